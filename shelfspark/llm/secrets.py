"""Secret scans: base rules, and a character convolutional network over further candidates.

Base rules find assignments, access keys and long hex runs. Every other candidate, a run of 12 or
more token characters or what base findings leave of a run, is read by the network with the characters
before and after it; a long one in windows that overlap, of which the highest score counts. The network is trained on labelled findings: base findings and other
candidates of all documents, and findings made from formats and a seed, which pass through the same
rules. Windows are dealt into shards; in a pass each shard fits the same network in its own task, over
all its windows and the made ones, and the next pass begins with the mean of these networks. Scores are
calibrated on counts of all windows of a fold that training does not see, and the threshold is the
highest that keeps the asked recall there, of the table's findings and of the made ones; a made secret
that no candidate covers is a miss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, own_columns, packed, stage, text_udf

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# A run is cut short nowhere, so the least length can be part of the pattern here, but not in ASSIGN: a short
# value there still uses up its text.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = 12  # stated in CANDIDATE too
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~$%@.-]{12,}")
PART = re.compile(r"[A-Za-z0-9+/_=~$%@.-]+")

BEFORE, INSIDE, AFTER = 24, 48, 12
WIDTH = BEFORE + INSIDE + AFTER
STRIDE = 16
#: Made texts.
MADE = 1_500
#: Windows of a shard, about; passes over all windows in the first and in the second fit.
SHARD, FIRST, SECOND = 16_384, 3, 8
#: Windows of a batch by cell: of the table with label 0 and 1, made with label 0 and 1.
QUOTA = (96, 12, 10, 10)
#: Steps of a score, and of a parameter where networks are added up.
GRID, FINE = 256, 1 << 32
RECALL = 0.98
DOUBTFUL = 0.9


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, in order; kind indexes KINDS."""
    out = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of LEAST or more token characters outside base spans, and parts of any length that touch one, in order."""
    out, at = [], 0
    for a, _, end in [*base, (len(text), 0, len(text))]:
        if a > at:
            out += _outside(text, at, a)
        at = max(at, end)
    return out


def _outside(text: str, low: int, high: int) -> list[tuple[int, int]]:
    """The candidates between two base spans, or an end of the text and one."""
    out = [m.span() for m in CANDIDATE.finditer(text, low, high)]
    head = PART.match(text, low, high) if low else None
    if head and head.end() - low < LEAST:
        out.insert(0, head.span())
    a = high
    while high < len(text) and a > low and high - a < LEAST and PART.match(text[a - 1]):
        a -= 1
    if 0 < high - a < LEAST and (a, high) not in out:
        out.append((a, high))
    return out


def window(text: str, a: int, b: int) -> bytes:
    """BEFORE characters, up to INSIDE of the candidate, AFTER characters; one byte each, 0 for none, 127 for other scripts."""
    left = text[max(0, a - BEFORE) : a].rjust(BEFORE, "\0")
    inside = text[a : min(b, a + INSIDE)].ljust(INSIDE, "\0")
    right = text[b : b + AFTER].ljust(AFTER, "\0")
    return bytes(c if c < 127 else 127 for c in map(ord, left + inside + right))


def windows(text: str, a: int, b: int) -> Iterator[tuple[int, bytes]]:
    """(start, window) over a candidate every STRIDE characters, the last so that it ends with the candidate."""
    for s in chain(range(a, b - INSIDE, STRIDE), (max(a, b - INSIDE),)):
        yield s, window(text, s, min(s + INSIDE, b))


def owner(text: str, a: int, b: int) -> int:
    """A number for a finding in its surroundings."""
    return int.from_bytes(hashlib.sha256(window(text, a, b) + text[a:b].encode("utf-8", "replace")).digest()[:7])


def _letters(windows: bytes) -> np.ndarray:
    return np.frombuffer(windows, dtype=np.uint8).reshape(-1, WIDTH)


@dataclass
class Network:
    """Embedding, one convolution, maxima over the candidate and over its surroundings, one hidden layer."""

    e: np.ndarray
    w: np.ndarray
    b: np.ndarray
    h: np.ndarray
    hb: np.ndarray
    o: np.ndarray
    ob: np.ndarray
    platt: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    TAPS = 5

    @classmethod
    def new(cls, seed: int = 3, emb: int = 10, filters: int = 24, hidden: int = 24) -> Network:
        r = np.random.default_rng(seed)
        n = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        z = lambda *s: np.zeros(s, dtype=np.float32)
        return cls(n(128, emb) * 4, n(cls.TAPS * emb, filters), z(filters), n(2 * filters, hidden), z(hidden), n(hidden, 1), z(1))

    def parameters(self) -> list[np.ndarray]:
        return [self.e, self.w, self.b, self.h, self.hb, self.o, self.ob]

    def forward(self, x: np.ndarray):
        """The convolution is a sum of one looked-up row a tap and letter."""
        t, f = WIDTH - self.TAPS + 1, len(self.b)
        a = np.zeros((len(x), t, f), dtype=self.w.dtype)
        for j, w in enumerate(self.w.reshape(self.TAPS, -1, f)):
            a += (self.e @ w).take(x[:, j : j + t], axis=0)
        lo, hi = BEFORE, BEFORE + INSIDE - self.TAPS + 1
        inside, around = a[:, lo:hi], np.concatenate([a[:, :lo], a[:, hi:]], axis=1)
        i1, i2 = inside.argmax(1), around.argmax(1)
        top = np.concatenate([np.take_along_axis(inside, i1[:, None], 1)[:, 0], np.take_along_axis(around, i2[:, None], 1)[:, 0]], axis=1)
        at = np.concatenate([i1 + lo, np.where(i2 >= lo, i2 + hi - lo, i2)], axis=1)
        pool = np.maximum(top + np.tile(self.b, 2), 0)
        hid = np.maximum(pool @ self.h + self.hb, 0)
        return (hid @ self.o + self.ob)[:, 0], (at, pool, hid)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 3e-3, seed: int = 5) -> None:
        """Adam on the logistic loss, both classes weighted to halves."""
        r, ps = np.random.default_rng(seed), self.parameters()
        ms, vs, step = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps], 0
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for s in range(0, len(x), batch):
                k = order[s : s + batch]
                step += 1
                for p, g, m, v in zip(ps, self.gradients(x[k], y[k], weight[k]), ms, vs):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def gradients(self, x, y, weight):
        z, (at, pool, hid) = self.forward(x)
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(x)).astype(np.float32)[:, None]
        go, gob = hid.T @ d, d.sum(0)
        dh = (d @ self.o.T) * (hid > 0)
        gh, ghb = pool.T @ dh, dh.sum(0)
        dp = (dh @ self.h.T) * (pool > 0)
        f = len(self.b)
        ge, gw, rows, filters = np.zeros_like(self.e), [], np.arange(len(x))[:, None], np.tile(np.arange(f), 2)
        for j, w in enumerate(self.w.reshape(self.TAPS, -1, f)):
            letter = x[rows, at + j].astype(np.int64) * f + filters
            g = np.bincount(letter.ravel(), dp.ravel(), minlength=len(self.e) * f).reshape(-1, f).astype(dp.dtype)
            ge += g @ w.T
            gw.append(self.e.T @ g)
        return [ge, np.concatenate(gw), dp.reshape(-1, 2, f).sum((0, 1)), gh, ghb, go, gob]

    def copy(self) -> Network:
        return Network(*[p.copy() for p in self.parameters()], self.platt, self.threshold)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def refilled(self, flat: np.ndarray) -> Network:
        """A network of this one's shape with these parameters."""
        ps = self.parameters()
        parts = np.split(flat.astype(np.float32), np.cumsum([p.size for p in ps])[:-1])
        return Network(*[v.reshape(p.shape) for v, p in zip(parts, ps)])

    def descend(self, cells: list[np.ndarray], rate: float, seed: tuple[int, ...]) -> None:
        """Adam once over the windows of all cells, those of one or two rare ones several times: a batch takes QUOTA of each cell. Cells of one label weigh the same, labels a half each."""
        r, ps = np.random.default_rng(seed), self.parameters()
        held = [(c, q, i % 2) for i, (c, q) in enumerate(zip(cells, QUOTA)) if len(c)]
        steps = max(-(-len(c) // q) for c, q, _ in held)
        order = [np.resize(r.permutation(len(c)), steps * q) for c, q, _ in held]
        n = sum(q for _, q, _ in held)
        y = np.concatenate([np.full(q, label, dtype=np.float32) for _, q, label in held])
        weight = np.concatenate([np.full(q, 0.5 * n / q / sum(v == label for *_, v in held), dtype=np.float32) for _, q, label in held])
        ms, vs = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps]
        for s in range(steps):
            x = np.concatenate([c[k[s * q : (s + 1) * q]] for (c, q, _), k in zip(held, order)])
            for p, g, m, v in zip(ps, self.gradients(x, y, weight), ms, vs):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** (s + 1))) / (np.sqrt(v / (1 - 0.999 ** (s + 1))) + 1e-8)

    def steps(self, x: np.ndarray) -> np.ndarray:
        """Raw scores in steps of 1 / GRID, so that counts of them lose nothing."""
        z = np.concatenate([self.forward(x[i : i + 256])[0] for i in range(0, len(x), 256)] or [np.empty(0)])
        return np.rint(np.clip(z.astype(np.float64), -64, 64) * GRID).astype(np.int64)

    def probability(self, steps: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.platt[0] * (steps / GRID) + self.platt[1], -30, 30)))

    def score(self, windows: list[bytes]) -> np.ndarray:
        """Calibrated probabilities."""
        if not windows:
            return np.empty(0)
        return self.probability(self.steps(_letters(b"".join(windows))))

    def curve(self, steps: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """A logistic curve over raw scores."""
        z, weight = steps / GRID, weight / weight.sum()
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            g = np.array([((p - y) * z * weight).sum() + 1e-3 * (a - 1), ((p - y) * weight).sum()])
            q = p * (1 - p) * weight
            h = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
            d = np.linalg.solve(h, g)
            a, b = max(a - np.clip(d[0], -1, 1), 1e-3), b - np.clip(d[1], -1, 1)
        self.platt = (float(a), float(b))

    def cut(self, steps: np.ndarray, n: np.ndarray, recall: float, unread: int = 0) -> float:
        """The highest threshold with the recall, ``n`` findings having each score and ``unread`` ones being misses."""
        order = np.argsort(steps)
        at = np.searchsorted(np.cumsum(n[order]), int((1 - recall) * (n.sum() + unread)) - unread, side="right")
        return float(self.probability(steps[order[at]])) if n.sum() and int((1 - recall) * (n.sum() + unread)) >= unread else 0.0

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """The curve over the scores of windows, then the highest threshold with the recall."""
        z = self.steps(x)
        self.curve(z, y, np.ones(len(z)))
        self.threshold = self.cut(z[y > 0], np.ones(int((y > 0).sum())), recall) if (y > 0).any() else 0.5


def made_texts(n: int = MADE, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) from formats: keys and tokens in the settings where they leak, and look-alikes that are none."""
    r = np.random.default_rng(seed)
    pick = lambda s: s[int(r.integers(len(s)))]
    run = lambda s, a, b: "".join(pick(s) for _ in range(int(r.integers(a, b + 1))))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    mixed, b64 = low + up + dig, low + up + dig + "+/"
    word = lambda: run("aeiou", 1, 1) + run("rstlnmdh", 1, 2) + run("aeiou", 1, 2) + run("nrst", 0, 2)
    words = lambda k: " ".join(word() for _ in range(k))
    path = lambda: pick("/._-").join(word() for _ in range(int(r.integers(6, 30))))
    out = []
    for i in range(n):
        if i % 2:
            form = i // 2 % 9
            core = (
                pick(("ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "npm_")) + run(mixed, 24, 40),
                run(b64, 32, 60) + pick(("", "=", "==")),
                "eyJ" + run(mixed, 20, 40) + "." + run(mixed, 20, 40),
                run(mixed, 24, 48),
                run(up + dig, 20, 32),
                run("0123456789ABCDEF", 32, 64),
                run(mixed + "$%@~", 14, 24),
                run(low + up, 20, 40),
                run("$%@~", 1, 1) + run(mixed + "$%@~", 3, 16),
            )[form]
            lead = pick(("key = ", "Authorization: Bearer ", "export KEY=\"", "pwd: ", "credential ", "client_key='", "auth=", "private key ", "login ", words(3) + " "))
            if form == 8:  # what a base rule leaves of a value
                lead = pick(("password=", "secret: ", "token = \"", "api_key=")) + run(mixed, 6, 14)
            elif i // 2 % 4 == 0:  # late in a long run
                lead += path() + pick("/=._-")
            label = 1
        else:
            form = i // 2 % 16
            core = (
                f"{run(dig, 4, 4)}-{run(dig, 2, 2)}-{run(dig, 2, 2)}T{run(dig, 2, 2)}.{run(dig, 2, 2)}",
                f"{word()}{word()}{run(dig, 2, 4)}@{word()}.com",
                f"{word()}/{word()}/{word()}{run(dig, 2, 3)}.html",
                f"{word()}_{word()}_{run(dig, 2, 4)}",
                f"{run(dig, 3, 3)}-{run(dig, 3, 3)}-{run(dig, 4, 4)}{word()}",
                f"v{run(dig, 1, 2)}.{run(dig, 1, 2)}.{run(dig, 1, 3)}-{word()}",
                f"{word()}{word()}{word()}{run(dig, 2, 2)}",
                f"www.{word()}{word()}.org/{run(dig, 4, 6)}",
                f"{word().title()}{word().title()}{run(dig, 4, 4)}--{word()}",
                word() + word() + word() + word(),
                (word() + word() + word() + word()).upper(),
                "-".join(word() for _ in range(4)) + pick(("", ".", "...", "%")),
                f"{word()}/{word()}/{word()}/{word()}.{word()}",
                pick("-=_.~") * int(r.integers(12, 60)),
                pick((".html", ".js", "@" + word() + ".com", "." + word())),
                path(),
            )[form]
            core = core if form == 14 else core.ljust(LEAST, "x")
            lead, label = pick((words(4) + " ", "see ", "on ", "version ", "mail ", "page ")), 0
            if form == 14:  # what follows a base finding and is no part of it
                lead = run("0123456789abcdef", 24, 40) if core[0] == "." else "password=" + word() + word()
        text = words(3) + " " + lead + core + pick((" ", "\"", "\n", ". ")) + words(2)
        a = text.index(lead + core) + len(lead)
        out.append((text, a, a + len(core), label))
    return out


def _read(text: str, a: int, b: int) -> tuple[list[tuple[int, int]], bool]:
    """The candidates that overlap a finding, and whether they and base findings cover it."""
    base = base_spans(text)
    got = [(x, y) for x, y in candidates(text, base) if x < b and y > a]
    at = a
    for x, y in sorted(got + [(x, y) for x, _, y in base]):
        at = max(at, y) if x <= at else at
    return got, at >= b


def _made(n: int = MADE, seed: int = 11) -> list[tuple[bytes, int, int]]:
    """(window, label, owner) of made findings, as the scan reads them; a window that has a part of a secret only has no label."""
    out = []
    for text, a, b, label in made_texts(n, seed):
        for x, y in _read(text, a, b)[0]:
            for s, w in windows(text, x, y):
                inside = min(s + INSIDE, y, b) - max(s, a)
                if label == 0 or inside <= 0:
                    out.append((w, 0, owner(text, x, y)))
                elif 4 * inside >= 3 * min(b - a, INSIDE, y - x):
                    out.append((w, 1, owner(text, x, y)))
    return out


def made_findings(n: int = MADE, seed: int = 11) -> list[tuple[bytes, int]]:
    return [(w, label) for w, label, _ in _made(n, seed)]


@cache
def _made_arrays() -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """Windows, labels and owners of made findings, and the number of secrets among them that are not read whole."""
    w, label, own = zip(*_made())
    return (_letters(b"".join(w)), np.array(label), np.array(own)), sum(y > 0 and not _read(t, a, b)[1] for t, a, b, y in made_texts())


def labelled_findings(docs: DataFrame) -> DataFrame:
    """w, label, own: windows of base findings (1) and of other candidates (0) of all texts, equal windows once. Parts that touch a base finding have no label."""
    rows = own_columns(docs, "text").where("text is not null")

    def factory():
        def run(rows):
            out = {"label": [], "w": [], "own": []}

            def add(label, text, a, b):
                own = owner(text, a, b)
                for _, w in windows(text, a, b):
                    for k, v in zip(out, (label, w, own)):
                        out[k].append(v)

            for text in rows["text"]:
                base = base_spans(text)
                for a, k, b in base:
                    if k == 0:
                        m = ASSIGN.match(text, a)
                        a, b = m.span(2)
                    add(1, text, a, b)
                edges = {x for a, _, b in base for x in (a, b)}
                for a, b in candidates(text, base):
                    if a in edges or b in edges:
                        continue
                    add(0, text, a, b)
            return out

        return run

    return map_rows(rows, factory, "label int, w binary, own long").groupBy("w").agg(F.max("label").alias("label"), F.min("own").alias("own"))


PACKED = "shard long, w binary, label binary, own binary"


def shards(found: DataFrame, windows: int = SHARD) -> DataFrame:
    """One row a shard of about ``windows`` windows, dealt by their hash and in their order, so a fit does not depend on files and tasks."""
    found = stage(found, "secret-windows")
    n = max(1, round(found.count() / windows))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("w")
        own = t["own"].to_numpy().astype(np.int64)
        row = {"shard": t["shard"][:1], "w": [b"".join(t["w"].to_pylist())], "label": [t["label"].to_numpy().astype(np.uint8).tobytes()], "own": [own.tobytes()]}
        return pa.table({k: v if k == "shard" else pa.array(v, pa.binary()) for k, v in row.items()})

    dealt = found.withColumn("shard", F.pmod(F.xxhash64("w"), F.lit(n))).repartition(n, "shard")
    return stage(dealt.groupBy("shard").applyInArrow(pack, PACKED), "secret-shards")


def _unpacked(rows: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for shard, w, label, own in zip(*[rows[k] for k in ("shard", "w", "label", "own")]):
        yield shard, _letters(w), np.frombuffer(label, dtype=np.uint8), np.frombuffer(own, dtype=np.int64)


def learn(packed: DataFrame, passes: int, made: tuple[np.ndarray, np.ndarray, np.ndarray], rate: float = 3e-3) -> Network:
    """The mean of all shards' networks after each pass, in whole steps of 1 / FINE, so that their order does not matter. Windows of owners divisible by 5 are not seen."""
    x, y, own = made
    more = [x[(own % 5 != 0) & (y == v)] for v in (0, 1)]

    def factory_of(net: Network, k: int, rate: float):
        def factory():
            total, n = np.zeros(net.flat().size, dtype=np.int64), 0

            def run(rows):
                nonlocal n
                for shard, x, y, own in _unpacked(rows):
                    mine = net.copy()
                    mine.descend([x[(own % 5 != 0) & (y == v)] for v in (0, 1)] + more, rate, (k, shard))
                    total[:] += np.rint(mine.flat().astype(np.float64) * FINE).astype(np.int64)
                    n += 1

            run.finish = lambda: {"p": [[n, *total.tolist()]] if n else []}
            return run

        return factory

    net = Network.new()
    for k in range(passes):
        sums = map_rows(packed, factory_of(net, k, rate * (1 - k / passes)), "p array<long>").select(F.posexplode("p").alias("i", "v"))
        got = [r.v for r in sums.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()]
        if got:
            net = net.refilled(np.array(got[1:], dtype=np.float64) / FINE / got[0])
        else:
            none = np.empty((0, WIDTH), dtype=np.uint8)
            net.descend([none, none, *more], rate * (1 - k / passes), (k, 0))
    return net


def _fold_scores(packed: DataFrame, net: Network, label: int) -> DataFrame:
    """own, z: the raw score of each window of a label whose owner is divisible by 5."""

    def factory():
        def run(rows):
            out = {"own": [], "z": []}
            for _, x, y, own in _unpacked(rows):
                k = np.flatnonzero((own % 5 == 0) & (y == label))
                out["own"] += own[k].tolist()
                out["z"] += net.steps(x[k]).tolist()
            return out

        return run

    return map_rows(packed, factory, "own long, z long")


def _counts(scores: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(score, number of rows with it); scores have 128 * GRID + 1 values."""
    got = np.array([(r.z, r["count"]) for r in scores.groupBy("z").count().collect()], dtype=np.int64).reshape(-1, 2)
    return got[:, 0], got[:, 1]


def calibrated(net: Network, packed: DataFrame, made: tuple[np.ndarray, np.ndarray, np.ndarray], recall: float, unread: int) -> Network:
    """Curve and threshold from counts of all scores of the fold. Cells weigh as in the fit. A finding counts once, by its highest window, and the recall is kept
    on the table's findings and on the made ones, each by themselves."""
    x, y, own = made
    fold = own % 5 == 0
    z, y, own = net.steps(x[fold]), y[fold], own[fold]
    cells = [[_counts(_fold_scores(packed, net, v)), np.unique(z[y == v], return_counts=True)] for v in (0, 1)]
    parts = [(at, np.full(len(at), v), n / n.sum() / sum(len(m) > 0 for m, _ in cells[v])) for v in (0, 1) for at, n in cells[v] if len(at)]
    net.curve(*[np.concatenate(p) for p in zip(*parts)])
    best = _counts(_fold_scores(packed, net, 1).groupBy("own").agg(F.max("z").alias("z")))
    _, of = np.unique(own[y > 0], return_inverse=True)
    top = np.full(of.max() + 1, -64 * GRID)
    np.maximum.at(top, of, z[y > 0])
    net.threshold = net.cut(top, np.ones(len(top)), recall, unread)
    if len(best[0]):
        net.threshold = min(net.threshold, net.cut(*best, recall))
    return net


def sure(packed: DataFrame, net: Network) -> DataFrame:
    """The shards without windows of label 0 that the network takes for secrets (DOUBTFUL or more)."""

    def factory():
        def run(rows):
            out = {k: [] for k in ("shard", "w", "label", "own")}
            for shard, x, y, own in _unpacked(rows):
                k = (y > 0) | (net.probability(net.steps(x)) < DOUBTFUL)
                for c, v in zip(out, (shard, x[k].tobytes(), y[k].tobytes(), own[k].tobytes())):
                    out[c].append(v)
            return out

        return run

    return stage(map_rows(packed, factory, PACKED), "secret-sure")


def train(docs: DataFrame, recall: float = RECALL) -> Network:
    """Fitted twice: the rules call no candidate of the table clean, they only miss it. So candidates that the first fit
    takes for secrets (DOUBTFUL or more) have no label in the second one and in the calibration."""
    packed, (made, unread) = shards(labelled_findings(docs)), _made_arrays()
    first = calibrated(learn(packed, FIRST, made), packed, made, recall, unread)
    packed = sure(packed, first)
    return calibrated(learn(packed, SECOND, made), packed, made, recall, unread)


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _highest(net: Network, found: list[tuple[str, int, int]], most: int = 4096) -> np.ndarray:
    """The highest score of each candidate's windows; at most ``most`` windows are held at a time."""
    best, own, held = np.zeros(len(found)), [], []

    def flush():
        np.maximum.at(best, np.array(own, dtype=np.int64), net.score(held))
        own.clear()
        held.clear()

    for i, (text, a, b) in enumerate(found):
        for _, w in windows(text, a, b):
            own.append(i)
            held.append(w)
            if len(held) >= most:
                flush()
    flush()
    return best


def find_spans(texts: list[str], net: Network) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    others = [candidates(t, b) for t, b in zip(texts, base)]
    p = _highest(net, [(t, a, b) for t, c in zip(texts, others) for a, b in c])
    out, i = [], 0
    for b, c in zip(base, others):
        more = [(a, 3, e) for (a, e), s in zip(c, p[i : i + len(c)]) if s >= net.threshold]
        i += len(c)
        out.append((b, sorted(b + more)))
    return out


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_cnn for every row; a null text is empty."""
    net = net or train(docs)

    def factory():
        def run(rows):
            got = find_spans([t or "" for t in rows["text"]], net)
            n = lambda k: [sum(x[1] == k for x in b) for b, _ in got]
            return {
                "doc_id": rows["doc_id"], "n_assign": n(0), "n_access": n(1), "n_hex": n(2), "base_sha256": [hashlib.sha256(_digest(b).encode()).hexdigest() for b, _ in got],
                "spans": [_digest(s) for _, s in got], "n_cnn": [len(s) - len(b) for b, s in got],
            }

        return run

    d = own_columns(docs, "doc_id", "text")
    return map_rows(d.select(d.doc_id.cast("long"), "text"), factory, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by ``mark`` (overlapping spans by one) and n_chars counted anew; null texts stay null."""
    net = train(docs)

    def factory():
        def run(texts):
            out = []
            for t, (_, spans) in zip(texts, find_spans([t or "" for t in texts], net)):
                if t is None or not spans:
                    out.append(t)
                    continue
                parts, at, end = [], 0, -1
                for a, _, b in spans:
                    if a >= end:
                        parts += [t[at:a], mark]
                    at = end = max(end, b)
                out.append("".join(parts) + t[at:])
            return {"clean": out}

        return run

    clean = text_udf(factory, "clean string")
    out = packed(docs, found=clean(docs["`text`"]))
    named = {"text": F.col("found.clean"), "n_chars": F.length(F.col("found.clean")).cast("long")}
    return out.select(*[(named[c] if c in named else F.col("row").getField(c)).alias(c) for c in docs.columns])
