"""Toxicity by maximum-scoring segments over token log-odds.

1. Tokens: a word's features are the word itself and its first 3 to 8 letters. Over labelled
   documents, each counted once a feature, the toxic rate of a feature has a Dirichlet prior
   around the rate of the next shorter feature, down to the rate of all documents; so an unseen
   form falls back on its stem, and a common word is not blamed for a stem it shares. A word's
   evidence is the log-odds of its longest known feature over those of all documents.
2. Scan: words without evidence cost ``drift``; one pass finds every maximal-scoring segment.
   Inside a segment the n-th time of a word counts an n-th.
3. Calibration: under clean text, segment scores follow an extreme-value law with parameters
   lambda and K; a text's evidence is how far its segments pass what its length makes likely, and
   a logistic curve fitted on labelled documents apart from those of step 1 makes it a score.

Labels may be fitted on a bounded sample (``most_labelled``); all texts are scored whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Remembered, first_by_hash, map_rows, mix64, own_columns, packed, shingles, stage, text_udf, word_hashes

STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PREFIXES = range(3, 9)
#: Documented bound of the fit: labelled documents looked at.
MOST_LABELLED = 40_000
#: A feature seen in fewer documents of the sample says no more than its stem.
LEAST_SEEN = 2
#: Weight of the prior, in documents; a feature with evidence has at least LEAST_DOCS toxic documents; evidence below LEAST is none.
PRIOR = 5.0
LEAST_DOCS = 4
LEAST = 1.2
THRESHOLD = 0.7


def features(word: bytes) -> list[str]:
    """Shortest first: stems, then the word itself."""
    w = word.strip(STRIP).decode().lower()
    if not w:
        return []
    return [*(w[:n] for n in PREFIXES if n <= len(w)), f"={w}"]


def stems(feature: str) -> list[str]:
    """The shorter features of a feature, longest first."""
    w = feature[1:] if feature[0] == "=" else feature
    return [w[:n] for n in reversed(PREFIXES) if n <= len(w) and w[:n] != feature]


@dataclass
class Model:
    """evidence: of features under a toxic stem. lam, k: of the extreme-value law. a, b, shift: of the logistic curve."""

    evidence: dict[str, float] = field(default_factory=dict)
    drift: float = 0.5
    lam: float = 1.0
    k: float = 0.1
    coef: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def score(self, word: bytes) -> float:
        """The evidence of a word's longest known feature if there is any, else -drift."""
        for f in reversed(features(word)):
            if f in self.evidence:
                e = self.evidence[f]
                return e if e > LEAST else -self.drift
        return -self.drift

    def excess(self, s: float, n: int) -> float:
        """-ln of the expected number of segments of score s or more in n clean words."""
        return self.lam * s - math.log(self.k * max(n, 2))

    def inputs(self, n: int, segments: list[tuple[float, int]]) -> tuple[float, float]:
        """(score, times) of segments -> of the best, and of all significant ones together; one that comes the n-th time adds an n-th."""
        x = [(e, t) for s, t in segments if (e := self.excess(s, n)) > 0]
        return (max(x)[0], math.log1p(sum(e / t for e, t in x))) if x else (0.0, 0.0)

    def probability(self, x: tuple[float, float]) -> float:
        t = self.coef[0] + self.coef[1] * x[0] + self.coef[2] * x[1]
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, t))))


class WordScores(Remembered):
    def __init__(self, model: Model, most: int = 120_000):
        super().__init__(model.score, most)
        self.model = model


def maximal_segments(scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (start, end, score), in one linear pass.

    Every score is positive or -drift, so runs between positive words are single steps. The
    candidates form a stack with the sums before and after each; a new candidate is merged
    leftwards while an earlier one begins lower and ends lower.
    """
    at = np.flatnonzero(scores > 0)
    stack: list[list] = []  # start, end, sum before, sum after, index of the nearest earlier candidate with a lower sum before
    total, last = 0.0, 0
    for i, s in zip(at.tolist(), scores[at].tolist()):
        total -= drift * (i - last)
        new = [i, i + 1, total, total + s, -1]
        total, last = total + s, i + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3], -1]
            del stack[j:]
    return [(a, b, y - x) for a, b, x, y, _ in stack]


def damped(words: list[bytes], s: np.ndarray, start: int, end: int, drift: float) -> float:
    """The best score inside a segment when the n-th time a word comes in it has an n-th of its evidence, so that one repeated line is not many findings."""
    times: dict[bytes, int] = {}
    best = run = 0.0
    last = start
    for i in (np.flatnonzero(s[start:end] > 0) + start).tolist():
        n = times[words[i]] = times.get(words[i], 0) + 1
        e = s[i] / n if s[i] / n > LEAST else -drift
        run = max(0.0, run - drift * (i - last)) + e
        best, last = max(best, run), i + 1
    return best


def _analyse(scores: WordScores, text: str | None):
    """Number of words, their scores, and the maximal segments of these as (start, end, damped score, how often its words of
    evidence have come in this order by now). What a segment holds and scores doesn't depend on what comes before it."""
    words = (text or "").encode().split()
    s = np.fromiter(map(scores.__getitem__, words), dtype=np.float64, count=len(words))
    drift, came, out = scores.model.drift, {}, []
    for a, b, _ in maximal_segments(s, drift):
        key = tuple(words[i] for i in (np.flatnonzero(s[a:b] > 0) + a).tolist())
        came[key] = came.get(key, 0) + 1
        out.append((a, b, damped(words, s, a, b, drift), came[key]))
    return len(words), s, out


def _labelled(docs: DataFrame, labels: DataFrame, modulus: int, held: int, most: int) -> DataFrame:
    """At most ``most`` labelled training documents: doc_id, toxic, part (0: tokens, 1: calibration), text.

    The sample is the first by a hash of doc_id among labelled rows outside the held-out fold; a
    doc_id with several labels counts as toxic if any says so."""
    y = own_columns(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null")
    y = y.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != held).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    y = first_by_hash(y, most, "doc_id")
    y = stage(y.withColumn("part", (F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)) == 0).cast("int")), "toxic-labels")
    # at most MOST_LABELLED rows of 16 bytes
    return own_columns(docs, "doc_id", "text").where("text is not null").join(F.broadcast(y), "doc_id")


def _once(rows: DataFrame) -> DataFrame:
    """One of each group of copies, exact or near, within a label: rows that agree in one of two min-hashes of their
    shingles. Otherwise every word of a text with copies would look like evidence."""

    def factory():
        def run(rows):
            out = {"toxic": rows["toxic"], "text": rows["text"], "a": [], "b": []}
            for h in map(shingles, word_hashes(rows["text"], lower=True)):
                out["a"].append(int(h[0] >> U64(1)) if len(h) else -1)
                out["b"].append(int(mix64(h ^ U64(0x5851F42D4C957F2D)).min() >> U64(1)) if len(h) else -1)
            return out

        return run

    hashed = map_rows(rows.select("toxic", "text"), factory, "toxic int, text string, a long, b long")
    one = hashed.groupBy("toxic", "a").agg(F.min(F.struct("text", "b")).alias("r")).select("toxic", F.col("r.text").alias("text"), F.col("r.b").alias("b"))
    return stage(one.groupBy("toxic", "b").agg(F.min("text").alias("text")), "toxic-fit")


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, most_labelled: int = MOST_LABELLED) -> Model:
    """Documents whose crc32(doc_id as text) mod ``modulus`` is ``held`` are not looked at."""
    sample = stage(_labelled(docs, labels, modulus, held, most_labelled).select("toxic", "part", "text"), "toxic-sample")
    model = Model()
    fit = _once(sample.where("part = 0"))
    n = {r.toxic: r.n for r in fit.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return model

    def factory():
        seen: dict[str, list[int]] = {}

        def flush():
            out = {"feature": list(seen), "toxic": [x[1] for x in seen.values()], "clean": [x[0] for x in seen.values()]}
            seen.clear()
            return out

        def run(rows):
            for y, text in zip(rows["toxic"], rows["text"]):
                for f in {f for w in set(text.encode().split()) for f in features(w)}:
                    seen.setdefault(f, [0, 0])[y] += 1
            if len(seen) > 300_000:
                return flush()

        run.finish = lambda: flush() if seen else None
        return run

    counts = stage(map_rows(fit.select("toxic", "text"), factory, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")), "toxic-counts")
    base = n[1] / (n[0] + n[1])
    heads = counts.where((F.col("t") >= LEAST_DOCS) & (F.col("t") >= 2 * base * (F.col("t") + F.col("c"))))
    heads = {r.feature for r in heads.select("feature").collect()}

    def under():
        def run(rows):
            keep = [i for i, f in enumerate(rows["feature"]) if f in heads or any(x in heads for x in stems(f))]
            return {k: [v[i] for i in keep] for k, v in rows.items()}

        return run

    known = map_rows(counts.where(F.col("t") + F.col("c") >= LEAST_SEEN), under, "feature string, t long, c long").collect()
    model.evidence = _evidence({r.feature: (r.t, r.c) for r in known}, base)

    parts = {(r.toxic, r.part) for r in sample.select("toxic", "part").distinct().collect()}
    clean = sample.where("toxic = 0 and part = 1" if (0, 1) in parts else "toxic = 0")
    model.lam, model.k = _extreme_value(*_clean_scores(clean, model), model.drift)
    rows = sample.where("part = 1") if {(0, 1), (1, 1)} <= parts else sample

    def measure():
        scores = WordScores(model)

        def run(rows):
            got = [(n, model.inputs(n, [x[2:] for x in found])) for n, _, found in (_analyse(scores, text) for text in rows["text"])]
            return {"toxic": rows["toxic"], "n": [n for n, _ in got], "best": [x[0] for _, x in got], "every": [x[1] for _, x in got]}

        return run

    # bounded by the sample: four numbers a document; in one order, so that sums come out the same
    found = sorted(tuple(r) for r in map_rows(rows.select("toxic", "text"), measure, "toxic int, n long, best double, every double").collect())
    model.coef = _logistic(np.array([(1.0, r[2], r[3]) for r in found]), np.array([r[0] for r in found], dtype=float))
    return model


def _clean_scores(clean: DataFrame, model: Model) -> tuple[list[tuple[float, int]], list[tuple[int, float]]]:
    """How often each positive word score comes in clean texts (a row a score that the evidence has), and (words, best segment) of each text, 0 for none."""

    def factory():
        scores, times = WordScores(model), {}

        def run(rows):
            out = {"words": [], "score": []}
            for text in rows["text"]:
                n, s, found = _analyse(scores, text)
                for x, k in zip(*np.unique(s[s > 0], return_counts=True)):
                    times[float(x)] = times.get(float(x), 0) + int(k)
                out["words"].append(n)
                out["score"].append(max((x[2] for x in found), default=0.0))
            return out | {"times": [None] * len(out["words"])}

        run.finish = lambda: {"words": [None] * len(times), "score": list(times), "times": list(times.values())}
        return run

    rows = stage(map_rows(clean.select("text"), factory, "words long, score double, times long"), "toxic-scores")
    words = sorted((r.score, r.n) for r in rows.where("times is not null").groupBy("score").agg(F.sum("times").alias("n")).collect())
    return words, sorted((r.words, r.score) for r in rows.where("times is null").select("words", "score").collect())


def _evidence(counts: dict[str, tuple[int, int]], base: float) -> dict[str, float]:
    """Log-odds of each feature's toxic rate over those of all documents. A feature seen in just the documents of its stem has its stem's."""
    rate: dict[str, float] = {}
    for f in sorted(counts, key=lambda x: (x[0] == "=", len(x), x)):
        t, c = counts[f]
        stem = next((x for x in stems(f) if x in rate), None)
        above = base if stem is None else rate[stem]
        rate[f] = above if stem is not None and counts[stem] == (t, c) else (t + PRIOR * above) / (t + c + PRIOR)
    odds = lambda x: math.log(x / (1 - x))
    return {f: odds(x) - odds(base) for f, x in rate.items()}


def _extreme_value(words: list[tuple[float, int]], texts: list[tuple[int, float]], drift: float) -> tuple[float, float]:
    """lambda with sum p(s) exp(lambda s) = 1 over clean words (one word of the mean evidence is added, so that it is finite), and K from the tail."""
    positive, times = np.array([s for s, _ in words]), np.array([t for _, t in words], dtype=float)
    n = sum(t for t, _ in texts) + 1
    positive, times = np.append(positive, (positive * times).sum() / times.sum() if len(words) else 1.0), np.append(times, 1.0)
    rest = max(0.0, n - times.sum()) / n
    f = lambda x: rest * math.exp(-x * drift) + float((times * np.exp(x * positive)).sum()) / n - 1
    low, high = 1e-6, 20.0 / float(positive.max())
    if f(low) >= 0:
        return 0.05, 1.0
    while f(high) < 0:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    x = sorted(low * best - math.log(max(t, 2)) for t, best in texts if best > 0)
    if not x:
        return low, 0.1
    at = x[int(0.9 * (len(x) - 1))]
    tail = sum(v >= at for v in x) / len(texts)
    return low, float(min(10.0, max(1e-3, tail * math.exp(at))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge-regularized by Newton steps; then shifted so that the cut with the best F1 is at THRESHOLD."""
    w, ridge = np.zeros(3), np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    t = x @ w
    order = np.argsort(-t, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.append(t[order][1:] < t[order][:-1], True)  # a cut lies between different values only
    i = int(np.argmax(np.where(ends, f1, -1)))
    low = t[order][i + 1] if i + 1 < len(y) else t[order][i] - 1
    w[0] += math.log(THRESHOLD / (1 - THRESHOLD)) - (t[order][i] + low) / 2
    return tuple(float(v) for v in w)


def scorer(model: Model):
    """A factory: texts -> score, predicted."""

    def factory():
        words = WordScores(model)

        def run(texts):
            score = []
            for text in texts:
                n, _, found = _analyse(words, text)
                score.append(model.probability(model.inputs(n, [x[2:] for x in found])))
            return {"score": score, "predicted": [int(x >= THRESHOLD) for x in score]}

        return run

    return factory


def score_documents(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts have no segment and so
    the lowest score. Without labels of both kinds every score is that of no evidence. A null doc_id
    is not held out."""
    model = train(docs, labels, modulus, held)
    make = scorer(model)

    def factory():
        f = make()
        return lambda rows: {"doc_id": rows["doc_id"], "held_out": rows["held_out"]} | f(rows["text"])

    d = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    return map_rows(d.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "text"), factory, "doc_id long, held_out boolean, score double, predicted int")


def passages(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """Every significant passage: doc_id, start_word, end_word (exclusive), score, excess (-ln of its expected number in clean text)."""

    def factory():
        words = WordScores(model)

        def run(rows):
            out = {"doc_id": [], "start_word": [], "end_word": [], "score": [], "excess": []}
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                n, _, found = _analyse(words, text)
                for a, b, v, _ in found:
                    if (e := model.excess(v, n)) > least:
                        for k, x in zip(out, (doc_id, a, b, v, e)):
                            out[k].append(x)
            return out

        return run

    d = own_columns(docs, "doc_id", "text")
    return map_rows(d.select(d.doc_id.cast("long"), "text"), factory, "doc_id long, start_word long, end_word long, score double, excess double")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose text is predicted toxic; all its columns, whatever their names. Null and empty texts stay."""
    found = text_udf(scorer(train(docs, labels)), "score double, predicted int")
    return packed(docs, found=found(docs["`text`"])).where("found.predicted = 0").select("row.*")
