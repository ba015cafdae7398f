import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import common, divergence, lines, radix, vector_codes

from . import cases

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def last(x):
    return x is None, x or 0


def low(t):
    return t.translate(str.maketrans(UPPER, LOWER))


LINED = "doc_id long, text string, lines string, gone string, t1 long, `d.text` string"


def lined_rows():
    r = random.Random(6)
    pool = ["A long Line of text", "a LONG line of text\t", "\x0b a long line of text \r", "short", "", "Ärger mit Üblem", "ärger mit übleM", "äRGER mit Üblem", "ſ and K lines", "exactly 10", "only nine", "😀" * 10, "nul\x00 nul\x00 nul"]
    rows = [(i, "\n".join(r.choice([*pool, f"line {r.randint(0, 60)} of its own"]) for _ in range(r.randint(0, 9)))) for i in r.sample(range(900), 60)]
    rows += [(950, None), (951, ""), (952, "\n"), (953, "\n\n"), (954, "a long line of text\n" * 3), (955, "x\n" * 5000 + "a long line of text"), rows[0], rows[0], (rows[1][0], rows[2][1])]
    return rows + [(None, "a long line of text\nfor null ids only"), (None, "for null ids only\nexactly 10"), (None, rows[3][1]), (None, None), (-7, "twice in this one\ntwice in this one")]


def test_lines(spark):
    rows = lined_rows()
    docs = spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], LINED)

    def keys(text):
        return [low(x.strip(SPACE)) for x in (text or "").split("\n")]

    for least_documents in (2, 4):
        held = defaultdict(set)
        for i, t in rows:
            for k in keys(t):
                if len(k) >= 10:
                    held[k].add(i)
        want = []
        for i, t in rows:
            stays = [x for x, k in zip((t or "").split("\n"), keys(t)) if len(held[k]) < least_documents or min(held[k], key=last) == i]
            want.append((i, "\n".join(stays), len(keys(t)), len(keys(t)) - len(stays)))
        got = [tuple(r) for r in lines.drop_repeated_lines(docs, least_documents).collect()]
        assert sorted(got, key=lambda x: (last(x[0]), x[1:])) == sorted(want, key=lambda x: (last(x[0]), x[1:]))
    assert lines.drop_repeated_lines(docs.where("false")).count() == 0
    assert lines.drop_repeated_lines(cases.documents(spark)).count() == len(cases.rows())


def test_lines_are_native_and_move_no_line(spark):
    plan = lines.drop_repeated_lines(spark.createDataFrame([(1, "a long line of text"), (2, "a long line of text")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_counted_join_of_hot_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 5)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["a"] * 50 + [None] * 30 + ["b", "b", "c"])], "k string, i int")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("first")).where("k is null or k <> 'c'")
    got = Counter((r.k, r.n, r["first"]) for r in common.join_counted(rows, keyed, ["k"], rows.count()).collect())
    assert got == {("a", 50, 0): 50, (None, 30, 50): 30, ("b", 2, 80): 2}


def parts_of(v):
    d = len(v) // 4
    return [tuple(v[k * d : (k + 1) * d]) for k in range(4)]


def lloyd(vectors, rounds=4, entries=256):
    """(vec_id, embedding, label) -> codes, errors and codebooks with Python's integers."""
    rows = [(i, [math.floor(1024 * x) if abs(x) < 2**60 else int(x) * 1024 for x in e], label) for i, e, label in vectors]
    books = [[parts_of(e)[k] for _, e, _ in sorted(rows, key=lambda r: (last(r[0]), r[1]))[:entries]] for k in range(4)]

    def assign():
        out = []
        for _, e, _ in rows:
            its = [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(books[k])) for k, x in enumerate(parts_of(e))]
            out.append(([j for _, j in its], sum(d for d, _ in its)))
        return out

    for _ in range(rounds):
        codes = assign()
        for k in range(4):
            given = defaultdict(list)
            for (_, e, _), (code, _) in zip(rows, codes):
                given[code[k]].append(parts_of(e)[k])
            for j, its in given.items():
                books[k][j] = tuple(sum(c) // len(its) for c in zip(*its))
    codes = assign()
    labels = Counter()
    for (_, _, label), (_, error) in zip(rows, codes):
        labels[label] += error
    return sorted([(i, bytes(code).hex(), error, labels[label]) for (i, _, label), (code, error) in zip(rows, codes)], key=lambda r: (last(r[0]), r[1:])), books


VECTORS = "vec_id long, embedding array<float>, label int, code string, n long, `a.error` string"


@pytest.mark.parametrize("case", ["plain", "few", "ties", "large", "huge"])
def test_codes(spark, case):
    r = random.Random(case)
    n, size = (40, 20) if case in ("few", "huge") else (420, 8)
    draw = {"ties": lambda: r.randint(0, 2) / 1024, "large": lambda: r.uniform(-(2.0**19), 2.0**19), "huge": lambda: r.choice([1e30, -2.5e30, 2.0**41, 5.5, 0.0])}.get(case, lambda: r.gauss(0, 0.3))
    # what Spark holds are floats of 32 bits
    rows = [(i if r.random() < 0.98 else None, [float(np.float32(draw())) for _ in range(size)], r.choice([0, 0, 1, None])) for i in r.sample(range(9 * n), n)]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1], 1)]
    bad = [(1, None, 0), (2, [None] * size, 0), (3, [float("nan")] * size, 1), (4, [0.5] * (size - 1) + [float("-inf")], 1), (5, [0.5, None], None)]
    df = spark.createDataFrame([(*v, "x", 1, "y") for v in [*rows, *bad]], VECTORS)
    want, books = lloyd(rows)
    got, its = vector_codes.compress_vectors(df)
    assert sorted([(x.vec_id, bytes(x.code).hex(), x.error, x.label_error) for x in got.collect()], key=lambda x: (last(x[0]), x[1:])) == want
    assert [[tuple(e) for e in b] for b in books] == [[tuple(e.tolist()) for e in b] for b in its]
    text = ",".join(str(v) for b in books for e in b for v in e)
    assert vector_codes.digest(its) == hashlib.sha256(text.encode()).hexdigest()
    none, its = vector_codes.compress_vectors(df.where("vec_id is not null and vec_id < 0"))
    assert none.count() == 0 and its == []


def test_vectors_of_other_lengths_are_an_error(spark):
    for rows in ([(1, [1.0] * 8, 0), (2, [1.0] * 4, 0)], [(1, [1.0] * 6, 0)]):
        with pytest.raises(ValueError, match="components"):
            vector_codes.compress_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    rows, _ = vector_codes.compress_vectors(spark.createDataFrame([(1, [], 0), (2, [], None)], "vec_id long, embedding array<float>, label int"))
    assert sorted((r.vec_id, r.error, bytes(r.code)) for r in rows.collect()) == [(1, 0, bytes(4)), (2, 0, bytes(4))]


def test_bounds_stay_true_and_prune():
    r = np.random.default_rng(8)
    centres = r.integers(-900, 900, (40, 6))
    x = (centres[r.integers(0, 40, 2000)] + r.integers(-60, 60, (2000, 6))).astype(np.int64)
    entries, gone = x[:64].copy(), np.zeros(64)
    code, upper, step, lower, _ = vector_codes.Part(entries, gone).first(x)
    measured = []
    for _ in range(4):
        moved = entries.copy()
        for j in set(code.tolist()):
            its = x[code == j]
            moved[j] = its.sum(0) // len(its)
        gone = vector_codes.above(gone + vector_codes.above(np.sqrt(((moved - entries) ** 2).sum(1).astype(float))))
        entries = moved
        part = vector_codes.Part(entries, gone)
        true = np.sqrt(((x[:, None, :] - entries[None]) ** 2).sum(2).astype(float))
        assert (true >= lower * step[:, None].astype(float) - gone[None] - 1e-6).all()
        assert (true[np.arange(len(x)), code] <= upper.astype(float) + gone[code] + 1e-6).all()
        code, upper, lower, n = part.again(x, code, upper, step, lower)
        measured.append(n)
        assert (code == ((x[:, None, :] - entries[None]) ** 2).sum(2).argmin(1)).all()
    assert max(measured) < 0.2 * x.shape[0] * 64 and measured[-1] < measured[0]


def audit(rows, least_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]

    def words(t):
        return low("".join(c if c.isascii() and c.isalpha() or ord(c) >= 0x80 else " " for c in t)).split(" ")

    docs, n, of = Counter(), Counter(), Counter()
    for lang, source, text in rows:
        its = [w for w in words(text) if w]
        docs.update({(lang, w) for w in its})
        of.update((lang, source, w) for w in its)
        n.update((lang, w) for w in its)
    kept = defaultdict(list)
    for (lang, w), c in docs.items():
        if c >= least_docs:
            kept[lang].append(w)
    groups, out = sorted({r[:2] for r in rows}), []

    def share(count, lang, its):
        return 1 + 10**9 * (count + 5) // (sum(its(w) for w in kept[lang]) + 5 * len(kept[lang]))

    p = {(lang, s, w): share(of[lang, s, w], lang, lambda x: of[lang, s, x]) for lang, s in groups for w in kept[lang]}
    for lang, s in groups:
        q = {w: share(n[lang, w], lang, lambda x: n[lang, x]) for w in kept[lang]}
        pair = [(sum(abs(p[lang, s, w] - p[lang, o, w]) for w in kept[lang]), o) for la, o in groups if la == lang and o != s]
        term = [(p[lang, s, w] - q[w], w) for w in kept[lang] if of[lang, s, w] and p[lang, s, w] > q[w]]
        for part, its in (("pair", pair), ("term", term)):
            its.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(its) if part == "pair" or k < top]
    return sorted(out)


AUDITED = "lang string, source string, text string, term string, n string, p int, held string"


@pytest.mark.parametrize("small", [1, 4096])
def test_audit(spark, monkeypatch, small):
    monkeypatch.setattr(divergence, "MOST_COUNTS", 50)
    monkeypatch.setattr(divergence, "PIECE", 40)
    monkeypatch.setattr(radix, "SMALL", small)
    monkeypatch.setattr(divergence, "top_of_groups", lambda rows, keys, k: radix.top_of_groups(rows, keys, k, small))
    r = random.Random(11)
    pool = ["the", "The", "and", "Ärger", "ärger", "été", "x1y", "漢字", "a-b", "it's", *("w" + "".join(r.choice("abc") for _ in range(5)) for _ in range(150))]
    rows = [(r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "š", None, ""]), " ".join(r.choices(pool, k=r.randint(0, 60)))) for _ in range(300)]
    rows += [("xx", "alone", "nothing is kept"), ("xx", "too", None), ("yy", "one", "the " * 40), ("yy", "none", ""), ("zz", None, None), rows[0], rows[0]]
    rows += [("yy", "one", "the and")] * 30
    df = spark.createDataFrame([(*x, "t", "n", 1, "h") for x in rows], AUDITED)
    for least, top in ((2, 50), (6, 7)):
        assert sorted(tuple(x) for x in divergence.audit_sources(df, least, top).collect()) == audit(rows, least, top)
    assert divergence.audit_sources(df.where("false")).count() == 0
    assert divergence.audit_sources(cases.documents(spark)).count() >= 0


@pytest.mark.parametrize("small", [0, 3, 4096])
def test_radix_selection(spark, small):
    r = random.Random(5)
    rows = {(f"g{r.randint(0, 3)}", "".join(r.choice("aéz漢") for _ in range(r.randint(1, 7)))): r.choice([0, 7, 1 << 20, (1 << 30) - 1, r.randint(0, 2000)]) for _ in range(1500)}
    rows |= {("long", "q" * 12 + str(i)): 3 for i in range(30)} | {("few", "a"): 1, ("few", "b"): 1}
    df = spark.createDataFrame([(g, item, v) for (g, item), v in rows.items()], "g string, item string, value long")
    for k in (1, 20):
        want = []
        for g in {g for g, _ in rows}:
            its = sorted(((v, item) for (h, item), v in rows.items() if h == g), key=lambda x: (-x[0], x[1].encode()))[:k]
            want += [(g, item, v, n + 1) for n, (v, item) in enumerate(its)]
        assert sorted(tuple(x) for x in radix.top_of_groups(df, ["g"], k, small).collect()) == sorted(want)
