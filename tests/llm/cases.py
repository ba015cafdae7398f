"""Small documents with the hard cases: null and empty texts, long ones, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch int, node string, `doc_id.x` string"


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4))) for _ in range(n))


def rows(seed=1):
    r = random.Random(seed)
    base = [words(r, 60) for _ in range(6)]
    shared = words(r, 30)
    texts = [None, "", "  \t\n", "one", "A b c d", "a B c d", words(r, 3000), *base]
    for b in base[:4]:
        w = b.split(" ")
        texts += [b, b.upper(), " ".join([*w[:30], "x", *w[31:]]), " ".join([*w[:10], shared, *w[10:]])]
    texts += [shared, f"{shared} tail", "é Ω ß " * 20, "\u0000 nul\u0000 " * 8, "İstanbul ΣΑΣ " * 5]
    out = [(i + 1, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", "š", None]), None, 7, "n", "x") for i, t in enumerate(texts)]
    return [*out, out[8], out[8], (None, base[0], "en", None, 1, 1, None, None), (900, base[1], None, "s1", 1, 1, None, None)]


def documents(spark, seed=1):
    return spark.createDataFrame(rows(seed), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
