import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import jaccard, langid, metric_join, toxicity
from shelfspark.llm.components import components

from . import cases


def groups(n, pairs):
    p = list(range(n))

    def top(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        p[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_components(spark):
    r = random.Random(1)
    e = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(400, i) for i in range(401, 500)] + [(i, i + 1) for i in range(600, 660)] + [(7, 7)]
    top = groups(700, e)
    got = {x.node: x.component for x in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: top[i] for i in {x for a, b in e if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_of_heads_lose_no_pair(spark):
    c = F.col
    pairs = spark.range(4000).select((20 + F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(150))).alias("na"), (20 + F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(150))).alias("nb"), (1 + F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(30))).alias("common"))
    wider = pairs.withColumns({"least": c("nb") - F.lit(2), "most": c("nb") + F.lit(3)})
    of = wider.select(jaccard._fit(c("na"), c("nb"), c("common")).alias("fit"), jaccard._may_fit(c("na"), c("least"), c("most"), c("common") + 1).alias("may"))
    got = Counter((x.fit, x.may) for x in of.collect())
    assert got[True, False] == 0 and got[True, True] and got[False, False] > 1000


def check_jaccard(spark, data, docs):
    ids, sets = [], []
    for i, t in data:
        w = (t or "").encode().lower().split()
        ids.append(i)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    pairs, by = [], {}
    for k, s in enumerate(sets):
        if ids[k] is None:
            continue
        if ids[k] in by:
            pairs.append((by[ids[k]], k))
        by.setdefault(ids[k], k)
    for a in range(len(sets)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and None not in (ids[a], ids[b]) and 100 * o >= 75 * len(sets[a] | sets[b]):
                pairs.append((a, b))
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k]))
    rank = {k: r for r, k in enumerate(order)}
    top = groups(len(ids), [(rank[a], rank[b]) for a, b in pairs])
    want = Counter((ids[k], len(sets[k]), ids[order[top[rank[k]]]]) for k in range(len(ids)))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()) == want
    return want


def test_jaccard_cases(spark):
    check_jaccard(spark, [(i, t) for i, t, *_ in cases.rows()], cases.documents(spark))
    assert jaccard.near_duplicates(cases.empty(spark)).count() == 0


def test_jaccard_chains_hubs_and_common_passages(spark):
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    hub, passage, chain = text(120), text(25), text(100)
    data = [(1000, hub)]
    for i in range(40):  # each near the hub, most far from each other
        w = list(hub)
        for j in r.sample(range(120), 2):
            w[j] = f"e{i}{j}"
        data.append((i, w))
    for i in range(40):  # one passage in documents that are apart otherwise
        w = text(r.randint(10, 200))
        data.append((100 + i, [*w[: len(w) // 2], *passage, *w[len(w) // 2 :]]))
    for i in range(25):  # each near the next only
        data.append((200 + i, [f"z{k}" for k in range(i * 8)][-0:] + chain[i * 3 :] + [f"y{k}" for k in range(i * 3)]))
    data += [(300 + i, text(r.randint(0, 8))) for i in range(20)] + [(400, hub), (401, hub)]
    data = [(i, " ".join(w)) for i, w in data]
    want = check_jaccard(spark, data, spark.createDataFrame(data, "doc_id long, text string"))
    assert max(Counter(c for _, _, c in want.elements()).values()) > 30


def test_one_of_each_group_stays(spark):
    kept = jaccard.keep_one(cases.documents(spark)).collect()
    found = jaccard.near_duplicates(cases.documents(spark)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({r.component_id for r in found if r.component_id is not None})
    assert len([r for r in kept if r.doc_id is None]) == 1


def vectors(seed=1):
    r = np.random.default_rng(seed)
    out = []
    for g in range(12):
        c = r.standard_normal(16)
        out += [(c + r.standard_normal(16) * r.uniform(0.0, 0.3)) for _ in range(15)]
    rows = [(i, [float(np.float32(x)) for x in v], i % 3) for i, v in enumerate(out)]
    hot = rows[0][1]
    rows += [(500 + i, hot, 0) for i in range(10)] + [(600, [x * 2 for x in hot], 0), (700, None, 0), (701, [], 0), (702, [0.0] * 16, 0), (703, [float("nan")] * 16, 0), (704, [None] * 16, 0), (705, [float("inf")] + [1.0] * 15, 0), (706, hot, None), (707, hot[:8], 0), (708, [1e-200] * 16, 1), (709, [1e200] * 16, 1)]
    return rows


@pytest.mark.parametrize("cell,block", [(4096, 4096), (10, 7)])
def test_metric_join(spark, cell, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit("x")).withColumn("n", F.lit(1))
    unit = []
    for _, v, y in rows:
        ok = y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        a = np.array(v, dtype=float) / np.abs(v).max() if ok else None
        unit.append(None if a is None else a / np.linalg.norm(a))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]
    top, n = groups(len(rows), pairs), Counter(x for p in pairs for x in p)
    want = sorted((r[0], n[k], rows[top[k]][0], top[k] == k) for k, r in enumerate(rows))
    got = metric_join.link_vectors(df, cell=cell, block=block).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want
    assert metric_join.link_vectors(df.where("false")).count() == 0


LANGS = {"xx": "bando gelu mira toke", "yy": "schtrum welf knorz pfalt", "zz": "ouais quelle étre vaux"}


def test_language(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(LANGS[k].split()) for _ in range(r.randint(1, 40))), k) for i in range(120) for k in [r.choice(list(LANGS))]]
    rows += [(900, None, "xx"), (901, " 12 !? ", "xx"), (902, "", None), (None, "bando", "xx"), (903, "bando gelu mira " * 20_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {x.doc_id: x for x in langid.identify(docs).collect()}
    assert len(got) == len(rows)
    for i, t, k in rows:
        assert got[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1
        assert got[i].lang_pred == ("und" if not t or not any(map(str.isalpha, t)) else k or "xx")
    assert langid.identify(docs.where("false")).count() == 0
    assert {x.lang_pred for x in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_segments_against_brute_force():
    """Ruzzo and Tompa's definition: the best interval, then the same to its left and right."""
    r = np.random.default_rng(3)

    def brute(s, a, b):
        best, at = 0.0, None
        for i in range(a, b):
            t = 0.0
            for j in range(i, b):
                t += s[j]
                if t > best + 1e-12:
                    best, at = t, (i, j + 1)
        return [] if at is None else [*brute(s, a, at[0]), at, *brute(s, at[1], b)]

    for _ in range(60):
        s = np.where(r.random(30) < 0.3, r.uniform(0.5, 4, 30), -0.5)
        assert [x[:2] for x in toxicity.maximal_segments(s, 0.5)] == brute(s, 0, 30)
    assert toxicity.maximal_segments(np.empty(0), 0.5) == []


def toxic_rows(seed=4, n=600):
    r = random.Random(seed)
    plain = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(plain) for _ in range(r.randint(20, 120))]
        toxic = i % 6 == 0
        for j in r.sample(range(len(w)), r.randint(2, 4)) if toxic else ():
            w[j] = r.choice(["Zork!", "zork", "vile", "grumwei" + r.choice(plain), "vile,"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    rows += [(5000, None), (5001, ""), (None, "zork"), (5002, "zork " * 3 + "abc " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("x"))
    y = spark.createDataFrame([*labels, labels[0], (None, 1), (3, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score_documents(docs, y).collect()}
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got.values())
    held = [(got[i].predicted, v) for i, v in labels if got[i].held_out]
    assert got[5000].score == got[5001].score == min(x.score for x in got.values())
    assert sum(p and v for p, v in held) >= 0.9 * sum(v for _, v in held) and sum(p and not v for p, v in held) <= 0.03 * len(held)
    kept = {x.doc_id for x in toxicity.drop_toxic(docs, y).collect()}
    assert kept == {i for i, x in got.items() if not x.predicted}
    model = toxicity.train(docs, y)
    spans = toxicity.passages(docs.where("doc_id = 0"), model).collect()
    assert spans and all("zork" in p or "vile" in p or "grumwei" in p for x in spans for p in [" ".join(rows[0][1].lower().split()[x.start_word : x.end_word])])
    none = toxicity.score_documents(docs, y.where("toxic = 0"))
    assert none.where("predicted = 1").count() == 0 and none.count() == len(rows)
    assert toxicity.score_documents(docs.where("false"), y).count() == 0


def test_a_passage_scores_the_same_after_others(spark):
    model = toxicity.Model(evidence={"=vile": 4.0, "=zork": 5.0, "=grim": 3.0}, lam=1.0, k=0.1)
    dense, gap = "vile zork grim vile zork", " abc" * 200 + " "
    text = gap.join(["vile", "zork", "grim", "vile"] * 4 + [dense, dense, dense])
    got = toxicity.passages(spark.createDataFrame([(1, text), (2, dense)], "doc_id long, text string"), model, least=-100.0).collect()
    alone = [x.score for x in got if x.doc_id == 2]
    assert len(alone) == 1 and [x.score for x in sorted(got, key=lambda x: x.start_word) if x.doc_id == 1][-3:] == alone * 3
    one, line = model.inputs(100, [(9.0, 1)]), model.inputs(100, [(9.0, 1), (9.0, 2)])
    assert one[0] == line[0] and one[1] < line[1] < model.inputs(100, [(9.0, 1), (9.0, 1)])[1]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, labels = toxic_rows(n=150)
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[1:6])] + [(2000, "password=abcdef1234 " + rows[1][1]), (2001, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, v) for i, v in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    toxic = {i for i, v in labels if v}
    ids = {r.doc_id for r in out}
    assert out and not ids & {1000, 1001, 1002, 1003, 1004} and len(ids & toxic) <= 2
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "bpe"]


def test_language_against_loops(spark):
    """The whole method again, letter by letter, without the module's own steps."""
    r = random.Random(8)
    words = {"aa": "häuser über straße gäste", "bb": "дом река небо", "cc": "山水 火山 日本語 東京"}
    rows = [(i, " ".join(r.choice(words[k].split()) for _ in range(r.randint(1, 12))), k) for i in range(60) for k in [r.choice(list(words))]]
    rows += [(100, "Река Häuser 山", None), (101, "東京 12 reka", "aa"), (102, "ÜBER", None)]
    dim, seed, vectors = 256, 3, {}

    def letter(c):
        if c not in vectors:
            vectors[c] = np.random.default_rng((seed, c)).choice(np.array([-1, 1], dtype=np.int8), dim).astype(float)
        return vectors[c]

    def bundle(text):
        s = [0]
        for ch in text.lower():
            c = ord(ch) if ch.isalpha() else 0
            if c or s[-1]:
                s.append(c)
        s += [0] if s[-1] else []
        grams = [np.roll(letter(s[i]), 2) * np.roll(letter(s[i + 1]), 1) * letter(s[i + 2]) for i in range(len(s) - 2)]
        return np.sum(grams, axis=0) / len(grams)

    learnt = {}
    for i, t, k in rows:
        if k and zlib.crc32(str(i).encode()) % 5:
            learnt.setdefault(k, []).append(bundle(t))
    langs = sorted(learnt)
    p = np.array([np.mean(learnt[k], axis=0) for k in langs])
    mean = p.mean(axis=0)
    got = {x.doc_id: x for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dim=dim, seed=seed).collect()}
    for i, t, _ in rows:
        v = bundle(t) - mean
        cos = np.array([v @ (x - mean) / np.linalg.norm(v) / np.linalg.norm(x - mean) for x in p])
        e = np.exp(langid.SHARPNESS * cos)
        assert got[i].lang_pred == langs[int(cos.argmax())] and abs(got[i].score - e.max() / e.sum()) < 1e-4


def test_a_text_of_very_many_trigrams_takes_bounded_memory():
    import tracemalloc

    r = np.random.default_rng(4)
    text = "".join(map(chr, r.integers(0x4E00, 0x4F00, 110_000))) + " " + "".join(map(chr, r.integers(0x20000, 0x20100, 110_000)))
    space = langid.Space(langid.DIM, langid.SEED)
    space.bundles([text[:100]])
    tracemalloc.start()
    got, has = space.bundles([text, "plain words", None, text[:500]])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(space.trigrams(text)[0]) > 200_000 and most < 200 << 20 and has.tolist() == [True, True, False, True]
    for t, row in zip((text[:500], "plain words"), (got[3], got[1])):
        codes, n = space.trigrams(t)
        assert np.allclose(row, (n / n.sum()) @ space.vectors(codes), atol=1e-5)


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    rows = [(i, "abc def", f"l{i % 3}") for i in range(30)]
    with pytest.raises(ValueError, match="3 languages"):
        langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_toxicity_score_against_brute_force(spark):
    """Given the evidence of words: best intervals by trying all, damping, and the curve, without the module's own steps."""
    import math

    rows, labels = toxic_rows(n=300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    m = toxicity.train(docs, y)
    assert m.evidence

    def evidence(word):
        w = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower()
        for f in [f"={w}", *(w[:k] for k in range(8, 2, -1) if k <= len(w))]:
            if w and f in m.evidence:
                return m.evidence[f] if m.evidence[f] > toxicity.LEAST else -m.drift
        return -m.drift

    def best(s, a, b):
        top, at = 1e-12, None
        for i in range(a, b):
            t = 0.0
            for j in range(i, b):
                t += s[j]
                if t > top + 1e-12:
                    top, at = t, (i, j + 1)
        return [] if at is None else [*best(s, a, at[0]), at, *best(s, at[1], b)]

    got = {x.doc_id: x for x in toxicity.score_documents(docs, y).collect()}
    for i, text in rows[:60]:
        w = text.split()
        s = [evidence(x) for x in w]
        came, sig = Counter(), []
        for a, b in best(s, 0, len(s)):
            seen, run, top = Counter(), 0.0, 0.0
            for k in range(a, b):
                e = -m.drift
                if s[k] > 0:
                    seen[w[k]] += 1
                    e = s[k] / seen[w[k]] if s[k] / seen[w[k]] > toxicity.LEAST else -m.drift
                run = max(0.0, run) + e
                top = max(top, run)
            key = tuple(w[k] for k in range(a, b) if s[k] > 0)
            came[key] += 1
            excess = m.lam * top - math.log(m.k * max(len(w), 2))
            if excess > 0:
                sig.append((excess, came[key]))
        z = m.coef[0] + (m.coef[1] * max(sig)[0] + m.coef[2] * math.log1p(sum(e / t for e, t in sig)) if sig else 0.0)
        assert abs(got[i].score - 1 / (1 + math.exp(-z))) < 1e-6, i


def test_toxicity_keeps_columns_of_any_name(spark):
    rows, labels = toxic_rows(n=150)
    rows += [(900, None), (901, ""), (900, None)]
    docs = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id long, text string, __toxic string, found int, row int")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, y)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert {tuple(x)[2:] for x in got} == {("a", 1, 2)} and sum(x.doc_id == 900 for x in got) == 2 and len(got) < len(rows)
    assert toxicity.drop_toxic(docs.where("false"), y).count() == 0


def test_vectors_of_one_id_have_their_own_links(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [1.0, 0.01], "a"), (3, [0.01, 1.0], "a"), (4, [0.02, 1.0], "a"), (1, [0.0, 1.0], "b"), (9, [0.0, 1.0], "b"), (None, [1.0, 0.0], "a")]
    got = metric_join.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert Counter((x.vec_id, x.n_links, x.component_id) for x in got) == Counter([(1, 1, 1), (2, 1, 1), (1, 2, 1), (3, 2, 1), (4, 2, 1), (1, 1, 1), (9, 1, 1), (None, 0, None)])


def test_one_of_the_rows_of_an_id_stays(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, 1, "g"), (1, "quite another text of some words", 2, "g"), (2, long, 3, "g"), (3, None, 4, "g"), (3, "", 5, "g"), (None, long, 6, "g"), (None, long, 6, "g"), (4, "own text", 7, "g"), (4, "own text", 7, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, __gone string").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    first = jaccard.keep_one(docs).drop("m").collect()
    assert Counter(x.doc_id for x in first) == Counter([1, 3, 4, None, None]) and jaccard.keep_one(docs).columns == docs.columns
    again = jaccard.keep_one(docs.repartition(3)).drop("m").collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert jaccard.keep_one(docs.where("false")).count() == 0


def test_pipeline_of_hard_rows(spark, tmp_path):
    """Each stage's rows against what it says, with clashing columns, nulls, repeated rows, and without any row."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from shelfspark.llm.queries import vocabulary

    rows, labels = toxic_rows(n=150)
    rows += [(900, None), (901, ""), (None, rows[1][1] + " tail of a text"), (902, rows[2][1]), (902, rows[2][1]), (903, "password=abcdef1234 " + "plain " * 30_000)]
    more = ("c", "n", "r", 1)
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}", len(t or ""), *more) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __clean string, component_id string, row string, repeats int")
    spark.createDataFrame([(i, 1, v) for i, v in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    toxic, sf = {i for i, v in labels if v}, str(tmp_path)
    for d in (docs, docs.where("false")):
        before = d
        for name, stage in corpus_pipeline.STAGES:
            at = f"{tmp_path}/{name}-{d is docs}"
            stage(spark, before, sf).write.parquet(at)
            after = spark.read.parquet(at)
            old, new = before.collect(), after.collect()
            if name != "bpe":
                assert after.columns == docs.columns
            if d is not docs:
                assert not new
            elif name == "toxicity":
                assert {x.doc_id for x in old} - {x.doc_id for x in new} <= toxic and {x.doc_id for x in new} >= {900, 901, 902, 903, None}
            elif name == "near_duplicates":
                ids = Counter(x.doc_id for x in new)
                assert 902 not in ids and ids[None] == 1 and ids[900] == ids[901] == 1 and set(ids.values()) == {1}
            elif name == "secrets":
                assert sorted(str(x.doc_id) for x in new) == sorted(str(x.doc_id) for x in old)
                assert next(x.text for x in new if x.doc_id == 903).startswith("[SECRET] plain") and next(x.text for x in new if x.doc_id == 900) is None
                assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in new)
            elif name == "mixing":
                assert {tuple(x) for x in new} <= {tuple(x) for x in old} and max(Counter(x.doc_id for x in new).values()) <= 3
            else:
                t, text = Tokenizer.from_file(vocabulary()), {x.doc_id: x.text for x in old}
                assert len(new) == len(old) and all(list(x.ids) == t.encode(text[x.doc_id] or "", add_special_tokens=False).ids for x in new)
            before = after
