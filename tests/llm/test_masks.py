"""Masks of sets bound overlaps from above, and keep sets of loosely alike texts from being sent for every pair."""

import random

import numpy as np
from pyspark.sql import functions as F

from shelfspark.llm import jaccard
from shelfspark.llm.common import U64

from .test_joins_and_models import check_jaccard


def test_masks_never_hide_a_common_element(spark):
    r = np.random.default_rng(7)
    rows = []
    for n in (1, 2, 15, 16, 17, 31, 33, 100, 129, 1000, 3000):
        for m in (n, -(-3 * n // 4)):
            for same in {0, m // 2, m}:
                a = np.unique(r.integers(0, 2**63, n, dtype=U64))
                b = np.unique(np.concatenate((a[:same], r.integers(0, 2**63, m - same, dtype=U64))))
                for x, y in ((a, b), (b, a)):
                    rows.append((len(x), len(y), len(np.intersect1d(x, y)), *(jaccard.set_mask(s).view(np.int64).tolist() for s in (x, y))))
    df = spark.createDataFrame(rows, "na long, nb long, o long, sa array<long>, sb array<long>")
    got = df.select("na", "nb", "o", (F.col("na") - jaccard._alone(F.col("sa"), F.col("sb"))).alias("most")).collect()
    assert all(x.o <= x.most <= x.na for x in got)
    assert all(x.most < 0.4 * x.na for x in got if x.o == 0 and x.na > 100)


def test_sets_are_sent_for_few_of_many_loosely_alike_texts(spark, monkeypatch):
    r = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    data = []
    for i in range(60):  # pairs are some 0.66 alike, and alike enough by their prefixes
        w = list(base)
        for j in r.sample(range(0, 400, 5), 8):
            w[j] = f"e{i}_{j}"
        data.append((i, " ".join(w)))
    rows, sent = {}, jaccard.stage

    def stage(df, name):
        out = sent(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stage", stage)
    check_jaccard(spark, data, spark.createDataFrame(data, "doc_id long, text string"))
    assert rows["jaccard-rest"][0] > 60
    pairs_with_sets = rows.get("possible-pairs", rows["jaccard-rest"])[-1]
    assert pairs_with_sets < rows["jaccard-rest"][0] / 4
