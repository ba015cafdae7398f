"""Mixing sources to target weights, by capped water-filling and seeded repetitions.

Native: DataFrame functions only. Sources are one row each after aggregation, so the
water-filling runs over as many rows as there are sources, never over documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import own_columns, packed, stage

WORD = r"[^\x20\x09-\x0D]+"
#: A plan of at most so many sources (some 100 bytes each) is broadcast; a larger one is joined by shuffle.
MOST_BROADCAST = 50_000
#: Hex digits of a document's key that make its bucket; half of them make its coarse bucket.
DIGITS = 4


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """(source, source_size) -> + target.

    Weights go round over the sources in code point order, null last. Each source's target
    is its weight's part of ``share`` of all words, clamped at ``max_epochs`` times its own
    size; what the clamped ones leave is dealt to the rest by weight, until none is above.
    The order of clamping is that of cap over weight, so prefix sums give the fixed point.
    """
    whole = W.partitionBy()
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    before = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    t = (
        totals.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)).cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("c", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", (F.col("all_words") - F.col("c")) * F.col("weight") > F.col("cap") * (F.col("all_weight") - F.col("w")).cast("double"))
    )
    left = F.col("all_words") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(whole)
    free = F.sum(F.when(F.col("capped"), F.lit(0)).otherwise(F.col("weight"))).over(whole)
    return t.withColumn("level", F.try_divide(left, free)).select(
        "source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target")
    )


def _cut(plan: DataFrame, sums: DataFrame) -> DataFrame:
    """plan with the bucket in which each source's rest ends, if any, and the words before it; sums has at most 256 rows a source."""
    up_to = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    t, c = plan.alias("t"), sums.withColumn("end", F.sum("words").over(up_to)).alias("c")
    start, end = F.col("t.base") + F.col("end") - F.col("words"), F.col("t.base") + F.col("end")
    hit = F.col("t.source").eqNullSafe(F.col("c.source")) & (start <= F.col("rest")) & (F.col("rest") < end)
    return t.join(c, hit, "left").select("t.source", "source_size", "target", "whole", "rest", F.col("bucket").alias("cut"), F.coalesce(start, F.col("t.base")).alias("base"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, share: float = 1.0, seed: int = 17) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, repeats.

    A document is taken whole ``floor(target / source_size)`` times; the fractional epoch
    takes documents in the order of a seeded key until the target is met to half a document.
    The cut is found from sums over 256 key buckets a source, then over 256 inside the one that
    holds it; only the last bucket's rows are ordered one by one. Null or empty texts have size 0; an empty table gives an empty
    table; equal rows count once each; a null doc_id is a document like others; further
    columns are ignored. A source without any words has the target 0 and repeats 0.
    """
    sizes = stage(_sized(own_columns(docs, "doc_id", "source", "text"), seed), "mix-sizes")
    rows = _take(sizes, _plan(sizes, weights, max_epochs, share))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")


def _sized(docs: DataFrame, seed: int, *more: str) -> DataFrame:
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), *more)


def _plan(sizes: DataFrame, weights: Sequence[int], max_epochs: int, share: float) -> DataFrame:
    """One row a source: source_size, target, whole, rest, and the last bucket with the words before it."""
    bucket = F.substring("key", 1, DIGITS)
    coarse = sizes.groupBy("source", F.substring("key", 1, DIGITS // 2).alias("bucket")).agg(F.sum("size").alias("words"))
    targets = source_targets(coarse.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs, share)
    targets = targets.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    targets = stage(targets.withColumn("base", F.lit(0).cast("long")), "mix-targets")
    few = targets.count() <= MOST_BROADCAST
    cut = stage(_cut(targets, coarse), "mix-cut")
    inside = sizes.alias("d").join((F.broadcast(cut) if few else cut).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & F.startswith("key", F.col("cut")))
    fine = inside.groupBy("d.source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    return stage(_cut(cut.drop("cut"), fine), "mix-plan")


def _take(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """sizes with their source's plan and repeats. Only rows of the last buckets are shuffled if the plan is small."""
    side = F.broadcast(plan) if plan.count() <= MOST_BROADCAST else plan
    rows = sizes.alias("d").join(side.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    rows = rows.select("d.*", "source_size", "target", "whole", "rest", "cut", "base", F.substring("key", 1, DIGITS).alias("bucket"))
    is_cut = F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False))
    ties = ["tie"] if "tie" in sizes.columns else []
    before = W.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", *ties).rowsBetween(W.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("size").over(before), F.lit(0))
    # no rest, no extra: rows of size 0 too stay within the epochs
    at_cut = rows.where(is_cut).withColumn("extra", (F.col("rest") > 0) & (start + F.col("size") / F.lit(2.0) <= F.col("rest")))
    clear = rows.where(~is_cut).withColumn("extra", (F.col("rest") > 0) & F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False)))
    return clear.unionByName(at_cut).withColumn("repeats", F.col("whole") + F.col("extra").cast("long"))


def repeat_rows(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, share: float = 1.0, seed: int = 17) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes that row, with docs' own columns, whatever their names.

    Rows that share a doc_id or have none are decided one by one, each by its own source. A null
    or empty text comes as often as its source's whole epochs and its place in the fractional one
    say; a source without any words does not come at all.
    """
    own = own_columns(docs, "doc_id", "source", "text")
    plan = _plan(stage(_sized(own, seed), "mix-sizes"), weights, max_epochs, share)
    c = lambda name: docs[f"`{name}`"]
    rows = packed(docs, doc_id=c("doc_id"), source=c("source"), text=c("text"), tie=F.xxhash64(c("text")))
    taken = _take(_sized(rows, seed, "tie", "row"), plan).where("repeats > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select("row.*")
