"""The k highest rows of every group by radix selection: histograms, not sorts.

A histogram over ten value bits, highest first, says in which bucket of each group the k-th value
lies; the next one looks inside that bucket only, so after three rounds each group's threshold is
known. Rows that tie at it are told apart by their item's UTF-8 bytes, two a round, in the same way.
Only what is at or above a threshold is ordered at last, ``k + SMALL`` rows a group at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if, stage

#: Values are below 2 ** (BITS * ROUNDS).
BITS, ROUNDS = 10, 3
#: So many ties of a group at most are ordered without a further histogram.
SMALL = 4096
#: State of so many groups at most is broadcast (some 100 bytes each).
MOST_GROUPS = 50_000


def _pick(histogram: DataFrame, keys: list[str], order) -> DataFrame:
    """Of each group's buckets (bucket, n, need) the one where the needed count is reached, with what is then still needed; none for a group that has too few rows."""
    up_to = F.sum("n").over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return histogram.withColumn("end", up_to).where("end - n < need AND need <= end").withColumn("need", F.col("need") - (F.col("end") - F.col("n"))).drop("end")


def _bytes(name: str) -> str:
    return f"CAST({name} AS BINARY)"


def thresholds(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, at (the k-th highest value of the group), n (rows at it), need (how many of them are among the k). No row for a group with less than k."""
    found = None
    for r in range(ROUNDS):
        shift = BITS * (ROUNDS - 1 - r)
        if found is None:
            hit = rows.withColumn("need", F.lit(k).cast("long"))
        else:
            hit = rows.join(broadcast_if(found, MOST_GROUPS), keys).where(F.shiftright("value", shift + BITS) == F.col("at"))
        histogram = hit.groupBy(*keys, F.shiftright("value", shift).alias("at")).agg(F.count("*").alias("n"), F.first("need").alias("need"))
        found = stage(_pick(histogram, keys, F.col("at").desc()).select(*keys, "at", "n", "need"), "radix")
    return found


def _refined(rows: DataFrame, found: DataFrame, keys: list[str], small: int) -> DataFrame:
    """found with upto: the bytes with which the last of the items that are needed begins. No group keeps more than ``small`` items that begin so, unless they are all needed."""
    found = found.withColumn("upto", F.lit(b"")).withColumn("open", (F.col("n") > small) & (F.col("n") > F.col("need")))
    while not found.where("open").isEmpty():
        its = rows.join(broadcast_if(found.where("open"), MOST_GROUPS), keys).where(F.expr(f"value = at AND substring({_bytes('item')}, 1, length(upto)) = upto"))
        histogram = its.groupBy(*keys, "at", "upto", F.expr(f"substring({_bytes('item')}, length(upto) + 1, 2)").alias("bucket")).agg(F.count("*").alias("n"), F.first("need").alias("need"))
        went = _pick(histogram, keys, F.col("bucket").asc()).withColumn("upto", F.concat("upto", "bucket"))
        still = (F.length("bucket") == 2) & (F.col("n") > small) & (F.col("n") > F.col("need"))
        went = went.select(*keys, "at", "n", "need", "upto", still.alias("open"))
        found = stage(found.where("NOT open").select(*keys, "at", "n", "need", "upto", "open").unionByName(went), "radix-ties")
    return found


def top_of_groups(rows: DataFrame, keys: list[str], k: int, small: int = SMALL) -> DataFrame:
    """keys, item, value, rank: the k highest of each group of ``rows`` (keys, item string, value long from 0 to below 2 ** 30), equal values by the item's bytes.

    keys are not null. An item is once in a group. A group with less than k rows gives all of them.
    """
    found = _refined(rows, thresholds(rows, keys, k), keys, small).select(*keys, "at", "upto")
    left = rows.join(broadcast_if(found, MOST_GROUPS), keys, "left")
    left = left.where(F.expr(f"at IS NULL OR value > at OR (value = at AND substring({_bytes('item')}, 1, length(upto)) <= upto)"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("value").desc(), F.col("item")))
    return left.select(*keys, "item", "value", rank.alias("rank")).where(F.col("rank") <= k)
