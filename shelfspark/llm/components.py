"""Connected components by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(a, b) of node ids -> (node, component): each node that has an edge to another, with the least id it reaches.

    A node with very many edges is only ever a key whose least neighbour is aggregated, or the
    many side of a join with one written row a key, which adaptive execution can split.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(e)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = e.withColumnRenamed("a", "v").join(least, F.col("b") == F.col("a")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "large-star")
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        new = _mark(e)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
