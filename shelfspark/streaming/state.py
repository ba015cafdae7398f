"""Stateful operators over streams: what they need of a session, and state that lives as long as it is asked for."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocks(spark: SparkSession) -> None:
    """Lists, maps, timers and time to live need this store; it also keeps state out of the heap. Set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
