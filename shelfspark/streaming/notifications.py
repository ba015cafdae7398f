"""ST-09: notifications from a stream of share changes, written batch by batch to a table; a batch that comes again changes nothing.

Under ``path``: ``events/batch=<id>`` has the events of a batch, ``state/batch=<id>`` the keys it has
changed, and ``base/batch=<id>`` all keys after that batch. A batch reads only what came before its own
id and overwrites its own folders, so a replay finds what the first try found and writes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.hadoop import Folder

KEY = ["viewer", "owner_uid"]
STATE = "viewer string, owner_uid string, active boolean, at long"
EVENTS = "viewer string, owner_uid string, event string, at long"
#: So many batches of changed keys are laid over a base; then there is a new base.
TOGETHER = 32


def _ids(folder: Folder, name: str, before: int) -> list[int]:
    ids = [int(n.split("=")[1]) for n in folder.names(name) if n.startswith("batch=")]
    return sorted(i for i in ids if i < before and folder.exists(f"{name}/batch={i}/_SUCCESS"))


def known(folder: Folder, before: int) -> DataFrame:
    """The state of every key as the batches before this one have left it."""
    base = max(_ids(folder, "base", before), default=-1)
    parts = [f"base/batch={base}"] * (base >= 0) + [f"state/batch={i}" for i in _ids(folder, "state", before) if i > base]
    if not parts:
        return folder.spark.createDataFrame([], STATE)
    rows = None
    for n, part in enumerate(parts):  # TOGETHER of them at most
        one = folder.spark.read.schema(STATE).parquet(f"{folder.path}/{part}").withColumn("n", F.lit(n))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(*KEY).agg(F.max_by(F.struct("active", "at"), "n").alias("s")).select(*KEY, "s.*")


def apply_batch(changes: DataFrame, batch: int, path: str) -> None:
    """changes: viewer, owner_uid, active, at. Granting makes an event ``new``, revoking ``dropped``, what is set already none; changes of a key go by time, at one time revoking first."""
    folder = Folder(changes.sparkSession, path)
    before = known(folder, batch)
    order = W.partitionBy(*KEY).orderBy("at", "active")
    rows = changes.select(*KEY, "active", "at").withColumn("was", F.lag("active").over(order)).withColumn("last", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("at"), F.desc("active"))) == 1)
    rows = rows.join(before.select(*KEY, F.col("active").alias("had")), KEY, "left").withColumn("was", F.coalesce("was", "had", F.lit(False)))
    events = rows.where(F.col("active") != F.col("was")).select(*KEY, F.when(F.col("active"), "new").otherwise("dropped").alias("event"), "at")
    events.write.mode("overwrite").parquet(f"{path}/events/batch={batch}")
    rows.where("last").select(*KEY, "active", "at").write.mode("overwrite").parquet(f"{path}/state/batch={batch}")
    base = max(_ids(folder, "base", batch + 1), default=-1)
    if sum(i > base for i in _ids(folder, "state", batch + 1)) >= TOGETHER:
        known(folder, batch + 1).write.mode("overwrite").parquet(f"{path}/base/batch={batch}")


def notification_events(spark, path: str) -> DataFrame:
    """All events so far."""
    return spark.read.schema(EVENTS).parquet(f"{path}/events")


def stream_notifications(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream; its query is returned."""
    return changes.writeStream.foreachBatch(lambda df, batch: apply_batch(df, batch, path)).option("checkpointLocation", checkpoint).start()


def windowed_lookups(log: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """W-06's streaming form: requests per user and sliding ten minutes, with late ones dropped behind the watermark."""
    return log.withWatermark("ts", lateness).groupBy(F.window("ts", "10 minutes", "5 minutes"), "uid").agg(F.count("*").alias("n"))
