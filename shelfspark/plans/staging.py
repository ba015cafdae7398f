"""Tables written to the folder that driver and executors share, to cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local session (one process, one disk) gets a
    folder of its own, and a cluster an error, for a local folder there would lose rows."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_shelfspark_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="shelfspark-")
        spark.sparkContext._shelfspark_dir = own
    return own


def own_dir(spark: SparkSession) -> str:
    """The application's folder in the shared one; it goes when the driver ends."""
    sc = spark.sparkContext
    own = getattr(sc, "_shelfspark_own_dir", None)
    if own is None:
        own = f"{shared_dir(spark)}/shelfspark/{sc.applicationId}"
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        sc._shelfspark_own_dir = own
    return own


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back; the planner then knows real sizes."""
    spark = df.sparkSession
    at = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
