"""Genre dictionary: sources, priority, conflicts and what is missing."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as X
from .catalog import placed
from .refresh import latest

LAYERS = ["override", "source", "seed", "existing"]


def read_mapping(spark: SparkSession, path: str, layer: str, source_rank: int = 0) -> DataFrame:
    """S-20: a JSON object of code to label; blank codes and labels go, a code that can't be is an error."""
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("code", "label"))
    return clean_mapping(m, layer, source_rank)


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """F-13: entities to characters. Dictionaries are small; Spark has no function that knows all entities."""
    return s.map(html.unescape, na_action="ignore")


def clean_mapping(m: DataFrame, layer: str, source_rank: int = 0) -> DataFrame:
    rows = m.select(F.lit(layer).alias("layer"), F.lit(source_rank).alias("source_rank"), X.trim(F.col("code")).alias("code"), X.label(unescape("label")).alias("label"))
    rows = rows.where("code <> '' and label <> ''")
    bad = F.raise_error(F.concat(F.lit("invalid genre code: "), F.col("code"))).cast("string")
    return rows.withColumn("code", F.when(X.mapping_code_ok(F.col("code")), F.col("code")).otherwise(bad))


def xsd_codes(texts: DataFrame) -> DataFrame:
    """S-21: enumeration values of XML schemas in column value, trimmed; it is an error if there are none."""
    values = texts.select(F.explode(F.expr("xpath(value, '//*[local-name()=\"enumeration\"]/@value')")).alias("code"))
    found = values.select(X.trim(F.col("code")).alias("code")).where("code <> ''").distinct()
    if found.isEmpty():
        raise ValueError("the schema lists no genre codes")
    return found


# The three layouts of a line: how it looks, and which group is the code, which the label. The first that is found of a code counts.
CODE = "[a-z][a-z0-9_]*"
LAYOUTS = [
    (rf"^({CODE})\s*[-–—]\s*(.+)$", 1, 2),
    (rf"^(.+?)\s+\(({CODE})\)(?:\s*[-–—]\s*[\d\s]+)?$", 2, 1),
    (rf"^(?:\d+\.)+\d+\s+({CODE})\s*;\s*(.+)$", 1, 2),
]


def page_mapping(lines: DataFrame) -> DataFrame:
    """S-22: codes and labels of text lines in three layouts: ``code - label``, ``label (code)`` with or without a number after a dash, and
    ``1.2.3 code;label``; of a code the first layout counts, then its first line."""
    found = [F.struct(F.lit(rank).alias("rank"), F.regexp_extract("line", p, c).alias("code"), F.regexp_extract("line", p, t).alias("label")) for rank, (p, c, t) in enumerate(LAYOUTS)]
    rows = lines.select("pos", F.inline(F.array(*found))).where("code <> ''").withColumn("label", X.label(unescape("label"))).where("label <> ''")
    return latest(rows, ["code"], [F.col("rank"), F.col("pos")]).select("code", "label")


def _rank():
    out = F.lit(None).cast("int")
    for i, layer in reversed(list(enumerate(LAYERS))):
        out = F.when(F.col("layer") == layer, F.lit(i)).otherwise(out)
    return out


def merge(mappings: DataFrame) -> DataFrame:
    """SE-01, C-05: overrides, then sources in order, then seed, then what was there."""
    return latest(mappings.withColumn("__l", _rank()), ["code"], [F.col("__l"), F.col("source_rank"), F.col("label")]).drop("__l")


def conflicts(mappings: DataFrame) -> DataFrame:
    """SE-02: labels of later sources that differ from the first source's."""
    s = mappings.where("layer = 'source'")
    kept = latest(s, ["code"], [F.col("source_rank"), F.col("label")]).select("code", F.col("label").alias("kept"), F.col("source_rank").alias("kept_rank"))
    return s.join(kept, "code").where((F.col("source_rank") > F.col("kept_rank")) & (F.col("label") != F.col("kept"))).select("code", "kept", "label", "source_rank")


def coverage(merged: DataFrame, canonical: DataFrame) -> DataFrame:
    """SE-03: codes that are missing, or beyond the canonical ones."""
    c = canonical.select("code").distinct()
    return c.join(merged, "code", "left_anti").select("code", F.lit("missing").alias("kind")).unionByName(merged.join(c, "code", "left_anti").select("code", F.lit("extended").alias("kind")))


def report(mappings: DataFrame, canonical: DataFrame) -> DataFrame:
    """A-20: per source, codes that are canonical and those that aren't."""
    c = canonical.select(F.col("code").alias("__c")).distinct()
    s = mappings.where("layer = 'source'").join(c, F.col("code") == F.col("__c"), "left")
    return s.groupBy("source_rank").agg(F.count("__c").alias("canonical"), F.count_if(F.col("__c").isNull()).alias("other"))


def check_growth(new: DataFrame, old: DataFrame) -> DataFrame:
    """K-11: refuses to shrink the dictionary."""
    lost = old.join(new, "code", "left_anti")
    if not lost.isEmpty():
        raise ValueError("the new dictionary lacks codes of the old one")
    return new


def write_dictionary(new: DataFrame, path: str, old: DataFrame | None = None) -> None:
    """K-11: the dictionary as one JSON object with a line an entry, sorted by code; it is an error if codes of the old one are missing.

    The files of the folder, one after the other in the order of their names, are the object, so no task has to write it all."""
    if old is not None:
        check_growth(new, old)
    rows = placed(new.select("code", "label"), [F.col("code")])
    n = rows.count()
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("k"))), r"(?s)^\{\"k\":(.*)\}$", 1)
    line = F.concat(F.lit("  "), quoted("code"), F.lit(": "), quoted("label"), F.when(F.col("place") < n, ",").otherwise(""))
    spark = new.sparkSession
    ends = spark.range(2).select(F.when(F.col("id") == 0, 0).otherwise(n + 1).cast("long").alias("place"), F.when(F.col("id") == 0, "{").otherwise("}").alias("line"))
    whole = rows.select("place", line.alias("line")).unionByName(ends)
    whole.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "place").sortWithinPartitions("place").select("line").write.text(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(code, label) of what ``write_dictionary`` has written, whatever the number of its files."""
    lines = spark.read.text(path).where("value not in ('{', '}')")
    one = F.from_json(F.concat(F.lit("{"), F.regexp_replace("value", ",$", ""), F.lit("}")), "map<string,string>")
    return lines.select(F.explode(one).alias("code", "label"))
