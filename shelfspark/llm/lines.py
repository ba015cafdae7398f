"""Line dedup: lines that several documents hold stay in the first of them only.

Native: DataFrame functions only. Lines are exploded and hashed (128 bits), distinct documents are
counted a hash, and a document's dropped positions come back to its text in one join; the text itself
moves once, lines never do.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, own_columns, stage

SPACES = " \t\n\x0b\x0c\r"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else. ``lower`` does just that where all is ASCII, and much faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(SPACES)))


def drop_repeated_lines(docs: DataFrame, least_documents: int = 2, least_chars: int = 10) -> DataFrame:
    """One row per row of docs: doc_id, text (what is left), n_lines (before dropping), n_dropped.

    A line goes if its key (spaces at both ends off, A-Z in lower case) has ``least_chars`` code points,
    is found in ``least_documents`` documents, and its own document isn't that of least doc_id among
    them. A document's own repeats of a line count once, and stay or go together.

    Null and empty texts are one empty line, which stays, and give an empty text. Rows of one doc_id
    are one document, each with its own text; all rows without doc_id are one document, after all
    others. An empty table gives an empty table; further columns are ignored.
    """
    own = own_columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    own = own.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(1), "text"))
    lines = own.select("doc_id", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    lines = lines.where(F.char_length("key") >= least_chars).select("doc_id", "t1", "t2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    lines = stage(lines, "lines")
    # a struct counts as a value even where its doc_id is null
    held = lines.groupBy("h1", "h2").agg(F.count_distinct(F.struct("doc_id")).alias("documents"), F.min("doc_id").alias("first"), F.count("*").alias("n"))
    repeated = stage(held.where(F.col("documents") >= least_documents).select("h1", "h2", "first", "n"), "repeated-lines")
    gone = join_counted(lines, repeated, ["h1", "h2"], lines.count()).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    gone = gone.groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    d, g = own.alias("d"), gone.alias("g")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.t1") == F.col("g.t1")) & (F.col("d.t2") == F.col("g.t2"))
    rows = d.join(g, same, "left").select("d.doc_id", F.split("d.text", "\n").alias("lines"), F.coalesce("g.gone", F.array().cast("array<int>")).alias("gone"))
    n = F.size("lines")
    # what lies between two dropped positions stays as it is
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    kept = F.flatten(F.zip_with(starts, F.concat("gone", F.array(n)), lambda a, b: F.slice("lines", a + 1, b - a)))
    return rows.select("doc_id", F.array_join(kept, "\n").alias("text"), n.cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"))
