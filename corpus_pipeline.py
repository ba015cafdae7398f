"""A corpus from documents: toxic ones out, one of each group of near-duplicates, secrets masked, sources mixed, texts encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents, and further
columns of any name as they came. Empty tables give empty tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import bpe, jaccard, mixing, secrets, toxicity
from shelfspark.llm.common import shared_dir
from shelfspark.llm.queries import table, vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Neural and statistical stages can't be put in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; null and empty texts stay. The model learns from the labelled documents among docs; without both labels nothing goes."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle Jaccard 0.75 stays, that of least doc_id. Rows with one doc_id become one; rows without doc_id, and null and empty texts, stay."""
    return jaccard.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found secret is replaced by a mark, and n_chars counted anew; null texts stay null. No row goes."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it; rows of one source share its target, null is a source. Sources without words go."""
    return mixing.repeat_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of every row, with their number and the digests of ids and decoded text; a null text has none."""
    return bpe.encode_documents(docs, vocabulary(), ids=True)


STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", mask_secrets), ("mixing", mix), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
