"""Keys that occur in more than one document, found without gathering any key's documents.

Documents are dealt into batches. A batch sends every key once, packed by key bucket, with a mark
if two of its documents hold it; a bucket answers each batch with those of its keys that another
batch also sent, or that are marked. A key that all documents hold is thus one number a batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64

SENT = "bucket int, batch int, keys binary, many binary"
SENT_COLUMNS = ["bucket", "batch", "keys", "many"]
ANSWER = "batch int, keys binary"


#: Bytes of a batch, about; a task holds one batch.
BATCH_BYTES = 64 << 20


def buckets(spark: SparkSession) -> int:
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches(spark: SparkSession, size: int) -> int:
    """Batches for ``size`` bytes of documents: two a shuffle partition, or more so that each is of BATCH_BYTES at most."""
    return max(buckets(spark), -(-size // BATCH_BYTES))


def batch_of(n: int, *cols: str):
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and how often each comes."""
    first = np.flatnonzero(np.concatenate(([len(x) > 0], x[1:] != x[:-1])))
    return x[first], np.diff(np.append(first, len(x)))


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array known."""
    if not len(known):
        return np.zeros(len(x), dtype=bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def distinct_of_documents(per_doc: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a batch, and which of them more than one document holds; each array is distinct."""
    if not per_doc:
        return np.empty(0, dtype=U64), np.empty(0, dtype=bool)
    keys, n = runs(np.sort(np.concatenate(per_doc)))
    return keys, n > 1


def send(batch: int, keys: np.ndarray, many: np.ndarray, buckets: int, kinds: np.ndarray | None = None) -> pd.DataFrame:
    """One row a bucket; keys must be sorted. A key's bucket is its top bits' share of the range. kinds: a number a key, to be added up."""
    at = np.searchsorted(keys, np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=U64))
    each = [keys, many] if kinds is None else [keys, many, kinds]
    parts = zip(range(buckets), *(np.split(x, at) for x in each))
    rows = [(b, batch, *(x.tobytes() for x in p)) for b, *p in parts if len(p[0])]
    return pd.DataFrame(rows, columns=[*SENT_COLUMNS, "kinds"][: 2 + len(each)])


def answer(rows: pd.DataFrame) -> pd.DataFrame:
    keys = [np.frombuffer(k, dtype=U64) for k in rows["keys"]]
    every = np.concatenate(keys)
    many = np.concatenate([np.frombuffer(m, dtype=bool) for m in rows["many"]])
    uniq, n = runs(np.sort(every))
    again = np.sort(np.concatenate((uniq[n > 1], every[many])))
    out = [(b, k[among(k, again)].tobytes()) for b, k in zip(rows["batch"], keys)]
    return pd.DataFrame([x for x in out if x[1]], columns=["batch", "keys"])


def answers(sent: DataFrame) -> DataFrame:
    return sent.groupBy("bucket").applyInPandas(answer, ANSWER)


def answers_with_spread(sent: DataFrame, wide: int) -> DataFrame:
    """answers, and which of their keys have ``wide`` kinds or more, all batches together."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(k, dtype=U64) for k in rows["keys"]])
        kinds = np.concatenate([np.frombuffer(k, dtype=np.uint16) for k in rows["kinds"]])
        order = np.argsort(keys, kind="stable")
        uniq, n = runs(keys[order])
        total = np.add.reduceat(kinds[order].astype(np.int64), np.cumsum(n) - n) if len(n) else n
        uniq = uniq[total >= wide]
        out = answer(rows)
        return out.assign(spread=[among(np.frombuffer(k, dtype=U64), uniq).tobytes() for k in out["keys"]])

    return sent.groupBy("bucket").applyInPandas(run, ANSWER + ", spread binary")


def answers_with_busy(sent: DataFrame) -> DataFrame:
    """answers, and which of their keys more than two documents may hold; any other key is held by just two documents, of two batches."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        every = np.concatenate([np.frombuffer(k, dtype=U64) for k in rows["keys"]])
        many = np.concatenate([np.frombuffer(m, dtype=bool) for m in rows["many"]])
        uniq, n = runs(np.sort(every))
        busy = np.sort(np.concatenate((uniq[n > 2], every[many])))
        out = answer(rows)
        return out.assign(spread=[among(np.frombuffer(k, dtype=U64), busy).tobytes() for k in out["keys"]])

    return sent.groupBy("bucket").applyInPandas(run, ANSWER + ", spread binary")


def unpack_with_spread(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a batch's answers, sorted, and their marks."""
    if not len(rows):
        return np.empty(0, dtype=U64), np.empty(0, dtype=bool)
    keys, spread = (np.concatenate([np.frombuffer(x, dtype=t) for x in rows[c]]) for c, t in (("keys", U64), ("spread", bool)))
    order = np.argsort(keys)
    return keys[order], spread[order]


def unpack(rows: pd.DataFrame) -> np.ndarray:
    """All keys of a batch's answers, sorted."""
    return np.sort(np.concatenate([np.frombuffer(k, dtype=U64) for k in rows["keys"]])) if len(rows) else np.empty(0, dtype=U64)
