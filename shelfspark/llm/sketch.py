"""Document fingerprints: bottom-k sketches of 5-word shingle hashes.

A sketch is the k smallest 48-bit hashes, ascending. Sketches of parts merge into that of the
whole, and estimate resemblance, containment and the number of distinct shingles; with fewer
than k shingles all three are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, map_rows, own_columns, shingles, word_hashes

K = 128
SPAN = 1 << 48


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """From sorted distinct 64-bit hashes; as many of them as it takes for k different values."""
    most = k + 8
    while True:
        out = np.unique(hashes[:most] >> U64(16))
        if len(out) >= k or most >= len(hashes):
            return out[:k]
        most *= 2


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; of two empty sets 1."""
    u = merge(a, b, k)
    if len(u) == 0:
        return 1.0
    return float(np.isin(u, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) / len(u)


def distinct(a: np.ndarray, k: int = K) -> float:
    return float(len(a)) if len(a) < k else (k - 1) * SPAN / float(a[k - 1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated part of a's shingles that b has: |A and B| = J |A or B|, over |A|."""
    n = distinct(a, k)
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / n) if n else 1.0


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, 2:] = raw
    return out.view(">u8").ravel().astype(U64)


class TextSketcher:
    def __init__(self, k: int = K, n: int = 5):
        self.k, self.n = k, n

    def __call__(self, text: str) -> np.ndarray:
        return next(self.each([text]))

    def each(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        return (sketch(shingles(h, self.n), self.k) for h in word_hashes(texts, lower=True))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles (estimated), fingerprint of every text; null and empty texts have the empty sketch."""

    def factory():
        of = TextSketcher(k)

        def run(rows):
            got = list(of.each(rows["text"]))
            return {"doc_id": rows["doc_id"], "n_shingles": [distinct(x, k) for x in got], "fingerprint": [to_text(x) for x in got]}

        return run

    d = own_columns(docs, "doc_id", "text")
    return map_rows(d.select(d.doc_id.cast("long"), "text"), factory, "doc_id long, n_shingles double, fingerprint string")


def _edited(of: TextSketcher, text: str, own: np.ndarray, after: str, its: np.ndarray) -> tuple:
    """What OUT has of a text from edited_sha256 on."""
    n = len(text) // 3
    new = text[: len(text) - n] + after[:n]
    s = own if new == text else of(new)
    return hashlib.sha256(new.encode()).hexdigest(), to_text(own), to_text(s), resemblance(own, s, of.k), resemblance(own, its, of.k), distinct(own, of.k), containment(own, s, of.k)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, kept_in_edited double"


def _ranges(ids: DataFrame, most: int) -> tuple[list[int], DataFrame]:
    """Bounds of up to ``most`` ranges of doc_id with about as many rows each, and (range, head, to) of each range that has rows: its largest doc_id, and the range that comes before it in descending order (of the first: the last)."""
    bounds = sorted({int(x) for x in ids.where("doc_id is not null").approxQuantile("doc_id", [i / most for i in range(1, most)], 1 / (4 * most))}) if most > 1 else []
    heads = _ranged(ids, bounds).groupBy("range").agg(F.max("doc_id").alias("head")).orderBy("range").collect()  # a row a range
    rows = [(r["range"], r["head"], heads[(i + 1) % len(heads)]["range"]) for i, r in enumerate(heads)]
    return bounds, ids.sparkSession.createDataFrame(rows, "range int, head long, to int")


def _ranged(d: DataFrame, bounds: list[int]) -> DataFrame:
    """d with its range: how many bounds are below doc_id, found by halving; null ids come last in descending order, so in range 0."""
    if not bounds:
        return d.withColumn("range", F.lit(0))
    held = d.sparkSession.createDataFrame([(0, bounds)], "one int, bounds array<long>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda k, step: k + F.when(F.get("bounds", k + step - 1) < F.col("doc_id"), step).otherwise(0))
    return d.withColumn("one", F.lit(0)).join(F.broadcast(held), "one").withColumn("range", found).drop("one", "bounds")


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edit: the last third replaced by the start of the next text.

    Next is by descending doc_id (null last; equal ids by a hash of the text, then equal texts
    side by side); the last is followed by the first, a single row by itself. Rows are dealt by
    ranges of doc_id, and the first row of each range also goes to the range before it, so every
    row meets its next in one task. Null texts are empty. n_shingles is the estimated number of distinct
    shingles of a text, kept_in_edited the estimated part of them that its edit has.
    """
    d = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds, heads = _ranges(d.select("doc_id"), 4 * n)
    here = F.struct(F.col("range").alias("at"), F.lit(False).alias("tail"))
    before = F.when(F.col("head").eqNullSafe(F.col("doc_id")), F.struct(F.col("to").alias("at"), F.lit(True).alias("tail")))
    dealt = _ranged(d, bounds).join(F.broadcast(heads), "range").select("doc_id", "text", F.explode(F.array_compact(F.array(here, before))).alias("x"))
    dealt = dealt.select(F.col("x.at").alias("at"), F.col("x.tail").alias("tail"), "doc_id", "text").repartition(n, "at")
    ordered = dealt.sortWithinPartitions("at", "tail", F.desc_nulls_last("doc_id"), F.xxhash64("text"))

    def factory():
        of = TextSketcher(k)
        held: list = []  # the row that waits for its next

        def run(rows):
            out: dict[str, list] = {f.split()[0]: [] for f in OUT.split(", ")}
            for tail, doc_id, text, own in zip(rows["tail"], rows["doc_id"], rows["text"], of.each(rows["text"])):
                if tail and not held:
                    continue  # more rows with the id of the first
                if held:
                    old_id, old, its = held.pop()
                    for c, v in zip(out, (old_id, len(old), *_edited(of, old, its, text, own))):
                        out[c].append(v)
                if not tail:
                    held.append((doc_id, text, own))
            return out

        return run

    return map_rows(ordered, factory, OUT)
