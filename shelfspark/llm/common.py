"""What the operators share: staged tables, words, hashes, and row mapping through Arrow.

A word is a run of bytes outside ``\\x20\\x09-\\x0D``. ``bytes.split()`` cuts at exactly
those six bytes and ``bytes.lower()`` changes exactly A-Z, so both work on UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.staging import shared_dir, stage  # noqa: F401
from ..shipping import ship

U64 = np.uint64
SLICE = 256
#: Rows of an Arrow batch.
ROWS = 1000


class Remembered(dict):
    """Results of a function of words, ``most`` at most. When half of them are new since the last time, the older half goes
    but for what is asked for again, so frequent words stay."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.half, self.old = make, max(1, most // 2), {}

    def __missing__(self, word):
        out = self.old.get(word)
        if out is None:
            out = self.make(word)
        if len(word) <= 64:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


_KEPT: dict = {}
_USED: set = set()


def kept(make, spec: str):
    """``make(spec)``, kept by the Python worker for its next tasks, until a task comes that does not ask for it."""
    key = make, hash(spec), len(spec)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make(spec)
    _USED.add(key)
    return _KEPT[key]


def _begun(factory):
    """``factory()`` at the start of a task; what was kept for other operators goes, so that a worker holds one operator's tables at most."""
    _USED.clear()
    f = factory()
    for k in [k for k in _KEPT if k not in _USED]:
        del _KEPT[k]
    return f


def map_rows(df: DataFrame, factory, schema: str | T.StructType) -> DataFrame:
    """mapInArrow in slices of at most SLICE rows, so that memory follows the slice, not the task.

    ``factory()`` runs once a task and returns a function from a dict of column lists to a
    dict of output column lists (any number of rows). A function with an attribute
    ``finish`` is asked for last rows when its task's input ends.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(schema)

    def run(batches):
        f = _begun(factory)
        for batch in batches:
            for s in range(0, batch.num_rows, SLICE):
                out = f(batch.slice(s, SLICE).to_pydict())
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)
        if hasattr(f, "finish"):
            out = f.finish()
            if out is not None:
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


MULT = 0x9E3779B97F4A7C15


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (order matters)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=U64)
    out = h[:m].copy()
    for j in range(1, n):
        out *= U64(MULT)
        out ^= out >> U64(29)
        out += h[j : j + m]
    return mix64(out)


SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Longer words are hashed one by one.
LONG = 64
#: Bytes of text that are looked at together; a word or a longer text is never cut.
TOGETHER = 1 << 20


def _hash_words(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, start) of each word; eight bytes of all words at a time."""
    raw = np.frombuffer(buffer + bytes(8), dtype=np.uint8)
    word = ~SPACES[raw[: len(buffer)]]
    turn = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    start, size = turn[::2], turn[1::2] - turn[::2]
    eight = np.lib.stride_tricks.as_strided(raw[:8].view(U64), (len(raw) - 7,), (1,))
    h = size.astype(U64) * U64(MULT)
    own = np.flatnonzero(size <= LONG)
    at = 0
    while len(own):
        left = np.minimum(size[own] - at, 8).astype(U64)
        x = eight[start[own] + at] & (~U64(0) >> (U64(64) - left * U64(8)))
        x = (h[own] ^ x) * U64(0xFF51AFD7ED558CCD)
        h[own] = x ^ x >> U64(32)
        at += 8
        own = own[size[own] > at]
    h = mix64(h)
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(buffer[start[i] : start[i] + size[i]])
    return h, start


def word_hashes(texts: Sequence[str | None], lower: bool = False) -> Iterator[np.ndarray]:
    """The hashes of each text's words, A-Z in lower case if asked; none for null."""
    held: list[bytes] = []

    def flush():
        buffer = b" ".join(held)
        h, start = _hash_words(buffer.lower() if lower else buffer)
        ends = np.cumsum([len(x) + 1 for x in held])
        yield from np.split(h, np.searchsorted(start, ends[:-1]))
        held.clear()

    size = 0
    for t in texts:
        raw = (t or "").encode()
        if held and size + len(raw) > TOGETHER:
            yield from flush()
            size = 0
        held.append(raw)
        size += len(raw)
    if held:
        yield from flush()


def shingles(h: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, no words are none."""
    if len(h) == 0:
        return np.empty(0, dtype=U64)
    g = np.sort(grams(h, min(n, len(h))))
    return g[np.concatenate(([True], g[1:] != g[:-1]))]


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ROWS at most, for texts can be long: a batch is held by the executor and by its Python worker, as Arrow data and as objects."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, ROWS)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, by exact name; any others (clashing or not) stay outside the operator. Every operator starts here, so executors get the package here."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    return df.select(*[df[f"`{n}`"].alias(n) for n in names])


def total_bytes(df: DataFrame, col: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(col).cast("long"))).first()[0] or 0


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """``row``, a struct of all columns of df whatever their names, and further columns beside it; ``select("row.*")`` undoes it."""
    return df.select(F.struct(*[df[f"`{c}`"].alias(c) for c in df.columns]).alias("row"), *[v.alias(k) for k, v in more.items()])


def first_by_hash(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """The first ``most`` rows by a hash of the keys, then by the keys. Of many rows, those with high hashes are left out
    before the sort, so that about ``most`` rows meet in one task, not so many from each."""
    h, n = F.xxhash64(*keys), df.count()
    if n > 2 * most:
        low = df.where(h < F.lit(int((1.5 * most / n - 0.5) * 2**64)))
        if low.count() >= most:
            df = low
    return df.orderBy(h, *keys).limit(most)


def text_udf(factory, schema: str):
    """A vectorized column function of one text column, for stages that keep all other columns in the JVM.

    ``factory()`` runs once a task and returns a function from a list of texts to a dict of
    columns, one value a text.
    """
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = _begun(factory)
        for s in batches:
            parts = [pd.DataFrame(f(s.iloc[i : i + SLICE].tolist()), columns=names) for i in range(0, len(s), SLICE)]
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({n: [] for n in names})

    return run


def broadcast_if(df: DataFrame, most: int) -> DataFrame:
    """df, marked for broadcast if it has ``most`` rows at most; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: A key is hot if it holds more than 1 / HOT of all rows, so there are fewer than HOT of them.
HOT = 1000


def join_counted(rows: DataFrame, keyed: DataFrame, on: Sequence[str], total: int) -> DataFrame:
    """rows with the columns of keyed, which has one row a key and the number n of the ``total`` rows that hold it.

    Hot keys are broadcast and their rows stay where they are; all others meet in a shuffle join, in
    which no key has more than 1 / HOT of the rows. Null keys meet null keys; rows of other keys go.
    """
    is_hot = F.col("n") * HOT > total
    hot, cold = F.broadcast(keyed.where(is_hot)), keyed.where(~is_hot)
    more = [c for c in keyed.columns if c not in on]

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        same = [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in on]
        return a.join(b, same).select("a.*", *[F.col(f"b.`{c}`") for c in more])

    a, b = rows.alias("a"), hot.alias("b")
    rest = a.join(b, [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in on], "left_anti")
    return met(rows, hot).unionByName(met(rest, cold))
