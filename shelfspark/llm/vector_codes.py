"""Vector code compression: Elkan's form of Lloyd's iterations on each quarter of the vectors.

Components become integers, so distances are exact integers and ties are true ties. A written table
keeps, beside each vector, its code and for each part one upper bound (distance to its own entry) and
one lower bound for each entry. When entries move, bounds shift by the way they moved; an entry whose
lower bound, or half of whose distance from the own entry, is strictly above the upper bound can be
neither nearer nor tied, and is not looked at. All others are compared by integers, least index first.

A lower bound takes one byte, rounded down, in steps of its row and part; movements are kept as sums
since the first round, so a bound is rounded once only, when its distance is measured.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.staging import own_dir
from .common import join_counted, own_columns

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Steps of a lower bound, and how many of them the largest first distance takes, so that it may grow.
STEPS, FIRST_STEPS = 255, 240


def above(x):
    """At least the true value of a rounded float result."""
    return x * (1 + 1e-9) + 1e-9


def below(x):
    return np.maximum(x * (1 - 1e-9) - 1e-9, 0)


def to_ints(values: list) -> np.ndarray:
    """floor(SCALE * x) exactly; Python's integers where int64 could not hold them."""
    x = np.asarray(values, dtype=np.float64)
    if x.size and np.abs(x).max() >= 2.0**40:
        whole = [math.floor(SCALE * v) if abs(v) < 2.0**60 else int(v) * SCALE for v in x.ravel().tolist()]
        return np.array(whole, dtype=object).reshape(x.shape)
    return np.floor(x * SCALE).astype(np.int64)


def number_type(width: int, *tables: np.ndarray):
    """The quickest type in which the squared distances of these integers are exact."""
    most = max((int(np.abs(t).max()) for t in tables if t.size), default=0)
    longest = (2 * most) ** 2 * max(width, 1)
    return np.float64 if longest < 2**53 else np.int64 if longest < 2**63 else object


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and c; x and c are of an exact type."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def roots(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


class Part:
    """One part's entries of a round: what they are, how far they are apart, and how far they have gone since the first round."""

    def __init__(self, entries: np.ndarray, gone: np.ndarray):
        self.entries, self.gone = entries, gone
        apart = below(roots(squares(*[entries.astype(number_type(entries.shape[1], entries))] * 2))) / 2
        np.fill_diagonal(apart, np.inf)
        self.half, self.safe = apart, apart.min(1, initial=np.inf)

    def first(self, x: np.ndarray):
        """x -> (code, upper, step, lower, squared distance), all distances measured."""
        kind = number_type(x.shape[1], x, self.entries)
        d2 = squares(x.astype(kind), self.entries.astype(kind))
        code = d2.argmin(1)
        least = d2[np.arange(len(x)), code]
        d = roots(d2)
        step = (d.max(1) / FIRST_STEPS).astype(np.float32)
        return code, self.upper(least, code), step, self.lower(d, np.arange(d.shape[1]), step[:, None]), least

    def upper(self, d2: np.ndarray, code: np.ndarray) -> np.ndarray:
        return np.nextafter((above(roots(d2)) - self.gone[code]).astype(np.float32), np.float32(np.inf))

    def lower(self, d: np.ndarray, entry: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Steps of what lies below distance + movement so far; step is 0 where all first distances were."""
        s = step.astype(np.float64)
        return np.minimum(np.floor(below(d + self.gone[entry]) / np.where(s > 0, s, np.inf)), STEPS).astype(np.uint8)

    def again(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, step: np.ndarray, lower: np.ndarray):
        """The same for rows with bounds, which are kept true; also how many distances were measured."""
        code, upper, lower = code.copy(), upper.copy(), lower.copy()
        kind = number_type(x.shape[1], x, self.entries)
        x, c = x.astype(kind), self.entries.astype(kind)
        own = above(upper.astype(np.float64) + self.gone[code])
        rows = np.flatnonzero(own >= self.safe[code])
        at_least = below(lower[rows] * step[rows, None].astype(np.float64)) - self.gone[None, :]
        open_ = (at_least <= own[rows, None]) & (self.half[code[rows]] <= own[rows, None])
        some = open_.any(1)
        rows, at_least, open_ = rows[some], at_least[some], open_[some]
        mine = ((x[rows] - c[code[rows]]) ** 2).sum(1)
        upper[rows] = self.upper(mine, code[rows])
        d = above(roots(mine))
        open_ &= (at_least <= d[:, None]) & (self.half[code[rows]] <= d[:, None])
        i, j = np.nonzero(open_)
        d2 = np.concatenate([((x[rows[a]] - c[b]) ** 2).sum(1) for a, b in zip(np.array_split(i, 1 + len(i) // 8192), np.array_split(j, 1 + len(j) // 8192))])
        lower[rows[i], j] = self.lower(roots(d2), j, step[rows[i]])
        lower[rows, code[rows]] = self.lower(roots(mine), code[rows], step[rows])
        # least distance, then least entry, among the own entry and those that were measured
        at, entry, dist = np.concatenate([np.arange(len(rows)), i]), np.concatenate([code[rows], j]), np.concatenate([mine, d2])
        order = np.lexsort((entry, dist, at)) if dist.dtype != object else np.array(sorted(range(len(at)), key=lambda k: (at[k], dist[k], entry[k])), dtype=np.int64)
        best = order[np.unique(at[order], return_index=True)[1]]
        code[rows] = entry[best]
        upper[rows] = self.upper(dist[best], code[rows])
        return code, upper, lower, len(rows) + len(i)


FIELDS = [T.StructField("code", T.BinaryType()), T.StructField("upper", T.BinaryType()), T.StructField("step", T.BinaryType()), T.StructField("lower", T.BinaryType())]


def _cut(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The parts of a batch's vectors, as integers."""
    x = to_ints(batch.column("embedding").to_pylist()).reshape(batch.num_rows, -1)
    return np.split(x, PARTS, axis=1)


def _rows(*columns: np.ndarray) -> list[bytes]:
    """One value a row: the row's bytes in each column, one after the other."""
    whole = np.concatenate([np.ascontiguousarray(c).reshape(len(c), -1).view(np.uint8).reshape(len(c), -1) for c in columns], axis=1)
    return [r.tobytes() for r in whole]


def _assigned(df: DataFrame, parts: list[Part]) -> DataFrame:
    """vec_id, label, embedding and the bounds of a round; the first round is that of rows without bounds."""
    schema = T.StructType([df.schema[n] for n in ("vec_id", "label", "embedding")] + FIELDS)
    arrow = to_arrow_schema(schema)
    sizes = [len(p.entries) for p in parts]
    ends = np.cumsum(sizes)[:-1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _cut(batch)
            if "code" in batch.schema.names:
                kinds = (("code", np.uint8), ("upper", np.float32), ("step", np.float32), ("lower", np.uint8))
                code, upper, step, lower = [np.frombuffer(b"".join(batch.column(n).to_pylist()), dtype=k).reshape(batch.num_rows, -1) for n, k in kinds]
                low = np.split(lower, ends, axis=1)
                out = [(*p.again(x[k], code[:, k].astype(np.int64), upper[:, k], step[:, k], low[k])[:3],) for k, p in enumerate(parts)]
                out = [(a, u, step[:, k], w) for k, (a, u, w) in enumerate(out)]
            else:
                out = [p.first(x[k])[:4] for k, p in enumerate(parts)]
            more = [_rows(*[o[k].astype(t) for o in out]) for k, t in enumerate((np.uint8, np.float32, np.float32, np.uint8))]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("vec_id", "label", "embedding")], *[pa.array(m, type=pa.binary()) for m in more]], schema=arrow)

    return df.mapInArrow(run, schema)


def _moved(df: DataFrame, parts: list[np.ndarray]) -> list[np.ndarray]:
    """The entries of the next round: floors of the means of what each was given; an entry that was given nothing stays."""
    arrow = to_arrow_schema(T._parse_datatype_string("part int, entry int, n long, sums array<decimal(38,0)>"))
    shapes = [p.shape for p in parts]

    def run(batches):
        n, sums = [np.zeros(s[0], dtype=np.int64) for s in shapes], [np.zeros(s, dtype=object) for s in shapes]
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            for k, x in enumerate(_cut(batch)):
                one = np.zeros(shapes[k], dtype=x.dtype)
                np.add.at(one, code[:, k], x)
                sums[k] += one
                n[k] += np.bincount(code[:, k], minlength=shapes[k][0])
        out = [(k, j, int(n[k][j]), [int(v) for v in sums[k][j]]) for k in range(len(shapes)) for j in np.flatnonzero(n[k]).tolist()]
        yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, map(list, zip(*out)) if out else ([],) * 4)), schema=arrow)

    tasks = df.select("embedding", "code").mapInArrow(run, "part int, entry int, n long, sums array<decimal(38,0)>")
    counts = tasks.groupBy("part", "entry").agg(F.sum("n").alias("n"))
    sums = tasks.select("part", "entry", F.posexplode("sums").alias("at", "v")).groupBy("part", "entry", "at").agg(F.sum("v").alias("v"))
    out = [p.astype(object) for p in parts]
    # PARTS * ENTRIES rows at most, one number for each component
    n = {(r.part, r.entry): r.n for r in counts.collect()}
    for r in sums.collect():
        out[r.part][r.entry, r["at"]] = int(r.v) // n[r.part, r.entry]
    return [o.astype(np.int64) if number_type(1, o) is not object else o for o in out]


class _Generations:
    """The table of the last round; the one before it goes as soon as a newer one is whole."""

    def __init__(self, spark):
        self.spark, self.at = spark, None

    def put(self, df: DataFrame) -> DataFrame:
        at, before = f"{own_dir(self.spark)}/codes-{uuid.uuid4().hex}", self.at
        df.write.parquet(at)
        self.at = at
        self._drop(before)
        return self.spark.read.schema(df.schema).parquet(at)

    def _drop(self, at: str | None) -> None:
        if at:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def usable(vectors: DataFrame) -> DataFrame:
    infinite = F.lit(math.inf)
    return vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinite)))


def digest(parts: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for p in parts for v in p.ravel()).encode()).hexdigest()


def train(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame | None, list[Part], list[np.ndarray]]:
    """(the table of the last round with its bounds, the parts after the last move, their entries); (None, [], []) without usable vectors.

    The codebooks begin with the parts of the ``entries`` (256 at most) least vec_ids, equal ones by
    their components and null last, so fewer rows make fewer entries.
    """
    kept = usable(vectors)
    lengths = kept.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if lengths[0] is None:
        return None, [], []
    if lengths[0] != lengths[1] or lengths[0] % PARTS:
        raise ValueError(f"vectors of {lengths[0]} to {lengths[1]} components: all need the same number, a multiple of {PARTS}")
    heads = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    now = np.split(to_ints([r.embedding for r in heads]).reshape(len(heads), -1), PARTS, axis=1)
    gone = [np.zeros(len(heads)) for _ in now]
    generations, table = _Generations(vectors.sparkSession), kept
    for _ in range(rounds):
        table = generations.put(_assigned(table, [Part(e, g) for e, g in zip(now, gone)]))
        then, now = now, _moved(table, now)
        gone = [above(g + above(roots(((a - b).astype(object) ** 2).sum(1)))) for g, a, b in zip(gone, then, now)]
    return table, [Part(e, g) for e, g in zip(now, gone)], now


def encode(table: DataFrame, parts: list[Part]) -> DataFrame:
    """vec_id, label, code (bytes, one a part) and error (squared distances, summed over the parts) of each vector."""
    schema = T.StructType([table.schema["vec_id"], table.schema["label"], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            error = 0
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            for k, x in enumerate(_cut(batch)):
                kind = number_type(x.shape[1], x, parts[k].entries)
                error = error + ((x.astype(kind) - parts[k].entries.astype(kind)[code[:, k]]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("code"), pa.array([int(e) for e in error], type=pa.int64())], schema=arrow)

    return _assigned(table, parts).mapInArrow(run, schema)


def compress_vectors(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, list[np.ndarray]]:
    """(one row per usable row of vectors: vec_id, label, code, error, label_error; the codebooks of the four parts).

    Rows whose embedding is null or holds null or non-finite components are left out; a vector without
    components is kept, if all are such. label_error is the error summed over equal labels, null being
    one. Rows of one vec_id, and equal rows, have codes of their own and count each. An empty table
    gives an empty table and no codebooks; further columns are ignored. Vectors of different lengths,
    or of one that is no multiple of 4, are an error; so are squared distances beyond a long and sums beyond 38 digits.
    """
    own = own_columns(vectors, "vec_id", "embedding", "label")
    table, parts, books = train(own, rounds, entries)
    if table is None:
        none = own.where("false").select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none, []
    rows = _Generations(own.sparkSession).put(encode(table, parts))
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return join_counted(rows, sums, ["label"], rows.count()).drop("n"), books
