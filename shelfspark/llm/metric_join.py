"""Embedding near-dedup: an exact metric range join on cosine.

On unit vectors, cosine >= c is distance <= r = sqrt(2 - 2c). Pivots cut a label's vectors into
cells, each vector at home in the cell of its nearest pivot. By the triangle inequality a vector can
be within r of another that is at home in cell i only if it lies within r of the plane between
pivot i and its own; it is copied into those cells. A cell that is still large is cut again by pivots
of its own, as long as that copies few vectors. A cell then counts, for each vector at home
in it, all links, apart from all other cells; what is large and can't be cut is dealt out in blocks.
Equal vectors are joined once, with their number.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, own_columns, stage
from .components import components

COSINE = 0.93
#: A cell with more vectors at home is cut, by about one pivot for each CELL of them, at most PIVOTS.
CELL, PIVOTS = 4096, 64
#: A cut pays if the comparisons left, as a part of those before, times the copies of each vector are at most this.
PAYS = 0.5
#: Rows of a block on either side.
BLOCK = 4096


def _vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label, dim, key, unit: key and unit are null for vectors that link with nothing."""

    def factory():
        def run(rows):
            out = {"vec_id": rows["vec_id"], "label": rows["label"], "dim": [], "key": [], "unit": []}
            for label, e in zip(rows["label"], rows["embedding"]):
                v = None
                if label is not None and e and not any(x is None for x in e):
                    v = np.array(e, dtype=np.float64)
                    scale = np.abs(v).max()
                    v = v / scale if 0 < scale < math.inf else None  # also false for NaN
                if v is None:
                    out["dim"].append(None), out["key"].append(None), out["unit"].append(None)
                else:
                    v = v / math.sqrt(float(v @ v)) + 0.0
                    out["dim"].append(len(v)), out["key"].append(xxhash.xxh3_128_digest(v.tobytes())), out["unit"].append(v.tobytes())
            return out

        return run

    return map_rows(rows, factory, "vec_id long, label string, dim int, key binary, unit binary")


CELLS = "label string, dim int, cell string, home boolean, vec_id long, w long, unit binary"


def _split(r: float):
    """Vectors of a part of a cell, and the cell's pivots -> one row for a vector's own new cell and one for each it is copied to."""

    def run(rows: pd.DataFrame, its: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[c.split()[0] for c in CELLS.split(", ")])
        p = np.frombuffer(b"".join(its.sort_values("vec_id")["unit"]), dtype=np.float64).reshape(len(its), -1)
        v = np.frombuffer(b"".join(rows["unit"]), dtype=np.float64).reshape(len(rows), -1)
        d2 = 2 - 2 * (v @ p.T)
        own = d2.argmin(1)
        apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
        near = d2 - d2[np.arange(len(v)), own][:, None] <= 2 * apart[own] * r + 1e-9
        i, j = np.nonzero(near)
        out = rows.iloc[i].drop(columns="part").reset_index(drop=True)
        return out.assign(cell=out["cell"] + "." + pd.Series(j).astype(str), home=out["home"] & (j == own[i]))

    return run


def _cells(reps: DataFrame, r: float, cell: int) -> DataFrame:
    """label, dim, cell, home, vec_id, w, unit of all cells, cut as often as it helps. A row a cell and its pivots are tables; none meets on the driver."""
    key = ["label", "dim", "cell"]
    open_, done = stage(reps.select("label", "dim", F.lit("").alias("cell"), F.lit(True).alias("home"), "vec_id", "w", "unit"), "metric-cells"), None
    while True:
        size = stage(open_.groupBy(*key).agg(F.count_if("home").alias("homes"), F.count("*").alias("all")), "metric-sizes")
        large = size.where(F.col("homes") > cell)
        # by a hash that differs from level to level, so that each cell has pivots of its own
        lot = F.pmod(F.xxhash64(F.lit("pivot"), "cell", "vec_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        wanted = F.least(F.col("homes") / F.lit(cell) + 1, F.lit(PIVOTS))
        pivots = open_.where("home").join(large, key).where(lot < wanted / F.col("homes")).select(*key, "vec_id", "unit")
        pivots = stage(pivots, "metric-pivots")
        cut = stage(pivots.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n").between(2, 4 * PIVOTS)), "metric-cut")
        if cut.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        parts = F.greatest(F.lit(1), F.ceil(F.col("all") / BLOCK)).cast("int")
        rows = open_.join(size.join(cut.select(*key), key).select(*key, parts.alias("parts")), key)
        rows = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
        its = pivots.join(size.join(cut.select(*key), key).select(*key, parts.alias("parts")), key)
        its = its.select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "unit")
        new = stage(rows.groupBy(*key, "part").cogroup(its.groupBy(*key, "part")).applyInPandas(_split(r), CELLS), "metric-cells")
        came = new.groupBy(*key).agg(F.count_if("home").cast("double").alias("h"), F.count("*").cast("double").alias("n"))
        came = came.groupBy("label", "dim", F.regexp_replace("cell", r"\.[0-9]+$", "").alias("cell")).agg(F.sum("n").alias("n"), F.sum(F.col("h") * F.col("n")).alias("work"))
        pays = F.col("work") / (F.col("homes") * F.col("all")) * F.col("n") / F.col("all") <= PAYS
        good = stage(came.join(size, key).where(pays).select(*key), "metric-good")
        # what was not cut, or to no use, is done; cells of a cut that helped go on
        rest = open_.join(good, key, "left_anti")
        done = rest if done is None else done.unionByName(rest)
        parent = F.regexp_replace("n.cell", r"\.[0-9]+$", "")
        g = good.alias("g")
        open_ = new.alias("n").join(g, (F.col("n.label") == F.col("g.label")) & (F.col("n.dim") == F.col("g.dim")) & (parent == F.col("g.cell")), "left_semi")
        if good.isEmpty():
            return done
        open_ = stage(open_, "metric-cells")


def _block(cosine: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Links of a block: a count for each vector on its left, and for both sides an edge to the least vector that the block connects them with."""
        x, y = rows[rows["left"]], rows[~rows["left"]]
        if not len(x) or not len(y):
            return pd.DataFrame({"vec_id": x["vec_id"], "n": np.zeros(len(x), dtype=np.int64), "least": x["vec_id"]})
        a, b = (np.frombuffer(b"".join(s["unit"]), dtype=np.float64).reshape(len(s), -1) for s in (x, y))
        linked = np.concatenate([a[i : i + 512] @ b.T >= cosine for i in range(0, len(a), 512)])
        n = np.concatenate([linked[i : i + 512] @ y["w"].to_numpy(np.int64) for i in range(0, len(a), 512)])
        ids, at = np.unique(np.concatenate([x["vec_id"].to_numpy(), y["vec_id"].to_numpy()]), return_inverse=True)
        ix, iy = at[: len(x)], at[len(x) :]
        px, py = np.nonzero(linked.any(1))[0], np.nonzero(linked.any(0))[0]
        least, part = np.arange(len(ids)), linked[np.ix_(px, py)]
        while True:  # as often as the longest chain inside the block
            old = least.copy()
            for i in range(0, len(px), 256):
                np.minimum.at(least, ix[px[i : i + 256]], np.where(part[i : i + 256], least[iy[py]], len(ids)).min(1))
            for i in range(0, len(py), 256):
                np.minimum.at(least, iy[py[i : i + 256]], np.where(part[:, i : i + 256].T, least[ix[px]], len(ids)).min(1))
            least = least[least]
            if (old == least).all():
                break
        return pd.concat([pd.DataFrame({"vec_id": x["vec_id"].to_numpy(), "n": n, "least": ids[least[ix]]}), pd.DataFrame({"vec_id": y["vec_id"].to_numpy(), "n": np.zeros(len(y), dtype=np.int64), "least": ids[least[iy]]})])

    return run


def link_vectors(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Links hold between rows with one non-null label, one dimension and cosine >= ``cosine``.
    Vectors that are null, empty, zero or hold null or non-finite components have none. Equal rows
    count each. Rows that share a vec_id are vectors of their own: each has its own links. A null
    vec_id links with nothing. Labels are compared as text.
    """
    d = own_columns(vectors, "vec_id", "label", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = stage(_vectors(d), "metric-rows")
    used = rows.where("key is not null and vec_id is not null")
    # a distinct vector is a node; its number holds as the table is written
    once = used.groupBy("label", "dim", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"))
    once = stage(once.withColumn("node", F.monotonically_increasing_id()), "metric-once")
    reps = used.alias("u").join(once.alias("o"), F.expr("u.label = o.label and u.dim = o.dim and u.key = o.key and u.vec_id = o.rep"))
    reps = stage(reps.select("u.label", "u.dim", F.col("o.node").alias("vec_id"), "o.w", "u.unit").dropDuplicates(["vec_id"]), "metric-reps")
    r = math.sqrt(2 - 2 * cosine)
    cells = _cells(reps, r, cell)
    count = cells.groupBy("label", "dim", "cell").agg(F.ceil(F.sum(F.col("home").cast("long")) / block).cast("int").alias("nx"), F.ceil(F.count("*") / block).cast("int").alias("ny"))
    cells = cells.join(count.where("nx > 0"), ["label", "dim", "cell"])
    lot = F.xxhash64("vec_id")
    left = cells.where("home").withColumn("i", F.pmod(lot, F.col("nx")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("left", F.lit(True))
    right = cells.withColumn("j", F.pmod(lot, F.col("ny")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).withColumn("left", F.lit(False))
    blocks = left.unionByName(right).select("label", "dim", "cell", "i", "j", "left", "vec_id", "w", "unit")
    links = stage(blocks.groupBy("label", "dim", "cell", "i", "j").applyInPandas(_block(cosine), "vec_id long, n long, least long"), "metric-links")
    n = links.groupBy("vec_id").agg(F.sum("n").alias("n"))
    comps = components(links.where("vec_id <> least").select(F.col("vec_id").alias("a"), F.col("least").alias("b")).distinct())
    nodes = once.join(n, F.col("node") == F.col("vec_id")).join(comps.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    nodes = stage(nodes.select("label", "dim", "key", "rep", (F.col("n") - 1).alias("n"), F.coalesce("component", "node").alias("top")), "metric-nodes")
    least = stage(nodes.groupBy("top").agg(F.min("rep").alias("c")), "metric-components")
    of_rep = nodes.join(least, "top").select("label", "dim", "key", "n", "c")
    out = rows.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.col("key"))).join(of_rep, ["label", "dim", "key"], "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
