"""N-gram Jaccard join by grouped prefixes, and the groups of near-duplicates it makes.

Two sets with Jaccard similarity of t or more share an element among the first
n - ceil(t n) + 1 of each, in any one order of all elements.

1. The order puts common shingles last: by the level of a counting sketch of fixed size over all
   documents, then by hash.
2. Equal sets become one; sets with equal prefixes and size become one group. Only a group's head
   goes on. Prefix elements that no other head has are set aside (``repeats``).
3. Each head is held against centres of its elements: per element the head with most shared elements,
   and one by hash. The best of a head's centres is verified first, which joins nearly all of a group
   of copies, so that no step lists all pairs within it.
4. The rest, exactly. Elements that the same heads share become one key; under each key the heads
   that are not in its main component by then are held against classes of its heads, alike in size and
   number of shared elements, and meet the heads of those classes only in which one may have enough
   overlap with them. Pairs are expanded to members in different components and verified.

Whatever names a pair, bit masks are compared before sets are sent: first of the heads' shared prefix
elements, then of the members' whole sets. A bit that one mask alone has is an element that is not
common, so masks bound the overlap from above and no link is lost.

Pairs that could only join what is joined already are left out; no link between components is.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce
from operator import add, and_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, map_rows, own_columns, packed, shingles, stage, word_hashes
from .components import components
from .repeats import SENT, SENT_COLUMNS, among, answers_with_busy, batch_of, batches, buckets, distinct_of_documents, send, unpack_with_spread

SIMILARITY = 75  # percent
COUNTERS_LOG2, BLOCKS = 24, 16
#: The counts of tasks are added up in so many parts a block first.
PARTS = 8
#: Words of the bit mask of a head's shared elements.
MASKS = 8
MASK = [f"m{i}" for i in range(MASKS)]
#: Bits an element of the masks of whole sets, at least; a mask has a power of two of words.
BITS = 4
#: What names a class of heads under a key.
CLASS = ["top", "next", "size_class", "pop_class"]
#: Heads of one class: their sizes differ by less than this factor, their numbers of shared elements by less than the other.
SIZES_APART, POPS_APART = 1.03, 1.25
#: Ids that are broadcast to fetch texts, 8 bytes each; more are joined by shuffle.
MOST_BROADCAST = 1_000_000


def shingle_levels(docs: DataFrame, n: int = 5) -> np.ndarray:
    """A level from 0 to 15 for each of 2^24 classes of shingles: by how many doublings the class's count over all
    documents passes the mean. The sketch has a fixed size: 16 MB a task (a task counts up to 255 a class), less as it is
    shuffled, and 16 MB on the driver."""
    size = 1 << COUNTERS_LOG2
    block = size // BLOCKS
    schema = "block int, part int, width int, counts binary"

    def factory():
        counts = np.zeros(size, dtype=np.uint8)

        def run(rows):
            for h in word_hashes(rows["text"], lower=True):
                at = (shingles(h, n) >> U64(64 - COUNTERS_LOG2)).astype(np.int64)
                counts[at] += counts[at] < 255

        def finish():
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            return {"block": list(range(BLOCKS)), "part": [part % PARTS] * BLOCKS, "width": [1] * BLOCKS, "counts": [zlib.compress(x.tobytes(), 1) for x in np.split(counts, BLOCKS)]}

        run.finish = finish
        return run

    def total_of(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(block, dtype=np.int64)
        for width, x in zip(rows["width"], rows["counts"]):
            total += np.frombuffer(zlib.decompress(x), dtype=np.uint8 if width == 1 else np.int64)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "part": [0], "width": [8], "counts": [zlib.compress(total.tobytes(), 1)], "total": [int(total.sum())]})

    out = schema + ", total long"
    sums = map_rows(own_columns(docs, "text"), factory, schema).groupBy("block", "part").applyInPandas(total_of, out)
    sums = stage(sums.groupBy("block").applyInPandas(total_of, out), "shingle-counts")
    mean = max(1.0, (sums.agg(F.sum("total")).first()[0] or 0) / size)

    def level(batches):
        for rows in batches:
            counts = [np.frombuffer(zlib.decompress(x), dtype=np.int64) for x in rows["counts"]]
            yield pd.DataFrame({"block": rows["block"], "levels": [np.clip(np.log2(np.maximum(x / mean, 1)), 0, 15).astype(np.uint8).tobytes() for x in counts]})

    levels = np.zeros(size, dtype=np.uint8)
    for r in sums.mapInPandas(level, "block int, levels binary").collect():
        levels[r.block * block : (r.block + 1) * block] = np.frombuffer(r.levels, dtype=np.uint8)
    return levels


def prefix_length(n: int) -> int:
    return n - -(-SIMILARITY * n // 100) + 1


def _needed(a: Column, b: Column) -> Column:
    """Least overlap of two sets of these sizes."""
    return F.ceil(F.lit(SIMILARITY) * (a + b) / F.lit(100.0 + SIMILARITY))


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * SIMILARITY


def _prefixes(docs: DataFrame, levels: np.ndarray, n: int) -> DataFrame:
    """doc_id, n, set_key, prefix_key, prefix of every row."""

    def factory():
        def run(rows):
            out = {"doc_id": rows["doc_id"], "n": [], "set_key": [], "prefix_key": [], "prefix": []}
            for h in (shingles(x, n) for x in word_hashes(rows["text"], lower=True)):
                key = np.sort(levels[(h >> U64(64 - COUNTERS_LOG2)).astype(np.int64)].astype(U64) << U64(60) | h >> U64(4))
                p = key[: prefix_length(len(h))] if len(h) else key
                out["n"].append(len(h))
                out["set_key"].append(xxhash.xxh3_128_digest(h.tobytes()))
                out["prefix_key"].append(xxhash.xxh3_128_digest(p.tobytes()))
                out["prefix"].append(p.tobytes())
            return out

        return run

    return map_rows(docs, factory, "doc_id long, n long, set_key binary, prefix_key binary, prefix binary")


def _shared(rows: DataFrame, heads: DataFrame, spark) -> DataFrame:
    """gid, n, pop, twos, more, and masks with a bit for each of both: the prefix elements of each head that just one other head has, and
    those that others have too, pop of them together; heads with none are left out.

    heads: (gid, prefix_key) of the rows that count."""
    # prefixes are a quarter of the sets, 8 bytes an element
    m, into = batches(spark, 2 * (rows.agg(F.sum("n")).first()[0] or 0)), buckets(spark)
    by = rows.select("doc_id", "n", "prefix_key", "prefix", batch_of(m, "doc_id").alias("batch")).groupBy("batch")
    heads = heads.select(batch_of(m, "gid").alias("batch"), "gid", "prefix_key")

    def turned(x: bytes) -> np.ndarray:
        # keys are nearly uniform in their low bits only: deal them by a turn
        k = np.frombuffer(x, dtype=U64)
        return np.sort((k << U64(4)) | (k >> U64(60)))

    def first(rows: pd.DataFrame, its: pd.DataFrame) -> pd.DataFrame:
        own = _of_heads(rows, its)
        if not own:
            return pd.DataFrame(columns=SENT_COLUMNS)
        keys, many = distinct_of_documents([turned(x) for _, _, x in own])
        return send(int(rows["batch"].iloc[0]), keys, many, into)

    def second(rows: pd.DataFrame, its: pd.DataFrame) -> pd.DataFrame:
        (again, busy), out = unpack_with_spread(its[its["keys"].notna()]), []
        for gid, n, x in _of_heads(rows, its[its["keys"].isna()]):
            k = turned(x)
            k = k[among(k, again)]
            if len(k):
                bit = np.unique(k & U64(64 * MASKS - 1))
                mask = np.zeros(MASKS, dtype=U64)
                np.bitwise_or.at(mask, (bit >> U64(6)).astype(np.int64), U64(1) << (bit & U64(63)))
                more = busy[np.searchsorted(again, k)]
                out.append((gid, n, len(k), k[~more].view(np.int64).tolist(), k[more].view(np.int64).tolist(), *mask.view(np.int64).tolist()))
        return pd.DataFrame(out, columns=["gid", "n", "pop", "twos", "more", *MASK])

    found = answers_with_busy(by.cogroup(heads.groupBy("batch")).applyInPandas(first, SENT))
    sent = found.unionByName(heads, allowMissingColumns=True)
    return by.cogroup(sent.groupBy("batch")).applyInPandas(second, "gid long, n long, pop long, twos array<long>, more array<long>, " + ", ".join(f"{m} long" for m in MASK))


def _of_heads(rows: pd.DataFrame, heads: pd.DataFrame) -> list[tuple[int, int, bytes]]:
    """(gid, n, prefix) of the rows that are heads, once each."""
    left = {(int(g), bytes(k)) for g, k in zip(heads["gid"], heads["prefix_key"])}
    out = []
    for i, n, k, x in zip(rows["doc_id"], rows["n"], rows["prefix_key"], rows["prefix"]):
        if (i, k) in left:
            left.remove((i, k))
            out.append((int(i), int(n), x))
    return out


def set_mask(s: np.ndarray) -> np.ndarray:
    """A bit for each element, in words; a mask of half the length is the two halves of it as one."""
    words = 1 << max(0, (BITS * len(s) - 1).bit_length() - 6)
    bit = np.unique(s & U64(64 * words - 1))
    mask = np.zeros(words, dtype=U64)
    np.bitwise_or.at(mask, (bit >> U64(6)).astype(np.int64), U64(1) << (bit & U64(63)))
    return mask


def _sets(docs: DataFrame, ids: DataFrame, n: int, masks: bool = False) -> DataFrame:
    """(doc_id, is_a, is_b, n, s: shingles, or a mask of them) of these documents, from their whole texts."""
    some = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids

    def factory():
        def run(rows):
            sets = [shingles(h, n) for h in word_hashes(rows["text"], lower=True)]
            s = [(set_mask(x) if masks else x).view(np.int64).tolist() for x in sets]
            return {c: rows[c] for c in ("doc_id", "is_a", "is_b")} | {"n": [len(x) for x in sets], "s": s}

        return run

    return map_rows(docs.join(some, "doc_id"), factory, "doc_id long, is_a boolean, is_b boolean, n long, s array<long>")


def _with_sets(docs: DataFrame, pairs: DataFrame, n: int, masks: bool = False) -> DataFrame:
    """pairs (a, b) with na, sa, nb, sb. pairs must be a written table. (No distinct here: it
    would bind the join's rows to their key, so that a centre with very many pairs could not be split.)"""
    side = lambda x: pairs.select(F.col(x).alias("doc_id"), F.lit(x == "a").alias("is_a"), F.lit(x == "b").alias("is_b"))
    ids = stage(side("a").union(side("b")).groupBy("doc_id").agg(F.max("is_a").alias("is_a"), F.max("is_b").alias("is_b")), "pair-ids")
    sets = stage(_sets(docs, ids, n, masks), "pair-masks" if masks else "pair-sets")
    of = lambda x: sets.where(f"is_{x}").select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}"))
    return pairs.join(of("b"), "b").join(of("a"), "a")


def _alone(p: Column, q: Column) -> Column:
    """How many bits of mask p are not in q; the longer one is folded to the other's length."""

    def folded(m: Column, other: Column) -> Column:
        half = (F.size(m) / 2).cast("int")
        return F.when(F.size(m) > F.size(other), F.zip_with(F.slice(m, F.lit(1), half), F.slice(m, half + 1, half), lambda x, y: x.bitwiseOR(y))).otherwise(m)

    bits = F.zip_with(folded(p, q), folded(q, p), lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    return F.aggregate(bits, F.lit(0), add)


def _similar(overlap: Column) -> Column:
    return overlap * 100 >= (F.col("na") + F.col("nb") - overlap) * SIMILARITY


def _verify(docs: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """Those pairs (a, b) of document ids whose sets are similar enough; pairs must be a written table. Sets are sent for
    the pairs only whose masks, a sixteenth of their size or an eighth, leave enough overlap possible."""
    most = F.least(F.col("na") - _alone(F.col("sa"), F.col("sb")), F.col("nb") - _alone(F.col("sb"), F.col("sa")))
    may = _with_sets(docs, pairs, n, masks=True).where(_sizes_fit(F.col("na"), F.col("nb"))).where(_similar(most)).select("a", "b")
    both = _with_sets(docs, stage(may, "possible-pairs"), n)
    return stage(both.where(_similar(F.size(F.array_intersect("sa", "sb")))).select("a", "b"), "links")


def _can_reach(common: Column, na: Column, nb: Column) -> Column:
    beyond = F.ceil(F.greatest(na, nb) * F.lit(SIMILARITY / 100.0)) - 1  # what lies beyond the longer prefix's set
    return common + beyond >= _needed(na, nb)


def near_duplicates(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Shingles are runs of n words after lower-casing A-Z; fewer words are one shingle. Null and
    empty texts have none and link with nothing. Rows with one doc_id are one document in
    components; a null doc_id links with nothing and has a null component_id.
    """
    spark = docs.sparkSession
    d = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stage(_prefixes(d, shingle_levels(d, n), n), "jaccard-rows")
    used = rows.where("n > 0 and doc_id is not null")
    # equal sets: one document each; equal prefixes and size: one group each
    sets = stage(used.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("prefix_key").alias("prefix_key")), "jaccard-sets")
    groups = sets.groupBy("n", "prefix_key").agg(F.min("rep").alias("gid"))
    members = stage(sets.join(groups, ["n", "prefix_key"]).select("gid", "rep", "prefix_key"), "jaccard-members")
    shared = stage(_shared(used, members.where("gid = rep").select("gid", "prefix_key"), spark), "jaccard-shared")
    candidates, keys = _candidates(shared)
    candidates = stage(_possible(candidates, shared), "jaccard-possible")

    inside = members.where("gid <> rep").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
    best = candidates.groupBy("b").agg(F.max(F.struct("common", "a")).alias("x")).select("x.a", "b")
    tried = stage(best.unionByName(inside), "jaccard-pairs")
    links = _verify(d, tried, n)
    found = components(links)
    rest = stage(_rest(candidates, keys, members, shared, found, tried), "jaccard-rest")
    edges = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_verify(d, rest, n))
    # rows that share a doc_id but not a text make one document of their sets
    held = used.select("doc_id", "set_key").join(sets.select("set_key", "rep"), "set_key")
    shared_ids = stage(held.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).where("b <> most").select("doc_id", "b"), "jaccard-shared-ids")
    if not shared_ids.isEmpty():
        edges = edges.unionByName(held.join(shared_ids, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct())
    final = components(edges)
    of_set = stage(sets.join(final, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component")), "jaccard-components")
    key = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("set_key"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), key.alias("own_key"))
    return out.join(of_set, F.col("own_key") == F.col("set_key"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _fit(na: Column, nb: Column, most: Column) -> Column:
    return _sizes_fit(na, nb) & _can_reach(most, na, nb)


def _may_fit(n: Column, least: Column, most: Column, common: Column) -> Column:
    """Whether a set of n elements may fit one of a size from least to most: true wherever _fit is, for any of these sizes and so many common elements or fewer."""
    sizes = (n * 100 >= least * SIMILARITY) & (most * 100 >= n * SIMILARITY)
    return sizes & (common + F.ceil(F.greatest(n, most) * F.lit(SIMILARITY / 100.0)) - 1 >= _needed(n, least))


def _candidates(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of heads (a, b, common), a: a centre of elements of b; and the keys (top, next, gid) under which all heads with a common element meet.

    The first centre of an element is the head with most shared elements. Of an element of two heads
    that is all there is; others have a second centre, by hash, and a key: the two heads with most
    shared elements, so that elements which the same heads share become one key."""
    c = F.col
    of = lambda toks: shared.select(F.explode(toks).alias("token"), "gid", "n", "pop")
    order = W.partitionBy("token").orderBy(F.desc("pop"), "gid")
    two = of("twos").select("gid", "n", "pop", *[F.lead(x).over(order).alias(f"{x}b") for x in ("gid", "n", "pop")])
    two = two.where(_fit(c("n"), c("nb"), F.least("pop", "popb"))).select(c("gid").alias("a"), c("gidb").alias("b"))
    p = of("more")
    # tables of one row an element are written, so that the elements of very many heads can be split in the joins below
    first = p.groupBy("token").agg(F.max(F.struct("pop", (-c("gid")).alias("gid"), "n")).alias("c"))
    first = stage(first.select("token", (-c("c.gid")).alias("top"), c("c.n").alias("nt"), c("c.pop").alias("pt")), "jaccard-tops")
    p = stage(p.join(first, "token"), "jaccard-postings")
    second = p.where("gid <> top").groupBy("token").agg(
        F.max(F.struct("pop", (-c("gid")).alias("gid"))).alias("c"), F.max(F.struct(F.xxhash64("token", "gid").alias("h"), (-c("gid")).alias("gid"), "n", "pop")).alias("o")
    )
    second = stage(second.select("token", (-c("c.gid")).alias("next"), (-c("o.gid")).alias("other"), c("o.n").alias("no"), c("o.pop").alias("po")), "jaccard-seconds")
    near = p.where((c("gid") != c("top")) & _fit(c("n"), c("nt"), F.least("pop", "pt"))).select(c("top").alias("a"), c("gid").alias("b"))
    p = p.join(second, "token")
    others = p.where((c("gid") != c("other")) & _fit(c("n"), c("no"), F.least("pop", "po"))).select(c("other").alias("a"), c("gid").alias("b"))
    pairs = two.unionByName(near).unionByName(others).groupBy("a", "b").agg(F.count("*").alias("common"))
    return stage(pairs, "jaccard-candidates"), stage(p.select("top", "next", "gid").distinct(), "jaccard-keys")


def _may_link() -> Column:
    """Whether heads x and y may be similar enough, by the masks of their shared elements: each bit that one mask alone has is
    an element that is not common, so pairs on one common passage end here."""
    c = F.col
    alone = lambda p, q: reduce(add, [F.bit_count(c(f"{p}.{m}").bitwiseAND(F.bitwise_not(f"{q}.{m}"))) for m in MASK])
    return _fit(c("x.n"), c("y.n"), F.least(c("x.pop") - alone("x", "y"), c("y.pop") - alone("y", "x")))


def _possible(candidates: DataFrame, shared: DataFrame) -> DataFrame:
    """Those candidates whose masks leave enough overlap possible. A head has up to two centres an element, so heads of many
    loosely alike texts have very many, and nearly all of them end here."""
    x, y = (shared.select("gid", "n", "pop", *MASK).alias(s) for s in "xy")
    at = candidates.join(x, candidates.a == F.col("x.gid")).join(y, candidates.b == F.col("y.gid"))
    return at.where(_may_link()).select("a", "b", "common")


def _component(df: DataFrame, col: str, found: DataFrame, name: str) -> DataFrame:
    c = found.select(F.col("node").alias(f"{name}_node"), F.col("component").alias(name))
    return df.join(c, df[col] == c[f"{name}_node"], "left").withColumn(name, F.coalesce(name, col)).drop(f"{name}_node")


def _rest(candidates: DataFrame, keys: DataFrame, members: DataFrame, shared: DataFrame, found: DataFrame, tried: DataFrame) -> DataFrame:
    """All pairs of members in different components that group pairs on a common element allow, and those inside one group; without those tried before.

    Under each key only the heads outside the component of its first head meet others: heads of the classes that may have
    a partner for them. A key has at most some thousands of classes (335 of sizes up to 20,000 by 38 of shared elements; those
    whose sizes fit one head are 20 by 38), so heads that are near none take time in proportion to their number."""
    c = F.col
    m = stage(_component(members.select("gid", "rep"), "rep", found, "c"), "jaccard-member-components")
    g = stage(m.groupBy("gid").agg(F.min("c").alias("low"), F.max("c").alias("high")), "jaccard-group-components")
    heads = keys.join(shared.select("gid", "n", "pop", *MASK), "gid").join(g, "gid")
    heads = heads.join(g.select(c("gid").alias("top"), c("low").alias("main")), "top")
    size_class, pop_class = F.floor(F.log(c("n")) / math.log(SIZES_APART)), F.floor(F.log(c("pop")) / math.log(POPS_APART))
    heads = heads.withColumns({"stray": (c("low") != c("high")) | (c("low") != c("main")), "size_class": size_class, "pop_class": pop_class})
    heads = stage(heads.drop("main"), "jaccard-heads")
    classes = heads.groupBy(*CLASS).agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("pop").alias("most_pop"))
    y = stage(classes, "jaccard-classes").alias("y")
    x = heads.where("stray").drop("size_class", "pop_class").alias("x")
    may = _may_fit(c("x.n"), c("y.least_n"), c("y.most_n"), F.least("x.pop", "y.most_pop"))
    x = x.join(y, (c("x.top") == c("y.top")) & (c("x.next") == c("y.next")) & may).select("x.*", "size_class", "pop_class")
    x, y = stage(x, "jaccard-strays").alias("x"), heads.alias("y")
    once = (c("x.gid") < c("y.gid")) | (~c("y.stray") & (c("x.gid") != c("y.gid")))
    same_class = reduce(and_, [c(f"x.{k}") == c(f"y.{k}") for k in CLASS])
    on = same_class & once & ~_one("x.low", "x.high", "y.low", "y.high") & _may_link()
    pairs = x.join(y, on).select(c("x.gid").alias("a"), c("y.gid").alias("b"))
    of = lambda col: g.select(c("gid").alias(col), c("low").alias(f"{col}low"), c("high").alias(f"{col}high"))
    others = candidates.join(of("a"), "a").join(of("b"), "b").where(~_one("alow", "ahigh", "blow", "bhigh")).select("a", "b")
    own = g.where("low <> high").select(c("gid").alias("a"), c("gid").alias("b"))
    pairs = pairs.unionByName(others).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(own).distinct()
    left = m.select(c("gid").alias("a"), c("rep").alias("ra"), c("c").alias("ca"))
    right = m.select(c("gid").alias("b"), c("rep").alias("rb"), c("c").alias("cb"))
    every = pairs.join(left, "a").join(right, "b").where("ca <> cb and ra <> rb")
    every = every.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    return every.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def _one(la: str, ha: str, lb: str, hb: str) -> Column:
    """Whether two groups lie in one and the same component."""
    return (F.col(la) == F.col(ha)) & (F.col(lb) == F.col(hb)) & (F.col(la) == F.col(lb))


def keep_one(docs: DataFrame, n: int = 5) -> DataFrame:
    """docs with one document of each component, that of least doc_id; all columns, whatever their names.

    Rows that share a doc_id become one: that of the least hash of its text, then of all its columns.
    Rows with a null doc_id stay, and so do null and empty texts."""
    found = near_duplicates(docs, n)
    gone = stage(found.where("component_id <> doc_id").select("doc_id").distinct(), "jaccard-gone")
    c = docs["`doc_id`"].cast("long")
    left = packed(docs, doc_id=c, lot=F.xxhash64(docs["`text`"])).join(gone, "doc_id", "left_anti")
    again = stage(own_columns(docs, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "jaccard-again")
    if again.isEmpty():
        return left.select("row.*")
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row", F.struct("lot", F.xxhash64(F.to_json("row")))).alias("row"))
    return left.join(again, "doc_id", "left_anti").select("row.*").unionByName(one.select("row.*"))
