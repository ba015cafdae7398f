"""Folder and invitation trees.

Walks down go level by level over DataFrames: each level is one equi-join of the frontier with the
edges, written to the shared folder, so depth is not limited by a recursion setting and a lost
executor costs one level. A node is entered once, so cycles end. Ways up, where each node has one
parent, are followed by pointers that jump twice as far each round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.staging import stage

MOST_DEPTH = 10_000


#: Levels after which those walked are written as one table.
TOGETHER = 16


def descend(start: DataFrame, edges: DataFrame, carry=None, stop=None) -> DataFrame:
    """All nodes reached from ``start`` (node, depth, ...) along ``edges`` (parent, node, ...), start included.

    ``carry``: columns of a child row from its parent's (``p.``) and its edge's (``e.``), in the order of start's other columns.
    ``stop``: is given each level as it is reached, and ends the walk there when it returns true.

    Where no node has two parents, only a cycle through a start node can lead back, so a level is held against the
    start alone; else against all levels before it.
    """
    names = start.columns
    start = seen = frontier = stage(start, "walk")
    one_parent = edges.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and start.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    # a start node below another one would be reached from there too
    for level in range(MOST_DEPTH):
        if stop is not None and stop(frontier):
            return seen
        step = frontier.alias("p").join(edges.alias("e"), F.col("p.node") == F.col("e.parent"))
        cols = [F.col("e.node").alias("node"), (F.col("p.depth") + 1).alias("depth"), *[c.alias(n) for c, n in zip(carry or [], names[2:])]]
        first = W.partitionBy("node").orderBy(*[c for c in names if c != "node"])
        nxt = step.select(*cols).join((start if one_parent else seen).select("node"), "node", "left_anti")
        nxt = stage(nxt.withColumn("__r", F.row_number().over(first)).where("__r = 1").select(*names), "walk")
        if nxt.isEmpty():
            return seen
        frontier, seen = nxt, seen.unionByName(nxt)
        if level % TOGETHER == TOGETHER - 1:
            seen = stage(seen, "walked")
    raise ValueError(f"deeper than {MOST_DEPTH}")


def _edges(folders: DataFrame) -> DataFrame:
    return folders.where("parent_id is not null").select(F.col("parent_id").alias("parent"), F.col("id").alias("node"), "name")


def child_counts(folders: DataFrame, books: DataFrame, root: str) -> DataFrame:
    """A-01: immediate folders and books of every folder; the root is no child."""
    f = folders.where((F.col("id") != root) & F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("folder_count"))
    b = books.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("book_count"))
    return folders.select("id").join(f, "id", "left").join(b, "id", "left").fillna(0, ["folder_count", "book_count"])


def folders_with_books(folders: DataFrame, books: DataFrame) -> DataFrame:
    """G-02, FI-06: ids of folders with a book anywhere below; climbs from the books' folders."""
    start = books.select(F.col("parent_id").alias("node")).distinct().withColumn("depth", F.lit(0))
    up = folders.select(F.col("id").alias("parent"), F.col("parent_id").alias("node")).where("node is not null")
    return folders.select("id").join(descend(start, up).select(F.col("node").alias("id")), "id", "left_semi")


def visible_child_counts(folders: DataFrame, books: DataFrame) -> DataFrame:
    """A-04."""
    some = folders.join(folders_with_books(folders, books), "id", "left_semi")
    n = some.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("visible_folders"))
    return folders.select("id").join(n, "id", "left").fillna(0, ["visible_folders"])


def with_children(folders: DataFrame, books: DataFrame) -> DataFrame:
    """FI-07: folders with any folder or book right below."""
    some = folders.select(F.col("parent_id").alias("id")).union(books.select("parent_id")).where("id is not null").distinct()
    return folders.join(some, "id", "left_semi")


def shareable_folders(folders: DataFrame, books: DataFrame, root: str) -> DataFrame:
    """G-09."""
    return folders.where(F.col("parent_id") == root).join(folders_with_books(folders, books), "id", "left_semi")


def depths(folders: DataFrame, root: str) -> DataFrame:
    """G-05: every folder below the root with depth and path from it."""
    start = folders.where(F.col("id") == root).select(F.col("id").alias("node"), F.lit(0).alias("depth"), F.lit("").alias("path"))
    path = F.when(F.col("p.path") == "", F.col("e.name")).otherwise(F.concat(F.col("p.path"), F.lit(" / "), F.col("e.name")))
    return descend(start, _edges(folders), [path])


def climb(nodes: DataFrame, step: Column | None = None) -> DataFrame:
    """(node, parent) -> node, top (where its parents end), steps (edges up to there), way (the steps' texts, top first, joined by " / "), cyclic.

    A node whose parent is null or no node is a top of its own. Each round joins the pointers with themselves, so they
    jump 1, 2, 4 ... edges and a tree of depth d takes log2(d) rounds. Nodes that have arrived take no further part. When no
    pointer arrives in a round, those that are left are in or below a cycle: of the nodes whose way ends, one at each depth
    is on the longest way, so each round brings some to their top. ``step``: the text of the edge above a node.
    """
    known = nodes.select(F.col("node").alias("__known"))
    rows = nodes.select("node", "parent", (F.lit("") if step is None else step).alias("way"))
    rows = rows.join(known, F.col("parent") == F.col("__known"), "left")
    is_top = F.col("__known").isNull()
    rows = stage(rows.select("node", F.when(~is_top, F.col("parent")).alias("up"), F.when(is_top, F.col("node")).alias("top"), (~is_top).cast("long").alias("steps"), F.when(is_top, F.lit("")).otherwise(F.col("way")).alias("way")), "climb")
    arrived, going = rows.where("up is null"), rows.where("up is not null")
    n = going.count()
    while n:
        a, b = going.alias("a"), arrived.unionByName(going).alias("b")
        way = F.when(F.col("b.way") == "", F.col("a.way")).otherwise(F.concat("b.way", F.lit(" / "), "a.way"))
        rows = stage(a.join(b, F.col("a.up") == F.col("b.node")).select("a.node", "b.up", "b.top", (F.col("a.steps") + F.col("b.steps")).alias("steps"), way.alias("way")), "climb")
        arrived, going, before = arrived.unionByName(rows.where("up is null")), rows.where("up is not null"), n
        n = going.count()
        if n == before:
            break
    none = going.select("node", F.lit(None).cast("string").alias("top"), F.lit(None).cast("long").alias("steps"), F.lit(None).cast("string").alias("way"), F.lit(True).alias("cyclic"))
    return arrived.select("node", "top", "steps", "way", F.lit(False).alias("cyclic")).unionByName(none)


def book_paths(folders: DataFrame, books: DataFrame, root: str) -> DataFrame:
    """G-03, PR-07: folder path and file name; the stored path where the folders don't lead to the root."""
    up = folders.select(F.col("id").alias("node"), F.when(F.col("id") != root, F.col("parent_id")).alias("parent"), "name")
    at = climb(up, F.col("name")).where(F.col("top") == root).select(F.col("node").alias("parent_id"), F.col("way").alias("__path"))
    made = F.when(F.col("__path") == "", F.col("file_name")).otherwise(F.concat(F.col("__path"), F.lit(" / "), F.col("file_name")))
    return books.join(at, "parent_id", "left").withColumn("path", F.when(F.col("__path").isNotNull(), made).otherwise(F.col("path"))).drop("__path")


def _live(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """W-04: (folders, books) of what is not in the bin, the first of equal ids."""
    live = items.where(~F.coalesce("trashed", F.lit(False)))
    kind = X.classify(F.col("name"), F.col("mime_type"))
    first = W.partitionBy("id").orderBy("parent_id", "name")
    live = live.withColumn("kind", kind).withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    return live.where("kind = 'folder'"), live.where("kind in ('fb2', 'zip', 'epub', 'mobi')")


DETAILS = ["size", "modified_time", "md5_checksum", "resource_key"]


def scan(items: DataFrame, root: str, on_progress: Callable[[dict], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """S-02, A-19: (folders, books) of all items below the root; trashed ones are left out, first of equal ids wins, and its details are kept.

    One join a level finds a level's folders and books together. ``on_progress`` is given, after each level, what the job that
    has read it counted: processed_folders (with the root), discovered_folders, queued_folders, books.
    """
    folders, books = _live(items)
    more = [c for c in DETAILS if c in items.columns]
    children = folders.unionByName(books).where(F.col("id") != root).select("id", "parent_id", "name", "kind", *more)
    frontier = items.sparkSession.range(1).select(F.lit(root).alias("id"), F.lit(0).alias("depth"), F.lit("").alias("path"))
    levels, processed, found, n = None, 0, 0, 0
    reading = 1
    for _ in range(MOST_DEPTH):
        p, c = frontier.select(F.col("id").alias("p_id"), "depth", F.col("path").alias("p_path")), children
        path = F.when(F.col("p_path") == "", F.col("name")).otherwise(F.concat("p_path", F.lit(" / "), "name"))
        seen = Observation()
        level = p.join(c, F.col("p_id") == F.col("parent_id")).select("id", "parent_id", "name", "kind", *more, (F.col("depth") + 1).alias("depth"), path.alias("path"))
        level = stage(level.observe(seen, F.count_if(F.col("kind") == "folder").alias("folders"), F.count_if(F.col("kind") != "folder").alias("books")), "scan")
        counted = seen.get
        processed, found, n = processed + reading, found + counted["folders"], n + counted["books"]
        reading = counted["folders"]
        if on_progress is not None:
            on_progress({"processed_folders": processed, "discovered_folders": found, "queued_folders": reading, "books": n})
        levels = level if levels is None else levels.unionByName(level)
        frontier = level.where("kind = 'folder'").select("id", "depth", "path")
        if not reading:
            break
    else:
        raise ValueError(f"deeper than {MOST_DEPTH}")
    its = levels.where("kind <> 'folder'").select("id", "parent_id", F.col("name").alias("file_name"), F.col("kind").alias("source_type"), "path", *more)
    return levels.where("kind = 'folder'").select("id", "parent_id", "name", "depth", "path"), its


def listing_problems(items: DataFrame, root: str) -> DataFrame:
    """ST-06: (id, problem) of a listing that can't be whole: no live root folder, ids twice, and what is not in the bin but names a parent that is not listed."""
    live = items.where(~F.coalesce("trashed", F.lit(False)))
    folder = X.classify(F.col("name"), F.col("mime_type")) == "folder"
    roots = live.where((F.col("id") == root) & folder).agg(F.count("*").alias("n")).where("n = 0").select(F.lit(root).alias("id"), F.lit("no root").alias("problem"))
    twice = live.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated").alias("problem"))
    known = items.select(F.col("id").alias("parent_id")).distinct()
    lost = live.where((F.col("id") != root) & F.col("parent_id").isNotNull()).join(known, "parent_id", "left_anti").select("id", F.lit("unknown parent").alias("problem"))
    return roots.unionByName(twice).unionByName(lost)


def count_indexable(items: DataFrame, root: str, minimum: int = 10) -> int:
    """S-03, FI-14: min(actual, minimum); goes no level deeper once there are enough."""
    folders, books = _live(items)
    found = 0

    def enough(level: DataFrame) -> bool:
        nonlocal found
        found += books.join(level.select(F.col("node").alias("parent_id")), "parent_id", "left_semi").limit(minimum - found).count()
        return found >= minimum

    start = items.sparkSession.range(1).select(F.lit(root).alias("node"), F.lit(0).alias("depth"))
    descend(start, _edges(folders), stop=enough)
    return found


def shared_folders(folders: DataFrame, root: str, excluded: list[str]) -> DataFrame:
    """G-01: folders reached from the root without entering an excluded one."""
    kept = folders.where(~F.col("id").isin(excluded)) if excluded else folders
    return depths(kept.unionByName(folders.where(F.col("id") == root)).distinct(), root)


def shared_books(folders: DataFrame, books: DataFrame, root: str, excluded: list[str]) -> DataFrame:
    """G-01: books in shared folders; the root's own books are always in."""
    return books.join(shared_folders(folders, root, excluded).select(F.col("node").alias("parent_id")), "parent_id", "left_semi")


def forest(users: DataFrame) -> DataFrame:
    """G-06: (uid, root, depth, cyclic) from (uid, invited_by). Roots have no or an unknown inviter; what no root reaches is in or below a cycle."""
    got = climb(users.select(F.col("uid").alias("node"), F.col("invited_by").alias("parent")))
    return got.select(F.col("node").alias("uid"), F.col("top").alias("root"), F.col("steps").cast("int").alias("depth"), "cyclic")


def ancestry(items: DataFrame, root: str) -> DataFrame:
    """G-04, FI-26: for each item whether its parents lead to the root: inside, excluded (trashed on the way, or led elsewhere), undetermined (a parent is missing, or a cycle)."""
    state = F.when(F.coalesce("trashed", F.lit(False)), "excluded").when(F.col("id") == root, "inside").when(F.col("parent_id").isNull(), "excluded")
    ends = items.select("id", "parent_id", state.alias("state"))
    got = climb(ends.select(F.col("id").alias("node"), F.when(F.col("state").isNull(), F.col("parent_id")).alias("parent")))
    known = ends.where("state is not null").select(F.col("id").alias("top"), "state")
    return got.join(known, "top", "left").select(F.col("node").alias("id"), "state").fillna("undetermined", ["state"])
