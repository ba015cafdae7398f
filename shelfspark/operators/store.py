"""Files of the application: what is listed, read by ranges, written, moved and never deleted; settings; covers; the refresh of a library.

A files table has a row a file: id, name, parent, mime_type, owner_uid (the app's own mark), content.
Changes are rows too, applied in the order of ``pos``; what is not allowed comes back as problems.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.staging import stage
from .refresh import latest, preserve_metadata, stale_covers
from .snapshots import SnapshotStore
from .tree import listing_problems, scan

# Where the application's own files lie, and what they are called.
APP_DATA, JSON, FOLDER = "appDataFolder", "application/json", "application/vnd.google-apps.folder"
CATALOG, COVER_PREFIX = "secret-library-catalog.json", "cover-"


def shared_catalog_files(files: DataFrame, name: str = CATALOG) -> DataFrame:
    """S-08: files of this name that are not in the bin."""
    return files.where((F.col("name") == name) & ~F.coalesce("trashed", F.lit(False)))


def shared_folders(files: DataFrame, owner_email: str = "") -> DataFrame:
    """S-08: folders of one owner, or without one those that are shared with the reader."""
    owner = X.normalized(owner_email)
    mine = F.exists("owners", lambda o: X.email(o) == owner) if owner else F.coalesce("shared_with_me", F.lit(False))
    return files.where((F.col("mime_type") == FOLDER) & ~F.coalesce("trashed", F.lit(False)) & mine)


def permissions_of(permissions: DataFrame, folder: str) -> DataFrame:
    """S-08: the permissions of a folder that are not deleted."""
    return permissions.where((F.col("folder_id") == folder) & ~F.coalesce("deleted", F.lit(False)))


def read_range(files: DataFrame, requests: DataFrame) -> DataFrame:
    """S-09: for requests (id, start, end), both inclusive: bytes, is_complete (the range reaches the file's end) and problem."""
    f, q = files.select("id", "content").alias("f"), requests.alias("q")
    size = F.octet_length("f.content")
    bad = F.col("q.start").isNull() | F.col("q.end").isNull() | (F.col("q.start") < 0) | (F.col("q.end") < F.col("q.start"))
    problem = F.when(bad, "invalid_range").when(F.col("f.id").isNull(), "not found").when(F.col("q.start") >= size, "invalid_content_range")
    got = F.when(problem.isNull(), F.substring(F.col("f.content"), (F.col("q.start") + 1).cast("int"), (F.col("q.end") - F.col("q.start") + 1).cast("int")))
    return q.join(f, F.col("q.id") == F.col("f.id"), "left").select("q.id", "q.start", "q.end", got.alias("bytes"), F.when(problem.isNull(), F.col("q.end") + 1 >= size).alias("is_complete"), problem.alias("problem"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """S-10: whole files of a folder and those below it: path, size, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), "content")


def read_json(files: DataFrame, schema: str) -> DataFrame:
    """S-10: content as JSON of this shape; ``problem`` where it is none."""
    text = F.decode("content", "UTF-8")
    value = F.from_json(text, schema)
    ok = F.try_parse_json(text).isNotNull()
    return files.select("id", F.when(ok, value).alias("value"), F.when(~ok, "invalid json").alias("problem"))


def apply_changes(files: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K-02, K-07, K-13: (files afterwards, problems). changes: pos, op, id, name, parent, old_parent, owner_uid, content.

    create needs a name and a parent, and an owner outside the app's folder; update replaces the content; move needs both
    parents; delete is for files in the app's own folder only, for others may be the reader's books, and of one that is
    gone is no problem. The last update, the last move and the last delete of a file count; a deleted file is gone.
    """
    c = changes.alias("c").join(files.select(F.col("id").alias("had"), F.col("parent").alias("at")).alias("f"), F.col("c.id") == F.col("f.had"), "left")
    blank = lambda x: F.coalesce(F.col(f"c.{x}"), F.lit("")) == ""
    op, gone = F.col("c.op"), F.col("had").isNull()
    problem = (
        F.when((op == "create") & (blank("name") | blank("parent") | (blank("owner_uid") & (F.col("c.parent") != APP_DATA))), "incomplete")
        .when((op == "create") & ~gone, "exists")
        .when((op == "move") & (blank("parent") | blank("old_parent")), "incomplete")
        .when(op.isin("update", "move") & gone, "not found")
        .when((op == "delete") & ~gone & (F.col("at") != APP_DATA), "deletion blocked")
        .when(~op.isin("create", "update", "move", "delete"), "unknown")
    )
    c = stage(c.select("c.*", problem.alias("problem")), "file-changes")
    good = c.where("problem is null")
    last = lambda o: latest(good.where(F.col("op") == o), ["id"], [F.desc("pos")])
    made = last("create").select("id", "name", "parent", F.lit(JSON).alias("mime_type"), "owner_uid", "content")
    body, place = last("update").select("id", F.col("content").alias("new")), last("move").select("id", F.col("parent").alias("to"))
    out = files.select("id", "name", "parent", "mime_type", "owner_uid", "content").unionByName(made).join(last("delete").select("id"), "id", "left_anti")
    out = out.join(body.withColumn("hit", F.lit(True)), "id", "left").join(place, "id", "left")
    out = out.select("id", "name", F.coalesce("to", "parent").alias("parent"), "mime_type", "owner_uid", F.when(F.col("hit"), F.col("new")).otherwise(F.col("content")).alias("content"))
    return out, c.where("problem is not null").select("pos", "op", "id", "problem")


def building_index_changes(saved: DataFrame, files: DataFrame, drop: bool = False) -> DataFrame:
    """K-02: a building index a library (root_folder_id, content): an update of the file that there is, else a new one; with ``drop`` its deletion."""
    name = F.concat(F.lit("building-index-"), F.col("s.root_folder_id"))
    f = latest(files.where(F.col("parent") == APP_DATA), ["name"], [F.col("id")]).select(F.col("id").alias("had"), F.col("name").alias("file_name"))
    rows = saved.alias("s").join(f, name == F.col("file_name"), "left")
    op = F.when(F.lit(drop), "delete").when(F.col("had").isNull(), "create").otherwise("update")
    return rows.select(F.lit(0).alias("pos"), op.alias("op"), F.coalesce("had", name).alias("id"), name.alias("name"), F.lit(APP_DATA).alias("parent"), F.lit(None).cast("string").alias("old_parent"), F.lit(None).cast("string").alias("owner_uid"), F.col("s.content").alias("content"))


def stored_settings(files: DataFrame, name: str, owner: str = "owner_uid") -> DataFrame:
    """S-31: one row an owner of the newest file of this name: version 1, its root folder and key; else ``problem``."""
    rows = latest(files.where(F.col("name") == name), [owner], [F.desc("modified_time"), F.col("id")])
    v = F.try_parse_json(F.decode("content", "UTF-8"))
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    problem = F.when(v.isNull(), "invalid json").when(~F.coalesce(F.try_variant_get(v, "$.version", "int") == 1, F.lit(False)), "version")
    root = F.nullif(text("activeRootFolderId"), F.lit(""))
    return rows.select(owner, "id", F.when(problem.isNull(), root).alias("root_folder_id"), F.when(problem.isNull(), F.coalesce(text("activeRootFolderResourceKey"), F.lit(""))).alias("resource_key"), problem.alias("problem"))


def cover_changes(covers: DataFrame) -> DataFrame:
    """K-13: a change that stores each cover (book_id, content, width, height, pos) under the app's name; the size it is to have beside it."""
    name = F.concat(F.lit(COVER_PREFIX), F.col("book_id"), F.lit(".webp"))
    size = X.fit_scale(F.col("width"), F.col("height"))
    return covers.select("pos", F.lit("create").alias("op"), name.alias("id"), name.alias("name"), F.lit(APP_DATA).alias("parent"), F.lit(None).cast("string").alias("old_parent"), F.lit(None).cast("string").alias("owner_uid"), "content", size.alias("size"))


def cover_removals(ids: DataFrame) -> DataFrame:
    """K-13: deletions of covers, each id once, blank ones left out."""
    one = ids.select(F.col("cover_file_id").alias("id")).where("id is not null and id <> ''").distinct()
    none = F.lit(None).cast("string")
    return one.select(F.lit(0).alias("pos"), F.lit("delete").alias("op"), "id", none.alias("name"), none.alias("parent"), none.alias("old_parent"), none.alias("owner_uid"), F.lit(None).cast("binary").alias("content"))


#: Fixed value: what names of a viewer's cached covers begin with.
SHARED_COVER_PREFIX = "secret-library-shared-cover-"


def shared_cover_name(owner, book, modified):
    """K-14: the name of a cached cover: owner, book, and the version of the book."""
    part = lambda c: F.replace(F.url_encode(F.coalesce(c.cast("string"), F.lit(""))), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit(SHARED_COVER_PREFIX), part(owner), F.lit("-"), part(book), F.lit("-"), part(F.coalesce(F.nullif(modified, F.lit("")), F.lit("unknown"))), F.lit(".webp"))


def cover_cache_changes(asked: DataFrame, files: DataFrame) -> DataFrame:
    """K-14: (name, id, action) for covers that a viewer asks for (owner_uid, book_id, modified_time): each name once however often it is asked for:
    ``hit`` (it is cached, in the first file of that name), ``create``, and for each book of which a version is created, ``delete`` of the cached
    versions that nobody asks for. Without owner or book there is nothing. files: id, name."""
    some = asked.where("coalesce(owner_uid, '') <> '' and coalesce(book_id, '') <> ''")
    q = some.select(shared_cover_name(F.col("owner_uid"), F.col("book_id"), F.lit("x")).alias("__x"), shared_cover_name(F.col("owner_uid"), F.col("book_id"), F.col("modified_time")).alias("name")).distinct()
    q = q.select("name", F.expr("left(__x, length(__x) - 6)").alias("prefix"))
    have = latest(files.where(F.startswith("name", F.lit(SHARED_COVER_PREFIX))), ["name"], [F.col("id")])
    rows = q.join(have.select("name", "id"), "name", "left").select("name", "prefix", "id", F.when(F.col("id").isNull(), "create").otherwise("hit").alias("action"))
    made = rows.where("action = 'create'").select("prefix").distinct()
    cached = files.where(F.startswith("name", F.lit(SHARED_COVER_PREFIX)))
    return rows.select("name", "id", "action").unionByName(_stale_versions(cached, made).join(q.select("name").distinct(), "name", "left_anti").select("name", "id", F.lit("delete").alias("action")))


def _stale_versions(cached: DataFrame, made: DataFrame) -> DataFrame:
    """Cached files whose name begins with a made prefix: each name is held against all its own beginnings that end in a hyphen, by equality."""
    cuts = F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring(F.col("name"), i, F.lit(1)) == "-")
    return cached.select("id", "name", F.explode(F.transform(cuts, lambda i: F.substring(F.col("name"), F.lit(1), i))).alias("prefix")).join(made, "prefix").select("id", "name").distinct()


class RefreshError(ValueError):
    """A refresh that must not be saved; the former snapshot stays current."""


def refresh_library(items: DataFrame, store: SnapshotStore, root: str, on_progress=None) -> dict:
    """ST-06: a refresh as one chain. The listing is checked, the tree is scanned, metadata of unchanged books is kept, the
    snapshot is saved, read back and made current, and only then are the covers named that nothing needs any more.

    An error at any place (RefreshError, Conflict, Mismatch, BadIndex) leaves the former snapshot current and names no cover. A
    listing without a live root folder, with an id twice or with an unlisted parent is one: a library is not emptied because its
    root was not found. items: id, parent_id, name, mime_type, trashed, size, modified_time. Returns books, folders, stale_covers, number."""
    bad = listing_problems(items, root).limit(5).collect()
    if bad:
        raise RefreshError(", ".join(f"{r.problem}: {r.id}" for r in bad))
    active = store.load(root)
    folders, found = scan(items, root, on_progress)
    books = found.withColumn("metadata_status", F.lit("pending"))
    if active is not None:
        books = preserve_metadata(books, active[2].drop("migrated"))
    number = store.commit({"root_folder_id": root}, folders, books, active[0].number if active else None)
    _, folders, books = store.load(root)
    had = None if active is None or "cover_file_id" not in active[2].columns else stale_covers(books, active[2])
    none = books.select(F.lit("").alias("cover_file_id")).where("false")
    return {"books": books.drop("migrated"), "folders": folders, "stale_covers": none if had is None else had, "number": number}


def zip_candidates(entries: DataFrame) -> DataFrame:
    """FI-13: entries that may be a book."""
    n = F.lower("name")
    return entries.where(X.zip_entry_kind(F.col("name")).isNotNull() & ~F.array_contains(F.split(n, "/"), "__macosx") & ~F.endswith(n, F.lit("thumbs.db")))


def zip_totals(entries: DataFrame, key: str, most: int = 512 << 20, ratio: int = 500) -> DataFrame:
    """A-15, V-05: (key, total, too_large, over) of entries (key, size, packed): whether all of an archive, or the ratio of one entry, is above its budget."""
    over = F.bool_or(F.col("size") > ratio * F.greatest(F.lit(1), F.col("packed")))
    return entries.groupBy(key).agg(F.sum("size").alias("total"), (F.sum("size") > most).alias("too_large"), over.alias("over"))
