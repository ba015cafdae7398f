"""Queries over listings, journals, snapshots, refreshes and what is published of them."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import genres as G
from ..operators import limits as L
from ..operators import publish as P
from ..operators import refresh as R
from ..operators import social as S
from ..operators import store as O
from ..operators import tree as T
from ..operators.journal import Journal
from ..operators.snapshots import Conflict, SnapshotStore
from ..registry import query
from ..sources.listing import listing, write_pages
from .staging import own_dir


def _folder(t, name: str) -> str:
    return f"{own_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


NUMBER = lambda c="id": F.substring(c, 2, 20).cast("long")


@query("s01_list_children", "SELECT parent_id, id, name FROM items WHERE NOT trashed")
def _(t):
    at = _folder(t, "pages")
    write_pages(t.items, at, 25)
    return listing(t.spark, at).select("parent_id", "id", "name")


@query("s01_list_folders", "SELECT parent_id, id, name FROM folders WHERE parent_id IN ('n3', 'n7')")
def _(t):
    at = _folder(t, "pages")
    kinds = t.folders_flat.withColumn("mime_type", F.lit(O.FOLDER)).unionByName(t.books.select("id", "parent_id", F.col("file_name").alias("name"), F.lit("").alias("mime_type")))
    write_pages(kinds, at, 10)
    return listing(t.spark, at, ["n3", "n7"], folders_only=True).select("parent_id", "id", "name")


@query("s14_whole_collection", "SELECT uid, display_name FROM users")
def _(t):
    at = _folder(t, "pages")
    write_pages(t.users.select(F.lit("users").alias("parent_id"), F.col("uid").alias("id"), F.col("display_name").alias("name")), at)
    return listing(t.spark, at, ["users"]).select(F.col("id").alias("uid"), F.col("name").alias("display_name"))


def _journal(t) -> Journal:
    """A full save and three deltas: rows of the second replace those of the first, ids that no book has are passed over, and one is gone by the last header."""
    j = Journal(t.spark, _folder(t, "journal"))
    later = lambda by: t.current.select("id", (F.col("size") + by).alias("size"))
    j.save({"phase": "h0"}, t.previous.select("id", "size"))
    j.save({"phase": "h1"}, later(500), t.current.where("pos % 4 < 2"))
    j.save({"phase": "h2"}, later(1000), t.current.where("pos % 4 = 1"))
    j.save({"phase": "h3", "removed_book_ids": ["b4", "b5"]}, later(7), t.spark.createDataFrame([("no such",)], "id string"))
    return j


JOURNALED = """(SELECT id, size FROM previous WHERE id NOT IN (SELECT id FROM current WHERE pos % 4 < 2) UNION ALL
    SELECT id, size + CASE WHEN pos % 4 = 1 THEN 1000 ELSE 500 END FROM current WHERE pos % 4 < 2)"""


@query("k03_checkpoint", f"SELECT id, size, 'h3' AS phase FROM {JOURNALED} WHERE id NOT IN ('b4', 'b5')")
def _(t):
    header, books = _journal(t).load()
    return books.withColumn("phase", F.lit(header["phase"]))


@query("k03_full_checkpoint", "SELECT id, size, 'h4' AS phase, 1 AS saves FROM current")
def _(t):
    j = _journal(t)
    j.save({"phase": "h4"}, t.current.select("id", "size"))
    header, books = j.load()
    return books.withColumns({"phase": F.lit(header["phase"]), "saves": F.lit(len(j.live()))})


@query("k01_k04_commit", f"SELECT id, size, 2 AS number, 'ready' AS metadata_status FROM {JOURNALED} WHERE id NOT IN ('b4', 'b5')")
def _(t):
    store, folders = SnapshotStore(t.spark, _folder(t, "store")), t.folders
    store.commit({"root_folder_id": "root"}, folders, t.previous.select("id", "size"), None)
    j = _journal(t)
    books = j.load()[1].withColumn("metadata_status", F.lit("ready"))
    store.commit({"root_folder_id": "root"}, folders, books, 1, j)
    try:
        store.commit({"root_folder_id": "root"}, folders, t.current.select("id", "size"), 1)
    except Conflict:
        m, _, books = SnapshotStore(t.spark, store.folder.path).load("root")
        return books.select("id", "size", F.lit(m.number).alias("number"), "metadata_status")
    raise AssertionError("a commit over another one must fail")


@query(
    "s11_saved_index",
    """SELECT id, CASE p_partkey % 4 WHEN 0 THEN 'fb2' WHEN 1 THEN 'epub' WHEN 2 THEN 'mobi' ELSE 'zip' END AS source_type, CASE WHEN metadata_status = 'processing' THEN 'pending' ELSE metadata_status END AS metadata_status, metadata_status = 'processing' OR p_partkey % 2 = 0 AS migrated
    FROM books JOIN part ON p_partkey = pos""",
)
def _(t):
    """Rows of an older form: every second one has neither kind nor extension."""
    store, old = SnapshotStore(t.spark, _folder(t, "store")), F.col("pos") % 2 == 0
    rows = t.books.select("id", "file_name", "metadata_status", "authors", F.when(~old, F.col("source_type")).alias("source_type"), F.when(~old, F.lower(F.regexp_extract("file_name", r"\.([A-Za-z0-9]+)$", 1))).alias("extension"))
    store.commit({"root_folder_id": "root", "version": 3}, t.folders, rows, None)
    return store.load("root")[2].select("id", "source_type", "metadata_status", "migrated")


BOOK = """(NOT trashed AND (regexp_matches(name, '\\.(fb2|epub|mobi|zip)$', 'i') OR (NOT regexp_matches(name, '\\.(azw3?|pdf|djvu|docx?|txt)$', 'i') AND mime_type IN ('application/zip', 'application/epub+zip', 'application/x-mobipocket-ebook')) OR (mime_type = 'application/zip')))"""
SAME = "CAST(substr(id, 2) AS BIGINT) % 5 = 0"


def _refreshed(t):
    folders = t.folders.where("id not like 'c%'").withColumn("mime_type", F.lit(O.FOLDER)).withColumn("trashed", F.lit(False))
    items = t.items.unionByName(folders.select("id", "parent_id", "name", "mime_type", "trashed")).withColumns({"size": F.lit(1), "modified_time": F.lit("m")})
    kind = X.classify(F.col("name"), F.col("mime_type"))
    active = t.items.select("id", F.col("name").alias("file_name"), kind.alias("source_type"), F.when(NUMBER() % 5 == 0, 1).otherwise(2).alias("size"), F.lit("m").alias("modified_time"), F.lit("ready").alias("metadata_status"), F.concat(F.lit("T"), "id").alias("title"), F.concat(F.lit("cover"), F.col("id")).alias("cover_file_id"))
    store = SnapshotStore(t.spark, _folder(t, "store"))
    store.commit({"root_folder_id": "root"}, t.folders, active, None)
    return O.refresh_library(items, store, "root")


@query("st06_refresh", f"SELECT id, CASE WHEN {SAME} THEN 'ready' ELSE 'pending' END AS metadata_status, CASE WHEN {SAME} THEN 'T' || id END AS title, 2 AS number FROM items WHERE {BOOK}")
def _(t):
    got = _refreshed(t)
    return got["books"].select("id", "metadata_status", "title", F.lit(got["number"]).alias("number"))


@query("st06_stale_covers", f"SELECT 'cover' || id AS cover_file_id FROM items WHERE NOT ({BOOK} AND {SAME})")
def _(t):
    return _refreshed(t)["stale_covers"]


@query("st06_listing_problems", "SELECT id, 'repeated' AS problem FROM items WHERE NOT trashed AND CAST(substr(id, 2) AS BIGINT) % 10 = 1 UNION ALL SELECT id, 'unknown parent' FROM items WHERE NOT trashed AND parent_id = 'n4' UNION ALL SELECT 'lost', 'no root'")
def _(t):
    """Rows with ids on 1 come twice; the folder n4 is not listed; the root is in the bin."""
    folders = t.folders.where("id not like 'c%' and id <> 'n4' and id <> 'root'").withColumn("mime_type", F.lit(O.FOLDER)).withColumn("trashed", F.lit(False))
    rows = t.items.unionByName(t.items.where("cast(substr(id, 2) as bigint) % 10 = 1 and parent_id <> 'n4'")).unionByName(t.items.where("cast(substr(id, 2) as bigint) % 10 = 1 and parent_id = 'n4'").withColumn("parent_id", F.lit("n5")))
    rows = rows.unionByName(folders.select("id", "parent_id", "name", "mime_type", "trashed"))
    root = t.spark.range(1).select(F.lit("lost").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("L").alias("name"), F.lit(O.FOLDER).alias("mime_type"), F.lit(True).alias("trashed"))
    return T.listing_problems(rows.unionByName(root).withColumn("parent_id", F.when(F.col("parent_id") == "root", "lost").otherwise(F.col("parent_id"))), "lost")


@query(
    "a19_scan_progress",
    """WITH d AS (SELECT CASE WHEN id = 'root' THEN 0 WHEN id LIKE 'r%' THEN 1 WHEN id LIKE 'n%' THEN 2 ELSE 3 END AS depth, count(*) AS f FROM folders GROUP BY 1),
    b AS (SELECT CASE WHEN parent_id LIKE 'n%' THEN 2 ELSE 3 END AS depth, count(*) AS b FROM books WHERE parent_id IN (SELECT id FROM folders) GROUP BY 1)
    SELECT CAST(sum(f) OVER w AS BIGINT) AS processed_folders, CAST(sum(f) OVER w - 1 + coalesce(lead(f) OVER w, 0) AS BIGINT) AS discovered_folders, CAST(coalesce(lead(f) OVER w, 0) AS BIGINT) AS queued_folders, CAST(sum(coalesce(b, 0)) OVER w AS BIGINT) AS books FROM d LEFT JOIN b USING (depth) WINDOW w AS (ORDER BY depth)""",
)
def _(t):
    """What the walk itself reports, one row a level."""
    items = t.folders.withColumn("mime_type", F.lit(O.FOLDER)).unionByName(t.books.select("id", "parent_id", F.col("file_name").alias("name"), F.lit("").alias("mime_type"))).withColumn("trashed", F.lit(False))
    told = []
    T.scan(items, "root", told.append)
    return t.spark.createDataFrame([tuple(x.values()) for x in told], "processed_folders long, discovered_folders long, queued_folders long, books long")


@query("s10_read_files", "SELECT n_nationkey AS k, CAST(octet_length(encode(n_name)) + 1 AS BIGINT) AS size, n_name AS text FROM nation")
def _(t):
    at = _folder(t, "files")
    t.raw("nation").select("n_nationkey", "n_name").write.partitionBy("n_nationkey").text(at)
    got = O.read_files(t.spark, at)
    return got.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("k"), "size", F.rtrim(F.decode("content", "UTF-8"), F.lit("\n")).alias("text"))


@query("k06_unpublished", "SELECT DISTINCT owner_uid, viewer_uid AS root_folder_id, false AS published, 0 AS books, 0 AS folders FROM shares")
def _(t):
    return P.tombstones(t.shares.select("owner_uid", F.col("viewer_uid").alias("root_folder_id"))).select("owner_uid", "root_folder_id", "published", F.size("books").alias("books"), F.size("folders").alias("folders"))


@query(
    "k05_publish_actions",
    """WITH asked AS (SELECT uid, root, sig FROM (SELECT o_custkey AS uid, o_orderkey % 2 AS root, o_orderkey % 3 AS sig, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1)
    SELECT uid AS owner_uid, CASE WHEN uid % 5 = 0 OR uid % 7 = 0 THEN 'create' WHEN root <> uid % 2 THEN 'move' WHEN sig = uid % 3 THEN 'skip' ELSE 'update' END AS action, CASE WHEN uid % 5 <> 0 AND uid % 7 <> 0 AND root <> uid % 2 THEN uid % 2 END AS unpublish_root FROM asked""",
)
def _(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    asked = t.raw("orders").select(c.alias("owner_uid"), (k % 2).alias("root_folder_id"), (k % 3).alias("signature"), k.alias("pos"))
    had = t.raw("orders").select(c.alias("owner_uid")).distinct().where("owner_uid % 7 <> 0").select("owner_uid", (F.col("owner_uid") % 2).alias("root_folder_id"), (F.col("owner_uid") % 3).alias("signature"), (F.col("owner_uid") % 5 != 0).alias("published"))
    return P.publish_all(asked, had).select("owner_uid", "action", "unpublish_root")


@query("st03_batches", "SELECT pos, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 500.0) AS BIGINT) AS batch FROM books WHERE pos % 2 = 0")
def _(t):
    items = t.books.select("pos", F.col("id").alias("book_id"), F.when(F.col("pos") % 2 == 0, "pending").otherwise("done").alias("state"))
    return P.numbered_batches(items, 500).select("pos", "batch")


CODES = [*P.ERROR_LABELS, "other_code"]


@query("pr15_error_labels", "SELECT pos, CASE pos % 10 " + " ".join(f"WHEN {i} THEN '{P.ERROR_LABELS.get(c, c)}'" for i, c in enumerate(CODES)) + " ELSE 'Ошибка' END AS label FROM errors")
def _(t):
    code = F.when(F.col("pos") % 10 < len(CODES), F.element_at(F.array(*map(F.lit, CODES)), F.least(F.col("pos") % 10 + 1, F.lit(len(CODES))).cast("int"))).when(F.col("pos") % 10 == 8, "")
    return t.errors.select("pos", P.error_label(code).alias("label"))


@query(
    "f31_scan_status",
    """SELECT parent_id, CASE WHEN bool_or(pos % 2 = 0) THEN 'Google Drive временно не ответил. Повторяем запрос…' ELSE 'Сканирование библиотеки…' END || ' Обработано папок: ' || min(pos) || '. В очереди: ' || max(pos) || '. Найдено книг: ' || count(*) || '. Прошло: ' || max(size) || ' с.' AS status,
    CASE WHEN parent_id LIKE 'c%' THEN 'Не удалось прочитать папку «' || parent_id || '».' ELSE 'Не удалось завершить обновление библиотеки. Не удалось прочитать одну из папок Google Drive.' END || ' Старая версия библиотеки сохранена.' AS failure FROM books GROUP BY parent_id""",
)
def _(t):
    n = t.books.groupBy("parent_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count("*").alias("n"), F.max("size").alias("s"), F.bool_or(F.col("pos") % 2 == 0).alias("r"))
    return n.select("parent_id", X.scan_status(F.col("a"), F.col("b"), F.col("n"), F.col("s"), F.col("r")).alias("status"), X.scan_failure(F.when(F.startswith("parent_id", F.lit("c")), F.col("parent_id"))).alias("failure"))


CACHE = "SELECT l_suppkey AS owner, l_orderkey * 10 + l_linenumber AS pos, 'u' || l_partkey AS uid, l_comment AS display_name, l_linestatus AS email, l_tax > 0.02 AS inbound, CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber % 3 = 1 END AS outbound FROM l"
LINES = "l AS (SELECT *, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE repeat(l_returnflag, 200) END AS l_comment FROM lineitem)"


def _friends(t):
    n = F.col("l_linenumber") % 3
    return t.raw("lineitem").select(
        F.col("l_suppkey").alias("owner"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("uid"), F.when(F.col("l_linenumber") % 4 != 0, F.repeat("l_returnflag", F.lit(200))).alias("display_name"),
        F.col("l_linestatus").alias("email"), F.lit(None).cast("string").alias("catalog_id"), F.lit(None).cast("string").alias("root_folder_id"), (F.col("l_tax") > 0.02).alias("inbound"), F.when(n > 0, n == 1).alias("outbound"), F.lit(None).cast("boolean").alias("is_admin"),
    )


KEPT_FRIENDS = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY pos, uid) AS r FROM ({CACHE}) WHERE inbound) WHERE r <= 20"


@query("pr12_friend_cache", f"WITH {LINES} SELECT owner, pos, uid, substr(coalesce(display_name, ''), 1, 160) AS display_name, email, '' AS catalog_id, '' AS root_folder_id, true AS inbound, coalesce(outbound, false) AS outbound, false AS is_admin FROM ({KEPT_FRIENDS})")
def _(t):
    return S.friend_cache(_friends(t), 20)


@query("v08_friend_cache_shape", f"WITH {LINES} SELECT owner, CAST(r - 1 AS INT) AS pos, uid FROM ({KEPT_FRIENDS}) WHERE owner % 3 <> 0 AND r % 4 <> 0 AND NOT (r % 5 = 0)")
def _(t):
    """Every third owner's value is no list; every fourth entry has a number for a uid, and every fifth no outbound."""
    kept = S.friend_cache(_friends(t), 20)
    place = F.row_number().over(W.partitionBy("owner").orderBy("pos", "uid"))
    e = kept.withColumn("r", place).select("owner", "r", F.to_json(F.struct(F.when(F.col("r") % 4 != 0, F.col("uid")).alias("uid"), F.when(F.col("r") % 4 == 0, F.col("r")).alias("n"), "display_name", "email", "inbound", F.when(F.col("r") % 5 != 0, F.col("outbound")).alias("outbound"))).alias("j"))
    e = e.withColumn("j", F.replace("j", F.lit('"n":'), F.lit('"uid":')))
    text = F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "j"))), lambda x: x["j"]), ","), F.lit("]"))
    stored = e.groupBy("owner").agg(text.alias("value")).withColumn("value", F.when(F.col("owner") % 6 == 0, '{"uid":"x"}').when(F.col("owner") % 3 == 0, "oops").otherwise(F.col("value")))
    return S.read_friend_cache(stored).select("owner", "pos", "uid")


@query("fi29_inbound", f"WITH {LINES} SELECT DISTINCT owner, uid FROM ({CACHE}) WHERE inbound AND pos % 3 <> 0")
def _(t):
    f = _friends(t).withColumn("uid", F.when(F.col("pos") % 6 == 0, F.concat(F.lit("email:"), "uid")).when(F.col("pos") % 3 == 0, "").otherwise(F.col("uid")))
    return S.inbound_friends(f).select("owner", "uid").distinct()


@query(
    "pr13_library_tabs",
    """WITH f AS (SELECT 'u' || (s_suppkey % 10) AS owner, 'u' || s_suppkey AS uid, s_name AS display_name, s_suppkey AS pos FROM supplier WHERE s_acctbal > 0 AND 'u' || s_suppkey <> 'u' || (s_suppkey % 10)),
    o AS (SELECT 'u' || s_suppkey AS owner, s_name AS display_name FROM supplier WHERE s_suppkey < 10)
    SELECT owner, CAST(row_number() OVER (PARTITION BY owner ORDER BY mine, pos) AS INT) AS place, uid, display_name FROM (SELECT owner, owner AS uid, display_name, 0 AS mine, 0 AS pos FROM o UNION ALL SELECT owner, uid, display_name, 1, pos FROM f)""",
)
def _(t):
    own = t.suppliers.where("pos < 10").select(F.col("uid").alias("owner"), "display_name")
    friends = t.suppliers.select(F.concat(F.lit("u"), (F.col("pos") % 10).cast("string")).alias("owner"), "uid", "display_name", (F.col("balance") > 0).alias("inbound"), "pos")
    made = friends.withColumn("uid", F.concat(F.lit("email:"), "uid")).withColumn("inbound", F.lit(True))
    return S.library_tabs(own, friends.unionByName(made))


@query(
    "st19_verified",
    """SELECT uid, CASE WHEN k % 2 = 0 THEN k % 3 = 0 ELSE true END AS inbound, CASE WHEN k % 2 = 0 AND k % 5 <> 0 THEN k % 7 = 0 ELSE CASE WHEN k % 4 = 0 THEN false END END AS outbound FROM (SELECT uid, pos AS k FROM suppliers)
    WHERE CASE WHEN k % 2 = 0 THEN k % 3 = 0 ELSE true END OR coalesce(CASE WHEN k % 2 = 0 AND k % 5 <> 0 THEN k % 7 = 0 ELSE CASE WHEN k % 4 = 0 THEN false END END, true)""",
)
def _(t):
    """What was verified under another root says nothing of outbound any more."""
    k = F.col("pos")
    rows = t.suppliers.select("uid", F.lit(True).alias("inbound"), F.when(k % 4 == 0, F.lit(False)).alias("outbound"))
    seen = t.suppliers.where("pos % 2 = 0").select("uid", (k % 3 == 0).alias("inbound"), (k % 7 == 0).alias("outbound"), F.when(k % 5 == 0, "old root").otherwise("root").alias("root_folder_id"))
    return S.overlay_verified(rows, S.reset_verified(seen, "root"))


STEPS = """s AS (SELECT c_nationkey AS library, c_custkey AS pos, c_custkey % 5 = 0 AS previous, c_custkey % 3 = 0 AS desired, CASE WHEN c_custkey % 97 = 0 THEN 'not a folder' WHEN (c_custkey % 5 = 0) <> (c_custkey % 3 = 0) AND c_custkey % 31 = 0 THEN 'not allowed' END AS problem FROM customer),
    f AS (SELECT *, problem IS NOT NULL OR (previous <> desired AND pos % 41 = 0) AS fails FROM s), o AS (SELECT *, coalesce(bool_or(fails) OVER (PARTITION BY library ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM f),
    r AS (SELECT library, pos, previous, CASE WHEN late THEN 'not reached' WHEN fails THEN 'failed' WHEN previous <> desired THEN 'applied' ELSE 'unchanged' END AS status, CASE WHEN NOT late AND fails THEN coalesce(problem, 'HTTP 403') END AS error FROM o)"""


def _access(t):
    k = F.col("c_custkey")
    c = t.raw("customer")
    folders = c.select(F.col("c_nationkey").alias("library"), k.alias("id"), F.col("c_name").alias("name"), k.alias("pos"))
    settings = c.where(k % 3 == 0).groupBy(F.col("c_nationkey").alias("library")).agg(F.collect_list(k).alias("excluded_folder_ids"))
    states = c.select(k.alias("id"), (k % 97 != 0).alias("is_folder"), (k % 5 == 0).alias("inherited_off"), F.when(k % 31 == 0, F.lit(False)).alias("can_turn_off"), (k % 31 != 0).alias("can_turn_on"))
    answers = c.select(k.alias("id"), (k % 41 != 0).alias("ok"), F.when(k % 41 == 0, "HTTP 403").alias("error"))
    return S.access_outcomes(S.access_steps(folders, settings, states), answers)


@query("st21_outcomes", f"WITH {STEPS} SELECT library, pos, status, error FROM r")
def _(t):
    return _access(t).select("library", "pos", "status", "error")


@query("st21_compensation", f"WITH {STEPS} SELECT library, CAST(row_number() OVER (PARTITION BY library ORDER BY pos DESC) AS INT) AS place, pos AS id, previous AS set_to, b.error AS because FROM r JOIN (SELECT library, error FROM r WHERE status = 'failed') b USING (library) WHERE status = 'applied'")
def _(t):
    return S.access_compensation(_access(t))


@query("st14_pruned", "SELECT user_id AS uid FROM events GROUP BY user_id HAVING user_id % 10 = 0 OR max(CAST(epoch(ts) AS BIGINT)) > (SELECT max(CAST(epoch(ts) AS BIGINT)) - 86400 FROM events)")
def _(t):
    """Every tenth user's times can't be read, so they stay."""
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    now = t.raw("events").agg(F.max(s)).first()[0]
    states = t.raw("events").groupBy(F.col("user_id").alias("uid")).agg(X.delta36(F.array_sort(F.collect_list(s))).alias("times"))
    return L.prune_budgets(states.withColumn("times", F.when(F.col("uid") % 10 == 0, "?!").otherwise(F.col("times"))), now).select("uid")


PLAIN = """'{"a":' || CASE event_id % 5 WHEN 0 THEN 'null' WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN 'true' WHEN 3 THEN '[' || user_id || ',"' || event_type || '",[]]' ELSE '2.5' END || ',"b":{"c":{"d":["' || event_type || '",{"e":' || event_id || '}]},"f":{}},"q":"say \\"' || event_type || '\\" \\\\"}'"""


def _plain(event_id: str = "event_id"):
    e = F.col(event_id)
    u, kind = F.col("user_id").cast("string"), F.col("event_type")
    a = F.when(e % 5 == 0, "null").when(e % 5 == 1, u).when(e % 5 == 2, "true").when(e % 5 == 3, F.concat(F.lit("["), u, F.lit(',"'), kind, F.lit('",[]]'))).otherwise("2.5")
    return F.concat(F.lit('{"a":'), a, F.lit(',"b":{"c":{"d":["'), kind, F.lit('",{"e":'), e.cast("string"), F.lit('}]},"f":{}},"q":"say \\"'), kind, F.lit('\\" \\\\"}'))


@query("pr11_round_trip", f"SELECT event_id, {PLAIN} AS plain FROM events")
def _(t):
    typed = t.raw("events").select("event_id", P.typed_document(_plain()).alias("typed"))
    return typed.select("event_id", P.document_value(F.col("typed")).alias("plain"))


@query(
    "pr11_typed",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"nullValue":null}' WHEN 1 THEN '{"integerValue":"' || user_id || '"}' WHEN 2 THEN '{"booleanValue":true}' WHEN 3 THEN '{"arrayValue":{"values":[{"integerValue":"' || user_id || '"},{"stringValue":"' || event_type || '"},{"arrayValue":{"values":[]}}]}}' ELSE '{"doubleValue":2.5}' END AS typed FROM events""",
)
def _(t):
    typed = F.try_parse_json(P.typed_document(_plain()))
    return t.raw("events").select("event_id", F.to_json(F.try_variant_get(typed, "$.mapValue.fields.a", "variant")).alias("typed"))


@query("s21_xsd_codes", "SELECT DISTINCT lower(replace(p_type, ' ', '_')) AS code FROM part")
def _(t):
    """One schema a brand, each with the types of its parts."""
    value = F.concat(F.lit('<xs:enumeration value=" '), F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))), F.lit(' "/>'))
    xsd = F.concat(F.lit('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:simpleType><xs:restriction base="xs:token">'), F.array_join(F.collect_list(value), ""), F.lit('<xs:enumeration value=" "/></xs:restriction></xs:simpleType></xs:schema>'))
    return G.xsd_codes(t.raw("part").groupBy("p_brand").agg(xsd.alias("value")))


@query("s22_page_mapping", "SELECT code, label FROM (SELECT lower(replace(p_brand, '#', '_')) || '_' || (p_partkey % 40) AS code, p_name AS label, row_number() OVER (PARTITION BY p_brand, p_partkey % 40 ORDER BY p_partkey % 3, p_partkey) AS r FROM part) WHERE r = 1")
def _(t):
    k, code = F.col("p_partkey"), F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("_"), (F.col("p_partkey") % 40).cast("string"))
    line = F.when(k % 3 == 0, F.concat(code, F.lit(" — "), "p_name")).when(k % 3 == 1, F.concat("p_name", F.lit(" ("), code, F.lit(") - 11 231"))).otherwise(F.concat(F.lit("0.12."), k.cast("string"), F.lit(" "), code, F.lit(";"), "p_name"))
    return G.page_mapping(t.raw("part").select(k.alias("pos"), line.alias("line")))


@query("k11_dictionary", "SELECT code, label FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY CASE layer WHEN 'override' THEN 0 WHEN 'source' THEN 1 WHEN 'seed' THEN 2 ELSE 3 END, source_rank, label) AS r FROM mappings) WHERE r = 1")
def _(t):
    at = _folder(t, "dictionary")
    G.write_dictionary(G.merge(t.mappings), at, t.mappings.select("code").distinct())
    return G.read_dictionary(t.spark, at)


@query(
    "k14_cover_cache",
    """WITH q AS (SELECT DISTINCT 'o' || (p_partkey % 7) AS owner, 'b' || (p_partkey % 500) AS book, 'm' || (p_partkey % 3) AS m FROM part), n AS (SELECT *, 'secret-library-shared-cover-' || owner || '-' || book || '-' AS prefix FROM q),
    have AS (SELECT 'secret-library-shared-cover-o' || (p_partkey % 7) || '-b' || (p_partkey % 500) || '-m' || (p_partkey % 2) || '.webp' AS name FROM part WHERE p_partkey % 4 = 0),
    made AS (SELECT prefix, prefix || m || '.webp' AS name FROM n WHERE prefix || m || '.webp' NOT IN (SELECT name FROM have))
    SELECT name, CASE WHEN name IN (SELECT name FROM have) THEN 'hit' ELSE 'create' END AS action FROM (SELECT prefix || m || '.webp' AS name FROM n)
    UNION ALL SELECT DISTINCT h.name, 'delete' FROM have h JOIN made ON starts_with(h.name, made.prefix) WHERE h.name NOT IN (SELECT prefix || m || '.webp' FROM n)""",
)
def _(t):
    k = F.col("p_partkey")
    text = lambda a, n: F.concat(F.lit(a), (k % n).cast("string"))
    asked = t.raw("part").select(text("o", 7).alias("owner_uid"), text("b", 500).alias("book_id"), text("m", 3).alias("modified_time"))
    files = t.raw("part").where(k % 4 == 0).select(k.cast("string").alias("id"), O.shared_cover_name(text("o", 7), text("b", 500), text("m", 2)).alias("name"))
    return O.cover_cache_changes(asked, files).select("name", "action").distinct()


@query(
    "pr14_error_details",
    """SELECT pos, CASE WHEN pos % 3 = 0 THEN 'parse' WHEN pos % 3 = 1 THEN 'download' ELSE 'metadata-extraction' END AS stage, coalesce(code, CASE WHEN pos % 2 = 0 THEN 'TypeError' ELSE 'error' END) AS code, CASE WHEN pos % 5 = 0 THEN 'because' ELSE substr(message, 1, 1000) END AS message,
    CASE WHEN pos % 7 = 0 THEN 3 ELSE 1 END AS attempt, CASE WHEN pos % 11 = 0 THEN 'd e f' END AS entry_path, CASE WHEN pos % 11 = 0 THEN 'FB2' END AS inner_format, CASE WHEN code = 'e1' AND pos % 2 = 1 THEN false END AS body_indexed FROM (SELECT pos, message, CASE WHEN code = 'e1' AND pos % 2 = 0 THEN NULL ELSE code END AS code FROM errors)""",
)
def _(t):
    p = F.col("pos")
    code = F.when(~((F.col("code") == "e1") & (p % 2 == 0)), F.col("code"))
    rows = t.errors.select(
        "pos", F.when(p % 3 == 0, "parse").alias("stage"), F.when(p % 3 == 1, 503).alias("status"), F.when(code == "e1", "metadata_only_recovered").otherwise(code).alias("code"), F.when(p % 2 == 0, "TypeError").alias("name"), F.when(p % 5 != 0, F.col("message")).alias("message"), F.lit("because").alias("reason"),
        F.when(p % 7 == 0, 3).alias("attempt"), F.when(p % 11 == 0, "d\te\nf").alias("entry_path"), F.when(p % 11 == 0, "fb2").alias("inner_format"),
    )
    d = R.error_details(rows)
    return d.select("pos", "stage", F.when(F.col("code") == "metadata_only_recovered", "e1").otherwise(F.col("code")).alias("code"), "message", "attempt", "entry_path", "inner_format", "body_indexed")
