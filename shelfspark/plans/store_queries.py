"""Queries over files of the application, checkpoints, settings, orders, dictionaries and book files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog as C
from ..operators import genres as G
from ..operators import publish as P
from ..operators import refresh as R
from ..operators import social as S
from ..operators import store as O
from ..registry import query

NO_TEXT = lambda: F.lit(None).cast("string")
BYTES = lambda c: F.encode(c, "UTF-8")


def _files(t):
    k = F.col("doc_id")
    return t.raw("documents").select(
        F.concat(F.lit("f"), k.cast("string")).alias("id"), F.concat(F.lit("n"), k.cast("string")).alias("name"), F.when(k % 3 == 0, O.APP_DATA).otherwise("root").alias("parent"),
        F.lit(O.JSON).alias("mime_type"), F.lit("u1").alias("owner_uid"), BYTES(F.col("source")).alias("content"),
    )


def _changes(t):
    k = F.col("doc_id")
    at = k % 7
    op = F.when(at == 0, "update").when(at.isin(1, 5), "move").when(at == 2, "delete").when(at.isin(3, 4), "create")
    made = at == 3
    return t.raw("documents").where(at != 6).select(
        k.alias("pos"), op.alias("op"), F.concat(F.when(made, "g").otherwise("f"), k.cast("string")).alias("id"), F.when(at.isin(3, 4), F.concat(F.lit("new"), k.cast("string"))).alias("name"),
        F.when(at == 1, "other").when(at.isin(3, 4), O.APP_DATA).alias("parent"), F.when(at.isin(1, 5), "root").alias("old_parent"), NO_TEXT().alias("owner_uid"), BYTES(F.when(made, "made").otherwise("new")).alias("content"),
    )


@query(
    "k07_file_changes",
    """SELECT 'f' || doc_id AS id, 'n' || doc_id AS name, CASE WHEN doc_id % 7 = 1 THEN 'other' WHEN doc_id % 3 = 0 THEN 'appDataFolder' ELSE 'root' END AS parent, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE source END AS text
    FROM documents WHERE NOT (doc_id % 7 = 2 AND doc_id % 3 = 0) UNION ALL SELECT 'g' || doc_id, 'new' || doc_id, 'appDataFolder', 'made' FROM documents WHERE doc_id % 7 = 3""",
)
def _(t):
    return O.apply_changes(_files(t), _changes(t))[0].select("id", "name", "parent", F.decode("content", "UTF-8").alias("text"))


@query("k07_blocked_changes", "SELECT doc_id AS pos, 'f' || doc_id AS id, CASE doc_id % 7 WHEN 2 THEN 'deletion blocked' WHEN 4 THEN 'exists' ELSE 'incomplete' END AS problem FROM documents WHERE doc_id % 7 IN (4, 5) OR (doc_id % 7 = 2 AND doc_id % 3 <> 0)")
def _(t):
    return O.apply_changes(_files(t), _changes(t))[1].select("pos", "id", "problem")


@query("k02_building_index", "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'file' || n_nationkey ELSE 'building-index-n' || n_nationkey END AS id, 'building-index-n' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'update' ELSE 'create' END AS op, n_name AS text FROM nation")
def _(t):
    k = F.col("n_nationkey").cast("string")
    n = t.raw("nation")
    files = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("file"), k).alias("id"), F.concat(F.lit("building-index-n"), k).alias("name"), F.lit(O.APP_DATA).alias("parent"))
    saved = n.select(F.concat(F.lit("n"), k).alias("root_folder_id"), BYTES(F.col("n_name")).alias("content"))
    return O.building_index_changes(saved, files).select("id", "name", "op", F.decode("content", "UTF-8").alias("text"))


@query("s08_catalog_files", "SELECT id FROM items WHERE name = 'src1_12.EPUB' AND NOT trashed OR id = 'd7' AND NOT trashed")
def _(t):
    name = F.when(F.col("id") == "d7", "src1_12.EPUB").otherwise(F.col("name"))
    return O.shared_catalog_files(t.items.withColumn("name", name), "src1_12.EPUB").select("id")


@query("s08_shared_folders", "SELECT 'all' AS owner, id FROM folders WHERE id LIKE 'c%' AND CAST(substr(id, 2) AS INT) % 3 = 0 AND CAST(substr(id, 2) AS INT) % 5 <> 0 UNION ALL SELECT 'one', id FROM folders WHERE id LIKE 'c%' AND CAST(substr(id, 2) AS INT) % 4 = 1 AND CAST(substr(id, 2) AS INT) % 5 <> 0")
def _(t):
    k = F.substring("id", 2, 20).cast("int")
    owner = F.concat(F.lit("Owner"), (k % 4).cast("string"), F.lit("@Example.com "))
    f = t.folders_flat.select("id", F.lit(O.FOLDER).alias("mime_type"), (k % 5 == 0).alias("trashed"), F.array(owner).alias("owners"), (k % 3 == 0).alias("shared_with_me"))
    return O.shared_folders(f).select(F.lit("all").alias("owner"), "id").unionByName(O.shared_folders(f, " OWNER1@example.com").select(F.lit("one").alias("owner"), "id"))


@query("s08_permissions", "SELECT viewer_uid FROM shares_now WHERE owner_uid = 'u9' AND active")
def _(t):
    p = t.shares_now.select(F.col("owner_uid").alias("folder_id"), "viewer_uid", (~F.col("active")).alias("deleted"))
    return O.permissions_of(p, "u9").select("viewer_uid")


@query(
    "s09_byte_ranges",
    """SELECT id, CASE WHEN a <= b AND a < n THEN hex(encode(substr(name, a + 1, b - a + 1))) END AS bytes, CASE WHEN a <= b AND a < n THEN b + 1 >= n END AS is_complete,
    CASE WHEN b < a THEN 'invalid_range' WHEN a >= n THEN 'invalid_content_range' END AS problem FROM (SELECT id, name, length(name) AS n, k % 40 AS a, k % 40 + k % 9 - 1 AS b FROM (SELECT id, name, CAST(substr(id, 2) AS BIGINT) AS k FROM items))""",
)
def _(t):
    k = F.substring("id", 2, 20).cast("long")
    q = t.items.select("id", (k % 40).alias("start"), (k % 40 + k % 9 - 1).alias("end"))
    return O.read_range(t.items.select("id", BYTES(F.col("name")).alias("content")), q).select("id", F.hex("bytes").alias("bytes"), "is_complete", "problem")


@query("s10_json_files", "SELECT event_id AS id, CASE WHEN event_id % 4 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 4 = 0 THEN 'invalid json' END AS problem FROM events")
def _(t):
    text = F.when(F.col("event_id") % 4 == 0, "{oops").otherwise(F.to_json(F.struct(F.col("user_id").alias("u"), F.col("event_type").alias("k"))))
    return O.read_json(t.raw("events").select(F.col("event_id").alias("id"), BYTES(text).alias("content")), "u long, k string").select("id", F.col("value.u").alias("user_id"), F.col("value.k").alias("kind"), "problem")


@query(
    "s31_settings",
    """SELECT owner_uid, CASE WHEN k % 5 > 1 THEN root END AS root_folder_id, CASE WHEN k % 5 > 1 THEN '' END AS resource_key, CASE k % 5 WHEN 0 THEN 'invalid json' WHEN 1 THEN 'version' END AS problem
    FROM (SELECT 'u' || (o_custkey % 50) AS owner_uid, o_orderkey AS k, 'r' || o_custkey AS root, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey DESC) AS r FROM orders WHERE o_orderkey % 2 = 0) WHERE r = 1""",
)
def _(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.when(k % 5 == 0, "oops{").when(k % 5 == 1, '{"version":2}').otherwise(F.concat(F.lit('{"version":1,"activeRootFolderId":"r'), c.cast("string"), F.lit('"}')))
    f = t.raw("orders").select(F.concat(F.lit("u"), (c % 50).cast("string")).alias("owner_uid"), k.cast("string").alias("id"), F.when(k % 2 == 0, "settings.json").otherwise("other.json").alias("name"), k.alias("modified_time"), BYTES(text).alias("content"))
    return O.stored_settings(f, "settings.json").select("owner_uid", "root_folder_id", "resource_key", "problem")


@query("k13_store_covers", "SELECT 'cover-b' || p_partkey || '.webp' AS id, 'appDataFolder' AS parent, CAST(greatest(1, floor(w * s + 0.5)) AS BIGINT) AS width, CAST(greatest(1, floor(h * s + 0.5)) AS BIGINT) AS height FROM (SELECT p_partkey, w, h, least(1.0::DOUBLE, 240.0::DOUBLE / w, 320.0::DOUBLE / h) AS s FROM (SELECT p_partkey, p_partkey % 900 + 1 AS w, p_partkey * 7 % 1100 + 1 AS h FROM part))")
def _(t):
    k = F.col("p_partkey")
    c = t.raw("part").select(k.alias("pos"), F.concat(F.lit("b"), k.cast("string")).alias("book_id"), BYTES(F.col("p_name")).alias("content"), (k % 900 + 1).alias("width"), (k * 7 % 1100 + 1).alias("height"))
    return O.cover_changes(c).select("id", "parent", "size.width", "size.height")


@query("k13_remove_covers", "SELECT id FROM (SELECT DISTINCT cover_file_id AS id FROM books WHERE cover_file_id IS NOT NULL)")
def _(t):
    c = t.books.select("cover_file_id")
    files = c.where("cover_file_id is not null").distinct().select(F.col("cover_file_id").alias("id"), F.col("cover_file_id").alias("name"), F.lit(O.APP_DATA).alias("parent"), NO_TEXT().alias("mime_type"), NO_TEXT().alias("owner_uid"), F.lit(None).cast("binary").alias("content"))
    left = O.apply_changes(files, O.cover_removals(c.unionByName(c.select(F.lit("").alias("cover_file_id")))))[0]
    return files.join(left.select("id"), "id", "left_anti").select("id")


STATUSES = "(SELECT k, 'user' || k || '@example.com' AS email, k % 4 = 0 AS reg, k % 4 IN (0, 1) AS acc, k % 4 = 2 AS pend FROM (SELECT c_custkey AS k FROM customer))"


def _synced(t):
    c = F.col("c_custkey")
    at = lambda *x: (c % 4).isin(*x)
    mail = lambda a="user", b="@example.com": F.concat(F.lit(a), c.cast("string"), F.lit(b))
    uid = F.concat(F.lit("u"), c.cast("string"))
    s = t.raw("customer").select(
        mail(" User", "@Example.com").alias("email"), F.when(at(2), "pending").alias("status"), F.lit(5).cast("long").alias("created_at"), F.lit(None).cast("long").alias("sent_at"), at(0).alias("registered"), F.when(at(0), uid).alias("registered_uid"), NO_TEXT().alias("registered_name"),
        at(0, 1).alias("accepted"), uid.alias("accepted_uid"), F.when(c % 8 == 1, "Named").alias("accepted_name"), F.lit(0).cast("long").alias("accepted_at"),
    )
    quota = s.limit(1).withColumn("email", F.lit("__quota"))
    # drive friends by address for multiples of 3, by uid for multiples of 5
    d = t.raw("customer").where((c % 3 == 0) | (c % 5 == 0)).select(c.alias("pos"), F.when(c % 3 == 0, F.lit("x")).otherwise(uid).alias("uid"), F.when(c % 3 == 0, mail()).otherwise("other@example.com").alias("email"), F.col("c_name").alias("display_name"), F.concat(F.lit("root"), c.cast("string")).alias("root_folder_id"), (c % 2 == 0).alias("inbound"), F.lit(False).alias("outbound"))
    old = t.raw("customer").where(c % 10 < 2).select(F.lit("old").alias("uid"), mail().alias("email"), F.lit("Old").alias("display_name"), F.lit("oldroot").alias("root_folder_id"), F.lit(False).alias("inbound"), (c % 10 == 0).alias("outbound"))
    return S.sync_statuses(s.unionByName(quota), d, old, "me", 77)


@query(
    "st29_accepted_friends",
    f"""SELECT 'u' || k AS uid, s.email, CASE WHEN k % 8 = 1 THEN 'Named' WHEN k % 3 = 0 OR k % 5 = 0 THEN c_name ELSE s.email END AS display_name,
    CASE WHEN k % 3 = 0 OR k % 5 = 0 THEN 'root' || k WHEN reg AND k % 10 < 2 THEN 'oldroot' ELSE '' END AS root_folder_id,
    NOT reg OR ((k % 3 = 0 OR k % 5 = 0) AND k % 2 = 0) AS inbound, NOT reg OR k % 10 = 0 AS outbound
    FROM {STATUSES} s JOIN customer ON c_custkey = k WHERE acc UNION ALL SELECT 'old', email, 'Old', 'oldroot', false, k % 10 = 0 FROM {STATUSES} WHERE NOT acc AND k % 10 < 2""",
)
def _(t):
    return _synced(t)["accepted"]


@query("st29_pending_and_ledger", f"SELECT email, 'pending' AS kind, CAST(5 AS BIGINT) AS at FROM {STATUSES} WHERE pend UNION ALL SELECT email, 'accepted', CAST(77 AS BIGINT) FROM {STATUSES} WHERE acc AND NOT reg")
def _(t):
    got = _synced(t)
    p = got["pending"].select(F.col("invitee_email").alias("email"), F.lit("pending").alias("kind"), F.col("created_at").alias("at"))
    return p.unionByName(got["ledger"].select("email", F.lit("accepted").alias("kind"), F.col("accepted_at").alias("at")))


@query("o04_facet_places", "SELECT value, row_number() OVER (ORDER BY CASE WHEN value = 'ECONOMY' THEN 0 ELSE 1 END, lower(label), value) AS place FROM (SELECT DISTINCT g AS value, CASE g WHEN 'ECONOMY' THEN 'Эконом' ELSE g END AS label FROM (SELECT unnest(genres) AS g FROM books) WHERE trim(g) <> '')")
def _(t):
    return C.placed(C.genre_facets(t.books, {"ECONOMY": "Эконом"}), C.facet_order()).select("value", "place")


@query("o15_o16_client_pages", "SELECT uid, CAST(ceil(row_number() OVER (ORDER BY uid) / 25.0) AS BIGINT) AS page FROM users")
def _(t):
    return C.placed(t.users.select("uid"), [F.col("uid")]).select("uid", F.ceil(F.col("place") / 25).cast("long").alias("page"))


@query("f17_admin_dates", "SELECT o_orderkey AS k, strftime(o_orderdate + to_seconds(o_orderkey % 60), '%d.%m.%Y, %H:%M:%S') AS text FROM orders")
def _(t):
    at = F.col("o_orderdate").cast("timestamp") + F.make_interval(secs=F.col("o_orderkey") % 60)
    return t.raw("orders").select(F.col("o_orderkey").alias("k"), X.date_label(at, seconds=True).alias("text"))


@query("f08_query_literals", "SELECT event_id, replace(replace(props || '\\' || event_type || '''', '\\', '\\\\'), '''', '\\''') AS text FROM events")
def _(t):
    c = F.concat("props", F.lit("\\"), "event_type", F.lit("'"))
    return t.raw("events").select("event_id", X.query_literal(c).alias("text"))


@query("f11_friend_plural", "SELECT c_custkey AS k, CASE WHEN c_custkey % 100 BETWEEN 11 AND 19 THEN 'друзей' WHEN c_custkey % 10 = 1 THEN 'друг' WHEN c_custkey % 10 BETWEEN 2 AND 4 THEN 'друга' ELSE 'друзей' END AS word FROM customer")
def _(t):
    return t.raw("customer").select(F.col("c_custkey").alias("k"), X.plural(F.col("c_custkey"), "друг", "друга", "друзей").alias("word"))


@query("st04_overlay_journal", "SELECT id, CASE WHEN pos % 10 = 0 THEN 'done' ELSE metadata_status END AS metadata_status FROM books")
def _(t):
    done = t.books.where("pos % 10 = 0").withColumn("metadata_status", F.lit("done"))
    early = t.books.where("pos % 20 = 0").withColumn("metadata_status", F.lit("early")).withColumn("pos", F.col("pos") - 1)
    return R.overlay(t.books, early.unionByName(done)).select("id", "metadata_status")


@query("v09_cursors", "SELECT 'u' || c_custkey AS uid FROM customer WHERE c_custkey < 40")
def _(t):
    keys = [C.decode_cursor(C.encode_cursor("users", f"u{i}", i), "users", 2) for i in range(40)]
    return t.spark.createDataFrame([(k[0],) for k in keys], "uid string").join(t.users.select("uid"), "uid", "left_semi")


def _made_files(t, kind):
    """Book files made of documents, as bytes: what parsers read back must be what went in."""
    import pandas as pd

    from ..shipping import ship
    from ..sources.parsers import made

    ship(t.spark)
    make = {"epub": made.epub, "mobi": made.mobi, "zip": made.zipped_fb2, "fb2": made.damaged_fb2}[kind]

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "name": b["id"] + "." + kind, "source_type": kind, "content": [make(i, a, x or "") for i, a, x in zip(b["id"], b["lang"], b["text"])]})

    rows = t.raw("documents").where("doc_id is not null").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("lang", F.lit("xx")).alias("lang"), "text")
    return rows.mapInPandas(run, "id string, name string, source_type string, content binary")


def _parsed(t, kind):
    from ..sources.parsers import extract_metadata

    out = extract_metadata(_made_files(t, kind))
    return out.select("id", "title", F.array_join("authors", "|").alias("authors"), "language", F.coalesce("warning", F.lit("")).alias("warning"))


PARSED = "SELECT CAST(doc_id AS VARCHAR) AS id, 'Book ' || doc_id AS title, 'A. Writer|B. Other' AS authors, coalesce(lang, 'xx') AS language, {warning} AS warning FROM documents"


@query("p11_j24_epub_files", PARSED.format(warning="''"))
def _(t):
    return _parsed(t, "epub")


@query("p12_s25_mobi_files", PARSED.format(warning="''"))
def _(t):
    return _parsed(t, "mobi")


@query("p09_s24_zip_files", PARSED.format(warning="''"))
def _(t):
    return _parsed(t, "zip")


@query("p07_damaged_fb2_files", PARSED.format(warning="CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'binary_corruption_recovered' ELSE 'metadata_only_recovered' END"))
def _(t):
    return _parsed(t, "fb2")


@query("f23_image_kinds", "SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' END AS kind FROM part")
def _(t):
    k = F.col("p_partkey")
    head = F.when(k % 5 == 0, "89504E470D0A1A0A00").when(k % 5 == 1, "FFD8FFE0").when(k % 5 == 2, "474946383961").when(k % 5 == 3, "524946460000000057454250").otherwise("52494646000000005741564500")
    return t.raw("part").select(k.alias("k"), X.image_kind(F.unhex(head)).alias("kind"))


@query("pr16_index_header", "SELECT 'root' AS root_folder_id, count(*) AS total, count(*) FILTER (metadata_status = 'error') AS failed FROM books")
def _(t):
    counts = t.books.agg(F.count("*").alias("total"), F.count_if(F.col("metadata_status") == "error").alias("failed"))
    index = t.spark.range(1).select(F.lit("root").alias("root_folder_id"))
    return P.header(index, counts).select("root_folder_id", "indexing_counts.total", "indexing_counts.failed")


@query("w04_first_of_equal_ids", "SELECT id, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 2 = 0 THEN 'a' ELSE parent_id END AS parent_id FROM items")
def _(t):
    even = F.col("id").substr(2, 20).cast("long") % 2 == 0
    rows = t.items.unionByName(t.items.where(even).withColumn("parent_id", F.lit("a"))).withColumn("parent_id", F.coalesce("parent_id", F.lit("")))
    return R.latest(rows, ["id"], [F.col("parent_id"), F.col("name")]).select("id", "parent_id")


