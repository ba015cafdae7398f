"""Queries over published catalogs, settings and small stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import publish as P
from ..operators import social as S
from ..registry import query

WALK = "WITH walk AS (SELECT 'root' AS node UNION ALL SELECT f.id FROM walk w JOIN folders f ON f.parent_id = w.node WHERE f.id NOT IN ('r2'))"


@query("k05_pr02_publish", f"{WALK} SELECT id, parent_id, file_name, size, title FROM books WHERE parent_id IN (SELECT node FROM walk)")
def _(t):
    rows, signature = P.publish(t.folders, t.books, "root", ["r2"], None)
    if P.publish(t.folders, t.books, "root", ["r2"], signature)[0] is not None:
        raise AssertionError("an unchanged catalog is not published again")
    return rows.select("id", "parent_id", "file_name", "size", "title")


@query("s27_s11_live_catalogs", "SELECT owner_uid, id FROM (SELECT owner_uid, id, active AS published, row_number() OVER (PARTITION BY owner_uid ORDER BY pos DESC, id) AS r FROM shares) WHERE r = 1 AND published")
def _(t):
    return P.live_catalogs(t.shares.select("owner_uid", "id", F.col("active").alias("published"), F.col("pos").alias("updated_at"))).select("owner_uid", "id")


@query("s28_registry", "WITH old AS (SELECT 'u' || (o_custkey % 20) AS owner_uid, 'a' || (o_orderkey % 50) AS email, 'old' AS status, o_orderkey AS updated_at FROM orders), new AS (SELECT 'u' || (o_custkey % 20) AS owner_uid, 'a' || (o_orderkey % 50) AS email, 'new' AS status, o_orderkey AS updated_at FROM orders WHERE o_orderkey % 3 = 0) SELECT owner_uid, email, status, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY owner_uid, email ORDER BY rank, updated_at DESC) AS r FROM (SELECT *, 0 AS rank FROM new UNION ALL SELECT *, 1 FROM old)) WHERE r = 1")
def _(t):
    row = F.struct(F.concat(F.lit("a"), (F.col("o_orderkey") % 50).cast("string")).alias("email"), F.lit("old").alias("status"), F.col("o_orderkey").alias("updated_at"))
    o = t.raw("orders").withColumn("owner_uid", F.concat(F.lit("u"), (F.col("o_custkey") % 20).cast("string")))
    new = o.where("o_orderkey % 3 = 0").select("owner_uid", F.to_json(row.withField("status", F.lit("new"))).alias("value"))
    return P.registry(o.select("owner_uid", F.to_json(F.array(row)).alias("value")), new.unionByName(o.limit(1).select("owner_uid", F.lit("{broken").alias("value"))))


@query("a02_w07_positions", "SELECT id, row_number() OVER (PARTITION BY parent_id ORDER BY pos) AS place, count(*) OVER (PARTITION BY parent_id) AS total FROM books")
def _(t):
    return P.positions(t.books, "parent_id", [F.col("pos")]).select("id", F.col("place").cast("long").alias("place"), "total")


@query("c06_first_genre", "SELECT id, list_filter(genres, lambda g: trim(g) <> '')[1] AS genre FROM books")
def _(t):
    return t.books.select("id", P.first_genre(F.col("genres")).alias("genre"))


@query("c08_same_rows", "SELECT (SELECT count(*) FROM (SELECT id, authors FROM books EXCEPT ALL SELECT id, authors FROM books WHERE pos >= 0)) = 0 AS same, (SELECT count(*) FROM (SELECT id, authors FROM books EXCEPT ALL SELECT id, authors FROM books WHERE pos > 0)) = 0 AS other")
def _(t):
    a = t.books.select("id", "authors")
    return t.spark.range(1).select(F.lit(P.same_rows(a, a.repartition(3))).alias("same"), F.lit(P.same_rows(a, a.where("pos > 0"))).alias("other"))


@query("j25_s19_label_rows", "SELECT b.id, coalesce(m.label, b.series) AS label FROM books b LEFT JOIN (SELECT ' Brand#' || n AS code, 'Серия ' || n AS label FROM (SELECT DISTINCT p_size AS n FROM part WHERE p_size < 10)) m ON m.code = b.series")
def _(t):
    names = t.raw("part").where("p_size < 10").select(F.concat(F.lit(" Brand#"), F.col("p_size").cast("string")).alias("code"), F.concat(F.lit("Серия "), F.col("p_size").cast("string")).alias("label")).distinct()
    return P.label_rows(t.books, "series", names).select("id", "label")


@query("fi28_outbound_allowed", "SELECT uid, coalesce(invited_by = 'u3', false) OR is_admin AS allowed FROM users")
def _(t):
    return P.outbound_allowed(t.users.select("uid", F.col("invited_by").alias("root_folder_id"), F.col("is_admin").alias("verified")), "u3").select("uid", "allowed")


@query("fi30_fi14_root_candidates", "SELECT id FROM folders WHERE parent_id = 'r1' AND id IN (SELECT parent_id FROM books GROUP BY parent_id HAVING count(*) >= 10)")
def _(t):
    return P.root_candidates(t.folders, t.books.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("books")), "r1").select("id")


@query("st17_register", "SELECT uid, display_name, invited_by FROM users UNION ALL SELECT uid, 'new' AS display_name, owner_uid FROM (SELECT 'u' || (c_custkey + 1000000) AS uid, 'user' || c_custkey || '@example.com' AS email FROM customer) n LEFT JOIN (SELECT invitee_email, owner_uid FROM (SELECT *, row_number() OVER (PARTITION BY invitee_email ORDER BY created_at, owner_uid) AS r FROM pending_invites WHERE active AND claimed_uid IS NULL) WHERE r = 1) i ON i.invitee_email = n.email")
def _(t):
    c = F.col("c_custkey")
    new = t.raw("customer").select(F.concat(F.lit("u"), (c + 1000000).cast("string")).alias("uid"), F.lit("new").alias("display_name"), F.concat(F.lit(" User"), c.cast("string"), F.lit("@Example.com")).alias("email"))
    return P.register(t.users, new.unionByName(new.where("uid = 'u1000001'")), S.first_inviters(t.pending_invites))


@query("st32_sendable", "SELECT pos, CASE WHEN NOT contains(invitee_email, '@') THEN 'address' WHEN lower(trim(invitee_email)) IN ('user1@example.com', 'user2@example.com') THEN 'blocked' WHEN lower(trim(invitee_email)) IN (SELECT 'user' || (c_custkey * 10) || '@example.com' FROM customer) THEN 'registered' WHEN owner_uid = 'u4' THEN 'limit' END AS stopped_by FROM invitations")
def _(t):
    blocked = t.spark.createDataFrame([("user1@example.com",), ("user2@example.com",)], "email string")
    registered = t.raw("customer").select(F.concat(F.lit("user"), (F.col("c_custkey") * 10).cast("string"), F.lit("@example.com")).alias("email"))
    full = t.spark.createDataFrame([("u4",)], "owner_uid string")
    return P.sendable(t.invitations.select("pos", "owner_uid", F.col("invitee_email").alias("email")), blocked, registered, full).select("pos", "stopped_by")


@query("se07_mutual", "SELECT a.owner_uid AS uid, a.viewer_uid AS other FROM shares_now a JOIN shares_now b ON a.owner_uid = b.viewer_uid AND a.viewer_uid = b.owner_uid WHERE a.active AND b.active AND a.owner_uid <> a.viewer_uid")
def _(t):
    return S.relations(t.shares_now).where("relation = 'mutual'").select("uid", "other")


@query("f13_labels", "SELECT p_partkey AS k, p_name AS label FROM part")
def _(t):
    return t.raw("part").select(F.col("p_partkey").alias("k"), X.label(F.concat(F.lit(" — "), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit("- "))).alias("label"))
