"""Queries over orders of names, whose names get their digits, case and accents from the key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admin as A
from ..operators import catalog as C
from ..operators import publish as P
from ..operators import social as S
from ..registry import query

# Names in the order of the language: letters before accents before case.
PEOPLE = ["абакин", "Абакин", "елкин", "Елкин", "ёлкин", "Ёлкин", "ель", "Яшин"]



def person(k):
    return F.element_at(F.array(*map(F.lit, PEOPLE)), (k % 8 + 1).cast("int"))


@query("o02_sibling_folders", "SELECT id, row_number() OVER (PARTITION BY parent_id ORDER BY CASE WHEN k % 3 = 2 THEN 0 ELSE 1 END, k % 40, id) AS place FROM (SELECT id, parent_id, CAST(substr(id, 2) AS INT) AS k FROM folders_flat)")
def _(t):
    k = F.substring("id", 2, 20).cast("int")
    name = F.concat(F.when(k % 3 == 0, "Том ").when(k % 3 == 1, "том ").otherwise("Ёж "), F.when(k % 5 == 0, "00").otherwise(""), (k % 40).cast("string"))
    return P.positions(t.folders_flat.withColumn("name", name), "parent_id", C.sibling_order()).select("id", F.col("place").cast("long").alias("place"))


@query("o05_friend_order", "SELECT uid, row_number() OVER (ORDER BY pos * 3 % 8, uid) AS place FROM suppliers")
def _(t):
    return C.placed(t.suppliers.select("uid", person(F.col("pos") * 3).alias("display_name")), S.friend_order()).select("uid", "place")


@query("o06_invitation_order", "SELECT pos, row_number() OVER (ORDER BY CASE WHEN pos % 3 = 0 THEN created_at ELSE updated_at END DESC, 'a' || pos) AS place FROM invitations WHERE updated_at > 0")
def _(t):
    sent = F.when(F.col("pos") % 3 != 0, F.col("updated_at")).when(F.col("pos") % 2 == 0, 0)
    rows = t.invitations.where("updated_at > 0").select("pos", "created_at", sent.alias("sent_at"), F.concat(F.lit("a"), F.col("pos").cast("string")).alias("invitee_email"))
    return C.placed(rows, S.invitation_order()).select("pos", "place")


@query("o07_notification_order", "SELECT viewer, k, row_number() OVER (PARTITION BY viewer ORDER BY k % 4 = 0 DESC, k % 6 DESC, k * 5 % 8, CAST(k AS VARCHAR)) AS place FROM (SELECT l_suppkey AS viewer, l_orderkey * 10 + l_linenumber AS k FROM lineitem)")
def _(t):
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = t.raw("lineitem").select(F.col("l_suppkey").alias("viewer"), k.alias("k"), (k % 4 == 0).alias("unread"), F.nullif(k % 6, F.lit(0)).alias("created_at"), person(k * 5).alias("display_name"), k.cast("string").alias("notification_key"))
    return P.positions(rows, "viewer", S.notification_order()).select("viewer", "k", F.col("place").cast("long").alias("place"))


@query("o08_users_by_role", "SELECT uid, row_number() OVER (ORDER BY k % 9 = 0 DESC, k % 4 = 0, k * 3 % 8, 'm' || (k % 2), uid) AS place FROM (SELECT uid, CAST(substr(uid, 2) AS BIGINT) AS k FROM users)")
def _(t):
    k = F.substring("uid", 2, 20).cast("long")
    rows = t.users.select("uid", (k % 9 == 0).alias("admin"), (k % 4 == 0).alias("banned"), person(k * 3).alias("display_name"), F.concat(F.lit("m"), (k % 2).cast("string")).alias("email"))
    return C.placed(rows, A.user_order("role")).select("uid", "place")


@query("o08_users_by_name", "SELECT uid, row_number() OVER (ORDER BY k * 3 % 8, k % 2, uid) AS place FROM (SELECT uid, CAST(substr(uid, 2) AS BIGINT) AS k FROM users)")
def _(t):
    k = F.substring("uid", 2, 20).cast("long")
    return C.placed(t.users.select("uid", person(k * 3).alias("display_name"), F.when(k % 2 == 0, "ель@").otherwise("Ель@").alias("email")), A.user_order("name")).select("uid", "place")


@query("o09_share_order", "SELECT id, row_number() OVER (ORDER BY a * 3 % 8, b * 5 % 8, id) AS place FROM (SELECT id, CAST(substr(owner_uid, 2) AS INT) AS a, CAST(substr(viewer_uid, 2) AS INT) AS b FROM shares_now)")
def _(t):
    k = F.substring("uid", 2, 20).cast("int")
    people = t.shares_now.select(F.col("owner_uid").alias("uid")).unionByName(t.shares_now.select(F.col("viewer_uid").alias("uid"))).distinct()
    named = A.named_pairs(t.shares_now, people.select("uid", person(k * 3).alias("display_name"), F.lit("").alias("email")), "owner_uid", "viewer_uid")
    named = named.withColumn("viewer_uid_name", person(F.substring("viewer_uid", 2, 20).cast("int") * 5))
    return C.placed(named, A.share_order()).select("id", "place")
