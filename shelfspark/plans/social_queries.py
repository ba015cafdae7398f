"""Queries over shares, friends, invitations, notifications and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import limits as L
from ..operators import social as S
from ..registry import query

MAIL = "lower(trim(invitee_email))"
LEDGER = f"(SELECT * FROM (SELECT owner_uid, {MAIL} AS invitee_email, CASE WHEN status IN ('pending', 'sent', 'accepted', 'revoked', 'shared') THEN status ELSE 'pending' END AS status, updated_at, created_at, accepted_uid, pos, row_number() OVER (PARTITION BY owner_uid, {MAIL} ORDER BY updated_at DESC, pos DESC) AS r FROM invitations WHERE contains({MAIL}, '@')) WHERE r = 1)"


@query("se04_other_side", "SELECT viewer_uid AS other, false AS inbound, true AS outbound FROM shares_now WHERE active AND owner_uid = 'u7' AND viewer_uid <> 'u7' UNION ALL SELECT owner_uid, true, false FROM shares_now WHERE active AND viewer_uid = 'u7' AND owner_uid <> 'u7'")
def _(t):
    return S.other_side(t.shares_now, "u7").select("other", "inbound", "outbound")


@query(
    "a06_j10_j11_friends",
    """WITH o AS (SELECT viewer_uid AS other, false AS i, true AS o, CAST(NULL AS VARCHAR) AS mail, id FROM shares_now WHERE active AND owner_uid = 'u7' AND viewer_uid <> 'u7' UNION ALL SELECT owner_uid, true, false, owner_email, id FROM shares_now WHERE active AND viewer_uid = 'u7' AND owner_uid <> 'u7')
    SELECT other AS uid, max(display_name) AS display_name, max(is_admin) AS is_admin, CASE WHEN max(is_admin) THEN '' ELSE coalesce(max(CASE WHEN CAST(substr(other, 2) AS INT) % 2 = 0 THEN email END), min(mail), '') END AS email, bool_or(i) AS inbound, bool_or(o) AS outbound FROM o JOIN users u ON u.uid = other GROUP BY other""",
)
def _(t):
    contacts = t.users.where("cast(substr(uid, 2) as int) % 2 = 0").select("uid", "email")
    return S.friends(t.shares_now, t.users, contacts, "u7")


@query(
    "j09_j12_merge_accepted",
    """WITH k AS (SELECT uid, display_name, CASE WHEN pos % 3 = 0 THEN NULL ELSE 'user' || pos || '@example.com' END AS email, pos FROM suppliers), a AS (SELECT invitee_email AS mail, uid, can FROM (SELECT 'user' || CAST(c_custkey AS VARCHAR) || '@example.com' AS invitee_email, 'u' || CAST(c_custkey + CASE WHEN c_custkey % 4 = 1 THEN 100000 ELSE 0 END AS VARCHAR) AS uid, c_custkey % 2 = 0 AS can FROM customer)),
    m AS (SELECT a.*, coalesce(k.uid, k2.uid) AS to_uid FROM a LEFT JOIN k ON k.uid = a.uid LEFT JOIN k k2 ON k2.email = a.mail)
    SELECT k.uid, k.display_name, CASE WHEN m.to_uid IS NOT NULL AND k.email IS NULL THEN m.mail ELSE k.email END AS email, false AS inbound, coalesce(m.can, false) AS outbound FROM k LEFT JOIN m ON m.to_uid = k.uid
    UNION ALL SELECT uid, mail, mail, false, can FROM m WHERE to_uid IS NULL""",
)
def _(t):
    known = t.suppliers.select("uid", "display_name", F.when(F.col("pos") % 3 != 0, F.concat(F.lit("user"), F.col("pos").cast("string"), F.lit("@example.com"))).alias("email"), F.lit(False).alias("inbound"), F.lit(False).alias("outbound"))
    c = F.col("c_custkey")
    accepted = t.raw("customer").select(F.concat(F.lit("u"), (c + F.when(c % 4 == 1, 100000).otherwise(0)).cast("string")).alias("uid"), F.concat(F.lit(" User"), c.cast("string"), F.lit("@Example.com")).alias("email"), F.lit(None).cast("string").alias("display_name"), (c % 2 == 0).alias("can_share"))
    return S.merge_accepted(known, accepted)


@query("w02_v04_ledger", f"SELECT invitee_email, status, updated_at, pos FROM {LEDGER} WHERE owner_uid = 'u3'")
def _(t):
    return S.ledger(t.invitations, "u3").select("invitee_email", "status", "updated_at", "pos")


@query("fi27_accepted_friends", f"SELECT accepted_uid AS uid, invitee_email AS email, invitee_email AS display_name FROM {LEDGER} WHERE owner_uid = 'u3' AND status = 'accepted' AND accepted_uid IS NOT NULL")
def _(t):
    return S.accepted_friends(S.ledger(t.invitations, "u3"))


@query("j13_fi19_pending", f"SELECT invitee_email, status FROM {LEDGER} WHERE owner_uid = 'u3' AND status NOT IN ('accepted', 'revoked') AND invitee_email NOT IN (SELECT invitee_email FROM {LEDGER} WHERE owner_uid = 'u4' AND status = 'accepted')")
def _(t):
    done = S.accepted_friends(S.ledger(t.invitations, "u4"))
    return S.pending_rows(S.ledger(t.invitations, "u3"), done).select("invitee_email", "status")


@query("w03_o06_merge_invitations", f"SELECT invitee_email, status, pos FROM (SELECT *, row_number() OVER (PARTITION BY invitee_email ORDER BY rank, pos) AS q FROM (SELECT invitee_email, status, pos, 0 AS rank FROM {LEDGER} WHERE owner_uid = 'u5' UNION ALL SELECT invitee_email, status, pos, 1 FROM {LEDGER} WHERE owner_uid = 'u6')) WHERE q = 1")
def _(t):
    none = t.users.where("false").select("email")
    return S.merge_invitations(S.ledger(t.invitations, "u5"), S.ledger(t.invitations, "u6"), none).select("invitee_email", "status", "pos")


@query("a16_first_inviters", "SELECT invitee_email, owner_uid, created_at FROM (SELECT *, row_number() OVER (PARTITION BY invitee_email ORDER BY created_at, owner_uid) AS r FROM pending_invites WHERE active AND claimed_uid IS NULL) WHERE r = 1")
def _(t):
    return S.first_inviters(t.pending_invites)


@query("a17_finalize", "SELECT invitee_email, owner_uid, CASE WHEN row_number() OVER (PARTITION BY invitee_email ORDER BY created_at, owner_uid) = 1 THEN 'accepted' ELSE 'shared' END AS status FROM pending_invites WHERE claimed_uid IS NOT NULL")
def _(t):
    return S.finalize_registrations(t.pending_invites)


@query("a08_g08_j20_relations", "WITH e AS (SELECT DISTINCT owner_uid AS a, viewer_uid AS b FROM shares_now WHERE active AND owner_uid <> viewer_uid) SELECT a AS uid, b AS other, CASE WHEN (b, a) IN (SELECT (a, b) FROM e) THEN 'mutual' ELSE 'outgoing' END AS relation FROM e UNION ALL SELECT b, a, 'incoming' FROM e WHERE (b, a) NOT IN (SELECT (a, b) FROM e)")
def _(t):
    return S.relations(t.shares_now)


@query("a23_invited_counts", "SELECT invited_by, count(*) AS invited, min(uid) AS first FROM users WHERE invited_by IS NOT NULL GROUP BY invited_by")
def _(t):
    return S.invited_counts(t.users)


@query(
    "j14_invitation_statuses",
    f"SELECT a.email, coalesce(g.status, r.status) AS status, u.uid, u.display_name FROM (SELECT DISTINCT {MAIL} AS email FROM invitations WHERE contains({MAIL}, '@')) a LEFT JOIN (SELECT 'user' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email, 'sent' AS status FROM customer WHERE c_custkey % 5 = 0) r USING (email) LEFT JOIN (SELECT 'user' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email, 'accepted' AS status FROM customer WHERE c_custkey % 7 = 0) g USING (email) LEFT JOIN (SELECT 'user' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email, 'u' || CAST(c_custkey AS VARCHAR) AS uid, c_name AS display_name FROM customer WHERE c_custkey % 3 = 0) u USING (email) WHERE (r.status IS NOT NULL OR g.status IS NOT NULL OR u.uid IS NOT NULL) AND a.email <> 'user15@example.com'",
)
def _(t):
    c = F.col("c_custkey")
    base = t.raw("customer").select(F.concat(F.lit("user"), c.cast("string"), F.lit("@example.com")).alias("email"), F.concat(F.lit("u"), c.cast("string")).alias("uid"), F.col("c_name").alias("display_name"), c.alias("k"))
    return S.invitation_statuses(t.invitations.select(F.col("invitee_email").alias("email")), base.where("k % 5 = 0").withColumn("status", F.lit("sent")), base.where("k % 7 = 0").withColumn("status", F.lit("accepted")), base.where("k % 3 = 0"), base, "user15@example.com")


def _events(t):
    key = F.concat("owner_uid", F.lit("|"), "viewer_uid")
    inbound = t.shares_now.where("active").select(F.col("viewer_uid").alias("viewer"), key.alias("notification_key"), F.col("owner_uid").alias("display_name"), F.lit(5).alias("created_at"))
    events = t.shares_now.where("cast(substr(owner_uid, 2) as int) % 3 = 0").select(F.col("viewer_uid").alias("viewer"), key.alias("notification_key"), F.col("owner_uid").alias("display_name"), F.lit(1).alias("created_at"), (F.length("id") % 2 == 0).alias("unread"))
    return inbound, events


KEYED = "SELECT viewer_uid AS viewer, owner_uid || '|' || viewer_uid AS notification_key, owner_uid AS display_name, active, id, CAST(substr(owner_uid, 2) AS INT) AS n FROM shares_now"


@query("se08_st09_sync_notifications", f"SELECT viewer, notification_key, created_at, unread FROM (SELECT *, row_number() OVER (PARTITION BY viewer ORDER BY created_at DESC, notification_key) AS r FROM (SELECT viewer, notification_key, 1 AS created_at, length(id) % 2 = 0 AS unread FROM ({KEYED}) WHERE n % 3 = 0 AND active UNION ALL SELECT viewer, notification_key, 5, true FROM ({KEYED}) WHERE active AND n % 3 <> 0)) WHERE r <= 20")
def _(t):
    inbound, events = _events(t)
    return S.sync_notifications(events, inbound, events, 20).select("viewer", "notification_key", "created_at", "unread")


@query("j23_visible_notifications", f"SELECT viewer, notification_key, display_name, length(id) % 2 = 0 AS unread FROM ({KEYED}) WHERE n % 3 = 0 AND active")
def _(t):
    inbound, events = _events(t)
    return S.visible_notifications(events, inbound).select("viewer", "notification_key", "display_name", "unread")


@query("st10_mark_seen", f"SELECT notification_key, length(id) % 2 = 0 AND NOT viewer = 'u3' AS unread FROM ({KEYED}) WHERE n % 3 = 0")
def _(t):
    _, events = _events(t)
    return S.mark_seen(events, events.where("viewer = 'u3'")).select("notification_key", "unread")


@query("a14_unread_badge", f"SELECT viewer, count(*) FILTER (length(id) % 2 = 0) AS unread, CASE WHEN count(*) FILTER (length(id) % 2 = 0) > 99 THEN '99+' WHEN count(*) FILTER (length(id) % 2 = 0) > 0 THEN CAST(count(*) FILTER (length(id) % 2 = 0) AS VARCHAR) ELSE '' END AS badge FROM ({KEYED}) WHERE n % 3 = 0 GROUP BY viewer")
def _(t):
    return S.unread_badge(_events(t)[1])


@query("st16_st18_share_changes", "SELECT id, owner_uid, viewer_uid, arg_max(active, pos) AS active FROM shares GROUP BY id, owner_uid, viewer_uid")
def _(t):
    start = t.shares_now.where("cast(substr(owner_uid, 2) as int) % 2 = 0").select("id", "owner_uid", "viewer_uid", "active", F.lit(None).cast("long").alias("shared_at"), F.lit(None).cast("long").alias("revoked_at"))
    return S.apply_share_changes(start, t.shares).select("id", "owner_uid", "viewer_uid", "active")


@query("st22_st25_invitation_changes", f"SELECT owner_uid, invitee_email, CASE WHEN status = 'pending' AND pos % 2 = 0 THEN 'revoked' ELSE status END AS status, status = 'accepted' AND pos % 2 = 0 AS rejected FROM {LEDGER}")
def _(t):
    from ..operators.refresh import latest

    rows = t.invitations.withColumn("invitee_email", X.email(F.col("invitee_email"))).where(X.valid_email(F.col("invitee_email")))
    rows = latest(rows.withColumn("status", F.when(F.col("status").isin(S.STATUSES), F.col("status")).otherwise("pending")), ["owner_uid", "invitee_email"], [F.desc("updated_at"), F.desc("pos")])
    changes = rows.where("pos % 2 = 0").select("owner_uid", "invitee_email", F.lit("revoked").alias("status"), "pos")
    return S.apply_invitation_changes(rows, changes).select("owner_uid", "invitee_email", "status", "rejected")


@query("st24_st26_st31_insert_absent", "SELECT uid, display_name FROM users UNION ALL SELECT uid, display_name FROM (SELECT 'u' || (s_suppkey + 100) AS uid, min(s_name) AS display_name FROM supplier GROUP BY 1) WHERE uid NOT IN (SELECT uid FROM users)")
def _(t):
    new = t.raw("supplier").select(F.concat(F.lit("u"), (F.col("s_suppkey") + 100).cast("string")).alias("uid"), F.col("s_name").alias("display_name"))
    return S.insert_absent(t.users.select("uid", "display_name"), new, "uid")


@query("st31_fill_emails", "SELECT s.id, CASE WHEN active THEN coalesce(owner_email, u.email) ELSE owner_email END AS owner_email FROM shares_now s LEFT JOIN users u ON u.uid = s.owner_uid")
def _(t):
    return S.fill_share_emails(t.shares_now, t.users.select("uid", "email")).select("id", "owner_email")


@query("a24_access_states", "SELECT owner_uid AS folder_id, viewer_uid || '@example.com' AS email, CASE WHEN min(r) = 0 THEN 'owner' WHEN min(r) = 1 THEN 'reader' ELSE 'writer' END AS role, bool_or(i) AS inherited, true AS granted FROM (SELECT *, CASE pos % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE CASE WHEN pos % 7 = 0 THEN 0 ELSE 2 END END AS r, pos % 2 = 0 AS i FROM shares WHERE pos % 11 <> 0) GROUP BY 1, 2")
def _(t):
    p = F.col("pos")
    role = F.when(p % 3 == 0, "reader").when(p % 3 == 1, "writer").otherwise(F.when(p % 7 == 0, "owner").otherwise("writer"))
    rows = t.shares.select(F.col("owner_uid").alias("folder_id"), F.concat(F.upper("viewer_uid"), F.lit("@Example.com ")).alias("email"), role.alias("role"), (p % 11 == 0).alias("deleted"), F.array(F.struct((p % 2 == 0).alias("inherited"))).alias("details"))
    return S.access_states(rows)


@query("st21_access_plan", "SELECT folder_id, email, 'grant' AS step FROM (SELECT DISTINCT owner_uid AS folder_id, viewer_uid AS email FROM shares_now WHERE active EXCEPT SELECT owner_uid, viewer_uid FROM shares_now WHERE owner_email IS NOT NULL) UNION ALL SELECT folder_id, email, 'revoke' FROM (SELECT owner_uid AS folder_id, viewer_uid AS email FROM shares_now WHERE owner_email IS NOT NULL EXCEPT SELECT owner_uid, viewer_uid FROM shares_now WHERE active)")
def _(t):
    two = lambda d: d.select(F.col("owner_uid").alias("folder_id"), F.col("viewer_uid").alias("email"))
    return S.folder_access_plan(two(t.shares_now.where("active")), two(t.shares_now.where("owner_email is not null")))


@query("j26_s07_discovered", "WITH c AS (SELECT * FROM (SELECT 'u' || CAST(l_suppkey % 40 AS VARCHAR) AS uid, l_linenumber % 2 = 0 AS published, l_orderkey % 90 AS root, row_number() OVER (PARTITION BY l_suppkey % 40 ORDER BY l_discount > 0.05 DESC, l_linenumber % 2 = 0 DESC, l_shipdate DESC, l_orderkey * 10 + l_linenumber) AS r FROM lineitem WHERE l_suppkey % 40 <> 3) WHERE r = 1), g AS (SELECT 'u' || CAST(s_suppkey AS VARCHAR) AS uid, s_acctbal > 0 AS outbound FROM supplier WHERE s_suppkey % 2 = 0) SELECT coalesce(c.uid, g.uid) AS uid, CASE WHEN c.uid IS NULL THEN NULL WHEN NOT published THEN false WHEN root < 50 THEN root % 2 = 0 END AS inbound, outbound FROM c FULL JOIN g ON c.uid = g.uid")
def _(t):
    li = t.raw("lineitem")
    catalogs = li.select(F.concat(F.lit("u"), (F.col("l_suppkey") % 40).cast("string")).alias("owner_uid"), (F.col("l_discount") > 0.05).alias("marked"), (F.col("l_linenumber") % 2 == 0).alias("published"), F.col("l_shipdate").alias("modified_time"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") % 90).alias("root_folder_id"))
    roots = t.spark.range(50).select(F.col("id").alias("root_folder_id"), (F.col("id") % 2 == 0).alias("readable"))
    granted = t.suppliers.where("pos % 2 = 0").select("uid", (F.col("balance") > 0).alias("granted"))
    return S.discovered_friends(catalogs, roots, granted, "u3")


@query("a22_summary", f"SELECT (SELECT count(*) FROM suppliers) AS friends, (SELECT bool_or(balance > 0) FROM suppliers) AS any_outbound, (SELECT count(DISTINCT invitee_email) FROM {LEDGER} WHERE owner_uid = 'u3' AND status = 'pending' AND invitee_email NOT IN (SELECT 'user' || pos || '@example.com' FROM suppliers)) AS pending, 13 AS remaining")
def _(t):
    f = t.suppliers.select((F.col("balance") > 0).alias("outbound"), F.concat(F.lit("user"), F.col("pos").cast("string"), F.lit("@example.com")).alias("email"))
    return S.summary(f, S.ledger(t.invitations, "u3").where("status = 'pending'"), 7)


@query("w06_window_counts", "SELECT uid, pos, count(*) OVER (PARTITION BY uid ORDER BY t RANGE BETWEEN 599 PRECEDING AND CURRENT ROW) AS short, count(*) OVER (PARTITION BY uid ORDER BY t RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS day FROM (SELECT uid, pos, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t FROM lookups)")
def _(t):
    return L.window_counts(t.lookups.select("uid", F.unix_seconds(F.date_trunc("second", "ts")).alias("t"), "pos")).select("uid", "pos", "short", "day")


@query("st11_st14_lookup_budget")
def _(t):
    """All-or-nothing budgets feed back on themselves, which SQL can't fold; checked by tests against a plain loop."""
    one = t.lookups.select("uid", (F.unix_seconds(F.col("ts").cast("timestamp")) / 20).cast("long").alias("t"), "pos", F.array(F.col("address"), F.concat(F.lit("b"), F.col("address"))).alias("addresses"))
    return L.lookup_budget(one)


@query("st12_send_reservations")
def _(t):
    """Leases and cooldowns; checked by tests against a plain loop."""
    op = F.when(F.col("pos") % 3 == 0, "reserve").when(F.col("pos") % 3 == 1, "sent").otherwise("failed")
    return L.send_reservations(t.lookups.select("uid", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "pos", op.alias("op")))


@query("st13_over_limit", f"SELECT owner_uid, count(DISTINCT invitee_email) AS n FROM {LEDGER} WHERE status <> 'revoked' AND owner_uid NOT IN (SELECT uid FROM admins WHERE active) GROUP BY owner_uid HAVING count(DISTINCT invitee_email) >= 10")
def _(t):
    rows = t.invitations.withColumn("invitee_email", X.email(F.col("invitee_email"))).where(X.valid_email(F.col("invitee_email")))
    return L.over_limit(rows, t.admins, 10)


@query("f06_emails", f"SELECT pos, {MAIL} AS email, contains({MAIL}, '@') AS valid FROM invitations")
def _(t):
    e = X.email(F.col("invitee_email"))
    return t.invitations.select("pos", e.alias("email"), X.valid_email(e).alias("valid"))


@query("v07_share_email_error", f"SELECT pos, CASE WHEN NOT contains({MAIL}, '@') THEN 'invalid' WHEN {MAIL} = 'user5@example.com' THEN 'self' END AS problem FROM invitations")
def _(t):
    return t.invitations.select("pos", X.share_email_error(F.col("invitee_email"), F.lit("USER5@example.com ")).alias("problem"))


@query("f07_email_names", "SELECT uid, lower(trim(display_name)) = split_part(email, '@', 1) AS same FROM users")
def _(t):
    return t.users.select("uid", X.is_email_name(F.col("display_name"), F.col("email")).alias("same"))


@query("f26_share_ids", "SELECT DISTINCT id, owner_uid || '__' || viewer_uid AS made FROM shares")
def _(t):
    return t.shares.select("id", X.share_id(F.col("owner_uid"), F.col("viewer_uid")).alias("made")).distinct()


@query("f30_identity", "SELECT uid, CASE WHEN CAST(substr(uid, 2) AS INT) % 2 = 0 THEN display_name ELSE email END AS shown FROM users")
def _(t):
    return t.users.select("uid", X.identity(F.when(F.expr("cast(substr(uid, 2) as int) % 2 = 0"), F.col("display_name")).otherwise(" "), F.col("email")).alias("shown"))
