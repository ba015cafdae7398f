"""Admin console: counts, related profiles, flags, cards, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .catalog import placed
from .refresh import latest

PERMISSIONS = ["viewUsers", "viewInvitations", "viewShares", "manageAdmins", "banUsers", "viewEvents"]


def dashboard(users: DataFrame, shares: DataFrame, admins: DataFrame, bans: DataFrame, allowed: list[str]) -> DataFrame:
    """A-11, A-12: counts of the sections that are allowed, null for the rest; one union of single-pass aggregates."""
    parts = {"users": users, "shares": shares.where("active"), "admins": admins.where("active"), "bans": bans}
    rows = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), F.when(F.lit(name in allowed), F.col("n")).alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def active_invitations(rows: DataFrame) -> DataFrame:
    """A-13."""
    return rows.groupBy("owner_uid").agg(F.count_if(~F.col("status").isin("revoked", "shared")).alias("active"))


def user_flags(page: DataFrame, bans: DataFrame, admins: DataFrame, directory: DataFrame) -> DataFrame:
    """J-16: banned, admin and address of each user of a page."""
    b = bans.select(F.col("uid").alias("__b")).distinct()
    a = admins.where("active").select(F.col("uid").alias("__a")).distinct()
    d = directory.groupBy(F.col("uid").alias("__d")).agg(F.min("email").alias("email"))
    j = page.join(b, F.col("uid") == F.col("__b"), "left").join(a, F.col("uid") == F.col("__a"), "left").join(d, F.col("uid") == F.col("__d"), "left")
    return j.select(*page.columns, F.col("__b").isNotNull().alias("banned"), F.col("__a").isNotNull().alias("admin"), "email")


def related_uids(rows: DataFrame, columns: list[str]) -> DataFrame:
    """J-18: distinct uids in any of the columns."""
    return rows.select(F.explode(F.array(*columns)).alias("uid")).where("coalesce(uid, '') <> ''").distinct()


def related_profiles(rows: DataFrame, columns: list[str], known: DataFrame, users: DataFrame, most: int = 150) -> DataFrame:
    """J-17: profiles of related users that are not known yet, the first by uid."""
    ids = related_uids(rows, columns).join(known.select("uid"), "uid", "left_anti")
    return users.join(ids, "uid", "left_semi").orderBy("uid").limit(most)


def resolve(uids: DataFrame, users: DataFrame, profiles: DataFrame, bans: DataFrame, admins: DataFrame) -> DataFrame:
    """J-27: a name from users, else profiles, bans, admins, else the uid."""
    out, names = uids, []
    for i, df in enumerate((users, profiles, bans, admins)):
        one = df.groupBy(F.col("uid").alias(f"__u{i}")).agg(F.min(X.blank_to_null(F.col("display_name"))).alias(f"__n{i}"))
        out = out.join(one, F.col("uid") == F.col(f"__u{i}"), "left")
        names.append(F.col(f"__n{i}"))
    return out.select("uid", F.coalesce(*names, F.col("uid")).alias("display_name"))


def named_pairs(rows: DataFrame, users: DataFrame, a: str, b: str) -> DataFrame:
    """J-21, J-22: both ends' names: display name, else address, else uid."""
    one = lambda t: users.select(F.col("uid").alias(f"__{t}"), F.coalesce(X.blank_to_null(F.col("display_name")), X.blank_to_null(F.col("email"))).alias(f"{t}_name"))
    j = rows.join(one(a), F.col(a) == F.col(f"__{a}"), "left").join(one(b), F.col(b) == F.col(f"__{b}"), "left").drop(f"__{a}", f"__{b}")
    return j.withColumn(f"{a}_name", F.coalesce(f"{a}_name", a)).withColumn(f"{b}_name", F.coalesce(f"{b}_name", b))


def share_order() -> list[Column]:
    """O-09."""
    return [X.person_key(F.col("owner_uid_name")).asc(), X.person_key(F.col("viewer_uid_name")).asc(), F.col("id").asc()]


def user_order(kind: str) -> list[Column]:
    """O-08: by name and address, by registration (oldest first), or admins first, banned ones last among either, and then by name."""
    name = [X.person_key(F.col("display_name")).asc(), X.person_key(F.col("email")).asc(), F.col("uid").asc()]
    if kind == "registered":
        return [F.col("created_at").asc_nulls_first(), *name]
    if kind == "role":
        return [F.coalesce("admin", F.lit(False)).desc(), F.coalesce("banned", F.lit(False)).asc(), *name]
    return name


def filter_users(users: DataFrame, text: str) -> DataFrame:
    """FI-16."""
    t = text.strip().lower()
    return users.where(F.contains(F.lower(F.coalesce("display_name", F.lit(""))), F.lit(t)) | F.contains(F.lower(F.coalesce("email", F.lit(""))), F.lit(t)))


def user_card(uid: str, users: DataFrame, admins: DataFrame, bans: DataFrame, directory: DataFrame, shares: DataFrame, most: int = 100) -> DataFrame:
    """J-19: one user with inviter, flags, and at most ``most`` outgoing, incoming and invited ids in order."""
    u = user_flags(users.where(F.col("uid") == uid), bans, admins, directory.select("uid", "email")) if "email" not in users.columns else user_flags(users.where(F.col("uid") == uid).drop("email"), bans, admins, directory)

    def ids(df: DataFrame, key: str, other: str, name: str) -> DataFrame:
        rows = df.where(F.col(key) == uid).select(other).distinct().orderBy(other).limit(most)
        return rows.agg(F.array_sort(F.collect_list(other)).alias(name)).withColumn("__k", F.lit(uid))

    live = shares.where("active")
    out = u
    for part in (ids(live, "owner_uid", "viewer_uid", "outgoing"), ids(live, "viewer_uid", "owner_uid", "incoming"), ids(users.withColumnRenamed("uid", "other"), "invited_by", "other", "invited")):
        out = out.join(part, F.col("uid") == F.col("__k"), "left").drop("__k")
    return out


def invited_page(users: DataFrame, uid: str, after: str | None = None, size: int = 25) -> DataFrame:
    """G-07."""
    from .catalog import keyset_page

    return keyset_page(users.where(F.col("invited_by") == uid), ["uid"], None if after is None else (after,), size)


def library_access(users: DataFrame) -> DataFrame:
    """FI-23: a user may enter if the inviter is there, or as superadmin."""
    i = users.select(F.col("uid").alias("__i")).distinct()
    return users.join(i, F.col("invited_by") == F.col("__i"), "left").select("uid", (F.coalesce("is_superadmin", F.lit(False)) | F.col("__i").isNotNull()).alias("allowed"))


def gate(users: DataFrame, admins: DataFrame, bans: DataFrame, permission: str) -> DataFrame:
    """FI-22: a ban beats everything, a superadmin needs no permission."""
    b = bans.select(F.col("uid").alias("__b")).distinct()
    a = admins.where("active").select(F.col("uid").alias("__a"), "role", "permissions")
    j = users.join(b, F.col("uid") == F.col("__b"), "left").join(a, F.col("uid") == F.col("__a"), "left")
    may = (F.col("role") == "superadmin") | F.coalesce(F.try_element_at("permissions", F.lit(permission)), F.lit(False))
    return j.select("uid", (F.col("__b").isNull() & F.col("__a").isNotNull() & F.coalesce(may, F.lit(False))).alias("allowed"))


def blocked_recipients(asked: DataFrame, directory: DataFrame, bans: DataFrame) -> DataFrame:
    """FI-25: addresses banned themselves, or of a banned user."""
    a = asked.select(X.email(F.col("email")).alias("email")).distinct()
    by_mail = a.join(bans.select(X.email(F.col("email")).alias("email")), "email", "left_semi")
    by_uid = a.join(directory.select(X.email(F.col("email")).alias("email"), "uid").join(bans.select("uid"), "uid", "left_semi"), "email", "left_semi")
    return by_mail.union(by_uid).distinct()


def permission_map(c: Column) -> Column:
    """C-09, PR-10: known permissions only."""
    return F.map_filter(c, lambda k, v: k.isin(PERMISSIONS) & F.coalesce(v, F.lit(False)))


def permission_problem(c: Column) -> Column:
    """V-10."""
    return F.exists(F.map_keys(c), lambda k: ~k.isin(PERMISSIONS)) | F.exists(F.map_values(c), lambda v: v.isNull())


def template_problem(c: Column, slot: str = "{{name}}", most: int = 10_000) -> Column:
    """V-11."""
    return F.when(~F.contains(c, F.lit(slot)), "no place for the name").when(F.length(c) > most, "too long")


def project(rows: DataFrame, columns: list[str], private: list[str], may_see: bool) -> DataFrame:
    """PR-09, PR-10: listed columns; private ones null, and addresses in texts masked, without the permission."""
    out = []
    for c in columns:
        v = F.col(c)
        if not may_see and c in private:
            v = F.lit(None).cast(rows.schema[c].dataType)
        elif not may_see and rows.schema[c].dataType.simpleString() == "string":
            v = X.redact_emails(v)
        out.append(v.alias(c))
    return rows.select(*out)


def owner_colours(rows: DataFrame) -> DataFrame:
    """W-05: owners alternate by when they first appear."""
    first = rows.groupBy("owner_uid").agg(F.min("pos").alias("first_pos"))
    rank = placed(first, [F.col("first_pos"), F.col("owner_uid")]).withColumn("colour", (F.col("place") - 1) % 2)
    return rows.join(rank.select("owner_uid", "colour"), "owner_uid")


def fold_bans(events: DataFrame) -> DataFrame:
    """ST-18: who is banned after all ban and restore events, the last of a user counts."""
    last = latest(events.where("action in ('ban', 'restore')"), ["target_uid"], [F.desc("created_at"), F.desc("id")])
    return last.where("action = 'ban'").select(F.col("target_uid").alias("uid"), F.col("actor_uid").alias("banned_by"), F.col("created_at").alias("banned_at"))


def rule_violations(shares: DataFrame, users: DataFrame) -> DataFrame:
    """FI-21: rows that break the access rules: ends that are no users, sharing with oneself, ids that don't fit, revoked without a time."""
    u = users.select("uid")
    bad_owner = shares.join(u, shares.owner_uid == u.uid, "left_anti").select("id", F.lit("owner unknown").alias("problem"))
    bad_viewer = shares.join(u, shares.viewer_uid == u.uid, "left_anti").select("id", F.lit("viewer unknown").alias("problem"))
    own = shares.select("id", F.when(F.col("owner_uid") == F.col("viewer_uid"), "shared with oneself").when(F.col("id") != X.share_id(F.col("owner_uid"), F.col("viewer_uid")), "id").alias("problem")).where("problem is not null")
    return bad_owner.unionByName(bad_viewer).unionByName(own)


def merge_documents(table: DataFrame, changes: DataFrame, key: str, mask: list[str]) -> DataFrame:
    """K-08: upsert of the masked columns."""
    c = changes.select(F.col(key).alias("__k"), *[F.col(m).alias(f"__{m}") for m in mask])
    j = table.join(c, F.col(key) == F.col("__k"), "full")
    return j.select(*[F.coalesce(key, "__k").alias(key) if x == key else F.when(F.col("__k").isNotNull(), F.col(f"__{x}")).otherwise(F.col(x)).alias(x) if x in mask else F.col(x) for x in table.columns])


def multi_get(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """S-13, S-17: a row for each asked (pos, key), null where there is none; order by pos."""
    return ids.join(table, key, "left")
