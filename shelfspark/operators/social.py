"""Shares, friends, invitations and notifications. Directions that are not verified stay null, never false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .refresh import latest

STATUSES = ["pending", "sent", "accepted", "revoked", "shared"]


def other_side(shares: DataFrame, uid: str) -> DataFrame:
    """SE-04: active shares of a user, both ways, with the other's id."""
    s = shares.where("active")
    out = s.where(F.col("owner_uid") == uid).select(F.col("viewer_uid").alias("other"), F.lit(False).alias("inbound"), F.lit(True).alias("outbound"), F.lit(None).cast("string").alias("email"), "id")
    return out.unionByName(s.where(F.col("viewer_uid") == uid).select(F.col("owner_uid").alias("other"), F.lit(True).alias("inbound"), F.lit(False).alias("outbound"), F.col("owner_email").alias("email"), "id")).where(F.col("other") != uid)


def friends(shares: DataFrame, profiles: DataFrame, contacts: DataFrame, uid: str) -> DataFrame:
    """A-06, J-10, J-11: one row for each other user with a profile; an admin's address is not shown."""
    flags = other_side(shares, uid).groupBy("other").agg(F.bool_or("inbound").alias("inbound"), F.bool_or("outbound").alias("outbound"), F.min(F.when(X.trim(F.col("email")) != "", F.struct("id", "email"))).alias("__e"))
    p = profiles.select(F.col("uid").alias("__u"), "display_name", F.coalesce("is_admin", F.lit(False)).alias("is_admin"))
    c = contacts.select(F.col("uid").alias("__c"), F.col("email").alias("__contact"))
    rows = flags.join(p, F.col("other") == F.col("__u")).join(c, F.col("other") == F.col("__c"), "left")
    mail = F.when(F.col("is_admin"), "").otherwise(F.coalesce(X.blank_to_null(F.col("__contact")), F.col("__e.email"), F.lit("")))
    return rows.select(F.col("other").alias("uid"), F.coalesce("display_name", F.lit("Пользователь")).alias("display_name"), "is_admin", mail.alias("email"), "inbound", "outbound")


def friend_order() -> list[Column]:
    """O-05."""
    return [X.person_key(F.col("display_name")).asc(), F.col("uid").asc()]


def merge_accepted(known: DataFrame, accepted: DataFrame) -> DataFrame:
    """J-09, J-12, J-15: accepted invitations into friends, matched on uid, else on address; a friend is only ever made outbound. New ones are appended with inbound false."""
    a = accepted.where("uid is not null and uid <> ''").withColumn("__mail", X.email(F.col("email"))).where("__mail <> ''")
    k = known.withColumn("__mail", X.email(F.col("email")))
    by_uid = a.join(k.select("uid").distinct(), "uid", "left_semi").withColumn("__to", F.col("uid"))
    rest = a.join(k.select("uid").distinct(), "uid", "left_anti")
    one = latest(k.where("__mail <> ''").select("__mail", F.col("uid").alias("__to")), ["__mail"], [F.col("__to")])
    by_mail = rest.join(one, "__mail")
    new = rest.join(one, "__mail", "left_anti")
    hit = by_uid.select("__to", "__mail", "display_name", "can_share").unionByName(by_mail.select("__to", "__mail", "display_name", "can_share"))
    hit = hit.groupBy("__to").agg(F.bool_or("can_share").alias("__out"), F.min("__mail").alias("__m"), F.min(X.blank_to_null(F.col("display_name"))).alias("__n"))
    no_mail = F.col("email").isNull() | (F.col("email") == "") | F.startswith(F.col("email"), F.lit("email:"))
    mail = F.when(F.col("__m").isNotNull() & no_mail, F.col("__m")).otherwise(F.col("email"))
    no_name = F.col("display_name").isNull() | (F.col("display_name") == "") | (F.col("display_name") == mail)
    merged = known.join(hit, F.col("uid") == F.col("__to"), "left").select("uid", F.when(F.col("__n").isNotNull() & no_name, F.col("__n")).otherwise(F.col("display_name")).alias("display_name"), mail.alias("email"), "inbound", F.when(F.coalesce("__out", F.lit(False)), F.lit(True)).otherwise(F.col("outbound")).alias("outbound"))
    added = new.groupBy("uid").agg(F.min("__mail").alias("email"), F.min(X.blank_to_null(F.col("display_name"))).alias("n"), F.bool_or("can_share").alias("outbound"))
    return merged.unionByName(added.select("uid", F.coalesce("n", "email").alias("display_name"), "email", F.lit(False).alias("inbound"), "outbound"))


def overlay_verified(rows: DataFrame, verified: DataFrame) -> DataFrame:
    """J-12, ST-19: verified directions win where they are known; rows with no relation go."""
    v = verified.select(F.col("uid").alias("__u"), F.col("inbound").alias("__i"), F.col("outbound").alias("__o"))
    out = rows.join(v, F.col("uid") == F.col("__u"), "left").withColumn("inbound", F.coalesce("__i", "inbound")).withColumn("outbound", F.coalesce("__o", "outbound"))
    return out.drop("__u", "__i", "__o").where("coalesce(inbound, true) or coalesce(outbound, true)")


def reset_verified(verified: DataFrame, root: str) -> DataFrame:
    """ST-19: what was verified while another root was shared says nothing of outbound any more: unknown, not false."""
    return verified.withColumn("outbound", F.when(F.col("root_folder_id").eqNullSafe(F.lit(root)), F.col("outbound")))


def ledger(records: DataFrame, owner: str) -> DataFrame:
    """V-04, W-02: an owner's records, one an address, the newest, later of equal ones; bad addresses go, unknown statuses are pending."""
    r = records.where(F.col("owner_uid") == owner).withColumn("invitee_email", X.email(F.col("invitee_email"))).where(X.valid_email(F.col("invitee_email")))
    r = r.withColumn("status", F.when(F.col("status").isin(STATUSES), F.col("status")).otherwise("pending"))
    return latest(r, ["invitee_email"], [F.desc_nulls_last("updated_at"), F.desc("pos")])


def accepted_friends(rows: DataFrame) -> DataFrame:
    """FI-27."""
    return rows.where("status = 'accepted' and coalesce(accepted_uid, '') <> ''").select(F.col("accepted_uid").alias("uid"), F.col("invitee_email").alias("email"), F.coalesce(X.blank_to_null(F.col("accepted_display_name")), "invitee_email").alias("display_name"))


def pending_rows(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """J-13, FI-19, SE-09: open invitations to addresses that have not accepted."""
    done = accepted.select(X.email(F.col("email")).alias("invitee_email"))
    return rows.where(~F.col("status").isin("accepted", "revoked")).join(done, "invitee_email", "left_anti")


def merge_invitations(live: DataFrame, old: DataFrame, accepted: DataFrame) -> DataFrame:
    """W-03: live rows beat ledger rows of an address; accepted ones go. Order by ``invitation_order``."""
    rows = live.withColumn("__rank", F.lit(0)).unionByName(old.withColumn("__rank", F.lit(1)), allowMissingColumns=True)
    rows = rows.withColumn("invitee_email", X.email(F.col("invitee_email"))).where("invitee_email <> ''")
    return latest(rows, ["invitee_email"], [F.col("__rank"), F.col("pos")]).drop("__rank").join(accepted.select(X.email(F.col("email")).alias("invitee_email")), "invitee_email", "left_anti")


def invitation_order() -> list[Column]:
    """O-06: the last sent first, by creation where nothing was sent."""
    return [F.coalesce(F.nullif(F.col("sent_at"), F.lit(0)), F.col("created_at"), F.lit(0)).desc(), F.col("invitee_email").asc()]


def invitation_statuses(asked: DataFrame, reservations: DataFrame, registry: DataFrame, directory: DataFrame, users: DataFrame, own: str) -> DataFrame:
    """J-14, S-29: what is known of each asked address; none about oneself, rows without a hit go."""
    a = asked.select(X.email(F.col("email")).alias("email")).where(X.valid_email(F.col("email"))).where(F.col("email") != own).distinct()
    a = a.join(reservations.select("email", F.col("status").alias("reserved")), "email", "left").join(registry.select("email", F.col("status").alias("registered")), "email", "left")
    a = a.join(directory.select("email", "uid"), "email", "left").join(users.select("uid", "display_name"), "uid", "left")
    return a.where("reserved is not null or registered is not null or uid is not null").select("email", F.coalesce("registered", "reserved").alias("status"), "uid", "display_name")


def first_inviters(pending: DataFrame) -> DataFrame:
    """A-16, ST-23: of active, unclaimed invitations of an address the earliest, then least owner."""
    rows = pending.where("active and claimed_uid is null")
    return latest(rows, ["invitee_email"], [F.col("created_at").asc_nulls_last(), F.col("owner_uid")]).select("invitee_email", "owner_uid", "created_at")


def finalize_registrations(pending: DataFrame) -> DataFrame:
    """A-17: of claimed invitations of an address the earliest is accepted, the others shared."""
    rows = pending.where("claimed_uid is not null")
    rn = F.row_number().over(W.partitionBy("invitee_email").orderBy(F.col("created_at").asc_nulls_last(), "owner_uid"))
    return rows.select("invitee_email", "owner_uid", F.when(rn == 1, "accepted").otherwise("shared").alias("status"))


def relations(shares: DataFrame) -> DataFrame:
    """A-08, G-08, J-20, SE-07: (uid, other, relation) for every pair with an active share, seen from both; no sets are gathered."""
    e = shares.where("active and owner_uid <> viewer_uid").select("owner_uid", "viewer_uid").distinct()
    both = e.select(F.col("owner_uid").alias("uid"), F.col("viewer_uid").alias("other"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(e.select(F.col("viewer_uid").alias("uid"), F.col("owner_uid").alias("other"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    g = both.groupBy("uid", "other").agg(F.max("out").alias("out"), F.max("into").alias("into"))
    return g.select("uid", "other", F.when((F.col("out") == 1) & (F.col("into") == 1), "mutual").when(F.col("out") == 1, "outgoing").otherwise("incoming").alias("relation"))


def invited_counts(users: DataFrame) -> DataFrame:
    """A-23, as counts and the least id; lists are made for one inviter at a time."""
    return users.where("invited_by is not null").groupBy("invited_by").agg(F.count("*").alias("invited"), F.min("uid").alias("first"))


def new_notifications(inbound: DataFrame, known: DataFrame) -> DataFrame:
    """SE-08, ST-09: events for keys that were not known."""
    return inbound.join(known.select("notification_key"), "notification_key", "left_anti").withColumn("unread", F.lit(True))


def sync_notifications(events: DataFrame, inbound: DataFrame, known: DataFrame, most: int = 1000) -> DataFrame:
    """ST-09, O-14: events of keys still inbound, and new ones; the last ``most`` of a viewer."""
    kept = events.join(inbound.select("notification_key"), "notification_key", "left_semi")
    rows = kept.unionByName(new_notifications(inbound, known).select(*events.columns))
    r = F.row_number().over(W.partitionBy("viewer").orderBy(F.desc("created_at"), "notification_key"))
    return rows.withColumn("__r", r).where(F.col("__r") <= most).drop("__r")


def visible_notifications(events: DataFrame, inbound: DataFrame) -> DataFrame:
    """J-23, O-07: events of present inbound friends, with their present names."""
    now = inbound.select("notification_key", F.col("display_name").alias("__n"))
    return events.join(now, "notification_key").withColumn("display_name", F.coalesce("__n", "display_name")).drop("__n")


def notification_order() -> list[Column]:
    """O-07: unread ones first, then the newest, then by name."""
    return [F.desc("unread"), F.coalesce("created_at", F.lit(0)).desc(), X.person_key(F.col("display_name")).asc(), F.col("notification_key").asc()]


def mark_seen(events: DataFrame, seen: DataFrame) -> DataFrame:
    """ST-10."""
    s = seen.select(F.col("notification_key").alias("__k")).distinct()
    return events.join(s, F.col("notification_key") == F.col("__k"), "left").withColumn("unread", F.col("unread") & F.col("__k").isNull()).drop("__k")


def unread_badge(events: DataFrame) -> DataFrame:
    """A-14."""
    return events.groupBy("viewer").agg(F.count_if("unread").alias("unread")).withColumn("badge", X.badge(F.col("unread")))


def apply_share_changes(shares: DataFrame, changes: DataFrame) -> DataFrame:
    """ST-16, ST-18, ST-30: the last change of a share wins; setting what is set changes nothing; revoked_at is set on revoking only."""
    last = latest(changes, ["id"], [F.desc("at"), F.desc("pos")]).select(F.col("id").alias("__id"), F.col("owner_uid").alias("__o"), F.col("viewer_uid").alias("__v"), F.col("active").alias("__a"), F.col("at").alias("__at"))
    j = shares.join(last, F.col("id") == F.col("__id"), "full")
    turned = F.col("__a").isNotNull() & ~F.col("active").eqNullSafe(F.col("__a"))
    return j.select(
        F.coalesce("id", "__id").alias("id"), F.coalesce("owner_uid", "__o").alias("owner_uid"), F.coalesce("viewer_uid", "__v").alias("viewer_uid"), F.coalesce("__a", "active").alias("active"),
        F.when(turned & F.col("__a"), F.col("__at")).otherwise(F.col("shared_at")).alias("shared_at"),
        F.when(turned & ~F.col("__a") & F.col("id").isNotNull(), F.col("__at")).when(turned & F.col("__a"), F.lit(None)).otherwise(F.col("revoked_at")).alias("revoked_at"),
    )


def apply_invitation_changes(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """ST-22, ST-25, K-09: pending to revoked or accepted; revoked again is the same; accepted ones stay. ``rejected`` tells a change that was not allowed."""
    c = latest(changes, ["owner_uid", "invitee_email"], [F.desc("pos")]).select("owner_uid", "invitee_email", F.col("status").alias("__s"))
    j = rows.join(c, ["owner_uid", "invitee_email"], "left")
    may = F.col("__s").isNull() | (F.col("status") == "pending") | (F.col("status") == F.col("__s")) | (F.col("status") == "sent")
    return j.withColumn("rejected", ~may).withColumn("status", F.when(may, F.coalesce("__s", "status")).otherwise(F.col("status"))).drop("__s")


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """ST-24, ST-26, ST-31: rows whose key is not there yet, one a key: the least by all columns in their order."""
    one = latest(rows, [key], [F.col(c).asc_nulls_last() for c in table.columns])
    return table.unionByName(one.join(table.select(key), key, "left_anti").select(*table.columns))


def fill_share_emails(shares: DataFrame, directory: DataFrame) -> DataFrame:
    """ST-31."""
    d = directory.groupBy(F.col("uid").alias("__u")).agg(F.min("email").alias("__e"))
    filled = F.when(F.col("active"), F.coalesce(X.blank_to_null(F.col("owner_email")), "__e")).otherwise(F.col("owner_email"))
    return shares.join(d, F.col("owner_uid") == F.col("__u"), "left").withColumn("owner_email", filled).drop("__u", "__e")


def access_states(permissions: DataFrame) -> DataFrame:
    """A-24: per folder and address the strongest role (owner, reader, then others by name), whether any detail is inherited, and that there is a grant."""
    p = permissions.where("not coalesce(deleted, false)").withColumn("email", X.email(F.col("email"))).where("email <> ''")
    rank = F.when(F.col("role") == "owner", 0).when(F.col("role") == "reader", 1).otherwise(2)
    inherited = F.exists(F.coalesce("details", F.array().cast("array<struct<inherited:boolean>>")), lambda d: F.coalesce(d["inherited"], F.lit(False)))
    g = p.groupBy("folder_id", "email").agg(F.min(F.struct(rank.alias("r"), "role")).alias("s"), F.bool_or(inherited).alias("inherited"))
    return g.select("folder_id", "email", F.col("s.role").alias("role"), "inherited", F.lit(True).alias("granted"))


def folder_access_plan(wanted: DataFrame, actual: DataFrame) -> DataFrame:
    """ST-21: grants to add and to take away, as rows; the side effects are the caller's."""
    k = ["folder_id", "email"]
    return wanted.select(k).distinct().join(actual, k, "left_anti").withColumn("step", F.lit("grant")).unionByName(actual.select(k).distinct().join(wanted, k, "left_anti").withColumn("step", F.lit("revoke")))


def access_steps(folders: DataFrame, settings: DataFrame, states: DataFrame) -> DataFrame:
    """ST-21, the plan: one row for each folder right below a library's root, in the order of pos: previous, desired, and what forbids the change.

    folders: library, id, name, pos; settings: library, excluded_folder_ids; states: id, is_folder, inherited_off, can_turn_off, can_turn_on (null: not known, so it may be tried).
    """
    asked = settings.select("library", F.explode("excluded_folder_ids").alias("id")).distinct().withColumn("__off", F.lit(True))
    rows = folders.join(asked, ["library", "id"], "left").join(states, "id", "left")
    desired, previous = F.coalesce("__off", F.lit(False)), F.coalesce("inherited_off", F.lit(False))
    may = F.coalesce(F.when(desired, F.col("can_turn_off")).otherwise(F.col("can_turn_on")), F.lit(True))
    problem = F.when(F.col("is_folder").isNull(), "not found").when(~F.col("is_folder"), "not a folder").when((previous != desired) & ~may, "not allowed")
    return rows.select("library", "pos", "id", "name", previous.alias("previous"), desired.alias("desired"), problem.alias("problem"))


def access_outcomes(steps: DataFrame, answers: DataFrame) -> DataFrame:
    """ST-21, the outcome: steps with status applied, unchanged, failed or not reached. Steps of a library go in order and end with its first failure. answers: id, ok, error (of the calls that were made)."""
    a = answers.select(F.col("id").alias("__id"), "ok", "error")
    rows = steps.join(a, F.col("id") == F.col("__id"), "left").drop("__id")
    differs = F.col("previous") != F.col("desired")
    fails = F.col("problem").isNotNull() | (differs & ~F.coalesce("ok", F.lit(False)))
    before = F.coalesce(F.bool_or(fails).over(W.partitionBy("library").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    status = F.when(before, "not reached").when(fails, "failed").when(differs, "applied").otherwise("unchanged")
    why = F.when(~before & fails, F.coalesce("problem", "error", F.lit("no answer")))
    return rows.select("library", "pos", "id", "name", "previous", "desired", status.alias("status"), why.alias("error"))


def access_compensation(outcomes: DataFrame) -> DataFrame:
    """ST-21, the way back: for each library with a failure what was applied, the last first, set to what it was; the failure stays the error to show, whatever comes of these steps."""
    failed = outcomes.where("status = 'failed'").select("library", F.col("error").alias("because"))
    applied = outcomes.where("status = 'applied'").join(failed, "library")
    place = F.row_number().over(W.partitionBy("library").orderBy(F.desc("pos")))
    return applied.select("library", place.alias("place"), "id", F.col("previous").alias("set_to"), "because")


def discovered_friends(catalogs: DataFrame, roots: DataFrame, granted: DataFrame, me: str) -> DataFrame:
    """J-26, S-07, PR-13: inbound from live catalogs whose root folder is seen, outbound from grants on the own root; null where the side was not looked at."""
    c = latest(catalogs.where(F.col("owner_uid") != me), ["owner_uid"], [F.desc("marked"), F.desc("published"), F.desc("modified_time"), F.col("id")])
    seen = roots.select(F.col("root_folder_id").alias("__r"), F.col("readable"))
    i = c.join(seen, F.col("root_folder_id") == F.col("__r"), "left").select(F.col("owner_uid").alias("uid"), F.when(~F.col("published"), F.lit(False)).otherwise(F.col("readable")).alias("inbound"))
    return i.join(granted.select("uid", F.col("granted").alias("outbound")), "uid", "full")


def inbound_friends(friends_: DataFrame) -> DataFrame:
    """FI-29: friends whose library is seen, with a uid of their own (not one made of an address)."""
    return friends_.where("coalesce(inbound, false) and coalesce(uid, '') <> '' and not startswith(uid, 'email:')")


def library_tabs(own: DataFrame, friends_: DataFrame) -> DataFrame:
    """PR-13: (owner, place, uid, display_name): an owner's own library first, then those of inbound friends in their order. own: owner, display_name; friends: owner, uid, display_name, inbound, pos."""
    mine = own.select("owner", F.col("owner").alias("uid"), "display_name", F.lit(0).alias("__mine"), F.lit(None).cast("long").alias("pos"))
    theirs = inbound_friends(friends_).where("uid <> owner").select("owner", "uid", "display_name", F.lit(1).alias("__mine"), F.col("pos").cast("long").alias("pos"))
    place = F.row_number().over(W.partitionBy("owner").orderBy("__mine", "pos", "uid"))
    return mine.unionByName(theirs).select("owner", place.alias("place"), "uid", "display_name")


# The texts of a friend that are kept, and how much of each.
CACHED = {"display_name": 160, "email": 254, "catalog_id": 256, "root_folder_id": 256}


def friend_cache(rows: DataFrame, most: int = 500) -> DataFrame:
    """PR-12: what is kept for the next start of each owner: the first ``most`` inbound friends in their order (pos), texts cut, absent ones empty, flags true only where they are known to be."""
    first = F.row_number().over(W.partitionBy("owner").orderBy("pos", "uid"))
    kept = rows.where("coalesce(inbound, false) and uid is not null").withColumn("__r", first).where(F.col("__r") <= most)
    texts = [F.substring(F.coalesce(c, F.lit("")), 1, n).alias(c) for c, n in CACHED.items()]
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("inbound", "outbound", "is_admin")]
    return kept.select("owner", "pos", "uid", *texts, *flags)


def read_friend_cache(stored: DataFrame) -> DataFrame:
    """V-08: (owner, value as JSON text) -> (owner, pos, uid, ...) of the entries that have their shape: uid and display name are texts, inbound is true, outbound a boolean. A value that is no list has no rows."""
    entries = stored.select("owner", F.posexplode(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")).alias("pos", "v"))
    kind = lambda f: F.schema_of_variant(F.try_variant_get("v", f"$.{f}", "variant"))
    text = lambda f: F.try_variant_get("v", f"$.{f}", "string")
    flag = lambda f: F.coalesce(F.when(kind(f) == "BOOLEAN", F.try_variant_get("v", f"$.{f}", "boolean")), F.lit(False))
    ok = (kind("uid") == "STRING") & (kind("display_name") == "STRING") & flag("inbound") & (kind("outbound") == "BOOLEAN")
    return entries.where(ok).select("owner", "pos", text("uid").alias("uid"), *[text(c).alias(c) for c in CACHED], flag("inbound").alias("inbound"), flag("outbound").alias("outbound"), flag("is_admin").alias("is_admin"))


def summary(friends_: DataFrame, pending: DataFrame, used: int, limit: int = 20) -> DataFrame:
    """A-22, FI-15, ST-13."""
    open_ = pending.select(X.email(F.col("invitee_email")).alias("email")).join(friends_.select(X.email(F.col("email")).alias("email")), "email", "left_anti")
    rows = friends_.select(F.lit(1).alias("friend"), "outbound", F.lit(None).cast("string").alias("email")).unionByName(open_.select(F.lit(0).alias("friend"), F.lit(None).cast("boolean").alias("outbound"), "email"))
    return rows.agg(F.coalesce(F.sum("friend"), F.lit(0)).alias("friends"), F.bool_or("outbound").alias("any_outbound"), F.count_distinct("email").alias("pending"), F.lit(max(0, limit - used)).alias("remaining"))


def sync_statuses(statuses: DataFrame, drive_friends: DataFrame, accepted: DataFrame, owner: str, now: int) -> dict[str, DataFrame]:
    """ST-29: what the server says of invitations, brought into friends, invitations and the ledger.

    statuses: email, status, created_at, sent_at, registered, registered_uid, registered_name, accepted, accepted_uid,
    accepted_name, accepted_at, one row an address. friends and accepted: uid, email, display_name, root_folder_id, inbound,
    outbound; of drive friends also pos. A registered account comes before an acceptance; it is a friend in the directions
    that the drive or the former row shows, an acceptance in both.

    Returns accepted (the former rows overlaid), pending (invitation rows) and ledger (status changes)."""
    s = statuses.withColumn("email", X.email(F.col("email"))).where("email <> '' and email <> '__quota'")
    is_registered = F.coalesce("registered", F.lit(False)) & (F.coalesce("registered_uid", F.lit("")) != "")
    is_accepted = F.coalesce("accepted", F.lit(False)) & (F.coalesce("accepted_uid", F.lit("")) != "")
    s = s.withColumn("kind", F.when(is_registered, "registered").when(is_accepted, "accepted")).withColumn("found", F.when(is_registered, F.col("registered_uid")).when(is_accepted, F.col("accepted_uid")))
    d = drive_friends.select("pos", F.col("uid").alias("d_uid"), X.email(F.col("email")).alias("d_email"), F.struct("display_name", "root_folder_id", "inbound", "outbound").alias("d"))
    got = s.where("kind is not null")
    by_email = got.select("email").join(d, F.col("email") == F.col("d_email")).select("email", "pos", "d")
    by_uid = got.select("email", "found").join(d, F.col("found") == F.col("d_uid")).select("email", "pos", "d")
    first = by_email.unionByName(by_uid).groupBy("email").agg(F.min_by("d", "pos").alias("d"))
    old = latest(accepted.withColumn("email", X.email(F.col("email"))), ["email"], [F.col("uid")])
    p = old.select("email", F.struct("root_folder_id", "inbound", "outbound").alias("p"))
    rows = got.join(first, "email", "left").join(p, "email", "left")
    reg = F.col("kind") == "registered"
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    either = lambda f: F.coalesce(F.col(f"d.{f}"), F.lit(False)) | F.coalesce(F.col(f"p.{f}"), F.lit(False)) | ~reg
    new = rows.select(
        F.col("found").alias("uid"), "email", F.coalesce(F.when(reg, text("registered_name")).otherwise(text("accepted_name")), text("d.display_name"), "email").alias("display_name"),
        F.coalesce(text("d.root_folder_id"), F.when(reg, text("p.root_folder_id")), F.lit("")).alias("root_folder_id"), either("inbound").alias("inbound"), either("outbound").alias("outbound"),
    )
    kept = old.select(*new.columns).join(new.select("email"), "email", "left_anti").select(*new.columns)
    time = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(other)).cast("long")
    pending = s.where("status = 'pending'").select(F.col("email").alias("invitee_email"), F.lit(owner).alias("owner_uid"), F.lit(True).alias("active"), time("created_at", now).alias("created_at"), time("sent_at", 0).alias("sent_at"))
    ledger = new.join(s.select("email", "kind", "accepted_at"), "email").where("kind = 'accepted'").select("email", F.lit("accepted").alias("status"), F.col("uid").alias("accepted_uid"), F.col("display_name").alias("accepted_display_name"), time("accepted_at", now).alias("accepted_at"))
    return {"accepted": kept.unionByName(new), "pending": pending.join(new.select(F.col("email").alias("invitee_email")), "invitee_email", "left_anti"), "ledger": ledger}
