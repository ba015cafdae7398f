"""Snapshots: what changed, what is carried forward, what is to be indexed, and whether a run is complete.

Absent fields of a row are null here; carry-forward copies a previous row's fields as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

# The fields that metadata extraction sets, and those that a scan sets.
METADATA_FIELDS = "metadata_status title authors series series_number annotation preview metadata_error metadata_error_message entry_path metadata_warning genres language metadata_version cover_file_id cover_mime_type inner_format metadata_warning_details".split()
SOURCE_FIELDS = "id parent_id file_name extension path size modified_time md5_checksum source_type resource_key".split()
METADATA_VERSION = 3
FINAL_OUTCOMES = ["failed", "recovered", "excluded"]


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order; order must be total for a stable choice."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def unchanged(cur: str, prev: str) -> Column:
    """FI-11: kind (fb2 unless given), time and size; checksums are not compared."""
    kind = lambda a: F.coalesce(F.col(f"{a}.source_type"), F.lit("fb2"))
    return (kind(cur) == kind(prev)) & F.col(f"{cur}.modified_time").eqNullSafe(F.col(f"{prev}.modified_time")) & F.col(f"{cur}.size").eqNullSafe(F.col(f"{prev}.size"))


def preserve_metadata(current: DataFrame, previous: DataFrame) -> DataFrame:
    """J-01: metadata of unchanged rows is carried forward; what was being processed is pending again."""
    fields = [f for f in METADATA_FIELDS if f in previous.columns]
    c, p = current.alias("c"), previous.alias("p")
    same = F.col("p.id").isNotNull() & unchanged("c", "p")
    own = [F.col(f"c.{x}") for x in current.columns if x not in fields]
    kept = []
    for f in fields:
        was = F.col(f"c.{f}") if f in current.columns else F.lit(None)
        v = F.when(same, F.col(f"p.{f}")).otherwise(was)
        kept.append((F.when(same & (v == "processing"), "pending").otherwise(v) if f == "metadata_status" else v).alias(f))
    return c.join(p, F.col("c.id") == F.col("p.id"), "left").select(*own, *kept)


def carry_journal(errors: DataFrame, books: DataFrame) -> DataFrame:
    """J-02: entries of books that are still there, with their present path."""
    e, b = errors.alias("e"), books.select(F.col("id").alias("__id"), F.col("path").alias("__path"))
    return e.join(b, F.col("file_id") == F.col("__id")).withColumn("path", F.coalesce("__path", "path")).drop("__id", "__path")


def stale_covers(current: DataFrame, previous: DataFrame) -> DataFrame:
    """J-03: covers of previous rows that are gone or changed."""
    p, c = previous.where("cover_file_id is not null and cover_file_id <> ''").alias("p"), current.alias("c")
    return p.join(c, F.col("c.id") == F.col("p.id"), "left").where(F.col("c.id").isNull() | ~unchanged("c", "p")).select("p.cover_file_id")


def unreferenced_covers(covers: DataFrame, books: DataFrame) -> DataFrame:
    """J-04, J-05, K-14: cover ids that no book has."""
    return covers.select("cover_file_id").where("cover_file_id is not null").distinct().join(books.select("cover_file_id"), "cover_file_id", "left_anti")


def overlay(base: DataFrame, journal: DataFrame, removed: DataFrame | None = None, key: str = "id", pos: str = "pos") -> DataFrame:
    """J-06, ST-04, S-12: the last journal row of a key replaces the base row; removed keys are dropped."""
    last = latest(journal, [key], [F.desc(pos)])
    out = base.join(last.select(key), key, "left_anti").unionByName(last.drop(*[c for c in last.columns if c not in base.columns]))
    return out if removed is None else out.join(removed.select(key), key, "left_anti")


def diff(current: DataFrame, previous: DataFrame, key: str = "id") -> DataFrame:
    """Rows added, removed, changed or unchanged between snapshots."""
    c, p = current.alias("c"), previous.alias("p")
    kind = F.when(F.col(f"p.{key}").isNull(), "added").when(F.col(f"c.{key}").isNull(), "removed").when(unchanged("c", "p"), "unchanged").otherwise("changed")
    return c.join(p, F.col(f"c.{key}") == F.col(f"p.{key}"), "full").select(F.coalesce(f"c.{key}", f"p.{key}").alias(key), kind.alias("change"))


def latest_outcomes(errors: DataFrame) -> DataFrame:
    """W-01: the last final outcome of each file, but for those of writing the index."""
    rows = errors.where((F.col("stage") != "index-write") & F.col("outcome").isin(FINAL_OUTCOMES))
    return latest(rows, ["file_id"], [F.desc("pos")])


def failed_books(books: DataFrame, errors: DataFrame, has_run: bool = True) -> DataFrame:
    """FI-08."""
    last = latest_outcomes(errors).select(F.col("file_id").alias("__f"), F.col("outcome").alias("__o"))
    cond = F.col("__o") == "failed"
    if not has_run:
        cond = cond | (F.col("__o").isNull() & (F.col("metadata_status") == "error"))
    return books.join(last, F.col("id") == F.col("__f"), "left").where(cond).drop("__f", "__o")


def check_retry(books: DataFrame, failed: DataFrame, asked: DataFrame) -> DataFrame:
    """FI-09, A-21: (id, problem) of asked ids that may not be retried; empty when all may."""
    n = books.groupBy("id").agg(F.count("*").alias("books"))
    a = asked.groupBy("id").agg(F.count("*").alias("times")).alias("a").join(n.alias("n"), F.col("a.id") == F.col("n.id"), "left")
    a = a.join(failed.select(F.col("id").alias("__f")).distinct(), F.col("a.id") == F.col("__f"), "left")
    problem = F.when(F.coalesce(X.trim(F.col("a.id")), F.lit("")) == "", "blank").when(X.trim(F.col("a.id")) != F.col("a.id"), "padded").when(F.col("times") > 1, "repeated").when(F.coalesce("books", F.lit(0)) != 1, "ambiguous").when(F.col("__f").isNull(), "not failed")
    return a.select(F.col("a.id").alias("id"), problem.alias("problem")).where("problem is not null")


def needs_metadata(books: DataFrame, mode: str, failed: DataFrame | None = None) -> DataFrame:
    """FI-10: the rows a run of this mode works on."""
    waiting = F.col("metadata_status").isin("pending", "processing")
    if mode == "full":
        return books
    if mode == "retry":
        return books.join(failed.select("id"), "id", "left_semi")
    if mode == "refresh":
        return books.where(waiting)
    if mode == "incremental":
        return books.where(waiting | ~F.col("metadata_version").eqNullSafe(F.lit(METADATA_VERSION)))
    raise ValueError(mode)


def prepare_build(books: DataFrame, selected: DataFrame, run_id: str, mode: str) -> tuple[DataFrame, DataFrame]:
    """ST-01, ST-27: (books with the selected ones pending, build items)."""
    s = selected.select(F.col("id").alias("__s")).distinct()
    marked = books.join(s, F.col("id") == F.col("__s"), "left")
    reset = marked.withColumn("metadata_status", F.when(F.col("__s").isNotNull(), "pending").when((F.col("metadata_status") == "processing") & F.lit(mode != "retry"), "pending").otherwise(F.col("metadata_status"))).drop("__s")
    items = marked.select(F.lit(run_id).alias("run_id"), F.col("id").alias("book_id"), F.when(F.col("__s").isNotNull(), "selected").otherwise("expected").alias("role"), F.when(F.col("__s").isNotNull(), "pending").otherwise("done").alias("state"))
    return reset, items


def progress(items: DataFrame) -> DataFrame:
    """ST-28, A-18: totals of a run."""
    n = lambda s: F.count_if(F.col("state") == s)
    done = F.count_if(F.col("state") != "pending")
    rows = items.where("role = 'selected'")
    return rows.groupBy("run_id").agg(F.count("*").alias("total"), done.alias("processed"), n("succeeded").alias("succeeded"), n("recovered").alias("recovered"), n("failed").alias("failed"), n("excluded").alias("excluded")).withColumn("remaining", F.greatest(F.lit(0), F.col("total") - F.col("processed")))


def can_resume(building: dict, active: dict, items: DataFrame, books: DataFrame) -> bool:
    """ST-02, SE-05: same base, mode and root; and the same ids on both sides."""
    if any(building.get(k) != active.get(k) for k in ("signature", "mode", "root")) or building.get("status") not in ("building", "paused"):
        return False
    return set_difference(items.where("role <> 'removed'").select(F.col("book_id").alias("id")), books.select("id")).isEmpty()


def set_difference(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """SE-05: (key, side) of ids on one side only."""
    left = a.select(key).distinct().join(b, key, "left_anti").withColumn("side", F.lit("left"))
    return left.unionByName(b.select(key).distinct().join(a, key, "left_anti").withColumn("side", F.lit("right")))


def changed_outside(candidate: DataFrame, active: DataFrame, selected: DataFrame, fields: list[str]) -> DataFrame:
    """SE-06: unselected rows that differ, compared as structures and not as text."""
    c, a = candidate.join(selected.select("id"), "id", "left_anti").alias("c"), active.alias("a")
    same = reduce(lambda x, y: x & y, [F.col(f"c.{f}").eqNullSafe(F.col(f"a.{f}")) for f in fields])
    return c.join(a, F.col("c.id") == F.col("a.id"), "left").where(F.col("a.id").isNull() | ~same).select("c.id")


def completeness(candidate: DataFrame, active: DataFrame, selected: DataFrame, expected: DataFrame, fields: list[str]) -> DataFrame:
    """V-06, J-07, ST-05: (id, problem); a run may be committed when it is empty."""
    left_over = candidate.join(selected.select("id"), "id", "left_semi").where(F.col("metadata_status").isin("pending", "processing")).select("id", F.lit("unfinished").alias("problem"))
    sides = set_difference(expected, candidate).select("id", F.when(F.col("side") == "left", "missing").otherwise("unexpected").alias("problem"))
    moved = changed_outside(candidate, active, selected, fields).select("id", F.lit("changed outside the run").alias("problem"))
    twice = candidate.groupBy("id").count().where("count > 1").select("id", F.lit("repeated").alias("problem"))
    return left_over.unionByName(sides).unionByName(moved).unionByName(twice)


def last_known_good(manifest: DataFrame, active: DataFrame) -> DataFrame:
    """J-08: manifest rows first, then active ones that are ready or pending with metadata; the first of an id wins."""
    good = active.where((F.col("metadata_status") == "ready") | ((F.col("metadata_status") == "pending") & F.col("title").isNotNull()))
    rows = manifest.withColumn("__rank", F.lit(0)).unionByName(good.withColumn("__rank", F.lit(1)), allowMissingColumns=True)
    return latest(rows, ["id"], [F.col("__rank"), F.col("pos")]).drop("__rank")


def book_outcome(parsed: Column, has_previous: Column, error: Column, warning: Column, eligible: Column) -> Column:
    """ST-07: outcome of one book from its parser's result and its past."""
    return (
        F.when(eligible == "excluded", "excluded")
        .when(error.isin("aborted", "auth", "retryable"), "interrupted")
        .when(parsed & warning.isNull(), "succeeded")
        .when(parsed, "recovered")
        .when(has_previous, "failed, previous kept")
        .otherwise("failed")
    )


def upsert_errors(journal: DataFrame, new: DataFrame) -> DataFrame:
    """ST-08: one entry a file, but for those of writing the index, which add up."""
    is_write = F.col("stage") == "index-write"
    kept = journal.where(is_write).unionByName(journal.where(~is_write).join(new.where(~is_write).select("file_id"), "file_id", "left_anti").select(*journal.columns))
    return kept.unionByName(new.where(is_write)).unionByName(latest(new.where(~is_write), ["file_id"], [F.desc("pos")]))


def index_counts(books: DataFrame, errors: DataFrame, has_run: bool = True) -> DataFrame:
    """A-05."""
    failed = failed_books(books, errors, has_run).select(F.col("id").alias("__f"))
    warned = errors.where("outcome = 'recovered'").select(F.col("file_id").alias("__w")).distinct()
    b = books.join(failed, F.col("id") == F.col("__f"), "left").join(warned, F.col("id") == F.col("__w"), "left")
    ready = (F.col("metadata_status") == "ready") & F.col("__f").isNull()
    recovered = ready & (F.col("__w").isNotNull() | F.coalesce(F.col("metadata_warning").isin("binary_corruption_recovered", "metadata_only_recovered"), F.lit(False)))
    return b.agg(F.count("*").alias("total"), F.count("__f").alias("failed"), F.count_if(recovered).alias("recovered"), F.count_if(ready & ~recovered).alias("succeeded"))


def action_labels(counts: DataFrame, total: Callable[[Column], Column] = X.grouped, failed: Callable[[Column], Column] = X.grouped) -> DataFrame:
    """PR-17. total, failed: how the two counts are written; in threes (ru-RU) unless told otherwise."""
    return counts.select(F.concat(F.lit("Переиндексировать все книги ("), total(F.col("total")), F.lit(")")).alias("full"), F.concat(F.lit("Повторить ошибки ("), failed(F.col("failed")), F.lit(")")).alias("retry"), (F.col("failed") == 0).alias("retry_hidden"))


def error_totals(errors: DataFrame) -> DataFrame:
    """A-09."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return errors.agg(n("failed").alias("failed"), n("recovered").alias("recovered"), n("excluded").alias("excluded"), n("interrupted").alias("interrupted"), F.count_if("previous_entry_preserved").alias("preserved"))


def error_codes(errors: DataFrame) -> DataFrame:
    """A-10, FI-20."""
    return errors.where("outcome = 'failed'").groupBy(F.coalesce("code", F.lit("error")).alias("code")).agg(F.count("*").alias("n"))


def export_errors(errors: DataFrame) -> DataFrame:
    """K-12, C-10, PR-14: one line an event; an entry without events is one line."""
    e = errors.select("file_id", "file_name", "stage", "outcome", F.coalesce("code", F.lit("error")).alias("code"), F.substring(F.coalesce("message", F.lit("")), 1, 1000).alias("message"), F.posexplode_outer("events").alias("i", "event"))
    parts = ["file_id", "file_name", "outcome", F.coalesce("event.stage", "stage"), F.coalesce("event.code", "code"), F.coalesce("event.message", "message")]
    return e.select("file_id", F.coalesce("i", F.lit(0)).alias("i"), F.concat_ws("\t", *parts).alias("value"))


def error_details(errors: DataFrame) -> DataFrame:
    """PR-14: an error as it is kept: pos, and what the columns that there are say, with defaults; what holds for some kinds of errors only is null for others.

    errors: pos and any of stage, status, code, name, message, reason, attempt, range, retry_result, folder_id, folder_name,
    entry_path, inner_format, metadata_indexed, previous_cover_preserved.
    """
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in errors.columns else F.lit(None).cast("string")
    status = F.nullif(F.col("status"), F.lit(0)) if "status" in errors.columns else F.lit(None).cast("int")
    code = F.coalesce(text("code"), text("name"), F.lit("error"))
    flag = lambda c: F.col(c) if c in errors.columns else F.lit(None).cast("boolean")
    only = code == "metadata_only_recovered"
    return errors.select(
        "pos", F.coalesce(text("stage"), F.when(status.isNotNull(), "download").otherwise("metadata-extraction")).alias("stage"), status.alias("status"), code.alias("code"),
        F.substring(F.coalesce(text("message"), text("reason"), F.lit("")), 1, 1000).alias("message"), F.coalesce(F.nullif(text("attempt").cast("int"), F.lit(0)), F.lit(1)).alias("attempt"), text("range").alias("range"), F.coalesce(text("retry_result"), F.lit("not-retried")).alias("retry_result"),
        text("folder_id").alias("folder_id"), F.when(text("folder_id").isNotNull(), F.coalesce(text("folder_name"), F.lit(""))).alias("folder_name"),
        F.substring(F.regexp_replace(text("entry_path"), r"[\r\n\t]", " "), 1, 240).alias("entry_path"), F.upper(text("inner_format")).alias("inner_format"),
        F.when(only, F.lit(False)).alias("full_xml_parsed"), F.when(only, F.lit(False)).alias("body_indexed"), F.when(only, F.lit(False)).alias("preview_indexed"), F.when(only, flag("metadata_indexed")).alias("metadata_indexed"),
        F.when(only, flag("previous_cover_preserved")).alias("previous_cover_preserved"),
    )


def previous_version_shown(books: DataFrame, errors: DataFrame) -> DataFrame:
    """FI-12."""
    return books.join(errors.where("previous_entry_preserved and outcome = 'failed'").select(F.col("file_id").alias("id")), "id", "left_semi")


def merge_source(previous: DataFrame, source: DataFrame) -> DataFrame:
    """PR-08: previous rows with what the scan now says, where it says something."""
    p, s = previous.alias("p"), source.alias("s")
    fields = [c for c in SOURCE_FIELDS if c in source.columns and c in previous.columns and c != "id"]
    return p.join(s, F.col("p.id") == F.col("s.id"), "left").select(*[F.coalesce(f"s.{c}", f"p.{c}").alias(c) if c in fields else F.col(f"p.{c}") for c in previous.columns])


def migrate(books: DataFrame) -> DataFrame:
    """V-02: older rows brought to the present form; ``migrated`` tells which changed."""
    ext = F.coalesce("extension", F.lower(F.nullif(F.regexp_extract("file_name", r"\.([A-Za-z0-9]+)$", 1), F.lit(""))))
    kind = F.coalesce("source_type", F.when(ext == "zip", "zip").when(ext.isin("epub", "mobi"), ext).otherwise("fb2"))
    status = F.when(F.col("metadata_status").isin("pending", "ready", "error"), F.col("metadata_status")).otherwise("pending")
    new = {"extension": ext, "source_type": kind, "metadata_status": status, "authors": F.coalesce("authors", F.array().cast("array<string>")), "entry_path": F.when(kind != "zip", F.col("entry_path"))}
    changed = reduce(lambda a, b: a | b, [~F.col(k).eqNullSafe(v) for k, v in new.items()])
    return books.select(*[new[c].alias(c) if c in new else F.col(c) for c in books.columns], changed.alias("migrated"))


def index_problems(header: DataFrame, root: str) -> DataFrame:
    """V-01."""
    problem = F.when(~F.coalesce(F.col("version").isin(1, 2, 3, 4), F.lit(False)), "version").when(F.coalesce(F.col("root_folder_id") != root, F.lit(True)), "root").when(F.col("folders").isNull() | F.col("books").isNull(), "arrays")
    return header.withColumn("problem", problem).where("problem is not null")


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Number of rows and an order-free digest of them, from one aggregation."""
    cols = [F.to_json(F.struct(*sorted(df.columns)))]
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("h")).first()
    return r.n, r.h
