"""Published catalogs, settings and small stores: what is written, when it is skipped, and how it is read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.staging import own_dir
from .catalog import placed
from .refresh import fingerprint, latest
from .tree import shared_books, shared_folders

# Fields of a published book.
PUBLISHED = "id parent_id file_name extension path size modified_time source_type title authors genres series series_number annotation preview language metadata_status".split()
# Codes of errors and what is shown for them.
NO_CODE = "Ошибка"
ERROR_LABELS = {
    "binary_file": "Не распознан как FB2/XML",
    "not_xml_html": "HTML-файл вместо FB2",
    "not_xml_rtf": "RTF-файл вместо FB2",
    "invalid_xml": "Повреждённый XML/FB2",
    "malformed_zip": "Повреждённый ZIP",
    "zip_no_supported_book": "ZIP не содержит поддерживаемую книгу",
    "zip_compressed_limit_exceeded": "ZIP превышает безопасный лимит",
}


def normalize_settings(settings: DataFrame, shareable: DataFrame) -> DataFrame:
    """V-03, C-03, C-04, K-10: notes trimmed, blank ones dropped; exclusions distinct and only of folders that can be shared, in their order. Settings are one row a library."""
    notes = F.map_filter(F.transform_values(F.coalesce("folder_notes", F.create_map().cast("map<string,string>")), lambda k, v: X.trim(v)), lambda k, v: F.coalesce(v, F.lit("")) != "")
    asked = settings.select("root_folder_id", F.explode_outer(F.array_distinct("excluded_folder_ids")).alias("__x"))
    kept = asked.join(shareable.select("id", "pos"), F.col("__x") == F.col("id")).groupBy("root_folder_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda r: r["id"]).alias("__kept"))
    return settings.join(kept, "root_folder_id", "left").select("root_folder_id", F.coalesce("__kept", F.array().cast("array<string>")).alias("excluded_folder_ids"), notes.alias("folder_notes"))


def published_rows(folders: DataFrame, books: DataFrame, root: str, excluded: list[str]) -> DataFrame:
    """PR-02, G-01: the rows of a published catalog; only the listed fields, absent ones null."""
    out = shared_books(folders, books, root, excluded)
    return out.select(*[c for c in PUBLISHED if c in out.columns])


def publish(folders: DataFrame, books: DataFrame, root: str, excluded: list[str], last: str | None) -> tuple[DataFrame | None, str]:
    """K-05, F-18: (rows, signature), or (None, signature) when nothing changed since ``last``. The signature is order-free, over all rows and folders."""
    rows = published_rows(folders, books, root, excluded)
    inside = shared_folders(folders, root, excluded).select("node", "path")
    signature = ":".join([*map(str, fingerprint(rows)), *map(str, fingerprint(inside))])
    return (None if signature == last else rows), signature


def tombstones(catalogs: DataFrame) -> DataFrame:
    """K-06: what takes the place of each owner's catalogs: one row a catalog, not published, without folders and books."""
    none = F.array().cast("array<string>")
    return catalogs.select("owner_uid", "root_folder_id").distinct().select("owner_uid", "root_folder_id", F.lit(False).alias("published"), none.alias("folders"), none.alias("books"))


def publish_all(catalogs: DataFrame, published: DataFrame) -> DataFrame:
    """K-05: what has to be written for each owner: ``create`` (nothing published yet), ``move`` (published under another root, which is
    unpublished too), ``update`` (another signature) or ``skip``. catalogs: owner_uid, root_folder_id, signature, the last of an owner by
    ``pos`` (what was asked meanwhile is not written one by one); published: owner_uid, root_folder_id, signature, published."""
    asked = latest(catalogs, ["owner_uid"], [F.desc("pos")])
    p = published.where("published").select(F.col("owner_uid").alias("__o"), F.col("root_folder_id").alias("from_root"), F.col("signature").alias("__s"))
    rows = asked.join(p, F.col("owner_uid") == F.col("__o"), "left")
    action = F.when(F.col("__o").isNull(), "create").when(F.col("from_root") != F.col("root_folder_id"), "move").when(F.col("signature") == F.col("__s"), "skip").otherwise("update")
    return rows.select("owner_uid", "root_folder_id", "signature", action.alias("action"), F.when(action == "move", F.col("from_root")).alias("unpublish_root"))


def live_catalogs(catalogs: DataFrame) -> DataFrame:
    """S-07, S-27, S-11: the newest row of each owner, if it is published."""
    return latest(catalogs, ["owner_uid"], [F.desc("updated_at"), F.col("id")]).where("published")


def registry(blobs: DataFrame, records: DataFrame) -> DataFrame:
    """S-28, ST-04: an owner's old blob of records overlaid by records of their own; rows that can't be read are skipped."""
    shape = "email string, status string, updated_at long"
    old = blobs.select("owner_uid", F.explode(F.from_json("value", "array<struct<email:string,status:string,updated_at:bigint>>")).alias("r")).select("owner_uid", "r.*", F.lit(1).alias("__rank"))
    new = records.select("owner_uid", F.from_json("value", shape).alias("r")).select("owner_uid", "r.*", F.lit(0).alias("__rank"))
    rows = new.unionByName(old).where("email is not null")
    return latest(rows, ["owner_uid", "email"], [F.col("__rank"), F.desc("updated_at"), F.col("status")]).drop("__rank")


def positions(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """A-02, W-07: place of each row within its key, and the key's total."""
    w = W.partitionBy(key)
    return rows.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count("*").over(w))


def first_genre(genres: Column) -> Column:
    """C-06: the first code that is not blank."""
    return F.get(F.filter(genres, lambda g: X.trim(g) != ""), F.lit(0))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """C-08: equality of tables by structure, whatever the order of rows."""
    return sorted(a.columns) == sorted(b.columns) and fingerprint(a) == fingerprint(b)


def error_label(code: Column) -> Column:
    """PR-15: the text of a known code, else the code, else a word for an error."""
    return F.coalesce(F.try_element_at(X.literal_map(ERROR_LABELS), F.coalesce(code, F.lit(""))), F.nullif(code, F.lit("")), F.lit(NO_CODE))


def label_rows(rows: DataFrame, code: str, names: DataFrame) -> DataFrame:
    """J-25, S-19: labels from a dictionary table, the code where there is none."""
    n = names.select(F.col("code").alias("__c"), F.col("label").alias("__l"))
    return rows.join(n, F.col(code) == F.col("__c"), "left").withColumn("label", F.coalesce("__l", code)).drop("__c", "__l")


def header(index: DataFrame, counts: DataFrame) -> DataFrame:
    """PR-16: totals of a run into the one row of an index header."""
    one = counts.select(F.struct(*counts.columns).alias("indexing_counts"), F.lit(1).alias("__k"))
    return index.withColumn("__k", F.lit(1)).join(one, "__k").drop("__k")


def outbound_allowed(rows: DataFrame, configured_root: str) -> DataFrame:
    """FI-28: trust in a direction holds for the root it was seen under, or for addresses that were verified again."""
    return rows.select("*", (F.coalesce(F.col("root_folder_id") == configured_root, F.lit(False)) | F.coalesce("verified", F.lit(False))).alias("allowed"))


def root_candidates(folders: DataFrame, counts: DataFrame, drive_root: str, minimum: int = 10) -> DataFrame:
    """FI-30, FI-14: children of the drive's root with enough books."""
    return folders.where(F.col("parent_id") == drive_root).join(counts.where(F.col("books") >= minimum), "id", "left_semi")


def register(users: DataFrame, new: DataFrame, inviters: DataFrame) -> DataFrame:
    """ST-17: new users, each with the inviter that holds the address's first invitation; known uids stay as they are."""
    i = inviters.select(F.col("invitee_email").alias("__e"), F.col("owner_uid").alias("invited_by"))
    rows = new.withColumn("__m", X.email(F.col("email"))).join(i, F.col("__m") == F.col("__e"), "left").select("uid", "display_name", "invited_by")
    one = latest(rows, ["uid"], [F.col("invited_by").asc_nulls_last(), F.col("display_name").asc_nulls_last()])
    return users.select("uid", "display_name", "invited_by").unionByName(one.join(users.select("uid"), "uid", "left_anti"))


def sendable(requests: DataFrame, blocked: DataFrame, registered: DataFrame, full_owners: DataFrame) -> DataFrame:
    """ST-32: each invitation request with what stops it, in the order of the checks: the address, a ban, an account, the owner's limit."""
    b, r, o = blocked.select(F.col("email").alias("__b")).distinct(), registered.select(F.col("email").alias("__r")).distinct(), full_owners.select(F.col("owner_uid").alias("__o")).distinct()
    q = requests.withColumn("email", X.email(F.col("email")))
    q = q.join(b, F.col("email") == F.col("__b"), "left").join(r, F.col("email") == F.col("__r"), "left").join(o, F.col("owner_uid") == F.col("__o"), "left")
    stop = F.when(~X.valid_email(F.col("email")), "address").when(F.col("__b").isNotNull(), "blocked").when(F.col("__r").isNotNull(), "registered").when(F.col("__o").isNotNull(), "limit")
    return q.withColumn("stopped_by", stop).drop("__b", "__r", "__o")


def numbered_batches(items: DataFrame, batch: int) -> DataFrame:
    """ST-03: pending items with the number of their batch, from 0, in the order of book_id."""
    return placed(items.where("state = 'pending'"), [F.col("book_id")]).withColumn("batch", F.floor((F.col("place") - 1) / batch).cast("long")).drop("place")


def run_batches(items: Callable[[], DataFrame], parse, batch: int, save) -> int:
    """ST-03: pending items in batches, each parsed and saved to the journal before the next; an interrupted run, called again, goes on
    with what is pending then. ``items()`` reads the present state. Batches are numbered once and written by number, so that a batch
    reads its own files. Saving must come between two batches, so it is a loop; take ``batch`` as large as what may be lost.
    Returns the number of batches."""
    spark = items().sparkSession
    at = f"{own_dir(spark)}/batches-{uuid.uuid4().hex}"
    numbered_batches(items(), batch).write.partitionBy("batch").parquet(at)
    waiting = spark.read.parquet(at) if not items().where("state = 'pending'").isEmpty() else None
    n = 0 if waiting is None else waiting.agg(F.max("batch")).first()[0] + 1
    for i in range(n):
        save(parse(waiting.where(F.col("batch") == i)))
    return n


#: Documents nest so deep at most.
MOST_NESTED = 20


def document_value(c: Column, depth: int = MOST_NESTED) -> Column:
    """PR-11: a typed document value, as JSON text, to a plain one, as JSON text: null, arrays and maps at any depth up to ``depth`` (deeper
    is an error), integers as such whatever their length. What has no known kind is null; text that is no JSON gives null. Apply it to a
    column, not to ``typed_document``'s expression: the analyzer follows a limited number of nested functions at a time."""
    return _once(F.try_parse_json(c), lambda v: F.when(v.isNotNull(), _plain(v, depth)))


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), where c is evaluated once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _wrapped(opening: str | Column, text: Column, closing: str | Column) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in (opening, text, closing)])


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("k"))), r"(?s)^\{\"k\":(.*)\}$", 1)


def _plain(v: Column, depth: int) -> Column:
    if depth < 0:
        return F.raise_error(F.lit(f"a document nests deeper than {MOST_NESTED}")).cast("string")
    get = lambda k, t: F.try_variant_get(v, f"$.{k}", t)
    # one list of (name, value) for maps and arrays alike, so that each level is written once
    entry = "array<struct<key:string,value:variant>>"
    fields = F.map_entries(get("mapValue.fields", "map<string,variant>"))
    values = F.transform(get("arrayValue.values", "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    inner = F.coalesce(fields.cast(entry), values.cast(entry), F.array().cast(entry))
    some = F.transform(inner, lambda e: F.concat(F.when(e["key"].isNull(), "").otherwise(F.concat(_quoted(e["key"]), F.lit(":"))), _plain(e["value"], depth - 1)))
    has = lambda k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    out = F.when(has("stringValue"), _quoted(get("stringValue", "string"))).when(has("integerValue"), get("integerValue", "string"))
    out = out.when(has("doubleValue"), F.to_json(get("doubleValue", "variant"))).when(has("booleanValue"), get("booleanValue", "string"))
    out = out.when(has("timestampValue"), _quoted(get("timestampValue", "string"))).when(has("nullValue"), "null")
    # the inner level is named once only, or the expression would double with each level
    is_map = has("mapValue")
    both = _wrapped(F.when(is_map, "{").otherwise("["), F.array_join(some, ","), F.when(is_map, "}").otherwise("]"))
    return out.when(is_map | has("arrayValue"), both).otherwise("null")


def typed_document(c: Column, depth: int = MOST_NESTED) -> Column:
    """PR-11, the other way: a plain value as JSON text to a typed one. A whole number is an integerValue, a text of digits, however it was written; any other number a doubleValue."""
    return _once(F.try_parse_json(c), lambda v: F.when(v.isNotNull(), _typed(v, depth)))


def _typed(v: Column, depth: int) -> Column:
    if depth < 0:
        return F.raise_error(F.lit(f"a document nests deeper than {MOST_NESTED}")).cast("string")
    kind = F.schema_of_variant(v)
    entry = "array<struct<key:string,value:variant>>"
    is_map, is_list = F.startswith(kind, F.lit("OBJECT")), F.startswith(kind, F.lit("ARRAY"))
    fields = F.when(is_map, F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")).cast(entry))
    values = F.when(is_list, F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value"))).cast(entry))
    inner = F.coalesce(fields, values, F.array().cast(entry))
    some = F.transform(inner, lambda e: F.concat(F.when(e["key"].isNull(), "").otherwise(F.concat(_quoted(e["key"]), F.lit(":"))), _typed(e["value"], depth - 1)))
    number = F.try_variant_get(v, "$", "double")
    whole = F.when(kind == "BIGINT", F.try_variant_get(v, "$", "string")).when(number % 1 == 0, F.try_variant_get(v, "$", "decimal(38,0)").cast("string"))
    out = F.when(kind == "STRING", _wrapped('{"stringValue":', F.to_json(v), "}")).when(kind == "BOOLEAN", _wrapped('{"booleanValue":', F.to_json(v), "}"))
    both = _wrapped(F.when(is_map, '{"mapValue":{"fields":{').otherwise('{"arrayValue":{"values":['), F.array_join(some, ","), F.when(is_map, "}}}").otherwise("]}}"))
    out = out.when(is_map | is_list, both).when(kind == "VOID", '{"nullValue":null}').when(whole.isNotNull(), _wrapped('{"integerValue":"', whole, '"}'))
    return out.when(number.isNotNull(), _wrapped('{"doubleValue":', F.to_json(v), "}")).otherwise('{"nullValue":null}')
