"""Search, direct filters, facets, cards, orders and pages over catalog rows."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.staging import stage


def _texts(c: Column) -> Column:
    return F.transform(F.coalesce(c, F.array().cast("array<string>")), X.normalize)


def _some_has(fields: Column, part: str) -> Column:
    return F.exists(fields, lambda f: F.contains(f, F.lit(part)))


def search(books: DataFrame, query: str = "", title: str = "", author: str = "", series: str = "", genre: str = "", language: str = "") -> DataFrame:
    """FI-01, FI-02: every word of query in some field, and all given conditions; blank ones hold. Input order is kept by pos."""
    one = X.normalized
    fields = F.concat(F.array(*[X.normalize(F.col(c)) for c in ("title", "series", "annotation", "file_name")]), _texts(F.col("authors")))
    out = books
    for w in filter(None, one(query).split(" ")):
        out = out.where(_some_has(fields, w))
    if one(title):
        out = out.where(F.contains(X.normalize(F.col("title")), F.lit(one(title))))
    if one(author):
        out = out.where(F.exists(_texts(F.col("authors")), lambda a: F.contains(a, F.lit(one(author)))))
    if one(series):
        out = out.where(F.contains(X.normalize(F.col("series")), F.lit(one(series))))
    if genre:
        out = out.where(F.array_contains("genres", genre))
    if one(language):
        out = out.where(X.language_key(F.col("language")) == X.language_key(F.lit(language)))
    return out


def direct_filter(books: DataFrame, kind: str, value: str) -> DataFrame:
    """FI-03, FI-04, FI-05; order with ``series_order`` where it matters."""
    v = value.strip()
    if kind == "series" and v:
        return books.where(X.trim(F.col("series")) == v)
    if kind == "genre":
        return books.where(F.array_contains("genres", value))
    if kind == "author":
        return books.where(F.exists("authors", lambda a: X.trim(a) == v))
    return books.where(F.lit(False))


def catalog_order() -> list[Column]:
    """O-01."""
    return [X.natural_key(F.col("file_name")).asc(), F.col("pos").asc()]


def sibling_order() -> list[Column]:
    """O-02: folders of one parent, numbers in their names by value."""
    return [X.natural_key(F.col("name")).asc(), F.col("id").asc()]


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place in one order over all rows; the order must be total.

    Rows are dealt by ranges of the order; a range is numbered in its own task, after the rows of the
    ranges before it, of which only the numbers meet in one place."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "placed")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    rows = dealt.join(F.broadcast(before), "__part")
    place = F.row_number().over(W.partitionBy("__part").orderBy(*order)) + F.col("__before")
    return rows.withColumn(name, place.cast("long")).drop("__part", "__before")


def series_order() -> list[Column]:
    """O-03."""
    return [X.number(F.col("series_number")).asc_nulls_last(), *catalog_order()]


def genre_facets(books: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """A-07: distinct codes, blanks dropped, with labels."""
    codes = books.select(F.explode("genres").alias("value")).where(X.trim(F.col("value")) != "").distinct()
    label = F.coalesce(F.try_element_at(X.literal_map(names), F.col("value")), F.col("value")) if names else F.col("value")
    return codes.withColumn("label", label)


def language_facets(books: DataFrame) -> DataFrame:
    """A-07: one row for each language key, with its least value and name."""
    whole = X.language_tag(F.col("language"))
    key = X.language_key(F.col("language"))
    known = F.startswith(key, F.lit("language:"))
    rows = books.select(key.alias("key"), F.when(known, X.language_base(F.col("language"))).otherwise(whole).alias("value"))
    got = rows.where("key <> ''").groupBy("key").agg(F.min("value").alias("value"))
    return got.select("key", "value", F.regexp_replace("key", "^(language|code):", "").alias("label"))


def facet_order() -> list[Column]:
    """O-04."""
    return [F.collate(F.col("label"), "ru").asc(), F.col("value").asc()]


def card_view(books: DataFrame, names: dict[str, str]) -> DataFrame:
    """PR-03."""
    ready = F.col("metadata_status") == "ready"
    fallback = X.title_fallback(F.col("file_name"))
    has_genre = F.exists(F.col("genres"), lambda g: X.trim(g) != "")
    return books.select(
        "id",
        F.when(ready & (F.size("authors") > 0), F.array_join("authors", ", ")).otherwise(X.NO_AUTHOR).alias("author"),
        F.when(ready, F.coalesce(X.blank_to_null(F.col("title")), fallback)).otherwise(fallback).alias("title"),
        F.when(ready & has_genre, F.array_join(X.genre_labels(F.col("genres"), names), ", ")).otherwise(X.NO_GENRE).alias("genre_line"),
        F.when(ready, F.coalesce(X.blank_to_null(F.col("annotation")), X.blank_to_null(F.col("preview")), F.lit(""))).otherwise(X.NO_ANNOTATION).alias("annotation"),
    )


def clamp_page(total: int, number: float | int | str | None = 1, size: int | float | None = 50, default: int = 50) -> tuple[int, int, int]:
    """O-10: (page, pages, size) with bad sizes the default, fractions cut, pages clamped."""
    size = size if isinstance(size, int) and not isinstance(size, bool) and size > 0 else default
    pages = -(-total // size)
    try:
        n = float(number)
        n = int(n) if n == n and abs(n) != float("inf") else 1
    except (TypeError, ValueError):
        n = 1
    return (min(max(1, n), pages) if pages else 1), pages, size


def page(df: DataFrame, order: list[Column], number=1, size=50) -> tuple[DataFrame, dict]:
    """O-10, O-15, O-16: one page of an order, and its totals. The count and the page are two jobs; neither brings rows to the driver."""
    total = df.count()
    n, pages, size = clamp_page(total, number, size)
    rows = df.orderBy(*order).offset((n - 1) * size).limit(size)
    return rows, {"total_items": total, "total_pages": pages, "current_page": n, "page_size": size}


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None = None, size: int = 25) -> DataFrame:
    """O-12, O-13: up to size + 1 rows after the key; the one too many says that there is more. Sizes are clamped to 1..100."""
    size = max(1, min(100, int(size)))
    if after is not None:
        df = df.where(F.struct(*[F.col(k) for k in keys]) > F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, after)]))
    return df.orderBy(*keys).limit(size + 1)


def encode_cursor(collection: str, *key) -> str:
    return base64.urlsafe_b64encode(json.dumps({"c": collection, "k": list(key)}, ensure_ascii=False).encode()).decode()


def decode_cursor(cursor: str, collection: str, n: int) -> tuple:
    """V-09: of this collection, with n parts; else ValueError."""
    try:
        got = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    except ValueError as e:
        raise ValueError("cursor can't be read") from e
    if not isinstance(got, dict) or got.get("c") != collection or not isinstance(got.get("k"), list) or len(got["k"]) != n:
        raise ValueError("cursor of another collection")
    return tuple(got["k"])


def listed(df: DataFrame, **conditions) -> DataFrame:
    """S-01, S-04, S-15 to S-18, S-30, FI-18: rows that equal every given value, or one of a list of them; all conditions reach the scan."""
    for c, v in conditions.items():
        df = df.where(F.col(c).isin(*v) if isinstance(v, (list, tuple)) else F.col(c) == v)
    return df


def first_page(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """S-15, S-16: the first n rows of an order, by a top-n in each task."""
    return df.orderBy(*order).limit(n)


def prefix_search(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """FI-17: a range predicate, which reaches the scan; case matters; 1 to 80 characters."""
    p = prefix.strip()
    if not 1 <= len(p) <= 80:
        raise ValueError("1 to 80 characters")
    return df.where((F.col(col) >= p) & (F.col(col) <= p + "\uf8ff"))


def top(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """O-14: the first n of each key."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")
