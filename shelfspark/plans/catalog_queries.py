"""Queries over books, folders and drive items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog as C
from ..operators import tree as T
from ..operators.publish import normalize_settings, positions
from ..operators.store import zip_candidates, zip_totals
from ..registry import query

NAMES = {"ECONOMY": "Эконом", "SMALL": "Малый", "LARGE": "Большой", "brand_1": "Первый"}
NAMES_SQL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " ELSE {0} END"
NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '\\s+', ' ', 'g'))"
TAG = f"replace({NORM.format('language')}, '_', '-')"
# Tags of the test tables by language, and its name.
LANGUAGES = {"ru": ("русский", ("ru", "rus")), "en": ("английский", ("en", "en-us", "eng")), "de": ("немецкий", ("ger",)), "ja": ("японский", ("ja", "ja-jp")), "pt": ("португальский", ("pt", "pt-br")), "zh": ("китайский", ("zh", "zh-cn")), "tyv": ("тувинский", ("tyv",))}
BASE = "CASE " + " ".join(f"WHEN {TAG} IN ({', '.join(map(repr, tags))}) THEN '{code}'" for code, (_, tags) in LANGUAGES.items()) + f" ELSE {TAG} END"
LANG = f"CASE WHEN {TAG} = '' THEN '' " + " ".join(f"WHEN {TAG} IN ({', '.join(map(repr, tags))}) THEN 'language:{name}'" for name, tags in LANGUAGES.values()) + f" ELSE 'code:' || {TAG} END"
HAS = "(contains({t}, '{w}') OR contains({s}, '{w}') OR contains({a}, '{w}') OR contains({f}, '{w}') OR len(list_filter(authors, lambda x: contains({x}, '{w}'))) > 0)"


def _has(w: str) -> str:
    return HAS.format(t=NORM.format("title"), s=NORM.format("series"), a=NORM.format("annotation"), f=NORM.format("file_name"), x=NORM.format("x"), w=w)


NUM = "TRY_CAST(CASE WHEN regexp_full_match(trim(series_number), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN trim(series_number) END AS DOUBLE)"
FALLBACK = "trim(regexp_replace(file_name, '\\.(fb2|zip|epub|mobi)$', '', 'i'))"


@query("fi01_search", f"SELECT id, title, file_name FROM books WHERE {_has('red')} AND {_has('economy')}")
def _(t):
    return C.search(t.books, " RED  economy ").select("id", "title", "file_name")


@query("fi02_field_filters", f"SELECT id FROM books WHERE contains({NORM.format('title')}, 'bolt') AND len(list_filter(authors, lambda x: contains({NORM.format('x')}, 'brand#1'))) > 0 AND contains({NORM.format('series')}, 'brand') AND list_contains(genres, 'ECONOMY') AND {LANG} = 'language:английский'")
def _(t):
    return C.search(t.books, title="Bolt", author="BRAND#1", series="brand", genre="ECONOMY", language="en").select("id")


@query("fi01_o10_search_page", f"SELECT id, title, pos, total_items FROM (SELECT id, title, pos, count(*) OVER () AS total_items, row_number() OVER (ORDER BY pos) AS r FROM books WHERE {_has('ring')}) WHERE r > 50 * (least(2, ceil(total_items / 50.0)) - 1) AND r <= 50 * least(2, ceil(total_items / 50.0))")
def _(t):
    rows, totals = C.page(C.search(t.books, "ring"), [F.col("pos")], 2, 50)
    return rows.select("id", "title", "pos", F.lit(totals["total_items"]).cast("long").alias("total_items"))


@query("fi03_direct_series", f"SELECT id, series, {NUM} AS number, row_number() OVER (ORDER BY {NUM} NULLS LAST, pos) AS place FROM books WHERE trim(series) = 'Brand#7'")
def _(t):
    from pyspark.sql import Window as W

    n = X.number(F.col("series_number"))
    rows = C.direct_filter(t.books, "series", " Brand#7 ")
    return rows.select("id", "series", n.alias("number"), F.row_number().over(W.partitionBy(X.trim(F.col("series"))).orderBy(n.asc_nulls_last(), "pos")).cast("long").alias("place"))


@query("fi04_direct_genre", "SELECT id, pos FROM books WHERE list_contains(genres, 'brand#3')")
def _(t):
    return C.direct_filter(t.books, "genre", "brand#3").select("id", "pos")


@query("fi05_direct_author", "SELECT id, pos FROM books WHERE len(list_filter(authors, lambda x: trim(x) = 'Brand#3')) > 0")
def _(t):
    return C.direct_filter(t.books, "author", " Brand#3").select("id", "pos")


@query("o01_natural_order", "SELECT id, row_number() OVER (ORDER BY split_part(lower(file_name), ' ', 1), split_part(lower(file_name), ' ', 2), CAST(regexp_extract(file_name, '([0-9]+)\\.', 1) AS BIGINT), pos) AS place FROM books")
def _(t):
    return C.placed(t.books, C.catalog_order()).select("id", "place")


@query("o03_series_order", f"SELECT id, trim(series) AS series_name, row_number() OVER (PARTITION BY trim(series) ORDER BY {NUM} NULLS LAST, split_part(lower(file_name), ' ', 1), split_part(lower(file_name), ' ', 2), CAST(regexp_extract(file_name, '([0-9]+)\\.', 1) AS BIGINT), pos) AS place FROM books WHERE coalesce(trim(series), '') <> ''")
def _(t):
    rows = t.books.withColumn("series_name", X.trim(F.col("series"))).where("series_name <> ''")
    return positions(rows, "series_name", C.series_order()).select("id", "series_name", F.col("place").cast("long").alias("place"))


@query("a07_genre_facets", f"SELECT DISTINCT g AS value, {NAMES_SQL.format('g')} AS label FROM (SELECT unnest(genres) AS g FROM books) WHERE trim(g) <> ''")
def _(t):
    return C.genre_facets(t.books, NAMES)


@query("a07_language_facets", f"SELECT key, min(value) AS value, regexp_replace(key, '^(language|code):', '') AS label FROM (SELECT {LANG} AS key, {BASE} AS value FROM books) WHERE key <> '' GROUP BY key")
def _(t):
    return C.language_facets(t.books)


@query("f02_language_keys", f"SELECT id, {LANG} AS key FROM books")
def _(t):
    return t.books.select("id", X.language_key(F.col("language")).alias("key"))


@query("f01_normalize", f"SELECT id, {NORM.format('annotation')} AS text FROM books")
def _(t):
    return t.books.select("id", X.normalize(F.col("annotation")).alias("text"))


@query("f03_unique_texts", "SELECT id, array_to_string(list_filter(list_distinct_ordered, lambda x: x <> ''), '|') AS authors FROM (SELECT id, list_transform(authors, lambda x: trim(x)) AS list_distinct_ordered FROM books)")
def _(t):
    return t.books.select("id", F.array_join(X.unique_texts(F.col("authors")), "|").alias("authors"))


@query("f04_series_number", f"SELECT id, {NUM} AS number FROM books")
def _(t):
    return t.books.select("id", X.number(F.col("series_number")).alias("number"))


@query("f05_pr06_series_label", f"SELECT id, CASE WHEN coalesce(trim(series), '') = '' THEN '' WHEN {NUM} IS NULL THEN trim(series) ELSE trim(series) || ' (' || CAST(CAST({NUM} AS BIGINT) AS VARCHAR) || ')' END AS label FROM books")
def _(t):
    return t.books.select("id", X.series_label(F.col("series"), F.col("series_number")).alias("label"))


@query("f33_title_fallback", f"SELECT id, coalesce(nullif({FALLBACK}, ''), file_name) AS title FROM books")
def _(t):
    return t.books.select("id", X.title_fallback(F.col("file_name")).alias("title"))


@query(
    "pr03_card_view",
    f"""SELECT id, CASE WHEN metadata_status = 'ready' AND len(authors) > 0 THEN array_to_string(authors, ', ') ELSE 'Автор не указан' END AS author,
    CASE WHEN metadata_status = 'ready' THEN coalesce(nullif(trim(title), ''), {FALLBACK}) ELSE {FALLBACK} END AS title,
    CASE WHEN metadata_status = 'ready' THEN array_to_string(list_transform(genres, lambda g: {NAMES_SQL.format('g')}), ', ') ELSE 'Жанр не указан' END AS genre_line,
    CASE WHEN metadata_status = 'ready' THEN coalesce(nullif(trim(annotation), ''), nullif(trim(preview), ''), '') ELSE 'Аннотация отсутствует' END AS annotation FROM books""",
)
def _(t):
    return C.card_view(t.books, NAMES)


@query("pr04_modal_authors", "SELECT id, CASE WHEN len(authors) >= 3 THEN trim(authors[1]) || ', ' || trim(authors[2]) || ' и другие' ELSE array_to_string(list_transform(authors, lambda x: trim(x)), ', ') END AS authors FROM books")
def _(t):
    return t.books.select("id", X.modal_authors(F.col("authors"), F.lit(None).cast("string")).alias("authors"))


@query("pr05_genre_labels", f"SELECT id, array_to_string(list_transform(genres, lambda g: {NAMES_SQL.format('g')}), '|') AS labels FROM books")
def _(t):
    return t.books.select("id", F.array_join(X.genre_labels(F.col("genres"), NAMES), "|").alias("labels"))


KIND = """CASE WHEN regexp_matches(name, '\\.(fb2|epub|mobi)$', 'i') THEN lower(regexp_extract(name, '\\.(fb2|epub|mobi)$', 1, 'i'))
 WHEN regexp_matches(name, '\\.zip$', 'i') OR mime_type IN ('application/zip', 'application/x-zip-compressed') THEN 'zip' WHEN regexp_matches(name, '\\.(azw3?|pdf|djvu|docx?|txt)$', 'i') THEN 'other'
 WHEN mime_type = 'application/epub+zip' THEN 'epub' WHEN mime_type = 'application/x-mobipocket-ebook' THEN 'mobi' ELSE 'other' END"""


@query("pr01_classify", f"SELECT id, {KIND} AS kind FROM items")
def _(t):
    return t.items.select("id", X.classify(F.col("name"), F.col("mime_type")).alias("kind"))


WALK = "WITH walk AS (SELECT id AS node, 0 AS depth, '' AS path FROM folders WHERE id = 'root' UNION ALL SELECT f.id, w.depth + 1, CASE WHEN w.path = '' THEN f.name ELSE w.path || ' / ' || f.name END FROM walk w JOIN folders f ON f.parent_id = w.node)"


@query("g05_depths", f"{WALK} SELECT node, CAST(depth AS INT) AS depth, path FROM walk")
def _(t):
    return T.depths(t.folders, "root")


@query(
    "s02_scan_books",
    f"{WALK} SELECT i.id, i.parent_id, i.name AS file_name, {KIND} AS source_type, CASE WHEN path = '' THEN name ELSE path || ' / ' || name END AS path FROM items i JOIN walk ON node = parent_id WHERE NOT trashed AND {KIND} <> 'other'",
)
def _(t):
    mid = t.folders_top.unionByName(t.folders_mid).withColumn("mime_type", F.lit("application/vnd.google-apps.folder")).withColumn("trashed", F.lit(False))
    return T.scan(t.items.unionByName(mid.select("id", "parent_id", "name", "mime_type", "trashed")), "root")[1]


@query("s03_count_indexable", "SELECT CAST(least(10, count(*)) AS BIGINT) AS n FROM items WHERE NOT trashed")
def _(t):
    mid = t.folders_top.unionByName(t.folders_mid).withColumn("mime_type", F.lit("application/vnd.google-apps.folder")).withColumn("trashed", F.lit(False))
    n = T.count_indexable(t.items.unionByName(mid.select("id", "parent_id", "name", "mime_type", "trashed")), "root", 10)
    return t.spark.range(1).select(F.lit(n).cast("long").alias("n"))


@query("g03_pr07_book_paths", f"{WALK} SELECT b.id, CASE WHEN w.path = '' THEN file_name ELSE w.path || ' / ' || file_name END AS path FROM books b LEFT JOIN walk w ON w.node = b.parent_id")
def _(t):
    return T.book_paths(t.folders, t.books, "root").select("id", "path")


UP = "WITH up AS (SELECT DISTINCT parent_id AS node FROM books UNION SELECT f.parent_id FROM up JOIN folders f ON f.id = up.node WHERE f.parent_id IS NOT NULL)"


@query("g02_fi06_folders_with_books", f"{UP} SELECT id FROM folders WHERE id IN (SELECT node FROM up)")
def _(t):
    return T.folders_with_books(t.folders, t.books)


@query("a01_child_counts", "SELECT f.id, (SELECT count(*) FROM folders c WHERE c.parent_id = f.id AND c.id <> 'root') AS folder_count, (SELECT count(*) FROM books b WHERE b.parent_id = f.id) AS book_count FROM folders f")
def _(t):
    return T.child_counts(t.folders, t.books, "root")


@query("a03_visible_folders", f"{UP} SELECT count(*) AS n FROM folders WHERE id IN (SELECT node FROM up) AND id <> 'root'")
def _(t):
    return T.folders_with_books(t.folders, t.books).where("id <> 'root'").agg(F.count("*").alias("n"))


@query("a04_visible_children", f"{UP} SELECT f.id, count(c.id) AS visible_folders FROM folders f LEFT JOIN (SELECT * FROM folders WHERE id IN (SELECT node FROM up)) c ON c.parent_id = f.id GROUP BY f.id")
def _(t):
    return T.visible_child_counts(t.folders, t.books)


@query("g09_shareable_folders", f"{UP} SELECT id, name FROM folders WHERE parent_id = 'root' AND id IN (SELECT node FROM up)")
def _(t):
    return T.shareable_folders(t.folders, t.books, "root").select("id", "name")


@query("fi07_has_children", "SELECT id FROM folders WHERE id IN (SELECT parent_id FROM folders UNION SELECT parent_id FROM books)")
def _(t):
    return T.with_children(t.folders, t.books).select("id")


@query("g01_shared_books", "WITH walk AS (SELECT 'root' AS node UNION ALL SELECT f.id FROM walk w JOIN folders f ON f.parent_id = w.node WHERE f.id NOT IN ('r1', 'n4')) SELECT id, parent_id FROM books WHERE parent_id IN (SELECT node FROM walk)")
def _(t):
    return T.shared_books(t.folders, t.books, "root", ["r1", "n4"]).select("id", "parent_id")


@query("g04_fi26_ancestry", "WITH tree AS (SELECT id, parent_id, id IN ('n2', 'r3') AS trashed FROM folders WHERE id <> 'n7'), walk AS (SELECT id AS node, CASE WHEN trashed THEN 'excluded' WHEN id = 'root' THEN 'inside' ELSE 'excluded' END AS state FROM tree WHERE trashed OR id = 'root' OR parent_id IS NULL UNION ALL SELECT f.id, w.state FROM walk w JOIN tree f ON f.parent_id = w.node WHERE NOT f.trashed) SELECT t.id, coalesce(state, 'undetermined') AS state FROM tree t LEFT JOIN walk ON node = t.id")
def _(t):
    return T.ancestry(t.folders.where("id <> 'n7'").withColumn("trashed", F.col("id").isin("n2", "r3")), "root")


@query("g06_forest", "WITH walk AS (SELECT uid AS node, 0 AS depth, uid AS root FROM users WHERE invited_by IS NULL OR invited_by NOT IN (SELECT uid FROM users) UNION ALL SELECT u.uid, w.depth + 1, w.root FROM walk w JOIN users u ON u.invited_by = w.node) SELECT uid, root, CAST(depth AS INT) AS depth, root IS NULL AS cyclic FROM users LEFT JOIN walk ON node = uid")
def _(t):
    return T.forest(t.users)


@query("o10_pages", "SELECT id, pos FROM books ORDER BY pos LIMIT 50 OFFSET 100")
def _(t):
    return C.page(t.books, [F.col("pos")], "3", 50)[0].select("id", "pos")


@query("o11_page_tokens", "SELECT p_partkey AS k, array_to_string(CASE WHEN n <= 1 THEN CAST([] AS INT[]) WHEN n <= 7 THEN range(1, n + 1) WHEN c <= 4 THEN [1, 2, 3, 4, 5, 0, n] WHEN c >= n - 3 THEN [1, 0, n - 4, n - 3, n - 2, n - 1, n] ELSE [1, 0, c - 2, c - 1, c, c + 1, c + 2, 0, n] END, ',') AS tokens FROM (SELECT p_partkey, p_size AS n, p_partkey % p_size + 1 AS c FROM part)")
def _(t):
    n = F.col("p_size")
    return t.raw("part").select(F.col("p_partkey").alias("k"), F.array_join(X.page_tokens(n, F.col("p_partkey") % n + 1).cast("array<string>"), ",").alias("tokens"))


@query("o12_keyset_page", "SELECT id, name FROM folders WHERE id > 'c15' ORDER BY id LIMIT 26")
def _(t):
    return C.keyset_page(t.folders.select("id", "name"), ["id"], C.decode_cursor(C.encode_cursor("folders", "c15"), "folders", 1), 25)


@query("o13_composite_keyset", "SELECT uid, display_name FROM users WHERE (display_name, uid) > ('Customer#000000042', 'u42') ORDER BY display_name, uid LIMIT 11")
def _(t):
    return C.keyset_page(t.users.select("uid", "display_name"), ["display_name", "uid"], ("Customer#000000042", "u42"), 10)


@query("o14_top_per_key", "SELECT id, file_id FROM (SELECT concat('e', pos) AS id, file_id, row_number() OVER (PARTITION BY file_id ORDER BY pos DESC) AS r FROM errors) WHERE r <= 5")
def _(t):
    return C.top(t.errors.select(F.concat(F.lit("e"), F.col("pos").cast("string")).alias("id"), "file_id", "pos"), "file_id", [F.desc("pos")], 5).select("id", "file_id")


@query("fi17_prefix_search", "SELECT uid FROM users WHERE display_name >= 'Customer#00000001' AND display_name <= 'Customer#00000001' || chr(63743)")
def _(t):
    return C.prefix_search(t.users, "display_name", " Customer#00000001 ").select("uid")


@query("s04_single_item", "SELECT id, name, mime_type FROM items WHERE id = 'd17'")
def _(t):
    return C.listed(t.items, id="d17").select("id", "name", "mime_type")


@query("s05_newest_of_name", "SELECT lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) AS name, max(CAST(substr(id, 2) AS BIGINT)) AS newest FROM items WHERE NOT trashed GROUP BY 1")
def _(t):
    from ..operators.refresh import latest

    k = F.col("id").substr(2, 20).cast("long")
    rows = C.listed(t.items, trashed=False).select(F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1)).alias("name"), k.alias("newest"))
    return latest(rows, ["name"], [F.desc("newest")])


@query("s06_prefix_listing", "SELECT id, name FROM items WHERE starts_with(name, 'src1_')")
def _(t):
    return C.prefix_search(t.items, "name", "src1_").select("id", "name")


@query("f10_book_count", "SELECT c_custkey AS k, CASE WHEN c_custkey >= 1000000 THEN CAST(c_custkey // 1000000 AS VARCHAR) || chr(160) || lpad(CAST(c_custkey // 1000 % 1000 AS VARCHAR), 3, '0') || chr(160) || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') WHEN c_custkey >= 1000 THEN CAST(c_custkey // 1000 AS VARCHAR) || chr(160) || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') ELSE CAST(c_custkey AS VARCHAR) END || ' ' || CASE WHEN c_custkey % 100 BETWEEN 11 AND 19 THEN 'книг' WHEN c_custkey % 10 = 1 THEN 'книга' WHEN c_custkey % 10 BETWEEN 2 AND 4 THEN 'книги' ELSE 'книг' END AS text FROM customer")
def _(t):
    return t.raw("customer").select(F.col("c_custkey").alias("k"), X.book_count(F.col("c_custkey")).alias("text"))


@query("f12_truncate", "SELECT doc_id, CASE WHEN length(text) <= 120 THEN text WHEN contains(substr(text, 1, 120), ' ') THEN regexp_extract(substr(text, 1, 120), '(?s)^(.*) ', 1) ELSE substr(text, 1, 120) END AS head FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", X.truncate_at_word(F.col("text"), 120).alias("head"))


@query("f12_word_count", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS INT) AS n FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", X.word_count(F.col("text")).cast("int").alias("n"))


@query("f16_duration", "SELECT o_orderkey AS k, CASE WHEN s >= 60 THEN CAST(s // 60 AS VARCHAR) || ' мин ' || CAST(s % 60 AS VARCHAR) || ' сек' ELSE CAST(s AS VARCHAR) || ' сек' END AS text FROM (SELECT o_orderkey, CAST(ceil(o_orderkey * 37 / 1000.0) AS BIGINT) AS s FROM orders)")
def _(t):
    return t.raw("orders").select(F.col("o_orderkey").alias("k"), X.duration(F.col("o_orderkey") * 37).alias("text"))


@query("f17_date_label", "SELECT o_orderkey AS k, strftime(o_orderdate, '%d.%m.%Y, %H:%M') AS text FROM orders")
def _(t):
    return t.raw("orders").select(F.col("o_orderkey").alias("k"), X.date_label(F.col("o_orderdate")).alias("text"))


@query("f19_short_hash", "SELECT c_custkey AS k, substr(sha256(CAST(c_custkey AS VARCHAR) || ':' || c_name), 1, 16) AS h FROM customer")
def _(t):
    return t.raw("customer").select(F.col("c_custkey").alias("k"), X.short_hash(F.col("c_custkey").cast("string"), F.col("c_name")).alias("h"))


@query("f20_fit_scale", "SELECT p_partkey AS k, CAST(greatest(1, floor(w * s + 0.5)) AS BIGINT) AS width, CAST(greatest(1, floor(h * s + 0.5)) AS BIGINT) AS height FROM (SELECT p_partkey, w, h, least(1.0::DOUBLE, 240.0::DOUBLE / w, 320.0::DOUBLE / h) AS s FROM (SELECT p_partkey, p_partkey % 900 + 1 AS w, p_partkey * 7 % 1100 + 1 AS h FROM part))")
def _(t):
    k = F.col("p_partkey")
    return t.raw("part").select(k.alias("k"), X.fit_scale(k % 900 + 1, k * 7 % 1100 + 1).alias("s")).select("k", "s.width", "s.height")


@query("f21_cover_score", "SELECT k, CASE WHEN w < 120 OR h < 160 OR h <= w OR h / w::DOUBLE < 1.15::DOUBLE OR h / w::DOUBLE > 3 THEN 0.0::DOUBLE ELSE w * h * least(h / w::DOUBLE, 2.0::DOUBLE) END AS score FROM (SELECT p_partkey AS k, p_partkey % 900 + 1 AS w, p_partkey * 7 % 1100 + 1 AS h FROM part)")
def _(t):
    k = F.col("p_partkey")
    return t.raw("part").select(k.alias("k"), X.cover_score(k % 900 + 1, k * 7 % 1100 + 1).alias("score"))


SCORE = "CASE WHEN w < 120 OR h < 160 OR h <= w OR h / w::DOUBLE < 1.15::DOUBLE OR h / w::DOUBLE > 3 THEN 0.0::DOUBLE ELSE w * h * least(h / w::DOUBLE, 2.0::DOUBLE) END"


@query("a25_best_cover", f"SELECT parent, k FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY score DESC, k) AS r FROM (SELECT p_partkey % 50 AS parent, p_partkey AS k, {SCORE} AS score FROM (SELECT p_partkey, p_partkey % 900 + 1 AS w, p_partkey * 7 % 1100 + 1 AS h FROM part)) WHERE score > 0) WHERE r = 1")
def _(t):
    from ..operators.refresh import latest

    k = F.col("p_partkey")
    rows = t.raw("part").select((k % 50).alias("parent"), k.alias("k"), X.cover_score(k % 900 + 1, k * 7 % 1100 + 1).alias("score")).where("score > 0")
    return latest(rows, ["parent"], [F.desc("score"), F.col("k")]).select("parent", "k")


@query("f25_zip_entry_kind", "SELECT id, nullif(lower(regexp_extract(name, '\\.(fb2|epub|mobi)$', 1, 'i')), '') AS kind FROM items")
def _(t):
    return t.items.select("id", X.zip_entry_kind(F.col("name")).alias("kind"))


@query("f27_base_signature", "SELECT concat_ws(':', 4, 3, 'root', max(modified_time), count(*)) AS signature FROM books")
def _(t):
    return t.books.agg(X.base_signature(F.lit(4), F.lit(3), F.lit("root"), F.max("modified_time"), F.count("*")).alias("signature"))


@query("f28_escape_html", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM pages")
def _(t):
    return t.raw("pages").select("page_id", X.escape_html(F.col("html")).alias("html"))


@query("f32_retry_delay", "SELECT p_partkey AS k, least(700 * pow(2.0::DOUBLE, p_size % 8), 10000.0::DOUBLE) AS ms FROM part")
def _(t):
    return t.raw("part").select(F.col("p_partkey").alias("k"), X.retry_delay(F.col("p_size") % 8).alias("ms"))


@query("fi13_zip_candidates", "SELECT id FROM items WHERE regexp_matches(name, '\\.(fb2|epub|mobi)$', 'i') AND NOT list_contains(string_split(lower(name), '/'), '__macosx') AND NOT ends_with(lower(name), 'thumbs.db')")
def _(t):
    return zip_candidates(t.items).select("id")


@query("a15_zip_totals", "SELECT parent_id, CAST(sum(size) AS BIGINT) AS total, bool_or(size > 500 * pos) AS over FROM books GROUP BY parent_id")
def _(t):
    return zip_totals(t.books.select("parent_id", "size", F.col("pos").alias("packed")), "parent_id").select("parent_id", "total", "over")


@query("p14_sniff", "SELECT page_id, CASE WHEN regexp_matches(lower(trim(substr(html, 1, 200))), '^(<!doctype html|<html)') THEN 'html' WHEN starts_with(trim(html), '<') THEN 'xml' ELSE 'binary' END AS kind FROM pages")
def _(t):
    return t.raw("pages").select("page_id", X.sniff(F.encode("html", "UTF-8")).alias("kind"))


def _settings(t):
    """One row a region: notes of its folders, some blank, and exclusions, some twice or of folders that can't be shared."""
    k = F.col("r_regionkey").cast("string")
    notes = F.create_map(F.concat(F.lit("n"), k), F.concat(F.lit("  "), F.col("r_name"), F.lit(" ")), F.lit("x"), F.lit("   "))
    asked = F.array(F.lit("r3"), F.concat(F.lit("r"), k), F.lit("gone"), F.lit("r3"))
    s = t.raw("region").select(F.concat(F.lit("root"), k).alias("root_folder_id"), asked.alias("excluded_folder_ids"), notes.alias("folder_notes"))
    return normalize_settings(s, t.folders_top.select("id", F.substring("id", 2, 9).cast("int").alias("pos")))


@query("c03_folder_notes", "SELECT 'root' || r_regionkey AS root_folder_id, 'n' || r_regionkey AS folder, r_name AS note FROM region")
def _(t):
    return _settings(t).select("root_folder_id", F.explode("folder_notes").alias("folder", "note"))


@query("c04_v03_k10_exclusions", "SELECT 'root' || r_regionkey AS root_folder_id, CASE WHEN r_regionkey = 3 THEN 'r3' WHEN r_regionkey < 3 THEN 'r' || r_regionkey || ',r3' ELSE 'r3,r' || r_regionkey END AS excluded FROM region")
def _(t):
    return _settings(t).select("root_folder_id", F.array_join("excluded_folder_ids", ",").alias("excluded"))


@query("c07_split_flatten", "SELECT conv_id, turn, len(string_split(text, ';')) AS n FROM conversations")
def _(t):
    return t.raw("conversations").select("conv_id", "turn", F.size(F.flatten(F.transform(F.array("text"), lambda x: F.split(x, ";")))).cast("long").alias("n"))


@query("pr02_shared_projection", "SELECT id, parent_id, file_name, source_type, size, title FROM books WHERE metadata_status = 'ready' AND parent_id IN (SELECT id FROM folders)")
def _(t):
    from ..operators.publish import published_rows

    rows = published_rows(t.folders, t.books.where("metadata_status = 'ready'"), "root", [])
    return rows.select("id", "parent_id", "file_name", "source_type", "size", "title")


@query("f14_html_lines")
def _(t):
    """Text lines of pages; checked by tests, for SQL has no HTML parser."""
    from ..sources.pages import page_lines

    return page_lines(t.raw("pages"))


@query("p01_extract_documents")
def _(t):
    """Documents wrapped as FB2 files and parsed back; checked by tests."""
    from ..sources.parsers import extract_metadata

    doc = F.concat(F.lit("<FictionBook><description><title-info><genre>"), "source", F.lit("</genre><author><first-name>A</first-name></author><book-title>"), F.col("doc_id").cast("string"), F.lit("</book-title><lang>"), "lang", F.lit("</lang></title-info></description><body><p>"), X.escape_html(F.col("text")), F.lit("</p></body></FictionBook>"))
    files = t.raw("documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("a.fb2").alias("name"), F.lit("fb2").alias("source_type"), F.encode(doc, "UTF-8").alias("content"))
    return extract_metadata(files).drop("cover")
