"""The driver's tables in the shapes of a catalog.

Each shape is a list of expressions that mean the same in Spark and in DuckDB, so a query and its
SQL start from the same rows. ``list_value`` is ``array`` in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SHAPES: dict[str, tuple[str, str]] = {
    "books": (
        "part",
        """concat('b', CAST(p_partkey AS STRING)) AS id,
        CASE WHEN p_partkey % 3 = 0 THEN concat('n', CAST(p_partkey % 25 AS STRING)) ELSE concat('c', CAST(p_partkey % 120 AS STRING)) END AS parent_id,
        concat(p_name, ' ', CAST(p_partkey AS STRING), CASE p_partkey % 4 WHEN 0 THEN '.fb2' WHEN 1 THEN '.EPUB' WHEN 2 THEN '.mobi' ELSE '.fb2.zip' END) AS file_name,
        CASE p_partkey % 4 WHEN 0 THEN 'fb2' WHEN 1 THEN 'epub' WHEN 2 THEN 'mobi' ELSE 'zip' END AS source_type,
        CAST(NULL AS STRING) AS path,
        CAST(p_partkey * 10 AS BIGINT) AS size,
        concat('2024-01-0', CAST(p_partkey % 9 + 1 AS STRING)) AS modified_time,
        CASE WHEN p_partkey % 10 = 0 THEN 'error' WHEN p_partkey % 10 = 1 THEN 'pending' WHEN p_partkey % 10 = 2 THEN 'processing' ELSE 'ready' END AS metadata_status,
        CAST(p_partkey % 4 AS INT) AS metadata_version,
        CASE WHEN p_partkey % 7 = 0 THEN '  ' WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS title,
        CASE WHEN p_partkey % 8 = 0 THEN list_value(p_brand, p_type, 'Third') WHEN p_partkey % 8 = 1 THEN list_value(concat(' ', p_brand, ' ')) ELSE list_value(p_type, p_brand) END AS authors,
        CASE WHEN p_partkey % 6 = 0 THEN list_value(p_type, ' ') ELSE list_value(p_type, lower(p_brand)) END AS genres,
        CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat(' ', p_brand) END AS series,
        CASE WHEN p_partkey % 13 = 0 THEN 'x' WHEN p_partkey % 13 = 1 THEN ' ' ELSE CAST(p_size AS STRING) END AS series_number,
        CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE concat(p_type, '  ', p_name) END AS annotation,
        p_name AS preview,
        CASE p_partkey % 17 WHEN 0 THEN 'ru' WHEN 1 THEN 'rus' WHEN 2 THEN 'en_US' WHEN 3 THEN ' ENG ' WHEN 4 THEN 'ger' WHEN 5 THEN 'qx' WHEN 6 THEN 'ja' WHEN 7 THEN 'ja-JP' WHEN 8 THEN 'pt-BR' WHEN 9 THEN 'PT' WHEN 10 THEN 'zh_CN' WHEN 11 THEN 'zh' WHEN 12 THEN 'tyv' WHEN 13 THEN 'русский' WHEN 14 THEN 'en' ELSE NULL END AS language,
        CASE WHEN p_partkey % 17 = 0 THEN concat('cover', CAST(p_partkey % 400 AS STRING)) ELSE NULL END AS cover_file_id,
        CASE WHEN p_partkey % 19 = 0 THEN 'metadata_only_recovered' ELSE NULL END AS metadata_warning,
        p_partkey AS pos""",
    ),
    "folders_flat": (
        "customer",
        "concat('c', CAST(c_custkey AS STRING)) AS id, concat('n', CAST(c_nationkey AS STRING)) AS parent_id, c_name AS name",
    ),
    "folders_mid": ("nation", "concat('n', CAST(n_nationkey AS STRING)) AS id, concat('r', CAST(n_regionkey AS STRING)) AS parent_id, n_name AS name"),
    "folders_top": ("region", "concat('r', CAST(r_regionkey AS STRING)) AS id, 'root' AS parent_id, r_name AS name"),
    "users": (
        "customer",
        """concat('u', CAST(c_custkey AS STRING)) AS uid, c_name AS display_name, CASE WHEN c_custkey = 0 THEN NULL ELSE concat('u', CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS STRING)) END AS invited_by,
        CAST(c_custkey * 7 % 1000 AS BIGINT) AS created_at, c_custkey % 50 = 0 AS is_admin, c_custkey = 0 AS is_superadmin, concat(lower(replace(c_name, '#', '.')), '@example.com') AS email""",
    ),
    "suppliers": ("supplier", "concat('u', CAST(s_suppkey AS STRING)) AS uid, s_name AS display_name, s_acctbal AS balance, s_suppkey AS pos"),
    "shares": (
        "lineitem",
        """concat('u', CAST(l_suppkey % 50 AS STRING), '__u', CAST(l_partkey % 50 AS STRING)) AS id, concat('u', CAST(l_suppkey % 50 AS STRING)) AS owner_uid, concat('u', CAST(l_partkey % 50 AS STRING)) AS viewer_uid,
        l_returnflag <> 'R' AS active, CASE WHEN l_linenumber % 3 = 0 THEN concat('o', CAST(l_suppkey % 50 AS STRING), '@example.com') ELSE NULL END AS owner_email, l_orderkey * 10 + l_linenumber AS at, l_orderkey * 10 + l_linenumber AS pos""",
    ),
    "errors": (
        "events",
        """concat('b', CAST(user_id AS STRING)) AS file_id, concat('book ', CAST(user_id AS STRING)) AS file_name, CASE WHEN event_id % 10 = 0 THEN 'index-write' ELSE 'parse' END AS stage,
        CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'recovered' WHEN 'purchase' THEN 'excluded' ELSE 'interrupted' END AS outcome,
        CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('e', CAST(event_id % 4 AS STRING)) END AS code, props AS message, event_id % 3 = 0 AS previous_entry_preserved, CAST(NULL AS STRING) AS path, event_id AS pos""",
    ),
    "invitations": (
        "orders",
        """concat('u', CAST(o_custkey % 20 AS STRING)) AS owner_uid, CASE WHEN o_custkey % 31 = 0 THEN 'not an address' ELSE concat(' User', CAST(o_custkey % 300 AS STRING), '@Example.com ') END AS invitee_email,
        CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'pending' ELSE 'odd' END AS status, CAST(o_orderkey % 977 AS BIGINT) AS updated_at, CAST(o_orderkey % 1009 AS BIGINT) AS created_at,
        CASE WHEN o_orderstatus = 'F' THEN concat('u', CAST(o_custkey % 300 AS STRING)) ELSE NULL END AS accepted_uid, CAST(NULL AS STRING) AS accepted_display_name, o_orderkey AS pos""",
    ),
    "pending_invites": (
        "orders",
        """concat('user', CAST(o_custkey % 300 AS STRING), '@example.com') AS invitee_email, concat('u', CAST(o_custkey % 20 AS STRING)) AS owner_uid, o_orderpriority <> '5-LOW' AS active,
        CASE WHEN o_orderstatus = 'F' THEN concat('u', CAST(o_custkey % 300 AS STRING)) ELSE NULL END AS claimed_uid, o_orderkey AS created_at, o_orderkey AS pos""",
    ),
    "current": (
        "orders",
        """concat('b', CAST(o_orderkey AS STRING)) AS id, 'fb2' AS source_type, CAST(o_orderdate AS DATE) AS modified_time, o_custkey AS size, 'pending' AS metadata_status, CAST(NULL AS STRING) AS title, CAST(NULL AS STRING) AS cover_file_id, CAST(NULL AS INT) AS metadata_version, o_orderkey AS pos""",
    ),
    "previous": (
        "orders",
        """concat('b', CAST(CASE WHEN o_orderkey % 97 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS STRING)) AS id, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'fb2' END AS source_type, CAST(o_orderdate AS DATE) AS modified_time,
        CASE WHEN o_orderkey % 13 = 0 THEN o_custkey + 1 ELSE o_custkey END AS size, CASE WHEN o_orderkey % 5 = 0 THEN 'processing' WHEN o_orderkey % 5 = 1 THEN 'error' ELSE 'ready' END AS metadata_status, o_orderpriority AS title,
        CASE WHEN o_orderkey % 3 = 0 THEN concat('cover', CAST(o_orderkey AS STRING)) ELSE NULL END AS cover_file_id, CAST(o_orderkey % 4 AS INT) AS metadata_version, o_orderkey AS pos""",
    ),
    "items": (
        "documents",
        """concat('d', CAST(doc_id AS STRING)) AS id, concat('n', CAST(doc_id % 25 AS STRING)) AS parent_id,
        concat(source, '_', CAST(doc_id AS STRING), CASE doc_id % 11 WHEN 0 THEN '.fb2' WHEN 1 THEN '.EPUB' WHEN 2 THEN '.mobi' WHEN 3 THEN '.zip' WHEN 4 THEN '.pdf' WHEN 5 THEN '.azw3' WHEN 6 THEN '.docx' WHEN 7 THEN '.fb2.zip' ELSE '' END) AS name,
        CASE doc_id % 6 WHEN 0 THEN 'application/zip' WHEN 1 THEN 'application/epub+zip' WHEN 2 THEN 'application/x-mobipocket-ebook' WHEN 3 THEN 'text/plain' ELSE '' END AS mime_type, doc_id % 23 = 0 AS trashed""",
    ),
    "lookups": ("events", "concat('u', CAST(user_id AS STRING)) AS uid, ts, event_id AS pos, concat('a', CAST(event_id % 7 AS STRING), '@example.com') AS address"),
    "mappings": (
        "part",
        """CASE p_partkey % 4 WHEN 0 THEN 'override' WHEN 1 THEN 'source' WHEN 2 THEN 'seed' ELSE 'existing' END AS layer, CAST(p_size % 5 AS INT) AS source_rank,
        concat(lower(replace(p_brand, '#', '_')), '_', lower(p_type)) AS code, p_name AS label""",
    ),
    "admins": ("supplier", "concat('u', CAST(s_suppkey * 3 AS STRING)) AS uid, s_suppkey % 4 <> 3 AS active, CASE WHEN s_suppkey = 0 THEN 'superadmin' ELSE 'admin' END AS role, concat(s_name, '@example.com') AS email, s_name AS display_name"),
    "bans": ("supplier", "concat('u', CAST(s_suppkey * 5 AS STRING)) AS uid, concat('customer.', lpad(CAST(s_suppkey * 7 AS STRING), 9, '0'), '@example.com') AS email, s_name AS display_name"),
    "admin_events": ("events", "concat('e', CAST(event_id AS STRING)) AS id, concat('u', CAST(event_id % 9 AS STRING)) AS actor_uid, CASE event_type WHEN 'error' THEN 'ban' WHEN 'signup' THEN 'restore' ELSE event_type END AS action, concat('u', CAST(user_id AS STRING)) AS target_uid, ts AS created_at, event_id AS pos"),
}

#: Shapes made of others: SQL that both engines read.
JOINED = {
    "folders": "SELECT id, parent_id, name FROM folders_flat UNION ALL SELECT id, parent_id, name FROM folders_mid UNION ALL SELECT id, parent_id, name FROM folders_top UNION ALL SELECT 'root' AS id, CAST(NULL AS STRING) AS parent_id, 'Library' AS name",
    "shares_now": "SELECT id, owner_uid, viewer_uid, bool_or(active) AS active, min(owner_email) AS owner_email FROM shares GROUP BY id, owner_uid, viewer_uid",
}


class Tables:
    """Shapes over a folder of Parquet tables, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in SHAPES:
            source, exprs = SHAPES[name]
            return self.spark.sql(f"SELECT {exprs.replace('list_value(', 'array(')} FROM {{t}}", t=self.raw(source))
        if name in JOINED:
            used = {n: getattr(self, n) for n in SHAPES if f" {n}" in JOINED[name]}
            q = JOINED[name]
            for n in sorted(used, key=len, reverse=True):
                q = q.replace(f"FROM {n}", f"FROM {{{n}}}")
            return self.spark.sql(q, **{n: d for n, d in used.items() if f"{{{n}}}" in q})
        raise AttributeError(name)


def with_shapes(sql: str) -> str:
    """The same shapes as common table expressions before a DuckDB query."""
    parts = [f"{n} AS (SELECT {e} FROM {s})" for n, (s, e) in SHAPES.items()] + [f"{n} AS ({q})" for n, q in JOINED.items()]
    sql = sql.strip()
    rest = sql[5:].lstrip() if sql.upper().startswith("WITH ") else None
    if rest is None:
        return f"WITH RECURSIVE {', '.join(parts)} {sql}"
    return f"WITH RECURSIVE {', '.join(parts)}, {rest}"
