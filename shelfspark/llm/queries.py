"""Queries of the operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, jaccard, langid, lines, metric_join, mixing, secrets, sketch, substring, token_counts, toxicity, vector_codes

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Place of the tokenizer file, the default of the operators' path parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.link_vectors(table(spark, sf_dir, "embeddings"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary())


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint_edits(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_mixing, op2_token_counts, op3_secrets, op4_substring_dedup, op5_embedding_dedup, op6_language, op7_toxicity,
    op8_jaccard_join, op9_bpe, op10_fingerprints, op11_vector_codes, op12_line_dedup, op13_divergence,
)


def queries() -> dict[str, Query]:
    found = {f.__name__: f for f in OPERATORS}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents
), t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)) AS BIGINT) AS weight
  FROM d GROUP BY source
), a AS (
  SELECT *, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS all_words, CAST(sum(weight) OVER () AS BIGINT) AS all_weight FROM t
), b AS (
  SELECT *,
    coalesce(CAST(sum(cap) OVER o AS BIGINT), 0) AS c, coalesce(CAST(sum(weight) OVER o AS BIGINT), 0) AS w
  FROM a WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), e AS (
  SELECT *, (all_words - c) * weight > cap * CAST(all_weight - w AS DOUBLE) AS capped FROM b
), f AS (
  SELECT source, source_size,
    CASE WHEN capped THEN CAST(cap AS DOUBLE)
         ELSE weight * ((all_words - CAST(sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS DOUBLE))
                        / nullif(CAST(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS DOUBLE), 0)) END AS target
  FROM e
), g AS (
  SELECT *, coalesce(CAST(floor(target / nullif(source_size, 0)) AS BIGINT), 0) AS whole FROM f
), r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS rest,
    coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN before + size / 2.0::DOUBLE <= rest AND rest < source_size AND before <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT doc_id, s, array_to_string(list_slice(w, s, s + 12), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)
), f AS (
  SELECT k, min(doc_id) AS first FROM p GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, s + j AS i FROM (SELECT doc_id, s, unnest(range(0, 13)) AS j FROM p JOIN f USING (k) WHERE first < doc_id)
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS top FROM v UNION SELECT links.b, reach.top FROM reach JOIN links ON links.a = reach.node
), c AS (
  SELECT node, min(top) AS component_id FROM reach GROUP BY node
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON c.node = v.vec_id
"""

OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * o >= 75 * (na.n + nb.n - o)
), reach AS (
  SELECT doc_id AS node, doc_id AS top FROM d UNION SELECT links.b, reach.top FROM reach JOIN links ON links.a = reach.node
), c AS (
  SELECT node, min(top) AS component_id FROM reach GROUP BY node
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""


def _op11_sql(rounds: int = 4) -> str:
    near = """
), a{r} AS MATERIALIZED (
  SELECT vec_id, part, best % 256 AS idx, best // 256 AS error FROM (
    SELECT p.vec_id, p.part, min(256 * CAST(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) + c.idx) AS best
    FROM p JOIN c{r} c ON c.part = p.part GROUP BY p.vec_id, p.part)"""
    move = """
), m{r} AS (
  SELECT part, idx, list((s - (s % n + n) % n) // n ORDER BY i) AS x FROM (
    SELECT part, idx, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
    FROM (SELECT vec_id, part, unnest(x) AS v, unnest(range(len(x))) AS i FROM p) JOIN a{q} USING (vec_id, part) GROUP BY part, idx, i) GROUP BY part, idx
), c{r} AS MATERIALIZED (
  SELECT c.part, c.idx, coalesce(m.x, c.x) AS x FROM c{q} c LEFT JOIN m{r} m USING (part, idx)"""
    steps = near.format(r=0) + "".join(move.format(r=r, q=r - 1) + near.format(r=r) for r in range(1, rounds + 1))
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, part, list_slice(e, 1 + part * len(e) // 4, (part + 1) * len(e) // 4) AS x FROM v, (SELECT unnest(range(4)) AS part)
), c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS idx, x FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256){steps}
), books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, idx)) AS codebooks_sha256 FROM c{rounds}
), coded AS (
  SELECT vec_id, label, string_agg(lpad(printf('%x', idx), 2, '0'), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error
  FROM a{rounds} JOIN v USING (vec_id) GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books
"""


OP12_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l
), f AS (
  SELECT k, min(doc_id) AS first FROM k WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.*, f.first IS NOT NULL AND f.first <> k.doc_id AS gone FROM k LEFT JOIN f USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), l AS (
  SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), g AS (
  SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n,
    CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // CAST(g.n + 5 * l.v AS HUGEINT) AS BIGINT) AS p,
    CAST(1 + 1000000000::HUGEINT * (kept.n + 5) // CAST(l.n + 5 * l.v AS HUGEINT) AS BIGINT) AS q
  FROM g JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), ranked AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM ranked) WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op5_embedding_dedup": OP5_SQL, "op8_jaccard_join": OP8_SQL,
        "op11_vector_codes": _op11_sql(), "op12_line_dedup": OP12_SQL, "op13_divergence": OP13_SQL,
    }
