"""Queries of the core operators over a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sekvant.operators import heavy_keys, intervals, packed_fields
from sekvant.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of each field that packs two or more."""
    parts = []
    for name, row_id, field, grammar in (("classifications", "cls_id", "domains", packed_fields.TYPED), ("blast_hits", "hit_id", "classified_by", packed_fields.PLAIN)):
        vals = packed_fields.split_packed(table(spark, sf_dir, name), row_id, field, grammar=grammar)
        parts.append(vals.where("n_vals >= 2").select(F.lit(field).alias("src_field"), "row_id", "pos", "val"))
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered stretches and the gaps between them, per sequence."""
    found = intervals.stretches(table(spark, sf_dir, "legacy_hits"), "base_seq", "env_from", "env_to", name="base_seq")
    return found.select("base_seq", "kind", F.col("pos_from").cast("int").alias("pos_from"), F.col("pos_to").cast("int").alias("pos_to"))


def _usual_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys.usual_values(table(spark, sf_dir, "legacy_hits"), "query_name", "query_len")


def p6_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of hits and usual length of every model."""
    return _usual_lengths(spark, sf_dir).select(F.col("k").alias("query_name"), F.col("n_rows").alias("n_hits"), F.col("usual").alias("usual_query_len"), F.col("n_usual").alias("n_usual"), F.col("n_values").alias("n_lengths"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that hold at least one in 25 of all rows, with their usual length."""
    total = table(spark, sf_dir, "legacy_hits").agg(F.count(F.lit(1)).alias("total")).scalar()
    return _usual_lengths(spark, sf_dir).where(F.col("n_rows") * 25 >= total).select(F.col("k").alias("query_name"), F.col("usual").alias("query_len"))


def p6_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a model's length differs from that of its hit before, by id."""
    found = heavy_keys.change_counts(table(spark, sf_dir, "legacy_hits"), "query_name", "query_len", order=["id"])
    return found.select(F.col("k").alias("query_name"), F.col("n_rows").alias("n_hits"), "n_changes")


QUERIES = {"p3_found": p3_found, "p5_found": p5_found, "p6_found": p6_found, "p6_models": p6_models, "p6_changes": p6_changes}

#: Signs between values, and blanks, as a character class.
_BETWEEN = r"[\s,;；，、/|+&]"

ORACLES = {
    # Typed values are told apart by what begins one, plain ones by what they consist of.
    "p3_found": rf"""
WITH f AS (
  SELECT 'domains' AS src_field, row_number() OVER () AS rn, cls_id AS row_id, trim(domains, E' \t\n\r') AS f FROM classifications
  UNION ALL SELECT 'classified_by', row_number() OVER (), hit_id, trim(classified_by, E' \t\n\r') FROM blast_hits),
g AS (
  SELECT src_field, rn, row_id, CASE WHEN regexp_full_match(f, '\[[^\]]*\]|\([^)]*\)|\{{[^}}]*\}}') THEN f[2:-2] ELSE f END AS f FROM f
  WHERE f IS NOT NULL AND lower(f) NOT IN ('', 'unknown', 'mixture', 'none', 'na', '?', '.')),
p AS (
  SELECT src_field, rn, row_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM (
    SELECT src_field, rn, row_id, CASE WHEN src_field = 'domains'
      THEN string_split(regexp_replace(regexp_replace(f, '("(?:[^"]|"")*")', E'\x01\\1\x01', 'g'), '(^|{_BETWEEN}|\x01)(''?[^\s,;；，、/|+&"''\x01]+\|[^\s,;；，、/|+&])', E'\\1\x01\\2', 'g'), E'\x01')
      ELSE regexp_extract_all(f, '"(?:[^"]|"")*"|''[^'']*''|[^\s,;；，、/|+&]+') END AS x FROM g)),
q AS (SELECT src_field, rn, row_id, i, trim(regexp_replace(v, '^{_BETWEEN}+|{_BETWEEN}+$', '', 'g')) AS v FROM p),
r AS (
  SELECT src_field, rn, row_id, i, trim(CASE WHEN v LIKE '"%"' AND length(v) > 1 THEN replace(v[2:-2], '""', '"') WHEN v LIKE '''%''' AND length(v) > 1 THEN v[2:-2] ELSE v END) AS v FROM q),
n AS (SELECT src_field, row_id, v, row_number() OVER k AS pos, count(*) OVER (PARTITION BY src_field, rn) AS n FROM r WHERE v <> '' WINDOW k AS (PARTITION BY src_field, rn ORDER BY i))
SELECT src_field, row_id, pos::INTEGER AS pos, v AS val FROM n WHERE n >= 2""",
    "p5_found": """
WITH s AS (
  SELECT DISTINCT base_seq, least(env_from, env_to)::BIGINT AS f, greatest(env_from, env_to)::BIGINT AS t
  FROM legacy_hits WHERE base_seq IS NOT NULL AND env_from IS NOT NULL AND env_to IS NOT NULL),
m AS (
  SELECT *, max(t) OVER (PARTITION BY base_seq ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR f > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY base_seq ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS island FROM m),
c AS (SELECT base_seq, island, min(f) AS f, max(t) AS t FROM i GROUP BY base_seq, island),
g AS (SELECT base_seq, t + 1 AS f, lead(f) OVER (PARTITION BY base_seq ORDER BY f) - 1 AS t FROM c)
SELECT base_seq, 'covered' AS kind, f::INTEGER AS pos_from, t::INTEGER AS pos_to FROM c
UNION ALL
SELECT base_seq, 'gap', f::INTEGER, t::INTEGER FROM g WHERE t IS NOT NULL""",
    "p6_found": """
WITH n AS (SELECT query_name, query_len, count(*) AS n FROM legacy_hits WHERE query_name IS NOT NULL GROUP BY 1, 2),
k AS (SELECT query_name, sum(n) AS n FROM n GROUP BY 1 HAVING sum(n) * 25 >= (SELECT count(*) FROM legacy_hits)),
b AS (SELECT query_name, query_len, row_number() OVER (PARTITION BY query_name ORDER BY n DESC, query_len) AS r FROM n WHERE query_len IS NOT NULL)
SELECT k.query_name, b.query_len FROM k LEFT JOIN b ON b.query_name = k.query_name AND b.r = 1""",
    "p6_changes": """
WITH c AS (SELECT query_name, query_len IS DISTINCT FROM lag(query_len) OVER w AS differs, row_number() OVER w AS i FROM legacy_hits WHERE query_name IS NOT NULL WINDOW w AS (PARTITION BY query_name ORDER BY id))
SELECT query_name, count(*) AS n_hits, count(*) FILTER (differs AND i > 1) AS n_changes FROM c GROUP BY 1""",
    "p6_models": """
WITH n AS (SELECT query_name, query_len, count(*) AS n FROM legacy_hits WHERE query_name IS NOT NULL GROUP BY 1, 2),
k AS (SELECT query_name, sum(n) AS n, count(query_len) AS lengths FROM n GROUP BY 1),
b AS (SELECT query_name, query_len, n, row_number() OVER (PARTITION BY query_name ORDER BY n DESC, query_len) AS r FROM n WHERE query_len IS NOT NULL)
SELECT k.query_name, k.n::BIGINT AS n_hits, b.query_len AS usual_query_len, coalesce(b.n, 0) AS n_usual, k.lengths AS n_lengths
FROM k LEFT JOIN b ON b.query_name = k.query_name AND b.r = 1""",
}
