"""Problem 3: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.keys import fold_key
from weftline.operators.orphans import find_orphans, orphan_counts
from weftline.session import table


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All references as (ref_table, row_key, kind, key, at)."""
    prints = table(spark, sf_dir, "printed_cards").select(F.lit("printed_cards").alias("ref_table"), F.col("id").cast("string").alias("row_key"), F.lit("identity").alias("kind"), fold_key(F.col("oracle_id")).alias("key"), F.col("ingested_at").alias("at"))
    aliases = table(spark, sf_dir, "aliases").select(F.lit("aliases").alias("ref_table"), F.col("id").cast("string").alias("row_key"), F.lit("printing_id").alias("kind"), F.col("card_id").cast("string").alias("key"), F.col("ingested_at").alias("at"))
    label = fold_key(F.col("expected_card_id"))
    kind = F.when(label.startswith("printing:"), "printing").when(label.startswith("name:"), "name")
    key = F.nullif(F.regexp_replace(label, "^(printing|name):", ""), F.lit(""))
    pairs = table(spark, sf_dir, "simulated_card_pairs").select(F.lit("simulated_card_pairs").alias("ref_table"), F.concat(F.col("expected_card_id"), F.lit(">"), F.coalesce("actual_card_id", F.lit(""))).alias("row_key"), kind.alias("kind"), key.alias("key"), F.col("first_seen_utc").alias("at"))
    # Padding may also stand around the parts of a label.
    parts = F.transform(F.split("key", ":"), lambda p: F.trim(p))
    pairs = pairs.withColumn("key", F.array_join(parts, ":")).where("kind is not null")
    return prints.unionByName(aliases).unionByName(pairs)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All targets as (kind, key, appeared, deleted)."""
    cards = table(spark, sf_dir, "oracle_cards")
    prints = table(spark, sf_dir, "printed_cards")
    span = [F.col("ingested_at").alias("appeared"), F.col("deleted_at").alias("deleted")]
    place = F.concat_ws(":", fold_key(F.col("set_code")), fold_key(F.col("collector_number")))
    whole = F.when(fold_key(F.col("set_code")).isNotNull() & fold_key(F.col("collector_number")).isNotNull(), place)
    return (
        cards.select(F.lit("identity").alias("kind"), fold_key(F.col("oracle_id")).alias("key"), *span)
        .unionByName(cards.select(F.lit("name").alias("kind"), fold_key(F.col("normalized_name")).alias("key"), *span))
        .unionByName(prints.select(F.lit("printing_id").alias("kind"), F.col("id").cast("string").alias("key"), *span))
        .unionByName(prints.select(F.lit("printing").alias("kind"), whole.alias("key"), *span))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_orphans(references(spark, sf_dir), targets(spark, sf_dir))


def p3_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(references(spark, sf_dir), targets(spark, sf_dir))


_ROWS = r"""
WITH r AS (
 SELECT 'printed_cards' AS ref_table, id::VARCHAR AS row_key, 'identity' AS kind, nullif(lower(trim(oracle_id, E' \t\n\r')), '') AS k, min(ingested_at) AS t FROM printed_cards GROUP BY ALL
 UNION ALL SELECT 'aliases', id::VARCHAR, 'printing_id', card_id::VARCHAR, min(ingested_at) FROM aliases GROUP BY ALL
 UNION ALL SELECT 'simulated_card_pairs', row_key, CASE WHEN l LIKE 'printing:%' THEN 'printing' WHEN l LIKE 'name:%' THEN 'name' END, nullif(regexp_replace(l, '^(printing|name):\s*', ''), ''), min(first_seen_utc)
  FROM (SELECT expected_card_id || '>' || coalesce(actual_card_id, '') AS row_key, lower(trim(expected_card_id, E' \t\n\r')) AS l, first_seen_utc FROM simulated_card_pairs)
  WHERE l LIKE 'printing:%' OR l LIKE 'name:%' GROUP BY ALL),
t AS (SELECT 'identity' AS kind, lower(trim(oracle_id, E' \t\n\r')) AS k, ingested_at AS a, deleted_at AS d FROM oracle_cards
 UNION ALL SELECT 'name', lower(trim(normalized_name, E' \t\n\r')), ingested_at, deleted_at FROM oracle_cards
 UNION ALL SELECT 'printing_id', id::VARCHAR, ingested_at, deleted_at FROM printed_cards
 UNION ALL SELECT 'printing', lower(trim(set_code, E' \t\n\r')) || ':' || lower(trim(collector_number, E' \t\n\r')), ingested_at, deleted_at FROM printed_cards),
u AS (SELECT kind, k, a, d FROM t WHERE k <> '' AND a IS NOT NULL GROUP BY ALL),
j AS (SELECT r.ref_table, r.row_key, r.k, r.t, min(u.a) AS first_a, count(*) FILTER (u.a <= r.t AND (u.d IS NULL OR u.d > r.t)) AS alive
 FROM r LEFT JOIN u ON r.kind = u.kind AND r.k = u.k WHERE r.k IS NOT NULL GROUP BY ALL),
o AS (SELECT ref_table, row_key, strftime(t, '%Y-%m') AS period, CASE WHEN first_a IS NULL THEN 'missing' WHEN t IS NULL OR alive > 0 THEN NULL WHEN first_a > t THEN 'late' ELSE 'deleted' END AS cause FROM j)
"""
P3_FOUND_SQL = _ROWS + "SELECT DISTINCT ref_table, row_key, period, cause FROM o WHERE cause IS NOT NULL"
P3_MONTH_SQL = _ROWS + "SELECT ref_table, period, cause, count(DISTINCT row_key) AS n_refs FROM o WHERE cause IS NOT NULL GROUP BY ALL"

QUERIES = {"p3_found": p3_found, "p3_orphans_by_month": p3_orphans_by_month}
SQL = {"p3_found": P3_FOUND_SQL, "p3_orphans_by_month": P3_MONTH_SQL}
