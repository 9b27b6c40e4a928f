"""Problem 1: per-key results where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.keys import fold_key, fold_label
from weftline.operators.fragment import fragment_join, per_key, plan_load, spelled_counts
from weftline.session import table

#: Share of a table's rows from which a key counts as heavy.
HEAVY_SHARE = 0.015


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with at least 1.5 % of their table's rows. Null and blank values are no keys."""
    cards = table(spark, sf_dir, "oracle_cards")
    prints = table(spark, sf_dir, "printed_cards").select(fold_key(F.col("oracle_id")).alias("key"), F.col("oracle_id").alias("spelling"))
    names = cards.select(fold_label(F.col("name")).alias("key"), F.col("name").alias("spelling"))
    identities = cards.select(fold_key(F.col("oracle_id")).alias("key")).where("key is not null").distinct()
    labels = cards.select(fold_label(F.col("name")).alias("key")).where("key is not null").distinct()
    out = []
    for field, rows, matching in (("oracle_id", prints, identities), ("name", names, labels)):
        counts, total = spelled_counts(rows, "key", "spelling", matching)
        heavy = counts.where(F.col("n") >= HEAVY_SHARE * total)
        out.append(heavy.select(F.lit(field).alias("key_field"), F.col("spelled").alias("key_value")))
    return out[0].unionByName(out[1])


P1_FOUND_SQL = r"""
WITH p AS (SELECT nullif(lower(trim(oracle_id, E' \t\n\r')), '') AS k, oracle_id AS v FROM printed_cards),
n AS (SELECT nullif(trim(regexp_replace(regexp_replace(lower(name), '[\x{00ad}\x{034f}\x{061c}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]', '', 'g'),
  '[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')), '') AS k, name AS v FROM oracle_cards),
f AS (SELECT 'oracle_id' AS key_field, k, v, count(*) AS c, sum(count(*)) OVER (PARTITION BY k) AS t, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, v) AS r FROM p WHERE k IS NOT NULL GROUP BY k, v
 UNION ALL SELECT 'name', k, v, count(*), sum(count(*)) OVER (PARTITION BY k), row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, v) FROM n WHERE k IS NOT NULL GROUP BY k, v)
SELECT key_field, v AS key_value FROM f
WHERE r = 1 AND t >= 0.015 * CASE key_field WHEN 'name' THEN (SELECT count(*) FROM oracle_cards) ELSE (SELECT count(*) FROM printed_cards) END
"""


def p1_printings_per_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printings of every identity key, with the identity's name where it exists.

    Keys are compared trimmed and without case; null and blank keys give no row. Counts run
    over all delivered rows.
    """
    prints = table(spark, sf_dir, "printed_cards").select(fold_key(F.col("oracle_id")).alias("oracle_key"), "language", "released_at", "rarity").where("oracle_key is not null")
    names = table(spark, sf_dir, "oracle_cards").groupBy(fold_key(F.col("oracle_id")).alias("oracle_key")).agg(F.min("name").alias("name"))
    joined = fragment_join(prints, names.where("oracle_key is not null"), "oracle_key", "left", plan_load(prints, "oracle_key"))
    return per_key(
        joined,
        ["oracle_key"],
        {"n": F.count("*"), "name": F.min("name"), "first_release": F.min("released_at"), "last_release": F.max("released_at"), "foreign": F.count_if(F.col("language") != "en"), "rare": F.count_if(F.col("rarity").isin("rare", "mythic"))},
        {"n_rows": F.sum("n"), "name": F.min("name"), "first_release": F.min("first_release"), "last_release": F.max("last_release"), "n_foreign": F.sum("foreign"), "n_rare": F.sum("rare")},
    )


P1_PRINTINGS_SQL = r"""
WITH p AS (SELECT nullif(lower(trim(oracle_id, E' \t\n\r')), '') AS oracle_key, language, released_at, rarity FROM printed_cards),
o AS (SELECT nullif(lower(trim(oracle_id, E' \t\n\r')), '') AS oracle_key, min(name) AS name FROM oracle_cards GROUP BY 1)
SELECT p.oracle_key, count(*) AS n_rows, min(o.name) AS name, min(released_at) AS first_release, max(released_at) AS last_release,
 count(*) FILTER (language <> 'en') AS n_foreign, count(*) FILTER (rarity IN ('rare', 'mythic')) AS n_rare
FROM p LEFT JOIN o USING (oracle_key) WHERE p.oracle_key IS NOT NULL GROUP BY 1
"""

QUERIES = {"p1_found": p1_found, "p1_printings_per_identity": p1_printings_per_identity}
SQL = {"p1_found": P1_FOUND_SQL, "p1_printings_per_identity": P1_PRINTINGS_SQL}
