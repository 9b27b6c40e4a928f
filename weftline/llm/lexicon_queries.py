"""Problem 2: recognised lines to the cards of the list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.keys import fold_key
from weftline.functions.text import normalize_text
from weftline.llm.lexicon import all_within, map_values
from weftline.plans.text_queries import norm_sql
from weftline.session import table


def card_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry, canonical): every identity's name, and its aliases by way of printing and identity."""
    cards = table(spark, sf_dir, "oracle_cards").where("normalized_name is not null and normalized_name <> ''")
    names = cards.select(F.col("normalized_name").alias("entry"), F.col("normalized_name").alias("canonical"))
    identity = cards.select(fold_key(F.col("oracle_id")).alias("oracle_key"), F.col("normalized_name").alias("canonical")).distinct()
    prints = table(spark, sf_dir, "printed_cards").select(F.col("id").alias("card_id"), fold_key(F.col("oracle_id")).alias("oracle_key")).where("oracle_key is not null")
    aliases = table(spark, sf_dir, "aliases").where("normalized_alias is not null and normalized_alias <> ''").select("card_id", F.col("normalized_alias").alias("entry")).distinct()
    paths = aliases.join(prints, "card_id").select("oracle_key", "entry").distinct().join(identity, "oracle_key").select("entry", "canonical")
    return names.unionByName(paths).distinct()


def _no_titles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Type lines and lines of rules text of the list."""
    cards = table(spark, sf_dir, "oracle_cards")
    return cards.select("type_line"), cards.select(F.explode(F.split("oracle_text", "\n")).alias("line"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card each recognition result shows, '' if its lines name none of the list."""
    types, rules = _no_titles(spark, sf_dir)
    results = table(spark, sf_dir, "recognition_results").where("obs_id is not null").select("obs_id", "ocr_lines")
    found = map_values(results, "obs_id", "ocr_lines", card_entries(spark, sf_dir), types, rules)
    return found.select("obs_id", F.col("canonical").alias("normalized_name"))


def p2_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of the list, names and aliases, within reach of each recognised line."""
    lines = table(spark, sf_dir, "recognition_results").select(F.explode("ocr_lines").alias("line"))
    return all_within(lines.select(normalize_text(F.col("line")).alias("text")), "text", card_entries(spark, sf_dir)).select("text", "entry", "distance")


P2_WITHIN_SQL = f"""
WITH k AS (SELECT id AS card_id, nullif(lower(trim(oracle_id, E' \\t\\n\\r')), '') AS k FROM printed_cards),
e AS (SELECT normalized_name AS entry FROM oracle_cards WHERE normalized_name <> ''
 UNION SELECT a.normalized_alias FROM aliases a JOIN k USING (card_id) JOIN (SELECT DISTINCT lower(trim(oracle_id, E' \\t\\n\\r')) AS k FROM oracle_cards WHERE normalized_name <> '') o ON o.k = k.k WHERE a.normalized_alias <> ''),
t AS (SELECT DISTINCT {norm_sql('l')} AS text FROM (SELECT unnest(ocr_lines) AS l FROM recognition_results) WHERE {norm_sql('l')} <> '')
SELECT text, entry, levenshtein(text, entry)::INT AS distance FROM t JOIN e ON abs(length(text) - length(entry)) <= length(entry) // 4 WHERE levenshtein(text, entry) <= length(entry) // 4
"""


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose lines name no card on the list, with the lines."""
    none = p2_found(spark, sf_dir).where("normalized_name = ''").select("obs_id")
    return table(spark, sf_dir, "recognition_results").select("obs_id", F.concat_ws(" | ", "ocr_lines").alias("lines")).distinct().join(none, "obs_id", "left_semi")


QUERIES = {"p2_found": p2_found, "p2_unmatched": p2_unmatched, "p2_within": p2_within}
SQL = {"p2_within": P2_WITHIN_SQL}
