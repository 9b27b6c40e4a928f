"""Problem 8: held-out passages inside the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.leakage import find_leaks
from weftline.session import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "heldout_items"), "item_id", "text")


def p8_leaks_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold each leaked item."""
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"))


QUERIES = {"p8_found": p8_found, "p8_leaks_per_item": p8_leaks_per_item}
SQL: dict = {}
