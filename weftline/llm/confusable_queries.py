"""Problem 5: visually identical names with different characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.confusables import annotate, look_alike_groups, look_alike_rows
from weftline.session import table

NAMES = (("oracle_cards", "name"), ("printed_cards", "printed_name"), ("aliases", "alias"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, c in NAMES:
        part = table(spark, sf_dir, t).where(F.col(c).isNotNull()).select(F.lit(t).alias("ref_table"), F.col("id").alias("row_id"), F.col(c).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose name holds a character that isn't the ordinary one for what it shows."""
    return look_alike_rows(_names(spark, sf_dir), "value").select("ref_table", "row_id").distinct()


def p5_consistent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name's one consistent form and skeleton."""
    return annotate(_names(spark, sf_dir), "value").select("ref_table", "row_id", "value", "plain", "skeleton").distinct()


def p5_look_alike_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that look alike: rows, different originals and the form they are brought to."""
    return look_alike_groups(_names(spark, sf_dir), "value")


QUERIES = {"p5_found": p5_found, "p5_consistent_names": p5_consistent_names, "p5_look_alike_groups": p5_look_alike_groups}
SQL: dict = {}
