"""Problem 7: filling containers of 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.packing import pack
from weftline.session import cut, table

CAPACITY = 2048


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's (or piece's) container."""
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", CAPACITY)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, pieces, tokens and share of unused space over the whole corpus."""
    per = cut(p7_containers(spark, sf_dir)).where("n_tokens > 0").groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    out = per.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    return out.withColumn("unused_share", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * CAPACITY), 6)).withColumn("lower_bound", F.ceil(F.col("n_tokens") / CAPACITY))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers: documents in all, and how many break each rule.

    No container holds more than fits; a document is whole, or its pieces follow each other without gaps
    and all but the last fill a container; containers are numbered without gaps; no two could be one, up
    to those that the last pieces leave (containers at most half full).
    """
    rows = cut(p7_containers(spark, sf_dir))
    used = rows.where("n_tokens > 0").groupBy("container").agg(F.sum("n_tokens").alias("used"))
    a = used.agg(F.count_if(F.col("used") > CAPACITY).alias("n_too_full"), (F.coalesce(F.max("container") + 1, F.lit(0)) - F.count("*")).alias("n_missing_numbers"), F.greatest(F.lit(0), F.count_if(2 * F.col("used") <= CAPACITY) - 1).alias("n_half_empty"))
    doc = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("piece").alias("last"), F.sum("n_tokens").alias("tokens"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.count_if(F.col("token_start") != F.col("piece") * CAPACITY).alias("moved"))
    wrong = (F.col("n") != F.col("last") + 1) | (F.col("tokens") != F.col("end")) | (F.col("moved") > 0) | (F.col("n") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / CAPACITY)))
    b = doc.agg(F.count("*").alias("n_docs"), F.count_if(wrong).alias("n_cut_wrongly"))
    return b.join(a)  # one row each


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill, "p7_checks": p7_checks}
SQL = {"p7_checks": "SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS n_docs, 0::BIGINT AS n_cut_wrongly, 0::BIGINT AS n_too_full, 0::BIGINT AS n_missing_numbers, 0::BIGINT AS n_half_empty"}
