"""Problem 4: percentiles of durations per mode, per day, and merged from days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.keys import strip_all
from weftline.llm.multiselect import digest, digest_percentiles, merge_digests, percentiles
from weftline.session import cut, table

QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, mode, day, seconds): one row a measurement, the earliest delivery of each id.

    Modes are compared without case, padding and with `-` as `_`; a missing mode is `unknown`.
    Null, NaN and negative durations are no measurements.
    """
    out = None
    for name, key, value, at in (("evaluations", "eval_id", "runtime_seconds", "evaluated_at"), ("scan_results", "scan_id", "elapsed_seconds", "scanned_at")):
        t = table(spark, sf_dir, name).groupBy(key).agg(F.min(F.struct("ingested_at", at, "mode", value)).alias("r"))
        mode = F.coalesce(F.nullif(F.replace(F.lower(strip_all(F.col("r.mode"))), F.lit("-"), F.lit("_")), F.lit("")), F.lit("unknown"))
        part = t.select(F.lit(name).alias("source"), mode.alias("mode"), F.to_date(f"r.{at}").alias("day"), F.col(f"r.{value}").alias("seconds"))
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("seconds").isNotNull() & ~F.isnan("seconds") & (F.col("seconds") >= 0))


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles per source and mode (day null), and per source, mode and day."""
    rows = cut(durations(spark, sf_dir))
    whole = percentiles(rows, ["source", "mode"], "seconds", QUANTILES).withColumn("day", F.lit(None).cast("date"))
    daily = percentiles(rows, ["source", "mode", "day"], "seconds", QUANTILES)
    out = whole.unionByName(daily)
    return out.select("source", "mode", "day", "n", *(F.round(q, 6).alias(q) for q in QUANTILES))


_ROWS = """
WITH e AS (SELECT 'evaluations' AS source, mode, evaluated_at AS ts, runtime_seconds AS s FROM evaluations QUALIFY row_number() OVER (PARTITION BY eval_id ORDER BY ingested_at) = 1
 UNION ALL SELECT 'scan_results', mode, scanned_at, elapsed_seconds FROM scan_results QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ingested_at) = 1),
d AS (SELECT source, coalesce(nullif(replace(lower(trim(mode)), '-', '_'), ''), 'unknown') AS mode, ts::DATE AS day, s FROM e WHERE s >= 0 AND NOT isnan(s) AND s IS NOT NULL)
"""
_Q = ", ".join(f"round(quantile_cont(s, {v}), 6) AS {k}" for k, v in QUANTILES.items())
P4_SQL = _ROWS + f"SELECT source, mode, NULL::DATE AS day, count(*) AS n, {_Q} FROM d GROUP BY ALL UNION ALL SELECT source, mode, day, count(*), {_Q} FROM d GROUP BY ALL"


def p4_daily_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mergeable digests (relative error 0.5 %) per source, mode and day."""
    return digest(durations(spark, sf_dir), ["source", "mode", "day"], "seconds")


_BIN = "CASE WHEN s = 0 THEN -2147483648 ELSE ceil(ln(s) / ln(1.005 / 0.995))::INT END"
P4_DIGEST_SQL = _ROWS + f"SELECT source, mode, day, {_BIN} AS bin, count(*) AS n FROM d GROUP BY ALL"


def p4_merged_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per source and mode from the merged daily digests, with the error bound."""
    merged = merge_digests(p4_daily_digests(spark, sf_dir), ["source", "mode"])
    out = digest_percentiles(merged, ["source", "mode"], QUANTILES)
    return out.select("source", "mode", "n", *(F.round(q, 6).alias(q) for q in QUANTILES), F.lit(0.005).alias("relative_error"))


QUERIES = {"p4_percentiles": p4_percentiles, "p4_daily_digests": p4_daily_digests, "p4_merged_from_days": p4_merged_from_days}
_MQ = ", ".join(f"round(CASE b{i} WHEN -2147483648 THEN 0.0 ELSE exp(b{i} * ln(1.005 / 0.995)) * 0.995 END, 6) AS {k}" for i, k in enumerate(QUANTILES))
_MB = ", ".join(f"(list_sort(list({_BIN})))[1 + floor({v} * (count(*) - 1))::INT] AS b{i}" for i, v in enumerate(QUANTILES.values()))
SQL = {
    "p4_percentiles": P4_SQL,
    "p4_daily_digests": P4_DIGEST_SQL,
    "p4_merged_from_days": _ROWS + f", m AS (SELECT source, mode, count(*) AS n, {_MB} FROM d GROUP BY ALL) SELECT source, mode, n, {_MQ}, 0.005::DOUBLE AS relative_error FROM m",
}
