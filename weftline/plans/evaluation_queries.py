"""Queries of the evaluation analytics, the pair store and the scan runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.keys import strip_all
from weftline.operators import evaluate as E
from weftline.operators import pairs as P
from weftline.operators.catalog import first_wins
from weftline.plans.registry import Registry
from weftline.session import table

query = Registry()
#: Rows before and after this time are compared as baseline and current.
CUT = "2024-07-01"


def mode_key(c="mode"):
    return F.coalesce(F.nullif(F.replace(F.lower(strip_all(F.col(c))), F.lit("-"), F.lit("_")), F.lit("")), F.lit("unknown"))


def facts(spark, d):
    """One row an evaluation, the earliest delivery, with a clean mode."""
    e = table(spark, d, "evaluations").where("eval_id is not null")
    cols = [c for c in e.columns if c not in ("eval_id", "ingested_at", "stage_timings")]
    best = e.groupBy("eval_id").agg(F.min_by(F.struct(*cols, "stage_timings"), "ingested_at").alias("r")).select("eval_id", "r.*")
    return best.withColumn("mode", mode_key())


_F = "(SELECT * REPLACE (coalesce(nullif(replace(lower(trim(mode)), '-', '_'), ''), 'unknown') AS mode) FROM evaluations WHERE eval_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY eval_id ORDER BY ingested_at) = 1)"
_PAPER = "(coalesce(expected_is_paper, true) AND (expected_games IS NULL OR len(expected_games) = 0 OR list_contains([lower(g) FOR g IN expected_games], 'paper')))"
_RUN = "CASE WHEN runtime_seconds >= 0 AND NOT isnan(runtime_seconds) THEN runtime_seconds END"
_SC, _SET = f"({_PAPER} AND coalesce(expected_name, '') <> '')", f"({_PAPER} AND coalesce(expected_set_code, '') <> '')"
_ART = f"({_SET} AND coalesce(expected_collector_number, '') <> '')"
_HIT = lambda c, p: f"count(*) FILTER ({p} AND {c})"
_RATIO = lambda n, dd: f"CASE WHEN {dd} > 0 THEN round({n} / {dd}, 4) ELSE 0.0 END"


_MEAN4 = lambda c: f"(2 * (sum(({c})::DECIMAL(20,8)) * 100000000)::HUGEINT + count({c}) * 10000) // (2 * count({c}) * 10000) / 10000.0"


def _summary_sql(src: str, by: str) -> str:
    sel = f"{by}, " if by else ""
    return f"""SELECT {sel}count(*) AS fixture_count, count(*) FILTER ({_SC}) AS scored_count, count(*) FILTER ({_SET}) AS set_scored_count, count(*) FILTER ({_ART}) AS art_scored_count,
 {_RATIO(_HIT('top1_hit', _SC), f'count(*) FILTER ({_SC})')} AS top1_accuracy, {_RATIO(_HIT('top5_hit', _SC), f'count(*) FILTER ({_SC})')} AS top5_accuracy,
 {_RATIO(_HIT('set_hit', _SET), f'count(*) FILTER ({_SET})')} AS set_accuracy, {_RATIO(_HIT('art_hit', _ART), f'count(*) FILTER ({_ART})')} AS art_accuracy,
 round(sum(coalesce(confidence, 0.0)) / count(*), 4) AS average_confidence, {_RATIO(f'sum(coalesce(confidence, 0.0)) FILTER ({_SC})', f'count(*) FILTER ({_SC})')} AS average_scored_confidence,
 {_MEAN4(_RUN)} AS average_runtime_seconds, round(avg(candidate_count), 1) AS average_candidate_count, round(median({_RUN}), 4) AS median_runtime_seconds,
 round(coalesce(stddev_pop({_RUN}), 0.0), 4) AS runtime_stddev_seconds, round(quantile_cont({_RUN}, 0.95), 4) AS runtime_p95_seconds, max({_RUN}) AS max_runtime_seconds FROM {src} {f'GROUP BY {by}' if by else ''}"""


@query(_summary_sql(_F, "mode"))
def ref_a5_a15_summary_by_mode(spark, d):
    return E.summary(facts(spark, d), ["mode"])


@query(_summary_sql(_F, "effective_backend"))
def ref_a15_summary_by_backend(spark, d):
    return E.summary(facts(spark, d), ["effective_backend"])


@query(f"SELECT mode, count(*) AS n, round(median({_RUN}), 4) AS median_seconds, round(coalesce(stddev_pop({_RUN}), 0.0), 4) AS stddev_seconds, round(quantile_cont({_RUN}, 0.95), 4) AS p95_seconds FROM {_F} GROUP BY 1")
def ref_a7_a8_a9_median_stddev_percentile(spark, d):
    r = E.measured("runtime_seconds")
    f = facts(spark, d)
    a = f.groupBy("mode").agg(F.count("*").alias("n"), F.round(F.coalesce(F.stddev_pop(r), F.lit(0.0)), 4).alias("stddev_seconds"))
    q = E.group_percentiles(f, ["mode"], r, {"median_seconds": 0.5, "p95_seconds": 0.95})
    return E.beside(a, q, ["mode"]).select("mode", "n", F.round("median_seconds", 4).alias("median_seconds"), "stddev_seconds", F.round("p95_seconds", 4).alias("p95_seconds"))


@query(f"SELECT 'roi' AS kind, active_roi AS value, count(*) AS n FROM {_F} WHERE active_roi IS NOT NULL GROUP BY ALL UNION ALL SELECT 'backend', coalesce(effective_backend, 'unknown'), count(*) FROM {_F} GROUP BY ALL UNION ALL SELECT 'error', error_class, count(*) FROM {_F} GROUP BY ALL")
def ref_a10_value_counts(spark, d):
    f = facts(spark, d)
    roi = E.value_counts(f.where("active_roi is not null"), [], F.col("active_roi")).withColumn("kind", F.lit("roi"))
    backend = E.value_counts(f, [], F.coalesce("effective_backend", F.lit("unknown"))).withColumn("kind", F.lit("backend"))
    return roi.unionByName(backend).unionByName(E.value_counts(f, [], F.col("error_class")).withColumn("kind", F.lit("error")))


_STAGE = f"(SELECT mode, evaluated_at, unnest(map_entries(stage_timings)) AS e FROM {_F})"


@query(f"SELECT mode, e.key AS stage, count(*) AS n, {_MEAN4("e.value")} AS mean_seconds FROM {_STAGE} WHERE e.value IS NOT NULL AND NOT isnan(e.value) GROUP BY ALL")
def ref_a11_average_stage_timings(spark, d):
    return E.average_map(facts(spark, d), ["mode"], "stage_timings")


@query(f"SELECT mode, round(avg(candidate_count), 1) AS mean_candidates FROM {_F} GROUP BY 1")
def ref_a12_mean_candidates(spark, d):
    return facts(spark, d).groupBy("mode").agg(F.round(F.avg("candidate_count"), 1).alias("mean_candidates"))


_LOW = "CASE WHEN confidence < 0.2 THEN 0.0 WHEN confidence < 0.4 THEN 0.2 WHEN confidence < 0.6 THEN 0.4 WHEN confidence < 0.8 THEN 0.6 ELSE 0.8 END"
_HIGH = "CASE WHEN confidence < 0.2 THEN 0.2 WHEN confidence < 0.4 THEN 0.4 WHEN confidence < 0.6 THEN 0.6 WHEN confidence < 0.8 THEN 0.8 ELSE 1.0 END"
_BINS = f"""SELECT mode, ({_LOW})::DOUBLE AS lower_bound, ({_HIGH})::DOUBLE AS upper_bound, count(*) AS n, {_MEAN4("confidence")} AS average_confidence, {_MEAN4("coalesce(top1_hit, false)::INT")} AS empirical_accuracy,
 round(abs({_MEAN4("confidence")} - {_MEAN4("coalesce(top1_hit, false)::INT")}), 4) AS calibration_gap FROM {_F} WHERE {_SC} AND confidence BETWEEN 0 AND 1 GROUP BY 1, 2, 3"""


@query(_BINS)
def ref_a13_calibration_bins(spark, d):
    return E.calibration_bins(facts(spark, d), ["mode"])


@query(f"SELECT mode, round(sum(calibration_gap * n) / sum(n), 4) AS calibration_error FROM ({_BINS}) GROUP BY 1")
def ref_a14_calibration_error(spark, d):
    return E.calibration_error(E.calibration_bins(facts(spark, d), ["mode"]), ["mode"])


def _halves(spark, d):
    f = facts(spark, d)
    at = F.col("evaluated_at") < F.lit(CUT).cast("timestamp")
    return f.where(at), f.where(~at)


_OLD, _NEW = f"(SELECT * FROM {_F} WHERE evaluated_at < TIMESTAMP '{CUT}')", f"(SELECT * FROM {_F} WHERE evaluated_at >= TIMESTAMP '{CUT}')"
_TALL = lambda src, v: "SELECT mode, metric, round(v, 4) AS " + v + f" FROM (SELECT mode, unnest([{', '.join(repr(m) for m in E.METRICS)}]) AS metric, unnest([{', '.join(m + '::DOUBLE' for m in E.METRICS)}]) AS v FROM ({_summary_sql(src, 'mode')}))"


@query(f"SELECT mode, metric, baseline_value, current_value, round(current_value - baseline_value, 4) AS delta FROM ({_TALL(_OLD, 'baseline_value')}) FULL JOIN ({_TALL(_NEW, 'current_value')}) USING (mode, metric)")
def ref_a16_metric_deltas(spark, d):
    old, new = _halves(spark, d)
    return E.metric_deltas(E.summary(old, ["mode"]), E.summary(new, ["mode"]), ["mode"])


_ST = lambda op: f"(SELECT mode, e.key AS stage, {_MEAN4("e.value")} AS m FROM {_STAGE} WHERE e.value IS NOT NULL AND NOT isnan(e.value) AND evaluated_at {op} TIMESTAMP '{CUT}' GROUP BY ALL)"


@query(f"SELECT coalesce(a.mode, b.mode) AS mode, coalesce(a.stage, b.stage) AS stage, coalesce(a.m, 0.0) AS baseline_seconds, coalesce(b.m, 0.0) AS current_seconds, round(coalesce(b.m, 0.0) - coalesce(a.m, 0.0), 4) AS delta FROM {_ST('<')} a FULL JOIN {_ST('>=')} b ON a.mode = b.mode AND a.stage = b.stage")
def ref_j17_stage_comparison(spark, d):
    old, new = _halves(spark, d)
    return E.stage_comparison(E.average_map(old, ["mode"], "stage_timings"), E.average_map(new, ["mode"], "stage_timings"), ["mode"])


@query(f"""SELECT mode, coalesce(active_roi, 'unknown') AS family, count(*) AS n, count(*) FILTER (top1_hit) AS correct, count(*) FILTER (NOT coalesce(top1_hit, false)) AS incorrect,
 round(count(*) FILTER (top1_hit) / count(*), 4) AS accuracy, {_MEAN4(_RUN)} AS average_runtime FROM {_F} GROUP BY ALL""")
def ref_a17_j19_family_rows(spark, d):
    hit = F.coalesce("top1_hit", F.lit(False))
    g = facts(spark, d).groupBy("mode", F.coalesce("active_roi", F.lit("unknown")).alias("family"))
    a = g.agg(F.count("*").alias("n"), F.count_if(hit).alias("correct"), F.count_if(~hit).alias("incorrect"), E.exact_mean(E.measured("runtime_seconds")).alias("average_runtime"))
    return a.withColumn("accuracy", F.round(F.col("correct") / F.col("n"), 4))


_FOUR = f"(SELECT error_class, unnest(['runtime_seconds', 'confidence', 'candidate_count', 'name_length']) AS metric, unnest([{_RUN}, CASE WHEN NOT isnan(confidence) THEN confidence END, candidate_count::DOUBLE, length(predicted_name)::DOUBLE]) AS v FROM {_F})"


@query(f"""SELECT error_class, metric, min(v) AS lo, round(quantile_cont(v, 0.1), 7) AS p10, {_MEAN4("v")} AS mean, round(median(v), 7) AS median, round(quantile_cont(v, 0.9), 7) AS p90, max(v) AS hi FROM {_FOUR} GROUP BY 1, 2""")
def ref_a18_metric_summary(spark, d):
    """Six figures of four columns per group."""
    four = {"runtime_seconds": E.measured("runtime_seconds"), "confidence": F.when(~F.isnan("confidence"), F.col("confidence")), "candidate_count": F.col("candidate_count").cast("double"), "name_length": F.length("predicted_name").cast("double")}
    tall = facts(spark, d).select("error_class", F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), c.alias("v")) for n, c in four.items()))))
    a = tall.groupBy("error_class", "metric").agg(F.min("v").alias("lo"), E.exact_mean(F.col("v")).alias("mean"), F.max("v").alias("hi"))
    q = E.group_percentiles(tall, ["error_class", "metric"], F.col("v"), {"p10": 0.1, "median": 0.5, "p90": 0.9})
    return E.beside(a, q, ["error_class", "metric"]).select("error_class", "metric", "lo", F.round("p10", 7).alias("p10"), "mean", F.round("median", 7).alias("median"), F.round("p90", 7).alias("p90"), "hi")


@query(f"SELECT expected_set_code, mode, count(*) AS n FROM {_F} GROUP BY ALL")
def ref_a19_two_level_counts(spark, d):
    """Rows of each set and mode; a missing mode is 'unknown'."""
    return facts(spark, d).groupBy("expected_set_code", "mode").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT eval_id, coalesce(predicted_name = expected_name, false) AS name_ok, coalesce(predicted_name = expected_name AND lower(predicted_set_code) = lower(expected_set_code), false) AS set_ok, coalesce(predicted_name = expected_name AND lower(predicted_set_code) = lower(expected_set_code) AND lower(predicted_collector_number) = lower(expected_collector_number), false) AS art_ok FROM {_F}")
def ref_d19_hit_flags(spark, d):
    return facts(spark, d).select("eval_id", *(c.alias(n) for n, c in E.hit_flags().items()))


_G = lambda c: f"coalesce({c}, '') <> ''"
_SETS = f"({_G('expected_set_code')} AND {_G('predicted_set_code')})"


@query(f"""SELECT eval_id, CASE WHEN NOT coalesce(expected_is_paper, true) THEN 'out_of_scope_nonpaper' WHEN coalesce(deadline_exceeded, false) THEN 'runtime_budget_exceeded' WHEN expected_name IS NULL THEN 'missing_expected_name'
 WHEN predicted_name IS NULL THEN 'no_prediction' WHEN predicted_name = expected_name AND {_SETS} AND lower(expected_set_code) <> lower(predicted_set_code) THEN 'wrong_set'
 WHEN predicted_name = expected_name AND {_SETS} AND {_G('expected_collector_number')} AND {_G('predicted_collector_number')} AND lower(expected_collector_number) <> lower(predicted_collector_number) THEN 'wrong_art'
 WHEN predicted_name = expected_name THEN 'correct_top1' WHEN coalesce(top5_hit, false) THEN 'correct_in_top5' ELSE 'wrong_top1' END AS derived_class FROM {_F}""")
def ref_d18_error_class(spark, d):
    return facts(spark, d).select("eval_id", E.error_class(F.coalesce("top5_hit", F.lit(False))).alias("derived_class"))


@query(f"SELECT eval_id, path, expected_name, predicted_name FROM {_F} WHERE {_SC} AND NOT coalesce(top1_hit, false) ORDER BY path, eval_id LIMIT 10")
def ref_k7_mismatch_preview(spark, d):
    bad = facts(spark, d).where(E.is_paper_row() & E.given("expected_name") & ~F.coalesce("top1_hit", F.lit(False)))
    return bad.orderBy("path", "eval_id").limit(10).select("eval_id", "path", "expected_name", "predicted_name")


def _scans(spark, d):
    return first_wins(table(spark, d, "scan_results"), "scan_id", "ingested_at", ["fixture", "mode", "elapsed_seconds", "expected_name", "predicted_name", "confidence", "name_hit", "failure_code", "scanned_at"]).withColumn("mode", mode_key())


_S = "(SELECT * REPLACE (coalesce(nullif(replace(lower(trim(mode)), '-', '_'), ''), 'unknown') AS mode) FROM scan_results QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ingested_at) = 1)"
_EL = "CASE WHEN elapsed_seconds >= 0 AND NOT isnan(elapsed_seconds) THEN elapsed_seconds END"


@query(f"SELECT mode, count(*) AS n, {_MEAN4('coalesce(name_hit, false)::INT')} AS accuracy, {_MEAN4(_EL)} AS mean, round(median({_EL}), 7) AS median, round(quantile_cont({_EL}, 0.95), 7) AS p95, max({_EL}) AS max FROM {_S} GROUP BY 1")
def ref_a22_stress_summary(spark, d):
    r = E.measured("elapsed_seconds")
    s = _scans(spark, d)
    a = s.groupBy("mode").agg(F.count("*").alias("n"), E.exact_mean(F.coalesce("name_hit", F.lit(False)).cast("int")).alias("accuracy"), E.exact_mean(r).alias("mean"), F.max(r).alias("max"))
    q = E.group_percentiles(s, ["mode"], r, {"median": 0.5, "p95": 0.95})
    return E.beside(a, q, ["mode"]).select("mode", "n", "accuracy", "mean", F.round("median", 7).alias("median"), F.round("p95", 7).alias("p95"), "max")


@query(f"SELECT scan_id, round(greatest(0.0, e.runtime_seconds - s.elapsed_seconds), 4) AS overhead, e.runtime_seconds - s.elapsed_seconds > greatest(1.0, 2 * s.elapsed_seconds) AS warn FROM {_S} s JOIN {_F} e ON e.eval_id = s.scan_id WHERE e.runtime_seconds >= 0 AND NOT isnan(e.runtime_seconds) AND s.elapsed_seconds >= 0 AND NOT isnan(s.elapsed_seconds)")
def ref_a24_i9_overhead_comparison(spark, d):
    """Two engines' times of one image: overhead of the first over the second and the warning."""
    s = _scans(spark, d).select("scan_id", E.measured("elapsed_seconds").alias("scan"))
    e = facts(spark, d).select(F.col("eval_id").alias("scan_id"), E.measured("runtime_seconds").alias("wall"))
    j = s.join(e, "scan_id").where("scan is not null and wall is not null")
    over = F.col("wall") - F.col("scan")
    return j.select("scan_id", F.round(F.greatest(F.lit(0.0), over), 4).alias("overhead"), (over > F.greatest(F.lit(1.0), F.col("scan") * 2)).alias("warn"))


def _store(spark, d):
    return table(spark, d, "simulated_card_pairs").groupBy("expected_card_id", "actual_card_id").agg(F.max("seen_count").alias("seen_count"), F.min("first_seen_utc").alias("first_seen_utc"), F.max("last_seen_utc").alias("last_seen_utc"))


_P = "(SELECT expected_card_id, actual_card_id, max(seen_count) AS seen_count, min(first_seen_utc) AS first_seen_utc, max(last_seen_utc) AS last_seen_utc FROM simulated_card_pairs GROUP BY ALL)"


@query(f"""WITH w AS (SELECT * FROM {_P} WHERE expected_card_id <> actual_card_id AND seen_count >= 2), g AS (SELECT expected_card_id, max(seen_count) AS top, sum(seen_count)::BIGINT AS total FROM w GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 12)
SELECT g.expected_card_id, top, total, actual_card_id, seen_count FROM w JOIN g USING (expected_card_id)""")
def ref_a20_grouped_mismatches(spark, d):
    return P.grouped_mismatches(_store(spark, d))


@query(f"SELECT expected_card_id, actual_card_id, seen_count FROM {_P} ORDER BY last_seen_utc DESC, first_seen_utc DESC, expected_card_id DESC, actual_card_id DESC LIMIT 10000")
def ref_w14_keep_newest_pairs(spark, d):
    return P.keep_newest(_store(spark, d), 10_000).select("expected_card_id", "actual_card_id", "seen_count")


def _events(spark, d):
    f = facts(spark, d).where("expected_name is not null and predicted_name is not null")
    return f.select(F.col("expected_name").alias("expected_card_id"), F.col("predicted_name").alias("actual_card_id"), F.col("evaluated_at").alias("seen_at"), F.col("eval_id").alias("seq"))


_EV = f"(SELECT expected_name AS expected_card_id, predicted_name AS actual_card_id, evaluated_at AS seen_at, eval_id AS seq FROM {_F} WHERE expected_name IS NOT NULL AND predicted_name IS NOT NULL)"


@query(f"SELECT seq, row_number() OVER (PARTITION BY expected_card_id, actual_card_id ORDER BY seen_at, seq) - 1 AS prior FROM {_EV}")
def ref_a21_prior_counts(spark, d):
    return P.prior_counts(_events(spark, d)).select("seq", "prior")


@query(f"""WITH n AS (SELECT expected_card_id, actual_card_id, count(*) AS n, arg_min(seen_at, seq) AS f, arg_max(seen_at, seq) AS l FROM {_EV} GROUP BY ALL)
SELECT coalesce(p.expected_card_id, n.expected_card_id) AS expected_card_id, coalesce(p.actual_card_id, n.actual_card_id) AS actual_card_id, coalesce(p.seen_count, 0) + coalesce(n.n, 0) AS seen_count,
 coalesce(p.first_seen_utc, n.f) AS first_seen_utc, coalesce(n.l, p.last_seen_utc) AS last_seen_utc FROM {_P} p FULL JOIN n ON n.expected_card_id = p.expected_card_id AND n.actual_card_id = p.actual_card_id""")
def ref_r4_a21_merge_pairs(spark, d):
    return P.merge_pairs(_store(spark, d), _events(spark, d))


_IDX = f"(SELECT lower(expected_set_code) || ':' || lower(expected_collector_number) AS k, min(path) AS path FROM {_F} WHERE expected_set_code IS NOT NULL AND expected_collector_number IS NOT NULL GROUP BY 1)"


@query(f"""SELECT p.expected_card_id, i.path, i.path IS NULL AS missing FROM (SELECT DISTINCT expected_card_id FROM {_P} WHERE expected_card_id <> actual_card_id AND seen_count >= 2) p
LEFT JOIN {_IDX} i ON lower(trim(p.expected_card_id)) = 'printing:' || i.k""")
def ref_j15_mismatch_fixture_index(spark, d):
    wrong = _store(spark, d).where("expected_card_id <> actual_card_id and seen_count >= 2").select("expected_card_id").distinct()
    key = F.concat(F.lit("printing:"), F.lower("expected_set_code"), F.lit(":"), F.lower("expected_collector_number"))
    index = facts(spark, d).where(key.isNotNull()).groupBy(key.alias("k")).agg(F.min("path").alias("path"))
    j = wrong.join(index, F.lower(F.trim("expected_card_id")) == F.col("k"), "left")
    return j.select("expected_card_id", "path", F.col("path").isNull().alias("missing"))


QUERIES, SQL = query.queries, query.sql
