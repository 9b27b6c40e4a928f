"""Evaluation analytics: hit flags, error classes, summaries, calibration, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metrics that are compared between two summaries, by column.
METRICS = ("top1_accuracy", "top5_accuracy", "set_accuracy", "art_accuracy", "average_confidence", "average_scored_confidence", "average_runtime_seconds", "median_runtime_seconds", "runtime_stddev_seconds", "runtime_p95_seconds", "max_runtime_seconds")


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d to 4 places; 0 where d isn't positive."""
    return F.when(d > 0, F.round(n / d, 4)).otherwise(0.0)


def exact_mean(c: Column, places: int = 4) -> Column:
    """Mean, halves up, from an exact decimal sum: it doesn't depend on the order of the rows."""
    return F.round(F.sum(c.cast("decimal(20,8)")) / F.count(c), places).cast("double")


#: Width of a bin of values, as a share of the value.
BIN = 0.0005


def _bin(v: Column) -> Column:
    """Number of the bin a value is in; bins are in the order of their values, 0 has its own."""
    size = F.floor(F.log(F.abs(F.when(v != 0, v))) / BIN).cast("bigint") + 2_000_000  # above 0 for any double
    return F.when(v == 0, F.lit(0).cast("bigint")).when(v > 0, size).otherwise(-size)


def group_percentiles(df: DataFrame, by: list[str], value: Column, quantiles: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles of each group: (by, one column a quantile).

    Equal values are counted first, then the bins of each group; the running counts of the bins say
    which bins hold the wanted ranks, and only the values of these are sorted, a bin a task. So no
    task gets the values of a group, however many it has. Null and NaN values are left out, infinite
    ones count; groups without values are left out, null groups are groups.
    """
    v = value.cast("double")
    rows = df.select(F.struct(F.lit(0), *by).alias("g"), v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    rows = rows.withColumn("v", F.col("v") + F.lit(0.0)).withColumn("bin", F.when(F.abs("v") == float("inf"), F.when(F.col("v") > 0, F.lit(2**60)).otherwise(F.lit(-(2**60)))).otherwise(_bin(F.col("v"))))
    values = rows.groupBy("g", "bin", "v").agg(F.count("*").alias("n"))
    bins = values.groupBy("g", "bin").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("g", "bin", "n", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("g")).alias("all"))
    spots = []
    for i, q in enumerate(quantiles.values()):
        spot = F.lit(q) * (F.col("all") - 1)
        spots += [F.struct(F.lit(2 * i).alias("k"), F.floor(spot).alias("r")), F.struct(F.lit(2 * i + 1).alias("k"), F.ceil(spot).alias("r"))]
    here = F.filter(F.array(*spots), lambda s: (s["r"] >= F.col("before")) & (s["r"] < F.col("before") + F.col("n")))
    wanted = bins.select("g", "bin", "before", "all", here.alias("spots")).where(F.size("spots") > 0)
    within = Window.partitionBy("g", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.join(wanted, ["g", "bin"]).withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    got = ranked.select("g", "v", "all", "at", "n", F.explode("spots").alias("s")).where((F.col("s.r") >= F.col("at")) & (F.col("s.r") < F.col("at") + F.col("n")))
    pick = lambda k: F.max(F.when(F.col("s.k") == k, F.col("v")))
    per = got.groupBy("g").agg(F.max("all").alias("all"), *(pick(2 * i).alias(f"lo{i}") for i in range(len(quantiles))), *(pick(2 * i + 1).alias(f"hi{i}") for i in range(len(quantiles))))
    out = []
    for i, (name, q) in enumerate(quantiles.items()):
        spot = F.lit(q) * (F.col("all") - 1)
        part = spot - F.floor(spot)
        out.append(F.when(part == 0, F.col(f"lo{i}")).otherwise(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * part).alias(name))
    return per.select(*(F.col("g")[c].alias(c) for c in by), *out)


def beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Left join on ``by`` in which nulls are values."""
    r = right.withColumnsRenamed({c: f"__{c}" for c in by})
    on = left[by[0]].eqNullSafe(r[f"__{by[0]}"])
    for c in by[1:]:
        on = on & left[c].eqNullSafe(r[f"__{c}"])
    return left.join(r, on, "left").drop(*(f"__{c}" for c in by))


def given(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def is_paper_row() -> Column:
    """Whether a row is about a printed card: no games given, or paper among them."""
    games = F.col("expected_games")
    return F.coalesce(F.col("expected_is_paper"), F.lit(True)) & (games.isNull() | (F.size(games) == 0) | F.array_contains(F.transform(games, lambda g: F.lower(g)), "paper"))


def measured(c: str) -> Column:
    """A duration, null where it is no measurement."""
    return F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0), F.col(c))


def hit_flags() -> dict[str, Column]:
    """Name, set and number agreement; null parts of the prediction never agree."""
    name = F.coalesce(F.col("predicted_name") == F.col("expected_name"), F.lit(False))
    low = lambda c: F.lower(F.col(c))
    set_ = F.coalesce(name & (low("predicted_set_code") == low("expected_set_code")), F.lit(False))
    art = F.coalesce(set_ & (low("predicted_collector_number") == low("expected_collector_number")), F.lit(False))
    return {"name_ok": name, "set_ok": set_, "art_ok": art}


def error_class(in_top5: Column) -> Column:
    """The first of the ordered classes that applies."""
    low = lambda c: F.lower(F.col(c))
    sets = given("expected_set_code") & given("predicted_set_code")
    numbers = given("expected_collector_number") & given("predicted_collector_number")
    wrong_set = sets & (low("expected_set_code") != low("predicted_set_code"))
    wrong_art = sets & numbers & (low("expected_collector_number") != low("predicted_collector_number"))
    right = F.col("predicted_name") == F.col("expected_name")
    return (
        F.when(~F.coalesce("expected_is_paper", F.lit(True)), "out_of_scope_nonpaper")
        .when(F.coalesce("deadline_exceeded", F.lit(False)), "runtime_budget_exceeded")
        .when(F.col("expected_name").isNull(), "missing_expected_name")
        .when(F.col("predicted_name").isNull(), "no_prediction")
        .when(right & wrong_set, "wrong_set")
        .when(right & wrong_art, "wrong_art")
        .when(right, "correct_top1")
        .when(in_top5, "correct_in_top5")
        .otherwise("wrong_top1")
    )


def summary(facts: DataFrame, by: list[str]) -> DataFrame:
    """All metrics of evaluation rows per group: one aggregate, percentiles beside it."""
    paper = is_paper_row()
    scored, set_scored = paper & given("expected_name"), paper & given("expected_set_code")
    art_scored = set_scored & given("expected_collector_number")
    hit = lambda c, p: F.count_if(p & F.coalesce(F.col(c), F.lit(False)))
    run = measured("runtime_seconds")
    conf = F.coalesce("confidence", F.lit(0.0))
    a = facts.groupBy(*by).agg(
        F.count("*").alias("fixture_count"), F.count_if(scored).alias("scored_count"), F.count_if(set_scored).alias("set_scored_count"), F.count_if(art_scored).alias("art_scored_count"),
        hit("top1_hit", scored).alias("h1"), hit("top5_hit", scored).alias("h5"), hit("set_hit", set_scored).alias("hs"), hit("art_hit", art_scored).alias("ha"),
        F.sum(conf).alias("c"), F.sum(F.when(scored, conf)).alias("cs"), exact_mean(run).alias("average_runtime_seconds"), F.round(F.avg("candidate_count"), 1).alias("average_candidate_count"),
        F.round(F.coalesce(F.stddev_pop(run), F.lit(0.0)), 4).alias("runtime_stddev_seconds"), F.max(run).alias("max_runtime_seconds"),
    )
    q = group_percentiles(facts, by, run, {"median_runtime_seconds": 0.5, "runtime_p95_seconds": 0.95})
    a = beside(a, q.select(*by, *(F.round(c, 4).alias(c) for c in ("median_runtime_seconds", "runtime_p95_seconds"))), by)
    return a.select(
        *by, "fixture_count", "scored_count", "set_scored_count", "art_scored_count", safe_ratio(F.col("h1"), F.col("scored_count")).alias("top1_accuracy"), safe_ratio(F.col("h5"), F.col("scored_count")).alias("top5_accuracy"),
        safe_ratio(F.col("hs"), F.col("set_scored_count")).alias("set_accuracy"), safe_ratio(F.col("ha"), F.col("art_scored_count")).alias("art_accuracy"),
        safe_ratio(F.col("c"), F.col("fixture_count")).alias("average_confidence"), safe_ratio(F.col("cs"), F.col("scored_count")).alias("average_scored_confidence"),
        "average_runtime_seconds", "average_candidate_count", "median_runtime_seconds", "runtime_stddev_seconds", "runtime_p95_seconds", "max_runtime_seconds",
    )


def calibration_bins(facts: DataFrame, by: list[str]) -> DataFrame:
    """Confidence bins of width .2, the last closed, empty ones left out: averages rounded before the gap."""
    scored = facts.where(is_paper_row() & given("expected_name") & F.col("confidence").between(0, 1))
    c = F.col("confidence")
    low = F.when(c < 0.2, 0.0).when(c < 0.4, 0.2).when(c < 0.6, 0.4).when(c < 0.8, 0.6).otherwise(0.8)
    high = F.when(c < 0.2, 0.2).when(c < 0.4, 0.4).when(c < 0.6, 0.6).when(c < 0.8, 0.8).otherwise(1.0)
    g = scored.groupBy(*by, low.alias("lower_bound"), high.alias("upper_bound")).agg(F.count("*").alias("n"), exact_mean(F.col("confidence")).alias("average_confidence"), exact_mean(F.coalesce("top1_hit", F.lit(False)).cast("int")).alias("empirical_accuracy"))
    return g.withColumn("calibration_gap", F.round(F.abs(F.col("average_confidence") - F.col("empirical_accuracy")), 4))


def calibration_error(bins: DataFrame, by: list[str]) -> DataFrame:
    """Gap of the bins weighted by their rows."""
    return bins.groupBy(*by).agg(F.round(F.sum(F.col("calibration_gap") * F.col("n")) / F.sum("n"), 4).alias("calibration_error"))


def average_map(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Mean of each key of a map column over the rows that have it."""
    e = df.select(*by, F.explode(column).alias("stage", "seconds")).where(F.col("seconds").isNotNull() & ~F.isnan("seconds"))
    return e.groupBy(*by, "stage").agg(F.count("*").alias("n"), exact_mean(F.col("seconds")).alias("mean_seconds"))


def metric_deltas(baseline: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, baseline, current, delta): both rounded to 4 places, then their difference; null where a side lacks the group."""
    def tall(df: DataFrame, name: str) -> DataFrame:
        pairs = ", ".join(f"'{m}', cast(`{m}` as double)" for m in METRICS)
        return df.select(*by, F.expr(f"stack({len(METRICS)}, {pairs})").alias("metric", "v")).select(*by, "metric", F.round("v", 4).alias(name))

    j = tall(baseline, "baseline_value").join(tall(current, "current_value"), [*by, "metric"], "full")
    return j.withColumn("delta", F.round(F.col("current_value") - F.col("baseline_value"), 4))


def stage_comparison(baseline: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """Stages of either side with their means, 0 where a side lacks one."""
    a = baseline.select(*by, "stage", F.col("mean_seconds").alias("baseline_seconds"))
    b = current.select(*by, "stage", F.col("mean_seconds").alias("current_seconds"))
    j = a.join(b, [*by, "stage"], "full").fillna(0.0, ["baseline_seconds", "current_seconds"])
    return j.withColumn("delta", F.round(F.col("current_seconds") - F.col("baseline_seconds"), 4))


def value_counts(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    return df.groupBy(*by, value.alias("value")).agg(F.count("*").alias("n"))


def bin_comparison(baseline: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """Calibration bins that both sides have, with the difference of their gaps and accuracies."""
    key = [*by, "lower_bound", "upper_bound"]
    side = lambda df, name: df.select(*key, F.col("n").alias(f"{name}_n"), F.col("calibration_gap").alias(f"{name}_gap"), F.col("empirical_accuracy").alias(f"{name}_accuracy"))
    j = side(baseline, "baseline").join(side(current, "current"), key)
    return j.withColumn("gap_delta", F.round(F.col("current_gap") - F.col("baseline_gap"), 4)).withColumn("accuracy_delta", F.round(F.col("current_accuracy") - F.col("baseline_accuracy"), 4))
