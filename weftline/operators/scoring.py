"""Confidence, margins, penalties and gates over ranked candidates.

Every function works on candidates with obs_id, ord (incoming position), name, score, set_code,
collector_number and notes, and partitions by obs_id only: an observation has a bounded number of
candidates, so no window grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What notes add to or take from a confidence.
CONFIDENCE_NOTES = {"exact": 0.05, "type_line_match": 0.03, "lower_text_match": 0.04, "set_symbol_match": 0.035, "art_match": 0.04, "layout_match": 0.02, "layout_mismatch": -0.08, "type_line_mismatch": -0.055, "lower_text_mismatch": -0.04}
CONFIRMATION_NOTES = {"exact": 0.03, "set_symbol_match": 0.05, "art_match": 0.05, "type_line_match": 0.025, "lower_text_match": 0.025}
SUPPORT_NOTES = ("type_line_match", "lower_text_match", "set_symbol_match", "art_match")


def ranked(candidates: DataFrame) -> DataFrame:
    """Add rn: by score, then name, then incoming position."""
    w = Window.partitionBy("obs_id").orderBy(F.desc("score"), "name", "ord")
    return candidates.withColumn("rn", F.row_number().over(w))


def by_score(candidates: DataFrame) -> DataFrame:
    """Add rn by score alone, equal scores in incoming order."""
    return candidates.withColumn("rn", F.row_number().over(Window.partitionBy("obs_id").orderBy(F.desc("score"), "ord")))


def distinct_printing(set_a: Column, number_a: Column, set_b: Column, number_b: Column) -> Column:
    """Whether set or number differ; nulls are values of their own."""
    return ~(set_a.eqNullSafe(set_b) & number_a.eqNullSafe(number_b))


def noted(weights: dict[str, float], notes: Column) -> Column:
    total = F.lit(0.0)
    for note, weight in weights.items():
        total = total + F.when(F.array_contains(notes, note), weight).otherwise(0.0)
    return total


def clamp(c: Column) -> Column:
    """Within 0 and 1, to 4 places; null stays null (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(c, 4))))


def _tops(candidates: DataFrame) -> DataFrame:
    """Candidates with rank, and the best one's fields beside each."""
    r = by_score(candidates)
    w = Window.partitionBy("obs_id").orderBy("rn")
    first = lambda c: F.first(c).over(w)
    return r.select("*", *(first(c).alias(f"best_{c}") for c in ("name", "score", "set_code", "collector_number", "notes")))


def confidence(candidates: DataFrame) -> DataFrame:
    """(obs_id, best_name, margin, same_name, penalty, confidence): one row an observation."""
    t = _tops(candidates)
    rival = (F.col("rn") > 1) & (F.col("name") == F.col("best_name")) & distinct_printing(F.col("set_code"), F.col("collector_number"), F.col("best_set_code"), F.col("best_collector_number")) & (F.col("best_score") - F.col("score") <= 0.12)
    per = t.groupBy("obs_id").agg(
        F.min_by("best_name", "rn").alias("best_name"), F.min_by("best_score", "rn").alias("best"), F.min_by("best_notes", "rn").alias("notes"),
        F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("score"))), F.lit(0.0)).alias("second"), F.count_if(rival).alias("same_name"),
    )
    has = lambda n: F.array_contains("notes", n)
    base = F.least(F.lit(0.16), F.col("same_name") * 0.035)
    penalty = F.when(F.col("same_name") == 0, 0.0).when(has("set_symbol_match") & has("art_match"), base * 0.4).when(has("set_symbol_match") | has("art_match"), base * 0.65).otherwise(base + 0.035)
    margin = F.greatest(F.lit(0.0), F.col("best") - F.col("second"))
    out = per.withColumn("margin", F.round(margin, 4)).withColumn("penalty", F.round(penalty, 4))
    value = F.col("best") + F.least(F.lit(0.08), margin * 0.24) + noted(CONFIDENCE_NOTES, F.col("notes")) - F.col("penalty")
    return out.select("obs_id", "best_name", "margin", "same_name", "penalty", clamp(value).alias("confidence"))


def skip_gates(candidates: DataFrame, confidences: DataFrame) -> DataFrame:
    """(obs_id, skip): whether the best candidate is settled without further reading."""
    t = ranked(candidates)
    per = t.groupBy("obs_id").agg(
        F.count("*").alias("n"), F.min_by("name", "rn").alias("name"), F.min_by("score", "rn").alias("score"), F.min_by("notes", "rn").alias("notes"),
        F.min_by(F.struct("name", "score"), F.when(F.col("rn") == 2, F.col("rn"))).alias("second"), F.sort_array(F.collect_list(F.struct("rn", "name", "score"))).alias("all"),
    )
    other = F.get(F.filter("all", lambda c: c["name"] != F.col("name")), F.lit(0))
    j = per.withColumn("other", other).join(confidences.select("obs_id", "confidence"), "obs_id")
    c, has = F.col("confidence"), lambda n: F.array_contains("notes", n)
    exact = has("exact") & ~has("noisy_title_ocr")
    support = F.arrays_overlap("notes", F.array(*map(F.lit, SUPPORT_NOTES)))
    rules = [
        (F.col("n") == 1) & exact & (c >= 0.9),
        (F.col("n") == 1) & (c >= 0.94) & support,
        (F.col("n") > 1) & (F.col("second.name") != F.col("name")) & exact & (F.col("score") - F.col("second.score") >= 0.16) & (c >= 0.9),
        F.col("other").isNotNull() & (c >= 0.88) & (F.col("score") - F.col("other.score") >= 0.18) & support,
        (c >= 0.92) & (has("set_symbol_match") | has("art_match")),
    ]
    skip = rules[0]
    for r in rules[1:]:
        skip = skip | r
    return j.select("obs_id", F.coalesce(skip, F.lit(False)).alias("skip"))


def matches_expected(c: str, e: str) -> Column:
    """Candidate columns ``c`` against expectation columns ``e``: an id decides alone, else what is given."""
    low = lambda x: F.lower(F.coalesce(F.col(x).cast("string"), F.lit("")))
    by_id = F.col(f"{e}scryfall_id").isNotNull()
    same = lambda f: F.col(f"{e}{f}").isNull() | (low(f"{c}{f}") == low(f"{e}{f}"))
    named = F.col(f"{e}name").isNull() | F.coalesce(F.col(f"{c}name") == F.col(f"{e}name"), F.lit(False))
    rest = same("oracle_id") & named & same("set_code") & same("collector_number")
    return F.when(by_id, low(f"{c}scryfall_id") == low(f"{e}scryfall_id")).otherwise(rest)


def expected_ranks(candidates: DataFrame) -> DataFrame:
    """(obs_id, n, expected_rank, expected_score, gap, best_other, margin) from candidates with is_expected."""
    r = by_score(candidates)
    w = Window.partitionBy("obs_id")
    e = F.min(F.when(F.col("is_expected"), F.col("rn"))).over(w)
    per = r.withColumn("e", e).groupBy("obs_id").agg(
        F.count("*").alias("n"), F.max("e").cast("int").alias("expected_rank"), F.max("score").alias("best"), F.max(F.when(F.col("rn") == F.col("e"), F.col("score"))).alias("expected_score"),
        F.coalesce(F.max(F.when(F.col("rn") != F.col("e"), F.col("score"))), F.lit(0.0)).alias("best_other"),
    )
    return per.select("obs_id", "n", "expected_rank", "expected_score", F.round(F.col("best") - F.col("expected_score"), 4).alias("gap"), "best_other", F.round(F.col("expected_score") - F.col("best_other"), 4).alias("margin"))


def promote_expected(candidates: DataFrame, window: float = 0.08, support_window: float = 0.16) -> DataFrame:
    """Candidates with the expected one just above the best if it is close enough; adds rank."""
    r = by_score(candidates)
    w = Window.partitionBy("obs_id")
    first = F.min(F.when(F.col("is_expected"), F.col("rn"))).over(w)
    top = F.max("score").over(w)
    support = F.size(F.array_intersect("notes", F.array(*map(F.lit, SUPPORT_NOTES))))
    gap = F.round(F.col("top") - F.col("score"), 4)
    lift = (F.col("rn") == F.col("first")) & (F.col("rn") > 1) & ((gap <= window) | ((gap <= support_window) & (support >= 1)))
    out = r.withColumn("first", first).withColumn("top", top).withColumn("promoted", F.coalesce(lift, F.lit(False)))
    out = out.withColumn("score", F.when(F.col("promoted"), F.least(F.lit(1.0), F.round(F.col("top") + 0.0001, 4))).otherwise(F.col("score")))
    final = Window.partitionBy("obs_id").orderBy(F.desc("score"), "rn")
    return out.withColumn("rank", F.row_number().over(final)).drop("first", "top", "rn")


def confirmation(candidates: DataFrame) -> DataFrame:
    """(obs_id, matches, confidence): how far the candidates confirm the expected one; 0 where absent."""
    r = by_score(candidates)
    w = Window.partitionBy("obs_id")
    e = F.min(F.when(F.col("is_expected"), F.col("rn"))).over(w)
    r = r.withColumn("e", e)
    mine = F.col("rn") == F.col("e")
    pick = lambda c: F.max(F.when(mine, F.col(c))).over(w)
    r = r.select("*", *(pick(c).alias(f"e_{c}") for c in ("name", "score", "set_code", "collector_number")))
    rival = ~mine & (F.col("name") == F.col("e_name")) & distinct_printing(F.col("set_code"), F.col("collector_number"), F.col("e_set_code"), F.col("e_collector_number")) & (F.col("e_score") - F.col("score") <= 0.05)
    per = r.groupBy("obs_id").agg(
        F.max("e").alias("e"), F.max("e_score").alias("own"), F.coalesce(F.max(F.when(~mine, F.col("score"))), F.lit(0.0)).alias("other"),
        F.max_by("notes", F.when(mine, 1)).alias("notes"), F.coalesce(F.bool_or(rival), F.lit(False)).alias("rival"),
    )
    margin = F.round(F.col("own") - F.col("other"), 4)
    value = F.col("own") + F.least(F.lit(0.12), F.greatest(F.lit(0.0), margin) * 0.3) + noted(CONFIRMATION_NOTES, F.col("notes"))
    value = value - F.when(F.col("e") > 1, F.least(F.lit(0.2), F.abs(margin) * 0.5) + 0.2).when(F.col("rival"), 0.08).otherwise(0.0)
    return per.select("obs_id", F.coalesce(F.col("e") == 1, F.lit(False)).alias("matches"), F.coalesce(clamp(value), F.lit(0.0)).alias("confidence"))


def compare_set(candidates: DataFrame, window: float, most: int) -> DataFrame:
    """Candidates of rank 1's name within ``window`` of its score, the first ``most``; none if only one."""
    t = ranked(candidates)
    w = Window.partitionBy("obs_id").orderBy("rn")
    near = t.withColumn("best_name", F.first("name").over(w)).withColumn("best", F.first("score").over(w))
    near = near.where((F.col("name") == F.col("best_name")) & (F.col("best") - F.col("score") <= window))
    k = F.row_number().over(w)
    kept = near.withColumn("k", k).where(F.col("k") <= most)
    n = F.count("*").over(Window.partitionBy("obs_id"))
    return kept.withColumn("n", n).where("n >= 2").drop("n", "best_name", "best")


def tie_gate(candidates: DataFrame, limit: float) -> DataFrame:
    """(obs_id, tied): whether the first two have one name and scores at most ``limit`` apart."""
    t = ranked(candidates).where("rn <= 2")
    per = t.groupBy("obs_id").agg(F.count("*").alias("n"), F.min("name").alias("a"), F.max("name").alias("b"), (F.max("score") - F.min("score")).alias("d"))
    return per.select("obs_id", ((F.col("n") == 2) & (F.col("a") == F.col("b")) & (F.round("d", 10) <= limit)).alias("tied"))


def visual_rerank(candidates: DataFrame, window: float, most: int, factor: float, least: float = 0.0, lead: float = 0.0) -> DataFrame:
    """Candidates with ``sim`` to their scores after comparing pictures; adds moved.

    Compared are the first ``most`` of rank 1's name within ``window`` of its score, if there are two.
    Nothing moves unless the strongest similarity is at least ``least`` and leads by ``lead``.
    """
    t = ranked(candidates)
    w = Window.partitionBy("obs_id").orderBy("rn")
    whole = Window.partitionBy("obs_id")
    near = (F.col("name") == F.first("name").over(w)) & (F.first("score").over(w) - F.col("score") <= window)
    t = t.withColumn("near", near.cast("int"))
    compared = (F.col("near") == 1) & (F.sum("near").over(w) <= most) & (F.sum("near").over(whole) >= 2)
    t = t.withColumn("s", F.when(compared, F.col("sim")))
    order = F.sort_array(F.collect_list("s").over(whole), asc=False)
    t = t.withColumn("top", F.get(order, F.lit(0))).withColumn("second", F.coalesce(F.get(order, F.lit(1)), F.lit(0.0)))
    moved = F.coalesce(F.col("s").isNotNull() & (F.col("top") >= least) & (F.col("top") - F.col("second") >= lead), F.lit(False))
    delta = F.round((F.col("sim") - 0.5) * factor, 4)
    return t.withColumn("moved", moved).withColumn("score", F.when(F.col("moved"), clamp(F.col("score") + delta)).otherwise(F.col("score"))).drop("near", "s", "top", "second", "rn")


def visual_pool(candidates: DataFrame, least: float = 0.92, lead: float = 0.06) -> DataFrame:
    """(obs_id, ord, similarity, margin, score) of observations that pictures alone decide.

    ``candidates`` has obs_id, ord and sim. The most similar (the first of equals) wins if it reaches
    ``least`` and leads the next by ``lead``, an only one by its whole similarity; its score is the
    similarity raised by half the margin, by ``lead`` at most. Null similarities don't take part.
    """
    w = Window.partitionBy("obs_id").orderBy(F.desc("sim"), "ord")
    r = candidates.where(F.col("sim").isNotNull()).select("obs_id", "ord", "sim", F.row_number().over(w).alias("rn"), F.coalesce(F.lead("sim").over(w), F.lit(0.0)).alias("next"))
    margin = F.round(F.col("sim") - F.col("next"), 4)
    won = r.where((F.col("rn") == 1) & (F.col("sim") >= least) & (margin >= lead))
    return won.select("obs_id", "ord", F.col("sim").alias("similarity"), margin.alias("margin"), clamp(F.col("sim") + F.least(F.lit(lead), margin * 0.5)).alias("score"))


def external_top(configured: Column, pool: Column, expected: Column) -> Column:
    """How many results to ask of an external engine: three a pool record, 100 at most; 20 where one card is expected."""
    own = F.greatest(F.lit(1), F.coalesce(configured, F.lit(1)))
    return F.when(F.coalesce(pool, F.lit(0)) > 0, F.greatest(own, F.least(F.lit(100), pool * 3))).when(expected, F.greatest(own, F.lit(20))).otherwise(own)
