"""The store of confused pairs: counting, retention, grouped mismatches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_pairs(store: DataFrame, events: DataFrame) -> DataFrame:
    """The store after ``events`` (expected_card_id, actual_card_id, seen_at, seq).

    Counts add up, first_seen stays, last_seen is that of the event processed last (greatest seq).
    """
    key = ["expected_card_id", "actual_card_id"]
    new = events.groupBy(*key).agg(F.count("*").alias("n"), F.min_by("seen_at", "seq").alias("first_at"), F.max_by("seen_at", "seq").alias("last_at"))
    j = store.join(new, key, "full")
    return j.select(*key, (F.coalesce("seen_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("seen_count"), F.coalesce("first_seen_utc", "first_at").alias("first_seen_utc"), F.coalesce("last_at", "last_seen_utc").alias("last_seen_utc"))


def prior_counts(events: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Events with the number of times their pair had been seen before.

    Ranks are counted in two levels: within a stretch of a pair's events, and by the stretches before. A
    stretch is a minute, or 65,536 numbers of ``seq`` for events without a time (which come first); so a
    pair that a third of all events belong to is spread over many tasks.
    """
    key = ["expected_card_id", "actual_card_id"]
    dated = events.withColumn("__day", F.when(F.col("seen_at").isNull(), F.floor(F.col("seq") / 65_536) - F.lit(1 << 60)).otherwise(F.floor(F.unix_seconds(F.col("seen_at").cast("timestamp")) / 60)))
    days = dated.groupBy(*key, "__day").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*key).orderBy(F.col("__day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*(F.col(c).alias(f"__{c}") for c in key), F.col("__day").alias("__d"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*key, "__day").orderBy("seen_at", "seq")
    same = F.col("__day").eqNullSafe(F.col("__d"))
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    ranked = dated.withColumn("__r", F.row_number().over(within) - 1).join(days, same)
    out = ranked.withColumn("prior", F.col("__before") + F.col("__r")).select(*events.columns, "prior")
    if store is not None:
        out = out.join(store.select(*key, F.col("seen_count").alias("held")), key, "left").withColumn("prior", F.col("prior") + F.coalesce("held", F.lit(0))).drop("held")
    return out


def keep_newest(store: DataFrame, most: int) -> DataFrame:
    """The ``most`` pairs seen last; the retention is the feature, a top-k."""
    return store.orderBy(F.desc("last_seen_utc"), F.desc("first_seen_utc"), F.desc("expected_card_id"), F.desc("actual_card_id")).limit(most)


def grouped_mismatches(store: DataFrame, most: int = 12, least: int = 2) -> DataFrame:
    """Mismatches of the ``most`` expected cards with the strongest confusions, a row each.

    (expected_card_id, top, total, actual_card_id, seen_count); cards by greatest count, then total,
    then id. A card may have any number of mismatches, so they aren't gathered in one row.
    """
    wrong = store.where((F.col("expected_card_id") != F.col("actual_card_id")) & (F.col("seen_count") >= least))
    top = wrong.groupBy("expected_card_id").agg(F.max("seen_count").alias("top"), F.sum("seen_count").alias("total")).orderBy(F.desc("top"), F.desc("total"), "expected_card_id").limit(most)
    items = wrong.join(F.broadcast(top), "expected_card_id")  # at most `most` rows are broadcast
    return items.select("expected_card_id", "top", "total", "actual_card_id", "seen_count")
