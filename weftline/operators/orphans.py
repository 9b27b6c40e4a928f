"""Orphan references: references whose target is missing, arrives later or is deleted before.

The references are pre-aggregated per key and period first, so a key that a third of all rows
point to is a few rows a period from then on. Keys with many references (there can be no more than
``tasks * 4``) are checked by a broadcast of *their* verdicts only; all other keys meet their targets
in a shuffle join that the rows of heavy keys don't enter. Both outcomes are united. A period in which
every reference of a key has the same cause is decided without touching its rows; only periods in which
a target appears or disappears are decided row by row.

Whether a target is there is a running count: a target row adds one when it appears and takes one off
when it is deleted. The count is carried on in two levels, from day to day and within a day, so no task
gets all target rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut, tasks

#: Most verdicts and changes of heavy keys that are broadcast; beyond it their rows are salted.
MOST_BROADCAST = 200_000


def target_states(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """When a key's targets were there: a row a key, and a row a key and month with changes.

    ``targets`` has kind, key, appeared (timestamp) and deleted (timestamp or null), one row for
    each delivered target row. The first table has kind, key, first_at, open_from (from when on a row
    that is never deleted is there) and ends, the months in which the presence of deleted rows changed,
    each with whether one was there at its end. The second has kind, key, period and changes, the times
    of these changes in order, each with whether one was there from then on. Rows with a null key or no
    time of appearance are no targets.
    """
    t = targets.where(F.col("key").isNotNull() & F.col("appeared").isNotNull()).select("kind", "key", "appeared", "deleted")
    whole = t.groupBy("kind", "key").agg(F.min("appeared").alias("first_at"), F.min(F.when(F.col("deleted").isNull(), F.col("appeared"))).alias("open_from"))
    both = F.array(F.struct(F.col("appeared").alias("t"), F.lit(1).alias("d")), F.struct(F.col("deleted").alias("t"), F.lit(-1).alias("d")))
    events = t.where(F.col("deleted") > F.col("appeared")).select("kind", "key", F.inline(both)).groupBy("kind", "key", "t").agg(F.sum("d").alias("d")).where("d <> 0").withColumn("day", F.to_date("t"))
    upto = Window.partitionBy("kind", "key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = events.groupBy("kind", "key", "day").agg(F.sum("d").alias("d")).select("kind", "key", "day", F.coalesce(F.sum("d").over(upto), F.lit(0)).alias("before"))
    within = Window.partitionBy("kind", "key", "day").orderBy("t")
    run = events.join(days, ["kind", "key", "day"]).withColumn("n", F.col("before") + F.sum("d").over(within))
    was = F.coalesce(F.lag("n").over(within), F.col("before")) > 0
    turns = run.withColumn("was", was).where((F.col("n") > 0) != F.col("was"))
    changes = turns.groupBy("kind", "key", F.date_format("t", "yyyy-MM").alias("period")).agg(F.sort_array(F.collect_list(F.struct("t", (F.col("n") > 0).alias("there")))).alias("changes"))
    end = F.struct("period", F.element_at("changes", -1)["there"].alias("there"))
    ends = changes.groupBy("kind", "key").agg(F.sort_array(F.collect_list(end)).alias("ends"))
    return whole.join(ends, ["kind", "key"], "left"), changes


def cause_at(at: Column) -> Column:
    """Cause of a reference at time ``at`` from a key's state; null where the target is there.

    A reference without a time only can be missing.
    """
    past = F.filter("changes", lambda c: c["t"] <= at)
    there = (F.coalesce(F.col("open_from") <= at, F.lit(False))) | F.when(F.size(past) > 0, F.element_at(past, -1)["there"]).otherwise(F.col("before"))
    return F.when(F.col("first_at").isNull(), "missing").when(at.isNull() | there, None).when(F.col("first_at") > at, "late").otherwise("deleted")


def find_orphans(refs: DataFrame, targets: DataFrame, heavy_per_task: int = 4) -> DataFrame:
    """(ref_table, row_key, period, cause) of every reference whose target isn't there.

    ``refs`` has ref_table, row_key, kind, key and at; of repeated deliveries of a row the
    earliest time holds. Null keys are no references and give no row. An empty target table makes
    every reference missing. Extra columns on either side are ignored.
    """
    n_tasks = tasks(refs.sparkSession)
    rows = refs.where(F.col("key").isNotNull() & F.col("row_key").isNotNull()).groupBy("ref_table", "row_key", "kind", "key").agg(F.min("at").alias("at"))
    rows = cut(rows.withColumn("period", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit(""))))
    keys, heavy, light = orphan_verdicts(rows, targets, heavy_per_task, n_tasks)
    by = ["ref_table", "kind", "key", "period"]
    many, few = rows.join(keys, ["kind", "key"], "left_semi"), rows.join(keys, ["kind", "key"], "left_anti")
    heavy = cut(heavy)
    if (heavy.agg(F.sum(1 + F.greatest(F.size("changes"), F.lit(0)))).first()[0] or 0) <= MOST_BROADCAST:
        checked = many.join(F.broadcast(heavy), by)
    else:
        spread = many.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(4 * n_tasks)).cast("int"))
        checked = spread.join(heavy.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(4 * n_tasks - 1)))), [*by, "salt"]).drop("salt")
    hit = checked.unionByName(few.join(light, by))
    out = hit.withColumn("cause", F.when(F.col("mixed"), cause_at(F.col("at"))).otherwise(F.col("cause")))
    return out.where("cause is not null").select("ref_table", "row_key", F.nullif("period", F.lit("")).alias("period"), "cause").distinct()


def orphan_verdicts(rows: DataFrame, targets: DataFrame, heavy_per_task: int, n_tasks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The heavy keys, and verdicts on the keys and periods of heavy and of other keys that may hold orphans.

    A verdict is one cause, or mixed with the key's state.
    """
    per = rows.groupBy("ref_table", "kind", "key", "period").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    loads = per.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    total = rows.count()
    limit = max(1.0, total / (n_tasks * heavy_per_task))
    heavy_keys = [(r.kind, r.key) for r in loads.where(F.col("n") > limit).select("kind", "key").collect()] if total else []
    keys = F.broadcast(rows.sparkSession.createDataFrame(heavy_keys, "kind string, key string"))  # at most n_tasks * heavy_per_task

    def verdicts(how: str) -> DataFrame:
        states, changes = target_states(targets.join(keys, ["kind", "key"], how))
        j = per.join(keys, ["kind", "key"], how).join(states, ["kind", "key"], "left")
        earlier = F.filter("ends", lambda e: e["period"] < F.col("period"))
        j = j.withColumn("before", F.when(F.size(earlier) > 0, F.element_at(earlier, -1)["there"]).otherwise(F.lit(False)))
        kind = changes.schema["changes"].dataType
        j = j.withColumn("changes", F.array().cast(kind)).withColumn("cause", cause_at(F.col("lo")))
        inside = lambda c: F.coalesce((c > F.col("lo")) & (c <= F.col("hi")), F.lit(False))
        turned = F.coalesce(F.exists("ends", lambda e: e["period"] == F.col("period")), F.lit(False))
        j = j.where(turned | inside(F.col("open_from")) | inside(F.col("first_at")) | F.col("cause").isNotNull()).drop("changes", "cause")
        # What is left is little, so the changes of its months are joined only now.
        j = j.join(changes, ["kind", "key", "period"], "left").withColumn("changes", F.coalesce("changes", F.array().cast(kind)))
        # No change between the first and the last reference: all of them have one cause.
        mixed = F.exists("changes", lambda c: inside(c["t"])) | inside(F.col("open_from")) | inside(F.col("first_at"))
        out = j.withColumn("mixed", mixed).withColumn("cause", cause_at(F.col("lo")))
        return out.where("mixed or cause is not null").select("ref_table", "kind", "key", "period", "mixed", "cause", "first_at", "open_from", "before", "changes")

    return keys, verdicts("left_semi"), verdicts("left_anti")


def orphan_counts(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Orphans per table, period and cause: (ref_table, period, cause, n_refs)."""
    return find_orphans(refs, targets).groupBy("ref_table", "period", "cause").agg(F.count("*").alias("n_refs"))
