"""Fragment-replicate by estimated load, for keys that hold most of the rows.

1. The load of every key is estimated by a count with map-side combine.
2. Keys above a task's fair share are *large*. There can be at most ``tasks * per_task`` of
   them, whatever the size of the data, so only they reach the driver.
3. Large keys are cut into shards proportionate to their load and the shards are packed on
   tasks, the heaviest first on the least loaded task. A shard is placed by choosing the salt
   whose hash together with the key falls into that task's partition, so that the plain hash
   exchange of the join carries it there.
4. The fragmented side gets one of its key's salts a row; the matching side is copied once to
   each salt of its key and nowhere else. Small keys have the one salt 0 and are not copied.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut, tasks

SALT = "__salt"


@dataclass(frozen=True)
class LoadPlan:
    """Salts of every large key. ``shards`` has (key, salts array), ``rows`` is all rows."""

    shards: DataFrame
    rows: int
    large: int
    key: str
    tasks: int


def pack_shards(loads: list[tuple], n_tasks: int, base: list[float], target: float) -> list[tuple]:
    """Shards of every key and the task of each: (key, shard, task), longest first on the emptiest task.

    ``base`` is what the small keys bring to each task.
    """
    pieces = []
    for key, load in loads:
        n = min(max(1, -(-load // max(1, int(target)))), n_tasks)
        pieces += [(load / n, key, i) for i in range(n)]
    pieces.sort(key=lambda p: (-p[0], str(p[1]), p[2]))
    heap = [(b, t) for t, b in enumerate(base)]
    heapq.heapify(heap)
    placed = []
    for load, key, i in pieces:
        at, t = heapq.heappop(heap)
        placed.append((key, i, t))
        heapq.heappush(heap, (at + load, t))
    return placed


def plan_load(df: DataFrame, key: str, n_tasks: int | None = None, per_task: int = 2) -> LoadPlan:
    """Estimate the load of ``df[key]`` and pack its large keys on ``n_tasks`` tasks.

    Null keys carry no load of a key and are left out. An empty table gives a plan without
    large keys.
    """
    spark = df.sparkSession
    n_tasks = n_tasks or tasks(spark)
    counts = cut(df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")))  # one pass, one row a key
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    target = max(1.0, total / n_tasks / per_task)
    large = F.col("n") > target
    loads = [(r.k, r.n) for r in counts.where(F.col("k").isNotNull() & large).collect()] if total else []
    # Small keys have the salt 0, so their task is known: a row a task.
    base = [0.0] * n_tasks
    for r in counts.where(F.col("k").isNotNull() & ~large).groupBy(_task(n_tasks, "k", F.lit(0)).alias("t")).agg(F.sum("n").alias("n")).collect() if loads else []:
        base[r.t] = float(r.n)
    wanted = pack_shards(loads, n_tasks, base, target)
    kind = counts.schema["k"].dataType.simpleString()
    shards = spark.createDataFrame(_salts(spark, wanted, n_tasks, kind), f"__key {kind}, __salts array<int>")
    return LoadPlan(shards, total, len(loads), key, n_tasks)


def _task(n_tasks: int, *columns) -> Column:
    """The partition that a hash exchange by these columns leads to."""
    return F.pmod(F.hash(*columns), F.lit(n_tasks))


def _salts(spark, wanted: list[tuple], n_tasks: int, kind: str) -> list[tuple]:
    """A distinct salt for each shard whose hash with the key leads to the shard's task.

    Keys keep their type, as the hash depends on it. Salts are tried where the data are; only one for
    each shard comes back.
    """
    if not wanted:
        return []
    need: dict[tuple, int] = {}
    for key, _, task in wanted:
        need[key, task] = need.get((key, task), 0) + 1
    places = spark.createDataFrame([(k, p, n) for (k, p), n in need.items()], f"k {kind}, p int, need int")
    keys = places.select("k").distinct().select("k", F.explode(F.sequence(F.lit(1), F.lit(8 * n_tasks))).alias("s"))
    at = keys.select("k", "s", _task(n_tasks, "k", "s").alias("p"))
    found = at.join(F.broadcast(places), ["k", "p"]).groupBy("k", "p", "need").agg(F.sort_array(F.collect_list("s")).alias("s"))
    salts: dict = {}
    for r in found.orderBy("k", "p").select("k", F.slice("s", F.lit(1), F.col("need")).alias("s")).collect():
        salts.setdefault(r.k, []).extend(r.s)
    out = []
    for key in dict.fromkeys(k for k, _, _ in wanted):
        mine = salts.get(key, [])
        short = sum(n for (k, _), n in need.items() if k == key) - len(mine)
        out.append((key, mine + list(range(8 * n_tasks + 1, 8 * n_tasks + 1 + short))))  # no salt leads there: any splits the key
    return out


def fragment(df: DataFrame, plan: LoadPlan, key: str | None = None) -> DataFrame:
    """Give each row one salt of its key, by a hash of the row and its place in its partition.

    Columns named ``__salt``, ``__salts`` or ``__key`` are replaced.
    """
    key = key or plan.key
    df = df.drop(SALT, "__salts", "__key")
    hashed = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    row = F.xxhash64(*hashed, F.monotonically_increasing_id())
    spread = F.pmod(row, F.size("__salts").cast("bigint")).cast("int")
    held = df.join(F.broadcast(plan.shards), F.col(key) == F.col("__key"), "left")
    anywhere = F.pmod(row, F.lit(64 * plan.tasks)).cast("int")  # null keys match nothing, so they may go anywhere
    return held.withColumn(SALT, F.when(F.col(key).isNull(), anywhere).when(F.col("__salts").isNull(), F.lit(0)).otherwise(F.get("__salts", spread))).drop("__key", "__salts")


def replicate(df: DataFrame, plan: LoadPlan, key: str) -> DataFrame:
    """Copy each row to the salts of its key, rows of small keys once."""
    df = df.drop(SALT, "__salts", "__key")
    held = df.join(F.broadcast(plan.shards), F.col(key) == F.col("__key"), "left")
    return held.withColumn(SALT, F.explode(F.coalesce("__salts", F.array(F.lit(0))))).drop("__key", "__salts")


def fragment_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", plan: LoadPlan | None = None) -> DataFrame:
    """Join ``left`` to ``right`` on ``key`` without a task that holds one key's rows.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``: the kinds for which copying
    the right side is exact. Null keys match nothing and are spread over all tasks. Columns of the right side that clash with
    the left's get the suffix ``_right``. The result keeps ``__salt``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"the right side is copied; a {how} join would repeat its rows")
    plan = plan or plan_load(left, key)
    clash = {c for c in right.columns if c in left.columns and c != key}
    right = right.withColumnsRenamed({c: f"{c}_right" for c in clash})
    # A fixed number of partitions: the placement holds, as no reader coalesces them.
    a, b = (x.repartition(plan.tasks, key, SALT) for x in (fragment(left, plan), replicate(right, plan, key)))
    return a.join(b, [key, SALT], how)


def per_key(joined: DataFrame, keys: list[str], partial: dict[str, Column], final: dict[str, Column]) -> DataFrame:
    """Aggregate by key and salt, then by key: no task sees all the rows of a key."""
    once = joined.groupBy(*keys, SALT).agg(*(c.alias(n) for n, c in partial.items()))
    return once.groupBy(*keys).agg(*(c.alias(n) for n, c in final.items()))


def spelled_counts(df: DataFrame, key: str, spelling: str, matching: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Rows of every key and the spelling most of them have, and the number of all rows.

    The rows go through :func:`fragment_join` to ``matching`` (one row a key, column ``key``);
    rows whose key isn't there count all the same. Null keys give no row. Of spellings with
    equally many rows the smallest is taken.
    """
    plan = plan_load(df, key)
    rows = df.where(F.col(key).isNotNull())
    joined = fragment(rows, plan) if matching is None else fragment_join(rows, matching, key, "left", plan)
    by_form = per_key(joined, [key, spelling], {"n": F.count("*")}, {"n": F.sum("n")})
    by_key = by_form.groupBy(key).agg(F.sum("n").alias("n"), F.min_by(spelling, F.struct(-F.col("n"), F.col(spelling))).alias("spelled"))
    return by_key, plan.rows
