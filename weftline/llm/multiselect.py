"""Exact percentiles per group by distributed multi-select, and digests that can be merged.

Multi-select: every batch of a partition proposes the median of its values that are still in
question, with their number as weight; the weighted median of the proposals becomes the pivot; the
values below, equal to and above the pivot are counted; the ruled-out range is discarded. This is
repeated for all groups and ranks at once until each is found. A pass counts for one pivot and at
the same time takes the proposals for both ranges that may remain, so a round is one pass without a
shuffle of values: what is exchanged is a row for each partition and open rank. A pivot discards a
quarter of the values at least, so the rounds grow with the logarithm of the rows. Ranges that hold
at most ``small`` values are read out and sorted within their group.

The percentiles are exact: error 0 in rank and value. :func:`digest` gives summaries of fixed
relative error that may be added up over days or partitions; see :func:`digest_percentiles`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut, drop_folder, shared_folder

#: Ranges with at most so many values are read out.
SMALL = 256


@dataclass
class _Targets:
    """Open ranks, by group: of group ``gid`` the value of 0-based ``rank`` among those in (lo, hi)."""

    gid: np.ndarray
    rank: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    pivot: np.ndarray
    left: np.ndarray
    value: np.ndarray


def _bisect(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, right: bool) -> np.ndarray:
    """Of many sorted slices v[lo:hi] at once the place of ``x``."""
    lo, hi = lo.copy(), hi.copy()
    while (busy := lo < hi).any():
        mid = (lo + hi) >> 1
        at = v[np.minimum(mid, len(v) - 1)]
        up = busy & ((at <= x) if right else (at < x))
        lo, hi = np.where(up, mid + 1, lo), np.where(busy & ~up, mid, hi)
    return lo


def _sorted_batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        g, v = b["gid"].to_numpy(), b["value"].to_numpy()
        if not len(g):
            continue
        if len(g) > 1 and not (np.diff(g) >= 0).all():
            o = np.lexsort((v, g))
            g, v = g[o], v[o]
        yield g, v


def _spans(g: np.ndarray, v: np.ndarray, gid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(target, start, end) of the values of a sorted batch that are still in question; gid is sorted."""
    a, b = np.searchsorted(gid, g[0], "left"), np.searchsorted(gid, g[-1], "right")
    first, last = np.searchsorted(g, gid[a:b], "left"), np.searchsorted(g, gid[a:b], "right")
    start = _bisect(v, first, last, lo[a:b], True)
    end = np.maximum(start, _bisect(v, first, last, hi[a:b], False))
    some = np.flatnonzero(end > start)
    return some + a, start[some], end[some]


def _round(data: DataFrame, t: _Targets, open_: np.ndarray) -> pa.Table:
    """One pass: below, equal, above, next pivot below, next pivot above of each open target."""
    gid, lo, hi, pivot = t.gid[open_], t.lo[open_], t.hi[open_], t.pivot[open_]

    def count(batches):
        for g, v in _sorted_batches(batches):
            k, s, e = _spans(g, v, gid, lo, hi)
            a, b = _bisect(v, s, e, pivot[k], False), _bisect(v, s, e, pivot[k], True)
            low = np.where(a > s, v[np.minimum(s + (a - s) // 2, len(v) - 1)], np.nan)
            up = np.where(e > b, v[np.minimum(b + (e - b) // 2, len(v) - 1)], np.nan)
            yield pd.DataFrame({"target": k.astype(np.int32), "below": a - s, "equal": b - a, "above": e - b, "lower": low, "upper": up})

    rows = data.mapInPandas(count, "target int, below bigint, equal bigint, above bigint, lower double, upper double")
    weight = lambda v, n: F.expr(f"percentile(if(isnan({v}), null, {v}), 0.5, {n})")
    agg = rows.groupBy("target").agg(F.sum("below").alias("b"), F.sum("equal").alias("e"), F.sum("above").alias("a"), weight("lower", "below").alias("lower"), weight("upper", "above").alias("upper"))
    return agg.toArrow()  # at most the open ranks


def _read_out(data: DataFrame, t: _Targets, few: np.ndarray) -> None:
    """Find the targets whose range is small: the values of each range once, sorted, and the ranks looked up."""
    key = np.rec.fromarrays([t.gid[few], t.lo[few], t.hi[few]])
    _, first, of = np.unique(key, return_index=True, return_inverse=True)
    gid, lo, hi = t.gid[few][first], t.lo[few][first], t.hi[few][first]

    def emit(batches):
        for g, v in _sorted_batches(batches):
            k, s, e = _spans(g, v, gid, lo, hi)
            n = e - s
            at = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield pd.DataFrame({"range": np.repeat(k, n).astype(np.int32), "value": v[at]})

    spark = data.sparkSession
    ranks = spark.createDataFrame(pa.table({"range": of.astype(np.int32), "target": np.arange(len(few), dtype=np.int32), "rank": t.rank[few].astype(np.int32)}))
    held = data.mapInPandas(emit, "range int, value double").groupBy("range").agg(F.sort_array(F.collect_list("value")).alias("v"))
    got = held.join(F.broadcast(ranks), "range").select("target", F.expr("get(v, rank)").alias("value")).toArrow()  # one row a target
    t.value[few[got["target"].to_numpy()]] = got["value"].to_numpy()


def select_ranks(data: DataFrame, gid: np.ndarray, rank: np.ndarray, size: np.ndarray, small: int = SMALL) -> tuple[np.ndarray, int]:
    """Values of the 0-based ``rank`` of each group of ``data`` (gid, value), exactly, and the rounds taken.

    The arrays are one entry a rank, sorted by ``gid``; ``size`` is the group's number of values.
    """
    n = len(gid)
    t = _Targets(gid, rank.astype(np.int64).copy(), np.full(n, -np.inf), np.full(n, np.inf), np.full(n, -np.inf), size.astype(np.int64).copy(), np.full(n, np.nan))
    rounds = 0
    while len(open_ := np.flatnonzero(np.isnan(t.value) & (t.left > small))):
        rounds += 1
        got = _round(data, t, open_)
        k = open_[got["target"].to_numpy()]
        below, equal, above = (got[c].to_numpy() for c in ("b", "e", "a"))
        lower, upper = (got[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in ("lower", "upper"))
        down, hit = t.rank[k] < below, (t.rank[k] >= below) & (t.rank[k] < below + equal)
        up = ~down & ~hit
        t.value[k[hit]] = t.pivot[k[hit]]
        t.hi[k[down]], t.left[k[down]], t.lo[k[up]], t.left[k[up]] = t.pivot[k[down]], below[down], t.pivot[k[up]], above[up]
        t.rank[k[up]] -= (below + equal)[up]
        t.pivot[k[down]], t.pivot[k[up]] = lower[down], upper[up]
    few = np.flatnonzero(np.isnan(t.value))
    if len(few):
        _read_out(data, t, few)
    return t.value, rounds


def percentiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float], small: int = SMALL, groups_a_run: int = 50_000, report: dict | None = None) -> DataFrame:
    """Exact percentiles of ``value`` per group: the group's columns, n and one column a quantile.

    ``quantiles`` maps column names to shares; between two ranks the value is interpolated. Null,
    NaN and infinite values are left out, and a group without values gives no row; null groups are
    groups. An empty table gives no rows. Runs take ``groups_a_run`` groups at a time, so what the
    driver holds, numbers of groups and ranks but no names, is bounded; all groups are done, and each
    run reads its own part of the rows only. ``report`` gets the number of runs and rounds.
    """
    spark = df.sparkSession
    rows = df.select(*by, F.col(value).cast("double").alias("__value")).where(F.col("__value").isNotNull() & ~F.isnan("__value") & (F.abs("__value") < float("inf")))
    groups = cut(rows.groupBy(*by).agg(F.count("*").alias("n")).withColumn("__gid", F.monotonically_increasing_id()))
    runs = max(1, -(-groups.count() // groups_a_run))
    run_of = F.pmod(F.xxhash64(*by), F.lit(runs))
    report = {} if report is None else report
    report.update(runs=runs, rounds=0)
    folder = shared_folder(spark, "percentiles") if runs > 1 else None
    if folder:
        rows.withColumn("__run", run_of).write.partitionBy("__run").parquet(folder)
    out = None
    for run in range(runs):
        mine = groups.where(run_of == run) if folder else groups
        counts = mine.select("__gid", "n").toArrow().sort_by("__gid")
        if not counts.num_rows:
            continue
        part = spark.read.schema(rows.withColumn("__run", F.lit(0).cast("bigint")).schema).parquet(folder).where(F.col("__run") == run) if folder else rows
        ids = mine.select("__gid", *(F.col(c).alias(f"__g_{c}") for c in by))
        on = F.lit(True)
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
        data = cut(part.join(F.broadcast(ids), on).select(F.col("__gid").alias("gid"), F.col("__value").alias("value")).sortWithinPartitions("gid", "value"))
        gid, n = counts["__gid"].to_numpy(), counts["n"].to_numpy()
        spot = np.array(list(quantiles.values()))[None, :] * (n - 1)[:, None]
        ranks = np.stack([np.floor(spot), np.ceil(spot)], 2).astype(np.int64).reshape(len(n), -1)
        pairs, at = np.unique(np.stack([np.repeat(np.arange(len(n)), ranks.shape[1]), ranks.ravel()], 1), axis=0, return_inverse=True)
        found, rounds = select_ranks(data, gid[pairs[:, 0]], pairs[:, 1], n[pairs[:, 0]], small)
        report["rounds"] += rounds
        low, high = np.moveaxis(found[at.ravel()].reshape(len(n), len(quantiles), 2), 2, 0)
        result = low + (high - low) * (spot - np.floor(spot))
        done = spark.createDataFrame(pa.table({"__gid": gid, **{q: result[:, i] for i, q in enumerate(quantiles)}}))
        named = mine.join(F.broadcast(done), "__gid").select(*by, "n", *quantiles)  # groups_a_run rows at most
        if runs > 1:
            named = cut(named)  # the driver keeps no run's result
        out = named if out is None else out.unionByName(named)
    if folder:
        drop_folder(spark, folder)
    return groups.select(*by, "n", *(F.lit(None).cast("double").alias(q) for q in quantiles)).limit(0) if out is None else out


def digest(df: DataFrame, by: list[str], value: str, error: float = 0.005) -> DataFrame:
    """Mergeable summary: (by, bin, n). Values of a bin differ by at most 2 * ``error`` of themselves.

    Bin b > -2147483648 holds ((1+e)/(1-e)) ** (b-1) < value <= ((1+e)/(1-e)) ** b; zero has the
    bin -2147483648. Null, NaN, infinite and negative values are left out. Adding the n of equal
    bins of two digests gives the digest of their union, exactly.
    """
    v = F.col(value).cast("double")
    growth = math.log((1 + error) / (1 - error))
    fine = v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))
    bin_ = F.when(v == 0, F.lit(-(2**31))).otherwise(F.ceil(F.log(F.when(v > 0, v)) / growth).cast("int"))
    return df.where(fine).groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"))


def merge_digests(digests: DataFrame, by: list[str]) -> DataFrame:
    """Digest of the groups ``by`` from digests of finer groups."""
    return digests.groupBy(*by, "bin").agg(F.sum("n").alias("n"))


def digest_percentiles(digests: DataFrame, by: list[str], quantiles: dict[str, float], error: float = 0.005) -> DataFrame:
    """Percentiles from a digest: each is within ``error`` times the value of rank floor(q*(n-1))."""
    growth = math.log((1 + error) / (1 - error))
    bins = digests.groupBy(*by).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    step = lambda acc, x: F.struct((acc["c"] + x["n"]).alias("c"), F.when((acc["c"] <= F.col("want")) & (acc["c"] + x["n"] > F.col("want")), x["bin"]).otherwise(acc["bin"]).alias("bin"))
    out = bins
    for q, share in quantiles.items():
        out = out.withColumn("want", F.floor(F.lit(share) * (F.col("n") - 1)))
        hit = F.aggregate("bins", F.struct(F.lit(0).cast("bigint").alias("c"), F.lit(None).cast("int").alias("bin")), step)["bin"]
        out = out.withColumn(q, F.when(hit == -(2**31), F.lit(0.0)).otherwise(F.exp(hit * growth) * (1 - error)))
    return out.drop("want", "bins")
