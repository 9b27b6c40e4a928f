import math
import random

import numpy as np
from pyspark.sql import functions as F

from weftline.llm.multiselect import digest, digest_percentiles, merge_digests, percentiles
from weftline.llm.percentile_queries import durations

Q = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def test_exact_with_many_rounds(spark):
    rnd = random.Random(2)
    rows = [("hot" if i % 3 else None, round(math.exp(rnd.gauss(0, 2)), 2)) for i in range(6000)]
    rows += [("ties", 5.0)] * 700 + [("ties", 6.0)] * 3 + [("one", 1.5), ("bad", float("nan")), ("bad", None), ("bad", float("inf"))]
    df = spark.createDataFrame(rows, "g string, value double").repartition(7)
    got = {r.g: r for r in percentiles(df, ["g"], "value", Q, small=20).collect()}
    assert set(got) == {"hot", None, "ties", "one"}
    for g, r in got.items():
        v = [x for k, x in rows if k == g]
        assert r.n == len(v)
        for q, s in Q.items():
            assert abs(r[q] - np.quantile(v, s)) < 1e-9, (g, q)


def test_runs_of_groups_and_clashing_names(spark):
    df = spark.createDataFrame([(i % 13, float(i), "x") for i in range(400)], "gid int, v double, n string")
    got = percentiles(df.withColumnRenamed("n", "m"), ["gid", "m"], "v", {"p50": 0.5}, small=4, groups_a_run=3)
    want = df.groupBy("gid").agg(F.expr("percentile(v, 0.5)").alias("m"))
    assert {r.gid: r.p50 for r in got.collect()} == {r.gid: r.m for r in want.collect()}


def test_empty(spark):
    df = spark.createDataFrame([], "g string, value double")
    assert percentiles(df, ["g"], "value", Q).count() == 0
    assert digest_percentiles(digest(df, ["g"], "value"), ["g"], {"p50": 0.5}).count() == 0


def test_digest_error_and_merge(spark):
    rnd = random.Random(3)
    rows = [(d, round(rnd.paretovariate(1.2), 4)) for d in range(10) for _ in range(300)] + [(0, 0.0)] * 5 + [(0, -1.0), (1, None)]
    df = spark.createDataFrame(rows, "day int, v double")
    days = digest(df, ["day"], "v", 0.01)
    merged = merge_digests(days.withColumn("all", F.lit(1)), ["all"])
    assert merged.agg(F.sum("n")).first()[0] == 3005
    r = digest_percentiles(merged, ["all"], {"p0": 0.0, "p50": 0.5, "p99": 0.99}, 0.01).first()
    v = sorted(x for _, x in rows if x is not None and x >= 0)
    assert r.p0 == 0.0
    for q, s in (("p50", 0.5), ("p99", 0.99)):
        true = v[math.floor(s * (len(v) - 1))]
        assert abs(r[q] - true) <= 0.0101 * true


def test_rounds_are_entered_and_runs_read_their_part(spark):
    rnd = random.Random(7)
    df = spark.createDataFrame([(i % 3, rnd.random()) for i in range(6000)], "g int, v double").repartition(6)
    report = {}
    got = percentiles(df, ["g"], "v", {"p50": 0.5}, report=report).collect()
    assert len(got) == 3 and report["runs"] == 1 and report["rounds"] >= 3
    percentiles(df, ["g"], "v", {"p50": 0.5}, groups_a_run=1, report=report).collect()
    assert report["runs"] == 3


def test_modes_and_days_go_through_rounds(spark):
    rows = durations(spark, "/root/testdata/sf0.01")
    report = {}
    percentiles(rows, ["source", "mode"], "seconds", {"p50": 0.5, "p95": 0.95}, report=report)
    assert report["rounds"] >= 3
