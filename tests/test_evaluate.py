import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import evaluate as E
from weftline.operators import pairs as P

SCHEMA = """mode string, path string, expected_name string, expected_set_code string, expected_collector_number string, predicted_name string, predicted_set_code string, predicted_collector_number string,
confidence double, top1_hit boolean, top5_hit boolean, set_hit boolean, art_hit boolean, runtime_seconds double, candidate_count int, expected_games array<string>, expected_is_paper boolean, deadline_exceeded boolean, stage_timings map<string,double>"""


def facts(spark):
    rows = [
        ("m", "echoing", "Echoing Courage", "dst", "61", "Echoing Courage", "dst", "61", 0.91, True, True, True, True, 0.4, 2, None, True, False, {"a": 1.0, "b": 2.0}),
        ("m", "jade", "Jade Avenger", "mh2", "167", "Jade Avenger", "mh2", "356", 0.63, True, True, True, False, 0.6, 3, [], True, False, {"a": 3.0}),
        ("m", "arena", "Arena Card", "y24", "1", "Other", None, None, 0.2, False, False, False, False, None, 0, ["arena"], False, False, None),
        ("m", "late", "Late", "abc", "1", "Late", "abc", "1", None, None, None, None, None, float("nan"), None, None, False, True, {}),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_summary_and_calibration(spark):
    s = E.summary(facts(spark), ["mode"]).first()
    assert (s.fixture_count, s.scored_count, s.top1_accuracy, s.set_accuracy, s.art_accuracy) == (4, 2, 1.0, 1.0, 0.5)
    assert s.median_runtime_seconds == 0.5 and s.runtime_p95_seconds == pytest.approx(0.59)
    bins = E.calibration_bins(facts(spark), ["mode"])
    assert {(r.lower_bound, r.upper_bound): r.calibration_gap for r in bins.collect()} == {(0.6, 0.8): 0.37, (0.8, 1.0): 0.09}
    assert E.calibration_error(bins, ["mode"]).first().calibration_error == 0.23
    assert E.summary(facts(spark).limit(0), ["mode"]).count() == 0


def test_bin_edges(spark):
    df = facts(spark).limit(1).drop("confidence").crossJoin(spark.createDataFrame([(x,) for x in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)], "confidence double"))
    assert sorted((r.lower_bound, r.n) for r in E.calibration_bins(df, ["mode"]).collect()) == [(0.0, 1), (0.2, 1), (0.4, 1), (0.6, 1), (0.8, 2)]


def test_error_classes(spark):
    got = {r.path: r.c for r in facts(spark).select("path", E.error_class(F.coalesce("top5_hit", F.lit(False))).alias("c")).collect()}
    assert got == {"echoing": "correct_top1", "jade": "wrong_art", "arena": "out_of_scope_nonpaper", "late": "out_of_scope_nonpaper"}


def test_stage_means_and_comparison(spark):
    a = E.average_map(facts(spark), ["mode"], "stage_timings")
    assert {r.stage: (r.n, r.mean_seconds) for r in a.collect()} == {"a": (2, 2.0), "b": (1, 2.0)}
    c = E.stage_comparison(a.where("stage = 'a'"), a.where("stage = 'b'"), ["mode"])
    assert {r.stage: r.delta for r in c.collect()} == {"a": -2.0, "b": 2.0}


def test_deltas(spark):
    s = E.summary(facts(spark), ["mode"])
    d = {r.metric: r.delta for r in E.metric_deltas(s.withColumn("top1_accuracy", F.lit(0.7)), s.withColumn("top1_accuracy", F.lit(0.8)), ["mode"]).collect()}
    assert d["top1_accuracy"] == 0.1 and d["art_accuracy"] == 0.0


T = dt.datetime(2024, 1, 1)
STORE = "expected_card_id string, actual_card_id string, seen_count bigint, first_seen_utc timestamp, last_seen_utc timestamp"


def test_pair_store(spark):
    ev = spark.createDataFrame([("x", "y", T, 1), ("x", "y", T - dt.timedelta(days=1), 2), ("p", "q", T, 3)], "expected_card_id string, actual_card_id string, seen_at timestamp, seq bigint")
    empty = spark.createDataFrame([], STORE)
    one = P.merge_pairs(empty, ev)
    got = {r.expected_card_id: r for r in one.collect()}
    assert got["x"].seen_count == 2 and got["x"].first_seen_utc == T and got["x"].last_seen_utc == T - dt.timedelta(days=1)
    assert {r.expected_card_id: r.seen_count for r in P.merge_pairs(one, ev).collect()} == {"x": 4, "p": 2}
    assert sorted((r.seq, r.prior) for r in P.prior_counts(ev).collect()) == [(1, 1), (2, 0), (3, 0)]
    assert sorted((r.seq, r.prior) for r in P.prior_counts(ev, one).collect()) == [(1, 3), (2, 2), (3, 1)]


def test_retention_and_mismatches(spark):
    day = lambda n: T + dt.timedelta(days=n)
    rows = [("a", "1", 1, T, T), ("b", "1", 1, T, day(1)), ("c", "1", 1, T, day(2))]
    assert sorted(r.expected_card_id for r in P.keep_newest(spark.createDataFrame(rows, STORE), 2).collect()) == ["b", "c"]
    rows = [("lea:1", "2ed:1", 4, T, T), ("lea:1", "3ed:1", 2, T, T), ("mh2:1", "unrecognized", 3, T, T), ("tmp:1", "tmp:1", 9, T, T), ("z", "y", 1, T, T)]
    got = sorted((-r.top, r.expected_card_id, -r.seen_count, r.actual_card_id) for r in P.grouped_mismatches(spark.createDataFrame(rows, STORE), 2, 2).collect())
    assert got == [(-4, "lea:1", -4, "2ed:1"), (-4, "lea:1", -2, "3ed:1"), (-3, "mh2:1", -3, "unrecognized")]


def test_group_percentiles_without_a_task_a_group(spark):
    rnd = random.Random(3)
    rows = [("hot", rnd.gauss(0, 3)) for _ in range(3000)] + [(None, float(i)) for i in range(7)] + [("ties", 5.0)] * 40 + [("ties", -5.0)] * 3 + [("zero", 0.0), ("zero", -0.0), ("one", 1e-300), ("bad", None), ("bad", float("nan"))]
    rows += [("ends", float("inf")), ("ends", -float("inf")), ("ends", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r for r in E.group_percentiles(df, ["k"], F.col("v"), {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p100": 1.0}).collect()}
    assert set(got) == {"hot", None, "ties", "zero", "one", "ends"}
    for k in ("hot", None, "ties", "zero", "one"):
        v = [x for g, x in rows if g == k]
        for c, q in (("p0", 0.0), ("p10", 0.1), ("p50", 0.5), ("p100", 1.0)):
            assert abs(got[k][c] - np.quantile(v, q)) < 1e-9, (k, c)
    assert (got["ends"].p50, got["ends"].p100) == (1.0, float("inf"))
    assert E.group_percentiles(df.limit(0), ["k"], F.col("v"), {"p": 0.5}).count() == 0
    assert abs(E.group_percentiles(df.where("k = 'hot'"), [], F.col("v"), {"p": 0.5}).first().p - np.median([x for k, x in rows if k == "hot"])) < 1e-9
