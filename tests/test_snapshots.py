import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators.snapshots import Bitmap, kept_ordinals, snapshot_changes, snapshot_ordinals

SETS = st.sets(st.one_of(st.integers(0, 200_000), st.integers(60_000, 70_000)), max_size=300)


@settings(max_examples=60, deadline=None)
@given(SETS, SETS)
def test_bitmap_is_a_set(a, b):
    x, y = Bitmap.of(np.array(sorted(a))), Bitmap.of(np.array(sorted(b)))
    assert set(x.and_not(y).members().tolist()) == a - b
    assert set(x.and_(y).members().tolist()) == a & b
    assert len(x) == len(a)


def test_dense_containers():
    a, b = np.arange(0, 150_000), np.arange(5, 150_000, 3)
    x, y = Bitmap.of(a), Bitmap.of(b)
    assert any(c.dtype == np.uint8 for c in x.containers.values())
    assert np.array_equal(x.and_not(y).members(), np.setdiff1d(a, b))
    assert np.array_equal(y.and_(x).members(), b)


def test_changes_against_plain_dicts(spark):
    rnd = random.Random(1)
    rows, state = [], {}
    for s in (1, 2, 4, 7):
        for _ in range(120):
            state[f"k{rnd.randrange(300)}"] = (rnd.choice(["u1", "u2", None, ""]), rnd.choice(["t1", "t2", None]))
        for k in list(state):
            if rnd.random() < 0.1:
                del state[k]
        for k, (u, t) in state.items():
            rows.append((s, k, u, t, 10, "x"))
            if rnd.random() < 0.2:
                rows.append((s, k, "old", "old", 5, "x"))
    rows += [(2, None, "u", "t", 1, "x"), (None, "k1", "u", "t", 1, "x")]
    df = spark.createDataFrame(rows, "s int, k string, u string, t string, v int, bucket string")
    watched = {"u": F.col("u"), "t": F.col("t")}
    got = {tuple(r) for r in snapshot_changes(df, "s", "k", "v", watched, per_bucket=100).collect()}
    by = {}
    for s, k, u, t, v, _ in rows:
        if s is not None and k is not None and v == 10:
            by.setdefault(s, {})[k] = (u or "", t or "")
    want = set()
    for a, b in ((1, 2), (2, 4), (4, 7)):
        want |= {(b, k, "added") for k in by[b].keys() - by[a].keys()} | {(b, k, "removed") for k in by[a].keys() - by[b].keys()}
        want |= {(b, k, "changed") for k in by[a].keys() & by[b].keys() if by[a][k] != by[b][k]}
    assert got == want


def test_ordinals_persist(spark):
    df = spark.createDataFrame([(1, f"k{i}") for i in range(50)], "s int, k string")
    first = snapshot_ordinals(df, "s", "k", 3)
    kept = {r.key: (r.bucket, r.ordinal) for r in first.collect()}
    more = spark.createDataFrame([(2, f"k{i}") for i in range(20, 90)], "s int, k string")
    again = {r.key: (r.bucket, r.ordinal) for r in snapshot_ordinals(more, "s", "k", 3, first).collect()}
    assert all(again[k] == v for k, v in kept.items()) and len(again) == 90 and len(set(again.values())) == 90


def test_one_or_no_snapshot(spark):
    df = spark.createDataFrame([(1, "a", "u", 1)], "s int, k string, u string, v int")
    assert snapshot_changes(df, "s", "k", "v", {"u": F.col("u")}).count() == 0
    assert snapshot_changes(df.limit(0), "s", "k", "v", {"u": F.col("u")}).count() == 0


def test_ordinals_are_kept_while_the_table_grows(spark, tmp_path):
    """Between two runs the table doubles, then grows tenfold: buckets split, and every old key keeps its number."""
    store, per, held = f"{tmp_path}/ordinals", 5, {}
    watched = {"u": F.col("u")}
    for n in (40, 80, 800):
        rows = [(s, f"k{i}", f"{i}{'x' if s == 2 and i % 7 == 0 else ''}", 1) for s in (1, 2) for i in range(n) if i % 10 != s]
        df = spark.createDataFrame(rows, "s int, k string, u string, v int")
        ordinals = kept_ordinals(df, "s", "k", store, per)
        now = {r.key: (r.bucket, r.ordinal) for r in ordinals.collect()}
        assert len(set(now.values())) == len(now) == len({k for _, k, _, _ in rows})
        assert all(now[k][1] == o for k, (_, o) in held.items())
        held = now
        with_known = {tuple(r) for r in snapshot_changes(df, "s", "k", "v", watched, ordinals, per).collect()}
        assert with_known == {tuple(r) for r in snapshot_changes(df, "s", "k", "v", watched).collect()}
    assert ordinals.select("buckets").distinct().count() == 1 and ordinals.first().buckets > 16
