import datetime as dt
import random

from pyspark.sql import functions as F

from weftline.operators import orphans
from weftline.operators.orphans import find_orphans, orphan_counts, target_states

T = dt.datetime


def frames(spark, refs, targets):
    r = spark.createDataFrame(refs, "ref_table string, row_key string, kind string, key string, at timestamp, extra string")
    t = spark.createDataFrame(targets, "kind string, key string, appeared timestamp, deleted timestamp, extra string")
    return r, t


def plain(refs, targets):
    out, first = set(), {}
    for table, row, kind, key, at, _ in refs:
        if key is None or row is None:
            continue
        k = (table, row, kind, key)
        if k not in first or first[k] is None or at is not None and at < first[k]:
            first[k] = at
    for (table, row, kind, key), at in first.items():
        mine = [(a, d) for k, y, a, d, _ in targets if (k, y) == (kind, key) and a is not None]
        if not mine:
            cause = "missing"
        elif at is None or any(a <= at and (d is None or d > at) for a, d in mine):
            continue
        else:
            cause = "late" if min(a for a, _ in mine) > at else "deleted"
        out.add((table, row, at and at.strftime("%Y-%m"), cause))
    return out


def test_against_plain_loop(spark):
    rnd = random.Random(5)
    day = lambda n: T(2024, 1, 1) + dt.timedelta(days=n)
    refs, targets = [], []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{rnd.randrange(60)}"
        refs.append((rnd.choice("ab"), str(i % 850), "x", None if i % 70 == 0 else key, None if i % 90 == 5 else day(rnd.randrange(300)), "e"))
    for k in ["hot", "hot", "hot"] + [f"k{rnd.randrange(60)}" for _ in range(80)]:
        a = rnd.randrange(250)
        targets.append(("x", k, None if rnd.random() < 0.05 else day(a), None if rnd.random() < 0.4 else day(a + rnd.randrange(0, 60)), "e"))
    r, t = frames(spark, refs, targets)
    got = {tuple(x) for x in find_orphans(r, t).collect()}
    assert got == plain(refs, targets)
    counts = {(x.ref_table, x.period, x.cause): x.n_refs for x in orphan_counts(r, t).collect()}
    assert sum(counts.values()) == len(got)


def test_earliest_delivery_and_edges(spark):
    refs = [("a", "1", "x", "k", T(2024, 5, 2), ""), ("a", "1", "x", "k", T(2024, 3, 1), ""), ("a", "2", "x", "k", T(2024, 4, 1), ""), ("a", "3", "x", "k", T(2024, 6, 1), "")]
    targets = [("x", "k", T(2024, 4, 1), T(2024, 6, 1), ""), ("x", "k", T(2024, 4, 20), T(2024, 6, 1), "")]
    r, t = frames(spark, refs, targets)
    assert {tuple(x) for x in find_orphans(r, t).collect()} == {("a", "1", "2024-03", "late"), ("a", "3", "2024-06", "deleted")}


def test_empty_tables(spark):
    refs = [("a", "1", "x", "k", T(2024, 5, 2), ""), ("a", "2", None, None, None, None)]
    r, t = frames(spark, refs, [])
    assert [tuple(x) for x in find_orphans(r, t).collect()] == [("a", "1", "2024-05", "missing")]
    r, t = frames(spark, [], [("x", "k", T(2024, 4, 1), None, "")])
    assert find_orphans(r, t).count() == 0


def test_overlapping_rows_change_once(spark):
    _, t = frames(spark, [], [("x", "k", T(2024, 1, d), T(2024, 1, d + 5), "") for d in (1, 3, 20)] + [("x", "k", None, None, ""), ("x", "k", T(2024, 3, 1), T(2024, 2, 1), "")])
    states, changes = target_states(t)
    s, c = states.first(), changes.collect()
    assert s.first_at == T(2024, 1, 1) and s.open_from is None and [tuple(e) for e in s.ends] == [("2024-01", False)]
    assert [(x.t.day, x.there) for r in c for x in r.changes] == [(1, True), (8, False), (20, True), (25, False)]


def test_hot_key_of_one_month_and_many_changes(spark, monkeypatch):
    """Half of the references have one key and month; its target comes and goes all the time."""
    rnd = random.Random(8)
    at = lambda h: T(2024, 1, 1) + dt.timedelta(hours=h)
    refs = [("a", str(i), "x", "hot" if i % 2 else f"k{i % 40}", at(rnd.randrange(700)), "") for i in range(2000)]
    targets = [("x", "hot", at(2 * h), at(2 * h + 1), "") for h in range(350)] + [("x", f"k{i}", at(i * 9), None if i % 3 else at(i * 9 + 100), "") for i in range(35)]
    r, t = frames(spark, refs, targets)
    want = plain(refs, targets)
    assert {tuple(x) for x in find_orphans(r, t).collect()} == want
    monkeypatch.setattr(orphans, "MOST_BROADCAST", 3)
    out = find_orphans(r, t)
    assert {tuple(x) for x in out.collect()} == want
    # The rows of the heavy key don't enter the join of the others.
    rows = r.groupBy("ref_table", "row_key", "kind", "key").agg(F.min("at").alias("at")).withColumn("period", F.date_format("at", "yyyy-MM"))
    keys, heavy, light = orphans.orphan_verdicts(rows, t, 4, 4)
    assert [k.key for k in keys.collect()] == ["hot"] and {x.key for x in heavy.collect()} == {"hot"} and "hot" not in {x.key for x in light.collect()}
