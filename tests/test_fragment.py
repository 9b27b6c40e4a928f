from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.operators.fragment import SALT, fragment, fragment_join, pack_shards, plan_load, replicate, spelled_counts


def skewed(spark, n=3000):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{i % 40}", i % 7) for i in range(n)]
    return spark.createDataFrame(rows, "id int, key string, v int")


def test_shards_follow_load_and_are_spread():
    placed = pack_shards([("a", 1000), ("b", 300), ("c", 120)], 4, [0.0] * 4, 250)
    assert Counter(k for k, _, _ in placed) == {"a": 4, "b": 2, "c": 1}
    assert set(t for _, _, t in placed) == {0, 1, 2, 3}


def test_hot_key_is_split_and_nothing_is_lost(spark):
    df = skewed(spark)
    plan = plan_load(df, "key", 8)
    parts = fragment(df, plan)
    assert parts.count() == df.count()
    hot = parts.where("key = 'hot'").groupBy(SALT).count().collect()
    assert len(hot) > 1 and max(r["count"] for r in hot) < 1000 * 2 / len(hot)
    assert parts.where("key is not null and key <> 'hot'").select(SALT).distinct().count() == 1


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_equals_plain_join(spark, how):
    df = skewed(spark)
    right = spark.createDataFrame([("hot", 1, "x"), ("hot", 2, "y"), ("k3", 3, "z"), (None, 4, "n"), ("nowhere", 5, "w")], "key string, v int, name string")
    got = fragment_join(df, right, "key", how).drop(SALT)
    want = df.join(right.withColumnRenamed("v", "v_right"), "key", how)
    assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, want.select(sorted(want.columns)).collect()))


def test_other_joins_are_refused(spark):
    with pytest.raises(ValueError):
        fragment_join(skewed(spark), skewed(spark), "key", "full")


def test_matching_side_is_copied_only_to_shards(spark):
    plan = plan_load(skewed(spark), "key", 8)
    right = spark.createDataFrame([("hot",), ("k3",)], "key string")
    n = {r["key"]: r["count"] for r in replicate(right, plan, "key").groupBy("key").count().collect()}
    assert n["k3"] == 1 and n["hot"] > 1


def test_spellings_ties_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", "A"), ("a", "a"), ("b", "B"), (None, "x"), ("b", "B"), ("b", "b")], "key string, spelling string")
    counts, total = spelled_counts(df, "key", "spelling")
    assert total == 6
    assert {r["key"]: (r["n"], r["spelled"]) for r in counts.collect()} == {"a": (2, "A"), "b": (3, "B")}
    counts, total = spelled_counts(df.limit(0), "key", "spelling")
    assert total == 0 and counts.count() == 0


def test_reserved_columns_are_replaced(spark):
    df = skewed(spark, 200).withColumn(SALT, F.lit("mine")).withColumn("__key", F.lit(1))
    assert fragment_join(df, df.select("key").distinct(), "key", "left").count() == 200


def test_numeric_keys_land_where_they_are_packed(spark):
    """The largest partition of a numeric key of 60 % holds little more than its share; null keys are spread."""
    rows = [(7 if i % 10 < 6 else i, i) for i in range(20_000)] + [(None, i) for i in range(8_000)]
    df = spark.createDataFrame(rows, "k bigint, v int")
    plan = plan_load(df, "k", 8)
    joined = fragment_join(df, spark.createDataFrame([(7, "seven"), (9, "nine")], "k bigint, name string"), "k", "left", plan)
    assert joined.count() == 28_000 and joined.where("name = 'seven'").count() == sum(k == 7 for k, _ in rows)
    sizes = fragment(df, plan).repartition(8, "k", SALT).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 1.35 * 28_000 / 8
