"""Registered queries return every row of their result."""

import datetime

from weftline.plans.catalog_queries import QUERIES as CATALOG
from weftline.plans.evaluation_queries import QUERIES as EVALUATION
from weftline.plans.evaluation_queries import facts
from weftline.plans.more_queries import QUERIES as MORE

AT = datetime.datetime(2024, 1, 1)


def catalogue(spark, path, name, normalized, n):
    """One identity with ``n`` printings that have a picture."""
    card = [(1, "o-1", name, normalized, "split", "Unit", "", [], AT)]
    prints = [(i, f"s-{i}", "o-1", "aaa", str(i), "2020-01-01", "https://x/y.png", AT) for i in range(n)]
    spark.createDataFrame(card, "id long, oracle_id string, name string, normalized_name string, layout string, type_line string, oracle_text string, colors array<string>, ingested_at timestamp").write.parquet(f"{path}/oracle_cards.parquet")
    spark.createDataFrame(prints, "id long, scryfall_id string, oracle_id string, set_code string, collector_number string, released_at string, image_uri string, ingested_at timestamp").write.parquet(f"{path}/printed_cards.parquet")
    return str(path)


def test_all_printings_of_a_name(spark, tmp_path):
    d = catalogue(spark, tmp_path, "Mudgrave Servant", "mudgrave servant", 60)
    got = [r.collector_number for r in CATALOG["ref_i3_k2_printings_for_name"](spark, d).collect()]
    assert got == sorted(map(str, range(60)))


def test_split_and_newest_orders_are_whole(spark, tmp_path):
    d = catalogue(spark, tmp_path, "Fire // Ice", "fire ice", 260)
    want = sorted(range(260), key=str)
    assert [r.id for r in CATALOG["ref_k6_split_order"](spark, d).collect()] == want
    assert [r.id for r in MORE["ref_k5_newest_first"](spark, d).collect()] == want


def test_newest_ten_thousand_pairs_are_kept(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(f"e{i}", f"a{i}", 1, at, at + datetime.timedelta(seconds=i)) for i in range(10_050)]
    spark.createDataFrame(rows, "expected_card_id string, actual_card_id string, seen_count long, first_seen_utc timestamp, last_seen_utc timestamp").write.parquet(f"{tmp_path}/simulated_card_pairs.parquet")
    got = {r.expected_card_id for r in EVALUATION["ref_w14_keep_newest_pairs"](spark, str(tmp_path)).collect()}
    assert got == {f"e{i}" for i in range(50, 10_050)}


def test_two_level_counts_have_every_mode(spark, data):
    q = EVALUATION["ref_a19_two_level_counts"](spark, data)
    n = facts(spark, data).count()
    assert {r["mode"] for r in q.collect()} >= {"greenfield", "small_pool", "unknown"}
    assert q.agg({"n": "sum"}).first()[0] == n
