import pytest
from pyspark.sql import functions as F

from weftline.operators import scoring as S

SCHEMA = "obs_id string, ord int, name string, score double, set_code string, collector_number string, notes array<string>, is_expected boolean"


def cands(spark, rows):
    return spark.createDataFrame([(o, i, n, s, st, c, list(notes), e) for i, (o, n, s, st, c, notes, e) in enumerate(rows)], SCHEMA)


def test_confidence_goldens(spark):
    rows = [
        ("a", "Lightning Bolt", 0.86, "m11", "1", ["exact", "type_line_match", "lower_text_match"], False), ("a", "Chain Lightning", 0.62, "x", "2", [], False),
        ("b", "Opt", 0.78, "m11", "1", ["fuzzy", "layout_mismatch", "type_line_mismatch"], False), ("b", "Optimus", 0.50, "x", "2", [], False),
        *(("c", "Evolving Wilds", s, st, "1", ["fuzzy", "layout_match"], False) for s, st in ((0.86, "a"), (0.84, "b"), (0.82, None), (0.80, "d"))),
        *(("d", "Evolving Wilds", s, st, "1", ["fuzzy", "set_symbol_match", "art_match", "layout_match"], False) for s, st in ((0.8884, "a"), (0.8615, "b"), (0.8148, "c"))),
        ("e", "Alone", 0.5, None, None, [], False), ("e2", "Same", 0.5, None, None, [], False), ("e2", "Same", 0.5, None, None, [], False),
    ]
    got = {r.obs_id: r for r in S.confidence(cands(spark, rows)).collect()}
    want = {"a": 1.0, "b": 0.7122, "c": 0.7448, "d": 0.9619}
    for o, c in want.items():
        assert got[o].confidence == pytest.approx(c, abs=1e-4)
    assert got["e"].margin == 0.5 and got["e2"].same_name == 0
    assert S.confidence(cands(spark, rows).limit(0)).count() == 0


def test_skip_gates(spark):
    rows = [
        ("cromat", "Cromat", 0.96, None, None, ["exact"], False), ("counter", "Counterspell", 0.95, None, None, ["exact"], False), ("counter", "Cancel", 0.72, None, None, ["fuzzy"], False),
        ("term", "Terminate", 0.91, "a", "1", ["exact"], False), ("term", "Terminate", 0.90, "b", "1", ["exact"], False), ("zub", "Zubera", 0.8323, None, None, ["fuzzy", "type_line_match", "layout_match", "noisy_title_ocr"], False),
        ("ser", "Serendib Sorcerer", 0.8561, "a", "1", ["set_symbol_match"], False), ("ser", "Serendib Sorcerer", 0.856, "b", "1", [], False), ("ser", "Apprentice Sorcerer", 0.5325, "c", "1", [], False),
    ]
    conf = spark.createDataFrame([("cromat", 0.95), ("counter", 0.93), ("term", 0.94), ("zub", 0.9623), ("ser", 0.90)], "obs_id string, confidence double")
    got = {r.obs_id: r.skip for r in S.skip_gates(cands(spark, rows), conf).collect()}
    assert got == {"cromat": True, "counter": True, "term": False, "zub": True, "ser": True}


def test_expected_and_confirmation(spark):
    rows = [("a", "X", 0.9, "s", "1", [], False), ("a", "Y", 0.83, "s", "2", ["exact"], True), ("b", "Y", 0.9, "s", "2", ["exact", "art_match"], True), ("b", "Y", 0.88, "t", "2", [], False), ("c", "Z", 0.9, None, None, [], False)]
    c = cands(spark, rows)
    p = {(r.obs_id, r.name, r.set_code): r for r in S.promote_expected(c).collect()}
    assert p["a", "Y", "s"].promoted and p["a", "Y", "s"].score == 0.9001 and p["a", "Y", "s"].rank == 1
    assert not p["b", "Y", "s"].promoted
    got = {r.obs_id: r for r in S.confirmation(c).collect()}
    assert got["c"].confidence == 0.0 and not got["c"].matches
    assert got["b"].matches and got["b"].confidence == pytest.approx(0.9 + 0.006 + 0.08 - 0.08, abs=1e-4)
    assert got["a"].confidence == pytest.approx(0.83 + 0.03 - 0.2 - 0.035, abs=1e-4)
    e = {r.obs_id: r for r in S.expected_ranks(c).collect()}
    assert e["a"].expected_rank == 2 and e["a"].gap == 0.07 and e["c"].expected_rank is None


def test_visual_rerank_needs_a_lead(spark):
    rows = [("a", "X", 0.9, "m13", "1", [], False), ("a", "X", 0.88, "dom", "1", [], False), ("b", "X", 0.9, "m13", "1", [], False), ("b", "X", 0.88, "dom", "1", [], False)]
    sims = F.when(F.col("set_code") == "dom", 0.94).when(F.col("obs_id") == "a", 0.58).otherwise(0.93)
    got = {(r.obs_id, r.set_code): (r.score, r.moved) for r in S.visual_rerank(cands(spark, rows).withColumn("sim", sims), 0.1, 6, 0.22, 0.81, 0.03).collect()}
    assert got["a", "dom"][0] > got["a", "m13"][0] and got["a", "dom"][1]
    assert got["b", "dom"] == (0.88, False)


def test_matches_expected(spark):
    df = spark.createDataFrame([("i1", "X", "I1", None, True), (None, "X", None, "X", True), ("i1", "X", "i2", "X", False), ("i1", "x", None, "X", False), (None, None, None, "X", False)], "c_scryfall_id string, c_name string, e_scryfall_id string, e_name string, want boolean")
    for f in ("oracle_id", "set_code", "collector_number"):
        df = df.withColumn(f"c_{f}", F.lit(None).cast("string")).withColumn(f"e_{f}", F.lit(None).cast("string"))
    assert all(r.got == r.want for r in df.select("want", S.matches_expected("c_", "e_").alias("got")).collect())
