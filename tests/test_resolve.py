import difflib
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import resolve as R
from weftline.operators.resolve import candidate_score, fuzzy_names, match


def test_text_functions(spark):
    df = spark.createDataFrame([("Nicol’s Bolas, Dragon-God",), ("Straße é",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(T.normalize_text(F.col("s"))).collect()] == ["nicols bolas dragon god", "strasse", "", None]
    g = spark.createDataFrame([("lightning bot", "lightning bolt"), ("", "x"), (None, None)], "a string, b string").select(T.gestalt_ratio("a", "b").alias("r")).collect()
    assert g[0].r == pytest.approx(0.963, abs=1e-3) and g[1].r == 0.0
    q = spark.createDataFrame([(["Akroan Horse", "4"],), (["Fire", "Ice (3)"],), ([],), (None,)], "l array<string>")
    assert [r[0] for r in q.select(T.clean_title_query(F.col("l"))).collect()] == ["Akroan Horse", "Fire Ice", "", None]
    assert q.select(T.split_title_queries(F.col("l"))).collect()[1][0] == ["fire", "ice", "fire ice", "ice fire"]


def plain(query, forms, limit):
    grams = lambda v: {f"  {v} "[i : i + 3] for i in range(len(v))}
    def score(t):
        own = set(query.split())
        s = 0.75 * difflib.SequenceMatcher(None, query, t).ratio() + 0.25 * len(own & set(t.split())) / len(own)
        return min(0.99, s + (0.05 if t.startswith(query) or query.startswith(t) else 0))

    near = {k for k, t in forms if grams(query) & grams(t)}
    pool = forms if len(query) < 4 or len(near) < 12 else [(k, t) for k, t in forms if k in near]
    best = {}
    for k, t in pool:
        best[k] = max(best.get(k, 0), score(t))
    return sorted(((-s, k) for k, s in best.items() if s >= 0.55))[:limit]


@pytest.mark.parametrize("block", [50_000, 25])
def test_fuzzy_equals_plain_search(spark, block):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeilnorst") for _ in range(rnd.randrange(3, 8)))
    names = sorted({f"{word()} {word()}" for _ in range(80)})
    forms = [(f"k{i}", n) for i, n in enumerate(names)] + [("k0", "other form")]
    queries = []
    for n in rnd.sample(names, 25):
        i = rnd.randrange(len(n))
        queries.append(n[:i] + rnd.choice("abcde") + n[i + 1 :])
    queries += ["abc", "zz", "", None]
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    got = {}
    for r in fuzzy_names(q, spark.createDataFrame(forms, "key string, form string"), 3, block).collect():
        got.setdefault(r.query, []).append((round(-r.score, 9), r.key))
    want = {x: [(round(s, 9), k) for s, k in p] for x in queries if x and (p := plain(x, forms, 3))}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_match(spark):
    names = spark.createDataFrame([("bolt", "lightning bolt"), ("helix", "lightning helix"), ("fire", "fire ice"), ("fire", "fire")], "key string, form string")
    records = spark.createDataFrame([("bolt", "Lightning Bolt", "normal"), ("helix", "Lightning Helix", "normal"), ("fire", "Fire // Ice", "split")], "key string, name string, layout string")
    obs = spark.createDataFrame([("exact", ["lightning bolt"], None), ("fuzzy", ["lightning bot"], "normal"), ("alias", ["Fire"], "split"), ("none", ["zzzz qqqq"], None), ("noise", ["Lightning Bolt", "123"], None), ("empty", [], None), ("null", None, None)], "obs_id string, lines array<string>, layout_hint string")
    got = {}
    for r in match(obs, names, records).orderBy("obs_id", "rank").collect():
        got.setdefault(r.obs_id, []).append(r)
    assert (got["exact"][0].name, got["exact"][0].score, got["exact"][0].notes) == ("Lightning Bolt", 0.74, ["exact"])
    assert got["fuzzy"][0].name == "Lightning Bolt" and got["fuzzy"][0].notes == ["fuzzy", "layout_match"]
    assert got["alias"][0].name == "Fire // Ice" and got["alias"][0].score == 0.77
    assert (got["none"][0].score, got["none"][0].notes) == (0.2, ["catalog_unavailable", "title_only"])
    assert got["noise"][0].name == "Lightning Bolt" and "exact" in got["noise"][0].notes
    assert "empty" not in got and "null" not in got


def test_candidate_score(spark):
    df = spark.createDataFrame([(0.7, 0.1), (0.1, None), (None, 0.6)], "t double, l double")
    s, n = candidate_score(F.lit(1.0), F.lit("exact"), F.lit(None).cast("boolean"), F.lit(False), F.col("t"), F.col("l"))
    got = df.select(s.alias("s"), n.alias("n")).collect()
    assert got[0].n == ["exact", "type_line_match", "lower_text_mismatch"] and got[0].s == pytest.approx(0.74 + 0.07 + 0.013 - 0.05)
    assert got[1].n == ["exact", "type_line_mismatch"] and got[1].s == pytest.approx(0.74 + 0.01 - 0.08)
    assert got[2].n == ["exact", "lower_text_match"] and got[2].s == pytest.approx(0.74 + 0.078)


def test_type_line_and_lower_text_decide(spark):
    names = spark.createDataFrame([("a", "storm crow"), ("b", "storm crew")], "key string, form string")
    records = spark.createDataFrame([("a", "Storm Crow", None, "Unit — Bird", ["Flight."]), ("b", "Storm Crew", None, "Rite", [])], "key string, name string, layout string, type_line string, lower_texts array<string>")
    obs = spark.createDataFrame([("o", ["Storm Crw"], None, "Unit — Bird", "Flight."), ("p", ["Storm Crw"], None, "Rite", None), ("q", ["Storm Crw"], None, None, "")], "obs_id string, lines array<string>, layout_hint string, type_text string, lower_text string")
    got = {(r.obs_id, r["rank"]): r for r in match(obs, names, records).collect()}
    assert got["o", 1].name == "Storm Crow" and got["o", 1].notes == ["fuzzy", "type_line_match", "lower_text_match"]
    assert got["p", 1].name == "Storm Crew" and got["p", 1].notes == ["fuzzy", "type_line_match"]
    assert got["q", 1].notes == ["fuzzy"]


def test_the_driver_stays_small(spark, monkeypatch):
    def built_here(forms):
        raise AssertionError("a block is built in the driver")

    monkeypatch.setattr(R, "NameBlock", built_here)
    names = spark.createDataFrame([("bolt", "lightning bolt")], "key string, form string")
    records = spark.createDataFrame([("bolt", "Lightning Bolt", "normal")], "key string, name string, layout string")
    obs = spark.createDataFrame([("o", ["lightning bot"], None), ("p", ["Lightning Bolt"], None)], "obs_id string, lines array<string>, layout_hint string")
    got = match(obs, names, records)
    assert {(r.obs_id, r.name, r.notes[0]) for r in got.collect()} == {("o", "Lightning Bolt", "fuzzy"), ("p", "Lightning Bolt", "exact")}
    assert "posexplode" not in got._jdf.queryExecution().optimizedPlan().toString()  # titles are cut out once, not in each branch


@pytest.mark.parametrize("block", [50_000, 25])
def test_long_and_odd_texts_equal_plain_search(spark, block):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdé-") for _ in range(rnd.randrange(1, 9)))
    forms = [(f"k{i % 60}", " ".join(word() for _ in range(rnd.choice((1, 2, 4, 12, 30))))) for i in range(90)]
    queries = [t[: rnd.randrange(1, len(t) + 1)] + rnd.choice(("", "a", " b")) for _, t in forms] + [t.replace("a", "b", 2) for _, t in forms]
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    got = {}
    for r in fuzzy_names(q, spark.createDataFrame(forms, "key string, form string"), 3, block).collect():
        got.setdefault(r.query, []).append((round(-r.score, 9), r.key))
    want = {x: [(round(s, 9), k) for s, k in p] for x in queries if (p := plain(x, forms, 3))}
    assert {k: sorted(x[0] for x in v) for k, v in got.items()} == {k: sorted(x[0] for x in v) for k, v in want.items()}
