from weftline.llm.lexicon import map_values


def test_half_of_a_title_may_be_a_type_or_rules_word(spark):
    entries = spark.createDataFrame([(n, n) for n in ("wuzheiloux warden", "storm crow", "draw the sphinx", "lantern golem")], "entry string, canonical string")
    rows = [
        (1, ["Wuzheiloux", "Warden", "Each rival loses 3 supply."]),
        (2, ["Wuzheilouq", "Warden"]),
        (3, ["Storm Crow", "Unit — Warden"]),
        (4, ["Draw", "the Sphinx"]),
        (5, ["Lantern", "Golem"]),
        (6, ["Unit — Warden", "Draw two cards."]),
    ]
    df = spark.createDataFrame(rows, "obs int, lines array<string>")
    known = ["warden", "unit warden", "unit", "lantern", "golem"]
    got = {r.obs: r.canonical for r in map_values(df, "obs", "lines", entries, known, ["draw two cards", "each rival loses 3 supply"]).collect()}
    assert got == {1: "wuzheiloux warden", 2: "wuzheiloux warden", 3: "storm crow", 4: "draw the sphinx", 5: "lantern golem", 6: ""}
