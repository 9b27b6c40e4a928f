import datetime

from weftline.plans.resolve_queries import QUERIES

AT = datetime.datetime(2024, 1, 1)


def folder(spark, path):
    """Tables with one identity that has an alias of quite another spelling, and one observation of each kind."""
    cards = [(1, "o-1", "Storm Crow", "storm crow"), (2, "o-2", "Lantern Golem", "lantern golem")]
    cards = [(i, o, n, norm, "normal", "Unit", "", [], AT) for i, o, n, norm in cards]
    prints = [(10, "s-10", " O-1 ", "aaa", "1", "2020-01-01", None, AT), (20, "s-20", "o-2", "aaa", "2", "2020-01-01", None, AT)]
    aliases = [(100, 10, "Corbeau Vif", "corbeau vif", AT), (101, 99, "Nobody", "nobody", AT), (102, 20, "", "", AT)]
    seen = [("name", ["Storm Crow"]), ("alias", ["Corbeau Vif"]), ("noisy", ["Corbeou Vif"]), ("none", ["Zzzz Qqqq"]), ("orphan", ["Nobody"])]
    seen = [(o, lines, None, AT) for o, lines in seen]
    for name, rows, schema in (
        ("oracle_cards", cards, "id long, oracle_id string, name string, normalized_name string, layout string, type_line string, oracle_text string, colors array<string>, ingested_at timestamp"),
        ("printed_cards", prints, "id long, scryfall_id string, oracle_id string, set_code string, collector_number string, released_at string, image_uri string, ingested_at timestamp"),
        ("aliases", aliases, "id long, card_id long, alias string, normalized_alias string, ingested_at timestamp"),
        ("recognition_results", seen, "obs_id string, ocr_lines array<string>, layout_hint string, ingested_at timestamp"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_aliases_are_forms_of_the_name(spark, tmp_path):
    d = folder(spark, tmp_path)
    got = {r.obs_id: r for r in QUERIES["ref_d1_d2_match_candidates"](spark, d).where("rank = 1").collect()}
    assert {o: (got[o].name, got[o].notes) for o in ("name", "alias", "noisy")} == {"name": ("Storm Crow", ["exact"]), "alias": ("Storm Crow", ["exact"]), "noisy": ("Storm Crow", ["fuzzy"])}
    assert all(got[o].score == 0.2 for o in ("none", "orphan"))
    near = {r.query: r.key for r in QUERIES["ref_j9_t4_fuzzy_names"](spark, d).where("rank = 1").collect()}
    assert near == {"corbeou vif": "storm crow"}
