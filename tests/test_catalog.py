import json

import pytest
from pyspark.sql import functions as F

from weftline.functions.text import normalize_text, trigrams
from weftline.operators import catalog as C

# Invented records: one plain, one of three faces of which one is blank, and others that are left out.
PLAIN = {
    "id": "v-10", "oracle_id": " c-10 ", "name": "Marsh Lantern", "printed_name": "Lanterne du Marais", "set": "QX1", "collector_number": "7a", "lang": "en", "games": ["Paper", "arena"],
    "layout": "normal", "type_line": "Relic", "mana_cost": "{2}", "oracle_text": "Rest: see far.", "colors": [" ", "W"], "image_uris": {"large": " ", "normal": "https://pics.example/ml.png"}, "unknown": {"a": 1},
}
THREE = {
    "id": "v-20", "oracle_id": "c-20", "name": "Dawn // Noon // Dusk", "set": "QX2", "collector_number": "8", "lang": "en", "layout": "split", "colors": None,
    "card_faces": [
        {"name": "Dawn", "printed_name": "Aube", "mana_cost": "{W}", "type_line": " ", "colors": ["W"]},
        {"name": " ", "mana_cost": None, "type_line": "Rite", "colors": ["G", "W"], "image_uris": {"png": "https://pics.example/noon.png"}},
        {"name": "Dusk", "mana_cost": "{B}", "type_line": "Trick", "colors": ["B", "G"], "image_uris": {"png": "https://pics.example/dusk.png"}},
    ],
}
OTHERS = [
    {"id": "v-30", "name": "Only On Screens", "lang": "en", "digital": True}, {"id": "v-31", "name": "Elsewhere", "lang": "en", "games": ["mtgo", "arena"]}, {"id": "v-32", "name": "Sumpflaterne", "lang": "de", "games": ["paper"]},
    "text", 3.5, None, ["list"], {"id": "v-33", "name": "  ", "lang": "en"}, {"id": None, "name": "Nameless", "lang": "en"},
    {"id": "v-40", "name": "No Identity", "set": "QX3", "lang": "en", "games": [], "digital": None}, {"id": "v-20", "oracle_id": "c-20", "name": "Later Delivery", "set": "QX9", "lang": "en", "games": ["paper"]},
]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("bulk") / "source.json"
    path.write_text(json.dumps([PLAIN, *OTHERS[:6], THREE, *OTHERS[6:]]))
    return C.build_catalog(C.read_bulk_json(spark, str(path)))


def test_variants_of_paper_records(built):
    got = {r.scryfall_id: r for r in built["variants"].collect()}
    assert {k: (v.oracle_id, v.set_code) for k, v in got.items()} == {"v-10": ("c-10", "QX1"), "v-20": ("c-20", "QX2"), "v-40": ("printing:v-40", "QX3")}
    assert got["v-10"].image_uri == "https://pics.example/ml.png" and got["v-20"].image_uri == "https://pics.example/noon.png" and got["v-40"].image_uri is None


def test_identities_join_their_faces(built):
    got = {r.oracle_id: r for r in built["identities"].collect()}
    three = got["c-20"]
    assert (three.name, three.mana_cost, three.type_line, three.colors) == ("Dawn // Noon // Dusk", "{W} // {B}", "Rite // Trick", ["W", "G", "B"])
    assert (got["c-10"].colors, got["c-10"].normalized_name, got["printing:v-40"].colors) == (["W"], "marsh lantern", [])


def test_aliases_and_metadata(built):
    assert sorted((r.scryfall_id, r.alias, r.normalized_alias) for r in built["aliases"].collect()) == [("v-10", "Lanterne du Marais", "lanterne du marais"), ("v-20", "Aube", "aube"), ("v-20", "Dawn", "dawn"), ("v-20", "Dusk", "dusk")]
    assert {r.key: r.value for r in built["metadata"].collect()} == {"schema_version": C.SCHEMA_VERSION, "card_count": "3", "oracle_count": "3", "alias_count": "4"}


def test_source_that_is_no_array_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="not an array"):
        C.read_bulk_json(spark, str(tmp_path / "x.json")).collect()


@pytest.fixture(scope="module")
def shelf(spark):
    i = spark.createDataFrame([("c-1", "Ox"), ("c-2", "Oxbow Ferry"), ("c-3", None), ("c-4", "Red Oxen")], "oracle_id string, name string").withColumn("normalized_name", normalize_text(F.col("name")))
    v = spark.createDataFrame(
        [("a", "C-1\t", "qx2", "12", "2019-05-05"), ("b", "c-1", "qx1", "3", None), ("c", "c-1", "qx1", "4", "2021-01-01"), ("d", "gone", "qx1", "5", "2020-01-01"), ("e", None, None, None, None), ("f", "c-4", None, "1", "2018-01-01")],
        "scryfall_id string, oracle_id string, set_code string, collector_number string, released_at string",
    )
    return C.Catalog(i, v)


def test_printings_in_order_and_filtered(shelf):
    assert [r.scryfall_id for r in shelf.printings(name=" oX ").collect()] == ["c", "a", "b"]
    assert [r.scryfall_id for r in shelf.printings(name="ox", limit=1).collect()] == ["c"]
    assert [r.scryfall_id for r in shelf.printings(name="Ox", set_code="QX1", collector_number="3").collect()] == ["b"]
    assert shelf.printings(name="…").count() == 0 and shelf.printings().count() == 4
    assert shelf.resolve(scryfall_id="f", name="ox").count() == 1 and shelf.resolve(oracle_id="c-1", name="red oxen").count() == 2 and shelf.resolve(name="ox").count() == 3


def test_equal_names_go_before_those_that_contain_them(shelf):
    assert [r.oracle_id for r in shelf.find_identities("OX").collect()] == ["c-1"]
    assert [r.oracle_id for r in shelf.find_identities("oxe").collect()] == ["c-4"]
    assert [r.oracle_id for r in shelf.find_identities("xb").collect()] == ["c-2"]
    assert shelf.find_identities("").count() == 0


def test_exact_lookup_names_before_aliases(spark):
    q = spark.createDataFrame([("q1", "dusk"), ("q2", "none"), ("q3", "aube")], "q_id string, query string")
    n = spark.createDataFrame([("dusk", "k1")], "normalized string, key string")
    a = spark.createDataFrame([("dusk", "k1"), ("dusk", "k2"), ("aube", "k1")], "normalized string, key string")
    assert sorted(map(tuple, C.exact_lookup(q, n, a).collect())) == [("q1", "dusk", "k1", 0), ("q1", "dusk", "k2", 1), ("q3", "aube", "k1", 1)]


def test_a_bare_name_must_be_unique(spark):
    q = spark.createDataFrame([(1, "Ox", None, None), (2, "Ox", "QX1", None), (3, "Elk", None, None), (4, "Ox", None, "9"), (5, "Ox", "qx2", "8"), (6, None, None, None)], "q_id int, name string, set_code string, collector_number string")
    r = spark.createDataFrame([("Ox", "qx1", "8", 20), ("Ox", "QX1", "9", 21), ("Ox", "qx2", "8", 22), ("Elk", None, None, 23)], "name string, set_code string, collector_number string, record_id int")
    assert sorted(map(tuple, C.unique_or_filtered(q, r).collect())) == [(2, 20), (3, 23), (4, 21), (5, 22)]
    assert C.unique_or_filtered(q, r.limit(0)).count() == 0


def test_blocked_counts(spark):
    g = lambda df, c: df.withColumn("grams", trigrams(F.col(c)))
    names = g(spark.createDataFrame([("storm crow",), ("storm crew",), ("elk",)], "key string"), "key")
    asked = g(spark.createDataFrame([("storm",), ("zzz",), ("elks",)], "q_id string"), "q_id")
    for block in (50_000, 1):
        assert sorted(map(tuple, C.blocked_counts(asked, names, block).collect())) == [("elks", 1, 3), ("storm", 2, 6)]
