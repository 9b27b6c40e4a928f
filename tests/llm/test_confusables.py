import pytest

from weftline.llm.confusables import annotate, look_alike_groups, look_alike_rows, look_alikes, odd_characters, plain_form, skeleton

ODD = {
    "Emberkin　Wisp": "Emberkin Wisp", "﻿Mudgrave Servant": "Mudgrave Servant", "Mudgrave Servant​": "Mudgrave Servant", "Galcrest ": "Galcrest",
    "Ｍossplain": "Mossplain", "Mo\U0001d42csy": "Mossy", "Keystone ﬆar": "Keystone star", "Spectrе": "Spectre", "Ϝlame": "Flame", "Ꭰuelist": "Duelist",
    "Café": "Café", "Mırage": "Mirage", "Neϲtar": "Nectar", "Tab\tname": "Tab name", "ボガ": "ボガ", "ﾗﾀﾌﾞ": "ラタブ", "口コフ": "ロコフ", "Тpачок": "Трачок", "ɡolem": "golem",
}
PLAIN = ["Emberkin Wisp", "Café Noir", "Schlüssel von Über", "Vrounkroa’s Acolyte", "Dash – dash", "Трачокранун дрюпур", "ラゼシのハゼベ", "テマピゲアー・カマネソ", "Fire // Ice", "", "O'Neil-Born", "Straße Ærø", "漢字の名前", "ἀρχή"]


@pytest.mark.parametrize("text", ODD)
def test_odd(text):
    assert odd_characters(text)
    assert plain_form(text) == ODD[text]
    assert not odd_characters(plain_form(text))


@pytest.mark.parametrize("text", PLAIN)
def test_ordinary(text):
    assert not odd_characters(text)


def test_look_alikes_have_one_skeleton():
    assert len({skeleton(t) for t in ("Spectre", "Sреctre", "Ѕpectrе", "S​pectre", "Ｓpectre")}) == 1
    assert skeleton("Café") == skeleton("Café") != skeleton("Cafe")
    assert skeleton(None) is None and plain_form(None) is None and not odd_characters(None)


def test_annotate_equals_plain_functions(spark):
    values = [*ODD, *PLAIN, "".join(map(chr, range(33, 127))), "rn0O1lI|", None, "x" * 50_000, "x" * 50_000 + "​", "  padded  ", "two  blanks"]
    df = spark.createDataFrame([(i, v, "keep") for i, v in enumerate(values)], "id int, value string, extra string")
    known = look_alikes(spark)
    for r in annotate(df, "value").collect():
        v = values[r.id]
        assert (r.is_odd, r.plain, r.skeleton, r.extra) == (odd_characters(v), plain_form(v, known), skeleton(v, known.prototype), "keep"), v
        assert not r.plain_odd


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([("a​", "old", "old")], "value string, plain string, __forms string")
    assert annotate(df, "value").first().plain == "a"
    with pytest.raises(ValueError):
        annotate(df, "plain")


def test_groups(spark):
    df = spark.createDataFrame([("Wisp",), ("Wisp",), ("W​isp",), ("Wiѕp",), (None,), ("Other",)], "name string")
    got = {r.plain: (r.n_rows, r.n_forms) for r in look_alike_groups(df, "name").collect()}
    assert got == {"Wisp": (4, 3), "Other": (1, 1)}
    assert look_alike_groups(df.limit(0), "name").count() == 0


def test_the_whole_table(spark):
    known = look_alikes(spark)
    assert len(known.prototype) > 5000
    for a, b in (("ꓢtorm", "Storm"), ("ꓮꓳ", "AO"), ("ⲟⲣ", "op"), ("Ꮖce", "Ice"), ("0ak", "Oak"), ("1ce", "lce"), ("Ice", "lce"), ("bum", "burn"), ("𝐒torm", "Storm"), ("Ｓtorm", "Storm")):
        assert skeleton(a, known.prototype) == skeleton(b, known.prototype), (a, b)
    for a, b in (("ꓢtorm", "Storm"), ("Stⲟrm", "Storm"), ("ꓮnvil", "Anvil"), ("ꓳak Trее", "Oak Tree")):
        assert plain_form(a, known) == b and odd_characters(a)


def test_rows_come_from_their_skeleton(spark):
    names = ["Storm Crow"] * 300 + ["Stоrm Crow"] * 200 + ["Storm\u200b Crow", "Ⴝtorm Crow", "Café", "Cafe\u0301", "Knoll’s", "Knoll's", "Рост", "Poct", None, "", "  "]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(names)], "id int, name string, plain string").repartition(5)
    got = sorted(r.id for r in look_alike_rows(df, "name").collect())
    assert got == [i for i, n in enumerate(names) if odd_characters(n)] and len(got) >= 203
    assert look_alike_rows(df, "name").columns == ["id", "name", "plain"]
    assert look_alike_rows(df.limit(0), "name").count() == 0
