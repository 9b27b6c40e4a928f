import random

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import lexicon
from weftline.llm.lexicon import Lexicon, NoTitles, all_within, fold, map_values, normalize, title_candidates


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


WORDS = st.text("abc ", min_size=1, max_size=14).map(str.strip).filter(bool)


@settings(max_examples=120, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=25), st.lists(WORDS, min_size=1, max_size=6))
def test_all_within_reach(entries, queries):
    lex = Lexicon.build([(e, e) for e in entries])
    for q, got in zip(queries, lex.within(queries, 99)):
        want = sorted((d, i) for i, e in enumerate(lex.entries) if (d := levenshtein(q, e)) <= len(e) // 4)
        assert got == want


def test_long_values():
    rnd = random.Random(3)
    names = ["".join(rnd.choice("abcdefg ") for _ in range(n)).strip() or "a" for n in (10, 30, 60, 62, 63, 70, 120, 300)]
    lex = Lexicon.build([(n, n) for n in names])
    for n in names:
        broken = n[:5] + "x" + n[6:]
        assert lex.closest([[broken]])[0][2] == n
    assert lex.closest([["q" * 200], [], [""]]) == [None, None, None]


def test_ties_and_alias_paths():
    lex = Lexicon.build([("storm crow", "storm crow"), ("storm crew", "storm crew"), ("crow", "storm crow"), ("crow", "crow"), ("krähe", "storm crow"), ("", "x")])
    assert lex.canonical[lex.exact["crow"]] == "crow"
    assert lex.closest([["storm crw"]])[0] == (1, -10, "storm crew")
    assert lex.closest([["storm crow"], ["zzzz"]])[1] is None


def test_normalization():
    assert normalize("Nicol’s Bolas, Dragon-God") == "nicols bolas dragon god"
    assert fold("Knêll оf X") == "knell of x" and normalize("Knêll") == "kn ll"


def test_titles():
    types, rules = frozenset({"unit smith", "relic"}), ["draw two cards", "when this unit arrives reveal a card"]
    got = title_candidates(["Unit — Smith", "Illus. Ann Bo", "12/300", "{2}: This", "When this unit arri", "2x Storm Crow", None, "", "Brackh", "olt Verge"], types, rules)
    assert "storm crow" in got and "brackholt verge" in got and "brackh olt verge" in got
    assert not any("illus" in g or "smith" in g or "arri" in g for g in got)
    assert title_candidates(None, types, rules) == []


def test_map_values(spark):
    rnd = random.Random(5)
    names = ["".join(rnd.choice("abcdefghij") for _ in range(9)) + f" {w}" for w in ("anvil", "crow", "lantern", "golem") for _ in range(30)]
    rows, want = [], {}
    for i in range(120):
        n = rnd.choice(names)
        kind = i % 4
        if kind == 0:
            rows.append((i, [n.upper(), "Relic"], "x"))
        elif kind == 1:
            rows.append((i, ["Relic", n[:4] + "q" + n[5:]], "x"))
        elif kind == 2:
            a, b = n.split()
            rows.append((i, [a, b], "x"))
        else:
            rows.append((i, ["zzzzzzzz yyyyyyy"], "x"))
            n = ""
        want[i] = n
    rows += [(500, None, "x"), (501, [], "x"), (502, [None, ""], "x"), (0, rows[0][1], "x"), (503, ["w" * 20_000], "x")]
    want |= {502: "", 503: ""}
    df = spark.createDataFrame(rows, "obs int, lines array<string>, entry string")
    entries = spark.createDataFrame([(n, n) for n in names] + [("", "x"), (None, "y"), (names[0], names[0])], "entry string, canonical string")
    got = {r.obs: r.canonical for r in map_values(df, "obs", "lines", entries, ["relic"], []).collect()}
    assert got == want
    sharded = {r.obs: r.canonical for r in map_values(df, "obs", "lines", entries, ["relic"], [], shard_entries=25).collect()}
    assert sharded == want
    assert map_values(df.limit(0), "obs", "lines", entries, [], []).count() == 0
    assert {r.canonical for r in map_values(df, "obs", "lines", entries.limit(0), [], []).collect()} == {""}


def test_errors_at_the_middle_and_other_alphabets():
    rnd = random.Random(9)
    for _ in range(60):
        letters = rnd.choice(["ab", "abc ", "abéß"])
        entries = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 80))) for _ in range(12)]
        lex = Lexicon.build([(e, e) for e in entries])
        queries = []
        for e in entries:
            q = list(e)
            for _ in range(rnd.randrange(len(e) // 4 + 2)):
                i = rnd.randrange(len(q) + 1)
                q[i : i + rnd.randrange(2)] = rnd.choice(["", rnd.choice(letters)])
            queries.append("".join(q))
        for q, got in zip(queries, lex.within(queries, 99)):
            assert got == sorted((d, i) for i, e in enumerate(lex.entries) if q and (d := levenshtein(q, e)) <= len(e) // 4)


def test_short_entries_are_found():
    lex = Lexicon.build([("e", "grove"), ("ox", "ox"), ("storm crow", "storm crow")])
    found = lambda *lines: lex.closest([title_candidates(lines, frozenset(), [], lex.exact)])[0]
    assert [found("E"), found(" Ox "), found("Грызарe", "Unit"), found("o"), found("9")] == [(0, -1, "e"), (0, -2, "ox"), (0, -1, "e"), None, None]
    assert found("_e_") is None and found("e", "Storm Crw") == (1, -10, "storm crow")


def test_rules_in_parts_flag_the_same_lines():
    rules = sorted(["draw", "draw a card", "when this dies bury two", "guard"])
    lines = ["Draw b.", "When this di", "Guard the gate.", "Guar", "When this dies bury two cards.", "Gua", None, "Storm Crow"]
    whole = NoTitles(frozenset({"relic"}), rules).flags(lines)
    parts = [NoTitles(frozenset(), [r]).flags(lines) for r in rules] + [NoTitles(frozenset({"relic"}), []).flags(lines)]
    assert [x | 0 for x in whole] == [a | b | c | d | e for a, b, c, d, e in zip(*parts)]
    assert [bool(x & 4) for x in whole] == [True, True, True, True, True, False, False, False]


def test_all_within_equals_plain(spark):
    rnd = random.Random(6)
    entries = ["".join(rnd.choice("abcd ") for _ in range(rnd.randrange(1, 30))).strip() or "a" for _ in range(80)]
    texts = [e[:3] + rnd.choice("abx") + e[3 + rnd.randrange(2) :] for e in entries] + [None, "", "zzzz", "q" * 5000]
    want = sorted((t, e, levenshtein(t, e)) for t in {x for x in texts if x and len(x) < 99} for e in set(entries) if levenshtein(t, e) <= len(e) // 4)
    v = spark.createDataFrame([(t, "x") for t in texts], "text string, entry string")
    e = spark.createDataFrame([(x, x) for x in entries] + [(None, "y"), ("", "z")], "entry string, canonical string")
    for shard in (100_000, 9):
        assert sorted((r.text, r.entry, r.distance) for r in all_within(v, "text", e, shard_entries=shard).collect()) == want
    assert all_within(v, "text", e.limit(0)).count() == 0


def test_lines_in_parts(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "LINES_AT_ONCE", 12)
    df = spark.createDataFrame([(1, ["Relic", "Guard the gate.", "Storm Crow"]), (2, ["Draw a c", "Relic — Golem"]), (None, ["Storm Craw"])], "k int, l array<string>")
    entries = spark.createDataFrame([("storm crow", "storm crow"), ("draw a c", "no"), ("golem", "no")], "entry string, canonical string")
    known, rules = spark.createDataFrame([("Relic — Golem",), ("Relic",), (None,)], "t string"), spark.createDataFrame([("Guard",), ("Draw a card",), (None,)], "r string")
    got = {r.k: r.canonical for r in map_values(df, "k", "l", entries, known, rules).collect()}
    assert got == {1: "storm crow", 2: "", None: "storm crow"}
