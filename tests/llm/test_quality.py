import random

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.quality import Partial, WordCounts, chunks, get, part_of, text_counts, text_quality

COMMON = ["the", "of", "and", "a", "in", "is", "that", "on", "der", "die", "und"]
PROSE = "The lantern on the shelf is old and the keeper of the house said that a storm was in the air. "


def form(text):
    p = part_of(text, WordCounts(frozenset(COMMON))).result()
    n = get(p[0], "words")
    names = ("prose", "list", "table", "junk")
    return None if n == 0 else "prose" if 2 * sum(p[1][1:]) <= n else max(zip(p[1][1:], names[1:]), key=lambda x: x[0])[1]


def test_forms():
    assert form(PROSE * 3) == form((PROSE * 3).upper()) == form((PROSE * 3).lower().replace(".", "")) == "prose"
    assert form("\n".join((PROSE * 5)[i : i + 45] for i in range(0, 300, 45))) == "prose"
    assert form("\n".join(f"- Name of Thing{i}, signed" for i in range(9))) == "list"
    assert form("\n".join(f"Quarry Harrier{i}" for i in range(9))) == "list"
    assert form("\n".join(f"{i};greenfield;0.{i};Big Name" for i in range(9))) == "table"
    assert form("| a | b |\n|---|---|\n| 1 | x |\n| 2 | y |") == "table"
    assert form("\n".join(f"{i}\t{i * 7}\tabc{i}" for i in range(9))) == "table"
    assert form("qzxv mmrt pplk wqrt zzkp xxvq\nbvcx nnmk qwrt ppls kkjh mnbv") == "junk"
    assert form("#### %%%% @@@@ ==== ~~~~\n&&&& **** ++++ ----") == "junk"
    assert form("Home Share Filter Reply Next » Quote Page Report Basket (0) Sets Help Top Newest Home Filter Reply Next » Quote") == "junk"
    assert form("Nach\n" * 12) == "junk"
    assert form("") is None and form(" \n \n") is None
    assert form("".join(PROSE for _ in range(2)) + "\n\n" + "\n".join(f"- Thing{i}" for i in range(4))) == "prose"


LINES = st.lists(st.sampled_from([PROSE, PROSE * 3, "Nach Haus " * 40, "one two three four five six seven eight nine ten " * 6, "", "- Name of Thing", "1;2;3;x", "Quarry Harrier", "qzxv mmrt pplk wqrt zzkp", "a,b", "The end. ", "\t", "Nach", "x" * 90]), max_size=12)


@settings(max_examples=150, deadline=None)
@given(LINES, st.integers(100, 400))
def test_chunks_merge_to_the_whole(lines, size):
    text, counts = "\n".join(lines), WordCounts(frozenset(COMMON))
    p = Partial()
    for c, g in chunks(text, size):
        p = p.merge(part_of(c, counts, g))
    assert p.result() == part_of(text, counts).result()
    assert "".join(c for c, _ in chunks(text, size)) == text


def test_merging_is_associative():
    rnd = random.Random(2)
    text, counts = "\n".join(rnd.choice([PROSE, "", "- Thing", "1;2;3"]) for _ in range(60)), WordCounts(frozenset(COMMON))
    parts = [part_of(c, counts, g) for c, g in chunks(text, 150)]
    left = Partial()
    for p in parts:
        left = left.merge(p)
    while len(parts) > 1:
        parts = [a.merge(b) for a, b in zip(parts[::2], [*parts[1::2], *([Partial()] if len(parts) % 2 else [])])]
    assert parts[0].result() == left.result() == part_of(text, counts).result()


def test_chunked_table_equals_whole(spark):
    rnd = random.Random(4)
    rows = [(i, "\n".join(rnd.choice([PROSE, "", "- Thing of Name", "1;2;3;4"]) for _ in range(rnd.randrange(40))), "x") for i in range(40)]
    rows += [(100, None, "x"), (101, "", "x"), (102, "word " * 30_000, "x"), (103, "y" * 5000, "x"), (104, "dup", "x"), (104, "dup", "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_words string")
    a = sorted(map(tuple, text_counts(df, "doc_id", "text", COMMON, chunk=10**9).collect()))
    b = sorted(map(tuple, text_counts(df, "doc_id", "text", COMMON, chunk=700, fan=40, spread=1000).collect()))
    c = sorted(map(tuple, text_counts(df, "doc_id", "text", COMMON, chunk=500).collect()))
    assert a == b == c and len(a) == len(rows)
    q = {r.doc_id: r for r in text_quality(df, "doc_id", "text", COMMON).collect()}
    assert q[100].form is None and q[101].mean_word_length is None and q[102].n_words == 30_000
    assert text_quality(df.limit(0), "doc_id", "text", COMMON).count() == 0
