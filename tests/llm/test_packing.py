import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.packing import VOCABULARY, encoder, pack, pack_histogram


def check(counts, capacity):
    groups = pack_histogram(dict(counts), capacity)
    got = {}
    for g in groups:
        assert g.count > 0 and g.free >= 0 and sum(s * k for s, k in g.items.items()) + g.free == capacity
        for s, k in g.items.items():
            got[s] = got.get(s, 0) + k * g.count
    assert got == {s: n for s, n in counts.items() if n}
    return sum(g.count for g in groups)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_everything_is_packed_once(counts):
    n = check(counts, 30)
    total = sum(s * k for s, k in counts.items())
    assert n >= -(-total // 30)


def best(items, capacity):
    """Fewest containers of a few items, by trying all."""
    items = sorted(items, reverse=True)

    def go(i, free, limit):
        if i == len(items):
            return True
        seen = set()
        for b in range(len(free)):
            if free[b] >= items[i] and free[b] not in seen:
                seen.add(free[b])
                free[b] -= items[i]
                if go(i + 1, free, limit):
                    free[b] += items[i]
                    return True
                free[b] += items[i]
        if len(free) < limit:
            free.append(capacity - items[i])
            ok = go(i + 1, free, limit)
            free.pop()
            return ok
        return False

    n = 0
    while not go(0, [], n):
        n += 1
    return n


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_near_the_optimum(items):
    counts = {s: items.count(s) for s in items}
    assert check(counts, 20) <= best(items, 20) + 1


def test_bulk_is_bounded():
    groups = pack_histogram({600: 3_000_000, 1000: 1_000_000, 1048: 1_000_001}, 2048)
    assert len(groups) < 50


def test_sizes_beyond_capacity_are_refused():
    with pytest.raises(ValueError):
        pack_histogram({11: 1}, 10)


def test_texts(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(rnd.choice([1, 3, 9, 30, 80]))), "x") for i in range(300)]
    rows += [(900, None, "x"), (901, "", "x"), (902, " ".join(word() for _ in range(900)), "x"), (903, "same text", "x"), (903, "same text", "x"), (None, "no key", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, piece string, container string").withColumnsRenamed({"piece": "text"})
    out = pack(df, "doc_id", "text", 128, salt_rows=10).collect()
    enc = encoder(open(VOCABULARY, "rb").read())
    size = {}
    for d, t, _ in rows:
        size.setdefault(d, []).append(len(enc.encode_ordinary(t or "")))
    fill, pieces = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r.n_tokens)
        if r.n_tokens:
            fill[r.container] = fill.get(r.container, 0) + r.n_tokens
        else:
            assert r.container == 0
    assert max(fill.values()) <= 128
    for d, s in size.items():
        assert sum(pieces[d]) == sum(s)
        if max(s) <= 128:
            assert sorted(pieces[d]) == sorted(s)
    assert sorted(pieces[902], reverse=True)[:-1] == [128] * (size[902][0] // 128)
    assert len(fill) <= -(-sum(fill.values()) // 128) + 3


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0
