import random
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.leakage import SeedIndex, _leaks, find_leaks, in_order, words


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=30), st.lists(st.integers(0, 6), max_size=30))
def test_in_order_is_the_longest_common_subsequence(a, b):
    assert in_order(np.array(a, np.int64), np.array(b, np.int64)) == lcs(a, b)


def test_words_ignore_what_does_not_matter():
    want = ["the", "lantern", "s", "9", "cafe"]
    for t in ("The lantern's 9 café", "THE *lantern’s* _9_\nCAFÉ", "t​he «lаntern» s 9 cafe", "Ｔhe <b>lantern</b> s 9 cafe"):
        assert words(t) == want
    assert words(None) == words("") == words(" .. ") == []


def leaks(doc, item, run=12, share=0.8, longer=1.3):
    d, i = words(doc), words(item)
    if not i or not d:
        return False
    if len(i) >= run and {tuple(i[p : p + run]) for p in range(len(i) - run + 1)} & {tuple(d[p : p + run]) for p in range(len(d) - run + 1)}:
        return True
    need, width = -(-len(i) * 8 // 10), len(i) * 13 // 10
    return any(lcs(i, d[s : s + width]) >= need for s in range(max(1, len(d) - need + 1)))


def test_against_brute_force(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, text(rnd.choice([2, 5, 14, 25, 40, 60]))) for i in range(30)]
    docs = []
    for d in range(250):
        t = text(rnd.randrange(0, 200))
        i = rnd.choice(items)[1]
        kind = rnd.randrange(6)
        p = list(i)
        if kind == 0:
            s = rnd.randrange(max(1, len(i) - 5))
            p = i[s : s + rnd.choice([8, 11, 12, 13, 20])]
        elif kind < 5:
            for _ in range(int(len(p) * rnd.choice([0.05, 0.15, 0.2, 0.25, 0.4]))):
                j = rnd.randrange(len(p))
                if kind == 1:
                    p[j] = rnd.choice(vocab)
                elif kind == 2 and len(p) > 1:
                    del p[j]
                elif kind == 3:
                    p.insert(j, rnd.choice(vocab))
                elif kind == 4:
                    k = rnd.randrange(len(p))
                    p[j], p[k] = p[k], p[j]
        at = rnd.randrange(len(t) + 1)
        docs.append((d, " ".join(t[:at] + p + t[at:]).upper() if d % 2 else ", ".join(t[:at] + p + t[at:])))
    docs += [(900, None), (901, ""), (902, " ".join(text(20_000) + items[5][1] + text(300)))]
    di = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id int, text string, item_id string")
    ii = spark.createDataFrame([(a, " ".join(b)) for a, b in items] + [(90, None), (91, " . ")], "item_id int, text string")
    got = {tuple(r) for r in find_leaks(di.drop("item_id"), "doc_id", "text", ii, "item_id", "text").collect()}
    want = {(d, i) for d, t in docs if d != 902 for i, w in items if leaks(t, " ".join(w))}
    assert {x for x in got if x[0] != 902} == want
    assert (902, 5) in got and any(len(items[i][1]) > 20 for _, i in want)
    blocks = {tuple(r) for r in find_leaks(di.drop("item_id"), "doc_id", "text", ii, "item_id", "text", block_words=200).collect()}
    assert blocks == got


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id int, text string")
    i = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id int, text string")
    assert find_leaks(d, "doc_id", "text", i, "item_id", "text").count() == 0
    assert find_leaks(i.withColumnRenamed("item_id", "doc_id"), "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_memory_follows_hits_and_not_items():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    texts = [[word() for _ in range(60)] for _ in range(200)]
    peaks = []
    for n in (500, 20_000):
        items = [(i, " ".join(word() for _ in range(15))) for i in range(n - 1)] + [(n, " ".join(texts[7][10:30]))]
        index = SeedIndex.build(items, 12, 0.8, 1.3, 20)
        tracemalloc.start()
        assert _leaks(texts, index) == {(7, n - 1)}
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0] + (1 << 21)
