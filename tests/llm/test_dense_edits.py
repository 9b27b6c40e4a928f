import random

from weftline.llm.leakage import find_leaks


def test_words_dropped_and_inserted_up_to_the_allowed_stretch(spark):
    rnd, rows, items = random.Random(1), [], []
    for n in (20, 28, 40, 60, 99):
        kept, stretch = -(-n * 8 // 10), n * 13 // 10
        # What stands between two successive kept words: a word less, a word more, or nothing.
        gaps = ["less"] * (n - kept) + ["more"] * (stretch - kept)
        gaps += [""] * (kept - 1 - len(gaps))
        rnd.shuffle(gaps)
        item, text = [f"i{n}"], [f"i{n}"]
        for j, gap in enumerate(gaps):
            item += [f"d{n}x{j}"] * (gap == "less") + [f"i{n}x{j}"]
            text += [f"m{n}x{j}"] * (gap == "more") + [f"i{n}x{j}"]
        assert len(item) == n and len(text) == stretch
        rows.append((n, " ".join(["before"] * 9 + text + ["after"] * 9)))
        items.append((n, " ".join(item)))
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {tuple(r) for r in find_leaks(docs, "doc_id", "text", spark.createDataFrame(items, "item_id int, text string"), "item_id", "text").collect()}
    assert got == {(n, n) for n, _ in items}
