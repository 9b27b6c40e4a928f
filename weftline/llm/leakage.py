"""Test passages that leaked into a corpus, found by seed hashing.

A seed is a mask over word positions; positions that it ignores may differ. The hashes of the test
items' words under each mask are joined with those of every corpus position. An item's hits within a
stretch of a text are counted, and where there are enough, the overlap around them is verified with
substitutions, insertions and deletions allowed. Runs of ``run`` equal words are found by the mask
that ignores nothing.

Which overlaps the seeds can't miss: of an item of n words, k = 80 % stand in order in a stretch of
s = 1.3 n words. Of the k - 1 pairs of successive kept words each of the n - k words left out and of
the s - k further words parts at most one, so 3 k - 1 - n - s pairs (at least one from 20 words on)
stand side by side in both. Every stretch with that many is verified. Items of fewer than ``short``
words use masks of two words, with and without a gap, and one hit.

The test items are a stated query set: they are taken in blocks of at most ``block_words`` words,
whose index (about 100 bytes a word) goes to the executors; each block meets all texts. A pass over
the texts, which are split into words once, takes ``blocks_a_pass`` blocks.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.confusables import PROTOTYPE, invisible

SHORT_MASKS = ((0, 1), (0, 2))
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Fold(dict):
    """Translation that drops what is invisible and puts look-alikes and marks in plain form."""

    def __missing__(self, o: int):
        c = chr(o)
        if invisible(c):
            out = ""
        else:
            flat = "".join(PROTOTYPE.get(x, x) for x in unicodedata.normalize("NFKD", PROTOTYPE.get(c, c)))
            out = "".join(x for x in flat if not unicodedata.combining(x)).lower()
        self[o] = out
        return out


_FOLD = _Fold()


def words(text: str | None) -> list[str]:
    """Runs of letters and digits without case, marks, look-alikes and invisible characters."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.lower() if text.isascii() else text.translate(_FOLD))


def _hash(ids: np.ndarray, mask: tuple[int, ...], tag: int) -> np.ndarray:
    """Hash of the words under ``mask`` at each position; positions past the end are left out."""
    n = len(ids) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, tag + 1, np.uint64)
    for off in mask:
        h = (h ^ ids[off : off + n].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


@dataclass
class SeedIndex:
    """Hashes of a block of test items under all masks, with what is needed to verify."""

    item_ids: list
    vocabulary: dict[str, int]
    items: list[np.ndarray]
    hashes: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    bits: np.ndarray
    masks: tuple
    need: np.ndarray
    kept: np.ndarray
    stretch: np.ndarray
    run: int
    members: dict

    @classmethod
    def build(cls, items: list[tuple[object, str]], run: int, share: float, longer: float, short: int) -> SeedIndex:
        split = [(i, w) for i, t in items if (w := words(t))]
        vocabulary: dict[str, int] = {}
        ids = [np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w], np.int64) for _, w in split]
        masks = (*SHORT_MASKS, (0,), tuple(range(run)))
        h, o = [], []
        for k, w in enumerate(ids):
            use = SHORT_MASKS[:1] if len(w) >= short else SHORT_MASKS if len(w) >= 2 else ((0,),)
            for m in (*use, masks[-1]):
                x = np.unique(_hash(w, m, masks.index(m)))
                h.append(x)
                o.append(np.full(len(x), k, np.int32))
        hashes = np.concatenate(h) if h else np.empty(0, np.uint64)
        owner = np.concatenate(o) if o else np.empty(0, np.int32)
        order = np.lexsort((owner, hashes))
        hashes, owner = hashes[order], owner[order]
        unique, first = np.unique(hashes, return_index=True)
        bits = np.zeros(1 << 22, np.bool_)  # 4 MB: most corpus positions end here
        bits[(unique >> np.uint64(42)).astype(np.int64)] = True
        n = np.array([len(w) for w in ids], np.int64)
        kept, stretch = np.ceil(share * n - 1e-9).astype(np.int64), np.floor(longer * n + 1e-9).astype(np.int64)
        # Of the kept - 1 pairs of successive kept words, each word of the item left out and each
        # further word of the stretch parts at most one; the others are seeds.
        need = np.where(n >= short, np.maximum(1, 3 * kept - 1 - n - stretch), 1)
        return cls([i for i, _ in split], vocabulary, ids, unique, np.append(first, len(hashes)), owner, bits, masks, need, kept, stretch, run, {})

    def member(self, i: int) -> np.ndarray:
        """Of each word id whether item ``i`` has it; a bounded number of items is kept."""
        if i not in self.members:
            if len(self.members) * len(self.vocabulary) > 1 << 25:
                self.members.clear()
            self.members[i] = np.zeros(len(self.vocabulary) + 1, np.bool_)
            self.members[i][self.items[i]] = True
        return self.members[i]

    def probe(self, ids: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, item) of every hit of mask ``m``."""
        h = _hash(ids, self.masks[m], m)
        at = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
        if not len(at):
            return at, at
        k = np.searchsorted(self.hashes, h[at]).clip(0, len(self.hashes) - 1)
        hit = self.hashes[k] == h[at]
        at, k = at[hit], k[hit]
        n = self.first[k + 1] - self.first[k]
        which = np.repeat(self.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.owner[which]


def in_order(item: np.ndarray, text: np.ndarray) -> int:
    """Most words of ``item`` that stand in ``text`` in their order, a bit a word of the item."""
    at: dict[int, int] = {}
    for j, w in enumerate(item.tolist()):
        at[w] = at.get(w, 0) | 1 << j
    full = (1 << len(item)) - 1
    v = full
    for w in text.tolist():
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def verified(item: np.ndarray, text: np.ndarray, kept: int, stretch: int, member: np.ndarray) -> bool:
    """Whether ``kept`` words of ``item`` stand in order in some stretch of that many words of ``text``.

    ``member`` says of each word id whether the item has it.
    """
    here = member[text]
    if np.count_nonzero(here) < kept:
        return False
    c = np.concatenate([[0], np.cumsum(here)])
    ends = np.minimum(np.arange(len(text)) + stretch, len(text))
    starts = np.flatnonzero((c[ends] - c[:-1] >= kept) & here)
    if not len(starts):
        return False
    lo, hi = starts[0], min(len(text), starts[-1] + stretch)
    if in_order(item, text[lo:hi]) < kept:
        return False
    return any(in_order(item, text[s : s + stretch]) >= kept for s in starts.tolist())


def _count_of(cells: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(cells, wanted).clip(0, len(cells) - 1)
    return np.where(cells[at] == wanted, counts[at], 0)


def _leaks(batch: list[list[str]], index: SeedIndex) -> set[tuple[int, int]]:
    """(text, item) of the batch's texts that hold an item's passage."""
    get = index.vocabulary.get
    found: set[tuple[int, int]] = set()
    n_items = len(index.items)
    widest = int(index.stretch.max(initial=1))
    ids, sizes, unknown = [], [], len(index.vocabulary)
    gap = [-1] * max(index.run, 4)
    for k, w in enumerate(batch):
        ids.extend(map(get, w, itertools.repeat(-1)))
        ids += gap  # no seed spans two texts
        sizes.append(len(w) + len(gap))
    ids, owner = np.array(ids, np.int64), np.repeat(np.arange(len(batch)), sizes)
    # Unknown words differ from every word, so that no hash of the index has them.
    ids = np.where(ids < 0, unknown, ids)
    start = np.searchsorted(owner, np.arange(len(batch) + 1))
    at, item = index.probe(ids, len(index.masks) - 1)
    for p, i in zip(at.tolist(), item.tolist()):
        found.add((int(owner[p]), i))
    # Stretches of twice the widest item, each position in two of them: no passage is cut in both.
    piece = (np.arange(len(ids)) - start[owner]) // widest
    base = np.concatenate([[0], np.cumsum(-(-np.diff(start) // widest) + 1)])
    # Only cells with hits are kept, so memory grows with the hits and not with pieces times items.
    hits = []
    for m in range(len(index.masks) - 1):
        at, item = index.probe(ids, m)
        hits.append((base[owner[at]] + piece[at]) * n_items + item)
    cells, counts = np.unique(np.concatenate(hits), return_counts=True)
    if not len(cells):
        return found
    window = np.union1d(cells, cells[cells >= n_items] - n_items)
    both = _count_of(cells, counts, window) + _count_of(cells, counts, window + n_items)
    p, i = np.divmod(window[both >= index.need[window % n_items]], n_items)
    of = np.searchsorted(base, p, "right") - 1
    real = p < base[of + 1] - 1  # the last piece of each text is empty, a space to the next
    t, p, i = of[real], p[real], i[real]
    lo = start[t] + (p - base[t]) * widest
    hi = np.minimum(start[t + 1], lo + 2 * widest)
    order = np.argsort(i, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(i[order])) + 1) if len(order) else ():
        k = int(i[part[0]])
        member, kept, stretch = index.member(k), int(index.kept[k]), int(index.stretch[k])
        if len(part) > 3:  # one look at all texts: places from which a stretch has enough of the item's words
            at = np.flatnonzero(member[ids])
            good = at[np.searchsorted(at, at + stretch, "left") - np.arange(len(at)) >= kept]
            part = part[np.searchsorted(good, hi[part], "left") > np.searchsorted(good, lo[part], "left")]
        for x in part.tolist():
            pair = (int(t[x]), k)
            if pair not in found and verified(index.items[k], ids[lo[x] : hi[x]], kept, stretch, member):
                found.add(pair)
    return found


def find_leaks(
    docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str,
    run: int = 12, share: float = 0.8, longer: float = 1.3, short: int = 20, block_words: int = 500_000, blocks_a_pass: int = 4,
) -> DataFrame:
    """(key, item_key) of every text that holds ``run`` successive words of an item, or ``share`` of
    all its words in order within a stretch of ``longer`` times its length.

    Null and empty texts and items have no words and give no row. Pairs are distinct. Every text is
    read whole; texts of any length are taken in stretches.
    """
    spark = docs.sparkSession
    out = None
    kinds = f"k {docs.schema[key].dataType.simpleString()}, i {items.schema[item_key].dataType.simpleString()}"
    corpus = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    blocks = _blocks(items, item_key, item_text, block_words)
    while part := list(itertools.islice((spark.sparkContext.broadcast(SeedIndex.build(b, run, share, longer, short)) for b in blocks), blocks_a_pass)):

        def search(batches: Iterator[pd.DataFrame], part=part) -> Iterator[pd.DataFrame]:
            for b in batches:
                keys, rows, held, size = b["k"].tolist(), [], [], 0
                for j, t in enumerate(b["t"]):
                    held.append((keys[j], words(t)))
                    size += len(held[-1][1]) + 16
                    if size > 40_000 or j == len(keys) - 1:
                        for ix in (x.value for x in part):
                            if ix.items:
                                rows += [(held[t][0], ix.item_ids[i]) for t, i in _leaks([w for _, w in held], ix)]
                        held, size = [], 0
                yield pd.DataFrame(rows, columns=["k", "i"])

        met = corpus.mapInPandas(search, kinds)
        out = met if out is None else out.unionByName(met)
    if out is None:
        out = spark.createDataFrame([], kinds)
    return out.distinct().select(F.col("k").alias(key), F.col("i").alias(item_key))


def _blocks(items: DataFrame, key: str, text: str, most: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of at most ``most`` words (an item that is longer alone is a block)."""
    sized = items.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.size(F.split(F.col(text), r"\s+")).alias("n"))
    total = sized.agg(F.sum("n").alias("n"), F.count("*").alias("c")).first()
    if not total["c"]:
        return
    parts = max(1, -(-total["n"] // max(1, most // 2)))
    for p in range(parts):
        held, size = [], 0
        for r in sized.where(F.pmod(F.xxhash64("k", "t"), F.lit(parts)) == p).toLocalIterator():
            if held and size + r.n > most:
                yield held
                held, size = [], 0
            held.append((r.k, r.t))
            size += r.n
        if held:
            yield held
