"""Filling containers of a fixed capacity with texts: dominance reduction, then best fit.

Sizes are whole numbers up to the capacity, so an instance of any number of texts is a histogram of
at most ``capacity`` counts; that is all the driver gets. Following Martello and Toth, sets of one
to three sizes that provably dominate every other container with their largest member are fixed, in
bulk; this is repeated until nothing can be fixed. What remains is packed by best fit in decreasing
order, again on counts: containers with the same content are one group, so the work and the result
are bounded by the capacity and not by the number of texts. Each text then finds its container from
its rank among the texts of its size, which is counted in two levels so that a size that a third of
all texts have doesn't meet in one task.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut

#: Vocabulary file of the tokenizer and the pattern that cuts texts before pairs are merged.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that this vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict[str, object] = {}


def encoder(vocabulary: bytes):
    """The tokenizer of a vocabulary file's content, once a process."""
    name = hashlib.sha256(vocabulary).hexdigest()
    if name not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        _encoders[name] = tiktoken.Encoding("container", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def count_tokens(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row; a null text has 0 tokens.

    The vocabulary file is read on the driver and its content, of a fixed size, goes to the executors.
    """
    with open(vocabulary, "rb") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(held.value).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "n_tokens": [len(enc(t)) if t else 0 for t in b["t"]]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(count, f"k {kind}, n_tokens bigint").withColumnRenamed("k", key)


@dataclass
class Group:
    """``count`` containers with the same content: ``items`` is size -> copies in each."""

    items: dict[int, int]
    count: int
    free: int


def _reduce(counts: np.ndarray, capacity: int) -> list[Group]:
    """Fix dominating sets and take them off ``counts`` (indexed by size)."""
    fixed: list[Group] = []

    def fix(times: int, *sizes: int) -> None:
        items: dict[int, int] = {}
        for s in sizes:
            items[s] = items.get(s, 0) + 1
            counts[s] -= times
        fixed.append(Group(items, times, capacity - sum(sizes)))

    changed = True
    while changed:
        changed = False
        for big in range(capacity, 0, -1):
            while counts[big]:
                rest = capacity - big
                counts[big] -= 1  # the others
                present = np.flatnonzero(counts[: rest + 1])
                present = present[present > 0]
                least = [] if not len(present) else np.repeat(present[:3], np.minimum(counts[present[:3]], 3))[:3].tolist()
                counts[big] += 1
                if not least:  # nothing fits beside it
                    fix(int(counts[big]) if 2 * big > capacity else 1, big)
                    changed = True
                    continue
                best = int(present[-1])
                pair_times = int(min(counts[big], counts[best])) if best != big else int(counts[big]) // 2
                if best == rest or len(least) < 2 or least[0] + least[1] > rest:
                    # An exact partner, or room for one only: the largest partner dominates.
                    fix(pair_times, big, best)
                    changed = True
                    continue
                if len(least) < 3 or sum(least) > rest:  # room for two: the best pair against the best single
                    a, b = _best_pair(counts, big, rest)
                    if best >= a + b:
                        fix(pair_times, big, best)
                        changed = True
                        continue
                    if best == max(a, b) and len(set(np.flatnonzero(counts[min(a, b) : rest + 1]).tolist())) == 1:
                        # No other size is as large as the smaller of the two: a and b are equal.
                        fix(int(counts[big]) // 3 if a == big else min(int(counts[big]), int(counts[a]) // 2), big, a, b)
                        changed = True
                        continue
                break
    return fixed


def _best_pair(counts: np.ndarray, big: int, rest: int) -> tuple[int, int]:
    """Two of the other sizes with the greatest sum up to ``rest``; (0, 0) if there are none."""
    counts[big] -= 1
    sizes = np.flatnonzero(counts[: rest + 1])
    sizes = sizes[sizes > 0]
    best, i, j = (0, 0), 0, len(sizes) - 1
    while i <= j:
        a, b = int(sizes[i]), int(sizes[j])
        if a + b > rest or (i == j and counts[a] < 2):
            j -= 1
        else:
            if a + b > sum(best):
                best = (a, b)
            i += 1
    counts[big] += 1
    return best


def _best_fit(counts: np.ndarray, capacity: int) -> list[Group]:
    """Best fit in decreasing order of all that ``counts`` holds, a group of equal containers at a time."""
    by_free: dict[int, list[Group]] = {}
    frees: list[int] = []
    done: list[Group] = []

    def put(g: Group) -> None:
        if not g.count:
            return
        if g.free == 0:
            done.append(g)
            return
        if g.free not in by_free:
            by_free[g.free] = []
            bisect.insort(frees, g.free)
        by_free[g.free].append(g)

    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            at = bisect.bisect_left(frees, size)
            if at == len(frees):
                g = Group({}, left, capacity)  # new containers, as many as may be needed
            else:
                g = by_free[frees[at]].pop()
                if not by_free[g.free]:
                    del by_free[g.free]
                    frees.pop(at)
            each = g.free // size
            full, rest = min(g.count, left // each), 0
            if full < g.count:
                rest = left - full * each if full * each + each > left else 0
            left -= full * each + rest
            put(Group({**g.items, size: each}, full, g.free - each * size))
            if rest:
                put(Group({**g.items, size: rest}, 1, g.free - rest * size))
            if g.items:
                put(Group(g.items, g.count - full - bool(rest), g.free))
    return done + [g for f in frees for g in by_free[f]]


def pack_histogram(counts: dict[int, int], capacity: int) -> list[Group]:
    """Groups of containers that hold exactly the items of the histogram ``size -> count``."""
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        if not 0 < size <= capacity:
            raise ValueError(f"size {size} doesn't fit a container of {capacity}")
        hist[size] = n
    return _reduce(hist, capacity) + _best_fit(hist, capacity)


def slot_table(groups: list[Group], first: int) -> dict[str, np.ndarray]:
    """Of each size the ranks that go to each group: size, rank from which, first container, copies in each."""
    rows, used, container = [], {}, first
    for g in groups:
        for size, copies in sorted(g.items.items()):
            start = used.get(size, 0)
            rows.append((size, start, container, copies))
            used[size] = start + copies * g.count
        container += g.count
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"size": table[:, 0], "start": table[:, 1], "container": table[:, 2], "copies": table[:, 3]}


def pack(df: DataFrame, key: str, text: str, capacity: int = 2048, vocabulary: str = VOCABULARY, salt_rows: int = 100_000) -> DataFrame:
    """(key, piece, token_start, n_tokens, container) of every text and piece.

    A text of more than ``capacity`` tokens is cut into full pieces, each a container of its own,
    and a last piece that is packed with the rest; any other text is piece 0 as a whole. Null and
    empty texts have one piece of 0 tokens in container 0. Rows with a null or repeated key are
    texts of their own. An empty table gives no rows. Pieces of one size are ranked in groups of about
    ``salt_rows`` at most, however many there are.
    """
    spark = df.sparkSession
    sized = count_tokens(df, key, text, vocabulary).withColumnRenamed(key, "k")
    last = F.when(F.col("n_tokens") > 0, F.ceil(F.col("n_tokens") / F.lit(capacity)) - 1).otherwise(0).cast("int")
    pieces = sized.select("k", F.col("n_tokens").alias("all"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    pieces = pieces.select("k", "piece", start.alias("token_start"), F.least(F.lit(capacity).cast("bigint"), F.col("all") - start).alias("n_tokens"))
    pieces = cut(pieces)
    salts = max(1, -(-pieces.count() // salt_rows))
    full = pieces.where("n_tokens > 0").withColumn("salt", F.pmod(F.xxhash64("k", "piece", F.monotonically_increasing_id()), F.lit(salts)))
    counts = full.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    by_size = counts.groupBy("n_tokens").agg(F.sum("n").alias("n"))
    groups = pack_histogram({r.n_tokens: r.n for r in by_size.collect()}, capacity)  # at most `capacity` rows
    slots = spark.sparkContext.broadcast(slot_table(groups, 0))
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("n_tokens", "salt").orderBy("k", "piece")
    ranked = full.withColumn("r", F.row_number().over(within) - 1).join(offsets, ["n_tokens", "salt"])
    ranked = ranked.select("k", "piece", "token_start", "n_tokens", (F.col("offset") + F.col("r")).alias("rank"))

    @F.pandas_udf("bigint")
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        t = slots.value
        if not len(t["size"]):
            return pd.Series(np.zeros(len(size), np.int64))
        n = size.to_numpy(np.int64)
        r = rank.to_numpy(np.int64)
        lo, hi = np.searchsorted(t["size"], n, "left"), np.searchsorted(t["size"], n, "right")
        wide = int(max(t["start"].max(), r.max(initial=0))) + 1
        at = np.searchsorted(t["size"] * wide + t["start"], n * wide + r, "right") - 1
        at = np.clip(at, lo, np.maximum(hi - 1, lo)).clip(0, len(t["size"]) - 1)
        return pd.Series(t["container"][at] + (r - t["start"][at]) // t["copies"][at])

    put = ranked.select("k", "piece", "token_start", "n_tokens", container("n_tokens", "rank").alias("container"))
    empty = pieces.where("n_tokens = 0").select("k", "piece", "token_start", "n_tokens", F.lit(0).cast("bigint").alias("container"))
    return put.unionByName(empty).withColumnRenamed("k", key)
