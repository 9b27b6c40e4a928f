"""Mapping free-entered values to a reference list: a trie searched with a Levenshtein automaton.

The entries (names and alias paths) form a trie, and their reversals a second one. A query's automaton
is the bit-parallel one: for each number of errors a word whose bit i says that the first i characters
of the query match the path so far. The frontier of all (query, node) pairs of a batch is advanced one
level at a time with array operations; queries that are longer than the bits of a word take several.
Of k errors either at most k // 2 come before the middle of a query, or at most (k - 1) // 2 come at the
middle or after it. So the trie is searched with what lies before the middle held to k // 2 errors, and
the reversed trie with all up to and with the middle held to (k - 1) // 2: one of both finds each entry.

An entry is within reach if its distance is at most ``share`` of its own length, so the distance allowed
depends on the entry. Rounds with growing distance stop as soon as a value has an entry: whatever is
found with at most k errors is the closest there is.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
import unicodedata
import uuid
import zlib
from collections.abc import Container, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.confusables import PROTOTYPE, invisible
from weftline.session import cut, tasks

_APOSTROPHES = dict.fromkeys(map(ord, "'’`´"))
_RUN = re.compile("[^0-9a-z]+")


def normalize(text: str) -> str:
    """Lower case, apostrophes deleted, every other run of signs a blank."""
    return _RUN.sub(" ", text.casefold().translate(_APOSTROPHES)).strip()


def fold(text: str) -> str:
    """As :func:`normalize`, with accents dropped and look-alike characters replaced first."""
    return _fold(text) if len(text) <= 200 else _fold.__wrapped__(text)


@functools.lru_cache(maxsize=1 << 14)
def _fold(text: str) -> str:
    if not text.isascii():
        text = "".join(PROTOTYPE.get(c, c) for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and not invisible(c))
    return normalize(text)


def _codes(texts: list[str], code: dict[str, int]) -> np.ndarray:
    width = max(map(len, texts), default=0)
    out = np.full((len(texts), width), -1, np.int32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = [code[c] for c in t]
    return out


def _lowest(bits: np.ndarray, words: int) -> np.ndarray:
    """Of each number the words that have so many of the lowest bits set: (words, numbers)."""
    n = np.clip(bits[None, :] - 64 * np.arange(words)[:, None], 0, 64)
    return np.where(n == 64, ~np.uint64(0), (np.uint64(1) << (n % 64).astype(np.uint64)) - np.uint64(1))


def _up(x: np.ndarray) -> np.ndarray:
    """All bits one place higher, from word to word."""
    y = x << np.uint64(1)
    if x.ndim > 1:
        y[1:] |= x[:-1] >> np.uint64(63)
    return y


@dataclass
class Trie:
    """Nodes level by level: children of a node are neighbours. ``entry`` is -1 within an entry."""

    code: dict[str, int]
    first: np.ndarray
    count: np.ndarray
    char: np.ndarray
    entry: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray
    lengths: np.ndarray

    @classmethod
    def build(cls, entries: list[str]) -> Trie:
        """``entries`` are distinct and not empty."""
        code = {c: i for i, c in enumerate(sorted(set().union(*entries)))}
        codes = _codes(entries, code)
        lengths = np.array([len(e) for e in entries], np.int32)
        node = np.zeros(len(entries), np.int64)
        firsts, counts, chars, ends, low, high = [], [], [np.array([0], np.int32)], [np.array([-1])], [], []
        start, width = 0, 1
        alive = np.arange(len(entries))
        for d in range(codes.shape[1] + 1):
            lo, hi = np.full(width, 1 << 30), np.zeros(width, np.int64)
            np.minimum.at(lo, node[alive] - start, lengths[alive])
            np.maximum.at(hi, node[alive] - start, lengths[alive])
            low.append(lo)
            high.append(hi)
            alive = alive[lengths[alive] > d]
            if not len(alive):
                firsts.append(np.full(width, start + width))
                counts.append(np.zeros(width, np.int64))
                break
            key = (node[alive] - start) * len(code) + codes[alive, d]
            made, which = np.unique(key, return_inverse=True)
            parent = made // len(code)
            n = np.bincount(parent, minlength=width)
            firsts.append(start + width + np.concatenate([[0], np.cumsum(n)[:-1]]))
            counts.append(n)
            chars.append((made % len(code)).astype(np.int32))
            start, width = start + width, len(made)
            node[alive] = start + which
            end = np.full(width, -1)
            whole = alive[lengths[alive] == d + 1]
            end[node[whole] - start] = whole
            ends.append(end)
        cat = np.concatenate
        return cls(code, cat(firsts).astype(np.int32), cat(counts).astype(np.int32), cat(chars), cat(ends).astype(np.int32), cat(low).astype(np.int32), cat(high).astype(np.int32), lengths)

    def search(self, queries: list[str], most: np.ndarray, held: np.ndarray, share: float, split: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, distance) of entries within ``most`` errors and ``share`` of their length.

        What comes before the middle of each query is held to ``held`` errors; if ``split`` is
        "second", what comes at the middle as well.
        """
        m = np.array([len(q) for q in queries], np.int64)
        top = int(most.max(initial=0))
        one = np.uint64(1)
        size = int(m.max(initial=0)) // 64 + 1
        masks = np.zeros((size, len(queries), len(self.code) + 1), np.uint64)
        for i, q in enumerate(queries):
            for j, c in enumerate(q):
                k = self.code.get(c)
                if k is not None:
                    masks[(j + 1) >> 6, i, k] |= one << np.uint64((j + 1) & 63)
        full = _lowest(m + 1, size)
        late = full & ~_lowest(m // 2 if split == "first" else m - m // 2 + 1, size)
        allowed = [np.where(e > most, np.uint64(0), np.where(e <= held, full, late)) for e in range(top + 1)]
        q = np.arange(len(queries))
        at = np.zeros(len(queries), np.int64)
        state = [_lowest(np.full(len(queries), e + 1), size) & allowed[e] for e in range(top + 1)]
        last, bit = m // 64, one << (m % 64).astype(np.uint64)
        if size == 1:  # the usual case, without the axis of the words
            masks, state, allowed = masks[0], [x[0] for x in state], [x[0] for x in allowed]
        held_at = np.arange(len(queries))  # where a pair's state stands
        hits = []
        while len(q):
            n = self.count[at]
            q = np.repeat(q, n)
            if not len(q):
                break
            child = np.repeat(self.first[at] + n - np.cumsum(n), n) + np.arange(len(q))
            # Lengths that no entry below can have with so few errors.
            ok = (self.longest[child] >= m[q] - most[q]) & (self.shortest[child] <= m[q] + most[q])
            origin = np.repeat(held_at, n)[ok]
            q, child = q[ok], child[ok]
            mask = masks[..., q, self.char[child]]
            new, before, made, live = [], None, None, None
            for e in range(top + 1):
                r = np.take(state[e], origin, axis=-1)
                x = _up(r) & mask
                if e:
                    x |= before | _up(before | made)
                x &= np.take(allowed[e], q, axis=-1)
                new.append(x)
                before, made = r, x
                live = x if live is None else live | x
            live = np.flatnonzero(live if size == 1 else live.any(axis=0))
            entry = self.entry[child]
            whole = np.flatnonzero(entry >= 0)
            for e in range(top + 1):
                ends = new[e][whole] if size == 1 else new[e][last[q[whole]], whole]
                got = whole[(ends & bit[q[whole]]) != 0]
                if len(got):
                    hits.append((q[got], entry[got], np.full(len(got), e)))
                    whole = np.setdiff1d(whole, got, assume_unique=True)
            q, at, state, held_at = q[live], child[live], new, live
        if not hits:
            z = np.empty(0, np.int64)
            return z, z, z
        hq, he, hd = (np.concatenate(x) for x in zip(*hits))
        near = hd <= np.floor(share * self.lengths[he] + 1e-9)
        return hq[near], he[near], hd[near]


@dataclass
class Lexicon:
    """Entries of a part of the list, their canonical values, and both tries."""

    entries: list[str]
    canonical: list[str]
    exact: dict[str, int]
    forward: Trie | None
    backward: Trie | None
    longest: int
    share: float

    @classmethod
    def build(cls, pairs: list[tuple[str, str]], share: float = 0.25) -> Lexicon:
        """``pairs`` of (entry, canonical): of an entry's canonical values its own, else the least."""
        best: dict[str, str] = {}
        for e, c in pairs:
            if e and (e not in best or (c != e, c) < (best[e] != e, best[e])):
                best[e] = c
        entries = sorted(best)
        tries = (Trie.build(entries), Trie.build([e[::-1] for e in entries])) if entries else (None, None)
        return cls(entries, [best[e] for e in entries], {e: i for i, e in enumerate(entries)}, *tries, max(map(len, entries), default=0), share)

    def reach(self, n: int) -> int:
        """Most errors an entry may have that a query of ``n`` characters can be within."""
        return int(n * self.share / (1 - self.share) + 1e-9)

    def within(self, queries: list[str], most: int, frontier: int = 96) -> list[list[tuple[int, int]]]:
        """Of each query all (distance, entry) within ``most`` errors and the entry's own limit."""
        out: list[dict[int, int]] = [{} for _ in queries]
        near = self.longest + int(self.longest * self.share + 1e-9)  # no entry is near a longer query
        word = [i for i, q in enumerate(queries) if 0 < len(q) <= near]
        word.sort(key=lambda i: len(queries[i]))
        for a in range(0, len(word) if self.forward else 0, frontier):
            part = word[a : a + frontier]
            qs = [queries[i] for i in part]
            k = np.minimum([self.reach(len(q)) for q in qs], most)
            for trie, texts, held, split in ((self.forward, qs, k // 2, "first"), (self.backward, [q[::-1] for q in qs], (k - 1) // 2, "second")):
                use = np.flatnonzero(held >= 0)
                if not len(use):
                    continue
                hq, he, hd = trie.search([texts[i] for i in use], k[use], held[use], self.share, split)
                for i, e, d in zip(use[hq].tolist(), he.tolist(), hd.tolist()):
                    seen = out[part[i]]
                    seen[e] = min(d, seen.get(e, d))
        return [sorted((d, e) for e, d in x.items()) for x in out]

    def closest(self, groups: list[list[str]]) -> list[tuple[int, int, str] | None]:
        """Of each group of queries the closest entry as (distance, -length, entry), or None.

        Of equally close entries the longest is taken, then the least.
        """
        found: list[tuple[int, int, str] | None] = [None] * len(groups)
        for g, qs in enumerate(groups):
            hit = [(0, -len(q), q) for q in qs if q in self.exact]
            if hit:
                found[g] = min(hit)
        widest = max((self.reach(len(q)) for qs in groups for q in qs), default=0)
        tried = 0
        for most in (2, 4, widest):
            if most <= tried:
                continue
            open_ = [g for g, qs in enumerate(groups) if found[g] is None and any(self.reach(len(q)) > tried for q in qs)]
            texts = sorted({q for g in open_ for q in groups[g] if self.reach(len(q)) > tried})
            hits = dict(zip(texts, self.within(texts, most)))
            for g in open_:
                got = [(d, -len(self.entries[e]), self.entries[e]) for q in groups[g] for d, e in hits.get(q, ())]
                if got:
                    found[g] = min(got)
            tried = most
        return found


_NO_TITLE = re.compile(r"^\W*(?:illus\b|\d+[a-z]?\s*/\s*\d+|(?:\{[^}]*\})+\s*:)", re.I)


_DASH = re.compile(r"[—–-]|//")
_RUN_OF_LETTERS = re.compile(r"[^\W\d_]{3}")
_STRAY = re.compile(r"^(?:\d+x?|.)$")


# Flags of a line: nothing that could be a title, a type line, a line of rules text.
_NOTHING, _TYPE, _RULE = 1, 2, 4


@dataclass
class NoTitles:
    """A part of the lines that are no titles: type lines, and rules text of which lines may be a beginning."""

    known: frozenset[str]
    starts: list[str]

    def flags(self, lines: Sequence[str | None]) -> list[int]:
        """Flags of each line. Those of several parts are added with ``|``."""
        out = []
        for line in lines:
            if not line or _NO_TITLE.match(line):
                out.append(_NOTHING)
                continue
            f = fold(line)
            i = bisect.bisect_left(self.starts, f)
            rule = len(f) >= 4 and i < len(self.starts) and self.starts[i].startswith(f) or line.rstrip().endswith(".") and self._goes_on(f)
            out.append((_TYPE if f in self.known else 0) | (_RULE if rule else 0))
        return out

    def _goes_on(self, f: str) -> bool:
        """Whether a line of rules text stands at the beginning of ``f``."""
        end = len(f)
        while end >= 4:
            i = bisect.bisect_right(self.starts, f[:end]) - 1
            if i < 0:
                return False
            s = self.starts[i]
            same = next((n for n, (x, y) in enumerate(zip(s, f)) if x != y), min(len(s), len(f)))
            if same == len(s):
                return same >= 4
            end = min(end - 1, same)
        return False


def _titles(lines: Sequence[str | None], flags: Sequence[int]) -> dict[str, bool]:
    """Normalized forms that may be a title; False if they count only where they are themselves an entry.

    A form of one or two characters counts where the line has a run of three letters (of a script that
    normalizing drops), or where it is all there is: a single letter among signs or other lines is noise.
    """
    letters = [not x & _NOTHING and any(c.isalpha() for c in fold(t)) for t, x in zip(lines, flags)]
    usable = [ok and not x & (_TYPE | _RULE) for ok, x in zip(letters, flags)]
    loose = [u or bool(x & _TYPE) and not _DASH.search(t or "") for u, x, t in zip(usable, flags, lines)]
    out: dict[str, bool] = {}
    alone = sum(letters) == 1
    for k, line in enumerate(lines):
        if not letters[k]:
            continue
        brief = _RUN_OF_LETTERS.search(line) or alone and line.strip().isalpha()
        texts = [(line, True)] if usable[k] else []
        if k + 1 < len(lines) and letters[k + 1]:
            free = loose[k] and loose[k + 1]
            texts += [(f"{line} {lines[k + 1]}", free), (f"{line}{lines[k + 1]}", free)]
        for t, free in texts:
            for f in (fold(t),) if t.isascii() else dict.fromkeys((fold(t), normalize(t))):
                words = f.split()
                forms = [f]
                # Stray digits and single signs at the ends belong to no title.
                while len(words) > 1 and _STRAY.match(words[0]):
                    words = words[1:]
                while len(words) > 1 and _STRAY.match(words[-1]):
                    words = words[:-1]
                if free:
                    forms.append(" ".join(words))
                for x in forms:
                    if len(x) >= 3 or x and brief:
                        out[x] = out.get(x, False) or free
    return out


def title_candidates(lines: Sequence[str] | None, known: frozenset[str], starts: list[str], entries: Container[str] = ()) -> list[str]:
    """Normalized forms of the lines that may be a title, alone and with the line that follows.

    Lines of ``known`` (normalized type lines), beginnings of one of the sorted ``starts`` (rules
    text), artists, numbers and costs are no titles. Type lines without a dash may still be half of
    a title; other joins with a type or rules line count if they are themselves one of ``entries``.
    """
    lines = [] if lines is None else list(lines)
    return [f for f, free in _titles(lines, NoTitles(known, starts).flags(lines)).items() if free or f in entries]


@dataclass
class Route:
    """Shards of a list by length of the entries, and the shards a text of a length has to see."""

    place: list[tuple[int, int, int]]  # length of an entry, first shard, shards of that length
    first: np.ndarray
    last: np.ndarray

    @classmethod
    def plan(cls, lengths: list[tuple[int, int]], share: float, shard_entries: int) -> Route:
        """``lengths`` has (length, entries) in order."""
        place, low, high, room = [], [], [], 0
        for size, n in lengths:
            if n > shard_entries:  # one length alone takes several
                parts = -(-n // shard_entries)
                place.append((size, len(low), parts))
                low += [size] * parts
                high += [size] * parts
                room = 0
                continue
            if n > room:
                low.append(size)
                high.append(size)
                room = shard_entries
            place.append((size, len(low) - 1, 1))
            high[-1] = size
            room -= n
        longest = lengths[-1][0] if lengths else 0
        reach = np.floor(share * np.arange(longest + 1) + 1e-9).astype(np.int64)
        up, down = np.arange(longest + 1) + reach, np.arange(longest + 1) - reach  # both grow with the length
        m = np.arange(int(up[-1]) + 1)
        least, most = np.searchsorted(up, m, "left"), np.searchsorted(down, m, "right") - 1
        return cls(place, np.searchsorted(high, least, "left"), np.searchsorted(low, most, "right"))

    def shards(self, n: int) -> range:
        return range(int(self.first[n]), int(self.last[n])) if n < len(self.first) else range(0)


#: Most characters of lines that are no titles that go to the executors at once.
LINES_AT_ONCE = 32_000_000
_built: dict[tuple, Lexicon] = {}


def _parts(lines: DataFrame | Sequence[str]) -> Iterator[list[str]]:
    """The lines in parts of about LINES_AT_ONCE characters, at least one part."""
    if not isinstance(lines, DataFrame):
        yield list(lines)
        return
    name = lines.columns[0]
    held = lines.where(F.col(name).isNotNull()).select(name).distinct()
    n = max(1, -(-(held.agg(F.sum(F.length(name))).first()[0] or 0) // LINES_AT_ONCE))
    for i in range(n):
        yield [r[0] for r in held.where(F.pmod(F.xxhash64(name), F.lit(n)) == i).toLocalIterator()]


def _spread(rows: DataFrame) -> DataFrame:
    """Rows in at least as many partitions as there are tasks; an input with enough splits isn't moved."""
    n = tasks(rows.sparkSession)
    return rows if rows.rdd.getNumPartitions() >= n else rows.repartition(n)


def _list(entries: DataFrame) -> DataFrame:
    """Each entry with its canonical value: of several its own, else the least."""
    own = F.struct((F.col("canonical") != F.col("entry")).alias("other"), "canonical")
    return entries.where((F.length("entry") > 0) & F.col("canonical").isNotNull()).groupBy("entry").agg(F.min(own).alias("c")).select("entry", "c.canonical")


def _search(rows: DataFrame, prepare, answer, entries: DataFrame, kind: str, out: str, share: float, shard_entries: int) -> DataFrame:
    """Meet every row's texts with the list.

    ``prepare`` turns a batch of ``rows`` into (keys, texts with whether they may differ from an entry)
    and ``answer`` a lexicon, keys and texts into the rows of ``out``. A list of one shard goes to the
    executors as a whole. Of a larger one each shard is built where its texts are: texts go to the shards
    of entries that are as long as they may be, in groups of a bounded number of rows.
    """
    spark = rows.sparkSession
    given = cut(_list(entries))  # read several times below
    lengths = [(r.n, r["count"]) for r in given.groupBy(F.length("entry").alias("n")).count().orderBy("n").collect()]  # a row a length
    if sum(n for _, n in lengths) <= shard_entries:
        whole = spark.sparkContext.broadcast(Lexicon.build([(r.entry, r.canonical) for r in given.collect()], share))

        def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for a in range(0, len(b), 2000):
                    yield answer(whole.value, *prepare(b.iloc[a : a + 2000]))

        return rows.mapInPandas(look_up, out)

    route = Route.plan(lengths, share, shard_entries)
    n = rows.count()
    salts = max(-(-n // 50_000), -(-2 * tasks(spark) // len(route.place)))
    token = uuid.uuid4().hex

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for k, texts in zip(*prepare(b)):
                by: dict[int, list[str]] = {}
                for t, free in texts.items():
                    for s in route.shards(len(t)):
                        by.setdefault(s, []).append(t if free else f"={t}")
                made += [(k, s, zlib.crc32(repr((k, ts)).encode()) % salts, ts) for s, ts in by.items()]
            yield pd.DataFrame(made, columns=["k", "shard", "salt", "texts"])

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = (token, key[0])
        if held not in _built:
            _built.clear()  # one shard at a time in a process
            _built[held] = Lexicon.build(list(zip(right["entry"], right["canonical"])), share)
        texts = [{t[1:] if t[0] == "=" else t: t[0] != "=" for t in ts} for ts in left["texts"]]
        parts = [answer(_built[held], left["k"].iloc[a : a + 2000], texts[a : a + 2000]) for a in range(0, len(left), 2000)]
        return pd.concat(parts) if parts else answer(_built[held], left["k"], [])

    sent = rows.mapInPandas(send, f"k {kind}, shard int, salt int, texts array<string>")
    place = F.broadcast(spark.createDataFrame(route.place, "n int, first int, parts int"))  # a row a length
    shard = (F.col("first") + F.pmod(F.xxhash64("entry"), F.col("parts").cast("bigint"))).cast("int")
    sharded = given.withColumn("n", F.length("entry")).join(place, "n").select(shard.alias("shard"), "entry", "canonical", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return sent.groupBy("shard", "salt").cogroup(sharded.groupBy("shard", "salt")).applyInPandas(meet, out)


def map_values(
    values: DataFrame, key: str, lines: str, entries: DataFrame, known: DataFrame | Sequence[str], starts: DataFrame | Sequence[str], share: float = 0.25, shard_entries: int = 100_000,
) -> DataFrame:
    """(key, canonical, distance) of every row with at least one line; '' and null if none is near.

    ``entries`` has entry and canonical. ``lines`` is an array of strings; null lines are skipped,
    rows whose array is null or empty give no row, rows with a null key one for all of them. ``known``
    and ``starts`` are the type lines and the rules text, lists or tables of one column; a table of any
    size is taken in parts. Of equally close entries the longest holds, then the least.
    """
    kind = values.schema[key].dataType.simpleString()
    given = values.where(F.size(lines) > 0)
    rows = _spread(given.select(F.col(key).alias("k"), F.col(lines).alias("l"), F.array().cast("array<int>").alias("f")))
    parts = itertools.zip_longest(_parts(known), _parts(starts), fillvalue=())
    sc = values.sparkSession.sparkContext
    held = [sc.broadcast(_no_titles(types, rules)) for types, rules in parts]

    def flagged(part, l, f) -> list[int]:
        new = part.value.flags([] if l is None else l)
        return [x | y for x, y in zip(f, new)] if len(f) else new

    for part in held[:-1]:

        def stage(batches: Iterator[pd.DataFrame], part=part) -> Iterator[pd.DataFrame]:
            for b in batches:
                b["f"] = [flagged(part, x, f) for x, f in zip(b["l"], b["f"])]
                yield b

        rows = rows.mapInPandas(stage, f"k {kind}, l array<string>, f array<int>")
    last = held[-1]

    def prepare(b: pd.DataFrame):
        return b["k"], [_titles(x, flagged(last, x, f)) for x, f in zip(b["l"], b["f"])]

    def answer(lex: Lexicon, keys: pd.Series, texts: list[dict[str, bool]]) -> pd.DataFrame:
        got = lex.closest([[t for t, free in ts.items() if free or t in lex.exact] for ts in texts])
        return pd.DataFrame({
            "k": keys.to_numpy(),
            "canonical": [lex.canonical[lex.exact[g[2]]] if g else "" for g in got],
            "distance": pd.array([g[0] if g else None for g in got], "Int32"),
            "length": pd.array([-g[1] if g else None for g in got], "Int32"),
        })

    schema = f"k {kind}, canonical string, distance int, length int"
    out = _search(rows, prepare, answer, entries, kind, schema, share, shard_entries)
    nothing = given.select(F.col(key).alias("k"), F.lit("").alias("canonical"), F.lit(None).cast("int").alias("distance"), F.lit(None).cast("int").alias("length"))
    best = F.min(F.struct(F.col("distance").isNull().alias("none"), "distance", (-F.col("length")).alias("short"), "canonical")).alias("b")
    return out.unionByName(nothing).groupBy("k").agg(best).select(F.col("k").alias(key), "b.canonical", "b.distance")


def _no_titles(types: Sequence[str], rules: Sequence[str]) -> NoTitles:
    known = {fold(t) for t in types} | {fold(p) for t in types for p in t.replace("//", "—").split("—")}
    return NoTitles(frozenset(known - {""}), sorted({fold(t) for t in rules} - {""}))


def all_within(values: DataFrame, text: str, entries: DataFrame, share: float = 0.25, shard_entries: int = 100_000) -> DataFrame:
    """(text, entry, canonical, distance): every entry within reach of every distinct value, as it stands.

    Values that are null, empty or out of reach of all entries give no row.
    """
    kind = "string"
    rows = values.where(F.length(text) > 0).select(F.col(text).alias("k")).distinct().repartition(tasks(values.sparkSession))

    def prepare(b: pd.DataFrame):
        return b["k"], [{t: True} for t in b["k"]]

    def answer(lex: Lexicon, keys: pd.Series, texts: list[dict[str, bool]]) -> pd.DataFrame:
        qs = [t for ts in texts for t in ts]
        rows = [(q, lex.entries[e], lex.canonical[e], d) for q, near in zip(qs, lex.within(qs, lex.longest)) for d, e in near]
        return pd.DataFrame(rows, columns=["text", "entry", "canonical", "distance"])

    return _search(rows, prepare, answer, entries, kind, "text string, entry string, canonical string, distance int", share, shard_entries)
