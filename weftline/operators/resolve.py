"""Names for noisy queries: exact before fuzzy, identities before printings.

Exact hits are equi-joins. Only distinct queries without one are compared with the list: a stated set of
queries, against blocks of at most ``block_names`` names, each sent to the executors once. Within a block
the trigram postings give the names that share one, upper bounds of the score, from letter counts, common
words and common subsequences (of many queries at once), put them in order, and the gestalt ratio is
computed from the top until the bounds fall below the worst of the best found. A bound is never below the score, so nothing is lost.
"""

from __future__ import annotations

import bisect
import collections
import difflib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from weftline.functions.text import APOSTROPHES, clean_title_query, contains_noise, normalize_text, split_title_queries, title_quality
from weftline.operators.scoring import clamp
from weftline.session import cut, tasks

_LETTERS = {c: i for i, c in enumerate("0123456789abcdefghijklmnopqrstuvwxyz ")}
_OTHER, _NONE = len(_LETTERS), len(_LETTERS) + 1  # any other character, and the places after a text's end
_AT_ONCE = 256

# Weights and limits of a candidate's score.
TITLE_WEIGHT, LAYOUT_MATCH, LAYOUT_MISMATCH, NOISY_TITLE = 0.74, 0.03, 0.08, 0.04
TYPE_WEIGHT, LOWER_WEIGHT, TYPE_MISMATCH, LOWER_MISMATCH = 0.10, 0.13, 0.08, 0.05
LEAST_SCORE, FEW_NAMES, SHORT_QUERY, TITLE_ONLY = 0.55, 12, 4, 0.2


def _grams(v: str) -> set[str]:
    p = f"  {v} "
    return {p[i : i + 3] for i in range(len(p) - 2)}


def _codes(text: str) -> bytes:
    return bytes(_LETTERS.get(c, _OTHER) for c in text)


def in_order(positions: dict[str, int], size: int, text: str) -> int:
    """Length of the longest common subsequence; ``positions`` has a bit for each place of a character."""
    full = (1 << size) - 1
    v = full
    for c in text:
        u = v & positions.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def matched(a: str, b: str) -> int:
    """Characters in the blocks of a gestalt match, as difflib finds them in texts under 200 characters."""
    places: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        places.setdefault(c, []).append(j)
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a_from, a_to, b_from, b_to = todo.pop()
        at, to, best = a_from, b_from, 0
        runs: dict[int, int] = {}
        for i in range(a_from, a_to):
            longer: dict[int, int] = {}
            for j in places.get(a[i], ()):
                if j < b_from:
                    continue
                if j >= b_to:
                    break
                k = longer[j] = runs.get(j - 1, 0) + 1
                if k > best:
                    at, to, best = i - k + 1, j - k + 1, k
            runs = longer
        if best:
            total += best
            if a_from < at and b_from < to:
                todo.append((a_from, at, b_from, to))
            if at + best < a_to and to + best < b_to:
                todo.append((at + best, a_to, to + best, b_to))
    return total


def gestalt(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio() if len(b) >= 200 else 2.0 * matched(a, b) / (len(a) + len(b))


class NameBlock:
    """Forms of a block of names in order of length, with their letters, words and trigrams."""

    def __init__(self, forms: list[tuple[str, str]]):
        forms = sorted(forms, key=lambda f: (len(f[1]), f))
        self.keys = [k for k, _ in forms]
        self.texts = [t for _, t in forms]
        self.lengths = np.array([len(t) for t in self.texts], np.int32)
        longest = int(self.lengths.max(initial=1))
        codes = np.full((len(forms), longest), _NONE, np.uint8)
        for i, t in enumerate(self.texts):
            codes[i, : len(t)] = np.frombuffer(_codes(t), np.uint8)
        self.letters = np.stack([(codes == c).sum(axis=1, dtype=np.int8 if longest < 128 else np.int32) for c in range(_NONE)])  # a row a letter
        self.codes = np.ascontiguousarray(codes.T)  # a row a place
        ids = {k: i for i, k in enumerate(dict.fromkeys(self.keys))}
        self.key_ids = np.array([ids[k] for k in self.keys], np.int32)
        words: dict[str, list[int]] = {}
        grams: dict[str, list[int]] = {}
        for i, t in enumerate(self.texts):
            for w in set(t.split()):
                words.setdefault(w, []).append(i)
            for g in _grams(t):
                grams.setdefault(g, []).append(i)
        self.words = {w: np.array(x, np.int32) for w, x in words.items()}
        self.grams = {g: np.array(x, np.int32) for g, x in grams.items()}
        self.gram_keys = {g: len(np.unique(self.key_ids[x])) for g, x in self.grams.items()}

    def _likely(self, query: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, bool]:
        """(forms, their word overlap, whether they share a trigram, keys that do, whether only these count).

        The forms are those whose letters and words allow the least score. The number of keys is exact
        where it is below ``FEW_NAMES``, else a lower bound.
        """
        size, codes, own = len(query), _codes(query), set(query.split())
        shares = np.zeros(len(self.texts), bool)
        many = 0
        for g in _grams(query):
            if g in self.grams:
                shares[self.grams[g]] = True
                many = max(many, self.gram_keys[g])
        if many < FEW_NAMES:
            many = len(np.unique(self.key_ids[shares]))
        narrow = many >= FEW_NAMES and size >= SHORT_QUERY
        counts = collections.Counter(codes)

        def common(part) -> np.ndarray:
            out = np.zeros_like(self.letters[0, part])
            least = np.empty_like(out)
            for c, k in counts.items():
                out += np.minimum(self.letters[c, part], min(k, 127) if out.dtype == np.int8 else k, out=least)
            return out

        # Without a common word the lengths differ by a factor of two at most: 1.5 x the shorter / both + 0.05 >= 0.55.
        lo, hi = np.searchsorted(self.lengths, [(size + 1) // 2, 2 * size + 1]).tolist()
        total = self.lengths[lo:hi] + size
        near = common(slice(lo, hi))
        fits = 30 * near.astype(np.int32) >= (11 - (self.codes[0, lo:hi] == codes[0])) * total
        if narrow:
            fits &= shares[lo:hi]
        found = [self.words[w] for w in own if w in self.words]
        at, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        inside = (at >= lo) & (at < hi)
        fits[at[inside] - lo] = False
        overlap = n / max(1, len(own))
        letters = np.empty(len(at))
        letters[inside], letters[~inside] = near[at[inside] - lo], common(at[~inside])
        bound = 1.5 * letters / (self.lengths[at] + size) + 0.25 * overlap + np.where(self.codes[0, at] == codes[0], 0.05, 0.0)
        some = bound >= LEAST_SCORE - 1e-9
        if narrow:
            some &= shares[at]
        rest = np.flatnonzero(fits) + lo
        forms = np.concatenate([rest, at[some]])
        return forms, np.concatenate([np.zeros(len(rest)), overlap[some]]), shares[forms], many, narrow

    def _in_order(self, queries: list[str], forms: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of each form and the query ``of`` it, at most 64 characters long."""
        bits = np.zeros((len(queries), _NONE + 1), np.uint64)
        full = np.zeros(len(queries), np.uint64)
        for i, q in enumerate(queries):
            masks: dict[int, int] = {}
            for j, c in enumerate(_codes(q[:64])):
                masks[c] = masks.get(c, 0) | 1 << j
            for c, m in masks.items():
                bits[i, c] = m
            full[i] = (1 << min(64, len(q))) - 1
        order = np.argsort(-self.lengths[forms], kind="stable")  # the longest first, so that those not yet at their end come first
        forms, of = forms[order], of[order]
        left, base, flat = self.lengths[forms], of.astype(np.int64) * (_NONE + 1), bits.ravel()
        v = full[of]
        for j in range(int(left.max(initial=0))):
            n = int(np.searchsorted(-left, -j))
            w = v[:n]
            u = w & flat[base[:n] + self.codes[j, forms[:n]]]
            v[:n] = (w + u) | (w - u)
        out = np.empty(len(order), np.int64)
        out[order] = np.bitwise_count(full[of]).astype(np.int64) - np.bitwise_count(v & full[of])
        return out

    def search(self, queries: list[str], limit: int) -> Iterator[tuple[list[tuple[str, float, bool]], int]]:
        """For each query (key, score, shares a trigram) of the best keys that score enough, and how many keys share one.

        If enough keys share a trigram only these can count, and the ``limit`` best of them are given
        (more where the last ones are equal); else all keys that score enough. The number is exact where
        it is below ``FEW_NAMES``.
        """
        for start in range(0, len(queries), _AT_ONCE):
            some = queries[start : start + _AT_ONCE]
            likely = [self._likely(q) for q in some]
            sizes = [len(x[0]) for x in likely]
            lengths = self._in_order(some, np.concatenate([x[0] for x in likely]), np.repeat(np.arange(len(some)), sizes))
            end = 0
            for q, (forms, overlap, shares, many, narrow), n in zip(some, likely, sizes):
                end += n
                yield self._best(q, forms, overlap, shares, lengths[end - n : end], narrow, limit), many

    def _best(self, query: str, forms: np.ndarray, overlap: np.ndarray, shares: np.ndarray, lengths: np.ndarray, narrow: bool, limit: int) -> list[tuple[str, float, bool]]:
        if len(query) > 64:
            positions: dict[str, int] = {}
            for j, c in enumerate(query):
                positions[c] = positions.get(c, 0) | 1 << j
            lengths = np.array([in_order(positions, len(query), self.texts[i]) for i in forms.tolist()], np.int64)
        # The blocks of a gestalt match stand in order, so they can't be longer than this; 0.05 is for a beginning.
        bound = 1.5 * lengths / (self.lengths[forms] + len(query)) + 0.25 * overlap + np.where(self.codes[0, forms] == _codes(query[:1])[0], 0.05, 0.0)
        kept = np.flatnonzero(bound >= LEAST_SCORE - 1e-9)
        kept = kept[np.argsort(-bound[kept], kind="stable")]
        best: dict[str, tuple[float, bool]] = {}
        top: list[float] = []  # the best scores of different keys, worst first
        least = LEAST_SCORE
        for i, b, words, shared in zip(forms[kept].tolist(), bound[kept].tolist(), overlap[kept].tolist(), shares[kept].tolist()):
            if b < least - 1e-9:
                break
            t = self.texts[i]
            begins = t.startswith(query) or query.startswith(t)
            if not begins and t[0] == query[0] and b - 0.05 < least - 1e-9:
                continue
            s = min(0.99, 0.75 * gestalt(query, t) + 0.25 * words + (0.05 if begins else 0.0))
            if s >= LEAST_SCORE:
                key = self.keys[i]
                old = best.get(key)
                best[key] = (s, shared) if old is None else (max(s, old[0]), shared or old[1])
                if narrow and (old is None or s > old[0]):
                    if old is not None and old[0] in top:
                        top.remove(old[0])
                    bisect.insort(top, s)
                    if len(top) > limit:
                        top.pop(0)
                    if len(top) == limit:
                        least = max(LEAST_SCORE, top[0])
        return [(k, s, sh) for k, (s, sh) in best.items() if s >= least - 1e-9]


_built: dict[str, NameBlock] = {}  # of a Python worker: the block that it used last


def _block(name: str, forms: list[tuple[str, str]]) -> NameBlock:
    if name not in _built:
        _built.clear()
        _built[name] = NameBlock(forms)
    return _built[name]


def fuzzy_names(queries: DataFrame, names: DataFrame, limit: int = 5, block_names: int = 50_000) -> DataFrame:
    """(query, key, score, rank): the ``limit`` best keys of every distinct query, ties by key.

    ``names`` has key and form, several forms a key. A key counts if it shares a trigram with the
    query; where fewer than 12 do, or the query has fewer than 4 characters, all keys count.
    Null and empty queries give no row. The driver holds the forms of one block at a time; what
    is needed to search them is built on the executors.
    """
    spark = queries.sparkSession
    asked = queries.where(F.length("query") > 0).select("query").distinct().repartition(tasks(spark) * 2, "query")
    forms = names.where(F.length("form") > 0).select("key", "form").distinct()
    total = forms.count()
    blocks = max(1, -(-total // block_names))
    out = None
    for b in range(blocks):
        part = forms.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)
        sent, name = spark.sparkContext.broadcast([(r.key, r.form) for r in part.toLocalIterator()]), uuid.uuid4().hex

        def look(batches: Iterator[pd.DataFrame], sent=sent, name=name) -> Iterator[pd.DataFrame]:
            block = _block(name, sent.value)
            for batch in batches:
                rows, now = [], batch["query"].tolist()
                for q, (hits, n) in zip(now, block.search(now, limit)):
                    if blocks == 1:  # all is known here
                        every = n < FEW_NAMES or len(q) < SHORT_QUERY
                        best = sorted((-s, k) for k, s, shared in hits if shared or every)[:limit]
                        rows += [(q, k, -s, True, i) for i, (s, k) in enumerate(best, 1)]
                    else:
                        rows += [(q, k, s, sh, n) for k, s, sh in hits] or [(q, None, None, False, n)]
                yield pd.DataFrame(rows, columns=["query", "key", "score", "shares", "n"])

        found = asked.mapInPandas(look, "query string, key string, score double, shares boolean, n int")
        if blocks == 1:
            return found.select("query", "key", "score", F.col("n").alias("rank"))
        found = found.withColumn("block", F.lit(b))
        out = found if out is None else out.unionByName(found)
    per_block = Window.partitionBy("query", "block")
    one = out.repartition("query").withColumn("first", F.row_number().over(per_block.orderBy("key")))
    shared = F.sum(F.when(F.col("first") == 1, F.col("n"))).over(Window.partitionBy("query"))
    kept = one.withColumn("shared", shared).where(F.col("key").isNotNull() & (F.col("shares") | (F.col("shared") < FEW_NAMES) | (F.length("query") < SHORT_QUERY)))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "key", "score", "rank")


def title_queries(observations: DataFrame) -> DataFrame:
    """(obs_id, q_ord, query) of (obs_id, lines): the titles that the lines may show."""
    return observations.where(F.size("lines") > 0).select("obs_id", F.posexplode(split_title_queries(F.col("lines"))).alias("q_ord", "query"))


def match(observations: DataFrame, names: DataFrame, records: DataFrame, limit: int = 5) -> DataFrame:
    """(obs_id, rank, name, score, key, notes): candidates of every observation (obs_id, lines, layout_hint).

    ``names`` has key and form (normalized names and aliases), ``records`` one row a key with name
    and layout. Where observations have type_text and lower_text (what was read below the title) and
    records type_line and lower_texts, their agreement counts as well. Of an observation's queries the best counts: an exact one, then the higher score, the
    better title, the earlier. Observations without any match get the joined title alone, with the
    score 0.2.
    """
    # Cut where a result is read more than once: the plans, of which the driver holds a text for every change, stay small.
    asked = cut(title_queries(observations))
    exact = cut(asked.join(names.select(F.col("form").alias("query"), "key").distinct(), "query").select("obs_id", "q_ord", "query", "key", F.lit(1.0).alias("score"), F.lit("exact").alias("kind")))
    open_ = asked.join(exact.select("obs_id").distinct(), "obs_id", "left_anti")
    fuzzy = open_.join(fuzzy_names(open_, names, limit * 3), "query").select("obs_id", "q_ord", "query", "key", "score", F.lit("fuzzy").alias("kind"))
    per_obs = Window.partitionBy("obs_id")
    tops = exact.unionByName(fuzzy).repartition("obs_id").withColumn("top", F.max("score").over(Window.partitionBy("obs_id", "q_ord"))).withColumn("most", F.max("score").over(per_obs)).where("top = most")
    best = tops.withColumn("first", F.min(F.struct((-title_quality(F.col("query"))).alias("quality"), "q_ord")).over(per_obs)).where("q_ord = first.q_ord")
    hits = cut(best.select("obs_id", "query", "key", "score", "kind"))
    chosen = hits.join(records, "key").join(observations.drop("lines"), "obs_id")
    hint, layout = F.lower("layout_hint"), F.lower("layout")
    known = (F.coalesce(F.col("layout_hint"), F.lit("")) != "") & (F.coalesce(F.col("layout"), F.lit("")) != "")
    same = (hint == layout) | (hint.isin("transform", "modal_dfc") & layout.isin("transform", "modal_dfc"))
    seen = {"type_text", "lower_text"} <= set(observations.columns) and {"type_line", "lower_texts"} <= set(records.columns)
    if seen:
        chosen = chosen.withColumn("type_score", text_agreement("type_text", F.array("type_line"))).withColumn("lower_score", text_agreement("lower_text", "lower_texts"))
    score, notes = candidate_score(F.col("score"), F.col("kind"), F.when(known, same), contains_noise(F.col("query")), *((F.col("type_score"), F.col("lower_score")) if seen else ()))
    scored = chosen.select("obs_id", "name", "key", score.alias("score"), notes.alias("notes"))
    rank = F.row_number().over(Window.partitionBy("obs_id").orderBy(F.desc("score"), "name", "key"))
    ranked = scored.withColumn("rank", rank).where((F.col("rank") <= limit) | F.array_contains("notes", "exact"))
    none = asked.join(hits.select("obs_id").distinct(), "obs_id", "left_anti").groupBy("obs_id").agg(F.max_by("query", "q_ord").alias("name"))
    alone = none.select("obs_id", "name", F.lit(None).cast("string").alias("key"), F.lit(TITLE_ONLY).alias("score"), F.array(F.lit("catalog_unavailable"), F.lit("title_only")).alias("notes"), F.lit(1).alias("rank"))
    return ranked.unionByName(alone)


def _agreement(read: pd.Series, given: pd.Series) -> pd.Series:
    out, seen = [], {}
    for q, texts in zip(read, given):
        q = _norm(q)
        best = None
        for t in () if texts is None or not q else texts:
            t = _norm(t)
            if t and (q, t) not in seen:
                words = set(q.split())
                seen[q, t] = 0.65 * difflib.SequenceMatcher(None, q, t).ratio() + 0.35 * len(words & set(t.split())) / len(words)
            if t:
                best = max(best or 0.0, seen[q, t])
        out.append(best)
    return pd.Series(out, dtype="float64")


def _norm(text: str | None) -> str:
    return re.sub("[^0-9a-z]+", " ", (text or "").casefold().translate(dict.fromkeys(map(ord, APOSTROPHES)))).strip()


#: Best agreement of a text with any of an array of texts; null where either side has none.
text_agreement = F.pandas_udf(_agreement, DoubleType())


def candidate_score(title: Column, kind: Column, layouts: Column, noisy: Column, type_score: Column | None = None, lower_score: Column | None = None) -> tuple[Column, Column]:
    """Score and notes of a candidate from its similarities.

    ``layouts`` says whether the layouts agree, ``type_score`` and ``lower_score`` how far type line and
    lower text do; null where either side has none, which then counts for nothing.
    """
    value, notes = title * TITLE_WEIGHT, [kind]
    if type_score is not None:
        value = value + F.coalesce(type_score * TYPE_WEIGHT - F.when(type_score <= 0.2, TYPE_MISMATCH).otherwise(0.0), F.lit(0.0))
        notes.append(F.when(type_score >= 0.65, "type_line_match").when(type_score <= 0.2, "type_line_mismatch"))
    if lower_score is not None:
        value = value + F.coalesce(lower_score * LOWER_WEIGHT - F.when(lower_score <= 0.12, LOWER_MISMATCH).otherwise(0.0), F.lit(0.0))
        notes.append(F.when(lower_score >= 0.55, "lower_text_match").when(lower_score <= 0.12, "lower_text_mismatch"))
    value = value + F.when(layouts, LAYOUT_MATCH).when(~layouts, -LAYOUT_MISMATCH).otherwise(0.0) - F.when(noisy, NOISY_TITLE).otherwise(0.0)
    notes += [F.when(layouts, "layout_match").when(~layouts, "layout_mismatch"), F.when(noisy, "noisy_title_ocr")]
    return clamp(value), F.array_compact(F.array(*notes))


def normalized_forms(identities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, form) from (key, name) and (key, alias)."""
    a = identities.select("key", normalize_text(F.col("name")).alias("form"))
    return a.unionByName(aliases.select("key", normalize_text(F.col("alias")).alias("form"))).where("form <> ''").distinct()


def expand_printings(matches: DataFrame, variants: DataFrame, least: float = 0.84) -> DataFrame:
    """Matches (obs_id, key, score, rank) whose best is at least ``least`` replaced by the printings of its key.

    ``variants`` has key and its printing's columns. Each printing gets the match's score; other
    observations keep their matches, with null printings. The best key's printings may be many: callers
    that only need one take :func:`weftline.operators.catalog.newest_per_key` first.
    """
    best = matches.where((F.col("rank") == 1) & (F.col("score") >= least))
    grown = best.join(variants, "key").withColumn("expanded", F.lit(True))
    rest = matches.join(grown.select("obs_id").distinct(), "obs_id", "left_anti").withColumn("expanded", F.lit(False))
    return grown.unionByName(rest, allowMissingColumns=True)


def lower_texts(oracle_text, flavor_text):
    """Texts that a card's lower part may show: rules, flavour, both; blank ones left out."""
    o, f = F.nullif(F.trim(oracle_text), F.lit("")), F.nullif(F.trim(flavor_text), F.lit(""))
    both = F.when(o.isNotNull() & f.isNotNull(), F.concat(o, F.lit(" "), f))
    return F.array_compact(F.array(o, f, both))


def reconcile(candidates: DataFrame, sources: list[tuple[DataFrame, list[str]]], columns: list[str]) -> DataFrame:
    """Candidates (cand_id, ...) with the columns of the first source that has a row of equal keys.

    Each source is (rows, keys) and has ``ord``; of its equal rows the one of least ``ord`` is taken.
    Candidates that no source has keep nulls and priority null.
    """
    found = None
    for k, (rows, keys) in enumerate(sources):
        first = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), "ord").alias("r"))
        hit = candidates.join(first, keys).select("cand_id", F.lit(k).alias("priority"), "r")
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy("cand_id").agg(F.min("priority").alias("priority"), F.min_by("r", "priority").alias("r"))
    return candidates.join(best, "cand_id", "left").select(*candidates.columns, "priority", *(F.col(f"r.{c}").alias(f"found_{c}") for c in columns))


# Regions that show a title, in the order in which they are asked, and those of two faces.
TITLE_REGIONS = ("planar_title", "standard", "split_full", "split_left", "split_right", "adventure", "transform_back")
FACE_REGIONS = ("planar_title", "split_full", "split_left", "split_right")


def ordered_title_queries(readings: DataFrame) -> DataFrame:
    """(obs_id, q_ord, query) of readings (obs_id, region, lines, layout_hint): title regions in their order.

    Regions of two faces of a split layout give all their split queries, others their cleaned title; of equal
    queries the first counts. An observation whose title regions give none gets the cleaned title of any of
    its readings, that of the least region.
    """
    order = F.array_position(F.array(*map(F.lit, TITLE_REGIONS)), F.col("region"))
    r = readings.where(F.size("lines") > 0).withColumn("at", order)
    single = F.array(normalize_text(clean_title_query(F.col("lines"))))
    faces = (F.lower("layout_hint") == "split") & F.col("region").isin(*FACE_REGIONS)
    queries = F.when(F.coalesce(faces, F.lit(False)), split_title_queries(F.col("lines"))).otherwise(single)
    title = r.where("at > 0").select("obs_id", "at", F.posexplode(queries).alias("pos", "query")).where("query <> ''")
    first = title.groupBy("obs_id", "query").agg(F.min(F.struct("at", "pos")).alias("p"))
    ranked = first.select("obs_id", (F.row_number().over(Window.partitionBy("obs_id").orderBy("p.at", "p.pos")) - 1).alias("q_ord"), "query")
    rest = r.select("obs_id", "region", single[0].alias("query")).where("query <> ''").join(title.select("obs_id").distinct(), "obs_id", "left_anti")
    fallback = rest.groupBy("obs_id").agg(F.min_by("query", F.struct(F.coalesce("region", F.lit("")), F.col("query"))).alias("query")).select("obs_id", F.lit(0).alias("q_ord"), "query")
    return ranked.unionByName(fallback)
