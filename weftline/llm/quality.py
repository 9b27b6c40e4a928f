"""Per-document text statistics and the form that most of a text's words stand in.

Every statistic is a sum over words, lines or blocks (lines between blank lines), so a text is cut
into chunks and each chunk gives a partial result that can be merged: :class:`Partial` keeps, beside
the counts of what is complete within the chunk, the state at its two boundaries, that is the open
line and the open block on either side. Merging joins the open parts and counts what they complete,
so the result doesn't depend on where the cuts are. Partials of huge texts are merged through a
tree; texts of one chunk are finished where they are, without any exchange.

The counts of a word are fields of one integer (see FIELDS) and are added up as such.
"""

from __future__ import annotations

import functools
import pickle
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("words", "common", "link", "lower", "upper", "title", "number", "odd", "damaged", "pipe", "dot", "chars", "symbols", "hard", "comma", "semicolon", "sum")
_BITS = 40
_SHIFT = {f: i * _BITS for i, f in enumerate(FIELDS)}
_MASK = (1 << _BITS) - 1

#: Rules of the forms; shares are of the words of a line or block.
RULES = {
    "prose_common": 0.08,  # common words that running text has at least, less
    "prose_slack": 0.5,  # so many words
    "bullet_common": 0.12,  # the same for an entry with a bullet that is a sentence
    "odd_share": 0.4,  # words that are no words, from which a line is junk
    "hard_share": 0.05,  # characters such as \ ~ ^ { that a line of words has at most
    "table_common": 0.15,  # common words that a row of a table has less than
    "entry_words": 12,  # an entry of a list without bullets has at most
    "table_lines": 0.6,  # lines with one separator that make a block a table
    "title_common": 0.15,  # common words that a long line of capitalised words has at least
    "menu_gaps": 8,  # wide gaps from which a capitalised line is a menu
    "loop_words": 24,  # a line of so many words is a loop if fewer than
    "loop_distinct": 0.45,  # this share differ within 32 words
}
# What UTF-8 read as a one-byte code looks like; marks that begin an entry.
_DAMAGE = re.compile("Ã|Â|â€|ï¿½|�")
_BULLET = re.compile(r"^(?:[-*•–—+▪◦‣·]|\(?\d{1,4}[.)x:]?|\d{1,3}x|\[.?\]?|[a-z][.)]|#\d+)$")
_HARD = re.compile(r"[\\~^{}<>=@$%|!]")
_END = (".", "!", "?", "…", "。", "！", "？", ":", ";")
# Common words that join the parts of names, so an entry of a list may have them.
_LINKS = frozenset(("of", "de", "von"))
_CLOSERS = "\"'”’»)]*_"
_WORD = re.compile(r"^[^\W\d_]+(?:['’ʼ-][^\W\d_]+)*$")
_NUMBER = re.compile(r"^[#(]?[+-]?\d[\d.,:%x/-]*\)?$")
_ROW = re.compile(r"^\|?(?::?-{2,}:?\|)+(?::?-{2,}:?)?$")
_STRIP = "\"'“”‘’«»()[]{}.,;:!?…*_¡¿<>"


def get(v: int, name: str) -> int:
    return v >> _SHIFT[name] & _MASK


class WordCounts(dict):
    """Counts of each word as one integer; at most ``most`` words are kept."""

    def __init__(self, common: frozenset[str], most: int = 200_000):
        super().__init__()
        self.common, self.most = common, most

    def __missing__(self, w: str) -> int:
        core = w.strip(_STRIP)
        low = core.lower()
        alnum = sum(map(str.isalnum, w))
        on = ["words"]
        if low in self.common:
            on.append("common")
            if low in _LINKS:
                on.append("link")
        if _DAMAGE.search(w):
            on.append("damaged")
        if w == "|" or _ROW.match(w):
            on.append("pipe")
        elif w in ("·", "»", "«", "›", "‹", "•"):
            on.append("dot")
        if len(core) <= 30 and _WORD.match(core):
            on.append("upper" if len(core) > 1 and core.isupper() else "lower" if core[0].islower() else "title")
        elif _NUMBER.match(w) or len(core) <= 12 and core.isalnum() and any(c.isdigit() for c in core):
            on.append("number")
        elif not (w in ("-", "–", "—", "//", "/", "&", "+") or "_" in core.strip("_") and core.replace("_", "").isalpha()):
            on.append("odd")
        v = sum(1 << _SHIFT[f] for f in on)
        v += len(w) << _SHIFT["chars"]
        v += (len(w) - alnum - sum(map(_is_mark, w))) << _SHIFT["symbols"]
        v += len(_HARD.findall(w)) << _SHIFT["hard"]
        v += (w.count(",") - w.endswith(",")) << _SHIFT["comma"]
        v += (w.count(";") - w.endswith(";")) << _SHIFT["semicolon"]
        v += sum(w.encode("utf-8", "replace")) << _SHIFT["sum"]
        if len(self) >= self.most:
            self.clear()
        if len(w) <= 64:
            self[w] = v
        return v


#: Words that a word is compared with to tell whether it repeats one shortly before it.
NEAR = 14


def _fresh(words: list[str]) -> int:
    """Words that none of the NEAR words before them equals."""
    if len(words) <= NEAR + 1:
        return len(set(words))
    at: dict[str, int] = {}
    n = 0
    for i, w in enumerate(words):
        if at.get(w, -NEAR - 1) < i - NEAR:
            n += 1
        at[w] = i
    return n


def _is_mark(c: str) -> bool:
    return not c.isascii() and unicodedata.category(c)[0] == "M"


@dataclass
class Line:
    """Counts of a line or a part of it: its words, tabs, gaps, first word, last word's end.

    ``distinct`` are the words that don't repeat one of those shortly before; of a part that may be
    continued, ``first`` and ``last`` are its first and last NEAR words, so that this can be carried on.
    """

    v: int = 0
    tabs: int = 0
    gaps: int = 0
    bullet: bool = False
    punct: bool = False
    distinct: int = 0
    first: tuple = ()
    last: tuple = ()

    def __add__(self, o: Line) -> Line:
        mine, its = get(self.v, "words"), get(o.v, "words")
        again = sum(w not in o.first[:j] and w in self.last[len(self.last) - NEAR + j if len(self.last) > NEAR - j else 0 :] for j, w in enumerate(o.first)) if self.last else 0
        first = self.first if len(self.first) >= NEAR else (self.first + o.first)[:NEAR]
        last = o.last if len(o.last) >= NEAR else (self.last + o.last)[-NEAR:]
        return Line(self.v + o.v, self.tabs + o.tabs, self.gaps + o.gaps, self.bullet if mine else o.bullet, o.punct if its else self.punct, self.distinct + o.distinct - again, first, last)


#: Words of a block by kind of line; ``texty`` with its common words, lines of one separator.
@dataclass
class Block:
    texty: int = 0
    common: int = 0
    entries: int = 0
    plain: int = 0
    rows: int = 0
    single: int = 0
    junk: int = 0
    prose: int = 0
    lines: int = 0
    row_lines: int = 0
    last: tuple = ()
    first: tuple = ()
    repeats: int = 0

    def __add__(self, o: Block) -> Block:
        out = Block(*(getattr(self, f) + getattr(o, f) for f in _ADDED))
        out.first, out.last = self.first or o.first, o.last or self.last
        out.repeats = self.repeats + o.repeats
        if self.last and o.first and self.last == o.first:
            out.repeats += o.first[0]
        return out


_ADDED = ("texty", "common", "entries", "plain", "rows", "single", "junk", "prose", "lines", "row_lines")


def of_line(x: Line) -> Block:
    """A line's words by their kind."""
    v = x.v
    n, common, lower, upper, title = (get(v, f) for f in ("words", "common", "lower", "upper", "title"))
    seps = max(get(v, "comma"), get(v, "semicolon"), x.tabs)
    b = Block(lines=1, first=(n, get(v, "sum")), last=(n, get(v, "sum")))
    plain_words = lower + upper + title
    strong = common - get(v, "link")
    running = n >= 4 and strong >= 1 and strong >= RULES["bullet_common"] * n  # nouns may be capitalised
    texty = running or lower >= 0.5 * n or upper >= 0.6 * n
    named = n <= 5 and title >= 2 and not running  # "Ember of Kro, worn"
    pipes = get(v, "pipe")
    hard = get(v, "hard") - pipes
    if pipes and (pipes >= 2 or n == pipes) and hard <= RULES["hard_share"] * get(v, "chars") + 1 and not get(v, "dot"):
        b.rows, b.row_lines = n, 1
    elif get(v, "damaged") > RULES["odd_share"] * n or hard > RULES["hard_share"] * get(v, "chars") + 4 and plain_words < 0.7 * n:
        b.junk = n
    elif n >= RULES["loop_words"] and x.distinct < RULES["loop_distinct"] * n or x.gaps >= RULES["menu_gaps"] and title > lower:
        b.junk = n
    elif hard > RULES["hard_share"] * get(v, "chars") + 1 and get(v, "odd") > 0.25 * n:
        b.junk = n
    elif seps >= 2 and (common < RULES["table_common"] * n or n <= 3 * (seps + 1)):
        b.rows, b.row_lines = n, 1
    elif x.gaps >= 1 and common < RULES["table_common"] * n and not get(v, "dot") and not (texty and n > 8 and x.gaps < n / 4) and n <= 6 * (x.gaps + 1) and n < 40:
        b.single, b.row_lines = n, 1
    elif seps == 1 and common < RULES["table_common"] * n and n <= 8 and not x.bullet:
        b.single, b.row_lines = n, 1
    elif get(v, "odd") + get(v, "dot") > RULES["odd_share"] * n and not (x.bullet and plain_words):
        b.junk = n
    elif x.bullet and not (running and n >= 5):
        if n > 2 * RULES["entry_words"] and common < RULES["prose_common"] * n:
            b.junk = n
        else:
            b.entries = n
    elif texty and not named and (n > 3 or lower == n or common):
        b.texty, b.common = n, common
    elif named or n <= RULES["entry_words"] and title:
        b.plain = n
    elif common < RULES["title_common"] * n and n > RULES["entry_words"]:
        b.junk = n
    else:
        b.texty, b.common = n, common
    return b


def forms(b: Block) -> tuple[int, int, int, int]:
    """Words of a block in sentences, lists, tables and junk."""
    prose, entries, rows, junk = b.prose, b.entries, b.rows, b.junk
    if b.common >= RULES["prose_common"] * b.texty - RULES["prose_slack"]:
        prose += b.texty
    else:
        junk += b.texty
    if b.row_lines >= RULES["table_lines"] * b.lines and b.row_lines:
        rows += b.single
    elif prose > b.single:
        prose += b.single
    else:
        entries += b.single
    repeated = b.repeats > 0.5 * (entries + b.plain + prose)
    if prose > b.plain:
        prose += b.plain
    else:
        entries += b.plain
    if repeated:
        return 0, 0, rows, prose + entries + junk
    return prose, entries, rows, junk


@dataclass
class Partial:
    """A chunk's counts and the state at its boundaries."""

    single: bool = True
    head: Line = field(default_factory=Line)
    head_block: Block = field(default_factory=Block)
    closed: bool = False
    done: tuple = (0, 0, 0, 0)
    tail_block: Block = field(default_factory=Block)
    tail: Line = field(default_factory=Line)
    total: int = 0
    lines: int = 0
    punct: int = 0

    def push(self, x: Line) -> None:
        """Count a complete line after what is there."""
        if not get(x.v, "words"):
            if self.closed:
                self.done = _plus(self.done, forms(self.tail_block))
                self.tail_block = Block()
            self.closed = True
            return
        self.lines += 1
        self.punct += x.punct
        if self.closed:
            self.tail_block += of_line(x)
        else:
            self.head_block += of_line(x)

    def merge(self, o: Partial) -> Partial:
        """This chunk followed by ``o``."""
        total = self.total + o.total
        joined = (self.head if self.single else self.tail) + o.head
        if self.single:
            out = pickle.loads(pickle.dumps(o))
            out.head, out.total = joined, total
            return out
        out = pickle.loads(pickle.dumps(self))
        out.total = total
        if o.single:
            out.tail = joined
            return out
        out.push(joined)
        out.lines += o.lines
        out.punct += o.punct
        if out.closed:
            out.tail_block += o.head_block
            if o.closed:
                out.done = _plus(out.done, forms(out.tail_block), o.done)
                out.tail_block = o.tail_block
        else:
            out.head_block += o.head_block
            if o.closed:
                out.closed, out.done, out.tail_block = True, _plus(out.done, o.done), o.tail_block
        out.tail = o.tail
        return out

    def result(self) -> tuple[int, tuple, int, int]:
        """(all counts, words by form, lines, lines that end in punctuation) of the whole text."""
        first = Partial(single=False)
        first.push(self.head)
        if self.single:
            out = first
        else:
            rest = pickle.loads(pickle.dumps(self))
            rest.head = Line()
            rest.total = 0
            # The first line belongs to the block that follows it.
            if get(self.head.v, "words"):
                rest.head_block = first.head_block + rest.head_block
                rest.lines, rest.punct = rest.lines + first.lines, rest.punct + first.punct
            rest.push(self.tail)
            out = rest
        return self.total, _plus(out.done, forms(out.head_block), forms(out.tail_block)), out.lines, out.punct


def _plus(*xs: tuple) -> tuple:
    return tuple(map(sum, zip(*xs)))


def part_of(text: str, counts: WordCounts, glued: bool = False, whole: bool = False) -> Partial:
    """Partial of a chunk; ``glued``: its first word is the end of one that began before it.

    ``whole``: it is the whole text, so that no state is kept for what may follow.
    """
    p = Partial()
    rows = text.split("\n")
    p.single = len(rows) == 1
    at = counts.__getitem__
    total = 0
    last = len(rows) - 1
    for k, row in enumerate(rows):
        words = row.split()
        rest = 0
        if glued and k == 0 and words and not row[0].isspace():
            rest = at(words[0]) >> _SHIFT["chars"] << _SHIFT["chars"]  # its characters count, the word doesn't
            words = words[1:]
            total += rest
        if not words:
            x = Line(rest)
        else:
            v = sum(map(at, words))
            total += v
            end = words[-1]
            x = Line(v + rest, row.count("\t") if "\t" in row else 0, len(re.findall(r"\S {2,}(?=\S)", row)) if "  " in row else 0, bool(_BULLET.match(words[0])), end.rstrip(_CLOSERS).endswith(_END), _fresh(words))
            if not whole and k in (0, last):
                x.first, x.last = tuple(words[:NEAR]), tuple(words[-NEAR:])
        if k == 0:
            p.head = x
        elif k == last:
            p.tail = x
        else:
            p.push(x)
    p.total = total
    return p


def chunks(text: str, size: int) -> Iterator[tuple[str, bool]]:
    """(chunk, glued): cut at white space where a chunk has any, else within the word."""
    at, glued = 0, False
    while len(text) - at > size:
        cut = at + size
        space = next((i for i in range(cut, at + size // 2, -1) if text[i].isspace() and (i == 0 or text[i - 1] not in " \t")), None)
        yield text[at : space or cut], glued
        at, glued = space or cut, space is None and not text[cut].isspace() and not text[cut - 1].isspace()
    yield text[at:], glued


_SCHEMA = "n_words bigint, n_word_chars bigint, n_symbols bigint, n_lines bigint, n_punct_lines bigint, n_common bigint, w_prose bigint, w_list bigint, w_table bigint, w_junk bigint"


def _row(p: Partial) -> tuple:
    total, form, lines, punct = p.result()
    return (*(get(total, f) for f in ("words", "chars", "symbols")), lines, punct, get(total, "common"), *form)


_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def _tree(parts: list[Partial], fan: int = 16) -> Partial:
    """Successive partials as one, merged ``fan`` at a time until one is left."""
    while len(parts) > 1:
        parts = [functools.reduce(Partial.merge, parts[a : a + fan]) for a in range(0, len(parts), fan)]
    return parts[0] if parts else Partial()


#: Characters of a chunk, and of a text whose chunks are counted in different tasks.
CHUNK, SPREAD = 8_192, 32_768
_LONGEST = 1 << 31  # no string has more bytes


def text_counts(df: DataFrame, key: str, text: str, common: list[str], chunk: int = CHUNK, fan: int = 64, spread: int = SPREAD) -> DataFrame:
    """(key, counts) of every row: words, characters, symbols, lines, common words, words by form.

    A null or empty text has counts 0. Texts longer than ``chunk`` characters are cut into chunks,
    whose partial counts are merged through a tree; the chunks of texts longer than ``spread`` are
    counted in different tasks and merged ``fan`` at a time, level by level, until one is left. The
    outcome doesn't depend on either.
    """
    kind = df.schema[key].dataType.simpleString()
    known = df.sparkSession.sparkContext.broadcast(frozenset(w.lower() for w in common if w))
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    spread = max(spread, chunk)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = WordCounts(known.value)
        for b in batches:
            parts = (part_of(t, counts, whole=True) if len(t) <= chunk else _tree([part_of(c, counts, g) for c, g in chunks(t, chunk)]) for t in b["t"])
            out = pd.DataFrame(map(_row, parts), columns=_COLUMNS)
            out.insert(0, "k", b["k"].to_numpy())
            yield out

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, u, t in zip(b["k"], b["u"], b["t"]):
                for i, (c, g) in enumerate(chunks(t, chunk)):
                    yield pd.DataFrame({"k": [k], "u": [u], "i": [i], "g": [g], "c": [c]})

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = WordCounts(known.value)
        for b in batches:
            b["p"] = [pickle.dumps(part_of(c, counts, bool(g))) for c, g in zip(b["c"], b["g"])]
            yield b[["k", "u", "i", "p"]]

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        p = _tree([pickle.loads(x) for x in part["p"]])
        return pd.DataFrame({"k": part["k"].iloc[:1], "u": part["u"].iloc[:1], "i": [int(part["i"].iloc[0]) // fan], "p": [pickle.dumps(p)]})

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([_row(pickle.loads(x)) for x in b["p"]], columns=_COLUMNS)
            out.insert(0, "k", b["k"].to_numpy())
            yield out

    short = rows.where(F.length("t") <= spread).mapInPandas(whole, f"k {kind}, {_SCHEMA}")
    long = rows.where(F.length("t") > spread).withColumn("u", F.monotonically_increasing_id())
    mid = f"k {kind}, u bigint, i int, p binary"
    parts = long.mapInPandas(cut_up, f"k {kind}, u bigint, i int, g boolean, c string").repartition("u", "i").mapInPandas(partial, mid)
    left = -(-_LONGEST // (chunk // 2))  # no text has more chunks
    while left > 1:
        parts = parts.groupBy("k", "u", F.floor(F.col("i") / fan)).applyInPandas(merge, mid)
        left = -(-left // fan)
    return short.unionByName(parts.mapInPandas(finish, f"k {kind}, {_SCHEMA}")).withColumnRenamed("k", key)


def text_quality(df: DataFrame, key: str, text: str, common: list[str], chunk: int = CHUNK) -> DataFrame:
    """Ratios and the form of every text: prose, list, table, junk, or null without words.

    Ratios of a text without words, lines or characters are null.
    """
    c = text_counts(df, key, text, common, chunk)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    other = F.col("w_list") + F.col("w_table") + F.col("w_junk")
    best = F.greatest("w_list", "w_table", "w_junk")
    form = F.when(F.col("n_words") == 0, None).when(2 * other <= F.col("n_words"), "prose").when(F.col("w_list") == best, "list").when(F.col("w_table") == best, "table").otherwise("junk")
    return c.select(
        key, "n_words", "n_lines", F.round(share("n_word_chars", "n_words"), 4).alias("mean_word_length"), F.round(share("n_symbols", "n_word_chars"), 4).alias("symbol_ratio"),
        F.round(share("n_punct_lines", "n_lines"), 4).alias("punct_line_share"), F.round(share("n_common", "n_words"), 4).alias("common_share"),
        "w_prose", "w_list", "w_table", "w_junk", form.alias("form"),
    )
