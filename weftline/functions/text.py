"""Text functions of the resolver as Column expressions; only the gestalt ratio needs Python."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from weftline.functions.keys import clean_optional, squeeze

# Characters that stand for an apostrophe and are deleted.
APOSTROPHES = "'’`´"


def normalize_text(c: Column) -> Column:
    """Lower case, apostrophes deleted, each run of other signs one blank, trimmed."""
    lowered = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(F.translate(lowered, APOSTROPHES, ""), "[^0-9a-z]+", " "))


def trigrams(c: Column) -> Column:
    """Distinct slices of three characters of the value padded with two blanks before and one after."""
    p = F.concat(F.lit("  "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))


def tokens(c: Column) -> Column:
    """Distinct words between blanks; none of an empty value."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda t: t != ""))


def token_overlap(query: Column, other: Column) -> Column:
    """Share of the query's distinct words that the other value has; 0 without words."""
    q = tokens(query)
    n = F.size(q)
    return F.when(n > 0, F.size(F.array_intersect(q, tokens(other))) / n).otherwise(0.0)


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict = {}
    for p in zip(a, b):
        if p not in seen:
            seen[p] = difflib.SequenceMatcher(None, p[0] or "", p[1] or "").ratio()
    return pd.Series([seen[p] for p in zip(a, b)], dtype="float64")


#: Gestalt ratio of two values; the order of the arguments matters. Null counts as empty.
gestalt_ratio = F.pandas_udf(_ratio, DoubleType())


def fuzzy_score(ratio: Column, query: Column, candidate: Column) -> Column:
    """Similarity of a name to a query given their gestalt ratio, at most .99."""
    prefix = F.when(F.startswith(candidate, query) | F.startswith(query, candidate), 0.05).otherwise(0.0)
    value = ratio * 0.75 + token_overlap(query, candidate) * 0.25 + prefix
    return F.when(value.isNotNull(), F.least(F.lit(0.99), value))


def compatibility_score(ratio: Column, query: Column, candidate: Column) -> Column:
    """Agreement of longer texts given their ratio; 0 where either is blank."""
    blank = (F.coalesce(query, F.lit("")) == "") | (F.coalesce(candidate, F.lit("")) == "")
    return F.when(blank, 0.0).otherwise(ratio * 0.65 + token_overlap(query, candidate) * 0.35)


def contains_noise(norm: Column) -> Column:
    """Whether any word consists of digits only."""
    return F.exists(F.split(norm, " "), lambda t: t.rlike("^[0-9]+$"))


def title_quality(norm: Column) -> Column:
    """How much a normalized query looks like a title."""
    n = F.size(F.filter(F.split(norm, " "), lambda t: t != ""))
    value = F.least(F.length(norm) / 24.0, F.lit(1.0)) - F.greatest(n - 2, F.lit(0)) * 0.08 - F.when(contains_noise(norm), 0.18).otherwise(0.0)
    return F.when(norm == "", 0.0).when(norm.isNotNull(), F.greatest(F.lit(0.0), value))


def is_noise_token(t: Column) -> Column:
    """Nothing but brackets, or a number of at most two digits."""
    bare = F.regexp_replace(t, r"^[\[\](){}<>]+|[\[\](){}<>]+$", "")
    return (bare == "") | bare.rlike("^[0-9]{1,2}$")


def clean_line(line: Column) -> Column:
    """A line without its noise tokens."""
    return F.array_join(F.filter(F.split(squeeze(line), " "), lambda t: ~is_noise_token(t)), " ")


def clean_title_query(lines: Column) -> Column:
    """The first two lines that are left after dropping noise tokens, joined."""
    kept = F.filter(F.transform(lines, clean_line), lambda x: x != "")
    return F.array_join(F.slice(kept, 1, 2), " ")


def is_title_fragment(value: Column) -> Column:
    """One to three words without digits, 3 to 32 characters."""
    norm = normalize_text(value)
    n = F.size(F.filter(F.split(norm, " "), lambda t: t != ""))
    return n.between(1, 3) & ~norm.rlike("[0-9]") & F.length(norm).between(3, 32)


def split_title_queries(lines: Column) -> Column:
    """Each cleaned line, the first two fragments in both orders, and the joined title; no repeats."""
    kept = F.filter(F.transform(lines, clean_line), lambda x: x != "")
    return _once(kept, lambda k: _once(F.filter(k, is_title_fragment), lambda parts: _title_forms(k, parts)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _title_forms(kept: Column, parts: Column) -> Column:
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    both = F.when(F.size(parts) >= 2, F.array(F.concat(a, F.lit(" // "), b), F.concat(b, F.lit(" // "), a))).otherwise(F.array().cast("array<string>"))
    every = F.concat(kept, both, F.array(F.array_join(F.slice(kept, 1, 2), " ")))
    norm = F.transform(every, normalize_text)
    return F.array_distinct(F.filter(norm, lambda x: x != ""))


def title_tokens(lines: Column) -> Column:
    """Distinct runs of at least three letters, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.array_join(lines, " ")), F.lit("([a-z]{3,})"), F.lit(1)))


def face_names(name: Column) -> Column:
    """The two faces of a name around the first " // "; null unless both are there."""
    p = F.split(name, " // ", 2)
    a, b = clean_optional(F.get(p, F.lit(0))), clean_optional(F.get(p, F.lit(1)))
    return F.when(a.isNotNull() & b.isNotNull(), F.array(a, b))


def slugify(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def observed_card_id(name: Column, set_code: Column, number: Column, label: str) -> Column:
    """`printing:set:number`, else `name:<normalized>`, else the label."""
    part = lambda c: F.nullif(F.lower(squeeze(c)), F.lit(""))
    s, n, norm = part(set_code), part(number), F.nullif(normalize_text(name), F.lit(""))
    return F.when(s.isNotNull() & n.isNotNull(), F.concat(F.lit("printing:"), s, F.lit(":"), n)).when(norm.isNotNull(), F.concat(F.lit("name:"), norm)).otherwise(F.lit(label))


def name_from_path(path: Column) -> Column:
    """A name from a file's stem: hash suffix dropped, dashes as blanks, words capitalised."""
    stem = F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[^.]*$", "")
    return F.nullif(F.initcap(F.replace(F.regexp_replace(stem, "-[0-9a-f]{8}$", ""), F.lit("-"), F.lit(" "))), F.lit(""))


def distinct_lines(lines: Column) -> Column:
    """Lines with squeezed blanks, without blank ones and repeats of the same normalized text."""
    clean = F.filter(F.transform(lines, squeeze), lambda x: x != "")
    norms = F.transform(clean, normalize_text)
    return F.filter(clean, lambda x, i: F.array_position(norms, F.get(norms, i)) == i + 1)
