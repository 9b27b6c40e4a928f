"""Similarity of hashes, histograms and colours as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming_hex(a: Column, b: Column, digits: int) -> Column:
    """Different bits of two hexadecimal strings of ``digits`` digits, 8 digits at a time."""
    part = lambda c, i: F.conv(F.substring(c, i, 8), 16, 10).cast("bigint")
    out = F.lit(0)
    for i in range(1, digits + 1, 8):
        out = out + F.bit_count(part(a, i).bitwiseXOR(part(b, i)))
    return out


def hash_similarity(a: Column, b: Column, digits: int) -> Column:
    """1 minus the share of different bits, to 4 places; 0 where a hash has another length."""
    fits = (F.length(a) == digits) & (F.length(b) == digits)
    return F.when(fits, F.round(1 - hamming_hex(a, b, digits) / (4 * digits), 4)).otherwise(0.0)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def histogram_similarity(a: Column, b: Column) -> Column:
    """Cosine within 0 and 1, to 4 places; 0 where a norm is 0 or the lengths differ."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(a, b) / norm)), 4)).otherwise(0.0)


def mean_colour_similarity(a: Column, b: Column) -> Column:
    """1 minus the distance over 255, at least 0, to 4 places."""
    d = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    return F.when(d.isNotNull(), F.round(F.greatest(F.lit(0.0), 1 - d / 255), 4))


# Weights of the parts of a fingerprint's similarity.
SYMBOL_WEIGHTS = {"mask": 0.5, "gray": 0.2, "edge": 0.2, "foreground": 0.1}
ART_WEIGHTS = {"gray": 0.22, "edge": 0.18, "histogram": 0.45, "mean": 0.15}


def symbol_similarity(mask: Column, gray: Column, edge: Column, foreground_a: Column, foreground_b: Column) -> Column:
    w = SYMBOL_WEIGHTS
    return F.round(mask * w["mask"] + gray * w["gray"] + edge * w["edge"] + (1 - F.abs(foreground_a - foreground_b)) * w["foreground"], 4)


def art_similarity(gray: Column, edge: Column, histogram: Column, mean: Column) -> Column:
    w = ART_WEIGHTS
    return F.round(gray * w["gray"] + edge * w["edge"] + histogram * w["histogram"] + mean * w["mean"], 4)


def score_delta(score: Column, similarity: Column, factor: float) -> Column:
    """Score moved by the similarity's distance from one half, within 0 and 1; null if either is."""
    moved = score + (similarity - 0.5) * factor
    return F.when(moved.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)), 4))


def bits_hex(flags: Column, bits: int) -> Column:
    """Array of at most 64 booleans as hexadecimal digits, the first bit the highest."""
    number = F.aggregate(flags, F.lit(0).cast("bigint"), lambda acc, f: F.shiftleft(acc, 1).bitwiseOR(F.when(f, 1).otherwise(0).cast("bigint")))
    return F.lower(F.lpad(F.hex(number), -(-bits // 4), "0"))


def difference_hash(grid: Column, rows: int, columns: int) -> Column:
    """Bits of each row's neighbours: right at least left. ``grid`` is row by row."""
    # The grid is bound once and each bit is a plain comparison.
    flags = lambda g: F.array(*(F.get(g, F.lit(r * columns + c + 1)) >= F.get(g, F.lit(r * columns + c)) for r in range(rows) for c in range(columns - 1)))
    return bits_hex(F.get(F.transform(F.array(grid), flags), F.lit(0)), rows * (columns - 1))


def average_hash(grid: Column, size: int) -> Column:
    """Bits of the values that are at least the mean, which is taken once."""
    mean = F.aggregate(grid, F.lit(0.0), lambda s, x: s + x.cast("double")) / size
    return bits_hex(F.get(F.transform(F.array(mean), lambda m: F.transform(grid, lambda x: x.cast("double") >= m)), F.lit(0)), size)


def mask_quality(foreground: Column, box_share: Column, centre_distance: Column) -> Column:
    """How usable a symbol's mask is: share of foreground near .18, of its box near .35, centred.

    ``centre_distance`` is the distance of the box's centre from the mask's, over width plus height.
    """
    near = lambda c, at: 1 - F.least(F.abs(c - at) / at, F.lit(1.0))
    whole = near(foreground, 0.18) * 0.45 + near(box_share, 0.35) * 0.35 + (1 - F.least(centre_distance, F.lit(1.0))) * 0.20
    return F.when(whole.isNotNull(), F.round(whole, 6))
