"""Boxes, quads and regions of interest as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: width over height of a card.
CARD_RATIO = 63 / 88


def box(left: Column, top: Column, width: Column, height: Column) -> Column:
    return F.struct(left.cast("int").alias("left"), top.cast("int").alias("top"), width.cast("int").alias("width"), height.cast("int").alias("height"))


def aspect_ratio(b: Column) -> Column:
    """Width over height; 0 where there is no height."""
    return F.when(b["height"] > 0, b["width"] / b["height"]).otherwise(0.0)


def clamp_box(b: Column, frame_width: Column, frame_height: Column) -> Column:
    """The part of the box within the frame; what lies outside has width or height 0."""
    left = F.greatest(F.lit(0), F.least(b["left"], frame_width))
    top = F.greatest(F.lit(0), F.least(b["top"], frame_height))
    return box(left, top, F.greatest(F.lit(0), F.least(b["width"], frame_width - left)), F.greatest(F.lit(0), F.least(b["height"], frame_height - top)))


def centred_box(frame_width: Column, frame_height: Column, ratio: float = CARD_RATIO, inset: float = 0.92) -> Column:
    """The largest box of a ratio within the inner ``inset`` of the frame, centred; at least a pixel each way."""
    across, down = (F.greatest(F.lit(1), F.floor(c * inset)) for c in (frame_width, frame_height))
    # The box is ratio * s by s, and s is the smaller of what either side of the frame allows.
    s = F.least(down.cast("double"), across / ratio)
    low = s < down
    w = F.when(low, across).otherwise(F.greatest(F.lit(1), F.bround(s * ratio, 0))).cast("int")
    h = F.when(low, F.greatest(F.lit(1), F.bround(s, 0))).otherwise(down).cast("int")
    middle = lambda whole, part: F.greatest(F.lit(0), F.floor((whole - part) / 2))
    return box(middle(frame_width, w), middle(frame_height, h), w, h)


def box_score(b: Column, frame_width: Column, frame_height: Column) -> Column:
    """How likely a box is a card: its ratio, its share of the frame, whether it is smaller than it."""
    error = F.abs(aspect_ratio(b) - CARD_RATIO) / CARD_RATIO
    cover = b["width"].cast("double") * b["height"] / F.greatest(F.lit(1), frame_width * frame_height)
    inner = F.when((b["width"] < frame_width) & (b["height"] < frame_height), 1.0).otherwise(0.85)
    whole = F.round(F.greatest(F.lit(0.0), 1 - error) * 0.55 + cover * 0.3 + inner * 0.15, 4)
    return F.when((b["width"] > 0) & (b["height"] > 0), whole).otherwise(0.0)


def quad_of(b: Column) -> Column:
    """Corners of a box, clockwise from the upper left."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    r, d = b["left"] + b["width"], b["top"] + b["height"]
    return F.array(point(b["left"], b["top"]), point(r, b["top"]), point(r, d), point(b["left"], d))


def box_of(quad: Column) -> Column:
    """The smallest box around a quad's corners."""
    xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    return box(x, y, F.array_max(xs) - x, F.array_max(ys) - y)


def unrotate(x: Column, y: Column, degrees: Column, width: Column, height: Column) -> Column:
    """A point of a picture turned by 90, 180 or 270 degrees, in the original; other turns change nothing."""
    p = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    mx, my = F.greatest(F.lit(0.0), width - 1 - F.when(degrees == 270, y).otherwise(x)), F.greatest(F.lit(0.0), height - 1 - F.when(degrees == 90, x).otherwise(y))
    return F.when(degrees == 90, p(y, my)).when(degrees == 270, p(mx, x)).when(degrees == 180, p(mx, my)).otherwise(p(x, y))


# Regions of a card by group, as left, top, width and height relative to it.
REGIONS = {
    "planar_title": ("plane_title", 0.03, 0.05, 0.12, 0.84),
    "split_full": ("full_card", 0.0, 0.0, 1.0, 1.0),
    "standard": ("title_band", 0.08, 0.05, 0.84, 0.12),
    "art_match": ("art_box", 0.08, 0.13, 0.84, 0.4),
    "type_line": ("type_line", 0.08, 0.19, 0.84, 0.08),
    "set_symbol": ("set_symbol", 0.81, 0.19, 0.1, 0.09),
    "lower_text": ("lower_text", 0.08, 0.75, 0.84, 0.18),
    "split_left": ("left_panel_title", 0.03, 0.59, 0.12, 0.4),
    "split_right": ("right_panel_title", 0.03, 0.10, 0.12, 0.4),
    "adventure": ("adventure_title", 0.53, 0.64, 0.37, 0.1),
    "transform_back": ("back_title", 0.08, 0.08, 0.84, 0.12),
}
# Regions that aren't read as text, and so aren't grown.
NOT_GROWN = ("art_match", "set_symbol")


def parse_factors(values: list[float]) -> tuple[float, float] | None:
    """Growth along the long and the short side from one or two positive numbers; nothing gives None."""
    if not values:
        return None
    if len(values) > 2 or any(v <= 0 for v in values):
        raise ValueError("one or two factors above zero are needed")
    return values[0], values[-1]


def merge_regions(preset, *overrides):
    """Regions (region, x, y, w, h) with those of each override in place of earlier ones, by name."""
    out = preset
    for o in overrides:
        new = o.select("region", *(F.col(c).alias(f"o_{c}") for c in "xywh"))
        out = out.join(new, "region", "full").select("region", *(F.coalesce(f"o_{c}", c).alias(c) for c in "xywh"))
    return out


def signature(regions):
    """One hash of all regions, whatever their order: a cache of another signature is stale."""
    rows = F.sort_array(F.collect_list(F.concat_ws("|", "region", *(F.format_string("%.4f", c) for c in "xywh"))))
    return regions.agg(F.sha2(F.array_join(rows, ";"), 256).alias("signature"))


def region_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, long_factor: Column, short_factor: Column) -> Column:
    """A relative region in pixels of a frame, grown from its centre along its long and short side.

    Rounds halves to even; the result lies within the frame and has at least one pixel each way.
    """
    r = lambda c: F.bround(c, 0).cast("int")
    left, top = F.greatest(F.lit(0), r(width * x)), F.greatest(F.lit(0), r(height * y))
    bw = F.greatest(F.lit(1), F.least(width, left + F.greatest(F.lit(1), r(width * w))) - left)
    bh = F.greatest(F.lit(1), F.least(height, top + F.greatest(F.lit(1), r(height * h))) - top)
    tw = bw * F.when(bw >= bh, long_factor).otherwise(short_factor)
    th = bh * F.when(bw >= bh, short_factor).otherwise(long_factor)
    cx, cy = left + bw / 2, top + bh / 2
    x0, y0 = F.greatest(F.lit(0), r(cx - tw / 2)), F.greatest(F.lit(0), r(cy - th / 2))
    x1, y1 = F.least(width, r(cx + tw / 2)), F.least(height, r(cy + th / 2))
    return box(x0, y0, F.greatest(F.lit(1), x1 - x0), F.greatest(F.lit(1), y1 - y0))


# Order in which regions are taken, and the regions of each layout.
REGION_ORDER = ("planar_title", "split_full", "standard", "art_match", "type_line", "set_symbol", "lower_text", "adventure", "transform_back", "split_left", "split_right")
LAYOUT_REGIONS = {
    "normal": ("standard", "art_match", "type_line", "set_symbol", "lower_text"),
    "split": ("planar_title", "split_full", "art_match", "type_line", "set_symbol", "lower_text"),
    "adventure": ("standard", "art_match", "type_line", "set_symbol", "adventure", "lower_text"),
    "transform": ("standard", "art_match", "type_line", "set_symbol", "transform_back", "lower_text"),
    "modal_dfc": ("standard", "art_match", "type_line", "set_symbol", "transform_back", "lower_text"),
    "planar": ("planar_title", "art_match", "lower_text"),
}


def regions_of_layout(layout: Column, enabled: Column | None = None) -> Column:
    """Regions to read of a layout beside the enabled ones: by the fixed order, unknown names left out.

    A missing layout counts as normal, one that isn't known adds nothing.
    """
    words = lambda xs: F.array(*map(F.lit, xs))
    none = F.array().cast("array<string>")
    table = F.create_map(*(x for k, v in LAYOUT_REGIONS.items() for x in (F.lit(k), words(v))))
    mine = F.coalesce(F.try_element_at(table, F.lower(F.coalesce(layout, F.lit("normal")))), none)
    every = F.array_union(mine, F.coalesce(enabled, none) if enabled is not None else none)
    return F.filter(words(REGION_ORDER), lambda r: F.array_contains(every, r))


def coerce_ints(value: Column, size: int) -> Column:
    """An array of texts as whole numbers; null unless there are ``size`` and all are numbers."""
    numbers = F.transform(value, lambda x: F.floor(x.try_cast("double")).cast("int"))
    return F.when((F.size(value) == size) & ~F.exists(numbers, lambda x: x.isNull()), numbers)


def pick_box(quad: Column, given: Column, candidates: Column, frame_width: Column, frame_height: Column, most_off: float = 0.12) -> Column:
    """(source, box) of where a card is: a quad, a box, the best candidate box, the frame, its middle.

    ``candidates`` are boxes; the best by score counts, the first of equals, if its score is above 0. The
    whole frame counts if its ratio is at most ``most_off`` from a card's.
    """
    frame = box(F.lit(0), F.lit(0), frame_width, frame_height)
    scored = F.transform(candidates, lambda b, i: F.struct(box_score(b, frame_width, frame_height).alias("score"), (-i).alias("order"), b.alias("b")))
    best = F.array_max(scored)
    out = lambda source, b: F.struct(F.lit(source).alias("source"), b.alias("box"))
    return (
        F.when(quad.isNotNull(), out("quad", box_of(quad)))
        .when(given.isNotNull(), out("box", given))
        .when(best["score"] > 0, out("candidate", best["b"]))
        .when(F.abs(frame_width / frame_height - CARD_RATIO) <= most_off, out("frame", frame))
        .otherwise(out("centre", centred_box(frame_width, frame_height)))
    )
