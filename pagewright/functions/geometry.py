"""Geometry of half-open boxes (x1, y1, x2, y2) as Column expressions."""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = namedtuple("Box", "x1 y1 x2 y2")


def box(alias: str = "") -> Box:
    """The columns x1, y1, x2, y2 of a relation."""
    return Box(*(F.col(f"{alias}.{c}" if alias else c) for c in Box._fields))


def width(a: Box) -> Column:
    return a.x2 - a.x1


def height(a: Box) -> Column:
    return a.y2 - a.y1


def area(a: Box) -> Column:
    return width(a) * height(a)


def centre(a: Box) -> tuple[Column, Column]:
    """Whole centre; the half size is floored."""
    return a.x1 + F.floor(width(a) / 2), a.y1 + F.floor(height(a) / 2)


def gap(a: Box, b: Box) -> tuple[Column, Column]:
    """Free space between two boxes along each axis; 0 where they touch or overlap."""
    return F.greatest(F.lit(0), F.greatest(a.x1, b.x1) - F.least(a.x2, b.x2)), F.greatest(F.lit(0), F.greatest(a.y1, b.y1) - F.least(a.y2, b.y2))


def near(a: Box, b: Box, most: int) -> Column:
    x, y = gap(a, b)
    return (x <= most) & (y <= most)


def apart(a: tuple, b: tuple) -> int:
    """The larger free space, along either axis, between two boxes of numbers; below 0 where they overlap."""
    return max(max(a[0], b[0]) - min(a[2], b[2]), max(a[1], b[1]) - min(a[3], b[3]))


def intersection(a: Box, b: Box) -> Column:
    w = F.greatest(F.lit(0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
    h = F.greatest(F.lit(0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    return w * h


def hull_area(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(1), (F.greatest(a.x2, b.x2) - F.least(a.x1, b.x1)) * (F.greatest(a.y2, b.y2) - F.least(a.y1, b.y1)))


def iou(a: Box, b: Box) -> Column:
    both = intersection(a, b)
    return both / F.greatest(F.lit(1), area(a) + area(b) - both)


def over_smaller(a: Box, b: Box) -> Column:
    return intersection(a, b) / F.greatest(F.lit(1), F.least(area(a), area(b)))


def holds_centre(a: Box, b: Box) -> Column:
    """Whether the centre of b lies in a."""
    x, y = centre(b)
    return (a.x1 <= x) & (x < a.x2) & (a.y1 <= y) & (y < a.y2)


def vertical(a: Box) -> Column:
    """Whether a box is a column of text."""
    w, h = width(a), height(a)
    return (h > w * 2) | (h > w * 1.5) & (w < 200)


def oversized(a: Box, b: Box, page_area: int) -> Column:
    """Whether a merge would cover too much of the page for the boxes' overlap."""
    strong = (iou(a, b) >= 0.35) | (over_smaller(a, b) >= 0.65)
    return hull_area(a, b) > F.when(strong, int(page_area * 0.72)).otherwise(int(page_area * 0.38))


def overlapping(a: Box, b: Box, page_area: int) -> Column:
    """Whether two regions overlap enough to be one balloon."""
    inside = (holds_centre(a, b) | holds_centre(b, a)) & ((iou(a, b) >= 0.12) | (over_smaller(a, b) >= 0.55))
    return ~oversized(a, b, page_area) & ((iou(a, b) > 0.2) | inside)


def clipped(a: Box, pad: int, page_w: int, page_h: int) -> Box:
    return Box(F.greatest(F.lit(0), a.x1 - pad), F.greatest(F.lit(0), a.y1 - pad), F.least(F.lit(page_w), a.x2 + pad), F.least(F.lit(page_h), a.y2 + pad))


def viable(a: Box, least: int = 8) -> Column:
    return (width(a) >= least) & (height(a) >= least)


def budget(style: Column, w: Column, h: Column) -> Column:
    """Struct of max_words and max_chars that fit a box."""
    size, tall = w * h, h / w
    sfx = F.least(F.lit(18), F.when(size < 12000, 12).otherwise(16) + F.when((w >= 160) | (h >= 220), 2).otherwise(0))
    # Thresholds in the order in which they are tested: condition, words, characters.
    table = [
        (w < 60, 5, 22), (w < 80, 7, 28), (w < 100, 8, 34), ((tall >= 1.75) & (w < 120), 8, 32), ((tall >= 1.75) & (size < 24000), 8, 44), (tall >= 1.75, 10, 44),
        ((tall >= 1.35) & (size < 26000), 9, 38), (tall >= 1.35, 12, 50), (size < 18000, 10, 44), (size < 32000, 12, 52),
    ]
    words, chars = F.when(style == "sfx", 3), F.when(style == "sfx", F.when((w >= 160) | (h >= 220), F.least(F.lit(18), sfx)).otherwise(sfx))
    for test, a, b in table:
        words, chars = words.when(test, a), chars.when(test, b)
    return F.struct(words.otherwise(14).cast("int").alias("max_words"), chars.otherwise(60).cast("int").alias("max_chars"))


def context(a: Box, page_w: int, page_h: int) -> Box:
    """A single dialogue's box with room around it for its balloon: more for narrow boxes, less for wide and for large ones."""
    w, h = width(a), height(a)
    share = lambda x, part: F.floor(x * part)
    x = F.least(F.lit(140), F.greatest(F.lit(28), share(w, 1.15), share(h, 0.32)))
    y = F.least(F.lit(110), F.greatest(F.lit(20), share(h, 0.34), share(w, 0.22)))
    large = w * h >= 70_000
    x = F.when(w >= 280, F.least(x, F.greatest(F.lit(24), share(w, 0.18)))).otherwise(x)
    x, y = F.when(large, F.least(x, F.lit(72))).otherwise(x), F.when(large, F.least(y, F.lit(64))).otherwise(y)
    return Box(F.greatest(F.lit(0), a.x1 - x), F.greatest(F.lit(0), a.y1 - y), F.least(F.lit(page_w), a.x2 + x), F.least(F.lit(page_h), a.y2 + y))
