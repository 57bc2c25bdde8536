"""Merges that depend on the order of a page's boxes, as kernels that see one page at a time.

The joins of `regions` find the same result in any order; these do not, so each page's boxes are read in
the order of `pos`. A page has few boxes; pages are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import median

from pyspark.sql import DataFrame

from pagewright.operators.pages import by_page

Corners = tuple[int, int, int, int]
CORNERS = ["x1", "y1", "x2", "y2"]
SCHEMA = "page long, pos long, x1 long, y1 long, x2 long, y2 long"


def hull(a: Corners, b: Corners) -> Corners:
    a1, a2, a3, a4 = a
    b1, b2, b3, b4 = b
    return a1 if a1 < b1 else b1, a2 if a2 < b2 else b2, a3 if a3 > b3 else b3, a4 if a4 > b4 else b4


def area(a: Corners) -> int:
    w, h = a[2] - a[0], a[3] - a[1]
    return w * h if w > 0 and h > 0 else 0


def shared(a: Corners, b: Corners) -> int:
    return area((max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])))


def gaps(a: Corners, b: Corners) -> Corners:
    """Free space and overlap along x, then along y."""
    a1, a2, a3, a4 = a
    b1, b2, b3, b4 = b
    x, y = (a3 if a3 < b3 else b3) - (a1 if a1 > b1 else b1), (a4 if a4 < b4 else b4) - (a2 if a2 > b2 else b2)
    return -x if x < 0 else 0, x if x > 0 else 0, -y if y < 0 else 0, y if y > 0 else 0


def settled(boxes: list[Corners], joins: Callable[[Corners, Corners], bool], grown: bool) -> list[Corners]:
    """Sweeps until nothing joins: each first box left takes all later ones that join it, as it was or as it has grown."""
    while True:
        left, out = boxes, []
        while left:
            seed, *rest = left
            box, left = seed, []
            for b in rest:
                if joins(box if grown else seed, b):
                    box = hull(box, b)
                else:
                    left.append(b)
            out.append(box)
        if len(out) == len(boxes):
            return out
        boxes = out


def same_balloon(page_w: int, page_h: int, also: Callable[[Corners, Corners], bool] | None = None) -> Callable[[Corners, Corners], bool]:
    """Whether two regions overlap enough to be one, or `also` says so, without covering too much of the page."""
    page = max(1, page_w * page_h)

    def holds(a: Corners, b: Corners) -> bool:
        x, y = b[0] + (b[2] - b[0]) // 2, b[1] + (b[3] - b[1]) // 2
        return a[0] <= x < a[2] and a[1] <= y < a[3]

    def joins(a: Corners, b: Corners) -> bool:
        both = shared(a, b)
        iou, part = both / max(1, area(a) + area(b) - both), both / max(1, min(area(a), area(b)))
        most = int(page * (0.72 if iou >= 0.35 or part >= 0.65 else 0.38))
        return area(hull(a, b)) <= most and (iou > 0.2 or (holds(a, b) or holds(b, a)) and (iou >= 0.12 or part >= 0.55) or also is not None and also(a, b))

    return joins


def same_phrase(region_w: int, region_h: int) -> Callable[[Corners, Corners], bool]:
    """Whether two boxes of a region are a phrase split over tight rows or columns."""
    most_x, most_y = max(12, int(region_w * 0.1)), max(10, int(region_h * 0.05))

    def joins(a: Corners, b: Corners) -> bool:
        gap_x, x, gap_y, y = gaps(a, b)
        w, h = [max(1, c[2] - c[0]) for c in (a, b)], [max(1, c[3] - c[1]) for c in (a, b)]
        below = x / min(w) >= 0.65 and gap_y <= most_y
        beside = y / min(h) >= 0.55 and gap_x <= min(most_x, int(max(w) * 0.3) + 6)
        return below or beside

    return joins


def rows_by_median(boxes: list[Corners], least: int = 50, most: int = 135, share: float = 0.75) -> list[int]:
    """The row of each box: downwards, a box joins the row if its centre is near the median of the row's centres."""
    out, row = [0] * len(boxes), -1
    centres: list[float] = []
    heights: list[int] = []
    for k in sorted(range(len(boxes)), key=lambda k: (boxes[k][1] + boxes[k][3]) / 2):
        y, h = (boxes[k][1] + boxes[k][3]) / 2, boxes[k][3] - boxes[k][1]
        if not centres or abs(y - median(centres)) > max(least, min(most, int(median([*heights, h]) * share))):
            row, centres, heights = row + 1, [], []
        centres.append(y)
        heights.append(h)
        out[k] = row
    return out


def merged_regions(boxes: DataFrame, page_w: int, page_h: int, also: Callable[[Corners, Corners], bool] | None = None) -> DataFrame:
    """Regions of each page, in order, after those that overlap enough, or of which `also` says so, are merged; a sweep tests seeds as they were."""
    return by_page(boxes, CORNERS, lambda b: settled(b, same_balloon(page_w, page_h, also), False), CORNERS)


def merged_phrases(boxes: DataFrame, region_w: int, region_h: int) -> DataFrame:
    """Boxes of each region, in order, after those of one phrase are merged; a sweep tests seeds as they have grown."""
    return by_page(boxes, CORNERS, lambda b: settled(b, same_phrase(region_w, region_h), True), CORNERS)


def median_rows(boxes: DataFrame) -> DataFrame:
    """(page, pos, row): rows of boxes, pos counted from 0 in input order."""
    return by_page(boxes, CORNERS, lambda b: [(r,) for r in rows_by_median(b)], ["row"])
