"""The box around a unit, among others of its parent, in which to look for its balloon."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.ordered import Corners
from pagewright.operators.pages import by_page
from pagewright.operators.splitting import CORNERS, everywhere, nowhere

#: Fixed values, by axis: growth in parts of the unit, that in a large parent and its least, the most there, and the least side.
GROWTH = ((0.85, 0.70, 56, 72, 28), (0.55, 0.45, 48, 64, 24))
LARGE = 250_000


def grown(unit: Corners, parent: Corners, axis: int) -> int:
    """How far a unit's box grows along an axis: more across a long unit, less in a large parent."""
    share, tight, least, most, _ = GROWTH[axis]
    size, other = unit[axis + 2] - unit[axis], unit[3 - axis] - unit[1 - axis]
    large = (parent[2] - parent[0]) * (parent[3] - parent[1]) >= LARGE
    out = max(14, int(size * share), int((parent[axis + 2] - parent[axis]) * 0.04))
    if large:
        out = min(out, max(18, int(size * tight), least))
    if other > size * (1.45, 1.8)[axis]:
        out = max(out, (min(90, int(other * 0.20)), min(70, int(other * 0.16)))[axis])
    return min(out, most) if large else out


def limits(unit: Corners, others: list[Corners], axis: int, low: int, high: int) -> tuple[int, int]:
    """Where the halves of others that stand beside a unit along an axis begin, with a little between."""
    cross = 1 - axis
    for b in others:
        common = min(unit[cross + 2], b[cross + 2]) - max(unit[cross], b[cross])
        if common < max(8, int(min(unit[cross + 2] - unit[cross], b[cross + 2] - b[cross]) * 0.18)):
            continue
        own, its = unit[axis] + unit[axis + 2], b[axis] + b[axis + 2]
        middle, between = round((own + its) / 4), max(4, int(min(unit[axis + 2] - unit[axis], b[axis + 2] - b[axis]) * 0.04))
        if its < own:
            low = max(low, middle + between)
        elif its > own:
            high = min(high, middle - between)
    return low, high


def centred(centre: float, size: int, low: int, high: int) -> tuple[int, int]:
    """A span of a size about a centre, moved into bounds."""
    a = max(low, round(centre) - size // 2)
    b = min(high, a + size)
    return max(low, b - size), b


def local_context(unit: Corners, parent: Corners, others: list[Corners], page_w: int, page_h: int, dialogue: bool, paper: Callable[[Corners], bool] = nowhere) -> Corners:
    """A unit's box grown within its parent, not beyond half way to the others, of some size; a column of dialogue gets more width where that is paper."""
    spans = []
    for axis, page in ((0, page_w), (1, page_h)):
        low, high, a, b = max(0, parent[axis]), min(page, parent[axis + 2]), unit[axis], unit[axis + 2]
        grow, (left, right) = grown(unit, parent, axis), limits(unit, others, axis, low, high)
        # What others leave never cuts off the unit's own marks.
        x, y = max(low, min(a, max(a - grow, left))), min(high, max(b, min(b + grow, right)))
        least = min(parent[axis + 2] - parent[axis], max(b - a + 8, GROWTH[axis][4]))
        spans.append(centred((a + b) / 2, least, low, high) if y - x < least else (x, y))
    (x1, x2), (y1, y2) = spans
    w, h = unit[2] - unit[0], unit[3] - unit[1]
    if dialogue and h > w * 1.35:
        wide = min(parent[2] - parent[0], max(x2 - x1, 96, w + min(140, int(h * 0.42))))
        a, b = centred((unit[0] + unit[2]) / 2, wide, max(0, parent[0]), min(page_w, parent[2]))
        if wide > x2 - x1 and paper((a, y1, b, y2)):
            x1, x2 = a, b
    return (x1, y1, x2, y2) if x2 > x1 and y2 > y1 else unit


def local_contexts(units: DataFrame, parents: DataFrame, page_w: int, page_h: int, on_paper: bool = False) -> DataFrame:
    """(page, pos, c_x1 to c_y2) of units (page, pos, parent, style, corners) that share a parent (page, pos, corners) with others.

    All lie on art, or all on paper. Units alone in their parent, without one, or with a null page, position or corner give no row. Units of the same
    place are siblings like others. A page's units are held by one task.
    """
    held = parents.select("page", F.col("pos").alias("parent"), *(F.col(c).alias(f"p_{c}") for c in CORNERS))
    rows = units.join(held, ["page", "parent"]).dropna(subset=["page", "pos", *CORNERS, *(f"p_{c}" for c in CORNERS)])
    columns = ["unit", "parent", "spoken", *CORNERS, *(f"p_{c}" for c in CORNERS)]

    def kernel(rows: list[tuple]) -> list[tuple]:
        families = defaultdict(list)
        for r in rows:
            families[r[1]].append(r)
        out = []
        for family in families.values():
            boxes = [r[3:7] for r in family]
            if len(family) > 1:
                out += [(r[0], *local_context(boxes[k], r[7:], boxes[:k] + boxes[k + 1 :], page_w, page_h, bool(r[2]), everywhere if on_paper else nowhere)) for k, r in enumerate(family)]
        return out

    told = rows.withColumns({"unit": F.col("pos"), "spoken": F.coalesce(F.col("style") == "dialogue", F.lit(False)).cast("int")})
    return by_page(told, columns, kernel, ["unit", *(f"c_{c}" for c in CORNERS)]).drop("pos").withColumnRenamed("unit", "pos")
