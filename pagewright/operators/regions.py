"""Relational operators over boxes of pages.

Inputs have `page`, `pos` (a total order within a page) and x1, y1, x2, y2. Joins
of a page's boxes are equi-joins on the page and on grid cells, so a crowded page is
spread over tasks and never met box by box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry as g
from pagewright.operators.graph import components as connected
from pagewright.operators.pages import by_page
from pagewright.session import join_small, saved

CORNERS = ["x1", "y1", "x2", "y2"]
#: Side of the cells of the finest grid; each grid is four times as coarse as the one before.
CELL, COARSER = 256, 4
#: Boxes of a page that a kernel sees whole; a page with more is crowded.
FEW = 256


def reading_order(regions: DataFrame, page_width: int, columns: int = 3) -> DataFrame:
    """regions with `place`: columns from the right, then down, then input order."""
    x, y = g.centre(g.box())
    column = columns - 1 - F.floor(x / (page_width / columns)).cast("int")
    order = Window.partitionBy("page").orderBy(column, y, "pos")
    return regions.withColumn("place", F.row_number().over(order))


def side(level: Column | int) -> Column:
    """Length of a cell's side of a grid."""
    return (F.lit(CELL) * F.pow(F.lit(COARSER), level)).cast("long")


def graded(df: DataFrame, reach: int) -> tuple[DataFrame, list[int]]:
    """df with `home`, the finest grid of which a box, grown by reach, takes two cells at most each way, and the grids that occur."""
    longest = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) + 2 * reach
    home = F.when(longest <= CELL, 0).otherwise(F.ceil(F.log(longest / CELL) / F.log(F.lit(float(COARSER))))).cast("int")
    df = df.withColumn("home", home)
    # A few numbers at most: sides are whole numbers of 64 bits.
    return df, sorted(r[0] for r in df.select("home").distinct().collect() if r[0] is not None)


def cells(df: DataFrame, reach: int) -> DataFrame:
    """A row for each cell, of the grid `level`, that a box, grown by reach, touches."""
    span = [F.sequence(F.floor((F.col(a) - reach) / side(F.col("level"))), F.floor((F.col(b) + reach) / side(F.col("level")))) for a, b in (("x1", "x2"), ("y1", "y2"))]
    return df.withColumn("cell_x", F.explode(span[0])).withColumn("cell_y", F.explode(span[1]))


def listed(df: DataFrame, grids: list[int]) -> DataFrame:
    """A row for each grid that occurs from a box's own on."""
    levels = F.filter(F.array(*map(F.lit, grids)), lambda x: x >= F.col("home")) if grids else F.array().cast("array<int>")
    return df.withColumn("level", F.explode(levels))


def pairs(boxes: DataFrame, test, reach: int = 0) -> DataFrame:
    """Pairs a, b (structs of pos and corners, a first) of a page whose boxes are at most `reach` apart each way and that pass the test.

    Boxes meet in the grid of the larger one, so a box takes four cells of each grid at most, however large it is. A pair is
    made in one cell only: the one that holds the corner where the two boxes, grown by half of reach, begin to overlap.
    """
    half = (reach + 1) // 2
    own = F.struct("pos", *CORNERS)
    rows, grids = graded(boxes.select("page", "pos", *CORNERS), half)
    gridded = cells(listed(rows, grids), half)
    a, b = (gridded.select("page", "level", "cell_x", "cell_y", own.alias(n), F.col("home").alias(f"home_{n}")) for n in "ab")
    first = [F.floor((F.greatest(f"a.{c}", f"b.{c}") - half) / side(F.col("level"))) == F.col(f"cell_{c[0]}") for c in ("x1", "y1")]
    both = a.join(b, ["page", "level", "cell_x", "cell_y"]).where((F.col("a.pos") < F.col("b.pos")) & (F.col("level") == F.greatest("home_a", "home_b")) & first[0] & first[1])
    return both.where(test(g.box("a"), g.box("b"))).select("page", "a", "b")


def near_pairs(boxes: DataFrame, gap: int) -> DataFrame:
    """Pairs of boxes at most so far apart along each axis."""
    return pairs(boxes, lambda a, b: g.near(a, b, gap), gap)


def overlap_pairs(boxes: DataFrame) -> DataFrame:
    """Pairs of boxes that share some area, with iou and share of the smaller."""
    found = pairs(boxes, lambda a, b: g.intersection(a, b) > 0)
    return found.withColumn("iou", g.iou(g.box("a"), g.box("b"))).withColumn("share", g.over_smaller(g.box("a"), g.box("b")))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(page, inner, outer): positions of boxes and of the boxes that hold their centre."""
    x, y = g.centre(g.box())
    areas, grids = graded(outer.select("page", F.col("pos").alias("outer"), *CORNERS), 0)
    areas = cells(areas.withColumn("level", F.col("home")), 0)
    points = listed(inner.select("page", F.col("pos").alias("inner"), x.alias("x"), y.alias("y"), F.lit(0).alias("home")), grids)
    points = points.withColumn("cell_x", F.floor(F.col("x") / side(F.col("level")))).withColumn("cell_y", F.floor(F.col("y") / side(F.col("level"))))
    inside = (F.col("x1") <= F.col("x")) & (F.col("x") < F.col("x2")) & (F.col("y1") <= F.col("y")) & (F.col("y") < F.col("y2"))
    return points.join(areas, ["page", "level", "cell_x", "cell_y"]).where(inside).select("page", "inner", "outer")


def by_size(boxes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Boxes of pages with few, which a kernel sees whole, and of crowded pages, if there are any; boxes must be a table that is cheap to read twice."""
    pages = saved(boxes.groupBy("page").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("page"))
    if pages.isEmpty():
        return boxes, None
    return join_small(boxes, pages, "page", "left_anti"), join_small(boxes, pages, "page", "left_semi")


def closed(rows: list[tuple], gap: int) -> list[tuple]:
    """Boxes (position and corners) of a page joined until none are near, each with the least position of its members."""
    out: list[tuple] = []
    for own in rows:
        at, x1, y1, x2, y2 = own
        k = 0
        while k < len(out):
            p, a, b, c, d = out[k]
            if a - x2 <= gap and x1 - c <= gap and b - y2 <= gap and y1 - d <= gap and g.apart((x1, y1, x2, y2), (a, b, c, d)) <= gap:
                # The first that is near, then again from the first.
                del out[k]
                at, x1, y1, x2, y2, k = min(at, p), min(x1, a), min(y1, b), max(x2, c), max(y2, d), 0
            else:
                k += 1
        out.append((at, x1, y1, x2, y2))
    return out


def closure(boxes: DataFrame, gap: int) -> DataFrame:
    """The boxes left when near ones are joined until none are near, with the least position of each.

    Pages with few boxes are closed by a kernel each. On crowded pages every box takes the hull of the boxes near to
    it, itself included, until none grows; only pages on which a box has grown go on to the next round.
    """

    def distinct(df: DataFrame) -> DataFrame:
        # Of equal boxes the least position stays.
        return df.groupBy("page", *CORNERS).agg(F.min("pos").alias("pos")).select("page", "pos", *CORNERS)

    whole = saved(boxes.select("page", "pos", *CORNERS))
    few, now = by_size(whole)
    kinds = {f.name: f.dataType for f in whole.schema}
    out = by_page(few.withColumn("at", F.col("pos")), ["at", *CORNERS], lambda rows: closed(rows, gap), ["at", *CORNERS]).drop("pos").withColumnRenamed("at", "pos")
    out = out.select(*(F.col(c).cast(kinds[c]).alias(c) for c in ("page", "pos", *CORNERS)))
    now = saved(distinct(now)) if now else None
    while now and not now.isEmpty():
        found = near_pairs(now, gap)
        both = F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.col("b").alias("own"), F.col("a").alias("other"))))
        sides = found.select("page", both.alias("s")).select("page", F.col("s.own.pos").alias("at"), *(F.col(f"s.other.{c}") for c in CORNERS), F.col("s.other.pos").alias("pos"))
        every = sides.unionByName(now.withColumn("at", F.col("pos")).select("page", "at", *CORNERS, "pos"))
        own = [F.max(F.when(F.col("pos") == F.col("at"), F.col(c))) for c in CORNERS]
        hull = [F.min("x1"), F.min("y1"), F.max("x2"), F.max("y2")]
        grown = own[0] != hull[0]
        for was, is_now in zip(own[1:], hull[1:], strict=True):
            grown = grown | (was != is_now)
        hulls = saved(every.groupBy("page", "at").agg(*(h.alias(c) for h, c in zip(hull, CORNERS, strict=True)), F.min("pos").alias("pos"), grown.alias("grown")))
        moved = hulls.where("grown").select("page").distinct()
        out = out.unionAll(hulls.join(moved, "page", "left_anti").select("page", "pos", *CORNERS))
        now = saved(distinct(hulls.join(moved, "page", "left_semi")))
    return out


def linked(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(page, pos, root): the least position that each node reaches over links (page, a, b)."""
    found = connected(links, ["page"]).withColumnRenamed("node", "pos")
    return nodes.select("page", "pos").join(found, ["page", "pos"], "left").select("page", "pos", F.coalesce("root", "pos").alias("root"))


def centroid_clusters(components: DataFrame, distance: int) -> DataFrame:
    """(page, pos, root) of boxes joined where their centres are nearer than a distance."""

    def close(a: g.Box, b: g.Box) -> Column:
        x, y = a.x1 - b.x1, a.y1 - b.y1
        return x * x + y * y < 4 * distance * distance

    def kernel(rows: list[tuple]) -> list[tuple]:
        groups: list[list[tuple]] = []
        for own in rows:
            met = [x for x in groups if any((own[1] - a) ** 2 + (own[2] - b) ** 2 < 4 * distance * distance for _, a, b in x)]
            groups = [x for x in groups if x not in met] + [[own, *(p for x in met for p in x)]]
        return [(p, least) for x in groups for least in [min(x)[0]] for p, _, _ in x]

    # A point at twice the centre stands for a box, so that all is whole.
    x, y = ((F.col(f"{c}1") + F.col(f"{c}2")).cast("long") for c in "xy")
    points = saved(components.select("page", "pos", x.alias("x1"), y.alias("y1"), x.alias("x2"), y.alias("y2")))
    few, many = by_size(points)
    out = by_page(few.withColumn("at", F.col("pos")), ["at", "x1", "y1"], kernel, ["at", "root"]).drop("pos").withColumnRenamed("at", "pos")
    out = out.select(*(F.col(c).cast(points.schema["pos" if c == "root" else c].dataType).alias(c) for c in ("page", "pos", "root")))
    return out.unionAll(linked(many, pairs(many, close, 2 * distance).select("page", F.col("a.pos").alias("a"), F.col("b.pos").alias("b")))) if many else out


def dominant_label(pixels: DataFrame, components: DataFrame, least_area: int = 2500) -> DataFrame:
    """(page, region, label): the label with most pixels in a region among components of some size; the greater label of equals."""
    large = components.where(F.col("area") >= least_area).select("page", "label")
    counts = pixels.where("label > 0").groupBy("page", "region", "label").agg(F.count("*").alias("n")).join(large, ["page", "label"])
    return counts.groupBy("page", "region").agg(F.max(F.struct("n", "label")).alias("m")).select("page", "region", F.col("m.label").alias("label"))


def row_islands(boxes: DataFrame, most: int) -> DataFrame:
    """boxes with `row`: a new row begins where the next centre, downwards, is more than so far below."""
    _, y = g.centre(g.box())
    order = Window.partitionBy("page").orderBy("cy", "pos")
    return boxes.withColumn("cy", y).withColumn("new", F.coalesce((F.col("cy") - F.lag("cy").over(order) > most).cast("int"), F.lit(0))).withColumn("row", F.sum("new").over(order)).drop("new")


def valleys(boxes: DataFrame, bins: int, page_width: int) -> DataFrame:
    """(page, bin, n, smooth, valley) of the centres' histogram: [1, 2, 1] smoothed, valleys below both neighbours."""
    x, _ = g.centre(g.box())
    counts = boxes.select("page", F.least(F.lit(bins - 1), F.floor(x * bins / page_width)).alias("bin")).groupBy("page", "bin").agg(F.count("*").alias("n"))
    every = boxes.select("page").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    order = Window.partitionBy("page").orderBy("bin")
    rows = every.join(counts, ["page", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    rows = rows.withColumn("smooth", F.coalesce(F.lag("n").over(order), F.lit(0)) + 2 * F.col("n") + F.coalesce(F.lead("n").over(order), F.lit(0)))
    return rows.withColumn("valley", F.coalesce((F.col("smooth") < F.lag("smooth").over(order)) & (F.col("smooth") < F.lead("smooth").over(order)), F.lit(False)))


def first_of_each(rows: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """The first row of each value, in input order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(pos))).where("__r = 1").drop("__r")


def best_candidate(candidates: DataFrame, by: list[str], score: Column, pos: str = "variant_idx") -> DataFrame:
    """The candidate with the greatest score of each group, the first of equals."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), pos)
    return candidates.withColumn("score", score).withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def coverage(units: DataFrame) -> DataFrame:
    """Counts of a page's units: detected, recognised, drawn, empty, failed, filtered; units have text, renderable, drawn."""
    some = F.length(F.trim("text")) > 0
    return units.groupBy("page").agg(
        F.count("*").alias("detected"),
        F.count_if(some).alias("ocr"),
        F.count_if(some & F.col("renderable") & F.col("drawn")).alias("rendered"),
        F.count_if(~some).alias("ocr_empty"),
        F.count_if(some & F.col("renderable") & ~F.col("drawn")).alias("render_failed"),
        F.count_if(some & ~F.col("renderable")).alias("filtered"),
    )


def render_contexts(units: DataFrame, parents: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """units (page, pos, parent, style, corners) with c_x1 to c_y2: the box in which to look for a unit's balloon.

    A unit alone in its parent (page, pos) has the parent's box, and room around it, if it is dialogue; units that share a parent, or have none, keep
    their own; `contexts.local_contexts` gives the boxes of those that share one.
    """
    alone = units.groupBy("page", "parent").agg(F.count("*").alias("n")).where("n = 1").select("page", "parent")
    held = parents.select("page", F.col("pos").alias("parent"), *(F.col(c).alias(f"p_{c}") for c in CORNERS)).join(alone, ["page", "parent"])
    rows = units.join(held, ["page", "parent"], "left")
    wide = g.context(g.Box(*(F.col(f"p_{c}") for c in CORNERS)), page_w, page_h)
    chosen = F.col("p_x1").isNotNull() & (F.col("style") == "dialogue")
    return rows.select("page", "pos", "parent", "style", *CORNERS, *(F.when(chosen, w).otherwise(F.col(c)).alias(f"c_{c}") for w, c in zip(wide, CORNERS, strict=True)))
