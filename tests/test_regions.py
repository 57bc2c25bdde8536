import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from pagewright.functions import geometry as g
from pagewright.operators import regions as r

SCHEMA = "page long, pos long, x1 long, y1 long, x2 long, y2 long"


def near(a, b, gap):
    return max(0, max(a[0], b[0]) - min(a[2], b[2])) <= gap and max(0, max(a[1], b[1]) - min(a[3], b[3])) <= gap


def close(boxes, gap):
    boxes = list(dict.fromkeys(boxes))
    while True:
        for i, a in enumerate(boxes):
            j = next((j for j in range(i + 1, len(boxes)) if near(a, boxes[j], gap)), None)
            if j is not None:
                b = boxes.pop(j)
                boxes[i] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                break
        else:
            return sorted(boxes)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(7)
    out = []
    for page in range(6):
        for pos in range(rng.choice([0, 1, 9, 25])):
            x, y = rng.randrange(700), rng.randrange(900)
            out.append((page, pos, x, y, x + rng.randrange(1, 400), y + rng.randrange(1, 90)))
    return out


@pytest.fixture(params=["few", "crowded"])
def kind(request, monkeypatch):
    """Pages as kernels see them, and as if all were crowded."""
    if request.param == "crowded":
        monkeypatch.setattr(r, "FEW", 0)


def test_closure(spark, pages, kind):
    found = r.closure(spark.createDataFrame(pages, SCHEMA), 12)
    got = {p: sorted(tuple(x[2:]) for x in found.collect() if x[0] == p) for p in {x[0] for x in pages}}
    assert got == {p: close([x[2:] for x in pages if x[0] == p], 12) for p in got}


def test_closure_of_grown_boxes(spark, kind):
    boxes = [(1, 0, 0, 0, 10, 50), (1, 1, 10, 40, 50, 50), (1, 2, 30, 5, 35, 10)]
    assert [tuple(x) for x in r.closure(spark.createDataFrame(boxes, SCHEMA), 0).collect()] == [(1, 0, 0, 0, 50, 50)]


def test_pairs_are_made_once(spark, pages):
    df = spark.createDataFrame(pages, SCHEMA)
    for gap in (0, 30, 300):
        got = rows(r.near_pairs(df, gap).select("page", "a.pos", "b.pos"))
        want = sorted(((a[0], a[1], b[1]) for a in pages for b in pages if a[0] == b[0] and a[1] < b[1] and near(a[2:], b[2:], gap)), key=lambda x: tuple((False, str(v)) for v in x))
        assert got == want


def test_clusters(spark, kind):
    boxes = [(1, 0, 0, 0, 10, 10), (1, 1, 100, 0, 110, 10), (1, 2, 200, 0, 210, 10), (1, 3, 300, 0, 310, 10), (2, 0, 0, 0, 10, 10)]
    got = rows(r.centroid_clusters(spark.createDataFrame(boxes, SCHEMA), 100))
    assert got == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 0, 0)]
    got = rows(r.centroid_clusters(spark.createDataFrame(boxes, SCHEMA), 101))
    assert got == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 3, 0), (2, 0, 0)]


def test_chains_longer_than_a_hundred(spark):
    row = [(1, i, 100 * i, 0, 100 * i + 10, 10) for i in range(300)]
    random.Random(1).shuffle(row)
    df = spark.createDataFrame(row, SCHEMA)
    assert {x["root"] for x in r.centroid_clusters(df, 101).collect()} == {0}
    assert [tuple(x) for x in r.closure(df, 90).collect()] == [(1, 0, 0, 0, 29910, 10)]


def test_large_boxes_take_few_cells(spark):
    boxes = [(1, 0, 0, 0, 2_000_000_000, 2_000_000_000), (1, 1, 5, 5, 9, 9), (1, 2, 1_999_999_990, 7, 2_000_000_000, 8), (1, 3, 3_000_000_000, 0, 3_000_000_001, 1)]
    df = spark.createDataFrame(boxes, SCHEMA)
    rows_, grids = r.graded(df, 0)
    assert r.cells(r.listed(rows_, grids), 0).count() < 40
    assert rows(r.near_pairs(df, 0).select("a.pos", "b.pos")) == [(0, 1), (0, 2)]
    assert rows(r.contained(df, df).where("inner <> outer").select("inner", "outer")) == [(1, 0), (2, 0)]


def test_reading_order(spark):
    centres = [(100, 10), (800, 50), (800, 5), (450, 1)]
    df = spark.createDataFrame([(1, i, x - 1, y - 1, x + 1, y + 1) for i, (x, y) in enumerate(centres)], SCHEMA)
    assert [x["pos"] for x in r.reading_order(df, 900).orderBy("place").collect()] == [2, 1, 3, 0]


def test_geometry(spark):
    df = spark.createDataFrame([(0, 0, 10, 10, 5, 0, 15, 10)], "a1 int, a2 int, a3 int, a4 int, b1 int, b2 int, b3 int, b4 int")
    a, b = g.Box(*(F.col(f"a{k}") for k in "1234")), g.Box(*(F.col(f"b{k}") for k in "1234"))
    x = df.select(g.iou(a, b), g.over_smaller(a, b), g.holds_centre(a, b), g.near(a, b, 0)).first()
    assert tuple(x) == (50 / 150, 0.5, False, True)


def test_budgets(spark):
    want = {("dialogue", 50, 200): (5, 22), ("dialogue", 110, 200): (8, 32), ("dialogue", 150, 100): (10, 44), ("dialogue", 150, 210): (12, 50), ("dialogue", 200, 200): (14, 60), ("sfx", 100, 100): (3, 12), ("sfx", 160, 100): (3, 18)}
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(want)], "i int, s string, w int, h int")
    assert [tuple(x[1]) for x in df.select("i", g.budget(F.col("s"), F.col("w"), F.col("h"))).orderBy("i").collect()] == list(want.values())


def test_empty(spark, kind):
    none = spark.createDataFrame([], SCHEMA)
    assert r.closure(none, 3).count() == r.near_pairs(none, 3).count() == r.centroid_clusters(none, 3).count() == 0


def test_coverage_adds_up(spark):
    units = [(1, "a", True, True), (1, "", True, False), (1, "b", False, False), (1, "c", True, False), (2, " ", False, False)]
    got = {x["page"]: x for x in r.coverage(spark.createDataFrame(units, "page int, text string, renderable boolean, drawn boolean")).collect()}
    assert all(x["detected"] == x["ocr"] + x["ocr_empty"] and x["ocr"] == x["rendered"] + x["render_failed"] + x["filtered"] for x in got.values())
    assert tuple(got[1])[1:] == (4, 3, 1, 1, 1, 1)
