import numpy as np
from helpers import block, disc, rows

from pagewright.operators import contexts as c
from pagewright.operators.splitting import text_lobes

PAGE = (1000, 1000)
PARENT = (100, 100, 500, 500)


def test_room_within_the_parent():
    # 40 x 30: grown by 34 and 16.
    assert c.local_context((200, 200, 240, 230), PARENT, [], *PAGE, False) == (166, 184, 274, 246)
    assert c.local_context((110, 110, 150, 140), PARENT, [], *PAGE, False) == (100, 100, 184, 156)
    # A column grows by a fifth of its height too, a line by a part of its width, and less in a parent of a page's size.
    assert c.local_context((200, 200, 210, 400), PARENT, [], *PAGE, False) == (160, 100, 250, 500)
    assert c.local_context((200, 200, 210, 400), (0, 0, 1000, 1000), [], *PAGE, False) == (160, 136, 250, 464)
    assert c.local_context((200, 200, 400, 220), PARENT, [], *PAGE, False) == (100, 168, 500, 252)


def test_siblings_leave_half_of_the_way():
    unit, beside, below, away = (200, 200, 240, 230), (260, 205, 300, 235), (205, 240, 245, 270), (400, 400, 440, 430)
    assert c.local_context(unit, PARENT, [beside], *PAGE, False) == (166, 184, 246, 246)
    assert c.local_context(unit, PARENT, [below], *PAGE, False) == (166, 184, 274, 231)
    assert c.local_context(unit, PARENT, [away, unit], *PAGE, False) == (166, 184, 274, 246)
    # What overlaps does not cut into the unit.
    assert c.local_context(unit, PARENT, [(210, 200, 250, 230)], *PAGE, False)[2] == 240


def test_columns_of_dialogue_on_paper():
    unit = (200, 200, 220, 300)
    narrow = c.local_context(unit, PARENT, [], *PAGE, True)
    assert narrow == (180, 145, 240, 355) and c.local_context(unit, PARENT, [], *PAGE, True, lambda _: True) == (162, 145, 258, 355)
    assert c.local_context(unit, PARENT, [], *PAGE, False, lambda _: True) == narrow


def test_contexts_of_units(spark):
    corners = "x1 int, y1 int, x2 int, y2 int"
    units = [(1, 1, 1, "sfx", 200, 200, 240, 230, "q"), (1, 2, 1, None, 260, 205, 300, 235, None), (1, 3, 2, "dialogue", 1, 1, 9, 9, "q"), (1, 4, None, "dialogue", 1, 1, 9, 9, "q"), (None, 5, 1, "sfx", 1, 1, 9, 9, "q"), (1, 6, 9, "sfx", 1, 1, 9, 9, "q"), (1, 7, 9, "sfx", 1, 1, 9, 9, "q")]
    u = spark.createDataFrame(units, f"page long, pos long, parent long, style string, {corners}, unit string")
    p = spark.createDataFrame([(1, 1, *PARENT), (1, 2, *PARENT)], f"page long, pos long, {corners}")
    got = rows(c.local_contexts(u, p, *PAGE))
    assert got == [(1, 1, *c.local_context((200, 200, 240, 230), PARENT, [(260, 205, 300, 235)], *PAGE, False)), (1, 2, *c.local_context((260, 205, 300, 235), PARENT, [(200, 200, 240, 230)], *PAGE, False))]
    assert c.local_contexts(u.limit(0), p, *PAGE).count() == 0


def test_texts_of_balloons_that_touch():
    paper = disc(50, 80, 45) | disc(150, 80, 45)
    left, right, also = (40, 60, 60, 100), (140, 60, 160, 100), (30, 70, 38, 90)
    assert text_lobes(paper, [left, right, also]) == [[left, also], [right]]
    # A box off the paper is in no balloon; one balloon is not taken apart, nor are boxes in one of two.
    assert text_lobes(paper, [left, right, (95, 0, 105, 10)]) == [[left], [right]]
    assert text_lobes(disc(100, 80, 60), [left, right]) == [] == text_lobes(paper, [left, also]) == text_lobes(paper, [left]) == text_lobes(block(0, 0, 5, 5), [left, right])
    assert text_lobes(np.ones((160, 200), np.uint8), [left, right]) == []
