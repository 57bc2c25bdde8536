import numpy as np
from helpers import disc, drawn

from pagewright.operators import balloons, surface
from pagewright.operators import grounds as g


def crop(light, w=200, h=160, box=None, ground=90):
    out = np.full((h, w, 3), ground if box else light, np.uint8)
    if box:
        out[box[1] : box[3], box[0] : box[2]] = light
    return out


def marks(*box, w=200, h=160):
    out = np.zeros((h, w), np.uint8)
    out[box[1] : box[3], box[0] : box[2]] = 255
    return out


WHOLE, INK = (0, 0, 200, 160), marks(90, 60, 110, 100)
RED = np.zeros((160, 200, 3), np.uint8) + np.array([0, 0, 200], np.uint8)


def test_neutral_grounds():
    assert all(g.neutral(crop(x), INK, WHOLE, "Hi") for x in (255, 160, 60)) and not g.neutral(RED, INK, WHOLE, "Hi") and not g.neutral(crop(108), INK, WHOLE, "Hi")
    halo = RED.copy()
    halo[20:140, 50:150] = 230
    assert g.neutral(halo, INK, WHOLE, "Hi")
    assert not g.neutral(crop(255), INK, WHOLE, "...") and not g.neutral(crop(255), None, WHOLE, "Hi") and not g.neutral(crop(255), INK, (0, 0, 201, 160), "Hi") and not g.neutral(crop(255), INK, (0, 0, 60, 50), "Hi")
    assert not g.neutral(crop(255), INK, WHOLE, None) and not g.neutral(crop(255), INK, (90, 60, 110, 100), "Hi")


def test_boxes_on_art():
    close = (60, 50, 140, 110)
    assert g.on_art(RED, INK, close, "Hi") and g.on_art(crop(160), INK, close, "Hi") and not g.on_art(crop(255), INK, close, "Hi")
    # More than five times as wide as the marks, and than 120, or out of the crop.
    assert not g.on_art(RED, INK, (40, 50, 161, 110), "Hi") and g.on_art(RED, INK, (40, 50, 160, 110), "Hi") and not g.on_art(RED, INK, (60, 50, 201, 110), "Hi")


def test_owned_ground():
    page = crop(255, box=(20, 20, 180, 140), ground=180)
    found = g.owned(page, INK, "Hi")
    y, x = np.nonzero(found)
    assert (x.min(), y.min(), x.max(), y.max()) == (22, 22, 177, 137) and found[80, 100]
    # The larger paper beside a smaller one with the marks is not the marks'.
    two = crop(255, box=(20, 20, 60, 140), ground=180)
    two[40:120, 80:120] = 255
    assert g.owned(two, INK, "Hi")[:, :75].sum() == 0 and g.owned(crop(90), INK, "Hi") is None and g.owned(RED, INK, "Hi") is None
    assert g.owned(page, None, "Hi") is None


def test_white_grounds():
    page = crop(255, box=(40, 30, 160, 130))
    assert (g.white(page, INK, 5) == (marks(40, 30, 160, 130) > 0)).all() and (g.white(page, None, 5) == g.white(page, INK, 5)).all()
    assert g.white(page, marks(5, 5, 25, 15), 1) is None and g.white(crop(255), INK, 5) is None and g.white(crop(230, box=(40, 30, 160, 130)), INK, 5) is None
    # A rectangle of less than a twelfth serves two words, not three.
    small = crop(255, box=(80, 50, 120, 110))
    assert g.white(small, INK, 2) is not None and g.white(small, INK, 3) is None


def test_boxes_of_columns():
    ink, white = marks(190, 40, 210, 140, w=400, h=300), crop(255, 400, 300)
    assert g.column_box(white, ink, (0, 0, 400, 300), "Hi") == (152, 0, 248, 211)
    assert g.column_box(white, ink, (150, 30, 250, 160), "Hi") == (150, 30, 250, 160) and g.column_box(white, marks(150, 40, 250, 140, w=400, h=300), (0, 0, 400, 300), "Hi") is None
    red = np.zeros((300, 400, 3), np.uint8) + np.array([0, 0, 200], np.uint8)
    assert g.column_box(red, ink, (0, 0, 400, 300), "Hi") is None and g.column_box(white, None, (0, 0, 400, 300), "Hi") is None


def test_text_fills_its_balloon_or_stands_by_its_ink():
    page, ink = drawn()
    box, inner, stands = g.text_box(page, ink, "dialogue")
    assert stands == "balloon" and not (inner & ~disc(100, 80, 58)).any() and box[0] < 60 and box[2] > 140
    assert g.text_box(RED, ink, "dialogue", "Hi") == (balloons.ink_box(balloons.ink_of(ink, 200, 160), 200, 160), None, "ink")
    assert g.text_box(RED, None, None) == (WHOLE, None, "ink") and g.text_box(page, ink, "sfx")[2] == "sound"
    tall = marks(190, 40, 210, 140, w=400, h=300)
    assert g.text_box(crop(160, 400, 300), tall, "dialogue", "Hi there")[2] == "column"


def test_grounds_of_texts():
    paper = crop(255, box=(40, 30, 160, 130))
    found, kind = g.ground(paper, INK, (60, 40, 140, 120), "Hi")
    # All white to its ends, a part is no rectangle on a page, but bright enough for paper.
    assert kind == "paper" and found[40:120, 60:140].all() and found.sum() == 80 * 80
    found, kind = g.ground(paper, INK, WHOLE, "Hi")
    assert kind == "paper" and (found == (marks(40, 30, 160, 130) > 0)).all()
    # Paper of middling brightness is no clean white, but paper.
    pale = crop(215, box=(40, 30, 160, 130))
    assert g.white(pale, INK, 1) is None and g.whitish(pale, INK, "Hi") is not None and g.whitish(crop(215), INK, "Hi") is None
    assert g.whitish(crop(215, box=(80, 55, 125, 105)), INK, "one two three") is None
    assert g.ground(crop(195, box=(20, 20, 180, 140), ground=150), INK, WHOLE, "Hi")[1] == "neutral"
    assert g.ground(RED, INK, (60, 50, 140, 110), "Hi") == (None, "art") and g.ground(RED, INK, (60, 50, 140, 110), "...") == (None, "none")


def test_light_and_colour_are_found_once(monkeypatch):
    found = []
    for name in ("grey", "saturation"):
        monkeypatch.setattr(surface, name, lambda pixels, f=getattr(surface, name), name=name: found.append(name) or f(pixels))
    page, ink = drawn()
    for pixels in (RED, page, crop(255, box=(40, 30, 160, 130)), crop(195, box=(20, 20, 180, 140), ground=150)):
        seen = surface.Seen(pixels)
        for text in ("Hi", "one two three", "..."):
            assert str(g.text_box(seen, ink, "dialogue", text)) == str(g.text_box(pixels, ink, "dialogue", text))
            assert str(g.ground(seen, INK, (60, 40, 140, 120), text)) == str(g.ground(pixels, INK, (60, 40, 140, 120), text))
        assert sorted(found) == ["grey", "saturation"]
        found.clear()
    assert (surface.Seen(page)[20:90, 30:110].light == surface.grey(page)[20:90, 30:110]).all()


def test_dark_art_needs_no_neighbourhood(monkeypatch):
    # What a whole box has too little of, its marks' neighbourhood has too little of.
    monkeypatch.setattr(g.placement, "neighbourhood", None)
    assert g.on_art(RED, INK, (60, 50, 140, 110), "Hi") and not g.neutral(RED, INK, WHOLE, "Hi")
    with np.testing.assert_raises(TypeError):
        g.on_art(crop(255), INK, (60, 50, 140, 110), "Hi")


def test_text_boxes_of_units(spark):
    page, ink = drawn()
    pixels, mask, red = page.tobytes(), ink.tobytes(), RED.tobytes()
    rows = [(1, 0, "dialogue", "Hi", 200, 160, pixels, mask, "a"), (1, 1, None, "Hi", 200, 160, pixels, mask, None), (1, 2, "sfx", None, 200, 160, pixels, mask, "a"), (1, 3, "dialogue", None, 200, 160, pixels, None, "a")]
    rows += [(1, 4, "dialogue", "Hi", 200, 160, red, mask, "a"), (1, 5, "dialogue", "Hi", 200, 160, None, mask, "a"), (1, 6, "dialogue", "Hi", None, 160, pixels, mask, "a"), rows[0]]
    units = spark.createDataFrame(rows, "page long, idx long, style string, text string, width int, height int, pixels binary, mask binary, stands string")
    out = sorted(g.text_boxes(units).collect(), key=lambda r: r["idx"])
    assert [r["idx"] for r in out] == [0, 0, 1, 2, 3, 4] and out[0] == out[1] and [r["stands"] for r in out] == ["balloon", "balloon", "balloon", "sound", "balloon", "art"]
    assert len(out[0]["mask"]) == 200 * 160 and out[3]["mask"] is None and out[0][2:] == out[2][2:]
    assert g.text_boxes(units.limit(0)).count() == 0
