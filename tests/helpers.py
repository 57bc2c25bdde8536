import numpy as np


def rows(df, *order):
    """All rows as tuples, in an order that does not depend on the plan."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def blank(w=200, h=160):
    return np.zeros((h, w), bool)


def block(x1, y1, x2, y2, w=200, h=160):
    out = blank(w, h)
    out[y1:y2, x1:x2] = True
    return out


def disc(cx, cy, r, w=200, h=160):
    y, x = np.mgrid[:h, :w]
    return (x - cx) ** 2 + (y - cy) ** 2 <= r * r


def drawn(w=200, h=160):
    """Grey ground, a white balloon with a black outline, black marks in it; and the marks' mask."""
    crop = np.full((h, w, 3), 120, np.uint8)
    crop[disc(100, 80, 62, w, h)] = 0
    crop[disc(100, 80, 58, w, h)] = 255
    marks = block(75, 50, 125, 110, w, h) & (np.mgrid[:h, :w][0] % 8 < 5)
    crop[marks] = 0
    return crop, marks.astype(np.uint8)
