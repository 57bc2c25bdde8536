"""Where texts may stand, in a balloon or on other ground: numpy kernels over one crop, and a DataFrame operator over many.

A crop is height x width x 3, blue first; a mask has a crop's size, set where the text's marks are. Boxes are within the crop.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.operators import balloons, placement, raster
from pagewright.operators.ordered import Corners
from pagewright.operators.surface import Seen, binary, grey, saturation

# By ground, least share of little colour, most median colour, least and most median light, least and most mean light.
PALE, DARK, NEAR = (0.86, 55, 115, 255, 105, 255), (0.78, 70, 0, 95, 0, 110), (0.78, 65, 115, 255, 105, 255)


def says(text: str | None) -> bool:
    """Whether a text has a letter or digit that can be drawn."""
    return bool(re.search(r"[A-Za-z0-9]", text or ""))


def marks_in(crop: np.ndarray, mask: np.ndarray | None, box: Corners, text: str | None, least: tuple[int, int, int]) -> np.ndarray | None:
    """The marks within a box of some width, height and area; None if it has few, reaches out of the crop, or nothing is to be drawn."""
    w, h = box[2] - box[0], box[3] - box[1]
    if mask is None or mask.shape != crop.shape[:2] or not says(text) or w < least[0] or h < least[1] or w * h < least[2]:
        return None
    return placement.cut(binary(mask), box, max(24, int(w * h * 0.004)))


def of_kind(stats: tuple[float, float, float, float], kind: tuple[float, ...]) -> bool:
    """Whether statistics of a surface are those of a kind of ground."""
    plain, colour, light, mean = stats
    return plain >= kind[0] and colour <= kind[1] and kind[2] <= light <= kind[3] and kind[4] <= mean <= kind[5]


def too_few(n: int, share: float) -> bool:
    """Whether so many pixels of a box are less than a share of any neighbourhood of marks in it."""
    return n / placement.AROUND < share


def neutral(crop: np.ndarray, mask: np.ndarray | None, box: Corners, text: str | None) -> bool:
    """Whether a box around marks is a balloon's white, grey or dark interior, as a whole or near the marks."""
    marks = marks_in(crop, mask, box, text, (28, 28, 1200))
    if marks is None:
        return False
    part = crop[box[1] : box[3], box[0] : box[2]]
    if too_few(np.count_nonzero(saturation(part) < placement.PLAIN), min(PALE[0], DARK[0], NEAR[0])):
        return False
    stats = placement.surface_stats(part)
    if of_kind(stats, PALE) or of_kind(stats, DARK):
        return True
    near = placement.neighbourhood(marks, box[2] - box[0], box[3] - box[1])
    return near is not None and of_kind(placement.surface_stats(part, near), NEAR)


def on_art(crop: np.ndarray, mask: np.ndarray | None, box: Corners, text: str | None) -> bool:
    """Whether a box may be drawn on art: close to the marks that stand there, and not on pure white."""
    marks = marks_in(crop, mask, box, text, (24, 20, 700))
    inner = placement.bounds(marks) if marks is not None else None
    if inner is None:
        return False
    w, h = box[2] - box[0], box[3] - box[1]
    if w > max(120, min(280, int((inner[2] - inner[0]) * 5.0))) or h > max(140, int((inner[3] - inner[1]) * 2.80)):
        return False
    part = crop[box[1] : box[3], box[0] : box[2]]
    clean = (grey(part) >= 242) & (saturation(part) <= 16)
    if too_few(np.count_nonzero(clean), 0.72):
        return True
    near = placement.neighbourhood(marks, w, h)
    told = near if near is not None else np.ones((h, w), bool)
    return float(clean[told].mean()) < 0.72


def owned(crop: np.ndarray, mask: np.ndarray | None, text: str | None) -> np.ndarray | None:
    """The paper of the crop that the marks stand on: of its components the one with most of them, cut at its outline and drawn in; None if the crop is not neutral."""
    h, w = crop.shape[:2]
    if not neutral(crop, mask, (0, 0, w, h), text):
        return None
    around, least = placement.anchor(binary(mask), w, h)
    if around is None:
        return None
    light = grey(crop)
    ground = raster.opened(raster.closed((saturation(crop) <= 52) & (light >= 190), 5, True), 3, True)
    best, score = None, -1
    for box, shape in raster.shapes(ground):
        n, common = int(shape.sum()), int((shape & around[box[1] : box[3], box[0] : box[2]]).sum())
        if n >= max(240, int(w * h * 0.045)) and min(box[2] - box[0], box[3] - box[1]) >= 24 and common >= least and 100 * common + n > score:
            best, score = (box, shape), 100 * common + n
    if best is None:
        return None
    (x1, y1, x2, y2), shape = best
    whole = np.zeros((h, w), bool)
    whole[y1:y2, x1:x2] = shape
    inner = raster.eroded(balloons.within_outline(whole, balloons.ink_of(mask, w, h), light), 5, True)
    box = placement.bounds(inner)
    if box is None or min(box[2] - box[0], box[3] - box[1]) < 24:
        return None
    return inner if inner.sum() >= max(180, int((box[2] - box[0]) * (box[3] - box[1]) * 0.22)) else None


def white(crop: np.ndarray, mask: np.ndarray | None, words: int) -> np.ndarray | None:
    """A clean white rectangle, or a jagged white balloon, that has the marks, or without marks is about the crop's middle."""
    h, w = crop.shape[:2]
    light = grey(crop)
    found = raster.shapes(raster.opened((light > 225) & (saturation(crop) < 45), 3))
    if not found:
        return None
    ink = balloons.ink_of(mask, w, h)
    around, least = placement.anchor(binary(mask), w, h) if ink else (None, 0)
    best, score = None, -math.inf
    for (x1, y1, x2, y2), shape in found:
        n, size = int(shape.sum()), (x2 - x1) * (y2 - y1)
        common = int((shape & around[y1:y2, x1:x2]).sum()) if around is not None else 0
        bright = float(light[y1:y2, x1:x2][shape].mean())
        if n < max(240, int(w * h * 0.035)) or min(x2 - x1, y2 - y1) < 28 or common < least or bright < 238:
            continue
        fill, share, boxed, ends = n / size, n / (w * h), size / (w * h), sum(balloons.touches((x1, y1, x2, y2), w, h))
        rectangle = fill >= 0.78
        jagged = bright >= 248 and fill >= 0.45 and share >= 0.06 and 0.12 <= boxed <= 0.82 and not (ends >= 3 and boxed > 0.55)
        if not rectangle and not jagged or rectangle and ends >= 2 and size > int(w * h * 0.62):
            continue
        if words > 2 and (share < 0.08 and boxed < 0.10 if rectangle else share < 0.14 and boxed < 0.24):
            continue
        worth = 1.4 * n + 2000 * fill - 5 * (abs((x1 + x2 - w) / 2) + abs((y1 + y2 - h) / 2)) + 25 * common
        if worth > score:
            best, score = np.zeros((h, w), bool), worth
            best[y1:y2, x1:x2] = shape
    if best is None:
        return None
    best = balloons.within_outline(best, ink, light)
    box = placement.bounds(best)
    return best if box and best.sum() >= max(180, int(w * h * 0.035)) and min(box[2] - box[0], box[3] - box[1]) >= 18 else None


def column_box(crop: np.ndarray, mask: np.ndarray | None, default: Corners, text: str | None) -> Corners | None:
    """A box wider than a narrow vertical text, around it, on neutral ground; the default one if that is at most 190 wide; None elsewhere."""
    h, w = crop.shape[:2]
    ink = balloons.ink_of(mask, w, h) if 72 <= w <= 420 and h >= 120 else None
    if ink is None:
        return None
    across, down = ink.size
    if down < across * 1.30 or w < max(72, int(across * 1.30)):
        return None
    if default[2] - default[0] <= 190:
        box = default
    else:
        wide = min(w, max(96, min(180, int(across * 1.85)), min(170, int(down * 0.48))))
        tall = min(h, max(120, int(down * 1.16), min(h, int(wide * 2.2))))
        x, y = ((max(0, min((ink.box[k] + ink.box[k + 2]) // 2 - size // 2, most - size))) for k, size, most in ((0, wide, w), (1, tall, h)))
        box = x, y, x + wide, y + tall
    return box if neutral(crop, mask, box, text) else None


def whitish(crop: np.ndarray, mask: np.ndarray | None, text: str | None) -> np.ndarray | None:
    """A white ground, else the largest paper with the marks, cut at its outline; None if it is small for more than two words or a dull ground that runs off the crop."""
    h, w = crop.shape[:2]
    words = len(re.findall(r"[A-Za-z']+", text or ""))
    if min(h, w) < 18:
        return None
    clean = white(crop, mask, words)
    if clean is not None:
        return clean
    light = grey(crop)
    papers = raster.shapes(raster.opened(raster.closed((light > 200) & (saturation(crop) < 48), 7, True, 2), 3, True))
    if not papers:
        return None
    ink = balloons.ink_of(mask, w, h)
    around, least = placement.anchor(binary(mask), w, h) if ink else (None, 0)
    best, score, clear = None, -math.inf, False
    for box, shape in papers:
        x1, y1, x2, y2 = box
        n, size = int(shape.sum()), (x2 - x1) * (y2 - y1)
        common = int((shape & around[y1:y2, x1:x2]).sum()) if around is not None else 0
        if n < max(180, int(w * h * 0.055)) or min(x2 - x1, y2 - y1) < 18 or n / size < 0.34 or common < least:
            continue
        bright = float(light[y1:y2, x1:x2][shape].mean())
        runs_off = sum(balloons.touches(box, w, h)) >= 2 and size > int(w * h * 0.45)
        found = 1.4 * n + 0.15 * size - 3 * (abs((x1 + x2 - w) / 2) + abs((y1 + y2 - h) / 2)) + 25 * common
        found -= n * (4.0 if bright < 232 else 0.35) if runs_off else 0
        if found > score:
            fill, share, boxed = n / size, n / (w * h), size / (w * h)
            crisp = bright >= 245 and fill >= 0.48 and (share >= 0.075 or boxed >= 0.14)
            clear = not (runs_off and (bright < 245 or fill < 0.82)) and (words <= 2 or share >= 0.11 or boxed >= 0.18 or crisp)
            best, score = np.zeros((h, w), bool), found
            best[y1:y2, x1:x2] = shape
    if not clear:
        return None
    best = balloons.within_outline(best, ink, light)
    box = placement.bounds(best)
    if box is None or best.sum() < max(180, int(w * h * 0.04)) or min(box[2] - box[0], box[3] - box[1]) < 18:
        return None
    return best if best.sum() >= max(120, int((box[2] - box[0]) * (box[3] - box[1]) * 0.25)) else None


def text_box(crop: np.ndarray, mask: np.ndarray | None, style: str | None, text: str = "") -> tuple[Corners, np.ndarray | None, str]:
    """The box in a crop that a text may fill, the part of the crop it may stand on, and where: balloon, column or ink; a sound stands by its marks."""
    h, w = crop.shape[:2]
    ink = balloons.ink_of(mask, w, h)
    if style == "sfx":
        return balloons.sound_box(ink, w, h), None, "sound"
    near = balloons.ink_box(ink, w, h) or (0, 0, w, h)
    inner = balloons.room(crop, ink, text)
    box = placement.bounds(inner) if inner is not None else None
    # A very narrow balloon gives way to a column's box, as a missing one does.
    if box and not (box[2] - box[0] < 58 and re.search(r"[A-Za-z0-9]{3,}", text)):
        return box, inner, "balloon"
    column = column_box(crop, mask, near, text)
    if column:
        return column, None, "column"
    return (box, inner, "balloon") if box else (near, None, "ink")


def ground(crop: np.ndarray, mask: np.ndarray | None, box: Corners, text: str | None) -> tuple[np.ndarray | None, str]:
    """What a text without a balloon stands on within its box, and its kind: paper, neutral, art, or none, where it is not to be drawn."""
    part, marks = crop[box[1] : box[3], box[0] : box[2]], placement.cut(mask, box)
    for kind, found in (("paper", whitish(part, marks, text)), ("neutral", owned(part, marks, text))):
        if found is not None:
            out = np.zeros(crop.shape[:2], bool)
            out[box[1] : box[3], box[0] : box[2]] = found
            return out, kind
    return None, "art" if on_art(crop, mask, box, text) else "none"


SCHEMA = "page long, idx long, x1 int, y1 int, x2 int, y2 int, stands string, mask binary"


def text_boxes(units: DataFrame) -> DataFrame:
    """(page, idx, x1, y1, x2, y2, stands, mask) of units (page, idx, style, text, width, height, pixels, mask).

    pixels are three bytes each, blue first, mask a byte a pixel; without a mask of that size the crop is taken to have no ink. A unit whose
    pixels are of another size, or null, is left out; a null style is dialogue, a null text empty. stands is balloon, sound, or the
    kind of ground: paper, neutral, art, none. The mask that comes back is 1 where text may stand, null where there is no ground but art.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            *told, crops, masks = b.columns
            for page, idx, style, text, w, h, pixels, mask in zip(*(c.to_pylist() for c in told), crops, masks, strict=True):
                # Pixels are read where the batch holds them, not copied.
                crop, marks = (np.frombuffer(x.as_buffer() or b"", np.uint8) for x in (pixels, mask))
                if w and h and len(crop) == 3 * w * h:
                    whole, ink = Seen(crop.reshape(h, w, 3)), marks.reshape(h, w) if len(marks) == w * h else None
                    box, inner, stands = text_box(whole, ink, style, text or "")
                    if stands in ("column", "ink"):
                        inner, stands = ground(whole, ink, box, text)
                    out.append((page, idx, *box, stands, inner.astype(np.uint8).tobytes() if inner is not None else None))
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), *(pa.int32(),) * 4, pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return units.select("page", "idx", "style", "text", "width", "height", "pixels", "mask").mapInArrow(run, SCHEMA)
