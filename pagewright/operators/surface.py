"""What the pixels of a crop say of its surface: numpy kernels over arrays of height x width x 3, blue first."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.operators import raster

AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
# Weights of blue, green and red in grey, of 2**14.
WEIGHTS, SHIFT = (1868, 9617, 4899), 14
#: By the brightest channel, what a step of chroma counts, in parts of 2**12.
PER = np.array([0, *np.rint((255 << 12) / np.arange(1, 256))], np.int32)


class Seen:
    """A crop whose light and colour are found once, and those of its parts with them."""

    def __init__(self, pixels: np.ndarray):
        self.pixels, self.shape = pixels, pixels.shape

    @cached_property
    def light(self) -> np.ndarray:
        return grey(self.pixels)

    @cached_property
    def colour(self) -> np.ndarray:
        return saturation(self.pixels)

    def __getitem__(self, part: tuple[slice, slice]) -> Seen:
        out = Seen(self.pixels[part])
        out.light, out.colour = self.light[part], self.colour[part]
        return out


def grey(crop: np.ndarray | Seen) -> np.ndarray:
    """Luminance, 0 to 255."""
    if isinstance(crop, Seen):
        return crop.light
    total = sum(crop[..., k].astype(np.int32) * w for k, w in enumerate(WEIGHTS))
    return ((total + (1 << SHIFT - 1)) >> SHIFT).astype(np.uint8)


def saturation(crop: np.ndarray | Seen) -> np.ndarray:
    """Chroma in parts of the brightest channel, 0 to 255."""
    if isinstance(crop, Seen):
        return crop.colour
    high, low = crop[..., 0], crop[..., 0]
    for k in range(1, crop.shape[-1]):
        high, low = np.maximum(high, crop[..., k]), np.minimum(low, crop[..., k])
    return (((high - low) * PER[high] + (1 << 11)) >> 12).astype(np.uint8)


def paper(crop: np.ndarray) -> bool:
    """Whether a crop has a white or pale grey ground like a balloon's, not merely little colour on the whole."""
    if crop is None or min(crop.shape[:2], default=0) < 24:
        return False
    light, colour = grey(crop), saturation(crop)
    white = (light >= 198) & (colour <= 60)
    if white.mean() >= 0.26:
        return bool(np.median(colour[white]) <= 55)
    pale = (light >= 155) & (light < 198) & (colour <= 42)
    return bool(pale.mean() >= 0.42 and np.median(colour) <= 48)


def otsu(values: np.ndarray) -> int:
    """The threshold that parts values of 0 to 255 into two classes with most variance between them, the least of equals."""
    count = np.bincount(values.ravel(), minlength=256).astype(float)
    n, total = count.sum(), (count * np.arange(256)).sum()
    below, mass = np.cumsum(count), np.cumsum(count * np.arange(256))
    both = (below > 0) & (below < n)
    spread = np.zeros(256)
    spread[both] = (total * below[both] / n - mass[both]) ** 2 / (below[both] * (n - below[both]))
    return int(spread.argmax())


def binary(mask: np.ndarray) -> np.ndarray:
    """A mask of 0 and 1, or of 0 to 255, as booleans."""
    return mask if mask.dtype == bool else mask > (127 if mask.max(initial=0) > 1 else 0)


def bright_balloon(crop: np.ndarray) -> bool:
    """Whether a crop on paper has a compact bright area of a balloon's size and little colour."""
    if not paper(crop):
        return False
    light, colour = grey(crop), saturation(crop)
    bright = raster.closed(light > int(np.clip(np.percentile(light, 82), 205, 235)), 7, True)
    h, w = light.shape
    small, box = (0.035, 0.03) if h * w >= 120_000 else (0.12, 0.10)
    for (x1, y1, x2, y2), shape in raster.shapes(bright):
        size, pixels = (x2 - x1) * (y2 - y1), int(shape.sum())
        if pixels >= max(500, int(h * w * small)) and size >= int(h * w * box) and min(x2 - x1, y2 - y1) >= 36 and pixels / size >= 0.42:
            if colour[y1:y2, x1:x2][shape].mean() <= 55:
                return True
    return False


def text_colour(crop: np.ndarray, mask: np.ndarray | None = None) -> tuple[int, int, int] | None:
    """Red, green and blue of coloured text: the median of the mask's pixels, or of those far from the border's colour; None for grey text."""
    if crop is None or crop.ndim != 3 or min(crop.shape[:2]) < 6 or crop.shape[2] < 3:
        return None
    rgb = crop[..., 2::-1].astype(float)
    chosen = binary(mask) if mask is not None and mask.shape == crop.shape[:2] else None
    if chosen is None or chosen.sum() < 5:
        h, w = crop.shape[:2]
        edge = max(2, min(h, w) // 8)
        ring = np.ones((h, w), bool)
        ring[edge:-edge, edge:-edge] = False
        far = np.sqrt(((rgb - np.median(rgb[ring], axis=0)) ** 2).sum(axis=2))
        chosen = far > max(otsu(np.clip(far, 0, 255).astype(np.uint8)), 25)
    if chosen.sum() < 5:
        return None
    found = np.median(rgb[chosen], axis=0).round().astype(int)
    return tuple(found.tolist()) if found.max() - found.min() >= 60 else None


def outline_colour(rgb: tuple[int, int, int]) -> tuple[int, int, int]:
    """White around dark text, black around light."""
    return (255,) * 3 if 0.299 * rgb[0] + 0.587 * rgb[1] + 0.114 * rgb[2] < 128 else (0,) * 3


def paper_fill(crop: np.ndarray, mask: np.ndarray) -> np.ndarray | None:
    """The colour of the paper around a mask, blue first; None if there is too little paper."""
    if mask.shape != crop.shape[:2]:
        return None
    light, colour = grey(crop), saturation(crop)
    told = ~mask & (light >= 188) & (colour <= 70)
    n = int(told.sum())
    if n < max(80, int(mask.size * 0.05)) or n / mask.size < 0.18 and light[told].mean() < 222 or colour[told].mean() > 58:
        return None
    return np.clip(np.median(crop[told].astype(float), axis=0).round(), 0, 255).astype(np.uint8)


def erase_mask(crop: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """All pixels to erase with a text: its mask, or what a threshold finds, grown over the edges and halos of its ink."""
    light = grey(crop)
    if mask is not None and mask.shape == light.shape:
        ink = binary(mask)
    else:
        level = otsu(light)
        ink = light <= level if light.mean() > 127 else light > level
    if not ink.any():
        return ink
    rows, columns = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    y1, y2, x1, x2 = rows[0], rows[-1] + 1, columns[0], columns[-1] + 1
    span = max(1, min(x2 - x1, y2 - y1))
    close, grow, near = (raster.odd(int(np.clip(round(span * share), least, most))) for share, least, most in ((0.045, 3, 11), (0.16, 5, 25), (0.32, 9, 45)))
    ink = raster.closed(ink, close, True)
    grown = raster.dilated(ink, grow, True)
    around = raster.dilated(ink, near, True)
    fill = paper_fill(crop, grown)
    if fill is not None:
        halo = around & ((np.sqrt(((crop.astype(int) - fill.astype(int)) ** 2).sum(axis=2)) > 28) | (light < 195))
    else:
        usual = light[y1:y2, x1:x2].mean()
        halo = around & grown & (light >= max(165, int(usual + 45)) if usual < 140 else light <= min(140, int(usual - 35)))
    return raster.closed(grown | halo, 3, True)


def erased(crop: np.ndarray, mask: np.ndarray | None = None, rounds: int = 200) -> np.ndarray:
    """A crop without its text: paper in the paper's colour, art by the mean of the nearest pixels that stay, spread inwards."""
    gone = erase_mask(crop, mask)
    fill = paper_fill(crop, gone)
    out = crop.copy()
    if fill is not None:
        out[gone] = fill
        return out
    left, value = gone.copy(), crop.astype(float)
    for _ in range(rounds):
        known = np.pad(~left, 1)
        near = sum(known[1 + dy : known.shape[0] - 1 + dy, 1 + dx : known.shape[1] - 1 + dx].astype(int) for dy, dx in AROUND)
        edge = left & (near > 0)
        if not edge.any():
            break
        wide = np.pad(np.where(left[..., None], 0, value), ((1, 1), (1, 1), (0, 0)))
        total = sum(wide[1 + dy : wide.shape[0] - 1 + dy, 1 + dx : wide.shape[1] - 1 + dx] for dy, dx in AROUND)
        value[edge] = total[edge] / near[edge][:, None]
        left &= ~edge
    out[gone] = np.clip(value[gone].round(), 0, 255).astype(np.uint8)
    return out


def collides(drawn: np.ndarray, before: np.ndarray, taken: np.ndarray) -> bool:
    """Whether what a text has changed on a page falls on what others have drawn."""
    new = (drawn != before).any(axis=2)
    return bool((new & (taken > 0)).sum() > max(36, int(new.sum() * 0.035))) if new.any() else False


def restored(page: np.ndarray, original: np.ndarray, box: tuple[int, int, int, int], mask: np.ndarray | None, taken: np.ndarray | None = None) -> np.ndarray:
    """A page with what was erased of a box's text put back, but for pixels that others have drawn."""
    x1, y1, x2, y2 = max(0, box[0]), max(0, box[1]), min(page.shape[1], box[2]), min(page.shape[0], box[3])
    out = page.copy()
    if x2 <= x1 or y2 <= y1:
        return out
    gone = np.ones((y2 - y1, x2 - x1), bool)
    if mask is not None and mask.shape == (box[3] - box[1], box[2] - box[0]):
        whole = np.zeros((*mask.shape, 3), original.dtype)
        whole[y1 - box[1] : y2 - box[1], x1 - box[0] : x2 - box[0]] = original[y1:y2, x1:x2]
        found = erase_mask(whole, mask)[y1 - box[1] : y2 - box[1], x1 - box[0] : x2 - box[0]]
        if found.any():
            gone = found if taken is None or taken.shape != page.shape[:2] else found & ~(taken[y1:y2, x1:x2] > 0)
    out[y1:y2, x1:x2][gone] = original[y1:y2, x1:x2][gone]
    return out


def projected(mask: np.ndarray | None, box: tuple[int, int, int, int], context: tuple[int, int, int, int]) -> np.ndarray | None:
    """A box's mask within its context; None if there is none of its size or it reaches outside."""
    if mask is None or mask.shape != (box[3] - box[1], box[2] - box[0]) or not (context[0] <= box[0] and context[1] <= box[1] and box[2] <= context[2] and box[3] <= context[3]):
        return None
    out = np.zeros((context[3] - context[1], context[2] - context[0]), np.uint8)
    out[box[1] - context[1] : box[3] - context[1], box[0] - context[0] : box[2] - context[0]] = mask
    return out


SCHEMA = "page long, paper boolean, balloon boolean, colour array<int>, n_erased long"


def described(crops: DataFrame) -> DataFrame:
    """(page, paper, balloon, colour, n_erased) of crops (page, height, width, pixels: three bytes a pixel, blue first); one of another size is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, h, w, pixels in zip(*(c.to_pylist() for c in b.columns), strict=True):
                whole = np.frombuffer(pixels or b"", np.uint8)
                if h and w and len(whole) == 3 * h * w:
                    crop = whole.reshape(h, w, 3)
                    out.append((page, paper(crop), bright_balloon(crop), text_colour(crop), int(erase_mask(crop).sum())))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int32()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return crops.select("page", "height", "width", "pixels").mapInArrow(run, SCHEMA)
