"""Text masks to boxes: morphology and connected components in numpy, one page at a time in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.operators.ordered import Corners, hull

#: Distance below which the centres of two marks make them one cluster.
CENTRES = 180.0


def odd(n: int) -> int:
    return n + 1 - n % 2


def spread(mask: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Each pixel set if one at most so far along an axis is."""
    out = mask.copy()
    done = 0
    while done < reach:
        step = min(done + 1, reach - done)
        now = out.copy()
        if axis:
            now[:, step:] |= out[:, :-step]
            now[:, :-step] |= out[:, step:]
        else:
            now[step:] |= out[:-step]
            now[:-step] |= out[step:]
        out, done = now, done + step
    return out


def dilated(mask: np.ndarray, size: int, round_: bool = False) -> np.ndarray:
    """Dilation by a square, or by an ellipse, of an odd size; nothing comes in from outside."""
    r = min(size // 2, max(mask.shape))
    if mask.all() or not mask.any():
        return mask.copy()
    if not round_:
        return spread(spread(mask, r, 0), r, 1)
    out = np.zeros_like(mask)
    wide, done = mask, 0
    for dy in range(r, -1, -1):
        # Rows nearer the middle are wider: each goes on from the one before.
        reach = int(round(r * np.sqrt(max(0.0, 1 - (dy / r) ** 2)))) if r else 0
        wide, done = spread(wide, reach - done, 1) if reach > done else wide, reach
        if dy < mask.shape[0]:
            out[dy:] |= wide[: mask.shape[0] - dy]
            out[: mask.shape[0] - dy] |= wide[dy:]
    return out


def eroded(mask: np.ndarray, size: int, round_: bool = False) -> np.ndarray:
    return ~dilated(~mask, size, round_)


def closed(mask: np.ndarray, size: int, round_: bool = False, times: int = 1) -> np.ndarray:
    for _ in range(times):
        mask = dilated(mask, size, round_)
    for _ in range(times):
        mask = eroded(mask, size, round_)
    return mask


def opened(mask: np.ndarray, size: int, round_: bool = False) -> np.ndarray:
    return dilated(eroded(mask, size, round_), size, round_)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end and component of each run of pixels; a component is 8-connected and named by its first run."""
    wide = np.zeros((mask.shape[0], mask.shape[1] + 2), bool)
    wide[:, 1:-1] = mask
    y, at = np.nonzero(wide[:, 1:] != wide[:, :-1])
    # Where a line's pixels begin and end, in turn.
    y, start, end = y[::2], at[::2], at[1::2]
    if not len(y):
        return y, start, end, np.zeros(0, int)
    up = list(range(len(y)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    top, foot = int(y[0]), int(y[-1])
    first, starts, ends = np.searchsorted(y, np.arange(top, foot + 2)).tolist(), start.tolist(), end.tolist()
    for line in range(1, foot - top + 1):
        i, j = first[line - 1], first[line]
        while i < first[line] and j < first[line + 1]:
            # Runs that overlap, or touch at a corner, are one.
            if starts[i] <= ends[j] and starts[j] <= ends[i]:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    return y, start, end, np.array([find(i) for i in range(len(y))], int)


def shapes(mask: np.ndarray) -> list[tuple[Corners, np.ndarray]]:
    """Box of each component, in reading order, and its pixels there."""
    if not mask.any():
        return []
    y, start, end, root = runs(mask)
    label = np.zeros(mask.shape, np.int32)
    for line, a, b, r in zip(y.tolist(), start.tolist(), end.tolist(), root.tolist(), strict=True):
        label[line, a:b] = r + 1
    out = []
    for r in np.unique(root):
        k = root == r
        box = int(start[k].min()), int(y[k].min()), int(end[k].max()), int(y[k].max()) + 1
        out.append((box, label[box[1] : box[3], box[0] : box[2]] == r + 1))
    return out


def components(mask: np.ndarray) -> list[tuple[Corners, int, float, float]]:
    """Box, area and centroid of each component, in reading order."""
    y, start, end, root = runs(mask)
    out = []
    for r in np.unique(root):
        k = root == r
        n = end[k] - start[k]
        total = int(n.sum())
        box = int(start[k].min()), int(y[k].min()), int(end[k].max()), int(y[k].max()) + 1
        out.append((box, total, float((n * (start[k] + end[k] - 1) / 2).sum() / total), float((n * y[k]).sum() / total)))
    return out


def near(a: Corners, b: Corners, gap: int) -> bool:
    return max(a[0], b[0]) - min(a[2], b[2]) <= gap and max(a[1], b[1]) - min(a[3], b[3]) <= gap


def joined(boxes: list[Corners], gap: int) -> list[Corners]:
    """Boxes joined until none are near each other, in the order of their first member."""
    out: list[Corners] = []
    for box in boxes:
        at, k = None, 0
        x1, y1, x2, y2 = box
        while k < len(out):
            b = out[k]
            if b[0] - x2 <= gap and x1 - b[2] <= gap and b[1] - y2 <= gap and y1 - b[3] <= gap and near(box, b, gap):
                # The first that is near, then again from the first.
                x1, y1, x2, y2 = box = hull(box, out.pop(k))
                at, k = k if at is None else min(at, k), 0
            else:
                k += 1
        out.insert(len(out) if at is None else at, box)
    return out


def padded(box: Corners, at: Corners, pad: int, w: int, h: int) -> Corners:
    """A box within a part of a page, in the page's coordinates and grown, not beyond the page."""
    return max(0, at[0] + box[0] - pad), max(0, at[1] + box[1] - pad), min(w, at[0] + box[2] + pad), min(h, at[1] + box[3] + pad)


def centre_clusters(mask: np.ndarray, box: Corners, least_area: int, pad: int, distance: float = CENTRES) -> list[Corners]:
    """Boxes of the marks of a region whose centres are near each other, directly or through others; none if all are."""
    part = mask[box[1] : box[3], box[0] : box[2]]
    found = [c for c in components(part) if c[1] >= max(60, least_area // 3) and min(c[0][2] - c[0][0], c[0][3] - c[0][1]) >= 8]
    groups: list[list[tuple]] = []
    for c in found:
        met = [g for g in groups if any((c[2] - x) ** 2 + (c[3] - y) ** 2 < distance * distance for _, _, x, y in g)]
        groups = [g for g in groups if g not in met] + [[c, *(x for g in met for x in g)]]
    if len(groups) < 2:
        return []
    out = []
    for g in groups:
        whole = g[0][0]
        for c in g[1:]:
            whole = hull(whole, c[0])
        out.append(padded(whole, box, pad, mask.shape[1], mask.shape[0]))
    return sorted(out, key=lambda b: (b[1], b[0]))


def parts(mask: np.ndarray, box: Corners, least_area: int, pad: int, oversized: bool) -> list[Corners]:
    """The boxes of a large region's separate blocks, found with little closing; none if it is one.

    An oversized region gives all its blocks; another only if no block has most of the pixels.
    """
    part = mask[box[1] : box[3], box[0] : box[2]]
    w, h = box[2] - box[0], box[3] - box[1]
    short, large = max(1, min(w, h)), w * h > 50_000
    if not part.any():
        return []
    if large and len(found := centre_clusters(mask, box, least_area, pad)) >= 2:
        return found
    shares = (0.004, 0.006) if oversized else (0.002, 0.003)
    close, grow = (3, 3) if oversized and large else (odd(max(3, int(round(short * x)))) for x in shares)
    blocks = [c for c in components(dilated(closed(part, close), grow, True)) if c[1] >= max(80 if oversized else 60, least_area // 3) and min(c[0][2] - c[0][0], c[0][3] - c[0][1]) >= 8]
    gap = (max(3, int(short * 0.015)) if large else max(4, int(short * 0.03))) if oversized else max(4, int(short * 0.02))
    out = joined([padded(c[0], box, pad, mask.shape[1], mask.shape[0]) for c in blocks], gap)
    if oversized:
        return out
    sizes = [c[1] for c in blocks]
    return out if len(out) >= 2 and max(sizes) / sum(sizes) <= 0.82 else []


def viable(mask: np.ndarray, box: Corners) -> bool:
    """Whether a region has some size and some marks."""
    return min(box[2] - box[0], box[3] - box[1]) >= 8 and int(mask[box[1] : box[3], box[0] : box[2]].sum()) >= 10


def regions(mask: np.ndarray, least_area: int = 30, pad: int = 5) -> list[Corners]:
    """Boxes of text blocks: marks are closed into blocks, small ones go, near ones are joined, large ones are taken apart, the rest is padded."""
    h, w = mask.shape
    short = min(h, w)
    wide = odd(max(25, int(round(short * 0.025))))
    blocks = closed(dilated(closed(mask, wide, times=2), wide, True), odd(max(19, int(round(short * 0.018)))), True)
    found = [b for b, area, _, _ in components(blocks) if area >= least_area and b[2] - b[0] >= 8 and b[3] - b[1] >= 8]
    out: list[Corners] = []
    for b in joined(found, max(30, int(short * 0.025))):
        bw, bh = b[2] - b[0], b[3] - b[1]
        apart = parts(mask, b, least_area, max(2, pad // 2), False) if bw * bh > 80_000 else []
        if len(apart) < 2 and (bw * bh > int(w * h * 0.06) or bw > int(w * 0.35) or bh > int(h * 0.35)):
            apart = parts(mask, b, least_area, max(2, pad // 2), True)
        out += apart if len(apart) >= 2 else [padded(b, (0, 0, w, h), pad, w, h)]
    return [b for b in out if viable(mask, b)]


def resized(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """An array of height x width by linear interpolation between pixel centres."""
    image = image.astype(float)
    for axis, size in ((0, h), (1, w)):
        n = image.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape([-1 if k == axis else 1 for k in range(image.ndim)])
        image = image.take(low, axis) * (1 - part) + image.take(np.minimum(low + 1, n - 1), axis) * part
    return image


def model_input(image: np.ndarray, size: int = 1024) -> np.ndarray:
    """An image, blue first, as a detector takes it: 1 x 3 x size x size, red first, 0 to 1."""
    return (resized(image[..., 2::-1], size, size) / 255).astype(np.float32).transpose(2, 0, 1)[None]


def text_mask(outputs: list[np.ndarray], w: int, h: int, least: float) -> np.ndarray:
    """The mask of a page from a detector's outputs: the first that is as large as an image, else the largest; none at all gives no text."""
    planes = [np.squeeze(np.asarray(o)) for o in outputs]
    planes = [p for p in planes if p.ndim >= 2]
    large = next((p for p in planes if min(p.shape[-2:]) >= 256), None)
    if large is not None:
        chosen = large if large.ndim == 2 else large[0 if large.shape[0] <= 4 else -1]
    elif planes:
        chosen = max(planes, key=lambda p: p.shape[-1] * p.shape[-2])
        chosen = chosen if chosen.ndim == 2 else chosen[0]
    else:
        return np.zeros((h, w), bool)
    return resized(chosen / max(1.0, float(chosen.max())), w, h) > least


def detected(pages: DataFrame, detector: Callable[[np.ndarray], list[np.ndarray]], least: float = 0.3) -> DataFrame:
    """(page, height, width, mask) of pages (page, height, width, pixels: three bytes a pixel, blue first); detector is a model's function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, h, w, pixels in zip(*(c.to_pylist() for c in b.columns), strict=True):
                whole = np.frombuffer(pixels or b"", np.uint8)
                if h and w and len(whole) == 3 * h * w:
                    out.append((page, h, w, text_mask(detector(model_input(whole.reshape(h, w, 3))), w, h, least).astype(np.uint8).tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["page", "height", "width", "mask"])

    return pages.select("page", "height", "width", "pixels").mapInArrow(run, "page long, height int, width int, mask binary")


def _boxes(masks: DataFrame, kernel, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page, h, w, mask in zip(*(c.to_pylist() for c in b.columns), strict=True):
                whole = np.frombuffer(mask or b"", np.uint8)
                if h and w and len(whole) == h * w:
                    rows += [(page, k, *r) for k, r in enumerate(kernel(whole.reshape(h, w) > 0))]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema([(n, pa.float64() if n in ("cx", "cy") else pa.int64()) for n in names]))

    return masks.select("page", "height", "width", "mask").mapInArrow(run, schema)


def mask_components(masks: DataFrame) -> DataFrame:
    """(page, pos, x1, y1, x2, y2, area, cx, cy) of each page's mask (page, height, width, mask: a byte a pixel); a mask of another size has none."""
    return _boxes(masks, lambda m: [(*b, area, x, y) for b, area, x, y in components(m)], "page long, pos long, x1 long, y1 long, x2 long, y2 long, area long, cx double, cy double")


def mask_regions(masks: DataFrame) -> DataFrame:
    """(page, pos, x1, y1, x2, y2) of the text blocks of each page's mask."""
    return _boxes(masks, regions, "page long, pos long, x1 long, y1 long, x2 long, y2 long")
