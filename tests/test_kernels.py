import random

import numpy as np
import pytest
from helpers import rows

from pagewright.operators import ordered, raster


def flood(mask):
    """Sizes and boxes of 8-connected components by flood fill."""
    left, out = {tuple(p) for p in np.argwhere(mask)}, []
    while left:
        stack, found = [min(left)], []
        left.discard(stack[0])
        while stack:
            y, x = stack.pop()
            found.append((y, x))
            for p in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if p in left:
                    left.discard(p)
                    stack.append(p)
        ys, xs = zip(*found, strict=True)
        out.append(((min(xs), min(ys), max(xs) + 1, max(ys) + 1), len(found), pytest.approx(sum(xs) / len(xs)), pytest.approx(sum(ys) / len(ys))))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_components(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((rng.integers(1, 30), rng.integers(1, 30))) < (0.1 + 0.07 * seed)
    assert raster.components(mask) == flood(mask)


@pytest.mark.parametrize("size", [1, 3, 5, 9, 31])
def test_morphology(size):
    mask = np.random.default_rng(size).random((23, 17)) < 0.08
    r = size // 2
    want = np.zeros_like(mask)
    for y, x in np.argwhere(mask):
        want[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1] = True
    assert (raster.dilated(mask, size) == want).all()
    assert (raster.closed(mask, size) >= mask).all() and (raster.opened(mask, size) <= mask).all()
    assert (raster.dilated(mask, size, True) <= want).all() and (raster.dilated(mask, size, True) >= mask).all()


def test_regions_of_a_mask(spark):
    mask = np.zeros((400, 600), np.uint8)
    for x in (50, 75, 100):
        mask[60:120, x : x + 15] = 255
    mask[300:340, 450:500] = 255
    mask[5, 590] = 255
    df = spark.createDataFrame([(1, 400, 600, mask.tobytes()), (2, 400, 600, b"x"), (3, 0, 0, None)], "page long, height int, width int, mask binary")
    got = raster.mask_regions(df).collect()
    assert [r["pos"] for r in got] == list(range(len(got))) and {r["page"] for r in got} == {1}
    blocks = [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in got]
    assert any(b[0] <= 50 and b[1] <= 60 and b[2] >= 115 and b[3] >= 120 for b in blocks)
    assert any(b[0] <= 450 and b[1] <= 300 and b[2] >= 500 and b[3] >= 340 for b in blocks) and len(blocks) == 2
    assert raster.mask_components(df).count() == 5


def test_joined_order_does_not_matter_but_for_places():
    rng = random.Random(3)
    for _ in range(60):
        boxes = [(x := rng.randrange(200), y := rng.randrange(200), x + rng.randrange(1, 30), y + rng.randrange(1, 30)) for _ in range(12)]
        want = sorted(raster.joined(boxes, 4))
        rng.shuffle(boxes)
        assert sorted(raster.joined(boxes, 4)) == want


def test_seeds_as_they_were_or_as_they_have_grown():
    chain = [(0, 0, 10, 10), (8, 0, 18, 10), (16, 0, 26, 10), (60, 0, 70, 10)]
    touch = lambda a, b: ordered.shared(a, b) > 0
    assert ordered.settled(chain, touch, True) == ordered.settled(chain, touch, False) == [(0, 0, 26, 10), (60, 0, 70, 10)]
    # Of equal boxes only those as they were match, so growth stops a merge.
    same = lambda a, b: a[2] - a[0] == b[2] - b[0] and ordered.gaps(a, b)[0] <= 2
    three = [(0, 0, 10, 10), (11, 0, 21, 10), (10, 0, 20, 5)]
    assert ordered.settled(three, same, False) == [(0, 0, 21, 10)]
    assert ordered.settled(three, same, True) == [(0, 0, 21, 10), (10, 0, 20, 5)]


def test_merges_by_page(spark):
    boxes = [(1, 0, 0, 0, 100, 100), (1, 1, 20, 20, 110, 110), (1, 2, 300, 300, 340, 340), (2, 5, 0, 0, 10, 10)]
    df = spark.createDataFrame(boxes, ordered.SCHEMA)
    assert rows(ordered.merged_regions(df, 1000, 1000)) == [(1, 0, 0, 0, 110, 110), (1, 1, 300, 300, 340, 340), (2, 0, 0, 0, 10, 10)]
    assert ordered.merged_phrases(df.limit(0), 9, 9).count() == 0
    assert rows(ordered.median_rows(df)) == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (2, 0, 0)]


def test_large_regions_are_taken_apart():
    mask = np.zeros((700, 700), bool)
    for x, y in ((50, 50), (80, 60), (500, 500), (530, 520)):
        mask[y : y + 12, x : x + 12] = True
    whole = (40, 40, 560, 560)
    assert raster.centre_clusters(mask, whole, 30, 2) == [(48, 48, 94, 74), (498, 498, 544, 534)]
    assert raster.parts(mask, whole, 30, 2, False) == raster.parts(mask, whole, 30, 2, True) == raster.centre_clusters(mask, whole, 30, 2)
    assert raster.centre_clusters(mask, (40, 40, 120, 120), 30, 2) == [] == raster.parts(mask, (200, 200, 300, 300), 30, 2, True)
    # Two blocks of equal size, then one that has most of the pixels.
    near = np.zeros((300, 300), bool)
    near[20:60, 20:60] = near[20:60, 120:160] = True
    assert raster.parts(near, (10, 10, 200, 100), 30, 2, False) == [(17, 17, 63, 63), (117, 17, 163, 63)]
    near[20:24, 120:160] = False
    near[28:60, 120:160] = False
    assert raster.parts(near, (10, 10, 200, 100), 30, 2, False) == []
    assert raster.viable(mask, (50, 50, 60, 60)) and not raster.viable(mask, (50, 50, 57, 60)) and not raster.viable(mask, (200, 200, 300, 300))


def test_masks_of_a_detector(spark):
    plane = np.zeros((1, 1, 512, 512), np.float32)
    plane[..., 128:256, 128:384] = 0.9
    got = raster.text_mask([np.zeros((1, 5, 7)), plane], 100, 200, 0.3)
    assert got.shape == (200, 100) and got[55:95, 30:70].all() and not got[:45].any() and not got[105:].any()
    assert raster.text_mask([np.full((4, 8), 255.0)], 16, 8, 0.3).all() and not raster.text_mask([np.zeros(3)], 4, 4, 0.3).any()
    image = np.zeros((10, 20, 3), np.uint8)
    image[..., 0] = 255
    blob = raster.model_input(image, 64)
    assert blob.shape == (1, 3, 64, 64) and (blob[0, 2] == 1).all() and not blob[0, :2].any()
    assert (raster.resized(np.arange(4.0)[None], 8, 1) == [[0, 0.25, 0.75, 1.25, 1.75, 2.25, 2.75, 3]]).all()
    df = spark.createDataFrame([(1, 200, 100, bytes(60_000)), (2, 1, 1, b"")], "page long, height int, width int, pixels binary")
    masks = raster.detected(df, lambda blob: [plane])
    assert [(r["page"], sum(r["mask"])) for r in masks.collect()] == [(1, int(got.sum()))] and raster.mask_regions(masks).count() == 1
