import json

import numpy as np
import pytest

from pagewright.operators import pages, replies, surface
from pagewright.settings import Settings
from pagewright.sources import files

WHITE = np.full((60, 80, 3), 250, np.uint8)


def lettered(ground, ink):
    crop, mask = ground.copy(), np.zeros(ground.shape[:2], np.uint8)
    mask[20:40, 20:60:6] = mask[20:40, 21:60:6] = 255
    crop[mask > 0] = ink
    return crop, mask


def test_threshold_against_all_splits():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(10, 60, 300), rng.integers(150, 220, 200)]).astype(np.uint8)

    def between(t):
        low, high = values[values <= t], values[values > t]
        return len(low) * len(high) * (low.mean() - high.mean()) ** 2 if len(low) and len(high) else -1

    assert surface.otsu(values) == max(range(256), key=lambda t: (round(between(t), 6), -t))


def test_colours_of_text():
    crop, mask = lettered(WHITE, (20, 30, 220))
    assert surface.text_colour(crop, mask) == surface.text_colour(crop) == (220, 30, 20)
    grey, mask = lettered(WHITE, (10, 10, 10))
    assert surface.text_colour(grey, mask) is None and surface.text_colour(grey[:5]) is None
    assert surface.outline_colour((220, 30, 20)) == (255, 255, 255) and surface.outline_colour((250, 250, 90)) == (0, 0, 0)


def test_erasing_leaves_paper():
    crop, mask = lettered(WHITE, (0, 0, 0))
    assert (surface.erase_mask(crop, mask)[mask > 0]).all() and (surface.erased(crop, mask) == 250).all()
    assert (surface.erase_mask(crop)[mask > 0]).all()
    art, mask = lettered(np.full((60, 80, 3), (90, 30, 120), np.uint8), (255, 255, 255))
    assert surface.paper_fill(art, mask > 0) is None and (surface.erased(art, mask) == (90, 30, 120)).all()
    assert not surface.erase_mask(WHITE, np.zeros((60, 80), np.uint8)).any()


def test_drawing_over_others():
    drawn = WHITE.copy()
    drawn[:20, :20] = 0
    taken = np.zeros((60, 80), np.uint8)
    assert not surface.collides(drawn, WHITE, taken) and not surface.collides(WHITE, WHITE, taken)
    taken[:10, :10] = 1
    assert surface.collides(drawn, WHITE, taken)
    back = surface.restored(drawn, WHITE, (-5, -5, 10, 10), None)
    assert (back[:10, :10] == 250).all() and (back[10:20, 10:20] == 0).all()


def test_masks_in_contexts():
    mask = np.ones((4, 6), np.uint8)
    got = surface.projected(mask, (10, 20, 16, 24), (8, 18, 20, 30))
    assert got.shape == (12, 12) and got[2:6, 2:8].all() and got.sum() == 24
    assert surface.projected(mask, (10, 20, 16, 24), (11, 18, 20, 30)) is None and surface.projected(None, (0, 0, 1, 1), (0, 0, 2, 2)) is None


def test_crops_described(spark):
    crop, _ = lettered(WHITE, (20, 30, 220))
    rows = [(1, 60, 80, crop.tobytes()), (2, 60, 80, b"x"), (3, None, None, None)]
    got = surface.described(spark.createDataFrame(rows, "page long, height int, width int, pixels binary")).collect()
    assert [(r["page"], r["paper"], r["balloon"], r["colour"]) for r in got] == [(1, True, True, [220, 30, 20])] and got[0]["n_erased"] > 0


@pytest.mark.parametrize(
    ("content", "want"),
    [("a", "a"), ([" a ", {"text": "b"}, {"text": " ", "output_text": "c"}, {"content": 5}, 7, ""], "a\nb\nc"), (None, ""), (3, ""), ({"text": "x"}, "")],
)
def test_message_text(spark, content, want):
    df = spark.createDataFrame([(json.dumps(content),)], "c string")
    assert df.select(replies.message_text(df.c)).first()[0] == want


def test_tries_and_waits(spark, tmp_path):
    log = tmp_path / "log"

    def client(prompts):
        with open(log, "a") as f:
            f.write("x")
        return [None] * len(prompts)

    df = spark.createDataFrame([("a",)], "prompt string").coalesce(1)
    assert replies.asked(df, client, waits=(0.01, 0.01), slots=1).first()["reply"] is None and log.read_text() == "xxx"


def test_pages_fail_alone(spark):
    def work(row):
        if row["page"] == 2:
            raise ValueError("bad")
        return b"ok"

    done = pages.attempted(spark.createDataFrame([(1,), (2,), (3,)], "page long"), work)
    assert sorted((r["page"], r["result"], r["error"]) for r in done.collect()) == [(1, b"ok", None), (2, None, "ValueError: bad"), (3, b"ok", None)]
    assert tuple(pages.run_summary(done).first()) == (3, 2, 1, None)
    assert tuple(pages.run_summary(done.where("page = 2")).first()) == (1, 0, 1, "ValueError: bad")
    assert tuple(pages.run_summary(done.limit(0)).first()) == (0, 0, 0, None)


def test_files_numbered_and_removed(spark, tmp_path):
    for k in range(23):
        (tmp_path / f"p{k:02}.png").write_bytes(bytes([k]))
    (tmp_path / "note.txt").write_bytes(b"x")
    got = {r["page_id"]: r["pos"] for r in files.folder(spark, str(tmp_path)).collect()}
    assert got == {f"p{k:02}.png": k + 1 for k in range(23)}
    assert files.removed(spark, str(tmp_path)) == (24, 0) and files.removed(spark, str(tmp_path / "none")) == (0, 0)


def test_settings():
    env = {"BASE_URL": "u", "API_KEY": "k", "MODEL": "m", "LOCAL_MAX_PARALLEL_PAGES": "5", "TRANSLATION_MAX_CONCURRENT_CALLS": "-1", "MODAL_MAX_PARALLEL_PAGES": "x", "USE_MODAL": " Yes "}
    s = Settings.load(env)
    assert (s.local_pages, s.calls, s.remote_pages, s.remote, s.pages) == (5, 3, 2, True, 2)
    s.check()
    assert s.with_model("n").model == "n" and s.model == "m"
    with pytest.raises(ValueError, match="API_KEY"):
        Settings.load(env | {"API_KEY": " "}).check()
