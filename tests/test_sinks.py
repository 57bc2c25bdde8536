import struct
import zlib

import numpy as np
import pytest

from pagewright.sources import files, png, sink


def picture(h=13, w=17):
    return np.random.default_rng(5).integers(0, 256, (h, w, 3), dtype=np.uint8)


def stored(rows, colour, kinds):
    """A PNG with rows stored by the given filters, worked out byte by byte."""
    size = png.DEPTH[colour]
    raw = b""
    for y, row in enumerate(rows):
        flat, above = row.ravel().tolist(), rows[y - 1].ravel().tolist() if y else [0] * row.size
        raw += bytes([kinds[y % len(kinds)]])
        for k, x in enumerate(flat):
            a, b, c = flat[k - size] if k >= size else 0, above[k], above[k - size] if k >= size else 0
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            raw += bytes([(x - [0, a, b, (a + b) // 2, near][kinds[y % len(kinds)]]) % 256])
    head = struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 8, colour, 0, 0, 0)
    data = zlib.compress(raw)
    return png.SIGNATURE + png.chunk(b"IHDR", head) + png.chunk(b"IDAT", data[:9]) + png.chunk(b"IDAT", data[9:]) + png.chunk(b"IEND", b"")


def test_png_there_and_back():
    image = picture()
    assert (png.decode(png.encode(image)) == image).all() and (png.decode(png.encode(image[..., 0])) == image[..., :1]).all()
    for colour, size in png.DEPTH.items():
        rows = np.random.default_rng(colour).integers(0, 256, (11, 7, size), dtype=np.uint8)
        got = png.decode(stored(rows, colour, (0, 1, 2, 3, 4)))
        assert (got == (rows[..., 2::-1] if size > 2 else rows[..., :1])).all()


def test_png_broken():
    good = png.encode(picture())
    for bad in (b"", b"GIF89a", good[:40], good[:-12], good.replace(b"IDAT", b"IDAx"), good[:-4] + b"abcd", png.SIGNATURE):
        with pytest.raises(ValueError):
            png.decode(bad)
    deep = png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 16, 0, 0, 0, 0)) + png.chunk(b"IEND", b"")
    huge = png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 1 << 20, 1 << 20, 8, 0, 0, 0, 0)) + png.chunk(b"IEND", b"")
    short = png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 9, 8, 0, 0, 0, 0)) + png.chunk(b"IDAT", zlib.compress(b"abc")) + png.chunk(b"IEND", b"")
    for bad in (deep, huge, short):
        with pytest.raises(ValueError):
            png.decode(bad)


def test_pages_read_drawn_and_written(spark, tmp_path):
    image = picture()
    rows = [(f"ch1/p{k}.png", 17, 13, image.tobytes()) for k in range(5)]
    images = spark.createDataFrame(rows, "name string, width int, height int, pixels binary")
    out = tmp_path / "out"
    assert sink.written(png.encoded(images), str(out)) == 5
    assert sorted(p.name for p in (out / "ch1").iterdir()) == [f"p{k}.png" for k in range(5)]
    back = png.decoded(files.folder(spark, str(out / "ch1"))).collect()
    assert len(back) == 5 and all((r["width"], r["height"], bytes(r["pixels"]), r["error"]) == (17, 13, image.tobytes(), None) for r in back)
    # A file of the same name is replaced, others stay.
    assert sink.written(spark.createDataFrame([("ch1/p0.png", b"GIF"), ("ch1/p9.png", b"")], "name string, content binary"), out.as_uri()) == 2
    assert (out / "ch1" / "p0.png").read_bytes() == b"GIF" and (out / "ch1" / "p9.png").read_bytes() == b"" and len(list((out / "ch1").iterdir())) == 6
    # The file of no bytes is no row.
    again = png.decoded(files.folder(spark, str(out / "ch1")))
    errors = again.where("error is not null").collect()
    assert again.count() == 5
    assert [(r["path"][-6:], r["pixels"], r["error"]) for r in errors] == [("p0.png", None, "ValueError: not a PNG file")]


@pytest.mark.parametrize("rows", [[("a", b"1"), ("a", b"1")], [("../a", b"1")], [("/a", b"1")], [("b/../../a", b"1")], [("c:a", b"1")], [("", b"1")], [("a/", b"1")], [(None, b"1")], [("a", None)]])
def test_nothing_written_of_bad_files(spark, tmp_path, rows):
    with pytest.raises(ValueError):
        sink.written(spark.createDataFrame([*rows, ("good", b"1")], "name string, content binary"), str(tmp_path))
    assert not list(tmp_path.iterdir())


def test_empty_tables_and_overwrite(spark, tmp_path):
    none = spark.createDataFrame([], "name string, content binary, size string")
    assert sink.written(none, str(tmp_path)) == 0 and not list(tmp_path.iterdir())
    assert png.decoded(none.withColumnRenamed("name", "path")).count() == 0
    spark.dataSource.register(sink.Folder)
    with pytest.raises(Exception, match="not emptied"):
        none.drop("size").write.format(sink.FORMAT).mode("overwrite").option("path", str(tmp_path)).save()
