import io
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright.operators import replies as a
from pagewright.sources import files

PARSED = [
    ("Sure!\n[1] A\nB\n[3] C\n2) D\n[9] Z", 3, {1: "A B", 2: "D [9] Z", 3: "C"}),
    ("A\nB", 1, {1: "A"}),
    ("[1]\ntext", 1, {1: "text"}),
    ("[1] A\n[1] B", 1, {1: "B"}),
    ("[1]: - A", 1, {1: "- A"}),
    ("7. x\ny", 2, {1: "7. x", 2: "y"}),
    ("", 2, {}),
]


def test_parse(spark):
    df = spark.createDataFrame([(i, x, n) for i, (x, n, _) in enumerate(PARSED)], "i int, reply string, n int")
    got = [r[1] for r in df.select("i", a.parsed(F.col("reply"), F.col("n"))).orderBy("i").collect()]
    assert got == [x[2] for x in PARSED]


def test_numbers_are_dense_over_texts(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", " ", "b", "", "c"])], "page int, idx int, text string")
    got = a.prompts(a.numbered(df, 3)).orderBy("batch").collect()
    assert [(r["batch"], r["expected"], r["prompt"]) for r in got] == [(0, 2, "[1] a\n[2] b"), (1, 1, "[1] c")]


def test_cascade(spark):
    def client(prompts):
        out = []
        for p in prompts:
            if "dead" in p:
                out.append(None)
            elif p == "[1] まってよ":  # alone or in repair it works
                out.append("[1] Hold on")
            else:
                out.append("\n".join(f"{x.split(' ')[0]} {'...' if 'まってよ' in x else 'Fine'}" for x in p.split("\n") if "gone" not in x))
        return out

    units = [(1, 0, "おはよう"), (1, 1, ""), (1, 2, "まってよ"), (1, 3, "gone"), (2, 0, "dead"), (2, 1, " x ")]
    got = {(r["page"], r["idx"]): r["target"] for r in a.translated(spark.createDataFrame(units, "page int, idx int, text string"), client).collect()}
    assert got == {(1, 0): "Fine", (1, 1): "", (1, 2): "Hold on", (1, 3): "gone", (2, 0): "dead", (2, 1): " x "}


@pytest.fixture
def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.png", b"1")
        z.writestr("d/b.txt", b"2")
        z.writestr("../up.png", b"3")
    return out.getvalue()


def test_archives(spark, archive):
    got = files.members(spark.createDataFrame([("x.zip", archive), ("y.zip", b"no"), ("z.zip", None)], "path string, content binary")).collect()
    assert sorted((r["path"], r["name"] or "", bytes(r["content"] or b""), r["error"] or "") for r in got) == [
        ("x.zip", "../up.png", b"", "name leads outside"), ("x.zip", "a.png", b"1", ""), ("x.zip", "d/b.txt", b"2", ""), ("y.zip", "", b"", "not an archive"), ("z.zip", "", b"", "not an archive"),
    ]
    back = files.archived(spark.createDataFrame([("f", "b.png", b"2"), ("f", "a.png", b"1")], "folder string, name string, content binary")).first()
    with zipfile.ZipFile(io.BytesIO(back["content"])) as z:
        assert z.namelist() == ["a.png", "b.png"] and z.read("b.png") == b"2"


def test_folder_and_stream(spark, tmp_path):
    for n in ("b.PNG", "a.jpg", "c.tif", "d.txt"):
        (tmp_path / n).write_bytes(b"x" * 3)
    got = files.folder(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["page_id"], r["pos"], r["length"]) for r in got] == [("a.jpg", 1, 3), ("b.PNG", 2, 3)]
    assert files.exists(spark, str(tmp_path)) and not files.exists(spark, str(tmp_path / "none"))
    from pagewright.streaming import arrivals

    q = arrivals.counted(arrivals.arrivals(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination()
    assert tuple(spark.sql("select sum(files), sum(bytes) from arrived").first()) == (2, 6)
