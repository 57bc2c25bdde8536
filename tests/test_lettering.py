import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.operators import lettering as x


def test_division():
    assert x.divided("attention!") == ["atten", "tion!"]
    assert x.divided("short") == ["short"]
    assert x.divided("strengths.") == ["str", "engths."]
    assert "".join(x.divided("Extraordinarily")) == "Extraordinarily"


@settings(max_examples=200, deadline=None)
@given(st.text("abcdefgh tion.,!\n", max_size=60), st.integers(1, 30))
def test_wrapping_keeps_all_and_fits(text, most):
    lines = x.wrapped(text, most, len)
    words = text.replace("\n", " ").split()
    if any(len(w) > most for w in words):
        assert lines == []
    else:
        assert " ".join(lines).split() == words and all(len(line) <= most for line in lines)
    cut = x.wrapped(text, most, len, characters=True)
    assert "".join("".join(cut).split()) == "".join(words)


@pytest.mark.parametrize(("text", "w", "h", "style"), [("Hello there friend", 120, 90, "dialogue"), ("BOOM", 60, 60, "sfx"), ("A somewhat longer line of words to be set here", 200, 160, "dialogue")])
def test_no_larger_size_fits(text, w, h, style):
    size, lines = x.fitted(text, w, h, style)
    slack = style != "sfx"
    fits = [s for s in range(6 if style == "sfx" else 10, x.most_size(len(text.split()), w, h, style) + 1) if (a := x.layout(text, s, w + slack, style))[0] and a[1] <= w + slack and a[2] <= h]
    assert size in fits and " ".join(lines) == text


def test_fit(spark):
    units = [(1, 0, "Hello you", "dialogue", 100, 60), (1, 1, " ", "dialogue", 50, 50), (1, 2, "Impossible", "dialogue", 5, 5), (1, 3, "x", "sfx", 0, 9), (1, 4, None, None, None, None)]
    df = spark.createDataFrame(units, "page long, idx long, text string, style string, w int, h int")
    got = {r["idx"]: r for r in x.fit(df).collect()}
    assert [got[i]["skip_reason"] for i in range(5)] == [None, "blank text", "no fitted lines", "no available text area", "blank text"]
    assert got[0]["size"] >= 10 and got[0]["lines"]


def test_sizes(spark):
    df = spark.createDataFrame([(0, 200, 200, 190, 190), (1, 150, 150, 140, 120), (2, 40, 100, 39, 99), (3, 120, 100, 100, 80)], "i int, bw int, bh int, w int, h int")
    got = df.select("i", x.least_size(F.col("bw"), F.col("bh"), F.col("w"), F.col("h"), F.lit(True)), x.outline(F.col("w")), x.spacing(F.col("w"), F.lit("sfx"))).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(0, 15, 15, 22), (1, 14, 11, 16), (2, 12, 3, 4), (3, 13, 8, 12)]
    style = df.select(x.drawn_style(F.lit("Wham"), F.col("w"), F.col("h"))).distinct().collect()
    assert [r[0] for r in style] == ["sfx"]
