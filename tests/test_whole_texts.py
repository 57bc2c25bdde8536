import pytest

from pagewright import plans


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Conversations whose last words are what counts."""
    at = str(tmp_path_factory.mktemp("whole"))
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(180, 0, "user", f"{words} ■ end"), (180, 1, "user", f"{words} Bob-chan end"), (180, 2, "user", f"{words} {'w' * 4000}"), (180, 3, "user", "a b")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


def by_turn(spark, folder, name):
    return {r["idx"]: r for r in plans.queries()[name](spark, folder).collect()}


def test_sanitize_whole(spark, folder):
    got = by_turn(spark, folder, "sanitize_text")[0]["text"]
    assert "word39 end" in got and "■" not in got


def test_postprocess_whole(spark, folder):
    got = by_turn(spark, folder, "postprocess_text")
    assert "word39 Bob end" in got[1]["text"] and "word39" in got[0]["text"]


def test_fit_whole(spark, folder):
    got = by_turn(spark, folder, "fitted_text")
    assert got[2]["skip_reason"] == "no fitted lines"
    assert got[0]["skip_reason"] is None and got[0]["n_lines"] > 3
