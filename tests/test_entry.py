import __spark_entry__ as entry
from pagewright import plans


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.queries()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["page", "pos", "place"] and df.count() > 0
