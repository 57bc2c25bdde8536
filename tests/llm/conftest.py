import pytest
from samples import frame, texts


@pytest.fixture(scope="session")
def values():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, values):
    return frame(spark, values, [3 * i + 1 for i in range(len(values))])


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def repeated(spark):
    """Repeated rows, a null key, and a key with two texts."""
    t = texts()
    return frame(spark, [t[0], t[0], t[1], t[2], t[2], None, t[3]], [1, 1, 2, None, 4, 5, 2])
