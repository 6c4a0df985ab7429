import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_rows import KINDS, ROWS  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeats, ties and columns whose names operators use inside."""
    return spark.createDataFrame(ROWS, KINDS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], KINDS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
