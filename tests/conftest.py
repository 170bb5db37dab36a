import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rolegrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, shuffle_partitions=4, app="rolegrid-tests")


@pytest.fixture
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def value(spark):
    """Value of one Column expression."""

    def get(col):
        return spark.range(1).select(col.alias("v")).collect()[0]["v"]

    return get
