import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from custodia.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """A table from tuples: rows("a int, b string", (1, "x"), ...)."""

    def make(schema, *values):
        return spark.createDataFrame(list(values), schema)

    return make
