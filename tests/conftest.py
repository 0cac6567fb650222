import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from folioforge.session import local_session

    s = local_session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows(spark):
    """Rows of one expression over a table of tuples."""

    def run(data, schema, *cols):
        return [tuple(r) for r in spark.createDataFrame(data, schema).select(*cols).collect()]

    return run
