import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from qassay.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("4", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Values of an expression over one text column x."""

    def run(values, expression, schema="x string"):
        rows = [(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, {schema}")
        return [r[0] for r in df.orderBy("i").select(expression).collect()]

    return run
