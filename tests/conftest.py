import logging
import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from newsloom.session import build

    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    return build("local[8]", 4, "8g")


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate column expressions over one row of named values."""

    def run(expression, schema="v string", *values):
        row = spark.createDataFrame([values or (None,)], schema)
        return row.select(expression.alias("x")).first()["x"]

    return run
