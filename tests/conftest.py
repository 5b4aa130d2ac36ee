import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cellweave.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    return session


def rows(df, *order):
    """Rows as plain tuples in a fixed order."""
    return [tuple(r) for r in df.orderBy(*order).collect()]


def one(spark, column):
    """Value of an expression on a single row."""
    return spark.range(1).select(column.alias("v")).first()["v"]
