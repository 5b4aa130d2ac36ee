import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""
    long = "alpha beta gamma delta " * 30000
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, "   \n\t ", "en", "a", 6),
        (4, long, "en", "a", len(long)),
        (5, "one two three", "en", "b", 13),
        (5, "one two three", "en", "b", 13),
        (6, "one two three", None, "b", 13),
        (None, "four five six seven eight", "en", None, 25),
        (7, "\ue000 password: abcdefgh12 \ue001\ue002 é 😀 token=\"zzzzzzzz\"", "en", "c", 50),
    ]
    names = ("size", "target", "score", "rank", "sid", "block", "uid", "spans", "id", "u", "v", "a", "piece", "label")
    schema = DOCS + "".join(f", {n} string" for n in names)
    return spark.createDataFrame([r + ("x",) * len(names) for r in rows], schema)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)
