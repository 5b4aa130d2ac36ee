import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cellweave.functions.exact import exact_mean, exact_sum


def result(df, *columns):
    return tuple(df.agg(*columns).first())


def test_same_bits_in_any_order(spark):
    r = random.Random(2)
    values = [r.uniform(-1, 1) * 10.0 ** r.randint(-6, 9) for _ in range(5000)]
    found = set()
    plain = set()
    for seed in range(4):
        random.Random(seed).shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(seed + 2)
        found.add(result(df, exact_sum("x"), exact_mean("x")))
        plain.add(result(df, F.sum("x")))
    assert len(found) == 1 < len(plain)
    total, mean = found.pop()
    assert total == pytest.approx(math.fsum(values), rel=1e-15) and mean == pytest.approx(total / 5000, rel=1e-15)


@pytest.mark.parametrize("values", [[1e15, 0.1, -1e15], [0.1] * 10, [-0.5, -0.25, 3.0], [2.0**-60, 2.0**-60], [-(2.0**-53)] * 3, [0.0, -0.0]])
def test_sums_are_right(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    exact = float(sum(Fraction(v) for v in values))
    total, mean = result(df, exact_sum("x"), exact_mean("x"))
    assert total == pytest.approx(exact, rel=1e-15, abs=1e-18) and mean == pytest.approx(exact / len(values), rel=1e-15, abs=1e-18)


def test_nothing_to_sum(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert result(df, exact_sum("x"), exact_mean("x")) == (None, None)
    assert result(df.filter("false"), exact_sum("x"), exact_mean("x")) == (None, None)
    assert df.filter("false").groupBy("x").agg(exact_sum("x")).count() == 0
