import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import carbonate
from cellweave.operators import chemistry


@pytest.fixture(scope="module")
def water(spark):
    """Random sea water over the range of the model, one row per sample."""
    columns = {
        "alk": (1800.0, 2600.0), "dic": (1500.0, 2400.0), "salt": (28.0, 38.0),
        "temp": (-1.0, 32.0), "pressure": (0.0, 500.0), "po4": (0.0, 4.0), "sio3": (0.0, 150.0),
    }
    return spark.range(500).select(
        "id", *[(F.rand(i) * (b - a) + a).alias(n) for i, (n, (a, b)) in enumerate(columns.items())]
    )


def test_published_check_values():
    """Constants at S = 35 and 25 degrees from the literature cited in the module."""
    eq = carbonate.Equilibrium(*[np.array([v]) for v in (35.0, 25.0, 0.0, 0.0, 0.0)])
    assert np.log(eq.k0)[0] == pytest.approx(-3.5617, abs=1e-4)
    assert np.log(eq.kb)[0] == pytest.approx(-19.7964, abs=1e-4)
    assert np.log(eq.ks)[0] == pytest.approx(-2.2996, abs=1e-3)
    scale = -np.log10(eq._to_total(eq.ks, eq.kf))[0]
    assert -np.log10(eq.k1)[0] - scale == pytest.approx(5.8401, abs=1e-4)
    assert -np.log10(eq.k2)[0] - scale == pytest.approx(8.9636, abs=1e-4)


def test_round_trip(water):
    found = water.withColumn("pco2", chemistry.pco2("alk", "dic")).withColumn(
        "again", chemistry.dic("alk", "pco2")
    )
    worst = found.agg(F.max(F.abs(F.col("again") / F.col("dic") - 1))).first()[0]
    assert worst < 1e-9
    assert found.filter("pco2 IS NULL OR pco2 <= 0").count() == 0


def test_against_bisection(water):
    """The batch iteration against 80 plain halvings of one sample after another."""
    found = water.withColumn("pco2", chemistry.pco2("alk", "dic")).limit(60).collect()
    for r in found:
        kg = {n: r[n] * 1e-6 / 1.02518 for n in ("alk", "dic", "po4", "sio3")}
        eq = carbonate.Equilibrium(r["salt"], r["temp"], r["pressure"], kg["po4"], kg["sio3"])
        low, high = -32.0, -4.0
        for _ in range(80):
            mid = (low + high) / 2
            h = np.exp(mid)
            pool = h * h + eq.k1 * h + eq.k1 * eq.k2
            total = kg["dic"] * (eq.k1 * h + 2 * eq.k1 * eq.k2) / pool
            total += eq.minor_alkalinity(h)[0]
            low, high = (mid, high) if total > kg["alk"] else (low, mid)
        h = np.exp((low + high) / 2)
        co2 = kg["dic"] * h * h / (h * h + eq.k1 * h + eq.k1 * eq.k2)
        assert r["pco2"] == pytest.approx(co2 / eq.k0 / eq.fugacity * 1e6, rel=1e-9)


def test_added_alkalinity_lowers_pco2_and_raises_dic(water):
    found = water.select(
        "dic",
        chemistry.pco2("alk", "dic").alias("p"),
        chemistry.pco2(F.col("alk") + 10.0, "dic").alias("p10"),
        "alk", "salt", "temp", "pressure", "po4", "sio3",
    ).withColumn("d10", chemistry.dic(F.col("alk") + 10.0, "p"))
    assert found.filter("p10 >= p OR d10 <= dic").count() == 0


@pytest.mark.parametrize("name", ["alk", "dic", "salt", "temp", "pressure", "po4", "sio3"])
def test_missing_input_gives_missing_result(water, name):
    holed = water.withColumn(name, F.when(F.col("id") % 2 == 0, F.col(name)))
    found = holed.withColumn("pco2", chemistry.pco2("alk", "dic"))
    assert found.count() == 500
    assert found.filter((F.col("id") % 2 == 0) != F.col("pco2").isNotNull()).count() == 0


def test_extreme_water_converges(spark):
    data = [(500.0, 480.0, 5.0), (3000.0, 1000.0, 35.0), (1000.0, 3000.0, 35.0), (50.0, 3000.0, 35.0)]
    df = spark.createDataFrame(data, "alk double, dic double, salt double").withColumns(
        {"temp": F.lit(10.0), "pressure": F.lit(0.0), "po4": F.lit(1.0), "sio3": F.lit(10.0)}
    )
    found = df.withColumn("p", chemistry.pco2("alk", "dic")).withColumn(
        "again", chemistry.dic("alk", "p")
    )
    assert found.filter("abs(again / dic - 1) > 1e-9 OR again IS NULL").count() == 0


def test_removal_potential(spark):
    state = "salt double, temp double, po4 double, sio3 double, pressure double"
    sea = (34.0, 15.0, 1.0, 10.0, 0.0)
    control = spark.createDataFrame(
        [(1, 2200.0, 2000.0, *sea), (2, 2200.0, 2000.0, *sea)],
        "cell int, alk double, dic double, " + state,
    )
    treated = spark.createDataFrame(
        [("a", 1, 2200.0, *sea), ("b", 1, 2250.0, *sea), ("a", 3, 2200.0, *sea)],
        "phase string, cell int, alk double, " + state,
    )
    found = chemistry.removal_potential(control, treated, ["cell"])
    got = {r["phase"]: r for r in found.collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["ddic"] == pytest.approx(0.0, abs=1e-6)
    assert 30.0 < got["b"]["ddic"] < 50.0


def test_result_does_not_depend_on_the_batch():
    rng = np.random.default_rng(3)
    n = 400
    water = [rng.uniform(30, 37, n), rng.uniform(0, 30, n), np.zeros(n), np.full(n, 5e-7), np.full(n, 1e-5)]
    alk, dic = rng.uniform(2.0e-3, 2.5e-3, n), rng.uniform(1.7e-3, 2.2e-3, n)
    whole = carbonate.pco2_from_dic(alk, dic, *water)
    alone = [carbonate.pco2_from_dic(alk[i : i + 1], dic[i : i + 1], *[w[i : i + 1] for w in water])[0] for i in range(n)]
    assert np.array_equal(whole, alone)
    assert all(np.isfinite(whole))


def test_unconverged_is_missing(monkeypatch):
    one = [np.array([v]) for v in (2.3e-3, 2.0e-3, 35.0, 20.0, 0.0, 5e-7, 1e-5)]
    monkeypatch.setattr(carbonate, "NEWTON_STEPS", 1)
    assert np.isnan(carbonate.pco2_from_dic(*one)[0])
