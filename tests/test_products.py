"""Every registered product against its reference SQL, and the shape of its plan."""

import os

import duckdb
import pandas as pd
import pytest
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries
from cellweave.plans.catalog import PRODUCTS

SQL = oracle_sql()
QUERIES = {name: query for name, query in queries().items() if name in PRODUCTS}


def connect(folder):
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{folder}/{file}'")
    return con


def tidy(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(spark, name, folder, con):
    found = tidy(QUERIES[name](spark, folder).toPandas())
    expected = tidy(con.execute(SQL[name]).df())
    pd.testing.assert_frame_equal(found, expected, check_dtype=False, rtol=1e-6, atol=1e-9)
    return found


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_product_has_reference_sql():
    assert set(QUERIES) == set(PRODUCTS) <= set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_product(spark, con, name):
    assert_same(spark, name, SMALL, con)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.fixture
def no_broadcast(spark):
    """Plans as they would be for tables far above the broadcast threshold."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, value in before.items():
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_pairwise_join(spark, no_broadcast, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin"):
        assert node not in plan


def plan_of(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(spark, "regional_wind")
    assert "ReadSchema: struct<l_suppkey:bigint,l_tax:double,l_shipdate:timestamp_ntz>" in plan


def test_surface_filter_reaches_the_scan(spark):
    plan = plan_of(spark, "control_carbonate_proxy")
    assert "EqualTo(l_linenumber,1)" in plan and "EqualTo(l_linestatus,F)" in plan


def test_pairing_reads_the_runs_once(spark):
    plan = plan_of(spark, "column_integral_full")
    assert plan.count("FileScan parquet") == 1
    assert "SortMergeJoin" not in plan


def test_month_numbers_do_not_sort_the_cells(spark):
    plan = plan_of(spark, "maximum_mixing_depth")
    assert "Window" not in plan and "Subquery" in plan


@pytest.mark.parametrize("name", sorted(PRODUCTS))
def test_no_job_while_a_plan_is_built(spark, monkeypatch, name):
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(*_, **__):
        raise AssertionError("a job while the plan is built")

    for action in ("collect", "count", "first", "head", "take", "toArrow", "toPandas", "toLocalIterator", "isEmpty", "checkpoint"):
        monkeypatch.setattr(DataFrame, action, refuse)
    PRODUCTS[name](spark, SMALL)


def test_strict_means_take_both_branches(spark):
    rows = QUERIES["surface_drivers_weighted"](spark, "/root/testdata/sf0.01").collect()
    missing = sum(r.ddpco2_wmean is None for r in rows)
    assert 0 < missing < len(rows)


def test_driver_correlations_per_region(spark):
    rows = QUERIES["driver_correlations"](spark, SMALL).collect()
    assert {r.region for r in rows} == {"Local", "CCS", "NE Pacific"}


def test_no_full_outer_join_where_an_inner_one_is_meant(spark):
    for name in ("removal_potential_cells", "removal_potential_total", "cumulative_surface_alkalinity"):
        assert "FullOuter" not in plan_of(spark, name)
    assert plan_of(spark, "cumulative_surface_alkalinity").count("FileScan") == 1


def test_perturbation_is_one_arrow_call(spark):
    plan = plan_of(spark, "alkalinity_perturbation")
    assert plan.count("ArrowEvalPython") == 1 and plan.count("_response(") <= 2
