"""Results stay whole when one key holds a third of the rows."""

import duckdb
import pytest
from conftest import SMALL
from test_products import assert_same, connect

AFFECTED = (
    "scenario_difference_native",
    "column_integral_full",
    "ensemble_series",
    "depth_time_means",
    "surface_cell_means",
    "driver_table",
    "surface_drivers_weighted",
    "weighted_mixing_depth",
    "maximum_mixing_depth",
    "subducted_under_current",
    "cumulative_uptake",
    "metric_correlation",
    "anomaly_series",
    "removal_potential_cells",
)


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """The small tables with a third of the lines in one cell, layer, run, month and order."""
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT CASE WHEN hot THEN 7 ELSE l_orderkey END AS l_orderkey,
        l_partkey, CASE WHEN hot THEN 3 ELSE l_suppkey END AS l_suppkey,
        CASE WHEN hot THEN 1 ELSE l_linenumber END::INTEGER AS l_linenumber, l_quantity,
        l_extendedprice, l_discount, l_tax,
        CASE WHEN hot THEN 'N' ELSE l_returnflag END AS l_returnflag, l_linestatus,
        CASE WHEN hot THEN TIMESTAMP '1996-03-05' ELSE l_shipdate END AS l_shipdate
        FROM (SELECT *, hash(l_orderkey, l_partkey, l_suppkey) % 3 = 0 AS hot
              FROM '{SMALL}/lineitem.parquet')) TO '{folder}/lineitem.parquet'""")
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN '1-URGENT'
        ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN
        TIMESTAMP '1997-05-28' ELSE o_orderdate END AS o_orderdate)
        FROM '{SMALL}/orders.parquet') TO '{folder}/orders.parquet'""")
    for name in ("supplier", "customer", "embeddings"):
        con.execute(f"COPY (FROM '{SMALL}/{name}.parquet') TO '{folder}/{name}.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", AFFECTED)
def test_product_on_skewed_tables(spark, skewed, name):
    found = assert_same(spark, name, skewed, connect(skewed))
    assert len(found) > 0
