import datetime as dt

import numpy as np
import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from cellweave.operators.integrate import row_of_maximum
from cellweave.operators.lookup import attach_ordinal
from cellweave.sources import chunks as c
from cellweave.sources import tables as t
from cellweave.sources.tables import read_files, read_matching, read_partitions, write_table

DIMS = ("time", "eta", "xi")


@pytest.fixture(scope="module")
def grid():
    """A 5 x 4 x 3 array, cut along time into chunks of two steps."""
    return np.arange(60, dtype=float).reshape(5, 4, 3)


@pytest.fixture(scope="module")
def chunks(spark, grid):
    data = []
    for var, array in (("alk", grid), ("dic", grid * 10)):
        for start in (0, 2, 4):
            block = array[start : start + 2]
            data.append(
                ("f", var, list(DIMS), [start, 0, 0], list(block.shape), block.ravel().tolist())
            )
    data.append(("f", "area", ["eta", "xi"], [0, 0], [4, 3], [1.0] * 12))
    return spark.createDataFrame(data, c.SCHEMA)


def test_grid_is_chosen_by_its_dimensions(chunks):
    assert c.select_grid(chunks, ["eta", "xi"]).count() == 1
    assert c.select_grid(chunks, DIMS).count() == 6
    assert c.select_grid(chunks, DIMS, ["alk"]).count() == 3


def test_rows_match_the_array(chunks, grid):
    found = c.chunk_rows(c.select_grid(chunks, DIMS, ["alk"]), DIMS)
    assert found.count() == 60
    for r in found.collect():
        assert grid[r["time"], r["eta"], r["xi"]] == r["value"]


@pytest.mark.parametrize(
    "slab",
    [
        {"time": (1, 3), "eta": (1, 2), "xi": (0, 2)},
        {"eta": (3, 1)},
        {"time": (4, 10)},
        {"time": (0, 1), "xi": (2, 1)},
    ],
)
def test_hyperslab_matches_array_slicing(chunks, grid, slab):
    found = c.hyperslab(c.select_grid(chunks, DIMS, ["alk"]), DIMS, slab)
    cut = tuple(slice(slab[d][0], sum(slab[d])) if d in slab else slice(None) for d in DIMS)
    expected = {
        (int(a), int(b), int(d)): v
        for (a, b, d), v in np.ndenumerate(grid)
        if all(
            not isinstance(s, slice) or s.start is None or s.start <= i < s.stop
            for i, s in zip((a, b, d), cut)
        )
    }
    assert {(r["time"], r["eta"], r["xi"]): r["value"] for r in found.collect()} == expected


def test_variables_side_by_side(chunks):
    found = c.variables_as_columns(chunks, DIMS, ["alk", "dic"])
    assert found.count() == 60
    assert found.filter("dic <> alk * 10").count() == 0


def test_coordinates(spark, chunks):
    axis = spark.createDataFrame([(i, 30 + i / 8) for i in range(4)], "idx int, coord double")
    found = c.with_coordinates(
        c.chunk_rows(c.select_grid(chunks, DIMS, ["alk"]), DIMS), {"eta": (axis, "lat")}
    )
    assert "eta" not in found.columns
    assert rows(found.groupBy("lat").count(), "lat") == [
        (30.0, 15), (30.125, 15), (30.25, 15), (30.375, 15),
    ]


def test_partitioned_layout_is_pruned(spark, tmp_path):
    df = spark.createDataFrame(
        [(y, p, float(y)) for y in (1999, 2000, 2001) for p in ("a", "b")],
        "year int, location string, x double",
    )
    path = str(tmp_path / "runs")
    t.write_table(df, path, ["year", "location"], ["x"])
    found = t.read_partitions(spark, path, [1999, 2001], ["b"])
    assert rows(found.select("year", "x"), "year") == [(1999, 1999.0), (2001, 2001.0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "year#" in filters and "location#" in filters
    read = [r[0] for r in found.select(F.input_file_name()).distinct().collect()]
    assert len(read) == 2 and all("location=b" in f and "year=2000" not in f for f in read)


def test_files_by_list_and_by_name(spark):
    listed = t.read_files(
        spark, [f"{SMALL}/region.parquet", f"{SMALL}/region.parquet"], provenance="path"
    )
    assert listed.count() == 2 * spark.read.parquet(f"{SMALL}/region.parquet").count()
    assert listed.select("path").distinct().count() == 1
    named = t.read_matching(spark, SMALL, "nation*.parquet")
    assert named.columns == spark.read.parquet(f"{SMALL}/nation.parquet").columns


def test_cutoff_per_run(spark):
    df = spark.createDataFrame(
        [("a", "2000-01"), ("a", "2000-06"), ("b", "2000-06")], "phase string, time string"
    )
    assert rows(t.until(df, {"a": "2000-05"}), "phase") == [("a", "2000-01"), ("b", "2000-06")]
    dated = df.withColumn("time", F.to_date(F.concat("time", F.lit("-01"))))
    assert t.until(dated, {"a": dt.date(2000, 5, 1), "b": dt.date(1999, 1, 1)}).count() == 1


def test_staged_table_needs_a_shared_folder(spark, tmp_path):
    df = spark.range(10)
    if spark.conf.get(t.CHECKPOINT_SETTING, None) is None:
        with pytest.raises(ValueError):
            t.stage(df, "x")
    staged = t.stage(df, "x", str(tmp_path))
    assert staged.count() == 10
    assert "Range" not in staged._jdf.queryExecution().optimizedPlan().toString()


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS bucketed LOCATION '%s'" % (tmp_path / "db"))
    cells = spark.range(1000).select(
        (F.col("id") % 50).alias("cell"), (F.col("id") % 7).alias("depth"), F.col("id").alias("x")
    )
    keys = ["cell", "depth"]
    left = t.save_bucketed(cells, "bucketed.a", keys, 4)
    right = t.save_bucketed(cells.groupBy(*keys).agg(F.sum("x").alias("s")), "bucketed.b", keys, 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = left.join(right, keys)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    spark.sql("DROP DATABASE bucketed CASCADE")


def test_ordinal_of_a_coordinate(spark):
    df = spark.createDataFrame([(5.0,), (0.0,), (5.0,), (90.0,)], "depth double")
    found = attach_ordinal(df, "depth", out="layer")
    assert rows(found, "layer", "depth") == [(0.0, 1), (5.0, 2), (5.0, 2), (90.0, 3)]


def test_nan_is_missing_from_the_scan_on(spark, tmp_path):
    nan = float("nan")
    rows = [("A", 1, 2000, "x", nan), ("A", 1, 2000, "x", 4.0), ("A", 2, 2001, "y", nan), ("A", 2, 2001, "y", 5.0)]
    df = spark.createDataFrame(rows, "phase string, cell int, year int, location string, value double")
    write_table(df, f"{tmp_path}/t", ["year", "location"])
    df.write.parquet(f"{tmp_path}/one/p.parquet")
    for read in (
        read_files(spark, [f"{tmp_path}/one/p.parquet"]),
        read_matching(spark, f"{tmp_path}/one/p.parquet", "*.parquet"),
        read_partitions(spark, f"{tmp_path}/t", years=[2000, 2001]),
    ):
        assert read.where("value is null").count() == 2
        got = {r.cell: r for r in read.groupBy("cell").agg(F.avg("value").alias("m"), F.max("value").alias("x"), F.sum("value").alias("s")).collect()}
        assert (got[1].m, got[1].x, got[1].s) == (4.0, 4.0, 4.0)
        best = row_of_maximum(read.withColumn("month", F.col("cell")), ["phase"], "value", "month", ["year"])
        assert [r.value for r in best.collect()] == [5.0]


def test_writing_one_phase_leaves_the_others(spark, tmp_path):
    for phase in ("A", "N", "A"):
        write_table(spark.createDataFrame([(phase, 1.0)], "phase string, v double"), f"{tmp_path}/t", ["phase"])
    assert sorted(r.phase for r in spark.read.parquet(f"{tmp_path}/t").collect()) == ["A", "N"]
