"""What the layouts are for: exchanges, files and row groups that a plan does without."""

import datetime as dt
import math
import random
import re

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from __spark_entry__ import queries
from cellweave.operators import boxes as b
from cellweave.operators import long_series as ls
from cellweave.operators import scenario, series
from cellweave.plans.bindings import StagedViews, Views
from cellweave.plans.catalog import PRODUCTS
from cellweave.plans.layouts import STAGED
from cellweave.sources import maps, shared
from cellweave.sources.tables import read_files_until, read_places

QUERIES = queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged(plan, key):
    """Exchanges that deal rows by a column."""
    return len(re.findall(rf"Exchange hashpartitioning\([^)]*\b{key}#", plan))


def scan_metrics(df):
    """Files and rows that the scans of a plan have read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = {"numFiles": 0, "numOutputRows": 0}

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if "QueryStage" in node.getClass().getSimpleName():
            return walk(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            for name in found:
                found[name] += node.metrics().apply(name).value()
        for i in range(node.children().length()):
            walk(node.children().apply(i))

    walk(plan)
    return found


# --- the calendar and the buckets -----------------------------------------------------


@pytest.mark.parametrize("name, lines", [("cumulative_uptake", 1), ("driver_table", 1), ("weighted_mixing_depth", 2),
                                         ("subducted_under_current", 2), ("surface_drivers_weighted", 3),
                                         ("driver_table_joined", 3), ("driver_correlations", 1)])
def test_months_come_from_the_calendar(spark, name, lines):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert plan.count("lineitem.parquet") == lines  # one for each main branch
    assert "Subquery" in plan and "kept/calendar-" in plan


@pytest.mark.parametrize("name", ["regional_monthly_series", "metric_anomalies", "metric_running_means", "metric_correlation"])
def test_orders_are_read_once(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert plan.count("orders.parquet") == 1 and plan.count("lineitem.parquet") == 1


def test_month_and_run_of_a_map_reach_the_scan(spark):
    plan = plan_of(QUERIES["map_of_column_alkalinity"](spark, SMALL))
    assert plan.count("lineitem.parquet") == 1
    scan = next(x for x in plan.split("\n") if "FileScan" in x and "lineitem" in x)
    assert "Or(EqualTo(l_linestatus,F),EqualTo(l_returnflag,N))" in scan
    assert re.search(r"DataFilters: .*l_shipdate#\d+ >= Subq", scan)  # a bound that is known before the scan


@pytest.mark.parametrize("name", ["map_of_flux", "map_of_gradient", "map_of_mixing_depth"])
def test_maps_read_the_lines_once(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert plan.count("lineitem.parquet") == 1 and "l_shipdate" in plan and "Subq" in plan


def test_series_beside_its_reference(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("b", 1, 5.0), ("b", 3, 7.0)], "region string, yr_mon int, x double")
    found = series.beside_reference(df, F.col("region") == "a", "x")
    assert rows(found, "region", "yr_mon") == [("a", 1, 2.0, 2.0), ("a", 2, None, None), ("b", 1, 5.0, 2.0), ("b", 3, 7.0, None)]


@pytest.mark.parametrize("run", ["X", None])
def test_unknown_runs_are_not_lost(spark, run):
    raw = spark.createDataFrame([(1, "A", 1.0), (1, run, 2.0)], "cell int, run string, x double")
    with pytest.raises(Exception, match="unknown run: (X|NULL)"):
        scenario.pair_runs(raw, ["cell"], "run", ["A", "N"], "control", {"x": "x"}).collect()


def test_keys_must_be_there(spark):
    df = spark.createDataFrame([(1, 2), (1, None)], "cell int, depth int")
    assert scenario.require_keys(df, ["cell"]).count() == 2
    with pytest.raises(Exception, match="missing key: depth"):
        scenario.require_keys(df, ["cell", "depth"]).collect()


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n in names:
        spark.conf.unset(n)


@pytest.mark.parametrize("name", STAGED)
def test_staged_cells_are_not_exchanged(spark, no_broadcast, name):
    plan = plan_of(PRODUCTS[f"staged_{name}"](spark, SMALL))
    assert "Bucketed: true" in plan and plan.count("spark_catalog.default.kept_") == 1
    assert exchanged(plan, "cell") == 0 < exchanged(plan_of(PRODUCTS[name](spark, SMALL)), "cell")


def test_buckets_grow_with_the_lines(spark, monkeypatch):
    whole = StagedViews(spark, SMALL)
    assert whole.buckets == StagedViews.least_buckets
    monkeypatch.setattr(StagedViews, "bucket_bytes", shared.total_bytes(spark, [f"{SMALL}/lineitem.parquet"]) // 40)
    more = StagedViews(spark, SMALL)
    assert 40 <= more.buckets <= 41 and more.early.buckets == more.buckets
    assert f"out of {more.buckets}" in plan_of(more.paired.groupBy("cell").count())
    assert rows(more.paired, "phase", "cell", "depth", "time") == rows(whole.paired, "phase", "cell", "depth", "time")


def test_kept_tables_follow_their_inputs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_root", lambda _: f"file://{tmp_path}/shared")
    source = f"{tmp_path}/in.parquet"
    built = []

    def table():
        key = shared.fingerprint(spark, [source])
        return shared.kept_table(spark, "t", key, lambda: built.append(1) or spark.read.parquet(source))

    spark.range(3).write.parquet(source)
    assert table().count() == 3 and table().count() == 3 and len(built) == 1
    spark.range(5).write.mode("overwrite").parquet(source)
    assert table().count() == 5 and len(built) == 2
    assert shared.fingerprint(spark, [source], 1) != shared.fingerprint(spark, [source], 2)


def test_shared_root_needs_a_setting_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Conf:
        get = staticmethod(lambda name, default: default)

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_root(Session())


# --- partitions and files -------------------------------------------------------------


def test_partitions_are_pruned_by_the_joined_table(spark):
    df = PRODUCTS["series_of_places"](spark, SMALL)
    plan = plan_of(df)
    assert "dynamicpruningexpression" in plan and "PartitionFilters" in plan
    everything = spark.read.parquet(Views(spark, SMALL).series_by_place)
    read = scan_metrics(df)
    wanted = everything.filter("location in (1, 2, 3) and year >= 1996").select(F.input_file_name()).distinct().count()
    assert read["numFiles"] <= wanted + 1 < everything.select(F.input_file_name()).distinct().count()


def test_join_of_places(spark, tmp_path):
    data = [(dt.date(2000 + y, 1, 1), float(y), y, p) for y in range(3) for p in (1, 2, None)]
    spark.createDataFrame(data, "day date, value double, year int, location int").write.partitionBy("year", "location").parquet(f"{tmp_path}/s")
    places = spark.createDataFrame([(2, "b"), (7, "z"), (None, "n")], "location int, place string")
    assert [r[-1] for r in rows(read_places(spark, f"{tmp_path}/s", places), "value")] == ["b"] * 3


def test_files_are_pruned_and_one_is_cut(spark):
    df = PRODUCTS["runs_with_a_cut"](spark, SMALL)
    v = Views(spark, SMALL)
    every = spark.read.parquet(*v.run_files.values())
    files = {run: spark.read.parquet(p).select(F.input_file_name()).distinct().count() for run, p in v.run_files.items()}
    assert len(files) == 3 and every.select(F.input_file_name()).distinct().count() == sum(files.values())
    assert "_metadata" in plan_of(df) or "file_path" in plan_of(df)
    assert scan_metrics(df)["numFiles"] == files["A"] + files["N"]


def test_cut_of_one_file_only(spark, tmp_path):
    day = dt.date(2001, 1, 1)
    paths = {}
    for name in ("a", "ab", "c"):
        paths[name] = f"{tmp_path}/{name}.parquet"
        spark.createDataFrame([(day + dt.timedelta(i), float(i)) for i in range(4)] + [(None, 9.0)], "time date, x double").write.parquet(paths[name])
    read = read_files_until(spark, paths, {"ab": day + dt.timedelta(1)})
    count = {r.run: r["count"] for r in read.groupBy("run").count().collect()}
    assert count == {"a": 5, "ab": 2, "c": 5}
    assert read_files_until(spark, paths, {}, wanted=["c"]).select("run").distinct().collect()[0][0] == "c"


# --- long series ----------------------------------------------------------------------


@pytest.fixture(params=[1, 7])
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def series_windows(data, size):
    """(key, at, total, mean) by plain loops; data: (key, at, value)."""
    out = []
    for key in {k for k, _, _ in data}:
        own = sorted(((a, v) for k, a, v in data if k == key), key=lambda x: x[0])
        for i, (at, _) in enumerate(own):
            seen = [v for _, v in own[: i + 1] if v is not None]
            ahead = [v for _, v in own[i : i + size]]
            full = len(ahead) == size and None not in ahead
            out.append((key, at, sum(seen) if seen else None, sum(ahead) / size if full else None))
    return sorted(out, key=repr)


def test_long_series_equal_the_window(spark, partitions):
    r = random.Random(4)
    data = [("all", i, float(r.randint(0, 9)) if i % 17 else None) for i in range(400)]
    data += [(k, i, 1.0) for k in ("b", None) for i in range(5)] + [("one", 0, None), ("two", 0, 2.0)]
    df = spark.createDataFrame(data, "key string, at long, value double").repartition(3)
    ranges = ls.in_ranges(df, ["key"], ["at"])
    summed = ls.running_totals(ranges, ["key"], ["at"], {"total": "value"})
    means = ls.running_averages(summed, ["key"], ["at"], {"mean": "value"}, size=12)
    assert sorted(map(tuple, means.select("key", "at", "total", "mean").collect()), key=repr) == series_windows(data, 12)
    if partitions > 1:  # no task has all rows
        largest = max(x["count"] for x in ranges.groupBy(ls.RANGE).count().collect())
        assert largest < len(data) / 2


def test_ranges_shorter_than_the_window(spark, partitions):
    data = [(1, i, float(i)) for i in range(9)]
    ranges = ls.in_ranges(spark.createDataFrame(data, "key int, at long, value double"), [], ["at"])
    found = ls.running_averages(ranges, [], ["at"], {"mean": "value"}, size=6)
    assert [x[0] for x in rows(found.select("mean", "at"), "at")] == [2.5, 3.5, 4.5, 5.5, *[None] * 5]


def test_one_order_value_for_all_rows(spark, partitions):
    df = spark.range(500).select(F.lit(1).alias("at"), F.lit(2.0).alias("value"))
    ranges = ls.in_ranges(df, [], ["at"])
    found = ls.running_totals(ranges, [], ["at"], {"total": "value"})
    assert sorted(r.total for r in found.collect()) == [2.0 * i for i in range(1, 501)]
    if partitions > 1:
        assert ranges.select(ls.RANGE).distinct().count() > 1


def test_empty_series(spark):
    empty = spark.createDataFrame([], "at long, value double")
    ranges = ls.in_ranges(empty, [], ["at"])
    assert ls.running_totals(ranges, [], ["at"], {"t": "value"}).count() == 0
    assert ls.running_averages(ranges, [], ["at"], {"m": "value"}).count() == 0


# --- boxes ----------------------------------------------------------------------------

BOX = "box int, lon_min double, lon_max double, lat_min double, lat_max double"


@pytest.mark.parametrize("closed", [True, False])
def test_boxes_equal_the_range_join(spark, closed):
    r = random.Random(8)
    points = [(i, r.randint(-80, 80) / 2, r.randint(-300, 300) / 2) for i in range(150)] + [(900, None, 1.0), (901, 1.0, None)]
    sides = (0.0, 1 / 64, 0.5, 1.0, 3.0, 40.0, 360.0, 2000.0)
    boxes = []
    for i in range(120):
        x, y, w, h = r.randint(-300, 300) / 2, r.randint(-80, 80) / 2, r.choice(sides), r.choice(sides)
        boxes.append((i, x, x + w, y, y + h))
    boxes += [(500, 1.0, 0.0, 0.0, 1.0), (501, None, 1.0, 0.0, 1.0), (502, -180.0, 180.0, -90.0, 90.0)]
    found = b.join_boxes(
        spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(boxes, BOX), closed=closed
    )
    inside = (lambda v, a, z: a <= v <= z) if closed else (lambda v, a, z: a < v < z)
    expected = sorted(
        (p, i) for p, y, x in points for i, x0, x1, y0, y1 in boxes
        if None not in (x, y, x0) and inside(x, x0, x1) and inside(y, y0, y1)
    )
    assert rows(found.select("id", "box"), "id", "box") == expected and len(expected) > 300


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("slab, meeting", [(25, 50), (1000, 1000)])
def test_means_of_boxes_equal_those_of_the_pairs(spark, monkeypatch, closed, slab, meeting):
    monkeypatch.setattr(b, "SLAB", slab)
    monkeypatch.setattr(b, "MEETING", meeting)
    r = random.Random(5)
    odd = (None, None, float("inf"), float("-inf"), float("nan"), 1e300, -1e300, 0.1, 1e-300)
    at = lambda: r.choice((r.randint(-8, 8) / 2, r.uniform(-4, 4), 1.0))
    points = [(at(), at(), r.choice(odd) if i % 20 == 0 else float(r.randint(-999, 999))) for i in range(300)]
    points += [(None, 1.0, 1.0), (1.0, None, 1.0), *[(2.0, i / 8, 0.5) for i in range(40)]]
    boxes = []
    for i in range(120):
        x, y, w, h = at(), at(), r.choice((0.0, 0.5, 3.0, 9.0)), r.choice((0.0, 0.5, 3.0, 9.0))
        boxes.append((None if i % 30 == 0 else i // 2, x, x + w, y, y + h))
    boxes += [(500, 1.0, 0.0, 0.0, 1.0), (501, None, 1.0, 0.0, 1.0), (502, -180.0, 180.0, -90.0, 90.0)]
    rows_of = spark.createDataFrame(points, "lat double, lon double, value double"), spark.createDataFrame(boxes, BOX)
    found = {row.box: row for row in b.join_boxes(*rows_of, closed=closed, by="box", value="value").collect()}
    held = b.join_boxes(*rows_of, closed=closed).groupBy("box").agg(F.collect_list(F.struct("value")).alias("v")).collect()
    expected = {row.box: [x.value for x in row.v] for row in held}
    assert found.keys() == expected.keys() and len(found) > 40
    for box, inside in expected.items():
        assert found[box].points == len(inside)
        some = [x for x in inside if x is not None]
        if not some:
            assert found[box].value_mean is None
        elif all(map(math.isfinite, some)):
            assert found[box].value_mean == pytest.approx(math.fsum(some) / len(some), rel=1e-14)
        else:
            assert found[box].value_mean == pytest.approx(sum(x for x in some if not math.isfinite(x)), nan_ok=True)


def test_means_of_boxes_make_no_pairs(spark):
    points = spark.range(2000).select((F.col("id") / 7.0).alias("lat"), (F.col("id") % 90).alias("lon"), F.lit(1.0).alias("v"))
    boxes = spark.createDataFrame([(i, -1.0, 100.0, -1.0, 1000.0) for i in range(300)], BOX)
    found = b.join_boxes(points, boxes, by="box", value="v")
    assert {tuple(row) for row in found.collect()} == {(i, 2000, 1.0) for i in range(300)}
    made = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if "Join" in name:
            made.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().length()):
            walk(node.children().apply(i))

    walk(found._jdf.queryExecution().executedPlan())
    assert made and max(made) <= 2000


def test_boxes_meet_points_by_equality(spark, no_broadcast):
    plan = plan_of(PRODUCTS["box_table_membership"](spark, SMALL))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" in plan
    tiles = b.binned_boxes(spark.createDataFrame([(i, 0.3 * i, 0.3 * i + i / 10, 1.0, 1.0 + i / 7) for i in range(1, 200)], BOX))
    assert max(x["count"] for x in tiles.groupBy("box").count().collect()) <= 4


# --- maps -----------------------------------------------------------------------------


def test_morton_is_the_curve(spark):
    points = [(90 * j / 2048 - 90, 360 * i / 4096 - 180, i, j) for i in (0, 1, 5, 4095) for j in (0, 1, 6, 2047)]
    df = spark.createDataFrame(points, "lat double, lon double, i int, j int")
    bits = lambda n: [(n >> k) & 1 for k in range(12)]
    for r in df.select("i", (F.floor((F.col("lat") + 90) / 180 * 4096)).alias("j"), maps.morton().alias("z")).collect():
        assert r.z == sum(x << (2 * k) | y << (2 * k + 1) for k, (x, y) in enumerate(zip(bits(r.i), bits(r.j), strict=True)))
    edge = spark.createDataFrame([(95.0, 400.0), (-95.0, -400.0)], "lat double, lon double")
    assert [r[0] for r in edge.select(maps.morton()).collect()] == [(1 << 24) - 1, 0]


def test_box_and_month_read_a_fraction(spark, tmp_path):
    n = 200_000
    place = F.col("id") * 7919
    cells = spark.range(n).select(
        F.lit("N").alias("phase"), F.expr("make_date(1999, cast(id % 4 + 1 AS int), 1)").alias("time"),
        (place % 1440 / 8.0 - 90).alias("lat"), (F.floor(place / 1440) % 2880 / 8.0 - 180).alias("lon"), F.rand(1).alias("x"),
    )
    maps.write_map(cells, f"{tmp_path}/map", group_bytes=1 << 16)
    read = spark.read.parquet(f"{tmp_path}/map")
    box = "lat between 10 and 30 and lon between -60 and -20 and time = date'1999-03-01'"
    found = read.filter(box).agg(F.count("x").alias("n"))
    metrics = scan_metrics(found)
    assert found.first().n == cells.filter(box).count() > 0
    assert metrics["numOutputRows"] < n / 10
