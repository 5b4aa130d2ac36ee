"""Products that rest on the layout of what they read: array files, buckets, partitions,
files used in part, map order, and the operators for long series and many boxes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.exact import exact_mean, exact_sum
from cellweave.functions.missing import ratio, sum0
from cellweave.functions.physics import thickness_full
from cellweave.functions.regions import STUDY_BOXES
from cellweave.operators import integrate, long_series, scenario, series
from cellweave.operators.boxes import join_boxes
from cellweave.operators.slices import map_slice
from cellweave.plans import catalog
from cellweave.plans.bindings import CELL_KEY, CONTROL, RUNS, StagedViews, Views, position
from cellweave.plans.catalog import PRODUCTS, labelled, product
from cellweave.sources.array_files import read_arrays
from cellweave.sources.tables import read_files, read_files_until, read_places

#: The block of the grid that is read from the array files: start and count.
BLOCK = {"time": (60, 240), "eta": (2, 4), "xi": (1, 3)}


@product
def array_file_block(v: Views) -> DataFrame:
    """A hyperslab of both variables; array files outside it are not opened."""
    return read_arrays(v.spark, v.array_files, ["alk", "dic"], BLOCK)


@product
def array_file_means(v: Views) -> DataFrame:
    """Means over time of one variable of the whole grid."""
    cells = read_arrays(v.spark, v.array_files, ["alk"])
    return cells.groupBy("eta", "xi").agg(F.avg("alk").alias("alk_mean"), F.count("alk").alias("steps"))


#: Products that are also run on the bucketed tables of paired cells.
STAGED = (
    "column_integral_full",
    "column_integral_top100",
    "surface_cell_means",
    "column_cell_means",
    "column_cell_means_top100",
    "flux_deviation",
    "gradient_block_mean",
    "gradient_deviation",
)


def staged(name: str):
    function = getattr(catalog, name)

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return labelled(function(StagedViews(spark, folder)))

    query.__name__ = f"staged_{name}"
    return query


PRODUCTS.update({f"staged_{name}": staged(name) for name in STAGED})


@product
def series_of_places(v: Views) -> DataFrame:
    """Monthly means at the places whose region's name begins with A; the folders of other
    places are pruned while the query runs."""
    places = v.table("region").filter(F.col("r_name").startswith("A")).select(
        (F.col("r_regionkey") + 1).cast("int").alias("location"), F.col("r_name").alias("place")
    )
    raw = read_places(v.spark, v.series_by_place, places).filter(F.col("year") >= 1996)
    return series.monthly_series(raw, {"value_mean": F.col("value") / 1000.0}, region="place")


@product
def long_running_series(v: Views) -> DataFrame:
    """All events as one series: the sum so far and the mean of twelve events on."""
    events = v.table("events").select("event_id", "ts", "value")
    ranges = long_series.in_ranges(events, [], ["ts", "event_id"])
    summed = long_series.running_totals(ranges, [], ["ts", "event_id"], {"value_sum": "value"})
    means = long_series.running_averages(summed, [], ["ts", "event_id"], {"value_mean": "value"})
    return means.select("event_id", "value_sum", "value_mean")


@product
def long_series_by_type(v: Views) -> DataFrame:
    """The same for the series of each event type, of which few hold all rows."""
    keys, order = ["event_type"], ["ts", "event_id"]
    ranges = long_series.in_ranges(v.table("events").select("event_id", "ts", "value", *keys), keys, order)
    summed = long_series.running_totals(ranges, keys, order, {"value_sum": "value"})
    means = long_series.running_averages(summed, keys, order, {"value_mean": "value"}, size=3)
    return means.select("event_id", "event_type", "value_sum", "value_mean")


@product
def runs_with_a_cut(v: Views) -> DataFrame:
    """Two of three files, one of them up to a month: sums per run and month."""
    cells = read_files_until(v.spark, v.run_files, {"N": date(1998, 5, 1)}, wanted=["A", "N"], label="phase")
    return cells.groupBy("phase", "time").agg(F.count(F.lit(1)).alias("cells"), sum0("alk").alias("alk_sum"))


@product
def listed_run_files(v: Views) -> DataFrame:
    """One scan over a list of three files, counted per file."""
    scan = read_files(v.spark, list(v.run_files.values()), provenance="path")
    return (
        scan.withColumn("file", F.regexp_extract("path", r"/(run_[^/]*)\.parquet", 1))
        .groupBy("file")
        .agg(F.count(F.lit(1)).alias("cells"), sum0("dic").alias("dic_sum"))
    )


def many_boxes(v: Views) -> DataFrame:
    """A box around each customer's position, from a cell to some degrees wide."""
    half = (F.col("c_custkey") % 40 + 1) / F.lit(16.0)
    placed = v.table("customer").select("c_custkey", *[c.alias(n) for n, c in position("c_custkey").items()])
    return placed.select(
        F.col("c_custkey").alias("box"),
        (F.col("lon") - half).alias("lon_min"), (F.col("lon") + half).alias("lon_max"),
        (F.col("lat") - half).alias("lat_min"), (F.col("lat") + half).alias("lat_max"),
    )


@product
def box_table_membership(v: Views) -> DataFrame:
    """Number and mean of the orders in each of as many boxes as there are customers."""
    points = v.table("orders").select(
        F.col("o_totalprice").alias("value"), *[c.alias(n) for n, c in position("o_orderkey").items()]
    )
    return join_boxes(points, many_boxes(v), by="box", value="value")


@product
def map_layout_slice(v: Views) -> DataFrame:
    """A month and box of the map layout: few row groups are read."""
    month = v.map_cells.filter((F.col("phase") == "N") & (F.col("time") == F.lit(date(1996, 7, 1))))
    return map_slice(month, "dta_column", box=STUDY_BOXES[-1], cap=100.0, divide_by=10.0, ids=("cell", "lat", "lon"))


#: Products whose values are the same bits in any order of the rows, and in any engine:
#: they are compared as they are.
EXACT = ("exact_integrated_series", "exact_monthly_totals")


@product
def exact_integrated_series(v: Views) -> DataFrame:
    """The depth integral of all cells per phase and month, from pairing to sum in exact
    accumulation."""
    rows = v.lines.withColumn("run", v.run)
    paired = scenario.pair_runs(
        rows, list(CELL_KEY), "run", RUNS, CONTROL, {"alk": F.col("quantity"), "dic": F.col("price")}, mean=exact_mean
    )
    thickness = thickness_full("depth")
    sums = {
        "dta_sum": (F.col("alk") - F.col("alk_con")) * thickness,
        "ddic_sum": (F.col("dic") / 1000.0 - F.col("dic_con") / 1000.0) * thickness,
    }
    found = integrate.totals(paired, ["phase", "time"], sums, add=lambda x: F.coalesce(exact_sum(x), F.lit(0.0)))
    return found.withColumn("cdr_eff", ratio("ddic_sum", "dta_sum"))


@product
def exact_monthly_totals(v: Views) -> DataFrame:
    """Sum and mean per region and month of the raw series."""
    return series.monthly_series(v.series, {}, extra={"total": exact_sum("value"), "mean": exact_mean("value")})
