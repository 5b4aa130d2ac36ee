"""The named data products: name -> function of (spark, folder) giving a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import calendar, physics
from cellweave.functions.missing import (
    clean_measures,
    keep_between,
    keep_nonnegative,
    log10_positive,
    ratio,
    ratio_if_positive,
    sum0,
    to_number,
)
from cellweave.functions.regions import STUDY_BOXES, expand_regions, region_class
from cellweave.operators import chemistry, drivers, ensemble, integrate, scenario, series
from cellweave.operators.lookup import attach_lookup, attach_ordinal
from cellweave.operators.slices import map_slice
from cellweave.plans.bindings import (
    CELL_KEY,
    CHECKED_LEAST,
    CHECKED_REGION,
    FIRST_MONTHS,
    REFERENCE_REGION,
    REGIONS,
    RUNS,
    MonthViews,
    Views,
)
from cellweave.sources import chunks as arrays
from cellweave.sources.tables import read_files, read_matching, until

Query = Callable[[SparkSession, str], DataFrame]

PRODUCTS: dict[str, Query] = {}

# Last month that counts of the one run whose last file goes beyond its end.
RUN_ENDS = {"N": date(1998, 5, 1)}


def labelled(df: DataFrame) -> DataFrame:
    """Months get their ``YYYY-MM`` label last, so that plans group and join on a date."""
    forms = {"date": "cast({0} AS string) AS {0}"}
    return df.selectExpr(
        *[
            "date_format(time, 'yyyy-MM') AS time"
            if (name, kind) == ("time", "date")
            else forms.get(kind, "{0}").format(name)
            for name, kind in df.dtypes
        ]
    )


def as_stored(df: DataFrame) -> DataFrame:
    """Measures in single precision, with noise near zero removed, for comparison with
    another engine: sums of doubles depend on the order of the rows, and in this form
    equal results are equal values. The products themselves are not rounded."""
    form = "cast(cast(rint({0} * 1e9) / 1e9 AS float) AS double) + 0e0 AS {0}"
    return df.selectExpr(
        *[form.format(name) if kind == "double" else name for name, kind in df.dtypes]
    )


def comparable(query: Query) -> Query:
    """A product in the form that is compared with its reference SQL."""

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return as_stored(query(spark, folder))

    return run


def product(function: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    """Register a product under its function name."""

    @wraps(function)
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return labelled(function(Views(spark, folder)))

    PRODUCTS[function.__name__] = query
    return function


# --- scenario differences -------------------------------------------------------------


@product
def scenario_difference_native(v: Views) -> DataFrame:
    cells = scenario.drop_land(until(v.treated, RUN_ENDS), ["alk"])
    treated = scenario.require_keys(cells, ["phase", *CELL_KEY])
    paired = scenario.pair_with_control(
        treated,
        v.control,
        CELL_KEY,
        {"dta": ("alk", "alk_con"), "ddic": ("dic", "dic_con")},
    )
    return paired.drop("alk", "dic", "alk_con", "dic_con")


@product
def scenario_difference_regridded(v: Views) -> DataFrame:
    treated = until(v.treated, RUN_ENDS)
    paired = scenario.pair_with_control(
        treated,
        v.control,
        CELL_KEY,
        {"dta": ("alk", "alk_con"), "ddic": ("dic", "dic_con")},
    )
    return paired.drop("alk", "dic", "alk_con", "dic_con")


@product
def surface_flux_difference(v: Views) -> DataFrame:
    treated = v.surface_treated.select(
        "phase", "cell", "time", "hbls", F.col("alk").alias("fg_co2_oae")
    )
    control = v.surface_control.select("cell", "time", F.col("alk_con").alias("fg_co2"))
    return scenario.pair_with_control(
        treated, control, ["cell", "time"], {"dfg": ("fg_co2_oae", "fg_co2")}
    )


@product
def induced_pco2_gradient(v: Views) -> DataFrame:
    treated = v.surface_treated.select(
        "phase", "cell", "time", (F.col("dic") - F.col("alk")).alias("dpco2_oae")
    )
    control = v.surface_control.select(
        "cell", "time", (F.col("dic_con") - F.col("alk_con")).alias("dpco2_con")
    )
    return scenario.pair_with_control(
        treated, control, ["cell", "time"], {"ddpco2": ("dpco2_oae", "dpco2_con")}
    )


@product
def control_carbonate_proxy(v: Views) -> DataFrame:
    return v.surface_control.select(
        "cell", "time", (F.col("alk_con") - F.col("dic_con")).alias("co3_prox")
    )


@product
def grid_containment(v: Views) -> DataFrame:
    nep = STUDY_BOXES[-1]
    return scenario.share_outside(
        domain_cells(v), ["phase", "time"], "dta_mol", nep.holds("lat", "lon"), "dta_sum"
    )


@product
def two_grid_containment(v: Views) -> DataFrame:
    """What the totals over the North-East Pacific grid miss of those over the whole one."""
    nep, cells = STUDY_BOXES[-1], domain_cells(v)
    whole = integrate.totals(cells, ["phase", "time"], {"dta_sum": "dta_mol"})
    part = integrate.totals(cells.filter(nep.holds("lat", "lon")), ["phase", "time"], {"dta_sum": "dta_mol"})
    return scenario.missing_share(whole, part, ["phase", "time"], "dta_sum")


@product
def cumulative_surface_alkalinity(v: Views) -> DataFrame:
    scan = read_matching(v.spark, v.folder, "lineitem*.parquet")
    layer = scan.filter(F.col("l_linenumber") < 5)
    # one grouping for both runs; a key that only one of them has gives NULL and adds nothing
    quantity, run = F.col("l_quantity"), F.col("l_linestatus")
    paired = layer.groupBy(
        F.col("l_suppkey").alias("cell"),
        F.col("l_linenumber").alias("layer"),
        calendar.month_start("l_shipdate").alias("time"),
    ).agg(
        (
            F.avg(F.when(run == "O", quantity)) - F.avg(F.when(run == "F", quantity))
        ).alias("dta")
    )
    return integrate.totals(paired, [], {"dta_total": "dta"})


# --- integrals ------------------------------------------------------------------------


def domain_cells(v: Views) -> DataFrame:
    """Paired cells with position, volume and moles."""
    placed = integrate.attach_static(v.paired, v.area, ["cell"])
    volume = placed.withColumn("volume", F.col("area") * physics.thickness_full("depth"))
    return integrate.cell_moles(volume, {"dta_mol": "dta", "ddic_mol": "ddic"}, "volume")


def column_cells(v: Views) -> DataFrame:
    """Paired cells with moles per square metre of the layer."""
    return v.paired.withColumn("thickness", physics.thickness_full("depth")).withColumns(
        {
            "dta_mol": F.col("dta") * F.col("thickness"),
            "ddic_mol": F.col("ddic") * F.col("thickness"),
        }
    )


def integrated_series(v: Views) -> DataFrame:
    return integrate.integrate(column_cells(v), ["phase", "time"])


@product
def cell_moles_native(v: Views) -> DataFrame:
    return integrate.with_efficiency(domain_cells(v)).select(
        "phase", "cell", "depth", "time", "dta_mol", "ddic_mol", "cdr_eff"
    )


@product
def domain_integral_native(v: Views) -> DataFrame:
    return integrate.integrate(domain_cells(v), ["phase", "time"])


@product
def cell_moles_per_metre(v: Views) -> DataFrame:
    text = v.area.select("cell", F.col("lat").cast("string").alias("lat"))
    cells = v.paired.join(text, ["cell"], "left").withColumn("lat", to_number("lat"))
    amounts = integrate.cell_moles(
        integrate.with_cell_area(cells), {"dta_m": "dta", "ddic_m": "ddic"}, "area"
    )
    return amounts.select("phase", "cell", "depth", "time", "area", "dta_m", "ddic_m")


@product
def depth_layer_integral(v: Views) -> DataFrame:
    placed = integrate.attach_static(v.paired, v.area, ["cell"])
    per_metre = integrate.cell_moles(placed, {"dta_mol": "dta", "ddic_mol": "ddic"}, "area")
    return integrate.integrate(per_metre, ["phase", "depth", "time"])


@product
def full_depth_integral(v: Views) -> DataFrame:
    return integrated_series(v)


def column_amounts(v: Views, top100: bool) -> DataFrame:
    return integrate.column_integral(v.paired, ["phase", "cell", "time"], top100=top100)


@product
def column_integral_full(v: Views) -> DataFrame:
    return column_amounts(v, top100=False)


@product
def column_integral_top100(v: Views) -> DataFrame:
    return column_amounts(v, top100=True)


# --- drivers of the uptake ------------------------------------------------------------


def placed_surface(v: Views) -> DataFrame:
    """Surface cells of the first months with month number, position and area."""
    numbered = v.early.with_month(clean_measures(v.early.surface))
    return integrate.attach_static(numbered, v.area, ["cell"])


def placed_wind(v: Views) -> DataFrame:
    return integrate.attach_static(v.wind, v.area, ["cell"])


def placed_proxy(v: Views) -> DataFrame:
    return integrate.attach_static(control_carbonate_proxy(v), v.area, ["cell"])


@product
def regional_wind(v: Views) -> DataFrame:
    return drivers.regional_means(
        placed_wind(v), ["time"], {"wind_avg": "wind_speed"}, whole="Domain"
    )


@product
def unused_alkalinity(v: Views) -> DataFrame:
    return drivers.regional_means(
        placed_surface(v),
        ["phase", "month", "time"],
        {"alk_pot_mean": "alk_pot"},
        whole="Domain",
    )


@product
def cell_uptake(v: Views) -> DataFrame:
    return drivers.with_uptake(placed_surface(v)).select(
        "phase", "cell", "time", "month", "lat", "lon", "co2_uptake"
    )


@product
def regional_uptake(v: Views) -> DataFrame:
    return drivers.regional_totals(
        drivers.with_uptake(placed_surface(v)),
        ["phase", "month", "time"],
        {"co2_upsum": "co2_uptake"},
    )


@product
def cumulative_uptake(v: Views) -> DataFrame:
    """Uptake at the surface against the gain of all layers, from one pass over the cells."""
    cells = domain_cells(v.early)
    uptake = physics.monthly_uptake("dta", "area", calendar.month_seconds("time"))
    sums = {"co2_sum_ind": F.when(F.col("depth") == 0, uptake), "ddic_sum": "ddic_mol"}
    monthly = v.early.with_month(integrate.totals(cells, ["phase", "time"], sums)).drop("time")
    return drivers.cumulative_uptake(monthly).select(
        "phase", "month", "co2_sum_ind", "co2_sum_cum", "ddic_sum", "fraction"
    )


@product
def regional_gradient(v: Views) -> DataFrame:
    return drivers.regional_means(
        placed_surface(v), ["phase", "month", "time"], {"ddpco2_mean": "ddpco2"}
    )


@product
def regional_proxy(v: Views) -> DataFrame:
    return drivers.regional_means(placed_proxy(v), ["time"], {"co3prox_mean": "co3_prox"})


@product
def driver_table(v: Views) -> DataFrame:
    found = v.early.with_month(drivers.drivers_of_runs(v.early.driver_cells, RUNS))
    return found.filter(F.col("month") <= FIRST_MONTHS).select(
        "region", "phase", "month", "time", *drivers.MEASURES
    )


@product
def driver_table_joined(v: Views) -> DataFrame:
    """The same from tables that are apart: cells of the runs, wind and proxy by region."""
    wind = drivers.regional_means(placed_wind(v.early), ["time"], {"wind_avg": "wind_speed"})
    return drivers.driver_table(
        drivers.with_uptake(placed_surface(v)), wind, regional_proxy(v.early)
    )


def seasonal_surface(v: Views) -> DataFrame:
    """All cells of the surface layer in the first months, with wind and uptake."""
    numbered = v.early.with_month(v.early.surface_seasonal)
    cells = integrate.attach_static(numbered, v.area, ["cell"])
    return drivers.with_uptake(cells.join(v.early.wind, ["cell", "time"], "left"))


@product
def surface_drivers_weighted(v: Views) -> DataFrame:
    return drivers.weighted_drivers(seasonal_surface(v))


@product
def unused_alkalinity_by_alkalinity(v: Views) -> DataFrame:
    local = STUDY_BOXES[0]
    return seasonal_surface(v).groupBy("phase", "month").agg(
        integrate.weighted_mean("alk_pot", "dta").alias("alkpot_wmean"),
        F.avg(F.when(local.holds("lat", "lon"), F.col("alk_pot"))).alias("ualk_mean"),
    )


@product
def driver_table_long(v: Views) -> DataFrame:
    return series.lengthen(
        driver_table(v), ["region", "phase", "month", "time"], drivers.MEASURES, "driver", "value"
    )


@product
def driver_correlations(v: Views) -> DataFrame:
    others = [m for m in drivers.MEASURES if m != "co2_upsum"]
    return driver_table(v).groupBy("region").agg(
        *[series.correlation("co2_upsum", m).alias(f"cor_{m}") for m in others],
        *[
            series.correlation("co2_upsum", m, missing="strict").alias(f"cor_strict_{m}")
            for m in others
        ],
    )


# --- ensemble statistics --------------------------------------------------------------

SERIES_VALUES = ("dta_sum", "ddic_sum", "cdr_eff")


def numbered_series(v: Views) -> DataFrame:
    return ensemble.number_rows(integrated_series(v), ["phase"], "time")


@product
def ensemble_series(v: Views) -> DataFrame:
    return ensemble.group_means(
        numbered_series(v), ["month"], {f"{c}_mean": c for c in SERIES_VALUES}
    )


@product
def ensemble_envelope(v: Views) -> DataFrame:
    return ensemble.group_envelope(numbered_series(v), ["month"], SERIES_VALUES)


@product
def ensemble_deviation(v: Views) -> DataFrame:
    return scenario.with_differences(
        ensemble_series(v), {f"d_{c}": (c, f"{c}_mean") for c in SERIES_VALUES}
    ).select("phase", "month", "time", *[f"d_{c}" for c in SERIES_VALUES])


def depth_levels(v: Views) -> DataFrame:
    return ensemble.bin_edges(v.treated_lines.select("depth").distinct())


@product
def depth_bins(v: Views) -> DataFrame:
    return depth_levels(v)


@product
def depth_time_table(v: Views) -> DataFrame:
    layers = v.early.with_month(depth_layer_integral(v.early))
    return attach_lookup(layers, depth_levels(v), ["depth"]).withColumns(
        {
            "category": physics.depth_class("depth"),
            "category_rank": physics.depth_class_rank("depth"),
        }
    )


def depth_time_ensemble(v: Views) -> DataFrame:
    layers = v.early.with_month(depth_layer_integral(v.early))
    return ensemble.group_means(
        layers,
        ["month", "depth"],
        {
            "dta_mean": "dta_sum",
            "ddic_mean": "ddic_sum",
            "cdr_effmean": keep_between("cdr_eff", 0, 1),
        },
    )


@product
def depth_time_means(v: Views) -> DataFrame:
    return depth_time_ensemble(v)


@product
def depth_time_deviation(v: Views) -> DataFrame:
    masked = (
        depth_time_ensemble(v)
        .withColumns(
            {
                "dta_sum": keep_nonnegative("dta_sum"),
                "ddic_sum": keep_nonnegative("ddic_sum"),
                "cdr_eff": keep_between("cdr_eff", 0, 1),
            }
        )
        .filter(F.col("depth") < 200)
    )
    return scenario.with_differences(
        masked,
        {
            "d_dta": ("dta_sum", "dta_mean"),
            "d_ddic": ("ddic_sum", "ddic_mean"),
            "d_cdr_eff": ("cdr_eff", "cdr_effmean"),
        },
    ).select("phase", "month", "depth", "d_dta", "d_ddic", "d_cdr_eff")


@product
def surface_cell_means(v: Views) -> DataFrame:
    cells = v.with_month(v.surface.select("phase", "cell", "time", "dta", "ddic"))
    averaged = ensemble.group_means(
        cells, ["cell", "month"], {"dta_mean": "dta", "ddic_mean": "ddic"}
    )
    return averaged.withColumn("cdreff_mean", ratio("ddic_mean", "dta_mean"))


@product
def column_cell_means(v: Views) -> DataFrame:
    cells = v.with_month(column_amounts(v, top100=False))
    averaged = ensemble.group_means(
        cells, ["cell", "month"], {"dta_mean": "dta_column", "ddic_mean": "ddic_column"}
    )
    return averaged.withColumn("cdreff_mean", ratio_if_positive("ddic_mean", "dta_mean")).select(
        "phase", "cell", "time", "month", "dta_column", "dta_mean", "ddic_mean", "cdreff_mean"
    )


@product
def column_cell_means_top100(v: Views) -> DataFrame:
    cells = v.with_month(column_amounts(v, top100=True))
    return ensemble.group_means(cells, ["cell", "month"], {"cdr_mean": "cdreff_col"}).select(
        "phase", "cell", "time", "month", "cdreff_col", "cdr_mean"
    )


@product
def flux_deviation(v: Views) -> DataFrame:
    cells = v.early.with_month(v.early.surface.select("phase", "cell", "time", "dfg"))
    averaged = ensemble.group_means(cells, ["cell", "month"], {"dfg_mean": "dfg"})
    return scenario.with_differences(averaged, {"d_dfg": ("dfg", "dfg_mean")})


@product
def gradient_block_mean(v: Views) -> DataFrame:
    cells = v.early.with_month(v.early.surface.select("phase", "cell", "time", "ddpco2"))
    return ensemble.block_means(cells, ["cell", "phase"], "month", {"ddpco2_3mean": "ddpco2"})


@product
def gradient_deviation(v: Views) -> DataFrame:
    cells = v.early.with_month(v.early.surface.select("phase", "cell", "time", "ddpco2"))
    averaged = ensemble.group_means(cells, ["cell", "month"], {"ddpco2_mean": "ddpco2"})
    return scenario.with_differences(averaged, {"d_ddpco2": ("ddpco2", "ddpco2_mean")})


# --- mixing depth and subduction ------------------------------------------------------


def maximum_mixing(v: Views) -> DataFrame:
    return integrate.row_of_maximum(
        v.early.with_month(v.early.mixing), ["phase", "cell"], "hbls", "month", ["time"]
    )


@product
def maximum_mixing_depth(v: Views) -> DataFrame:
    return maximum_mixing(v)


@product
def maximum_mixing_deviation(v: Views) -> DataFrame:
    averaged = ensemble.group_means(maximum_mixing(v), ["cell"], {"hbls_mean": "hbls"})
    return scenario.with_differences(averaged, {"d_hbls": ("hbls", "hbls_mean")})


@product
def monthly_mixing_deviation(v: Views) -> DataFrame:
    cells = v.early.with_month(v.early.mixing)
    averaged = ensemble.group_means(cells, ["cell", "month"], {"hbls_mean": "hbls"})
    return scenario.with_differences(averaged, {"d_hbls": ("hbls", "hbls_mean")})


@product
def weighted_mixing_depth(v: Views) -> DataFrame:
    columns = column_amounts(v.early, top100=False).select(
        "phase", "cell", "time", "dta_column"
    )
    cells = v.early.with_month(v.early.mixing).join(columns, ["phase", "cell", "time"], "left")
    return drivers.weighted_mixing_depth(integrate.attach_static(cells, v.area, ["cell"]))


def numbered_columns(v: Views) -> DataFrame:
    return v.early.with_month(
        column_cells(v.early).select("phase", "cell", "depth", "time", "dta_mol", "ddic_mol")
    )


@product
def subducted_under_maximum(v: Views) -> DataFrame:
    deepest = maximum_mixing(v).select("phase", "cell", "hbls")
    cells = numbered_columns(v).join(deepest, ["phase", "cell"], "left")
    return integrate.subducted(
        cells, ["phase", "month"], {"dta": "dta_mol", "ddic": "ddic_mol"}
    )


@product
def subducted_under_current(v: Views) -> DataFrame:
    cells = numbered_columns(v).join(v.early.mixing, ["phase", "cell", "time"], "left")
    return integrate.subducted(
        cells, ["phase", "month"], {"dta": "dta_mol", "ddic": "ddic_mol"}
    )


# --- regional time series -------------------------------------------------------------


def sst_series(v: Views) -> DataFrame:
    checked = series.quality_rule(v.series, CHECKED_REGION, F.col("value") >= CHECKED_LEAST)
    return series.monthly_series(checked, {"sst_mean": F.col("value") / 1000.0})


def sst_anomalies(v: Views) -> DataFrame:
    return series.anomalies(sst_series(v), ["region"], "sst_mean", "sst_clim", "sst_anom")


@product
def regional_monthly_series(v: Views) -> DataFrame:
    return v.monthly


@product
def climatology_baseline(v: Views) -> DataFrame:
    return series.climatology(sst_series(v), ["region"], "sst_mean", "sst_clim")


@product
def anomaly_series(v: Views) -> DataFrame:
    return sst_anomalies(v)


@product
def running_annual_mean(v: Views) -> DataFrame:
    return series.running_means(sst_anomalies(v), ["region"], ["sst_mean", "sst_anom"])


@product
def anomaly_correlation(v: Views) -> DataFrame:
    found = sst_anomalies(v).select("region", "yr_mon", "sst_anom")
    beside = series.beside_reference(found, F.col("region") == REFERENCE_REGION, "sst_anom")
    pairs = beside.filter(F.col("region") != REFERENCE_REGION).dropna("any", subset=["sst_anom", "reference"])
    return pairs.groupBy("region").agg(series.correlation("reference", "sst_anom").alias("cor"))


# Short names of the measures of a month.
METRICS = {"t50_mean": "t50", "depth_26_mean": "depth26", "salt_26_mean": "salt26"}


def metric_table(v: Views, measures=METRICS) -> DataFrame:
    """Long (region, yr_mon, metric, metric_mean), metrics under their short names."""
    long = series.lengthen(v.monthly, ["region", "yr_mon"], list(measures), "metric", "metric_mean")
    short = F.lit(None).cast("string")
    for name, own in measures.items():
        short = F.when(F.col("metric") == name, F.lit(own)).otherwise(short)
    return long.withColumn("metric", short)


@product
def metric_anomalies(v: Views) -> DataFrame:
    return (
        series.anomalies(
            metric_table(v), ["region", "metric"], "metric_mean", "metric_clim", "metric_anom"
        )
    )


@product
def metric_running_means(v: Views) -> DataFrame:
    found = series.anomalies(
        metric_table(v), ["region", "metric"], "metric_mean", "metric_clim", "metric_anom"
    )
    return (
        series.running_means(found, ["region", "metric"], ["metric_mean", "metric_anom"])
    )


@product
def metric_correlation(v: Views) -> DataFrame:
    """Each metric of each region against the anomalies of the reference region's sst,
    which runs along as a metric of its own."""
    table = metric_table(v, {**METRICS, "sst_mean": "sst"})
    found = series.anomalies(
        table.filter((F.col("metric") != "sst") | F.col("metric_mean").isNotNull()),
        ["region", "metric"], "metric_mean", "metric_clim", "metric_anom",
    )
    is_reference = (F.col("metric") == "sst") & (F.col("region") == REFERENCE_REGION)
    beside = series.beside_reference(found, is_reference, "metric_anom")
    pairs = beside.filter(F.col("metric") != "sst").dropna("any", subset=["metric_anom", "reference"])
    return pairs.groupBy("region", "metric").agg(
        series.correlation("reference", "metric_anom").alias("cor")
    )


@product
def region_columns(v: Views) -> DataFrame:
    return (
        series.widen(
            sst_anomalies(v), ["yr_mon"], "region", "sst_anom", REGIONS
        ).withColumnsRenamed({name: f"anom_{name[0]}" for name in REGIONS})
    )


@product
def series_before_cutoff(v: Views) -> DataFrame:
    return series.before(sst_series(v), "2001-01-01")


@product
def earliest_series_month(v: Views) -> DataFrame:
    return series.earliest(sst_series(v), "yr_mon", ["region"])


# --- maps and points ------------------------------------------------------------------


@product
def point_region_class(v: Views) -> DataFrame:
    return v.points.select("cell", "lat", "lon", region_class("lat", "lon").alias("region"))


@product
def region_membership(v: Views) -> DataFrame:
    return (
        expand_regions(v.points)
        .groupBy("region")
        .agg(
            F.count(F.lit(1)).alias("points"),
            sum0("value").alias("value_sum"),
            F.avg("value").alias("value_mean"),
        )
    )


@product
def region_extent(v: Views) -> DataFrame:
    return integrate.extent(expand_regions(v.points, whole="Domain"), ["lat", "lon"], ["region"])


@product
def open_box_means(v: Views) -> DataFrame:
    inside = v.points.filter(STUDY_BOXES[1].holds("lat", "lon", closed=False))
    return inside.agg(
        F.count(F.lit(1)).alias("points"),
        F.avg("value").alias("value_mean"),
        F.avg(log10_positive("value")).alias("value_log_mean"),
    )


@product
def map_of_column_alkalinity(v: Views) -> DataFrame:
    """Month and run reach the scan; nothing else is paired."""
    one = MonthViews(v.spark, v.folder, "N", 10)
    cells = integrate.attach_static(column_amounts(one, top100=False), v.area, ["cell"])
    return map_slice(
        cells,
        "dta_column",
        phase="N",
        box=STUDY_BOXES[-1],
        cap=100.0,
        blank_zero=True,
        blank_negative=True,
        divide_by=10.0,
        ids=("cell", "lat", "lon"),
    )


def surface_map(v: Views, value: str, **options) -> DataFrame:
    """A surface measure of one run in its tenth month, over the North-East Pacific."""
    cells = integrate.attach_static(MonthViews(v.spark, v.folder, "N", 10).surface, v.area, ["cell"])
    return map_slice(cells, value, phase="N", box=STUDY_BOXES[-1], ids=("cell", "lat", "lon"), **options)


@product
def map_of_flux(v: Views) -> DataFrame:
    return surface_map(v, "dfg", cap=20.0)


@product
def map_of_gradient(v: Views) -> DataFrame:
    return surface_map(v, "ddpco2", valid=(-25.0, 25.0))


@product
def map_of_mixing_depth(v: Views) -> DataFrame:
    return surface_map(v, "hbls", cap=200.0, blank_zero=True)


@product
def closing_step(v: Views) -> DataFrame:
    monthly = numbered_series(v).select("phase", "month", "dta_sum")
    return ensemble.repeat_last_period(monthly, ["phase"], "month")


# --- arrays ---------------------------------------------------------------------------

CHUNK_DIMS = ("time", "eta", "xi")


@product
def chunk_cells(v: Views) -> DataFrame:
    grid = arrays.select_grid(v.chunks, CHUNK_DIMS, ["alk"])
    axes = {
        "eta": (lattice(v, 30.0), "lat"),
        "xi": (lattice(v, -120.0), "lon"),
    }
    return arrays.with_coordinates(arrays.chunk_rows(grid, CHUNK_DIMS), axes)


def lattice(v: Views, first: float) -> DataFrame:
    """Coordinate values of an 8-cell axis."""
    return v.spark.range(8).select(
        F.col("id").cast("int").alias("idx"),
        (F.col("id") * physics.CELL_DEGREES + first).alias("coord"),
    )


@product
def chunk_block(v: Views) -> DataFrame:
    grid = arrays.select_grid(v.chunks, CHUNK_DIMS, ["alk"])
    return arrays.hyperslab(grid, CHUNK_DIMS, {"time": (60, 240), "eta": (2, 4), "xi": (1, 3)})


@product
def chunk_variables(v: Views) -> DataFrame:
    wide = arrays.variables_as_columns(v.chunks, CHUNK_DIMS, ["alk", "dic"])
    return wide.groupBy("file", "eta", "xi").agg(
        sum0("alk").alias("alk_sum"),
        sum0("dic").alias("dic_sum"),
        sum0(F.col("alk") * F.col("dic")).alias("product_sum"),
    )


@product
def deep_index_filter(v: Views) -> DataFrame:
    """Layers whose position in the depth axis is beyond the fourth."""
    indexed = attach_ordinal(v.treated, "depth", out="layer", source=v.treated_lines)
    deep = indexed.filter(F.col("layer") > 4)
    return deep.groupBy("layer", "depth").agg(
        F.count(F.lit(1)).alias("cells"), F.avg("alk").alias("alk_mean")
    )


# --- joins, unions and scalars on their own -------------------------------------------


@product
def join_run_variables(v: Views) -> DataFrame:
    keys = ["phase", "cell", "depth", "time"]
    alk = v.treated.filter(F.col("alk") >= 10.0).select(*keys, "alk")
    dic = v.treated.filter(F.col("dic") <= 80.0).select(*keys, "dic")
    return scenario.join_variables(alk, dic, keys)


@product
def static_right_join(v: Views) -> DataFrame:
    thickness = v.control.select("cell", "depth").distinct().withColumn(
        "dz", physics.thickness_full("depth")
    )
    return integrate.attach_static(v.area, thickness, ["cell"], "right").select(
        "cell", "depth", (F.col("area") * F.col("dz")).alias("volume")
    )


@product
def merged_runs(v: Views) -> DataFrame:
    return scenario.merge_runs(
        v.surface_treated.groupBy("cell", "time").agg(F.avg("alk").alias("alk")),
        v.surface_control.select("cell", "time", "alk_con"),
        ["cell", "time"],
    )


@product
def stacked_runs(v: Views) -> DataFrame:
    control = v.control_lines.groupBy("cell").agg(F.avg("quantity").alias("alk"))
    treated = v.treated_lines.groupBy("cell").agg(
        F.avg("quantity").alias("alk"), F.avg("discount").alias("hbls")
    )
    return scenario.stack_runs({"control": control, "treated": treated}, "run")


@product
def distinct_positions(v: Views) -> DataFrame:
    return v.area.select("lat", "lon", "area").distinct()


@product
def calendar_forms(v: Views) -> DataFrame:
    """Order dates as text, label, model seconds and month length, counted per month."""
    days = v.table("orders").groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("n"))
    text = days.select("n", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("text"))
    moment = calendar.parse_datetime("text")
    seconds = F.unix_timestamp(moment) - F.lit(calendar.EPOCH_1979)
    forms = text.select(
        "n",
        calendar.year_month("text").alias("time"),
        calendar.mid_month(calendar.from_seconds_1979(seconds)).cast("string").alias("yr_mon"),
        calendar.month_of_year(moment).alias("moy"),
        calendar.seconds_1979_from_year_one(
            seconds + F.lit(calendar.YEAR_ONE_TO_1979)
        ).alias("model_seconds"),
    )
    return (
        forms.groupBy("time", "yr_mon", "moy")
        .agg(F.sum("n").alias("orders"), F.min("model_seconds").alias("first_seconds"))
        .withColumn("secs", calendar.month_seconds(calendar.month_date("time")).cast("bigint"))
    )


@product
def unit_conversions(v: Views) -> DataFrame:
    return v.control.select(
        "cell",
        "depth",
        "time",
        (physics.to_mol_per_kg("alk_con") * 1e6).alias("umol_per_kg"),
        physics.to_mmol_per_m3(physics.to_mol_per_kg("dic_con")).alias("dic_again"),
        physics.pressure_bar(-F.col("depth")).alias("pressure"),
        physics.wrap_longitude(F.col("cell") + F.lit(120.0)).alias("lon"),
    )


@product
def read_listed_files(v: Views) -> DataFrame:
    """One scan over an explicit file list, counted per source file."""
    scan = read_files(v.spark, [f"{v.folder}/orders.parquet"], provenance="path")
    return (
        scan.withColumn("file", F.element_at(F.split("path", "/"), -1))
        .groupBy("file")
        .agg(F.count(F.lit(1)).alias("rows"), sum0("o_totalprice").alias("price_sum"))
    )


# --- carbonate chemistry --------------------------------------------------------------


def surface_water(v: Views) -> DataFrame:
    return v.control_water.filter(F.col("depth") == 0).withColumn(
        "pressure", physics.pressure_bar("depth")
    )


@product
def pco2_comparison(v: Views) -> DataFrame:
    """Calculated and stored pCO2 in long form with the residual of each cell."""
    both = surface_water(v).select(
        "cell",
        "time",
        chemistry.pco2("alk", "dic").alias("pco2_calc"),
        (F.col("dic") - 1600.0).alias("pco2oc"),
    )
    with_residual = both.withColumn("dpco2", F.col("pco2oc") - F.col("pco2_calc"))
    return series.lengthen(
        with_residual, ["cell", "time", "dpco2"], ["pco2_calc", "pco2oc"], "variant", "pco2"
    )


@product
def alkalinity_perturbation(v: Views) -> DataFrame:
    """Response of pCO2 and DIC to 10 mmol per m3 of added alkalinity."""
    solved = surface_water(v).withColumn("_r", chemistry.response("alk", "dic", 10.0))
    return solved.select("cell", "time", "dic", "_r.*").select(
        "cell",
        "time",
        "pco2_calc",
        "pco2_calc_pert",
        (F.col("pco2_calc_pert") - F.col("pco2_calc")).alias("dpco2"),
        (F.col("dic_pert") - F.col("dic")).alias("ddic"),
    )


def potential(v: Views) -> DataFrame:
    pressure = physics.pressure_bar("depth")
    cells = chemistry.removal_potential(
        v.control_water.withColumn("pressure", pressure),
        v.treated_water.withColumn("pressure", pressure),
        list(CELL_KEY),
    )
    placed = integrate.attach_static(cells, v.area, ["cell"])
    volume = F.col("area") * physics.thickness_full("depth")
    return integrate.cell_moles(placed, {"cdr_pot": "ddic"}, volume)


@product
def removal_potential_cells(v: Views) -> DataFrame:
    """Potential per cell in units of a million moles."""
    return potential(v).select(
        "phase", "cell", "depth", "time", "ddic", (F.col("cdr_pot") / 1e6).alias("cdr_pot_e6")
    )


@product
def removal_potential_total(v: Views) -> DataFrame:
    return integrate.totals(potential(v), ["phase"], {"cum_cdr_pot": "cdr_pot"})
