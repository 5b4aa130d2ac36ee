"""Surface drivers of the carbon uptake, per region and weighted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.calendar import month_seconds
from cellweave.functions.missing import ratio, sum0
from cellweave.functions.physics import moles, monthly_uptake
from cellweave.functions.regions import STUDY_BOXES, expand_regions
from cellweave.operators.ensemble import group_means, running_sum
from cellweave.operators.integrate import means, totals, weighted_mean

MEASURES = ("co2_upsum", "alk_pot_mean", "wind_avg", "ddpco2_mean", "co3prox_mean")


def with_uptake(df: DataFrame, flux: str = "dfg", area: str = "area", time: str = "time"):
    """Monthly carbon uptake of each cell in moles; ``time`` is a date in the month."""
    return df.withColumn("co2_uptake", monthly_uptake(flux, area, month_seconds(time)))


def regional_means(df, keys, averages, boxes=STUDY_BOXES, whole=None) -> DataFrame:
    return means(expand_regions(df, boxes=boxes, whole=whole), ["region", *keys], averages)


def regional_totals(df, keys, sums, boxes=STUDY_BOXES, whole=None) -> DataFrame:
    return totals(expand_regions(df, boxes=boxes, whole=whole), ["region", *keys], sums)


def cumulative_uptake(monthly: DataFrame) -> DataFrame:
    """Add the running sum of the monthly uptake ``co2_sum_ind`` and its share of the
    integrated carbon gain ``ddic_sum``."""
    summed = running_sum(monthly, ["phase"], "month", "co2_sum_ind", "co2_sum_cum")
    return summed.withColumn("fraction", ratio("co2_sum_cum", "ddic_sum"))


def drivers_of_runs(cells: DataFrame, runs, boxes=STUDY_BOXES) -> DataFrame:
    """``driver_table`` from cells that hold all runs: (region, phase, time) and measures.

    ``cells`` has wind_speed and co3_prox, and for each run a struct of co2_uptake, alk_pot
    and ddpco2, NULL where the run has no such cell. Cells are expanded into regions and
    grouped once, and what belongs to no run meets the runs without a join.
    """
    expanded = expand_regions(cells, boxes=boxes)
    aggregates = [F.avg("wind_speed").alias("wind_avg"), F.avg("co3_prox").alias("co3prox_mean")]
    for run in runs:
        aggregates.append(
            F.struct(
                F.count(run).alias("cells"),
                F.lit(run).alias("phase"),
                sum0(f"{run}.co2_uptake").alias("co2_upsum"),
                F.avg(f"{run}.alk_pot").alias("alk_pot_mean"),
                F.avg(f"{run}.ddpco2").alias("ddpco2_mean"),
            ).alias(run)
        )
    grouped = expanded.groupBy("region", "time").agg(*aggregates)
    return (
        grouped.withColumn("_run", F.explode(F.array(*runs)))
        .filter("_run.cells > 0")
        .select("region", "_run.phase", "time", "_run.co2_upsum", "_run.alk_pot_mean", "wind_avg", "_run.ddpco2_mean", "co3prox_mean")
    )


def driver_table(cells: DataFrame, wind: DataFrame, proxy: DataFrame, boxes=STUDY_BOXES):
    """Uptake and its drivers per region, phase and month.

    The cell measures (``co2_uptake, alk_pot, ddpco2``) come in one table, so the
    cells are read and expanded into regions once. ``wind`` and ``proxy`` are
    already averaged by region and time; they join at that coarser grain.
    """
    surface = (
        expand_regions(cells, boxes=boxes)
        .groupBy("region", "phase", "month", "time")
        .agg(
            sum0("co2_uptake").alias("co2_upsum"),
            F.avg("alk_pot").alias("alk_pot_mean"),
            F.avg("ddpco2").alias("ddpco2_mean"),
        )
    )
    return (
        surface.join(wind, ["region", "time"], "left")
        .join(proxy, ["region", "time"], "left")
        .select("region", "phase", "month", "time", *MEASURES)
    )


def weighted_drivers(cells: DataFrame) -> DataFrame:
    """Gradient and wind weighted by the unused alkalinity of each cell, with the sums.

    The means are strict: a phase and month with an incomplete cell has none.
    """
    weighted = cells.withColumn("alk_potmolm", moles("alk_pot", "area"))
    return weighted.groupBy("phase", "month").agg(
        weighted_mean("ddpco2", "alk_potmolm").alias("ddpco2_wmean"),
        weighted_mean("wind_speed", "alk_potmolm").alias("wind_wmean"),
        sum0("alk_potmolm").alias("ualk_sum"),
        sum0("co2_uptake").alias("co2_upsum"),
    )


def weighted_mixing_depth(cells: DataFrame) -> DataFrame:
    """Mixing depth weighted by the alkalinity inventory, per phase and over the phases."""
    by_phase = (
        cells.withColumn("_inventory", F.col("dta_column") * F.col("area"))
        .groupBy("phase", "month")
        .agg(weighted_mean("hbls", "_inventory").alias("hbls_wmean"))
    )
    return group_means(by_phase, ["month"], {"hbls_ovmean": "hbls_wmean"}, missing="strict")
