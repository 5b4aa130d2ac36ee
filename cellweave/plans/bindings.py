"""Grid-shaped views of the star-schema tables.

The library's operators take any table with the right columns. These views give
the bundled tables the shape of model output, so that every data product can be
run and checked on them:

* ``lineitem`` as cells: phase, scenario, cell, depth, month and two measures
  (``alk`` from the quantity, ``dic`` from the price), treated and control;
* ``supplier`` as the static layer (position and area of a cell);
* ``customer`` as points with a value;
* ``orders`` (with ``lineitem``) as regional time series;
* ``embeddings`` as array chunks of 8 x 8 values.

Each view reads only the columns it needs and aggregates before any join.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.calendar import mid_month, month_seconds, month_start
from cellweave.functions.missing import ratio
from cellweave.functions.physics import cell_area, monthly_uptake
from cellweave.operators.integrate import attach_static, column_integral
from cellweave.operators.lookup import first_values, ordered_values, ordinal_in
from cellweave.operators.scenario import pair_runs, with_differences
from cellweave.sources.array_files import write_arrays
from cellweave.sources.maps import write_map
from cellweave.sources.shared import fingerprint, kept_buckets, kept_path, kept_table, total_bytes
from cellweave.sources.tables import read_files

# Depth in metres of line numbers 1 to 7.
DEPTHS = (0.0, 40.0, 80.0, 90.0, 100.0, 200.0, 300.0)

# The treated runs and the name given to the control run.
RUNS = ("A", "N", "R")
CONTROL = "control"

CELL_KEY = ("cell", "depth", "time")
FIRST_MONTHS = 24
REFERENCE_REGION = "1-URGENT"
# The region whose values are checked, and the least that counts there.
CHECKED_REGION, CHECKED_LEAST = "3-MEDIUM", 20000.0
REGIONS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def position(key: str) -> dict:
    """Latitude and longitude on a 1/8 degree lattice over the map frame."""
    return {
        "lat": F.lit(5.0) + (F.col(key) * 37 % 481) / F.lit(8.0),
        "lon": F.lit(-160.0) + (F.col(key) * 53 % 561) / F.lit(8.0),
    }


class Views:
    """The views over one folder of tables.

    With ``first`` set, every view holds only what belongs to the first months
    of the treated runs. The restriction is applied to the raw rows, below the
    aggregations and joins, where the optimizer could not move it by itself.
    """

    def __init__(self, spark: SparkSession, folder: str, first: int | None = None):
        self.spark = spark
        self.folder = folder
        self.first = first
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = read_files(self.spark, [f"{self.folder}/{name}.parquet"])
        return self._tables[name]

    @cached_property
    def early(self) -> Views:
        """The same views restricted to the first months of each run."""
        early = type(self)(self.spark, self.folder, FIRST_MONTHS)
        early._tables = self._tables
        early.calendar, early.periods = self.calendar, self.periods
        return early

    @cached_property
    def _all_lines(self) -> DataFrame:
        cases = " ".join(f"WHEN {i} THEN {d}D" for i, d in enumerate(DEPTHS, start=1))
        depth = F.expr(f"CASE l_linenumber {cases} END")
        return self.table("lineitem").select(
            F.col("l_returnflag").alias("phase"),
            F.col("l_linestatus").alias("scenario"),
            F.col("l_suppkey").alias("cell"),
            F.col("l_linenumber").alias("layer"),
            depth.alias("depth"),
            month_start("l_shipdate").alias("time"),
            F.col("l_shipdate").alias("day"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
        )

    def source_key(self, *names: str) -> str:
        """Fingerprint of the files of these tables."""
        return fingerprint(self.spark, [f"{self.folder}/{name}.parquet" for name in names])

    @cached_property
    def calendar(self) -> DataFrame:
        """(phase, time): the months of the treated runs, kept from the first plan that
        needs them, so that no plan scans the lines for its months."""
        treated = self._all_lines.filter(F.col("scenario") == "O")
        return kept_table(
            self.spark,
            "calendar",
            self.source_key("lineitem"),
            lambda: treated.select("phase", "time").distinct().coalesce(1),
        )

    @cached_property
    def periods(self) -> Column:
        """The months of each treated run in order."""
        return ordered_values(self.calendar, "time", "phase")

    def _early_rows(self, lines: DataFrame, keys: list[str]) -> DataFrame:
        if self.first is None:
            return lines
        if "phase" in keys:
            return lines.filter(ordinal_in(self.periods, "phase", "time") <= self.first)
        early = first_values(self.calendar, "time", "phase", self.first)
        return lines.filter(F.array_contains(early, F.col("time")))

    @cached_property
    def lines(self) -> DataFrame:
        """Raw rows of all runs; ``time`` is the first day of the month."""
        return self._early_rows(self._all_lines, ["time"])

    @cached_property
    def treated_lines(self) -> DataFrame:
        return self._early_rows(
            self._all_lines.filter(F.col("scenario") == "O"), ["phase", "time"]
        )

    @cached_property
    def control_lines(self) -> DataFrame:
        return self._early_rows(self._all_lines.filter(F.col("scenario") == "F"), ["time"])

    def with_month(self, df: DataFrame) -> DataFrame:
        """Add the month number of the treated run."""
        return df.withColumn("month", ordinal_in(self.periods, "phase", "time"))

    @cached_property
    def treated(self) -> DataFrame:
        """(phase, cell, depth, time) with alk, dic."""
        return (
            self.treated_lines.groupBy("phase", "cell", "depth", "time").agg(
                F.avg("quantity").alias("alk"),
                (F.avg("price") / 1000.0).alias("dic"),
            )
        )

    @cached_property
    def control(self) -> DataFrame:
        """(cell, depth, time) with alk_con, dic_con."""
        return (
            self.control_lines.groupBy("cell", "depth", "time").agg(
                F.avg("quantity").alias("alk_con"),
                (F.avg("price") / 1000.0).alias("dic_con"),
            )
        )

    @property
    def run(self):
        """Name of the run a raw row belongs to."""
        return F.when(F.col("scenario") == "F", F.lit(CONTROL)).otherwise(F.col("phase"))

    def _paired(self, lines: DataFrame, keys: list[str], measures: dict) -> DataFrame:
        rows = lines.withColumn("run", self.run)
        paired = pair_runs(rows, keys, "run", RUNS, CONTROL, measures).withColumns(
            {name: F.col(name) / 1000.0 for name in ("dic", "dic_con")}
        )
        return with_differences(
            self._early_rows(paired, ["phase", "time"]),
            {"dta": ("alk", "alk_con"), "ddic": ("dic", "dic_con")},
        )

    @cached_property
    def paired(self) -> DataFrame:
        """Treated cells with control and differences dta, ddic."""
        return self._paired(
            self.lines,
            list(CELL_KEY),
            {"alk": F.col("quantity"), "dic": F.col("price")},
        )

    @cached_property
    def area(self) -> DataFrame:
        """(cell) with lat, lon, area: the static layer, never distributed by hint."""
        placed = self.table("supplier").select(
            F.col("s_suppkey").alias("cell"), *[c.alias(n) for n, c in position("s_suppkey").items()]
        )
        return placed.withColumn("area", cell_area("lat"))

    @cached_property
    def surface_treated(self) -> DataFrame:
        """(phase, cell, time) with hbls and, at depth 0, alk and dic.

        The mixing depth is averaged over whole hundredths, which add up exactly:
        it is compared with depth levels, and the last bit must not depend on
        the order of the rows.
        """
        at_surface = F.col("layer") == 1
        quantity = F.avg(F.when(at_surface, F.col("quantity")))
        price = F.avg(F.when(at_surface, F.col("price"))) / 1000.0
        return (
            self.treated_lines.groupBy("phase", "cell", "time").agg(
                (F.avg(F.rint(F.col("discount") * 100.0)) * 30.0).alias("hbls"),
                quantity.alias("alk"),
                price.alias("dic"),
            )
        )

    @cached_property
    def surface_control(self) -> DataFrame:
        """(cell, time) at depth 0 with alk_con, dic_con."""
        return (
            self.control_lines.filter(F.col("layer") == 1)
            .groupBy("cell", "time")
            .agg(
                F.avg("quantity").alias("alk_con"),
                (F.avg("price") / 1000.0).alias("dic_con"),
            )
        )

    @cached_property
    def surface(self) -> DataFrame:
        """Surface cells paired with control: flux difference, gradient, unused alkalinity.

        The quantity stands for flux and sea pCO2, the price for air pCO2.
        """
        surface = F.col("layer") == 1
        paired = self._paired(
            self.lines.filter((F.col("scenario") == "O") | surface),
            ["cell", "time"],
            {
                "hbls": F.rint(F.col("discount") * 100.0),
                "alk": F.when(surface, F.col("quantity")),
                "dic": F.when(surface, F.col("price")),
            },
        )
        return paired.select(
            "phase",
            "cell",
            "time",
            (F.col("hbls") * 30.0).alias("hbls"),
            "dta",
            "ddic",
            F.col("dta").alias("dfg"),
            (F.col("dta") - F.col("ddic")).alias("alk_pot"),
            ((F.col("dic") - F.col("alk")) - (F.col("dic_con") - F.col("alk_con"))).alias(
                "ddpco2"
            ),
        )

    @cached_property
    def surface_seasonal(self) -> DataFrame:
        """Cells of the surface layer beside the control of their calendar month.

        The control is a mean per cell and month of the year, so that it covers most
        cells, but not all.
        """
        treated = (
            self.treated_lines.filter(F.col("layer") == 1)
            .groupBy("phase", "cell", "time")
            .agg(F.avg("quantity").alias("alk"), (F.avg("price") / 1000.0).alias("dic"))
        )
        control = (
            self._all_lines.filter((F.col("scenario") == "F") & (F.col("layer") == 1))
            .groupBy("cell", F.month("time").alias("season"))
            .agg(F.avg("quantity").alias("alk_con"), (F.avg("price") / 1000.0).alias("dic_con"))
        )
        paired = treated.withColumn("season", F.month("time")).join(control, ["cell", "season"], "left")
        dta, ddic = F.col("alk") - F.col("alk_con"), F.col("dic") - F.col("dic_con")
        return paired.select(
            "phase",
            "cell",
            "time",
            dta.alias("dta"),
            dta.alias("dfg"),
            (dta - ddic).alias("alk_pot"),
            (ddic - dta).alias("ddpco2"),
        )

    @cached_property
    def mixing(self) -> DataFrame:
        """(phase, cell, time) with hbls."""
        return self.surface_treated.select("phase", "cell", "time", "hbls")

    @cached_property
    def wind(self) -> DataFrame:
        """(cell, time) with wind_speed, over all runs."""
        return (
            self.lines.groupBy("cell", "time").agg(
                (F.avg("tax") * 100.0).alias("wind_speed")
            )
        )

    @cached_property
    def driver_cells(self) -> DataFrame:
        """(cell, time) with position, area, wind_speed, co3_prox and a column per treated
        run that holds its uptake, unused alkalinity and gradient: one grouping of the lines."""
        surface, control = F.col("layer") == 1, F.col("scenario") == "F"

        def means(here: Column, name: str) -> list[Column]:
            return [
                F.avg(F.when(here & surface, F.col("quantity"))).alias(f"q_{name}"),
                (F.avg(F.when(here & surface, F.col("price"))) / 1000.0).alias(f"p_{name}"),
            ]

        aggregates = [(F.avg("tax") * 100.0).alias("wind_speed"), *means(control, CONTROL)]
        for run in RUNS:
            here = ~control & (F.col("phase") == run)
            aggregates += [F.count(F.when(here, F.lit(1))).alias(f"rows_{run}"), *means(here, run)]
        wide = attach_static(self.lines.groupBy("cell", "time").agg(*aggregates), self.area, ["cell"])
        q, p = F.col(f"q_{CONTROL}"), F.col(f"p_{CONTROL}")
        runs = {}
        for run in RUNS:
            dta, ddic = F.col(f"q_{run}") - q, F.col(f"p_{run}") - p
            measures = F.struct(
                monthly_uptake(dta, "area", month_seconds("time")).alias("co2_uptake"),
                (dta - ddic).alias("alk_pot"),
                ((F.col(f"p_{run}") - F.col(f"q_{run}")) - (p - q)).alias("ddpco2"),
            )
            runs[run] = F.when(F.col(f"rows_{run}") > 0, measures)
        return wide.select(
            "cell", "time", "lat", "lon", "wind_speed", (q - p).alias("co3_prox"), *[c.alias(n) for n, c in runs.items()]
        )

    @cached_property
    def points(self) -> DataFrame:
        """(cell) with lat, lon, value."""
        return self.table("customer").select(
            F.col("c_custkey").alias("cell"),
            *[c.alias(n) for n, c in position("c_custkey").items()],
            F.col("c_acctbal").alias("value"),
        )

    @cached_property
    def series(self) -> DataFrame:
        """(region, ts, value) raw rows."""
        return self.table("orders").select(
            F.col("o_orderpriority").alias("region"),
            F.col("o_orderdate").alias("ts"),
            F.col("o_totalprice").alias("value"),
        )

    @cached_property
    def monthly(self) -> DataFrame:
        """(region, yr_mon) with sst_mean, t50_mean, depth_26_mean, salt_26_mean, from one
        scan of the orders and one of their lines.

        Lines are added up per order before the join, so an order holding a large share of
        the lines meets its one order row as a single row. Low values of one region do not
        count as sst; the reference region has no line metrics.
        """
        per_order = (
            self.table("lineitem")
            .groupBy(F.col("l_orderkey").alias("o_orderkey"))
            .agg(
                F.sum("l_quantity").alias("quantity"),
                F.sum("l_discount").alias("discount"),
                F.count(F.lit(1)).alias("lines"),
            )
        )
        orders = self.table("orders").select(
            "o_orderkey",
            F.col("o_orderpriority").alias("region"),
            F.col("o_orderdate").alias("ts"),
            F.col("o_totalprice").alias("value"),
        )
        counts = (F.col("region") != CHECKED_REGION) | (F.col("value") >= CHECKED_LEAST)
        measured = F.col("region") != REFERENCE_REGION
        return (
            orders.join(per_order, "o_orderkey", "left")
            .groupBy("region", mid_month("ts").alias("yr_mon"))
            .agg(
                F.avg(F.when(counts, F.col("value") / 1000.0)).alias("sst_mean"),
                F.avg(F.col("value") / 10000.0).alias("t50_mean"),
                F.when(measured, ratio(F.sum("quantity"), F.sum("lines"))).alias("depth_26_mean"),
                F.when(measured, ratio(F.sum("discount") * 100.0, F.sum("lines"))).alias("salt_26_mean"),
            )
        )

    @cached_property
    def chunks(self) -> DataFrame:
        """Array chunks: two variables on (time, eta, xi), one chunk per vector."""
        blocks = self.table("embeddings").select(
            F.concat(F.lit("run_"), F.col("label").cast("string")).alias("file"),
            F.array(F.lit("time"), F.lit("eta"), F.lit("xi")).alias("dims"),
            F.array(F.col("vec_id").cast("int"), F.lit(0), F.lit(0)).alias("starts"),
            F.array(F.lit(1), F.lit(8), F.lit(8)).alias("sizes"),
            F.col("embedding").cast("array<double>").alias("values"),
        )
        variables = F.array(
            F.struct(F.lit("alk").alias("var"), F.col("values").alias("values")),
            F.struct(F.lit("dic").alias("var"), F.reverse("values").alias("values")),
        )
        return blocks.withColumn("_v", F.explode(variables)).select(
            "file", F.col("_v.var").alias("var"), "dims", "starts", "sizes",
            F.col("_v.values").alias("values"),
        )

    @cached_property
    def array_files(self) -> str:
        """Folder of array files: two variables on (time, eta, xi), 64 time steps a file."""

        def write(path: str) -> None:
            blocks = self.table("embeddings").select(
                F.array(F.col("vec_id").cast("int"), F.lit(0), F.lit(0)).alias("starts"),
                F.array(F.lit(1), F.lit(8), F.lit(8)).alias("sizes"),
                F.col("embedding").cast("array<double>").alias("alk"),
                F.reverse(F.col("embedding").cast("array<double>")).alias("dic"),
            )
            write_arrays(blocks, path, ["time", "eta", "xi"], steps=64)

        return kept_path(self.spark, "arrays", self.source_key("embeddings"), write)

    @cached_property
    def run_files(self) -> dict[str, str]:
        """A file per treated run with its cells of the surface layer."""

        def write(path: str) -> None:
            for run in RUNS:
                cells = self.treated.filter((F.col("phase") == run) & (F.col("depth") == 0)).drop("phase")
                cells.write.parquet(f"{path}/run_{run}.parquet")

        path = kept_path(self.spark, "runs", self.source_key("lineitem"), write)
        return {run: f"{path}/run_{run}.parquet" for run in RUNS}

    @cached_property
    def series_by_place(self) -> str:
        """Folder of the raw series in a ``year=/location=`` layout."""

        def write(path: str) -> None:
            placed = self.series.withColumns(
                {"year": F.year("ts"), "location": F.substring("region", 1, 1).cast("int")}
            )
            dealt = placed.repartition("year", "location")
            dealt.write.partitionBy("year", "location").parquet(path)

        return kept_path(self.spark, "series", self.source_key("orders"), write)

    @cached_property
    def map_cells(self) -> DataFrame:
        """Column amounts with position, laid out for maps."""

        def write(path: str) -> None:
            amounts = column_integral(self.paired, ["phase", "cell", "time"])
            write_map(attach_static(amounts, self.area, ["cell"]).drop("area"), path, group_bytes=1 << 18)

        path = kept_path(self.spark, "map", self.source_key("lineitem", "supplier"), write)
        return read_files(self.spark, [path])

    def _water(self, df: DataFrame) -> DataFrame:
        """Stand-in sea-water state from the raw measures of a cell."""
        return df.select(
            *[c for c in df.columns if c not in ("quantity", "price", "discount", "tax")],
            (F.col("quantity") * 4.0 + 2100.0).alias("alk"),
            (F.col("price") / 1000.0 + 1900.0).alias("dic"),
            (F.col("tax") * 40.0 + 32.0).alias("salt"),
            (F.col("discount") * 200.0 + 4.0).alias("temp"),
            (F.col("quantity") * 0.02 + 0.2).alias("po4"),
            (F.col("quantity") * 0.5 + 2.0).alias("sio3"),
        )

    def _water_means(self, lines: DataFrame, keys: list[str]) -> DataFrame:
        means = lines.groupBy(*keys, "time").agg(
            *[F.avg(c).alias(c) for c in ("quantity", "price", "discount", "tax")]
        )
        return self._water(means)

    @cached_property
    def control_water(self) -> DataFrame:
        return self._water_means(self.control_lines, ["cell", "depth"])

    @cached_property
    def treated_water(self) -> DataFrame:
        return self._water_means(self.treated_lines, ["phase", "cell", "depth"]).drop("dic")


class MonthViews(Views):
    """The views restricted to one treated run, its control, and one of its months.

    The month is known by its number; its dates come from the calendar before the lines are
    read, as bounds of the raw date and of the run that reach the scan.
    """

    def __init__(self, spark: SparkSession, folder: str, phase: str, month: int):
        super().__init__(spark, folder)
        self.phase, self.month = phase, month

    def _bound(self, months: int) -> Column:
        own = self.calendar.filter(F.col("phase") == self.phase)
        first = F.get(F.sort_array(F.collect_set("time")), F.lit(self.month - 1))
        return own.agg(F.add_months(first, months).cast("timestamp_ntz")).scalar()

    @cached_property
    def lines(self) -> DataFrame:
        run = (F.col("scenario") == "F") | (F.col("phase") == self.phase)
        day = F.col("day")
        return self._all_lines.filter(run & (day >= self._bound(0)) & (day < self._bound(1)))


class StagedViews(Views):
    """The views over one table of paired cells in buckets of the cell, kept between plans.

    Everything that groups, ranks or joins by cell and further columns reads the buckets in
    place: the cells are shuffled once, when the table is written, and never again.
    """

    #: Least number of buckets, and bytes of the lines' files for each: a task reads one bucket.
    least_buckets, bucket_bytes = 16, 4 << 20

    @cached_property
    def buckets(self) -> int:
        size = total_bytes(self.spark, [f"{self.folder}/lineitem.parquet"])
        return max(self.least_buckets, -(-size // self.bucket_bytes))

    def _kept(self, name: str, build) -> DataFrame:
        return kept_buckets(self.spark, name, self.source_key("lineitem"), build, "cell", self.buckets)

    def _whole(self) -> Views:
        """All rows of all runs, whatever this object is restricted to."""
        return Views(self.spark, self.folder)

    @cached_property
    def paired(self) -> DataFrame:
        kept = self._kept("paired", lambda: self._whole().paired)
        return self._early_rows(kept, ["phase", "time"])

    @cached_property
    def surface(self) -> DataFrame:
        kept = self._kept("surface", lambda: self._whole().surface)
        return self._early_rows(kept, ["phase", "time"])
