"""Columnar scans and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.missing import clean_measures
from cellweave.sources.shared import CHECKPOINT_SETTING


def read_files(
    spark: SparkSession, paths: Sequence[str], schema=None, provenance: str | None = None
) -> DataFrame:
    """One scan over an explicit list of files; ``provenance`` names a source-file column.

    As in all readers here, NaN becomes NULL directly on the scan.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = clean_measures(reader.parquet(*paths))
    return df if provenance is None else df.withColumn(provenance, F.input_file_name())


def read_matching(spark: SparkSession, folder: str, glob: str, schema=None) -> DataFrame:
    """One scan over the files of a folder whose name matches a glob."""
    reader = spark.read.option("pathGlobFilter", glob)
    if schema is not None:
        reader = reader.schema(schema)
    return clean_measures(reader.parquet(folder))


def read_partitions(
    spark: SparkSession,
    path: str,
    years: Iterable[int] | None = None,
    places: Iterable[str] | None = None,
) -> DataFrame:
    """A ``year=/location=`` layout; only the partitions asked for are listed and read."""
    df = clean_measures(spark.read.parquet(path))
    if years is not None:
        df = df.filter(F.col("year").isin(*years))
    if places is not None:
        df = df.filter(F.col("location").isin(*places))
    return df


def read_files_until(
    spark: SparkSession,
    paths: Mapping[str, str],
    cutoffs: Mapping[str, object],
    wanted: Sequence[str] | None = None,
    time: str = "time",
    label: str = "run",
    schema=None,
) -> DataFrame:
    """One scan over named files, of which some count up to a last period only.

    ``paths`` names the files in the order of their runs; ``cutoffs`` gives the last period
    of those that are not used to their end (the last file of a run, as a rule). ``wanted``
    selects files: the predicate is on the path that Spark knows of each file, so that the
    others are left out when files are listed and are never opened. The name comes back
    in the column ``label``.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    scan = reader.parquet(*paths.values())
    place = F.col("_metadata.file_path")
    names = list(paths if wanted is None else wanted)

    def of(name: str) -> Column:
        own = "/" + paths[name].rstrip("/").rsplit("/", 1)[-1]
        return place.endswith(own) | place.contains(f"{own}/")

    if wanted is not None:
        chosen = F.lit(False)
        for name in names:
            chosen = chosen | of(name)
        scan = scan.filter(chosen)
    run, within = F.lit(None).cast("string"), F.lit(True)
    for name in names:
        run = F.when(of(name), F.lit(name)).otherwise(run)
        if name in cutoffs:
            within = within & (~of(name) | (F.col(time) <= F.lit(cutoffs[name])))
    return clean_measures(scan.filter(within).withColumn(label, run))


def read_places(spark: SparkSession, path: str, places: DataFrame, on: Sequence[str] = ("location",)) -> DataFrame:
    """A ``year=/location=`` layout, of the places that are rows of a table.

    Where the table of places is small (Spark measures it), its rows are sent out before
    the scan and only the folders of these places are listed: the partitions are pruned
    while the query runs, by what a filter on the other table leaves.
    """
    return clean_measures(spark.read.parquet(path)).join(places, list(on))


def until(
    df: DataFrame, cutoffs: Mapping[str, object], phase: str = "phase", time: str = "time"
) -> DataFrame:
    """Keep each phase up to its last period; a phase without a cutoff is kept whole."""
    within = ~F.col(phase).isin(*cutoffs)
    for name, last in cutoffs.items():
        within = within | ((F.col(phase) == name) & (F.col(time) <= F.lit(last)))
    return df.filter(within)


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> None:
    """Write Parquet, by default one folder level per phase or year.

    ``sort_by`` orders rows inside each file, so row-group statistics can prune
    on depth or position. Overwriting a partitioned table replaces the phases or
    years that ``df`` holds and leaves the others.
    """
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def save_bucketed(
    df: DataFrame,
    table: str,
    keys: Sequence[str],
    buckets: int,
    mode: str = "overwrite",
    path: str | None = None,
) -> DataFrame:
    """Save a cell table bucketed and sorted by its join key, under ``path`` if given
    (a folder all executors share), else in the session's warehouse.

    Later joins and groupings on the key read the buckets in place instead of
    shuffling the cells again. Hash on the cell key, never on the phase, whose
    few values would make a few huge buckets.
    """
    writer = df.write.mode(mode).format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def stage(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Write a table to the shared checkpoint folder and continue from the files.

    Cuts the lineage in a place every executor can read, so a lost executor
    costs a re-read and not a recomputation, and gives later joins the exact
    size of the table.
    """
    spark = df.sparkSession
    root = root or spark.conf.get(CHECKPOINT_SETTING, None)
    if not root:
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
