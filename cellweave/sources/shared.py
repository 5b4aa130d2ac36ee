"""Tables that are built once, kept in the shared folder and found again by their inputs.

A kept table's folder is named by what it is and by a fingerprint of the files it was
built from, so that changed inputs lead to another table and never to a stale one. It is
written under a name of its own and renamed when it is whole: a job that dies leaves
nothing that is mistaken for the table.
"""

from __future__ import annotations

import functools
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. In a local session without it, where driver
    and executors are one process, a folder of this application; elsewhere an error."""
    root = spark.conf.get(CHECKPOINT_SETTING, None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    if not hasattr(context, "_cellweave_root"):
        context._cellweave_root = "file://" + tempfile.mkdtemp(prefix="cellweave-")
    return context._cellweave_root


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in its form: any store Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def total_bytes(spark: SparkSession, paths: Sequence[str]) -> int:
    """Length of the files under ``paths``; runs no job."""
    places = (_file_system(spark, path) for path in paths)
    return sum(system.getContentSummary(place).getLength() for system, place in places)


def fingerprint(spark: SparkSession, paths: Sequence[str], *settings: object) -> str:
    """Hash of the length, number and last change of the files under ``paths``, of
    ``settings`` and of this package, so that a table that other code has built is another
    table. Asks the file system once per path and runs no job."""
    parts = [repr(settings), _package()]
    for path in paths:
        system, place = _file_system(spark, path)
        whole, own = system.getContentSummary(place), system.getFileStatus(place)
        parts.append(f"{place} {whole.getLength()} {whole.getFileCount()} {own.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


@functools.cache
def _package() -> str:
    """Hash of the modules that shape kept tables."""
    root = Path(__file__).resolve().parent.parent
    digest = hashlib.sha256()
    for part in ("functions", "operators", "plans", "sources"):
        for module in sorted((root / part).glob("*.py")):
            digest.update(module.read_bytes())
    return digest.hexdigest()


def kept_path(
    spark: SparkSession, name: str, key: str, write: Callable[[str], None]
) -> str:
    """Folder of the kept result ``name`` under ``key``; ``write(path)`` makes it if it is
    not there. If two sessions build it at once, the first to finish stays."""
    path = f"{shared_root(spark)}/kept/{name}-{key}"
    if not exists(spark, path):
        own = f"{shared_root(spark)}/building/{name}-{uuid.uuid4().hex}"
        write(own)
        system, target = _file_system(spark, path)
        system.mkdirs(target.getParent())
        if not system.exists(target):
            system.rename(_file_system(spark, own)[1], target)
    return path


def kept_table(
    spark: SparkSession,
    name: str,
    key: str,
    build: Callable[[], DataFrame],
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """``build()`` as Parquet in the shared folder, written at its first use only."""

    def write(path: str) -> None:
        build().write.partitionBy(*partition_by).parquet(path)

    return spark.read.parquet(kept_path(spark, name, key, write))


def kept_buckets(
    spark: SparkSession,
    name: str,
    key: str,
    build: Callable[[], DataFrame],
    by: str,
    buckets: int,
) -> DataFrame:
    """``kept_table`` in buckets of the column ``by``, sorted by it within each.

    Rows are dealt to the buckets before the write, so each bucket is one file. Groupings,
    windows and joins on ``by`` and any further columns read the buckets in place.
    """

    def write(path: str) -> None:
        table = f"building_{uuid.uuid4().hex}"
        dealt = build().repartition(buckets, by)
        dealt.write.option("path", path).bucketBy(buckets, by).sortBy(by).saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")  # the name only

    key = f"{key}-{buckets}"
    path = kept_path(spark, name, key, write)
    table = f"kept_{name}_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
    if not spark.catalog.tableExists(table):
        columns = spark.read.parquet(path).schema.toDDL()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
            f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(table)
