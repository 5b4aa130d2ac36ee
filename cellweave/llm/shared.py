"""Helpers that several operators of this folder use."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; where that is unset (tests), a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="cellweave-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def pin(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read again: cuts lineage, and
    later steps read it instead of computing it once more."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of texts that a Python worker gets at a time, about; a longer text stands alone.
BATCH = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bytes(setting: str) -> int:
    """The bytes of a setting such as 64m or 67108864b."""
    number, unit = re.match(r"(\d+)([kmg]?)", setting.strip().lower()).groups()
    return int(number) << 10 * " kmg".index(unit or " ")


@contextmanager
def text_batches(spark: SparkSession):
    """What runs meanwhile hands texts to Python workers in Arrow batches of `BATCH` bytes.

    Spark's own batches of 64 MB are held several times over, by the executor and by each of its
    workers. A lower limit of the session stays; its setting is put back in the end.
    """
    before = spark.conf.get(BATCH_SETTING)
    if _bytes(before) > BATCH:
        spark.conf.set(BATCH_SETTING, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def pin_texts(df: DataFrame) -> DataFrame:
    """`pin` of what Python workers make of texts, which come to them in small batches."""
    with text_batches(df.sparkSession):
        return pin(df)


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for the small tables of an iteration."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(name: str, taken) -> str:
    """`name`, made longer until no column of `taken` has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def crc_of_id(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))


#: Bits of `maybe_in` for each key, and of one row of its bitmap.
KEY_BITS, ROW_BITS = 16, 1 << 15


def maybe_in(df: DataFrame, key, keys: DataFrame, name: str) -> DataFrame:
    """`df` with `name`: false where the hash `key` is surely none of `keys` (one column of such hashes).

    A bitmap of two bytes for each key goes to every task; of the other rows about one in
    `KEY_BITS` is true as well. Rows of long texts then move only where a join may need them.
    """
    rows = max(1, -(-KEY_BITS * keys.count() // ROW_BITS))

    def place(hashed):
        at = F.pmod(hashed, F.lit(rows * ROW_BITS).cast("long"))
        return F.shiftright(at, ROW_BITS.bit_length() - 1), at.bitwiseAND(F.lit(ROW_BITS - 1).cast("long"))

    row, bits = free_name("bitmap_row", df.columns), free_name("bitmap", df.columns)
    own, at = place(F.col(keys.columns[0]))
    bitmap = keys.select(own.alias(row), at.alias("at")).groupBy(row).agg(F.bitmap_construct_agg("at").alias(bits))
    own, at = place(key)
    byte = F.substring(F.col(bits), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))
    bit = F.lit(1).cast("long") * F.pow(F.lit(2.0), at.bitwiseAND(F.lit(7).cast("long"))).cast("long")
    held = F.conv(F.hex(byte), 16, 10).cast("long").bitwiseAND(bit) != 0
    return (
        df.join(F.broadcast(bitmap), own == F.col(row), "left")
        .withColumn(name, F.coalesce(held, F.lit(False)))
        .drop(row, bits)
    )


def join_few(df: DataFrame, keys: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """`df` joined with `keys` (a pinned table), `inner` or `left_semi`, on columns of the
    same types; rows of `df` that surely meet none are dropped where they are read."""
    name, few = free_name("maybe", df.columns), F.xxhash64(*on)
    return maybe_in(df, few, keys.select(few.alias(name)), name).where(F.col(name)).drop(name).join(keys, on, how)


def running_total(df: DataFrame, order, value: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over all rows before this one in `order`.

    Rows are dealt by ranges of `order`, summed within each range, and the totals of
    the ranges (one row for each partition) are summed on top: no task sees all rows.
    """
    ranged = pin(
        df.repartitionByRange(*([order] if not isinstance(order, list) else order))
        .withColumn("_part", F.spark_partition_id())
    )
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = totals.select(
        "_part",
        (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"),
    )
    order = order if isinstance(order, list) else [order]
    within = F.sum(value).over(
        Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        ranged.withColumn("_within", within - F.col(value))
        .join(before, "_part")
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_part", "_before", "_within")
    )


def by_group(work, keys: tuple[str, ...], names: tuple[str, ...]):
    """A map over Arrow batches of rows that come sorted by `keys`: `work` on each group's
    columns of more than one row, and its columns `names` of longs.

    `work` gets arrays; a column of lists of equal length becomes a matrix. Groups are cut
    out of whole batches, which costs less than a call from Spark for each.
    """

    def column(chunks):
        whole = pa.chunked_array(chunks)
        if pa.types.is_list(whole.type):
            return whole.combine_chunks().flatten().to_numpy().reshape(len(whole), -1)
        return whole.to_numpy()

    def emit(held):
        columns = {name: column([h.column(name) for h in held]) for name in held[0].schema.names}
        edge = np.zeros(sum(map(len, held)) - 1, bool)
        for k in keys:
            edge |= columns[k][1:] != columns[k][:-1]
        bounds = [0, *(np.flatnonzero(edge) + 1).tolist(), len(edge) + 1]
        out = [
            work({k: v[low:high] for k, v in columns.items()})
            for low, high in zip(bounds[:-1], bounds[1:], strict=True)
            if high - low > 1
        ]
        return pa.RecordBatch.from_pydict(
            {n: pa.array(np.concatenate([o[n] for o in out]) if out else [], pa.int64()) for n in names}
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            tail = np.logical_and.reduce([(c := batch.column(k).to_numpy()) == c[-1] for k in keys])
            cut = len(batch) - int(np.argmin(tail[::-1])) if not tail.all() else 0
            if cut:
                yield emit([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            else:
                if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
                    yield emit(held)
                    held = []
                held.append(batch)
        if held:
            yield emit(held)

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every id on an edge; component_id is the smallest id reachable.

    Alternating large-star and small-star rounds. Neighbourhoods are never collected:
    each round takes a minimum per node (combined on the map side) and joins it back.
    """
    edges = checkpoint(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct()
    )
    state = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or not seen[0]:
            break
        state = tuple(seen)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(
            small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
    pairs = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return pairs.union(roots)
