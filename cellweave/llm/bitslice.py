"""Exact top-k search by inner product on a bit-sliced index.

Vectors become integers. The index holds them in blocks of rows; of each component a few
high bits are kept as bitmaps over the block's rows, one per bit. A query, quantised to a
few bits as well, adds up the slices of all components by bitmap arithmetic (carry-save
adders over whole bitmaps), which gives the slices of an approximate score. Walking these
from the most significant one downward selects the k-th best approximate score. All rows
within twice the block's error bound of it, again found slice by slice, are the boundary
rows: only they are scored exactly, so that the result is exact.

Every query goes to every index block, never the index to the queries: a task gets a
block's rows first, builds its slices once, and streams the queries by it. The best k of
each block are merged per query. No task holds more than one block and some queries.

Cases: vectors that are null, empty or hold null or non-finite components take no part;
vectors of other lengths score only among themselves; a repeated id takes part once, with
its least vector; ties go to smaller ids; an empty table gives an empty result; other
columns are not read. Components must be small enough for scores to fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import pin

K = 10
SCALE = 1024
#: Rows of an index block, and queries whose results a task hands on together.
ROWS = 16_384
QUERIES = 256
#: Bits kept of each component of rows and of queries.
ROW_BITS = 6
QUERY_BITS = 5


class Block:
    """The bit-sliced index of some rows."""

    def __init__(self, values: np.ndarray):
        self.values = values
        low, high = int(values.min()), int(values.max())
        self.shift = max(0, (high - low).bit_length() - ROW_BITS)
        coarse = (values - low) >> self.shift
        rest = values - low - (coarse << self.shift)
        self.rest = float(np.sqrt(((rest - rest.mean(0)) ** 2).sum(1).max()))
        self.spread = float(np.sqrt(((coarse - coarse.mean(0)) ** 2).sum(1).max()))
        words = -(-len(values) // 64)
        bits = np.zeros((values.shape[1], ROW_BITS, words * 64), np.uint8)
        for b in range(ROW_BITS):
            bits[:, b, : len(values)] = (coarse.T >> b) & 1
        self.slices = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)
        self.rows = np.packbits(
            (np.arange(words * 64) < len(values)).astype(np.uint8), bitorder="little"
        ).view(np.uint64)

    def add(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the sum of weight * component, up to a constant.

        A negative weight adds the complement of the component's slices.
        """
        columns: dict[int, list[np.ndarray]] = {}
        signed = self.slices ^ np.where(weights < 0, ~np.uint64(0), np.uint64(0))[:, None, None]
        size = np.abs(weights)
        for digit in range(int(size.max(initial=0)).bit_length()):
            has = np.flatnonzero(size >> digit & 1)
            for b in range(ROW_BITS):
                columns.setdefault(digit + b, []).append(signed[has, b])
        out, at = [], 0
        while at <= max(columns, default=-1):
            held = columns.pop(at, [])
            layer = np.concatenate(held) if held else np.zeros((0, len(self.rows)), np.uint64)
            carries = []
            while len(layer) > 1:
                third = len(layer) // 3
                if third:
                    a, b, c = layer[:third], layer[third : 2 * third], layer[2 * third : 3 * third]
                    odd = a ^ b
                    carries.append((a & b) | (odd & c))
                    layer = np.concatenate([odd ^ c, layer[3 * third :]])
                else:
                    carries.append(layer[:1] & layer[1:])
                    layer = layer[:1] ^ layer[1:]
            out.append(layer[0] if len(layer) else np.zeros(len(self.rows), np.uint64))
            if carries:
                columns.setdefault(at + 1, []).extend(carries)
            at += 1
        return out

    def kth(self, total: list[np.ndarray], k: int) -> int:
        """The k-th largest sum, from the most significant slice downward."""
        sure, equal, value = np.zeros_like(self.rows), self.rows.copy(), 0
        for s in reversed(total):
            value <<= 1
            tried = sure | (equal & s)
            if int(np.bitwise_count(tried).sum()) >= k:
                equal &= s
                value |= 1
            else:
                sure = tried
                equal &= ~s
        return value

    def at_least(self, total: list[np.ndarray], bound: int) -> np.ndarray:
        """Numbers of the rows whose sum is `bound` or more."""
        above, equal = np.zeros_like(self.rows), self.rows.copy()
        if bound > 0:
            if bound.bit_length() > len(total):
                return np.zeros(0, np.int64)
            for at in range(len(total) - 1, -1, -1):
                if bound >> at & 1:
                    equal &= total[at]
                else:
                    above |= equal & total[at]
                    equal &= ~total[at]
        hit = (above | equal).view(np.uint8)
        return np.flatnonzero(np.unpackbits(hit, bitorder="little"))

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Numbers of all rows that can be among the k best."""
        if len(self.values) <= k:
            return np.arange(len(self.values))
        shift = max(0, int(np.abs(query).max()).bit_length() - QUERY_BITS)
        weights = np.rint(query / float(1 << shift)).astype(np.int64)
        total = self.add(weights)
        # |score - unit * sum - constant| is at most this, by Cauchy-Schwarz on both rests
        error = float(np.linalg.norm(query)) * self.rest + float(1 << self.shift) * float(
            np.linalg.norm(query - (weights << shift))
        ) * self.spread
        unit = float(1 << (shift + self.shift))
        return self.at_least(total, self.kth(total, k) - int(2 * error / unit) - 1)


def best_of(block: Block, ids: np.ndarray, query_id: int, query: np.ndarray, k: int):
    """(ids, scores) of the k best rows other than the query's own, exactly."""
    rows = block.candidates(query, k + 1)
    rows = rows[ids[rows] != query_id]
    scores = block.values[rows] @ query
    order = np.lexsort((ids[rows], -scores))[:k]
    return ids[rows][order], scores[order]


MET = "query_id long, vec_id long, score long"


def matrix(values: pa.Array) -> np.ndarray:
    return values.flatten().to_numpy().reshape(len(values), -1)


def runs(batch: pa.RecordBatch, size: int):
    """(key, whether queries, ids, values) of at most `size` neighbouring rows of one block and side."""
    key = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("dimension", "row_block", "asks")])
    edges = (key[:, 1:] != key[:, :-1]).any(0)
    bounds = [0, *(np.flatnonzero(edges) + 1).tolist(), len(batch)]
    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        for low in range(start, end, size):
            some = batch.slice(low, min(size, end - low))
            yield tuple(key[:2, low]), bool(key[2, low]), some["vec_id"].to_numpy(), matrix(some["v"])


def meet(k: int, size: int):
    """A map over Arrow batches that come sorted by block, its rows first, then the queries."""

    def run(batches):
        at, held, block, ids = None, [], None, None
        for batch in batches:
            for key, asks, got, values in runs(batch, size) if len(batch) else ():
                if key != at:
                    at, held, block = key, [], None
                if not asks:
                    held.append((got, values))
                    continue
                if block is None and held:
                    ids, whole = (np.concatenate(part) for part in zip(*held, strict=True))
                    block, held = Block(whole), []
                if block is None:  # no row of these queries' length
                    continue
                best = [best_of(block, ids, i, q, k) for i, q in zip(got.tolist(), values, strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": np.repeat(got, [len(b[0]) for b in best]),
                        "vec_id": np.concatenate([b[0] for b in best]),
                        "score": np.concatenate([b[1] for b in best]),
                    }
                )

    return run


def search(table: DataFrame, is_query, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` best rows for each row where `is_query` holds."""
    sound = (F.size("embedding") > 0) & F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    clear = pin(
        table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(sound)
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.transform("embedding", lambda v: F.floor(v.cast("double") * scale)).alias("v"),
        )
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
        .withColumn("dimension", F.size("v"))
    )
    blocks = max(1, -(-clear.count() // ROWS))
    key = ("dimension", "row_block", "asks")
    index = clear.withColumn("row_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks).cast("long")))
    asked = clear.where(is_query).withColumn(
        "row_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )
    met = (
        index.withColumn("asks", F.lit(0))
        .unionByName(asked.withColumn("asks", F.lit(1)))
        .repartition("dimension", "row_block")
        .sortWithinPartitions(*key)
        .mapInArrow(meet(k, QUERIES), MET)
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
