"""Embedding near-duplicates by lattice hashing.

Each table projects the unit vectors at random to eight dimensions and decodes them to the
nearest point of the E8 lattice. A vector is stored under its home cell and asks in the
home cell and in the neighbouring cells whose points come next nearest. Every pair met is
verified by cosine in double precision. Cells are kept apart by label.

Equal vectors of a label are joined into one representative with a count first. A cell
with many vectors is split into blocks, and pairs of blocks are compared in tasks of their
own. Pairs are never emitted: a task returns for each vector how many links it found (a
pair counts in the first table only in which it meets) and a spanning star of the links'
local components, which are joined over the corpus afterwards.

Cases: a null label, a null, empty or zero vector, and one that holds null or non-finite
components link with nothing and are kept; vectors of other lengths never meet; repeated
ids stand for one vector, the least; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_group, components, pin

COSINE = 0.93
TABLES = 5
#: Neighbouring cells asked besides the home cell.
PROBES = 3
#: Scale of the projection in units of the lattice: near-duplicates at the least cosine
#: then lie about 0.67 apart, against a packing radius of 0.71. A pair at cosine 0.93
#: meets in a table with probability 0.69 and in any with 0.9988, one at 0.3 with 0.06.
SCALE = 1.8
#: Vectors of a block.
BLOCK = 512
SEED = 20_260_801


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: what lies around a lattice point."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1.0, -1.0):
                for b in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        signs = np.array([1.0 if bits >> k & 1 else -1.0 for k in range(8)])
        if (signs < 0).sum() % 2 == 0:
            out.append(signs / 2)
    return np.array(out)


def nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest points of D8: integer vectors with an even sum."""
    r = np.rint(x)
    odd = np.rint(r.sum(1)) % 2 != 0
    off = x - r
    worst = np.abs(off).argmax(1)
    rows = np.flatnonzero(odd)
    step = np.where(off[rows, worst[rows]] >= 0, 1.0, -1.0)
    r[rows, worst[rows]] += step
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 (D8 and D8 moved by one half) to each row."""
    a = nearest_even(x)
    b = nearest_even(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(1) < ((x - a) ** 2).sum(1)
    return np.where(closer[:, None], b, a)


def cell_codes(points: np.ndarray) -> np.ndarray:
    """One 64-bit number for each lattice point (a polynomial hash of the doubled coordinates)."""
    code = np.zeros(len(points), np.uint64)
    for k in range(8):
        code = (code ^ np.rint(2 * points[:, k]).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code.view(np.int64)


def projection(dimension: int, table: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, dimension, table])
    return rng.standard_normal((dimension, 8)) * (SCALE / np.sqrt(8))


def hash_cells(unit: np.ndarray) -> np.ndarray:
    """(rows, tables, 1 + probes): the home cell and the cells to ask besides."""
    around = minimal_vectors()
    out = np.zeros((len(unit), TABLES, 1 + PROBES), np.int64)
    for t in range(TABLES):
        x = unit @ projection(unit.shape[1], t)
        home = decode(x)
        out[:, t, 0] = cell_codes(home)
        gain = (x - home) @ around.T
        near = np.argpartition(-gain, PROBES, axis=1)[:, :PROBES]
        for p in range(PROBES):
            out[:, t, 1 + p] = cell_codes(home + around[near[:, p]])
    return out


def salt(dimension: int, table: int) -> np.int64:
    """Keeps the cells of tables, and of vectors of other lengths, apart."""
    return np.int64((dimension * 64 + table) * 0x5851F42D4C957 & (1 << 62) - 1)


ENTRY = "label long, rep long, n long, vector binary, cells binary, buckets array<long>"
#: Vectors that are hashed together.
HASHED = 1024


def entries(batches):
    """Rows of (label, rep, n, embedding) with their cells: for each table the bucket where
    a row is stored and those where it asks besides."""
    for pdf in batches:
        for low in range(0, len(pdf), HASHED):
            some = pdf.iloc[low : low + HASHED]
            for dimension, part in some.groupby(some["embedding"].map(len)):
                vectors = np.stack(part["embedding"].to_numpy())
                unit = vectors.astype(np.float64)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                cells = hash_cells(unit)
                salts = np.array([salt(dimension, t) for t in range(TABLES)])
                yield pd.DataFrame(
                    {
                        "label": part["label"].to_numpy(),
                        "rep": part["rep"].to_numpy(),
                        "n": part["n"].to_numpy(),
                        "vector": [v.tobytes() for v in vectors.astype(np.float32)],
                        "cells": [c.tobytes() for c in cells],
                        "buckets": list((cells ^ salts[:, None]).reshape(len(cells), -1)),
                    }
                )


LINKS = "rep long, links long, low long"


def compare(least: float):
    """A function of one pair of blocks of a cell: links and local components of its rows."""
    nothing = {k: np.zeros(0, np.int64) for k in ("rep", "links", "low")}

    def run(rows):
        first, second, bucket = rows["first"][0], rows["second"][0], rows["bucket"][0]
        order = np.argsort(rows["rep"], kind="stable")
        rep, n, block, home = (rows[k][order] for k in ("rep", "n", "block", "home"))
        vectors, cells = rows["vector"][order], rows["cells"][order]
        own, others = np.flatnonzero(block == first), np.flatnonzero(block == second)
        if not len(own) or not len(others) or not home.any():
            return nothing
        x = np.stack([np.frombuffer(v, np.float32) for v in vectors]).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        cells = np.stack([np.frombuffer(c, np.int64) for c in cells]).reshape(len(x), TABLES, 1 + PROBES)
        salts = np.array([salt(x.shape[1], t) for t in range(TABLES)])
        table = int(np.flatnonzero((cells[0] ^ salts[:, None] == bucket).any(1))[0])
        # a vector asks in a cell once, at home or from next door: rows are distinct by rep
        near = x[own] @ x[others].T >= least
        near &= home[own][:, None] | home[others][None, :]
        if first == second:
            near &= own[:, None] < others[None, :]
        i, j = np.nonzero(near)
        if not len(i):
            return nothing
        i, j = own[i], others[j]
        met = np.zeros(len(i), bool)
        for t in range(table):
            a, b = cells[i, t], cells[j, t]
            met |= (a[:, :1] == b).any(1) | (b[:, :1] == a).any(1)
        # in one table two vectors can meet in the home cells of both: the smaller's counts
        a, b = np.minimum(i, j), np.maximum(i, j)
        met |= ~home[a] & (cells[a, table, :1] == cells[b, table]).any(1)
        i, j = i[~met], j[~met]
        links = np.zeros(len(rep), np.int64)
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        low = np.arange(len(rep))
        while True:
            after = low.copy()
            np.minimum.at(after, i, low[j])
            np.minimum.at(after, j, low[i])
            after = after[after]
            if (after == low).all():
                break
            low = after
        some = links > 0
        return {"rep": rep[some], "links": links[some], "low": rep[low[some]]}

    return run


def near_duplicates(table: DataFrame, least: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of `table` (vec_id, embedding, label)."""
    vector = F.transform("embedding", lambda v: v.cast("float"))
    sound = (
        F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists("embedding", lambda v: v != 0)
    )
    rows = table.select("vec_id", F.col("label").cast("long").alias("label"), vector.alias("embedding"), F.coalesce(sound, F.lit(False)).alias("sound"))
    clear = (
        rows.where("sound and vec_id is not null")
        .groupBy("vec_id")
        .agg(F.min(F.struct("label", "embedding")).alias("v"))
        .select("vec_id", "v.*")
    )
    keyed = clear.withColumn("key", F.sha2(F.to_json(F.struct("embedding")).cast("binary"), 256))
    reps = pin(
        keyed.groupBy("label", "key").agg(
            F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding")
        )
    )
    members = keyed.select("vec_id", "label", "key").join(reps.select("label", "key", "rep", "n"), ["label", "key"])
    stored = pin(
        reps.select("label", "rep", "n", "embedding")
        .repartition("rep")
        .mapInPandas(entries, ENTRY)
    )
    # a row for each cell is small; vectors join those of cells where something can meet
    asked = stored.select("label", "rep", F.posexplode("buckets").alias("at", "bucket")).select(
        "label", "rep", "bucket", (F.col("at") % (1 + PROBES) == 0).alias("home")
    )
    sizes = asked.groupBy("label", "bucket").agg(F.count("*").alias("size"), F.count_if("home").alias("homes")).where("size > 1 and homes > 0")
    blocked = (
        asked.join(sizes.select("label", "bucket", F.ceil(F.col("size") / BLOCK).alias("blocks")), ["label", "bucket"])
        .join(stored.select("rep", "n", "vector", "cells"), "rep")
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("first", F.least("block", "other"))
        .withColumn("second", F.greatest("block", "other"))
        .drop("other", "blocks")
    )
    key = ("label", "bucket", "first", "second")
    found = pin(
        blocked.repartition(*key)
        .sortWithinPartitions(*key)
        .mapInArrow(by_group(compare(least), key, ("rep", "links", "low")), LINKS)
    )
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    out = (
        members.join(counts, "rep", "left")
        .join(joined.withColumnRenamed("id", "rep"), "rep", "left")
        .select(
            "vec_id",
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
            F.coalesce("component_id", "rep").alias("component_id"),
        )
    )
    return rows.join(out, "vec_id", "left").select(
        "vec_id",
        F.when(F.col("sound"), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
