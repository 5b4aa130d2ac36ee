"""Centroid clustering over a vector-approximation file.

Integer vectors are clustered by a fixed number of Lloyd rounds. Each dimension is cut
into 2**bits cells that hold about equally many vectors (percentiles over all vectors),
and a vector's cells, packed to `bits` bits a dimension, make its row of the approximation
file. For each round two lookup tables hold the least and the largest square that a
component of a cell can be away from a centroid's; their sums over the dimensions bound
the distance of a vector to each centroid. Where one centroid's largest distance is below
all others' least, the vector is decided without being read. Full vectors are fetched only
where intervals overlap, or where a vector changes its cluster: sums of clusters are kept
and moved vectors taken from one and added to the other, in exact integers. The last
assignment fetches all, for the distances that are returned.

Spark deals vectors to buckets by a row number that the first step writes. The
approximation rows travel through the rounds as a small table in the shared folder; what
is fetched meets the bucketed vectors without moving them. Sums are combined in each task
before they are added up; the driver gets one row for each centroid and no more.

Cases: vectors that are null, hold null or non-finite components or another number of
them take no part; repeated rows and ids are vectors of their own; among equal distances
the smaller centroid wins; equal ids fight for a place among the first centroids in the
order of their components; a null id counts as empty text there; with fewer vectors than
centroids there are as many centroids as vectors; an empty table gives an empty result;
other columns are not read. Components beyond +-2**27 (after scaling) raise an error:
their squared distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.sources.tables import save_bucketed

from .shared import pin, shared_folder

#: Largest size of a component: 64 squares of its double fit into 62 bits.
LARGEST = 1 << 27


def integer_vectors(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, q): the vectors that take part, components as floor(scale * x)."""
    wide = F.col("embedding").cast("array<double>")
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    q = F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))))
    return rows.where(wide.isNotNull() & (F.size(wide) == dims) & sound).select("vec_id", q.alias("q"))


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The vectors of the k smallest hashes of their ids: k rows reach the driver."""
    name = F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    found = vectors.orderBy(F.sha2(name, 256), "q").limit(k).select("q").collect()
    return np.array([r.q for r in found], np.int64)


def cell_edges(vectors: DataFrame, dims: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last): the least and the largest component of each cell, dims x 2**bits.

    Any edges give right results; percentiles make the cells equally full. The outer cells
    end at the true extremes.
    """
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    columns = [F.col("q")[d].alias(f"c{d}") for d in range(dims)]
    found = vectors.select(*columns).agg(
        *[F.percentile_approx(f"c{d}", steps, 2000).alias(f"p{d}") for d in range(dims)],
        *[F.min(f"c{d}").alias(f"l{d}") for d in range(dims)],
        *[F.max(f"c{d}").alias(f"h{d}") for d in range(dims)],
    ).first()
    upper = np.array([[*found[f"p{d}"], found[f"h{d}"]] for d in range(dims)], np.int64)
    if abs(upper).max() > LARGEST or min(found[f"l{d}"] for d in range(dims)) < -LARGEST:
        raise ValueError(f"components beyond +-{LARGEST} after scaling")
    upper = np.maximum.accumulate(upper, axis=1)
    lower = np.concatenate([[[found[f"l{d}"]] for d in range(dims)], upper[:, :-1] + 1], axis=1)
    return lower, upper  # a cell whose first is above its last is empty


def pack(cells: np.ndarray, bits: int) -> np.ndarray:
    """Cells (n x dims) as n rows of bits * dims / 8 bytes."""
    planes = (cells[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1
    return np.packbits(planes.reshape(len(cells), -1).astype(np.uint8), axis=1)


def unpack(packed: np.ndarray, dims: int, bits: int) -> np.ndarray:
    planes = np.unpackbits(packed, axis=1)[:, : dims * bits].reshape(len(packed), dims, bits)
    return (planes << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.int64)


def bounds(cells: np.ndarray, lower: np.ndarray, upper: np.ndarray, centroids: np.ndarray):
    """(least, most): bounds of the squared distance of each row to each centroid."""
    c = centroids.T[:, None, :]  # dims x 1 x k
    low, high = lower[:, :, None], upper[:, :, None]
    near = np.maximum(np.maximum(low - c, c - high), 0) ** 2  # dims x cells x k
    far = np.maximum(np.abs(low - c), np.abs(high - c)) ** 2
    least = np.zeros((len(cells), len(centroids)), np.int64)
    most = np.zeros_like(least)
    for d in range(cells.shape[1]):
        least += near[d][cells[:, d]]
        most += far[d][cells[:, d]]
    return least, most


def candidates(cells, lower, upper, centroids) -> np.ndarray:
    """Which centroids can be the nearest of each row: n x k of truth values.

    One that may tie with a better bound stays, so that ties are resolved on full vectors.
    """
    least, most = bounds(cells, lower, upper, centroids)
    return least <= most.min(axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _bytes(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1)


def _lists(mask: np.ndarray) -> pa.Array:
    """Rows of truth values as lists of the positions that are true."""
    offsets = np.concatenate([[0], mask.sum(axis=1).cumsum()])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.nonzero(mask)[1], pa.int32()))


def nearest(q: np.ndarray, centroids: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) in exact integers among the centroids that `mask` leaves."""
    distance = np.full(mask.shape, np.iinfo(np.int64).max)
    for c in range(len(centroids)):
        rows = np.flatnonzero(mask[:, c])
        distance[rows, c] = ((q[rows] - centroids[c]) ** 2).sum(axis=1)
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(q)), best]


SLICE = 2048


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.slice(at, SLICE)


class VectorFile:
    """Vectors in buckets and their approximations, with the current cluster of each row."""

    def __init__(self, vectors: DataFrame, dims: int, bits: int):
        spark = vectors.sparkSession
        self.spark, self.dims, self.bits = spark, dims, bits
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"va_{uuid.uuid4().hex}"
        self.vectors = save_bucketed(
            vectors.withColumn("row", F.monotonically_increasing_id()).repartition(self.buckets, "row"),
            name, ["row"], self.buckets, path=f"{shared_folder(spark)}/{name}",
        )
        spark.sql(f"DROP TABLE {name}")  # the name only: the files and this DataFrame stay
        self.lower, self.upper = cell_edges(self.vectors, dims, bits)
        self.state = pin(self._approximate())

    def _approximate(self) -> DataFrame:
        """(row, cells, cluster): all vectors, of no cluster yet (-1)."""
        dims, bits, upper = self.dims, self.bits, self.upper

        def work(batches):
            for batch in _sliced(batches):
                q = _matrix(batch.column("q"), dims)
                cells = np.stack([np.searchsorted(upper[d], q[:, d]) for d in range(dims)], axis=1)
                packed = [r.tobytes() for r in pack(cells, bits)]
                none = np.full(len(batch), -1, np.int32)
                yield pa.RecordBatch.from_pydict(
                    {"row": batch.column("row"), "cells": pa.array(packed, pa.binary()), "cluster": pa.array(none)}
                )

        return self.vectors.select("row", "q").mapInArrow(work, "row long, cells binary, cluster int")

    def judged(self, centroids: np.ndarray) -> DataFrame:
        """The state with `open`: the centroids whose intervals overlap, one if decided."""
        dims, bits, lower, upper = self.dims, self.bits, self.lower, self.upper

        def work(batches):
            for batch in _sliced(batches):
                cells = unpack(_bytes(batch.column("cells")), dims, bits)
                mask = candidates(cells, lower, upper, centroids)
                yield pa.RecordBatch.from_arrays([*batch.columns, _lists(mask)], [*batch.schema.names, "open"])

        return self.state.mapInArrow(work, "row long, cells binary, cluster int, open array<int>")

    def fetched(self, rows: DataFrame, *columns: str) -> DataFrame:
        """`rows` with their full vectors, which stay in their buckets."""
        return rows.join(self.vectors.select("row", "q", *columns), "row")

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Give every row its nearest centroid: (change of the clusters' sums, of their counts,
        how many vectors were fetched)."""
        dims, k = self.dims, len(centroids)
        judged = pin(self.judged(centroids))
        decided = (F.size("open") == 1) & (F.col("open")[0] == F.col("cluster"))

        def work(batches):
            sums, counts, seen = np.zeros((k, dims), object), np.zeros(k, np.int64), 0
            for batch in _sliced(batches):
                q, mask = _matrix(batch.column("q"), dims), _mask(batch.column("open"), k)
                old = batch.column("cluster").to_numpy()
                best, _ = nearest(q, centroids, mask)
                for c in range(k):
                    enter, leave = best == c, old == c
                    sums[c] += q[enter].sum(axis=0) - q[leave].sum(axis=0)
                    counts[c] += enter.sum() - leave.sum()
                seen += len(batch)
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": batch.column("row"), "cells": batch.column("cells"), "cluster": pa.array(best, pa.int32()),
                        "sums": pa.nulls(len(batch), pa.list_(pa.int64())), "count": pa.nulls(len(batch), pa.int64()),
                    }
                )
            if seen:
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": pa.nulls(k, pa.int64()), "cells": pa.nulls(k, pa.binary()), "cluster": pa.array(range(k), pa.int32()),
                        "sums": pa.array([list(map(int, s)) for s in sums], pa.list_(pa.int64())), "count": pa.array(counts),
                    }
                )

        schema = "row long, cells binary, cluster int, sums array<long>, count long"
        moved = pin(self.fetched(judged.where(~decided)).select("row", "cells", "cluster", "open", "q").mapInArrow(work, schema))
        wide = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]
        totals = moved.where("row is null").groupBy("cluster").agg(F.sum("count").alias("n"), *wide).collect()
        sums, counts = np.zeros((k, dims), object), np.zeros(k, object)
        for r in totals:
            sums[r.cluster], counts[r.cluster] = [int(r[f"s{d}"]) for d in range(dims)], int(r.n)
        named = ["row", "cells", "cluster"]
        self.state = judged.where(decided).select(*named).union(moved.where("row is not null").select(*named))
        return sums, counts, moved.where("row is not null").count()

    def distances(self, centroids: np.ndarray) -> DataFrame:
        """(vec_id, cluster, distance) of every row."""
        dims, k = self.dims, len(centroids)

        def work(batches):
            for batch in _sliced(batches):
                best, distance = nearest(_matrix(batch.column("q"), dims), centroids, _mask(batch.column("open"), k))
                yield pa.RecordBatch.from_pydict(
                    {"vec_id": batch.column("vec_id"), "cluster": pa.array(best, pa.int32()), "distance": pa.array(distance)}
                )

        joined = self.fetched(self.judged(centroids), "vec_id").select("open", "q", "vec_id")
        return joined.mapInArrow(work, "vec_id long, cluster int, distance long")


def _mask(column: pa.Array, k: int) -> np.ndarray:
    mask = np.zeros((len(column), k), bool)
    mask[column.value_parent_indices().to_numpy(), column.flatten().to_numpy()] = True
    return mask


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(
    rows: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, bits: int = 5, report: dict | None = None
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of the vectors of `rows` (vec_id, embedding), centroids).

    `report` is given the number of vectors and of those fetched in each round.
    """
    vectors = pin(integer_vectors(rows, dims, scale))
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        return vectors.selectExpr("vec_id", "cast(0 AS int) AS cluster", "cast(0 AS long) AS distance"), centroids
    file = VectorFile(vectors, dims, bits)
    sums, counts = np.zeros((len(centroids), dims), object), np.zeros(len(centroids), object)
    for at in range(rounds):
        more, changed, fetched = file.assign(centroids)
        sums, counts = sums + more, counts + changed
        centroids = np.array(
            [s // n if n else c for s, n, c in zip(sums, counts, centroids, strict=True)], np.int64
        )
        if report is not None:
            report[at] = (int(counts.sum()), fetched)
    return file.distances(centroids), centroids


def summarised(spark: SparkSession, found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`found` with the inertia of each cluster and of all, and the centroids' digests."""
    found = pin(found)
    own = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}  # a row for each centroid
    clusters = spark.createDataFrame(
        [(c, own[c], sum(own.values()), centroid_digest(x)) for c, x in enumerate(centroids) if c in own],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(clusters), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return summarised(spark, *cluster(rows))


def _sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds written out one after the other."""
    parts = [
        f"""kept AS (
    SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, q FROM kept
    QUALIFY cluster < {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""d{r} AS (
    SELECT uid, cluster, list_sum(list_transform(list_zip(kept.q, c{r}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance
    FROM kept, c{r}),
a{r} AS (SELECT uid, min(distance) AS distance, arg_min(cluster, (distance, cluster)) AS cluster FROM d{r} GROUP BY uid)"""
        )
        if r < rounds:
            parts.append(
                f"""m{r} AS (
    SELECT cluster, pos, CAST(sum(x) AS HUGEINT) AS total, count(*) AS n
    FROM (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS pos FROM a{r} JOIN kept USING (uid))
    GROUP BY cluster, pos),
c{r + 1} AS (
    SELECT c{r}.cluster, coalesce(moved.q, c{r}.q) AS q FROM c{r} LEFT JOIN (
        SELECT cluster, list(CAST((total - (((total % n) + n) % n)) // n AS BIGINT) ORDER BY pos) AS q FROM m{r} GROUP BY cluster
    ) moved USING (cluster))"""
            )
    last = rounds
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
    CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(distance) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c{last}.q, ',')) AS centroid_sha256
FROM a{last} JOIN kept USING (uid) JOIN c{last} USING (cluster)
"""


SQL = _sql()
