import hashlib
import math
import random

import numpy as np
import pytest
from llm_fixtures import DATA

from cellweave.llm import va_clusters

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=16, rounds=3, dims=64, scale=64):
    """[(vec_id, cluster, distance)] and the centroids, in Python integers."""
    kept = [
        (i, [math.floor(scale * float(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [q for _, q in sorted(((name(i), q) for i, q in kept))[:k]]
    def assign():
        out = []
        for i, q in kept:
            found = [sum((a - b) ** 2 for a, b in zip(q, c, strict=True)) for c in centroids]
            out.append((i, found.index(min(found)), min(found)))
        return out
    for _ in range(rounds):
        got = assign()
        for c in range(len(centroids)):
            own = [q for (_, q), (_, at, _) in zip(kept, got, strict=True) if at == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return assign(), centroids


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got, centroids = va_clusters.cluster(df, **options)
    return sorted(map(tuple, got.collect()), key=repr), centroids.tolist()


def check(spark, rows, **options):
    got, centroids = found(spark, rows, **options)
    expected, wanted = brute(rows, **{k: v for k, v in options.items() if k not in ("bits", "report")})
    assert got == sorted(expected, key=repr) and centroids == wanted
    return got


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    expected, centroids = brute(rows)
    got = sorted(map(tuple, va_clusters.query(spark, DATA).collect()))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = {c: sum(d for _, at, d in expected if at == c) for c in range(16)}
    assert got == sorted((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in expected)


def test_few_vectors_are_fetched(spark):
    """Well separated clusters are decided on the cells; one cell more or less is not."""
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(8, 64)) / 2
    rows = [(i, (middles[i % 8] + rng.normal(size=64) / 100).astype(np.float32).tolist()) for i in range(2000)]
    report = {}
    got = check(spark, rows, k=8, report=report, bits=4)
    assert len(got) == 2000 and report[0] == (2000, 2000)  # the first sums need every vector
    assert report[2][1] < 400


def test_bounds_hold_for_any_cells(spark):
    rng = np.random.default_rng(1)
    q = rng.integers(-40, 40, (300, 8))
    for bits in (1, 2, 5):
        upper = np.sort(rng.integers(-40, 40, (8, 1 << bits)), axis=1)
        upper[:, -1] = 40
        lower = np.concatenate([np.full((8, 1), -40), upper[:, :-1] + 1], axis=1)
        cells = np.stack([np.searchsorted(upper[d], q[:, d]) for d in range(8)], axis=1)
        assert (va_clusters.unpack(va_clusters.pack(cells, bits), 8, bits) == cells).all()
        centroids = rng.integers(-40, 40, (5, 8))
        least, most = va_clusters.bounds(cells, lower, upper, centroids)
        true = ((q[:, None, :] - centroids) ** 2).sum(axis=2)
        assert (least <= true).all() and (true <= most).all()
        assert va_clusters.candidates(cells, lower, upper, centroids)[np.arange(300), true.argmin(axis=1)].all()


@pytest.mark.parametrize("bits", [1, 3])
def test_odd_rows(spark, bits):
    """Nulls, wrong sizes, non-finite components, repeated rows and ids, ties, one hot vector."""
    r = random.Random(3)
    vector = lambda n=64: [r.uniform(-0.5, 0.5) for _ in range(n)]
    hot = vector()
    rows = [(1, None), (2, []), (3, vector(63)), (4, vector(65)), (5, [None, *vector(63)]), (6, [float("nan"), *vector(63)]),
            (7, [float("inf"), *vector(63)]), (None, vector()), (None, vector()), (8, vector()), (8, vector()),
            *[(20 + i, hot) for i in range(60)], *[(100, hot)] * 5, *[(200 + i, vector()) for i in range(50)]]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert len(check(spark, rows, bits=bits)) == len(rows) - 7


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(i, [float(i)] * 64) for i in (3, 1, 2)]
    check(spark, rows)
    check(spark, [(1, [0.5] * 64)] * 2)
    assert found(spark, [(1, None)]) == ([], [])
    empty = va_clusters.summarised(spark, *va_clusters.cluster(spark.createDataFrame([], SCHEMA)))
    assert empty.count() == 0 and empty.columns[-1] == "centroid_sha256"


def test_clashing_columns_and_doubles(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(40)]
    names = ("row", "q", "cells", "cluster", "open", "distance", "sums", "count")
    df = spark.createDataFrame([(*r, *["x"] * 8) for r in rows], "vec_id long, embedding array<double>, " + ", ".join(f"{n} string" for n in names))
    got, _ = va_clusters.cluster(df)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows)[0])


def test_sizes_beyond_the_bound_are_named(spark):
    df = spark.createDataFrame([(1, [3.0e9] * 64, 0), (2, [0.0] * 64, 0)], SCHEMA)
    with pytest.raises(ValueError, match="components beyond"):
        va_clusters.cluster(df)
