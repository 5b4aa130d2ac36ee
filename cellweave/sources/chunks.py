"""Array variables stored as chunks.

A chunk row holds one block of one variable:

    file string, var string, dims array<string>, starts array<int>,
    sizes array<int>, values array<double>

``values`` is in row-major order (the last dimension varies fastest) and
``starts`` are the 0-based grid indices of the first value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.lookup import attach_lookup

SCHEMA = (
    "file string, var string, dims array<string>, starts array<int>, "
    "sizes array<int>, values array<double>"
)


def _size(dims: Sequence[str], dim: str) -> Column:
    return F.col("sizes")[dims.index(dim)]


def _start(dims: Sequence[str], dim: str) -> Column:
    return F.col("starts")[dims.index(dim)]


def _stride(dims: Sequence[str], dim: str) -> Column:
    stride = F.lit(1)
    for inner in dims[dims.index(dim) + 1 :]:
        stride = stride * _size(dims, inner)
    return stride


def select_grid(chunks: DataFrame, dims: Sequence[str], variables: Sequence[str] = ()) -> DataFrame:
    """Chunks of the grid with this dimension signature, optionally of some variables."""
    signature = F.array(*[F.lit(d) for d in dims])
    grid = chunks.filter(F.col("dims") == signature)
    return grid.filter(F.col("var").isin(*variables)) if variables else grid


def chunk_rows(
    chunks: DataFrame, dims: Sequence[str], columns: Sequence[str] = ("values",)
) -> DataFrame:
    """Long rows: one per array position, with a grid index column per dimension.

    ``columns`` are parallel arrays of the chunk; each becomes a measure column.
    """
    zipped = F.col(columns[0]) if len(columns) == 1 else F.arrays_zip(*columns)
    carried = [c for c in chunks.columns if c not in {*columns, "dims", "var"}]
    rows = chunks.select(*carried, F.posexplode(zipped).alias("_pos", "_item"))
    index = {
        d: _start(dims, d)
        + F.floor(F.col("_pos") / _stride(dims, d)).cast("int") % _size(dims, d)
        for d in dims
    }
    if len(columns) == 1:
        measures = {"value" if columns[0] == "values" else columns[0]: F.col("_item")}
    else:
        measures = {c: F.col("_item")[c] for c in columns}
    kept = [c for c in carried if c not in ("starts", "sizes")]
    return rows.select(
        *kept,
        *[index[d].alias(d) for d in dims],
        *[c.alias(name) for name, c in measures.items()],
    )


def hyperslab(
    chunks: DataFrame, dims: Sequence[str], slab: Mapping[str, tuple[int, int]]
) -> DataFrame:
    """Long rows of the block given as ``{dim: (start, count)}`` in grid indices.

    Chunks outside the block are dropped before any array is opened, the
    leading dimension is cut with ``slice``, and only the inner dimensions are
    filtered row by row.
    """
    for dim, (start, count) in slab.items():
        first = _start(dims, dim)
        chunks = chunks.filter(
            (first < start + count) & (first + _size(dims, dim) > start)
        )
    lead = dims[0]
    if lead in slab:
        start, count = slab[lead]
        first, size, stride = _start(dims, lead), _size(dims, lead), _stride(dims, lead)
        low = F.greatest(first, F.lit(start))
        high = F.least(first + size, F.lit(start + count))
        chunks = chunks.withColumns(
            {
                "values": F.slice("values", (low - first) * stride + 1, (high - low) * stride),
                "starts": F.concat(F.array(low), F.slice("starts", 2, len(dims))),
                "sizes": F.concat(F.array(high - low), F.slice("sizes", 2, len(dims))),
            }
        )
    rows = chunk_rows(chunks, dims)
    for dim, (start, count) in slab.items():
        if dim != lead:
            rows = rows.filter(F.col(dim).between(start, start + count - 1))
    return rows


def variables_as_columns(
    chunks: DataFrame, dims: Sequence[str], variables: Sequence[str]
) -> DataFrame:
    """Several variables of one grid side by side.

    The chunks are paired while they are still arrays, so the shuffle moves one
    row per chunk and variable; the arrays are opened afterwards, in place.
    """
    block = ["file", "starts", "sizes"]
    paired = (
        select_grid(chunks, dims, variables)
        .groupBy(*block)
        .pivot("var", list(variables))
        .agg(F.first("values"))
    )
    return chunk_rows(paired, dims, variables)


def with_coordinates(rows: DataFrame, axes: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Replace index columns by coordinates: ``{dim: (axis(idx, coord), name)}``."""
    for dim, (axis, name) in axes.items():
        labelled = axis.select(F.col("idx").alias(dim), F.col("coord").alias(name))
        rows = attach_lookup(rows, labelled, [dim]).drop(dim)
    return rows
