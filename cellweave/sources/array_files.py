"""Files of chunked arrays as a Spark data source, with hyperslab pushdown.

A file holds one block of one grid: a header with the dimensions, the grid index and the
size of the block along each, and the place of each variable; then the variables, each
in row-major order as little-endian doubles (NaN is missing, and NULL in rows).

    spark.read.format("array_files")
        .option("slab", "time:60:240,eta:2:4")    # start and count, 0-based
        .option("variables", "alk,dic")
        .load(folder)

gives one row per position: an int column per dimension and a double column per variable.
The reader plans from headers alone: files outside the slab are not opened, of the others
only the bytes of the wanted variables within the wanted part of the leading dimension are
read, large files are split along that dimension and small ones share a partition. With
``option("pushdown", True)`` and ``spark.sql.python.filterPushdown.enabled``, comparisons
of dimension columns in ``filter`` narrow the slab as well.

Writing takes rows ``starts array<int>, sizes array<int>, <variable> array<double>...``;
blocks that follow each other along the leading dimension within a partition share a file,
up to ``steps`` of them. A job's headers are put into one index file when all its tasks
are through. Where a folder has index files only what they name is read, so what a failed
attempt left behind never counts; in a folder without any, headers come from the files.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from cellweave.session import ship_package

FORMAT = "array_files"
MAGIC = b"CELLARR1"
ENDING, INDEX = ".cwa", "_headers-"
VALUE_BYTES = 8
#: Values of one variable in a partition, about, and in a batch of rows.
PARTITION_VALUES, BATCH_VALUES = 1 << 22, 1 << 16


# --- one file -------------------------------------------------------------------------


def encode(dims: Sequence[str], starts: Sequence[int], variables: Mapping[str, np.ndarray]) -> tuple[bytes, dict]:
    """The bytes of a file and its header; the arrays share one shape."""
    sizes = list(next(iter(variables.values())).shape)
    block = math.prod(sizes) * VALUE_BYTES
    header = {
        "dims": list(dims), "starts": [int(s) for s in starts], "sizes": sizes,
        "variables": {name: i * block for i, name in enumerate(variables)},
    }
    text = json.dumps(header).encode()
    header["data"] = len(MAGIC) + 4 + len(text)
    body = [np.ascontiguousarray(a, "<f8").tobytes() for a in variables.values()]
    return b"".join([MAGIC, struct.pack("<I", len(text)), text, *body]), header


def read_header(file) -> dict:
    if file.read(len(MAGIC)) != MAGIC:
        raise ValueError("not an array file")
    (length,) = struct.unpack("<I", file.read(4))
    return {**json.loads(file.read(length)), "data": len(MAGIC) + 4 + length}


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def folder_headers(path: str) -> dict[str, dict]:
    """{file: header} of a folder, from its index files if it has any."""
    system, root = open_folder(path)
    names = [i.path for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File]
    found: dict[str, dict] = {}
    indexes = [n for n in names if n.rsplit("/", 1)[-1].startswith(INDEX)]
    for name in indexes:
        with system.open_input_stream(name) as file:
            found.update({f"{root}/{k}": h for k, h in json.loads(file.read()).items()})
    if not indexes:
        for name in (n for n in names if n.endswith(ENDING)):
            with system.open_input_file(name) as file:
                found[name] = read_header(file)
    return dict(sorted(found.items(), key=lambda x: (x[1]["starts"], x[0])))


# --- reading --------------------------------------------------------------------------


@dataclass
class Piece(InputPartition):
    """Parts of files along the leading dimension: [(file, header, low, high)]."""

    parts: list[tuple[str, dict, int, int]]


def parse_slab(text: str) -> dict[str, tuple[int, int]]:
    """"time:60:240,eta:2:4" as {dim: (first, end)}."""
    slab = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        dim, start, count = part.split(":")
        slab[dim] = (int(start), int(start) + int(count))
    return slab


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, dims: Sequence[str], variables: Sequence[str], columns: Sequence[str], slab, values: int):
        self.path, self.dims, self.variables, self.columns = path, list(dims), list(variables), list(columns)
        self.slab = dict(slab)
        self.values = values

    def window(self, header: dict) -> list[tuple[int, int]]:
        """First index and end of the slab within a file, per dimension."""
        out = []
        for dim, start, size in zip(header["dims"], header["starts"], header["sizes"], strict=True):
            first, end = self.slab.get(dim, (start, start + size))
            out.append((max(start, first), min(start + size, end)))
        return out

    def partitions(self) -> list[InputPartition]:
        pieces: list[Piece] = []
        held, room = [], self.values
        for file, header in folder_headers(self.path).items():
            if header["dims"] != self.dims:
                continue  # a grid of other dimensions
            window = self.window(header)
            if any(low >= high for low, high in window):
                continue
            inner = max(1, math.prod(header["sizes"][1:]))
            step = max(1, self.values // inner)
            low, end = window[0]
            while low < end:
                high = min(end, low + step)
                if held and (high - low) * inner > room:
                    pieces.append(Piece(held))
                    held, room = [], self.values
                held.append((file, header, low, high))
                room -= (high - low) * inner
                low = high
        return [*pieces, Piece(held)] if held or not pieces else pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(self.path)
        for file, header, low, high in partition.parts:
            window = [(low, high), *self.window(header)[1:]]
            sizes, starts = header["sizes"], header["starts"]
            inner = math.prod(sizes[1:])
            cut = tuple(slice(a - s, b - s) for (a, b), s in zip(window[1:], starts[1:], strict=True))
            arrays = {}
            with system.open_input_file(file) as source:
                for name in self.variables:
                    at = header["data"] + header["variables"][name] + (low - starts[0]) * inner * VALUE_BYTES
                    data = source.read_at((high - low) * inner * VALUE_BYTES, at)
                    block = np.frombuffer(data, "<f8").reshape([high - low, *sizes[1:]])
                    arrays[name] = block[(slice(None), *cut)].ravel()
            shape = [b - a for a, b in window]
            index = np.meshgrid(*[np.arange(a, b, dtype=np.int32) for a, b in window], indexing="ij", copy=False)
            columns = {d: i.ravel() for d, i in zip(self.dims, index, strict=True)}
            for at in range(0, math.prod(shape), BATCH_VALUES):
                take = slice(at, at + BATCH_VALUES)
                made = {d: pa.array(c[take], pa.int32()) for d, c in columns.items() if d in self.columns}
                made |= {n: pa.array(a[take], mask=np.isnan(a[take])) for n, a in arrays.items()}
                yield pa.RecordBatch.from_pydict({c: made[c] for c in self.columns})


class PushingReader(ArrayReader):
    """Takes bounds of dimension columns from the filters of a query; Spark still applies them."""

    def pushFilters(self, filters):  # noqa: N802
        bounds = {EqualTo: (0, 1), GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, 0), LessThanOrEqual: (None, 1)}
        for f in filters:
            if type(f) in bounds and len(f.attribute) == 1 and f.attribute[0] in self.dims and type(f.value) is int:
                dim, (low, high) = f.attribute[0], bounds[type(f)]
                first, end = self.slab.get(dim, (-(1 << 31), 1 << 31))
                first = first if low is None else max(first, f.value + low)
                end = end if high is None else min(end, f.value + high)
                self.slab[dim] = (first, end)
        yield from filters


# --- writing --------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    headers: dict[str, dict]


class ArrayWriter(DataSourceWriter):
    def __init__(self, path: str, dims: Sequence[str], variables: Sequence[str], steps: int, overwrite: bool):
        self.path, self.dims, self.variables = path, list(dims), list(variables)
        self.steps, self.overwrite = steps, overwrite

    def write(self, rows) -> Written:
        system, root = open_folder(self.path)
        system.create_dir(root, recursive=True)
        written: dict[str, dict] = {}
        held: list = []

        def flush():
            arrays = {
                v: np.concatenate([np.array([math.nan if x is None else x for x in r[v]], float).reshape(r["sizes"]) for r in held])
                for v in self.variables
            }
            data, header = encode(self.dims, held[0]["starts"], arrays)
            name = f"{uuid.uuid4().hex}{ENDING}"
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            written[name] = header
            held.clear()

        for row in rows:
            if held:
                last = held[-1]
                follows = row["starts"][0] == last["starts"][0] + last["sizes"][0] and (
                    (row["starts"][1:], row["sizes"][1:]) == (last["starts"][1:], last["sizes"][1:])
                )
                full = last["starts"][0] + last["sizes"][0] + row["sizes"][0] - held[0]["starts"][0] > self.steps
                if not follows or full:
                    flush()
            held.append(row)
        if held:
            flush()
        return Written(written)

    def commit(self, messages) -> None:
        system, root = open_folder(self.path)
        system.create_dir(root, recursive=True)
        before = [i.path for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File]
        headers = {k: h for m in messages if m for k, h in m.headers.items()}
        with system.open_output_stream(f"{root}/{INDEX}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(headers).encode())
        if self.overwrite:
            for name in before:
                if name.rsplit("/", 1)[-1] not in headers:
                    system.delete_file(name)

    def abort(self, messages) -> None:
        system, root = open_folder(self.path)
        for name in (n for m in messages if m for n in m.headers):
            system.delete_file(f"{root}/{name}")


class ArrayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _names(self, option: str) -> list[str]:
        return [n.strip() for n in self.options.get(option, "").split(",") if n.strip()]

    def _grid(self) -> dict:
        """Header of the first file of the wanted dimensions."""
        wanted = self._names("dims")
        for header in folder_headers(self.options["path"]).values():
            if not wanted or header["dims"] == wanted:
                return header
        raise ValueError(f"no array file of these dimensions in {self.options['path']}")

    def schema(self) -> str:
        grid = self._grid()
        variables = self._names("variables") or list(grid["variables"])
        return ", ".join([*[f"`{d}` int" for d in grid["dims"]], *[f"`{v}` double" for v in variables]])

    def reader(self, schema) -> DataSourceReader:
        dims = self._names("dims") or self._grid()["dims"]
        columns = schema.fieldNames()
        kind = PushingReader if self.options.get("pushdown", "").lower() == "true" else ArrayReader
        return kind(
            self.options["path"], dims, [c for c in columns if c not in dims], columns,
            parse_slab(self.options.get("slab", "")), int(self.options.get("values", PARTITION_VALUES)),
        )

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        variables = [n for n in schema.fieldNames() if n not in ("starts", "sizes")]
        return ArrayWriter(self.options["path"], self._names("dims"), variables, int(self.options.get("steps", "64")), overwrite)


# --- for callers ----------------------------------------------------------------------


def _registered(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    spark.dataSource.register(ArrayFiles)
    return spark


def write_arrays(blocks: DataFrame, path: str, dims: Sequence[str], steps: int = 64, mode: str = "append") -> None:
    """Write blocks (starts, sizes, one array column per variable) as array files.

    Blocks are dealt by ranges of their starts, so that those which follow each other
    meet in one task and share files."""
    _registered(blocks.sparkSession)
    dealt = blocks.repartitionByRange("starts").sortWithinPartitions("starts")
    dealt.write.format(FORMAT).option("dims", ",".join(dims)).option("steps", steps).mode(mode).save(path)


def read_arrays(
    spark: SparkSession,
    path: str,
    variables: Sequence[str] = (),
    slab: Mapping[str, tuple[int, int]] | None = None,
    dims: Sequence[str] = (),
) -> DataFrame:
    """Rows of the hyperslab ``{dim: (start, count)}`` of the grid with these dimensions."""
    text = ",".join(f"{d}:{start}:{count}" for d, (start, count) in (slab or {}).items())
    reader = _registered(spark).read.format(FORMAT).option("slab", text)
    return reader.option("variables", ",".join(variables)).option("dims", ",".join(dims)).load(path)
