import os

import numpy as np
import pytest
from conftest import rows

from cellweave.sources import array_files as af

DIMS = ("time", "eta", "xi")
GRID = np.arange(200, dtype=float).reshape(10, 5, 4)
GRID[3, 1, 2] = np.nan


@pytest.fixture
def folder(tmp_path):
    """Five files of two time steps each, without an index, and one of another grid."""
    for start in range(0, 10, 2):
        block = GRID[start : start + 2]
        data, _ = af.encode(DIMS, [start, 0, 0], {"alk": block, "dic": block * 10})
        (tmp_path / f"f{start}.cwa").write_bytes(data)
    (tmp_path / "area.cwa").write_bytes(af.encode(["eta", "xi"], [0, 0], {"area": np.ones((5, 4))})[0])
    return str(tmp_path)


def expected(slab, *arrays):
    ranges = [range(*slab[d]) if d in slab else range(n) for d, n in zip(DIMS, GRID.shape, strict=True)]
    return [
        (t, e, x, *[None if np.isnan(a[t, e, x]) else a[t, e, x] for a in arrays])
        for t in ranges[0] for e in ranges[1] for x in ranges[2]
    ]


@pytest.mark.parametrize("slab", [{}, {"time": (3, 7)}, {"time": (0, 10), "eta": (1, 3), "xi": (2, 4)}, {"xi": (0, 1)}])
@pytest.mark.parametrize("values", [20, 1 << 22])
def test_slab_equals_array_slicing(spark, folder, slab, values):
    counted = {d: (a, b - a) for d, (a, b) in slab.items()}
    af._registered(spark)
    text = ",".join(f"{d}:{a}:{n}" for d, (a, n) in counted.items())
    read = spark.read.format("array_files").option("dims", "time,eta,xi").option("slab", text).option("values", values)
    assert rows(read.load(folder), *DIMS) == expected(slab, GRID, GRID * 10)


def test_grid_is_chosen_by_its_dimensions(spark, folder):
    assert af.read_arrays(spark, folder, dims=["eta", "xi"]).count() == 20
    assert af.read_arrays(spark, folder, ["dic"], dims=DIMS).columns == ["time", "eta", "xi", "dic"]


def test_schema_prunes_variables(spark, folder):
    af._registered(spark)
    df = spark.read.format("array_files").schema("dic double, xi int").option("dims", "time,eta,xi").load(folder)
    assert sorted(x[0] for x in rows(df.filter("xi = 0 and dic is not null"), "dic")) == sorted((GRID[:, :, 0] * 10).ravel())


def write(spark, path, steps=4, parts=1):
    blocks = [([t, 0, 0], [1, 5, 4], GRID[t].ravel().tolist(), (GRID[t] * 10).ravel().tolist()) for t in range(10)]
    df = spark.createDataFrame(blocks, "starts array<int>, sizes array<int>, alk array<double>, dic array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        af.write_arrays(df, path, DIMS, steps, mode="overwrite")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_written_files_are_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    write(spark, path)
    headers = af.folder_headers(path)
    assert [h["starts"][0] for h in headers.values()] == [0, 4, 8] and [h["sizes"][0] for h in headers.values()] == [4, 4, 2]
    assert rows(af.read_arrays(spark, path), *DIMS) == expected({}, GRID, GRID * 10)
    write(spark, path, steps=2, parts=3)  # takes the place of the first
    assert rows(af.read_arrays(spark, path), *DIMS) == expected({}, GRID, GRID * 10)
    assert sum(n.endswith(".cwa") for n in os.listdir(tmp_path / "out")) == len(af.folder_headers(path)) >= 5


def test_only_needed_files_are_opened(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    write(spark, path)
    headers = af.folder_headers(path)
    for file, header in headers.items():  # what the slab does not need can be no array file
        if header["starts"][0] != 4:
            with open(file, "wb") as out:
                out.write(b"broken")
    (tmp_path / "out" / "leftover.cwa").write_bytes(b"of a failed attempt")
    found = af.read_arrays(spark, path, slab={"time": (5, 3), "eta": (2, 2)})
    assert rows(found, *DIMS) == expected({"time": (5, 8), "eta": (2, 4)}, GRID, GRID * 10)
    reader = af.ArrayReader(path, DIMS, ["alk"], [*DIMS, "alk"], {"time": (5, 8)}, 1 << 22)
    assert [(p[0], p[2:]) for piece in reader.partitions() for p in piece.parts] == [
        (f, (5, 8)) for f, h in headers.items() if h["starts"][0] == 4
    ]
    assert af.read_arrays(spark, path, slab={"time": (50, 3)}).count() == 0


def test_only_the_wanted_bytes_are_read(tmp_path, monkeypatch):
    data, _ = af.encode(DIMS, [0, 0, 0], {"alk": GRID, "dic": GRID})
    (tmp_path / "one.cwa").write_bytes(data)
    reader = af.ArrayReader(str(tmp_path), DIMS, ["dic"], [*DIMS, "dic"], {"time": (2, 4)}, 1 << 22)
    seen = []
    real = af.open_folder

    class Watched:
        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            return getattr(self.system, name)

        def open_input_file(self, name):
            file = self.system.open_input_file(name)

            class File:
                def __enter__(self):
                    return self

                def __exit__(self, *_):
                    file.close()

                def read_at(self, size, at):
                    seen.append(size)
                    return file.read_at(size, at)

            return File()

    pieces = reader.partitions()
    monkeypatch.setattr(af, "open_folder", lambda p: (Watched(real(p)[0]), real(p)[1]))
    assert sum(b.num_rows for p in pieces for b in reader.read(p)) == 40 and seen == [2 * 20 * 8]


def test_filters_narrow_the_slab(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    write(spark, path, steps=2)
    for file, header in af.folder_headers(path).items():
        if header["starts"][0] not in (4, 6):
            os.truncate(file, 3)
    setting = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(setting, "true")
    try:
        df = spark.read.format("array_files").option("pushdown", True).load(path)
        found = df.filter("time >= 4 and time < 7 and eta = 2 and xi > 1 and xi <= 3")
        assert rows(found, *DIMS) == expected({"time": (4, 7), "eta": (2, 3), "xi": (2, 4)}, GRID, GRID * 10)
    finally:
        spark.conf.unset(setting)
