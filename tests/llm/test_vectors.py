import numpy as np
import pytest

from cellweave.llm import bitslice, lattice

DATA = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score string, key string, block string, n string, component_id string"


@pytest.fixture(scope="module")
def odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 1),
            (6, [], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [0.0, 0.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0, 0.0], 1),
            (12, [0.0, 1.0], 1), (200, [0.5, 0.5], 2), (None, [1.0, 0.0], 1)]
    return spark.createDataFrame([r + ("x",) * 6 for r in rows], SCHEMA)


def brute_links(rows, least=0.93):
    v = {i: np.array(e, "f8") for i, e, label in rows}
    out = {i: [] for i in v}
    for label in {r[2] for r in rows}:
        ids = sorted(r[0] for r in rows if r[2] == label)
        x = np.stack([v[i] / np.linalg.norm(v[i]) for i in ids])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True):
            out[ids[a]].append(ids[b])
            out[ids[b]].append(ids[a])
    return out


def roots(links):
    low = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in low:
                low[j] = i
                todo += links[j]
    return low


def held(df, rows, recall=1.0):
    links = brute_links(rows)
    low = roots(links)
    got = {r.vec_id: r for r in lattice.near_duplicates(df).collect()}
    assert sum(r.n_links for r in got.values()) >= recall * sum(map(len, links.values()))
    for i, found in links.items():
        assert got[i].n_links <= len(found)
        assert got[i].kept == (got[i].component_id == i)
        if recall == 1.0:
            assert (got[i].n_links, got[i].component_id) == (len(found), low[i])
    return got


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 8)) * 2
    home = lattice.decode(x)
    around = lattice.minimal_vectors()
    assert len(np.unique(around, axis=0)) == 240
    for k in range(240):
        assert (((x - home) ** 2).sum(1) <= ((x - home - around[k]) ** 2).sum(1) + 1e-9).all()
    assert (((x - home) ** 2).sum(1) <= 1 + 1e-9).all()


def test_near_duplicates_of_the_table(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    held(df, [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])


def test_large_cells_and_recall(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((8, 32))
    x = [b + rng.standard_normal(32) * s for b in base for s in (0.05, 0.1, 0.2, 0.25) for _ in range(25)]
    rows = [(i, v.astype("f4").tolist(), i % 2) for i, v in enumerate(x)] + [(5000 + i, x[0].astype("f4").tolist(), 0) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    whole = {r.vec_id: tuple(r) for r in held(df, rows, 0.99).values()}
    monkeypatch.setattr(lattice, "BLOCK", 16)
    assert {r.vec_id: tuple(r) for r in lattice.near_duplicates(df).collect()} == whole


def test_odd_vectors(spark, odd):
    got = {(r.vec_id): r for r in lattice.near_duplicates(odd).collect()}
    assert (got[0].n_links, got[100].n_links, got[3].n_links) == (2, 2, 2)
    assert {got[i].component_id for i in (0, 100, 3)} == {0}
    for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 200):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert lattice.near_duplicates(odd).count() == odd.count()
    assert lattice.near_duplicates(odd.limit(0)).count() == 0


def brute_top(rows, k=10):
    ids = np.array([r[0] for r in rows])
    v = np.floor(1024 * np.array([r[1] for r in rows], "f8")).astype("i8")
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        s = v @ v[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out.update({(int(ids[i]), r + 1): (int(ids[j]), int(s[j])) for r, j in enumerate(order)})
    return out


def test_search_matches_brute_force(spark, monkeypatch):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = brute_top([tuple(r) for r in df.select("vec_id", "embedding").collect()])
    for rows, queries in ((bitslice.ROWS, bitslice.QUERIES), (300, 7)):
        monkeypatch.setattr(bitslice, "ROWS", rows)
        monkeypatch.setattr(bitslice, "QUERIES", queries)
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in bitslice.query(spark, DATA).collect()}
        assert got == want


def test_slices_add_up():
    rng = np.random.default_rng(3)
    for n, d, scale in ((1, 3, 10), (70, 5, 1000), (500, 64, 300), (200, 2, 1)):
        values, q = rng.integers(-scale, scale + 1, (n, d)), rng.integers(-scale, scale + 1, d)
        block = bitslice.Block(values)
        w = rng.integers(-9, 10, d)
        total = block.add(w)
        low = int(values.min())
        coarse = (values - low) >> block.shift
        want = np.where(w < 0, -w * ((1 << bitslice.ROW_BITS) - 1 - coarse), w * coarse).sum(1)
        bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:n].astype(int) for s in total]
        assert (sum(b << i for i, b in enumerate(bits)) == want).all()
        assert block.kth(total, min(n, 3)) == np.sort(want)[::-1][min(n, 3) - 1]
        best = set(np.argsort(-(values @ q), kind="stable")[:5])
        exact = np.sort(values @ q)[::-1][: min(n, 5)]
        got = block.candidates(q, 5)
        assert (np.sort((values @ q)[got])[::-1][: min(n, 5)] == exact).all() and len(best)


def test_search_odd(spark, odd):
    f = bitslice.F
    rows = bitslice.search(odd, f.col("vec_id") % 100 == 0).collect()
    got = [(r["rank"], r.vec_id, r.score) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == 0]
    assert got == [(1, 3, 2 * 1024**2), (2, 4, 1024**2), (3, 100, 1024**2), (4, 200, 512 * 1024), (5, 9, 0), (6, 12, 0)]
    assert bitslice.search(odd.limit(0), f.col("vec_id") % 100 == 0).count() == 0


def test_a_vector_with_its_cells_is_one_row():
    rng = np.random.default_rng(9)
    rows = [(1, i, 1, rng.standard_normal(d).astype("f4")) for i, d in enumerate([16] * 1500 + [8] * 20)]
    pdf = lattice.pd.DataFrame(rows, columns=["label", "rep", "n", "embedding"])
    got = list(lattice.entries([pdf]))
    assert sorted(r for g in got for r in g["rep"]) == list(range(1520)) and max(map(len, got)) <= lattice.HASHED
    assert {len(b) for g in got for b in g["buckets"]} == {lattice.TABLES * (1 + lattice.PROBES)}
