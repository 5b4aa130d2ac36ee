import re
from collections import Counter, defaultdict

import pytest

from llm_fixtures import documents, no_documents, odd_documents  # noqa: F401

from cellweave.llm import mixture

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Water filling by bisection, apart from the operator's own steps."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    whole, low, high = 1.5 * sum(sizes.values()), 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[s], mid * weight[s]) for s in names) < whole else (low, mid)
    return {s: min(2 * sizes[s], high * weight[s]) for s in names}


def test_sizes_targets_and_taken(documents):
    rows = mixture.mix(documents).collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in documents.collect()}
    source = {r.doc_id: r.source for r in documents.collect()}
    total = defaultdict(int)
    for i, n in size.items():
        total[source[i]] += n
    want, taken = targets(total), defaultdict(int)
    assert len(rows) == len(size)
    for r in rows:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        assert r.source_size == total[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]], rel=1e-6)
        taken[source[r.doc_id]] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 4 * mixture.BLOCK


def test_reruns_agree(documents):
    a, b = mixture.mix(documents), mixture.mix(documents.repartition(7))
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))


def test_odd_rows(odd_documents, no_documents):
    rows = mixture.mix(odd_documents, block=8).collect()
    assert len(rows) == odd_documents.count()
    assert {r["size"] for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert mixture.mix(no_documents).count() == 0


def test_slots_follow_the_golden_ratio(spark):
    sources = spark.createDataFrame([(0, 300.0), (1, 100.0)], "sid long, target double")
    got = mixture.slots(sources, 1).groupBy("sid").count().collect()
    n = Counter(int((i * mixture.GOLDEN % 2**40) >= 0.75 * 2**40) for i in range(400))
    assert {r.sid: r["count"] for r in got} == n


def test_ranks_pass_the_end_of_a_run(spark, monkeypatch):
    monkeypatch.setattr(mixture, "RUN", 16)
    sources = spark.createDataFrame([(0, 300.0), (1, 100.0)], "sid long, target double")
    for sid in (0, 1):
        blocks = sorted(r.block for r in mixture.slots(sources, 1).where(f"sid = {sid}").collect())
        assert blocks == list(range(len(blocks)))


def test_mixed_documents(documents):
    out = mixture.mixed_documents(documents)
    copies = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert out.columns == documents.columns and max(copies.values()) == 2


def test_matches_sql(spark):
    import os

    import duckdb

    for folder in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{os.path.join(folder, 'documents.parquet')}'")
        want = Counter(con.execute(mixture.SQL).fetchall())
        columns = ["doc_id", "size", "source_size", "target", "taken"]
        assert Counter(tuple(r) for r in mixture.query(spark, folder).select(*columns).collect()) == want
