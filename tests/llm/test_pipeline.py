import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from llm_fixtures import no_documents, odd_documents  # noqa: F401

import corpus_pipeline
from cellweave.llm import mixture, oddsketch, packing, secret_scan, shared, toxicity

from test_oddsketch import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.pin(stage(spark, docs, SF))
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "near_duplicates", "secrets", "mixture", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() > 0


def test_each_stage_against_its_own_input(spark, stages):
    (_, d0, d1), (_, _, d2), (_, _, d3), (_, _, d4), (_, _, d5) = stages
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = {r.doc_id for r in toxicity.score(d0, labels).where("predicted = 0").collect()}
    assert Counter(r.doc_id for r in d1.select("doc_id").collect()) == Counter(clean)
    want = brute([tuple(r) for r in d1.select("doc_id", "text").collect()])
    assert {r.doc_id for r in d2.collect()} == {i for i, (_, root) in want.items() if root == i}
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (d2, d3))
    assert before.keys() == after.keys()
    spans = {r.doc_id: [s for s in r.spans if s.live] for r in secret_scan.scan(d2).collect()}
    for i, text in before.items():
        out, at = [], 0
        for s in sorted(spans[i]):
            if s.start >= at:
                out += [text[at : s.start], "[secret]"]
            at = max(at, s.end)
        assert after[i] == "".join(out) + text[at:]
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixture.mix(d3).collect()}
    copies = Counter(r.doc_id for r in d4.select("doc_id").collect())
    for i, (n, size) in taken.items():
        assert copies[i] == (int(n / size + 0.5) if size else 0)
    tokenizer, pieces = Tokenizer.from_file(packing.tokenizer_path()), Counter()
    for r in d4.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[at : at + packing.CAPACITY]
            pieces[(r.doc_id, piece, len(part), zlib.crc32(part.tobytes()))] += 1
    rows = d5.collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows) == pieces
    bins = defaultdict(int)
    for r in rows:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= packing.CAPACITY


def test_odd_and_empty_documents(spark, odd_documents, no_documents, tmp_path):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_documents, no_documents):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.pin(stage(spark, docs, str(tmp_path)))
            assert name == "packing" or docs.columns == columns


def test_odd_documents_in_each_stage(spark, odd_documents, tmp_path):
    """Labels that reject nothing: which rows each stage keeps."""
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    every = Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 1, 7: 1, None: 1})
    want = {"toxicity": every, "near_duplicates": every - Counter([6]), "secrets": every - Counter([6])}
    docs = odd_documents
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.pin(stage(spark, docs, str(tmp_path)))
        assert Counter(r.doc_id for r in docs.collect()) == want[name], name
    sums = defaultdict(lambda: [0, 0])
    for r in mixture.mix(docs).collect():
        sums[r.doc_id][0] += r.taken
        sums[r.doc_id][1] += r["size"]
    out = corpus_pipeline.mixed(spark, docs, str(tmp_path))
    copies = Counter(r.doc_id for r in out.collect())
    assert {i: copies[i] for i in (1, 2, 3)} == {1: 1, 2: 1, 3: 1}
    for i in (4, 5, 7):
        taken, size = sums[i]
        assert copies[i] == int(taken / size + 0.5) * want["secrets"][i], i
    assert {r.doc_id for r in corpus_pipeline.packed(spark, out, str(tmp_path)).collect()} >= {1, 2, 3}


def test_null_and_repeated_ids(spark):
    """Each row is judged by its own text: none is lost or kept for its id alone."""
    word = " ".join(f"w{i}" for i in range(40))
    rows = [
        (None, "password=livevalue99 one two three", "en", "a", 34),
        (1, word, "en", "a", len(word)),
        (2, word, "en", "a", len(word)),
        (2, "another text of the same id that nothing links", "en", "a", 46),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = oddsketch.deduplicate(docs)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((r[0], r[1]) for r in rows if r[:2] != (2, word))
    safe = {r.doc_id: r.text for r in secret_scan.redact(docs).where("doc_id is null").collect()}
    assert safe == {None: "[secret] one two three"}
    # all is taken twice; the rows of one id apart
    out = Counter((r.doc_id, r.text) for r in mixture.mixed_documents(docs, share=2.0, block=1).collect())
    assert out == Counter({(r[0], r[1]): 2 for r in rows})


CLASHING = ("_id", "_hash", "_source", "_spans", "_copies", "_copy", "_new", "gone_id", "copy", "number", "held", "fresh", "n", "uid", "key", "text_hash")


def test_clashing_names_in_each_stage(spark, tmp_path):
    """Columns named as the stages name theirs come through with their values."""
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, f"password=live{i}value99 one two three {i}", "en", "abc"[i % 3], 40, *[f"{n}{i}" for n in CLASHING]) for i in range(6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in CLASHING)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.pin(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHING], name
        for r in docs.collect():
            assert [r[n] for n in CLASHING] == [f"{n}{r.doc_id}" for n in CLASHING], name
    assert docs.count() > 0 and all(r.text.startswith("[password]") or "[secret]" in r.text for r in docs.collect())


def test_kept_documents_are_unlinked(stages):
    _, _, d2 = stages[1]
    assert oddsketch.groups(d2).where("not kept").count() == 0


@pytest.mark.parametrize("step", [toxicity.find_contexts, oddsketch.sketch, oddsketch.full_sets])
def test_a_worker_holds_little_beside_its_batch(step):
    texts = [" ".join(f"w{i % 7}x{k}" for k in range(500)) for i in range(900)]
    ids = pa.array(range(len(texts)))
    batch = pa.RecordBatch.from_pydict({"doc_id": ids, "text_hash": ids, "text": pa.array(texts)})
    del texts
    for _ in step([batch.slice(0, 10)]):
        pass
    tracemalloc.start()
    for _ in step([batch]):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 35e6


TEXT_STEPS = [
    (toxicity, ("count_terms", "find_contexts", "feature_rows")),
    (oddsketch, ("sketch", "full_sets")),
    (packing, ("coded",)),
]


def test_workers_get_texts_in_small_batches(spark, tmp_path, monkeypatch):
    """No map over texts gets more than `shared.BATCH` bytes and one row; the session's setting stays."""
    common, rows = " ".join(f"w{k}" for k in range(300)), []
    for i in range(400):
        text = f"{common if i % 2 else common[::-1]} own{i} {'vileword' if i < 100 else 'plain'} end{i % 7}"
        rows.append((i if i % 50 else None, text, "en", "abc"[i % 3], len(text)))
    rows += [(1000, None, "en", "a", None), (1000, "", "en", "a", 0), (1, rows[300][1], "en", "a", rows[300][4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    spark.createDataFrame([(i, 1, int(i < 100)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    clean = Counter((r[0], r[1]) for r in rows if "vileword" not in (r[1] or ""))
    monkeypatch.setattr(shared, "BATCH", 1 << 14)
    seen = tmp_path / "seen"
    seen.mkdir()

    def noting(work, name):
        def noted(first, *rest):
            if name in ("feature_rows", "coded"):
                texts = rest[0] if name == "feature_rows" else first
                note(texts.nbytes)
                return work(first, *rest)
            return work(sized(first), *rest)

        def sized(batches):
            for batch in batches:
                note(batch["text"].nbytes)
                yield batch

        def note(size):
            with open(f"{seen}/{name}", "a") as out:
                out.write(f"{size}\n")

        return noted

    for module, names in TEXT_STEPS:
        for name in names:
            monkeypatch.setattr(module, name, noting(getattr(module, name), name))
    before = spark.conf.get(shared.BATCH_SETTING)
    kept = toxicity.reject(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == clean
    oddsketch.deduplicate(docs).count()
    packing.pack(docs).count()
    assert spark.conf.get(shared.BATCH_SETTING) == before
    longest = max(len(r[1] or "") for r in rows)
    for _, names in TEXT_STEPS:
        for name in names:
            sizes = [int(x) for x in (seen / name).read_text().split()]
            assert max(sizes) <= (1 << 14) + 2 * longest, (name, max(sizes))


@pytest.mark.parametrize(("setting", "held"), [("8k", "8k"), ("16384b", "16384b"), ("64m", str(1 << 22)), ("1g", str(1 << 22))])
def test_a_lower_limit_of_the_session_stays(spark, setting, held):
    before = spark.conf.get(shared.BATCH_SETTING)
    spark.conf.set(shared.BATCH_SETTING, setting)
    try:
        with shared.text_batches(spark):
            assert spark.conf.get(shared.BATCH_SETTING) == held
        assert spark.conf.get(shared.BATCH_SETTING) == setting
    finally:
        spark.conf.set(shared.BATCH_SETTING, before)
