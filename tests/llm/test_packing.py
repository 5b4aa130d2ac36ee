import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from llm_fixtures import documents, no_documents, odd_documents  # noqa: F401

from cellweave.llm import packing


def held(docs, capacity=4096, **options):
    rows = packing.pack(docs, capacity=capacity, **options).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            want[(r.doc_id, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity) if rows else 0


def test_whole_table(documents):
    used, least = held(documents)
    assert used <= least * 1.01 + 1


def test_odd_rows_and_levels(odd_documents, no_documents, documents):
    held(odd_documents)
    assert held(no_documents) == (0, 0)


def test_levels(documents, spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_BINS", 4)
    used, least = held(documents, shard=100)
    assert used <= least * 1.03 + 2
    # more than half of a sequence each, so that no bin can be filled
    half = spark.createDataFrame([(i, "a " * 39) for i in range(300)], "doc_id long, text string")
    assert held(half, capacity=64, shard=10)[0] == 300
    short = spark.createDataFrame([(i, "") for i in range(500)], "doc_id long, text string")
    assert held(short, capacity=64, shard=10)[0] == 8


def test_words_and_white_space(spark):
    texts = ["a b c d\u0085e\x1cf\x0bg", "It's they'LL we 've", "<|endoftext|> x<|startoftext|>y <| endoftext |>",
             "é ́x Å Å", "don 't \n's 1234 ½ ٣٤ 中文字 😀👍🏽", "﻿x ​ y퟿", "A" * 5000,
             "<|ENDOFTEXT|> <|EndOfText|>, Ça! ÉTÉ.. été?! dogs', can't. 12, x9. ½. İstanbul. ΣΑΣ, naïve… œuvre; ŒUVRE: ÿ Ÿ ẞ ß.",
             "e\u0301. a\u030a, n\u0303! \u0301. .\u0301 ,.a .,. a.b a,b. |x| --a-- (the) the). _a_ a_,",
             "'tis 'the 'stop 's. \"'llama (re've) ve' don't!! ##the### $$$ it's's word<|endoftext|>word !<|endoftext|>! <|x|> a<|b"]
    held(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), capacity=64)


def test_a_word_is_coded_once_for_all_marks_around_it():
    real = Tokenizer.from_file(packing.tokenizer_path())
    asked = []

    class Counted:
        model = type("Model", (), {"tokenize": staticmethod(lambda text: asked.append(text) or real.model.tokenize(text))})
        encode = real.encode

    words = packing.Words(Counted())
    for text in ("Éireneou,", "(éireneou", "house", "house.", "((house))", "house", "don't", "'house", "<|house"):
        want = real.encode(text, add_special_tokens=False).ids
        assert words[text.encode()] == np.array(want, "<u4").tobytes()
    assert len(asked) == 3  # the first form, in small letters and plain
    words.forget(5)
    assert not words and words[b"house."] and len(asked) == 3


def test_a_word_is_looked_up_once_for_all_its_places_in_a_chunk(monkeypatch):
    asked = []

    class Counted(packing.Words):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    monkeypatch.setattr(packing, "Words", Counted)
    text = "House, (house) été. house... (été) don't house\n" * 50
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "text": [text] * 100})
    rows = pa.Table.from_batches(packing.cutting(packing.tokenizer_path())(iter([batch]))).to_pylist()
    ids = [*Tokenizer.from_file(packing.tokenizer_path()).encode(text, add_special_tokens=False).ids, 1]
    crc = zlib.crc32(np.array(ids, "<u4").tobytes())
    assert rows == [{"doc_id": i, "piece": 0, "start": 0, "length": len(ids), "ids_crc32": crc} for i in range(100)]
    assert len(asked) < 20  # of 35,000 words


def test_marks_around_doubtful_cores_and_chunks(monkeypatch):
    """Whatever stands at the edge of a word, and wherever a chunk ends, ids are the tokenizer's."""
    edges = ["", ",", "'", "...", ",'", "',", "<|", "|>", "_", "\x01", "\x7f", "\u0301", "\u0338", "…", "\u00a0", "\u0085", "½", "ª", "ß", "Ÿ", "Œ", "9", "😀"]
    cores = ["", "a", "É", "house", "e\u0301", "x.y", "don't", "Σ", "7", "endoftext", "ÿ", "\x1c"]
    words = [a + b + c + d for a in edges for b in cores for c in edges for d in ("", ",")]
    texts = [None, "", " \n", *(" ".join(words[k : k + 40]) for k in range(0, len(words), 40)), None, *words[:300], " " * 50, ""]
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at : at + 64], "<u4")
            want.append((i, piece, at, len(part), zlib.crc32(part.tobytes())))
    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    for chunk, batches in ((1 << 20, [whole]), (300, [whole[:7], whole[7:7], whole[7:]]), (1, [whole])):
        monkeypatch.setattr(packing, "CHUNK", chunk)
        found = packing.cutting(packing.tokenizer_path(), 64)(iter(batches))
        assert [tuple(r.values()) for b in found for r in b.to_pylist()] == want


def test_sequence_numbers_are_exact(spark):
    parts = [(s, b) for s in (0, 1, 255, 256, (1 << 32) - 1) for b in (0, 1, 255, 65536, (1 << 24) - 1)]
    df = spark.createDataFrame(parts, "shard long, bin int")
    for level in (0, 1, 127):
        found = {(r.shard, r.bin): r.n for r in df.select("shard", "bin", packing.sequence_number(level).alias("n")).collect()}
        assert found == {(s, b): level << 56 | s << 24 | b for s, b in parts}
        assert min(found.values()) >= 0  # full pieces have negative numbers


def test_crossover_saves_bins_where_best_fit_does_not_do(spark, monkeypatch):
    """Two to four pieces make a sequence: the algorithm finds fuller bins than best fit."""
    rng = random.Random(5)
    lengths = [rng.randint(1000, 1700) for _ in range(600)]
    plain = packing.Packing(lengths, 4096)
    plain.best_fit(sorted(range(600), key=lambda i: -lengths[i]))
    made = []
    monkeypatch.setattr(packing, "crossover", lambda *a, cross=packing.crossover: made.append(1) or cross(*a))
    best = packing.evolve(lengths, 4096, [], 3, packing.GENERATIONS, packing.POPULATION)[0]
    assert len(made) >= 50 and len(best.bins) <= len(plain.bins) - 3
    assert sorted(i for b in best.bins for i in b) == list(range(600))
    # the same through islands and levels
    short = [n // 50 for n in lengths[:300]]
    plain = packing.Packing(short, 82)
    plain.best_fit(sorted(range(300), key=lambda i: -short[i]))
    docs = spark.createDataFrame([(i, "a " * (n - 1)) for i, n in enumerate(short)], "doc_id long, text string")
    used, _ = held(docs, capacity=82)
    assert used < len(plain.bins)


def test_crossover_keeps_every_item_once():
    rng = random.Random(1)
    lengths = [rng.randint(1, 60) for _ in range(200)]
    a, b = packing.Packing(lengths, 100), packing.Packing(lengths, 100)
    a.best_fit(range(200))
    b.best_fit(sorted(range(200), key=lambda i: -lengths[i]))
    for _ in range(20):
        a = packing.crossover(a, b, rng)
        assert sorted(i for x in a.bins for i in x) == list(range(200))
        assert max(a.fill) <= 100
    best = packing.evolve(lengths, 100, [], 1, 30, 6)[0]
    assert len(best.bins) <= len(b.bins)
