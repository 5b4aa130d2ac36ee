import itertools
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm_fixtures import no_documents, odd_documents  # noqa: F401

from cellweave.llm import toxicity

DATA = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_matches_brute_force():
    terms = ["abcab", "bacab", "abc", "caabbc", "bbcca", "bb*", "ccaba*"]
    words = ["".join(w) for n in range(7) for w in itertools.product("abcx"[: 3 if n > 5 else 4], repeat=n)]
    got = toxicity.Automaton(terms).distances(words)
    for word, d in zip(words, got.tolist(), strict=True):
        want = 2
        for t in terms:
            if t.endswith("*"):
                n = min(distance(word[:k], t[:-1]) for k in range(len(word) + 1))
                want = min(want, n if n == 0 or (n == 1 and len(t) > toxicity.FUZZY_LENGTH) else 2)
            else:
                n = distance(word, t)
                want = min(want, n if n == 0 or (n == 1 and len(t) >= toxicity.FUZZY_LENGTH) else 2)
        assert d == want, word


def test_quotation_is_told_from_abuse():
    finder = toxicity.Finder(toxicity.Automaton(["idiot"]))
    texts = ["you are an idiot", 'he said "idiot" once', "such an idoit or idiott here", "the word idiot means"]
    tokens = [t.split() for t in texts]
    finder.learn(tokens)
    f = [finder.features(t) for t in tokens]
    assert f[0][0] > 0 and f[0][1] == 0 and f[0][4] > 0
    assert f[1][0] == 0 and f[1][1] > 0 and f[3][1] > 0
    assert f[2][0] == 0 and f[2][2] > 0


def test_terms_are_told_from_chance_and_from_copies(spark):
    """No count and no share limits the lexicon; words inside a copied passage are no terms."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    abuse = [f"zorg{word()}" for _ in range(400)]
    rows = []
    for i in range(12_000):
        toxic = i % 6 == 0
        words = [word() for _ in range(12)]
        if toxic:
            words[1], words[3], words[11] = rng.sample(abuse, 3)
        if i % 60 == 0:
            words[5:10] = ["first", "copied", "passage", "whole", "last"]
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    keys = docs.select(F.xxhash64("text").alias("key"), "toxic", "doc_id")
    held = toxicity.learn_terms(docs, keys, 2000, 10_000)
    often = Counter(w for _, t, y in rows if y for w in t.split() if w.startswith("zorg"))
    assert all(w in held and held[w] == n for w, n in often.items() if n >= 10)
    assert "zorg*" in toxicity.choose_terms(held) and len(held) > 350
    # a passage's first and last word stand beside changing words
    assert all(t.startswith(("zorg", "firs", "last")) for t in held)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(rows) == docs.count()
    right = {True: [0, 0], False: [0, 0]}
    for r in labels.collect():
        got = rows[r.doc_id]
        assert got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= got.score <= 1 and got.predicted == int(got.score >= 0.5)
        if got.held_out:
            right[r.toxic == 1][got.predicted == r.toxic] += 1
    assert right[True][1] >= 0.85 * sum(right[True]) and right[False][1] >= 0.995 * sum(right[False])
    clean = toxicity.reject(docs, labels)
    assert clean.columns == docs.columns
    assert clean.count() == sum(r.predicted == 0 for r in rows.values())


def test_class_ratio_does_not_depend_on_the_sample(spark, monkeypatch):
    """Sampled rows weigh as many as the distinct labelled training texts of their label."""
    rows = [(i, f"{'zorgl you' if i % 8 == 0 else 'plain'} text {i % 1200}", int(i % 8 == 0)) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.selectExpr("doc_id", "1 AS quality", "toxic")
    texts = {(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5}
    seen, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda x, y, w: seen.append((y, w)) or fit(x, y, w))
    for sample in (10_000, 100):
        monkeypatch.setattr(toxicity, "SAMPLE", sample)
        toxicity.train(docs, labels)
        y, w = seen.pop()
        for label in (0, 1):
            whole = sum(v == label for _, v in texts)
            assert (y == label).sum() == min(sample, whole)
            assert w[y == label].sum() == pytest.approx(whole)


@pytest.mark.parametrize("marks", [[], [(4, 1, 0), (5, 0, 1), (None, None, None)]])
def test_odd_rows(spark, odd_documents, no_documents, marks):
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    assert toxicity.score(odd_documents, labels).count() == odd_documents.count()
    assert toxicity.reject(odd_documents, labels).columns == odd_documents.columns
    assert toxicity.score(no_documents, labels).count() == 0
