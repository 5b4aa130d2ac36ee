import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm_fixtures import documents, no_documents, odd_documents  # noqa: F401

from cellweave.llm import gated_lm

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def expected(rows):
    docs = [(i, WORD.findall((t or "").encode().lower()) + [b""]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    counts = Counter(w for (_, d), h in zip(docs, held, strict=True) if not h for w in d)
    n, v = sum(counts.values()), len(counts)
    out = []
    for (i, d), h in zip(docs, held, strict=True):
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in d)
        out.append((i, h, len(d), sum(counts[w] > 0 for w in d), n, base))
    return out


def held(df):
    rows = gated_lm.score(df).collect()
    want = expected([tuple(r) for r in df.select("doc_id", "text").collect()])
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    return rows


def test_counts_base_and_gain(documents, spark, monkeypatch):
    monkeypatch.setattr(gated_lm, "HEAD", 5000)  # so that other words come by the join
    rows = [r for r in held(documents) if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_odd_rows(spark, odd_documents, no_documents):
    held(odd_documents)
    assert gated_lm.score(no_documents).count() == 0


def network(seed=0):
    rng = np.random.default_rng(seed)
    return {k: (rng.standard_normal(s) * 0.3).astype(np.float32) for k, s in gated_lm.SHAPES.items()}


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    weights = {k: v.astype(np.float64) for k, v in network().items()}
    inputs, starts = rng.integers(0, 256, (5, 3), dtype=np.uint8), rng.random((5, 3)) < 0.3
    target, h = rng.integers(0, 256, 15, dtype=np.uint8), np.zeros((3, gated_lm.HIDDEN))

    def loss():
        net = gated_lm.Network(weights)
        states, _, steps = net.run(inputs, starts, h, True)
        got, grads, dh = net.outputs(states.reshape(-1, gated_lm.HIDDEN), target, True)
        net.back(inputs, starts, steps, dh.reshape(states.shape), grads)
        return -got.mean(), grads

    _, grads = loss()
    for name in gated_lm.SHAPES:
        for _ in range(6):
            at = tuple(int(rng.integers(n)) for n in weights[name].shape)
            if name == "x":
                at = (int(inputs[rng.integers(5), rng.integers(3)]), at[1])
            kept = weights[name][at]
            values = []
            for step in (1e-3, -1e-3):
                weights[name][at] = kept + step
                values.append(loss()[0])
            weights[name][at] = kept
            assert grads[name][at] == pytest.approx((values[0] - values[1]) / 2e-3, abs=2e-4)


def test_state_is_carried_and_streams_do_not_mix():
    rng = np.random.default_rng(4)
    weights = network(2)
    documents = [np.r_[rng.integers(1, 256, n), 0].astype(np.uint8) for n in (0, 1, 5, 700, 33, 64, 2000, 3)] * 3
    together = gated_lm.log_likelihoods(weights, documents)
    net = gated_lm.Network(weights)
    for d, got in zip(documents, together, strict=True):
        inputs = np.r_[np.uint8(0), d[:-1]][:, None].astype(np.uint8)
        states, _, _ = net.run(inputs, np.zeros(inputs.shape, bool), np.zeros((1, gated_lm.HIDDEN), np.float32), False)
        one = net.outputs(states.reshape(-1, gated_lm.HIDDEN), d, False)[0].sum() / math.log(10)
        assert got == pytest.approx(one, rel=1e-4)


def test_probabilities_add_up():
    words = [(b"the", 50), (b"of", 40), (b"alpha", 3), (b"beta", 2), (b"gamma", 1)]
    totals = {}
    for w, n in words[2:]:
        t = totals.setdefault(gated_lm.ending(w), [0, 0])
        t[0] += n
        t[1] += 1
    kept = gated_lm.SINGLES
    try:
        gated_lm.SINGLES = 2
        lexicon = gated_lm.Lexicon(words, {e: tuple(t) for e, t in totals.items()}, 10, 106, 6)
    finally:
        gated_lm.SINGLES = kept
    net = gated_lm.Network(network(3))
    h = np.random.default_rng(0).standard_normal((1, gated_lm.HIDDEN)).astype(np.float32)
    chance = np.exp([net.outputs(h, np.array([c], np.uint8), False)[0][0] for c in range(256)])
    assert chance.sum() == pytest.approx(1, abs=1e-4)
    share = {}
    for w, n in words:
        c = int(lexicon.classes[lexicon.index[w]])
        share[c] = share.get(c, 0) + 10 ** (math.log10(n + 1) - lexicon.share[c] - lexicon.alone[c])
    for c, s in share.items():
        # what is left of a class of endings is its unknown word's share
        assert s == pytest.approx(1) if lexicon.alone[c] else s + 10 ** -lexicon.share[c] == pytest.approx(1)
