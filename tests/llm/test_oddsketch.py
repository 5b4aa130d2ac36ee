import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np

from llm_fixtures import documents, no_documents, odd_documents  # noqa: F401

from cellweave.llm import oddsketch

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall((text or "").encode().lower())
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    low = {i: i for i, _ in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(k)
    seen = set()
    for held in holders.values():
        if len(held) < 400:
            seen.update(combinations(held, 2))
    for a, b in seen:
        (i, x), (j, y) = sets[a], sets[b]
        same = len(x & y)
        if 100 * same >= 80 * (len(x) + len(y) - same):
            i, j = root(i), root(j)
            low[max(i, j)] = min(i, j)
    return {i: (len(s), root(i)) for i, s in sets}


def held(df):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = brute([r for r in rows if r[0] is not None])
    got = oddsketch.groups(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_whole_table(documents):
    held(documents)


def variants(n, words, least, most, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randint(least, most)):
            text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def test_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    texts = variants(120, 150, 0, 6, 1) + variants(60, 2500, 10, 90, 2) + variants(40, 12, 0, 1, 3) + variants(30, 300, 5, 12, 4)
    df = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    held(df)
    monkeypatch.setattr(oddsketch, "BLOCK", 16)
    held(df)


def test_odd_rows(spark, odd_documents, no_documents):
    rows = oddsketch.groups(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    got = {r.doc_id: r for r in rows}
    assert [got[i].n_shingles for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 4, 1]
    assert (got[6].component_id, got[6].kept, got[None].kept) == (5, False, True)
    assert oddsketch.groups(no_documents).count() == 0
    kept = oddsketch.deduplicate(odd_documents)
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count() - 1


def test_estimates_are_close_and_forest_spans():
    rng = np.random.default_rng(0)
    for size in (40, 400, 5000):
        for share in (0.78, 0.8, 0.85, 0.95):
            same = int(size * 2 * share / (1 + share))
            hashes = rng.integers(0, 1 << 64, 2 * size - same, dtype=np.uint64)
            a, b = np.sort(hashes[:size]), np.sort(np.r_[hashes[:same], hashes[size:]])
            made = [oddsketch.odd_sketch(x) for x in (a, b)]
            bits = np.stack([np.frombuffer(m[0], np.uint64) for m in made])
            got = oddsketch.estimates(bits, np.array([m[1] for m in made]), np.array([len(a), len(b)]), slice(0, 1), slice(1, 2))
            true = same / (len(a) + len(b) - same)
            assert true - 0.05 < got[0, 0] < true + 0.05 + 4 / size
    w = np.round(rng.random((40, 40)), 1)
    w = np.maximum(w, w.T)
    i, j = oddsketch.strongest_forest(np.where(w > 0.3, w, -1))
    assert len(i) == 39


def test_filter_loses_no_pair_at_the_threshold():
    """Pairs of similarity 0.8, the least that links: none of thousands is filtered out, and
    the standard error that the margin rests on is the one that shows."""
    rng = np.random.default_rng(3)
    for union, pairs in ((10, 1500), (200, 1500), (1000, 1500), (3000, 600), (20000, 60)):
        found = []
        for _ in range(pairs):
            items = rng.integers(0, 1 << 63, union, dtype=np.uint64) * np.uint64(2)
            own = union // 10
            a, b = np.sort(items[own:]), np.sort(np.r_[items[:own], items[2 * own :]])
            made = [oddsketch.odd_sketch(x) for x in (a, b)]
            rows = {
                "sketch": [m[0] for m in made], "filled": np.array([m[1] for m in made]), "n_shingles": np.array([len(a), len(b)]),
                "id": np.array([1, 2]), "first": np.array([0]), "second": np.array([0]),
            }
            near, allowed = oddsketch.candidates(rows)
            assert allowed[0, 1]
            found.append(near[0, 1])
        if union >= 1000:
            shown, stated = np.std(found), oddsketch.spread(np.array(float(union)))
            assert 0.6 * stated < shown < 1.3 * stated
