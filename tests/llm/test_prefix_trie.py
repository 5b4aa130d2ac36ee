import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from llm_fixtures import DATA

from cellweave.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Nodes of rows (conv_id, turn, role, text), by plain dictionaries of prefixes."""
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            named = hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest()
            turns[c].append((t is not None, t or 0, r, named, x))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
            if d:
                children[tuple(path[: d - 1])].add(tuple(path[:d]))
        ends[tuple(path)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * (len(node[-1][1]) if node else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(
        (m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(children[n]), leaves[n], saved[n], digest(ends[n]))
        for n, m in members.items()
    )


def nodes(spark, rows):
    return sorted(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).select(COLUMNS).collect()))


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = prefix_trie.query(spark, DATA)
    assert sorted(map(tuple, found.select(COLUMNS).collect())) == brute(rows)
    assert dict(found.dtypes) == {c: "string" if c == "ends_sha256" else "bigint" for c in COLUMNS}


def test_odd_rows(spark):
    """Null turns, roles, texts and ids; ties; repeated rows; absent and short families; no turns left."""
    rows = [
        (None, 0, "user", "lost"), (0, 1, "user", "b"), (0, None, None, None), (0, 1, "user", "b"), (0, 1, "user", "a"),
        (1, 0, "user", "x"), (2, 0, "user", "x"), (2, 1, None, "y"), (2, 1, "", "y"), (105, 0, "u", "😀é"), (106, 0, "u", ""),
        *[(c, t, "user", "same" * (t + 1)) for c in range(200, 230) for t in range(7)], (310, None, "", ""), (311, 5, "z", None),
    ]
    assert nodes(spark, rows) == brute(rows)
    assert nodes(spark, [(7, 0, "u", "t")]) == brute([(7, 0, "u", "t")])
    assert nodes(spark, []) == [] and nodes(spark, [(None, 1, "u", "t")]) == []


def test_random_tries(spark):
    r = random.Random(11)
    rows = [(c, t, r.choice("ua"), r.choice(["p", "q"])) for c in r.sample(range(1200), 160) for t in range(r.randint(1, 9))]
    assert nodes(spark, rows) == brute(rows)


def test_hot_conversation_and_hot_parent(spark):
    """One conversation holds a third of all rows; one node has a third of all ends and children."""
    rows = [(0, t, "u", f"{t % 7}") for t in range(600)]
    rows += [(c, t, "u", "open" if t == 5 else f"{t}") for c in range(100, 160) for t in range(6)]
    rows += [(c, 6, "u", f"{c}") for c in range(130, 160)]
    assert nodes(spark, rows) == brute(rows)


def test_ends_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    ends = [(1, 5, 6, c) for c in (1000, 2, 30, -4, 5, 600, 7)] + [(1, 5, 7, 9), (0, 0, 0, 1)]
    df = spark.createDataFrame(ends, "depth long, x1 long, x2 long, conv_id long").repartition(3)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    got = {tuple(r)[:3]: r.ends_sha256 for r in prefix_trie.digests_of(df).collect()}
    assert got == {(1, 5, 6): digest("-4,2,5,7,30,600,1000"), (1, 5, 7): digest("9"), (0, 0, 0): digest("1")}


@pytest.mark.parametrize("n, spacing, small", [(1, 4, 8), (8, 4, 8), (9, 4, 8), (700, 4, 8), (300, 2, 1)])
def test_list_ranking(spark, n, spacing, small):
    order = list(range(100, 100 + n))
    random.Random(n).shuffle(order)
    links = [(a, b, 1 + a % 3) for a, b in zip(order, [*order[1:], prefix_trie.END], strict=True)]
    df = spark.createDataFrame(links, "arc long, next long, gap long").repartition(4)
    left, expected = 0, {}
    for a, _, gap in reversed(links):
        left += gap
        expected[a] = left
    assert {r.arc: r.left for r in prefix_trie.distances(df, 0, spacing, small).collect()} == expected


def test_clashing_columns(spark):
    rows = [(c, t, "u", f"{t}") for c in (0, 5, 6) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = brute(rows)
    for n in ("pos", "depth", "size", "x1", "_part", "_tell", "id", "arc", "next", "base", "h"):
        df = df.withColumn(n, df["role"])
    assert sorted(map(tuple, prefix_trie.trie(df).select(COLUMNS).collect())) == expected
