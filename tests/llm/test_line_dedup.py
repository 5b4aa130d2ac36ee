import hashlib
from collections import defaultdict

import duckdb
from llm_fixtures import DATA, DOCS, documents, no_documents, odd_documents  # noqa: F401

from cellweave.llm import line_dedup

SPACE = " \t\n\x0b\f\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_chars=40, min_docs=5):
    """(doc_id, n_lines, n_dropped, text) of each of rows (doc_id, text)."""
    smallest = float("-inf")
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= min_chars:
                holders[key_of(line)].add(smallest if doc is None else doc)
    out = []
    for doc, text in rows:
        lines, own = (text or "").split("\n"), smallest if doc is None else doc
        stay = [x for x in lines if len(h := holders.get(key_of(x), ())) < min_docs or max(h) == own]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def reported(docs, **options):
    return sorted(map(tuple, line_dedup.drop_common_lines(docs, report=True, **options).collect()), key=repr)


def test_whole_table(spark, documents):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    expected = brute(rows)
    assert sum(r[2] for r in expected) > 100
    assert reported(documents) == sorted(expected, key=repr)
    digests = {r.doc_id: r.kept_sha256 for r in line_dedup.query(spark, DATA).collect()}
    assert digests == {d: hashlib.sha256(t.encode()).hexdigest() for d, _, _, t in expected}


def test_reference_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    columns = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({line_dedup.SQL})").fetchall()
    assert sorted(map(tuple, line_dedup.query(spark, DATA).select(columns).collect())) == sorted(expected)


LICENCE = "This Line Is Found In Many Documents, É And All"


def test_lines_keys_and_ties(spark):
    lower = key_of(LICENCE)
    assert len(lower) >= 40
    short = "x" * 39
    rows = [
        (1, f"a\n{LICENCE}\nb"), (2, f" {lower}\r\n\n{LICENCE}\t"), (3, f"{LICENCE}\n{short}"),
        (4, f"{lower}\n{short}"), (5, f"{LICENCE}\nkept\n \x0b{lower}"), (6, short), (7, short), (8, short),
        # É does not lower: another line, in four documents only
        *[(10 + i, lower.replace("É", "é") + "\nrest") for i in range(4)],
        (11, lower.replace("É", "é")), (11, lower.replace("É", "é")),
    ]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    got = reported(docs)
    assert got == sorted(brute(rows), key=repr)
    assert (2, 3, 2, "") in got and (1, 3, 1, "a\nb") in got and (5, 3, 0, rows[4][1]) in got


def test_null_ids_are_one_document(spark):
    rows = [(None, LICENCE), (None, LICENCE + "\nx"), *[(i, f"{LICENCE}\n{i}") for i in range(4)], (3, LICENCE)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    got = reported(docs)
    assert got == sorted(brute(rows), key=repr) and (None, 1, 1, "") in got and (3, 1, 0, LICENCE) in got
    assert reported(docs.where("doc_id is null or doc_id > 0")) == sorted(brute([r for r in rows if r[0] != 0]), key=repr)


def test_odd_rows_and_clashing_columns(spark, odd_documents, no_documents):  # noqa: F811
    names = ("drop", "drop_", "positions", "pos", "h1", "t1", "keeper", "docs", "marks", "n_lines", "_id")
    docs = odd_documents
    for n in names:
        docs = docs.withColumn(n, odd_documents["lang"])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert reported(docs) == sorted(brute(rows), key=repr)
    # three documents are enough here: the repeated text goes from all but the largest id
    kept = line_dedup.drop_common_lines(docs, min_chars=5, min_docs=2)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(
        (d or 0, t) for d, _, _, t in brute(rows, 5, 2)
    )
    assert reported(no_documents) == []


def test_text_of_many_lines(spark):
    """One document holds a third of all lines, and all but its own go."""
    common = [f"line number {i} of the passage that every document repeats" for i in range(20000)]
    rows = [(9, "\n".join(common + ["tail"])), *[(i, "\n".join(common[i::6])) for i in range(6)], (10, "\n".join(common))]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    assert reported(docs, min_docs=3) == sorted(brute(rows, min_docs=3), key=repr)
