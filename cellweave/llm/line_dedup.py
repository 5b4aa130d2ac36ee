"""Line deduplication: lines that stand in many documents are dropped from all but one.

Texts are split at line feeds. A line's key is the line without the white space at its
ends and with A-Z lower-cased; keys of at least `min_chars` code points are hashed and
exploded, distinct documents are counted for each hash, and what stands in `min_docs`
documents or more goes from all documents but the one with the largest id. What is left is
put together again by position.

Nothing but built-in expressions. Texts are normalised once, and only hashes (128 bits a
line) are written, shuffled and counted. Counts of a line that stands in a third of all
documents are combined before they are shuffled, over (hash, document) first and over the
hash after that. Its lines meet the common hashes in a plain inner join, whose large
partitions adaptive execution splits. Positions are collected for each text, never more
than the text has lines.

Cases: a null or empty text is one empty line; null ids are one document, the smallest;
rows of one id are one document, and each of them loses the same lines; equal rows stay
equal; within the document that keeps a line all its copies stay; a text that loses all
lines becomes empty; an empty table gives an empty result; other columns are not read and
may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pin

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def ascii_lower(line: Column) -> Column:
    """A-Z only; texts without other letters take the faster way."""
    plain = F.octet_length(line) == F.char_length(line)
    return F.when(plain, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def hashes(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different seeds: 128 bits together."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def hashed_lines(text: Column, min_chars: int) -> Column:
    """Array of (pos, h1, h2) of the lines that are long enough."""
    keys = F.transform(
        F.transform(lines_of(text), lambda line: F.btrim(line, F.lit(SPACE))),
        lambda line: F.when(F.char_length(line) >= min_chars, ascii_lower(line)),
    )

    def marked(key, pos):
        h1, h2 = hashes(key)
        return F.when(key.isNotNull(), F.struct(pos.alias("pos"), h1.alias("h1"), h2.alias("h2")))

    return F.filter(F.transform(keys, marked), lambda mark: mark.isNotNull())


def dropped_positions(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, t1, t2, positions) of each text, by id and hashes, that loses lines."""
    text = F.coalesce("text", F.lit(""))
    t1, t2 = hashes(text)
    marked = pin(
        docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), hashed_lines(text, min_chars).alias("marks")).where(
            F.size("marks") > 0
        )
    )
    lines = marked.select("doc_id", "t1", "t2", F.inline("marks"))
    nameless = F.max(F.when(F.col("doc_id").isNull(), 1).otherwise(0))
    common = (
        lines.groupBy("h1", "h2")
        .agg((F.count_distinct("doc_id") + nameless).alias("docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("docs") >= min_docs)
        .select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "keeper")
    )
    # met on one hash and compared on the other: both sides are then dealt for this join
    # alone, and adaptive execution can split the rows of a hot line
    same = (F.col("h1") == F.col("c1")) & (F.col("h2").bitwiseXOR(F.col("c2")) == 0)
    return (
        lines.join(common, same)
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "t1", "t2")
        .agg(F.collect_set("pos").alias("positions"))
    )


def without(text: Column, positions: Column) -> Column:
    """`text` without the lines at `positions`. Both arrays are bound once, so that the
    work is in proportion to the lines."""
    held = F.array(
        F.struct(
            lines_of(text).alias("lines"),
            F.array_except(F.sequence(F.lit(0), F.size(lines_of(text)) - 1), positions).alias("stay"),
        )
    )
    return F.transform(
        held, lambda s: F.array_join(F.transform(s["stay"], lambda pos: F.get(s["lines"], pos)), "\n")
    )[0]


def drop_common_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, report: bool = False) -> DataFrame:
    """`docs` (doc_id, text, ...) with the text of each row without its common lines.

    With `report` the result is (doc_id, n_lines, n_dropped, text) instead: the number of
    lines before and of those dropped, and the text that is left.
    """
    drops = dropped_positions(docs, min_chars, min_docs).select(
        F.struct("doc_id", "t1", "t2", "positions").alias(free := _free("drop", docs.columns))
    )
    text, drop = F.coalesce("text", F.lit("")), F.col(free)
    t1, t2 = hashes(text)
    joined = docs.join(drops, docs["doc_id"].eqNullSafe(drop["doc_id"]) & (t1 == drop["t1"]) & (t2 == drop["t2"]), "left")
    left = F.when(drop.isNull(), F.col("text")).otherwise(without(text, drop["positions"]))
    if not report:
        return joined.select(*[left.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    return joined.select(
        "doc_id",
        F.size(lines_of(text)).cast("long").alias("n_lines"),
        F.coalesce(F.size(drop["positions"]), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(left, F.lit("")).alias("text"),
    )


def _free(name: str, taken: list[str]) -> str:
    """`name`, made longer until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_common_lines(docs, report=True).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
    FROM lines),
common AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT keyed.*, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
