"""Mixing sources to target weights by a low-discrepancy schedule of token blocks.

Each source's documents, in a shuffled order, form one stream of words that is cut into
blocks of equally many words. Slot i of the mix takes the golden-ratio point
frac(i * phi); the source whose interval of cumulative targets holds the point gets the
slot. The slots of a source are ranked, and its r-th slot takes the r-th block of its
stream, starting over at the end of the stream; no source gets more slots than two
passes hold. What a document gives is the overlap of its words with the taken blocks.

Nothing but built-in expressions. A hot source is split: its running word counts are
taken within ranges of the shuffled order and its slots are ranked within runs of slots, and the join
key (source, block) spreads it evenly.

Cases: null text counts no words and takes none; a null source is a source of its own,
the last; repeated rows are rows of their own; an empty table gives an empty result;
other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, free_name, pin, running_total

#: Words of one slot.
BLOCK = 256
#: Rows per bucket of a source's stream, about, and slots per ranked run.
BUCKET = 1 << 12
RUN = 1 << 15
#: The golden ratio's fraction as a share of 2**40.
GOLDEN = 679523144761
BITS = 40


def word_count(column: str = "text"):
    return F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights, share: float, cap: float) -> DataFrame:
    """(source, sid, source_size, target) of each source of `sizes` (source, size).

    Targets are min(cap * size, level * weight); the level rises as capped sources
    leave, until no source is above its cap. One small aggregate per step.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_total(
        sources.withColumn("one", F.lit(1).cast("long")), F.col("source").asc_nulls_last(), "one", "sid"
    ).drop("one")
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = pin(
        ranked.withColumn(
            "weight", F.element_at(table, (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
        )
    )
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    most = F.lit(float(cap)) * F.col("source_size")
    level, capped = 0.0, -1
    while True:
        over = most < F.lit(level) * F.col("weight")
        n, fixed, open_weight = ranked.agg(
            F.count_if(over),
            F.sum(F.when(over, most)),
            F.sum(F.when(~over, F.col("weight"))),
        ).first()
        if n == capped or not open_weight:
            break
        capped = n
        level = (share * whole - (fixed or 0.0)) / open_weight
    return ranked.select(
        "source", "sid", "source_size", F.least(most, F.lit(level) * F.col("weight")).alias("target")
    )


def slots(sources: DataFrame, block: int) -> DataFrame:
    """(sid, block): the blocks of each source's stream that the schedule takes."""
    spark = sources.sparkSession
    total, count = sources.agg(F.sum("target"), F.count("*")).first()
    number = -(-int(round(total or 0)) // block)
    if not number:
        return spark.createDataFrame([], "sid long, block long")
    span = 1 << BITS
    held = running_total(sources.where("target > 0"), F.col("sid").asc(), "target", "low")
    cell_bits = BITS - max(10, (4 * count).bit_length())
    low = F.floor(F.col("low") / F.lit(total) * span).cast("long")
    high = F.floor((F.col("low") + F.col("target")) / F.lit(total) * span).cast("long")
    cells = (
        held.select("sid", low.alias("lo"), high.alias("hi"))
        .where("hi > lo")
        .withColumn(
            "cell",
            F.explode(
                F.sequence(F.shiftright("lo", cell_bits), F.shiftright(F.col("hi") - 1, cell_bits))
            ),
        )
    )
    half = 1 << (BITS // 2)
    upper, lower = F.floor(F.col("id") / half).cast("long"), F.pmod("id", F.lit(half))
    point = F.pmod(
        F.pmod(upper * F.lit(GOLDEN % half), F.lit(half)) * half + F.pmod(lower * F.lit(GOLDEN), F.lit(span)),
        F.lit(span),
    )
    points = (
        spark.range(number)
        .withColumn("x", point)
        .withColumn("cell", F.shiftright("x", cell_bits))
        .withColumn("run", F.floor(F.col("id") / RUN))
    )
    dealt = points.join(cells, "cell").where("x >= lo and x < hi").select("sid", "run", "id")
    counts = dealt.groupBy("sid", "run").agg(F.count("*").alias("n"))
    before = counts.select(
        "sid",
        "run",
        (F.sum("n").over(Window.partitionBy("sid").orderBy("run")) - F.col("n")).alias("before"),
    )
    rank = F.row_number().over(Window.partitionBy("sid", "run").orderBy("id")) - 1
    return (
        dealt.withColumn("rank", rank)
        .join(before, ["sid", "run"])
        .select("sid", (F.col("before") + F.col("rank")).alias("block"))
    )


def mix(
    docs: DataFrame,
    weights=(5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    block: int = BLOCK,
    seed: str = "mix",
) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of `docs` (doc_id, source, text)."""
    return mixed_rows(docs, weights, share, cap, block, seed).drop("source", "text_hash")


def mixed_rows(
    docs: DataFrame,
    weights=(5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    block: int = BLOCK,
    seed: str = "mix",
) -> DataFrame:
    """The columns of `mix`, and source and text_hash, which tell the rows of one id apart."""
    sized = pin(docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("text_hash")))
    sources = pin(source_targets(sized, weights, share, cap))
    buckets = max(1, -(-sized.count() // BUCKET))
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    stream = (
        sized.join(sources, sized["source"].eqNullSafe(sources["source"]))
        .select(
            "doc_id", sized["source"], "text_hash", "size", "sid", "source_size", "target", order.alias("key")
        )
        .withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)))
    )
    sums = stream.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    before = sums.select(
        "sid",
        "bucket",
        (F.sum("n").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("n")).alias("before"),
    )
    within = F.sum("size").over(
        Window.partitionBy("sid", "bucket")
        .orderBy("key", "doc_id", "size", "text_hash")
        .rowsBetween(Window.unboundedPreceding, 0)
    ) - F.col("size")
    placed = (
        stream.withColumn("within", within)
        .join(before, ["sid", "bucket"])
        .withColumn("start", F.col("before") + F.col("within"))
    )
    own = ["doc_id", "source", "text_hash", "size", "sid", "source_size", "target", "start"]
    names = ["doc_id", "source", "text_hash", "size", "source_size", "target"]
    passes = placed.where("size > 0").withColumn(
        "at", F.explode(F.array(*[F.col("start") + e * F.col("source_size") for e in range(cap)]))
    )
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    parts = passes.withColumn("block", F.explode(F.sequence(first, last)))
    overlap = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(
        F.col("at"), F.col("block") * block
    )
    taken = (
        parts.join(slots(sources, block).withColumn("hit", F.lit(True)), ["sid", "block"], "left")
        .groupBy(*own)
        .agg(F.sum(F.when(F.col("hit"), overlap).otherwise(F.lit(0))).cast("long").alias("taken"))
    )
    return taken.select(*names, "taken").union(
        placed.where("size = 0").select(*names, F.lit(0).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """`docs` as the mix holds them: a document stands once for each time that the mix
    takes all or most of it, and not at all if it takes less than half. A document without
    words (null, empty or blank text) has nothing to take or leave and stands once. Rows of
    one id, source and text, null or not, are one document here and share what it is given."""
    times = F.try_divide(F.sum("taken"), F.sum("size"))
    copy, number = free_name("copy", docs.columns), free_name("number", docs.columns)
    copies = (
        mixed_rows(docs, **options)
        .groupBy("doc_id", "source", "text_hash")
        .agg(F.when(F.sum("size") == 0, F.lit(1.0)).otherwise(times).alias("times"))
        .withColumn("n", F.floor(F.col("times") + 0.5).cast("int"))
        .where("n > 0")
        .select(F.struct("doc_id", "source", "text_hash", "n").alias(copy))
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col(copy)["doc_id"])
        & F.col("source").eqNullSafe(F.col(copy)["source"])
        & (F.xxhash64("text") == F.col(copy)["text_hash"])
    )
    return (
        docs.join(copies, same)
        .withColumn(number, F.explode(F.sequence(F.lit(1), F.col(copy)["n"])))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def query(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
    FROM documents),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid
    FROM sized GROUP BY source),
weighed AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight FROM sources),
levels AS (
    -- if the sources before this one, in the order of their caps' levels, are capped
    SELECT 2e0 * source_size / weight AS own,
        (1.5e0 * sum(source_size) OVER () - coalesce(sum(2e0 * source_size) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM weighed
    WINDOW before AS (ORDER BY 2e0 * source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
    SELECT *, least(2e0 * source_size, (SELECT max(level) FROM levels WHERE level <= own) * weight) AS target
    FROM weighed),
held AS (
    SELECT sid, target, sum(target) OVER (ORDER BY sid) - target AS low, sum(target) OVER () AS total
    FROM targets WHERE target > 0),
bounds AS (
    SELECT sid, floor(low / total * 1099511627776) AS lo, floor((low + target) / total * 1099511627776) AS hi FROM held),
points AS (
    SELECT i, CAST(i AS HUGEINT) * {GOLDEN} % 1099511627776 AS x
    FROM range((SELECT CAST(ceil(round(max(total)) / {BLOCK}) AS BIGINT) FROM held)) r(i)),
slots AS (
    SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY i) - 1 AS block
    FROM points JOIN bounds ON x >= lo AND x < hi),
placed AS (
    SELECT doc_id, size, sid, source_size, target, row_number() OVER () AS uid,
        sum(size) OVER (PARTITION BY sid ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
parts AS (
    SELECT *, unnest(range(pos // {BLOCK}, (pos + size - 1) // {BLOCK} + 1)) AS block
    FROM (SELECT *, CAST(start + e * source_size AS BIGINT) AS pos FROM placed, range(2) r(e) WHERE size > 0)),
taken AS (
    SELECT uid, sum(least(pos + size, (block + 1) * {BLOCK}) - greatest(pos, block * {BLOCK})) AS taken
    FROM parts JOIN slots USING (sid, block) GROUP BY uid)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM placed LEFT JOIN taken USING (uid)
"""
