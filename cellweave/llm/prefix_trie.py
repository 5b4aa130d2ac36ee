"""Prefix trie of conversations, measured by the Euler-tour technique.

Conversations are rebuilt (see `rebuilt`), and each distinct sequence of first turns is a
node. A node is known by its depth and 128 bits: the exclusive-or of a hash of (position,
turn) over its turns, so that all prefixes of a conversation come from one prefix sum.

* Nodes: one grouping of (conversation, depth) rows by that key, combined before the
  shuffle.
* Tour: parents and children are sorted as families, each parent before its children.
  The row after a row gives first children and next siblings, and thereby the successor
  of each node's enter and exit arc; the parent row before a child gives its parent.
* List ranking: arcs whose id hashes to 0 in `SPACING` are rulers; pointers double until
  they reach the next ruler, the list of rulers is ranked the same way, and a list of at
  most `SMALL` arcs is walked in one task. Work is in proportion to the arcs.
* Prefix sums of leaves and savings over arcs in tour order, in blocks of positions; a
  subtree's value is the sum at its exit arc without that before its enter arc.

Sorted steps deal rows by ranges of the whole order, so that a conversation or a node's
children may be spread over many tasks; what crosses from one range to the next is one
row for each range and group. Ids of the conversations that end at a node are joined to
text in chunks, and the chunks run through the digest in order, in bounded memory.

Cases: rows with a null conv_id belong to no conversation; turns of one number are ordered
by role and a digest of the turn, equal turns stay turns of their own; null role or text
is empty; a conversation without turns is a member of the root only; an empty table has no
nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import pin

#: One arc in so many is a ruler; a list of so many arcs is walked in one task.
SPACING, SMALL = 64, 1 << 13
#: Positions of the tour in one block; ids in one chunk of text.
BLOCK, CHUNK = 1 << 16, 1 << 12
#: Turns that the rule takes over are fewer than this; groups of conversations.
HEADS, FAMILY = 6, 100
END = -1


# --- sorted ranges --------------------------------------------------------------------


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """`df` dealt by ranges of `order` and written, with the number of the range (`_part`).

    Equal rows are told apart, so that many of them are dealt too.
    """
    told = df.withColumn("_tell", F.monotonically_increasing_id())
    return pin(told.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (*order, "_tell")]).withColumn("_part", F.spark_partition_id()))


def prefixes(part: DataFrame, group: list[str], order: list[str], sums: Mapping[str, Column]) -> DataFrame:
    """A table of `ranged` with the sum or exclusive-or of each of `sums` over the rows of
    the group up to each row, and `size`, the rows of the group in all ranges."""
    base = part.withColumns({f"_{n}": c for n, c in sums.items()})
    fold = {n: (F.bit_xor if n.startswith("x") else F.sum) for n in sums}
    totals = base.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), *[fold[n](f"_{n}").alias(f"_{n}") for n in sums])
    across = Window.partitionBy(*group)
    before = across.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "_part", *group, F.sum("_n").over(across).alias("size"),
        *[F.coalesce(fold[n](f"_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums],
    )
    up_to = Window.partitionBy("_part", *group).orderBy(*[F.col(c).asc_nulls_first() for c in (*order, "_tell")]).rowsBetween(Window.unboundedPreceding, 0)
    whole = base.withColumns({n: fold[n](f"_{n}").over(up_to) for n in sums}).join(carried, ["_part", *group])
    add = {n: (F.col(n).bitwiseXOR(F.col(f"_before_{n}")) if n.startswith("x") else F.col(n) + F.col(f"_before_{n}")) for n in sums}
    return whole.withColumns(add).drop(*[f"_{n}" for n in sums], *[f"_before_{n}" for n in sums])


# --- conversations --------------------------------------------------------------------


def takes(conv: str = "conv_id") -> Column:
    """How many turns the rule takes over from the first conversation of the family."""
    return (F.crc32(F.col(conv).cast("string").cast("binary")) % HEADS).cast("int")


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_key, chars, size): turns from 0, by number, role and digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    turns = rows.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), named.alias("turn_key"), F.char_length(text).cast("long").alias("chars"))
    order = ["turn", "role", "turn_key"]
    placed = prefixes(ranged(turns, "conv_id", *order), ["conv_id"], order, {"pos": F.lit(1)})
    return placed.select("conv_id", (F.col("pos") - 1).alias("pos"), "turn_key", "chars")


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, turn_key, chars, x1, x2, size) of the rebuilt conversations.

    Conversation c takes the first h turns of conversation c - c % 100, h = crc32(c) % 6,
    and has its own turns after its first h. x1 and x2 name the prefix that ends here.
    """
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS - 1))
    heads = heads.select(F.col("conv_id").alias("base"), "pos", "turn_key", "chars")
    taken = (
        convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), takes().alias("h"))
        .join(heads, "base")
        .where("pos < h")
        .select("conv_id", F.lit(0).alias("own"), "pos", "turn_key", "chars")
    )
    own = turns.where(F.col("pos") >= takes()).select("conv_id", F.lit(1).alias("own"), "pos", "turn_key", "chars")
    order = ["own", "pos"]
    part = ranged(taken.union(own), "conv_id", *order)
    placed = pin(prefixes(part, ["conv_id"], order, {"depth": F.lit(1)}))
    marks = {"x1": F.xxhash64("depth", "turn_key"), "x2": F.xxhash64(F.lit(1), "depth", "turn_key")}
    return prefixes(placed.drop("size"), ["conv_id"], order, marks).withColumns(
        {f"p{n}": F.col(n).bitwiseXOR(mark) for n, mark in marks.items()}
    )


def nodes_of(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """(id, depth, x1, x2, px1, px2, conv_id, n_convs, chars), the root included."""
    below = steps.groupBy("depth", "x1", "x2").agg(
        F.min("px1").alias("px1"), F.min("px2").alias("px2"), F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), F.lit(None).cast("long").alias("px1"),
        F.lit(None).cast("long").alias("px2"), "conv_id", "n_convs", zero.alias("chars"),
    )
    return pin(below.union(root).withColumn("id", F.monotonically_increasing_id()))


def digests_of(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of ends (depth, x1, x2, conv_id), ids ascending."""
    key = ["depth", "x1", "x2"]

    def chunks(batches):
        held, ids = None, []

        def row():
            return (*held, ids[0], ",".join(map(str, ids)))

        for batch in batches:
            out = []
            for *at, conv in zip(*[batch.column(c).to_pylist() for c in (*key, "conv_id")], strict=True):
                if ids and (at != held or len(ids) == CHUNK):
                    out.append(row())
                    ids = []
                held = at
                ids.append(conv)
            if out:
                yield _batch(out, [*key, "first", "joined"])
        if ids:
            yield _batch([row()], [*key, "first", "joined"])

    def digest(batches):
        held, state = None, None
        for batch in batches:
            out = []
            for *at, joined in zip(*[batch.column(c).to_pylist() for c in (*key, "joined")], strict=True):
                if at != held:
                    if held:
                        out.append((*held, state.hexdigest()))
                    held, state = at, hashlib.sha256(joined.encode())
                else:
                    state.update(b"," + joined.encode())
            if out:
                yield _batch(out, [*key, "ends_sha256"])
        if held:
            yield _batch([(*held, state.hexdigest())], [*key, "ends_sha256"])

    order = [*key, "conv_id"]
    parts = (
        ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(chunks, "depth long, x1 long, x2 long, first long, joined string")
    )
    return parts.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digest, "depth long, x1 long, x2 long, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {n: pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)}
    )


# --- the tour -------------------------------------------------------------------------


def families(nodes: DataFrame) -> DataFrame:
    """Rows of parents (child 0) and of children (child 1), by (depth, x1, x2) of the parent
    and conv_id, each with the row after it and, on children, the conv_id and id of their parent."""
    key = ["depth", "x1", "x2"]
    rows = nodes.select(*key, F.lit(0).alias("child"), "conv_id", "id").union(
        nodes.where("depth > 0").select(F.col("depth") - 1, "px1", "px2", F.lit(1), "conv_id", "id")
    )
    order = [*key, "child", "conv_id"]
    part = ranged(rows, *order)
    row = F.struct(*order, "id")
    edges = part.groupBy("_part").agg(
        F.min(row).alias("first"), F.max(F.when(F.col("child") == 0, row)).alias("parent")
    )  # one row for each range
    across = Window.orderBy("_part")
    edges = edges.select(
        "_part",
        F.lead("first").over(across).alias("_after"),
        F.last("parent", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_above"),
    )
    within = Window.partitionBy("_part").orderBy(*order)
    seen = F.last(F.when(F.col("child") == 0, row), ignorenulls=True)
    return (
        part.withColumn("_next", F.lead(row).over(within))
        .withColumn("_parent", seen.over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(edges, "_part")
        .select(*order, "id", F.coalesce("_next", "_after").alias("next"), F.coalesce("_parent", "_above").alias("parent"))
    )


def arcs_of(family: DataFrame) -> DataFrame:
    """(arc, next): enter arcs have even, exit arcs odd numbers; the last has next END."""
    follows = F.col("next.child") == 1
    for c in ("depth", "x1", "x2"):
        follows = follows & (F.col(f"next.{c}") == F.col(c))
    follows = F.coalesce(follows, F.lit(False))
    enter = F.col("next.id") * 2
    down = family.where("child = 0").select(
        (F.col("id") * 2).alias("arc"), F.when(follows, enter).otherwise(F.col("id") * 2 + 1).alias("next")
    )
    up = family.where("child = 1").select(
        (F.col("id") * 2 + 1).alias("arc"), F.when(follows, enter).otherwise(F.col("parent.id") * 2 + 1).alias("next")
    )
    last = family.where("child = 0 and depth = 0").select((F.col("id") * 2 + 1).alias("arc"), F.lit(END).cast("long").alias("next"))
    return down.union(up).union(last)


def distances(links: DataFrame, level: int = 0, spacing: int = SPACING, small: int = SMALL) -> DataFrame:
    """(arc, left): the sum of `gap` from each of links (arc, next, gap) to the list's end."""
    if links.limit(small + 1).count() <= small:
        return pin(links.coalesce(1).mapInArrow(_walk, "arc long, left long"))

    def ruler(c: Column) -> Column:
        return (F.pmod(F.xxhash64(F.lit(level), c), F.lit(spacing)) == 0) | (c == END)

    done, active = links.where(ruler(F.col("next"))), links.where(~ruler(F.col("next")))
    reached = [done]
    while not active.isEmpty():
        # pointers of plain arcs to plain arcs are all different: no key is hot here
        onward = active.union(done).select(F.col("arc").alias("next"), F.col("next").alias("then"), F.col("gap").alias("more"))
        onward = onward.where(~ruler(F.col("next")))
        moved = pin(active.join(onward, "next").select("arc", F.col("then").alias("next"), (F.col("gap") + F.col("more")).alias("gap")))
        stopped = moved.where(ruler(F.col("next")))
        reached.append(stopped)
        done, active = done.union(stopped), moved.where(~ruler(F.col("next")))
    whole = pin(done)
    rest = distances(whole.where(ruler(F.col("arc"))), level + 1, spacing, small).select(F.col("arc").alias("next"), "left")
    return whole.join(rest, "next", "left").select("arc", (F.col("gap") + F.coalesce("left", F.lit(0))).alias("left"))


def _walk(batches):
    """The list walked backwards from its end; at most `SMALL` arcs."""
    columns = [np.concatenate(c) for c in zip(*[[b.column(n).to_numpy() for n in ("arc", "next", "gap")] for b in batches], strict=True)]
    if not columns:
        return
    arcs, nexts, gaps = columns
    before = {n: i for i, n in enumerate(nexts.tolist())}
    left, at, total = np.zeros(len(arcs), np.int64), END, 0
    for _ in range(len(arcs)):
        i = before[at]
        total += int(gaps[i])
        left[i], at = total, int(arcs[i])
    yield pa.RecordBatch.from_pydict({"arc": pa.array(arcs), "left": pa.array(left)})


def subtree_sums(arcs: DataFrame, nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(id, n_leaves, saved_tokens) from prefix sums over the arcs in tour order."""
    ranks = distances(arcs.withColumn("gap", F.lit(1).cast("long")))
    values = nodes.join(leaves, "id", "left").select(
        (F.col("id") * 2).alias("arc"),
        F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    zero = F.lit(0).cast("long")
    # counted from the end: `left` falls along the tour, and sums run from the last arc
    toured = pin(
        ranks.join(values, "arc", "left").select(
            "arc", "left", F.floor(F.col("left") / BLOCK).alias("block"), F.coalesce("leaf", zero).alias("leaf"), F.coalesce("saved", zero).alias("saved")
        )
    )
    names = ("leaf", "saved")
    totals = toured.groupBy("block").agg(*[F.sum(n).alias(f"_{n}") for n in names])
    later = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    carried = totals.select("block", *[F.coalesce(F.sum(f"_{n}").over(later), zero).alias(f"_{n}") for n in names])
    within = Window.partitionBy("block").orderBy("left").rowsBetween(Window.unboundedPreceding, 0)
    summed = toured.withColumns({n: F.sum(n).over(within) for n in names}).join(carried, "block")
    is_exit = F.col("arc") % 2 == 1
    # enter arcs hold the values: the sum from the exit's rest to the enter arc is the subtree
    return summed.groupBy(F.floor(F.col("arc") / 2).alias("id")).agg(
        *[F.sum(F.when(is_exit, -1).otherwise(1) * (F.col(n) + F.col(f"_{n}"))).alias(a) for n, a in zip(names, ("n_leaves", "saved_tokens"), strict=True)]
    )


def trie(rows: DataFrame) -> DataFrame:
    """A row for each node of conversations `rows` (conv_id, turn, role, text)."""
    turns = pin(turns_of(rows))
    convs = pin(turns.select("conv_id").distinct())
    steps = pin(rebuilt(turns, convs))
    nodes = nodes_of(steps, convs)
    family = pin(families(nodes))
    children = family.where("child = 1").groupBy(F.col("parent.id").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    leaves = nodes.select("id").join(children, "id", "left_anti").withColumn("leaf", F.lit(1))
    sums = subtree_sums(arcs_of(family), nodes, leaves)
    ended = steps.where("depth = size").select("depth", "x1", "x2", "conv_id")
    zero = F.lit(0).cast("long")
    turnless = convs.join(steps.select("conv_id").distinct(), "conv_id", "left_anti").select(zero, zero, zero, "conv_id")
    digests = digests_of(ended.union(turnless))
    parents = family.where("child = 1").select("id", F.col("parent.conv_id").alias("parent_conv_id"))
    return (
        nodes.join(sums, "id").join(children, "id", "left").join(parents, "id", "left").join(digests, ["depth", "x1", "x2"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


def query(spark, sf_dir):
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


SQL = """
WITH RECURSIVE crc AS (
    -- the remainders of all bytes, eight steps of the polynomial each
    SELECT b, 0 AS step, CAST(b AS UBIGINT) AS v FROM range(256) r(b)
    UNION ALL
    SELECT b, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END FROM crc WHERE step < 8),
codes AS (SELECT list(v ORDER BY b) AS t FROM crc WHERE step = 8),
turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id
            ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
    SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(
            list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
            lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INTEGER) + 1])), CAST(4294967295 AS UBIGINT)) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM turns), codes),
joined AS (
    SELECT convs.conv_id, 0 AS own, pos, role, text FROM convs JOIN turns ON turns.conv_id = base AND pos < h
    UNION ALL
    SELECT conv_id, 1, pos, role, text FROM convs JOIN turns USING (conv_id) WHERE pos >= h),
steps AS (
    SELECT conv_id, row_number() OVER w AS depth, list({'role': role, 'text': text}) OVER w AS path, length(text) AS chars,
        count(*) OVER (PARTITION BY conv_id) AS size
    FROM joined WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)),
members AS (
    SELECT conv_id, depth, path, chars, depth = size AS ends FROM steps
    UNION ALL
    SELECT conv_id, 0, [], 0, conv_id NOT IN (SELECT conv_id FROM steps) FROM convs),
nodes AS (
    SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM members GROUP BY path),
-- the ancestors of a node, itself included, are what its smallest member passes on the way
above AS (
    SELECT nodes.conv_id, nodes.depth, members.path AS top, members.depth AS top_depth, n_convs, nodes.chars
    FROM nodes JOIN members ON members.conv_id = nodes.conv_id AND members.depth <= nodes.depth),
parents AS (
    SELECT above.conv_id, above.depth, above.top, nodes.conv_id AS parent_conv_id
    FROM above JOIN nodes ON above.top = nodes.path WHERE above.top_depth = above.depth - 1),
children AS (SELECT top AS path, count(*) AS n_children FROM parents GROUP BY top),
leaves AS (SELECT conv_id, depth FROM nodes WHERE path NOT IN (SELECT path FROM children)),
sums AS (
    SELECT top AS path, count(leaves.conv_id) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens
    FROM above LEFT JOIN leaves USING (conv_id, depth) GROUP BY top)
SELECT nodes.conv_id, nodes.depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM nodes JOIN sums USING (path) LEFT JOIN children USING (path) LEFT JOIN parents USING (conv_id, depth)
"""
