"""MinHash near-duplicates with odd sketches.

A document is the set of its 4-word shingles, as 64-bit hashes. Banded MinHash proposes
buckets of similar sets. A second MinHash sample, one minimum for each of 1,024 ranges of
the hash, is folded into a bitmap of parities; the population count of two bitmaps' XOR
gives the size of the samples' symmetric difference and so the similarity, closely where
it is high. Pairs whose estimate is near or above the threshold are confirmed on the full
sets.

Equal sets are one node. Buckets of the same members are looked at once; large ones are
split into blocks, and pairs of blocks are compared in tasks of their own. A task does not
emit its pairs: it returns the strongest spanning forest of its candidate pairs, at most
one edge for each member. After these are confirmed, only candidate pairs between
different components can still change the result. Full sets go to the buckets where such
pairs are left, and all of them are confirmed there, each pair in one bucket only; what
comes out are links that join components. Full sets are made only for nodes that stand in
a candidate pair.

Cases: null, empty and blank texts have an empty set and link with nothing; a null id
links with nothing; repeated rows are one document with several texts, and their rows
are all kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_group, components, free_name, join_few, maybe_in, pin, pin_texts

WORDS = 4
#: A link holds when 100 * intersection >= PERCENT * union.
PERCENT = 80
BANDS, PER_BAND = 20, 4
SAMPLE_BITS = 10
SKETCH_BITS = 11
#: How many standard errors below the threshold an estimate may lie for its pair to be
#: confirmed exactly.
ERRORS = 6.0
BLOCK = 1024
SEED = 4_000_037
#: Bytes of text that are hashed together; some ten numbers of 8 bytes are held for each.
CHUNK = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finish of 64-bit hashes."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Shingler:
    """Sorted sets of shingle hashes of texts (UTF-8), many at a time.

    A word's hash is a difference of prefix sums of a polynomial over its bytes.
    """

    def __init__(self):
        self._up = self._down = np.zeros(0, np.uint64)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        if len(data) > len(self._up):
            self._up = _powers(len(data), _BASE)
            self._down = _powers(len(data), pow(_BASE, -1, 1 << 64))
        inside = np.r_[False, ~_SPACE[data], False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.r_[_U(0), np.cumsum((data.astype(np.uint64) + _U(1)) * self._up[: len(data)])]
        word = mixed((sums[ends] - sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))
        limits = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
        many = _U(0xD6E8FEB86659FD93)
        rolled = word
        for k in range(1, WORDS):
            rolled = rolled[:-1] * many + word[k:] if len(rolled) > 1 else rolled[:0]
        rolled = mixed(rolled)
        out = []
        for low, high in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
            if high - low >= WORDS:
                out.append(np.unique(rolled[low : high - WORDS + 1]))
            elif high > low:
                h = _U(high - low)
                for w in word[low:high]:
                    h = h * many + w
                out.append(mixed(np.array([h], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def chunks(column):
    """Lists of texts of about CHUNK bytes together; a longer one stands alone."""
    held, size = [], 0
    for value in column:
        text = value.as_py() or b""
        if held and size + len(text) > CHUNK:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def multipliers() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return rng.integers(1 << 62, 1 << 64, BANDS * PER_BAND, dtype=np.uint64) | _U(1)


def band_hashes(items: np.ndarray, by: np.ndarray) -> np.ndarray:
    """MinHash values, hashed band by band."""
    low = np.full(len(by), ~_U(0))
    for at in range(0, len(items), 4096):
        low = np.minimum(low, mixed(items[at : at + 4096, None] * by).min(0))
    low = low.reshape(BANDS, PER_BAND)
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(PER_BAND):
        h = mixed(h * _U(_BASE) + low[:, k])
    return h.view(np.int64)


def odd_sketch(items: np.ndarray) -> tuple[bytes, int]:
    """Parity bitmap of the minimum of each range of the (sorted) hashes; number of minima."""
    ranges = items >> _U(64 - SAMPLE_BITS)
    first = np.r_[True, ranges[1:] != ranges[:-1]]
    sample = items[first]
    at = (mixed(sample ^ _U(SEED)) >> _U(64 - SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(at, minlength=1 << SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).tobytes(), len(sample)


#: A pair of blocks of a bucket.
KEY = ("bucket", "first", "second")
SKETCHED = "doc_id long, text_hash long, n_shingles long, key binary, bands array<long>, sketch binary, filled int"


def sketch(batches):
    shingler, by = Shingler(), multipliers()
    with np.errstate(over="ignore"):
        for batch in batches:
            sizes, keys, bands, sketches, filled = [], [], [], [], []
            for texts in chunks(batch["text"].cast(pa.binary())):
                for items in shingler.sets(texts):
                    sizes.append(len(items))
                    keys.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                    bits, n = odd_sketch(items) if len(items) else (b"", 0)
                    bands.append(band_hashes(items, by) if len(items) else [])
                    sketches.append(bits)
                    filled.append(n)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"],
                    "text_hash": batch["text_hash"],
                    "n_shingles": pa.array(sizes, pa.int64()),
                    "key": pa.array(keys, pa.binary()),
                    "bands": pa.array(bands, pa.list_(pa.int64())),
                    "sketch": pa.array(sketches, pa.binary()),
                    "filled": pa.array(filled, pa.int32()),
                }
            )


def full_sets(batches):
    """id and its set as bytes."""
    shingler = Shingler()
    with np.errstate(over="ignore"):
        for batch in batches:
            at = 0
            for texts in chunks(batch["text"].cast(pa.binary())):
                items = [s.tobytes() for s in shingler.sets(texts)]
                yield pa.RecordBatch.from_pydict(
                    {"id": batch["doc_id"][at : at + len(texts)], "items": pa.array(items, pa.binary())}
                )
                at += len(texts)


def estimates(sketches: np.ndarray, filled: np.ndarray, sizes: np.ndarray, a: slice | np.ndarray, b) -> np.ndarray:
    """Estimated similarity of rows `a` and `b`, less what its error allows for."""
    odd = np.zeros((len(filled[a]), len(filled[b])), np.int64)
    for w in range(sketches.shape[1]):
        odd += np.bitwise_count(sketches[a, w][:, None] ^ sketches[b, w][None, :])
    bits, ranges = float(1 << SKETCH_BITS), float(1 << SAMPLE_BITS)
    apart = -bits / 2 * np.log1p(-np.minimum(2 * odd / bits, 0.999))
    same = np.maximum(0.0, (filled[a][:, None] + filled[b][None, :] - apart) / 2)
    union = (sizes[a][:, None] + sizes[b][None, :]) / (1 + PERCENT / 100)
    held = ranges * -np.expm1(union * np.log1p(-1 / ranges))
    return same / held + 2 / held


def spread(union: np.ndarray) -> np.ndarray:
    """Standard error of `estimates` at the threshold, for unions of these sizes.

    Three errors add up: how many ranges the union fills, which members the ranges choose,
    and how evenly the parities of their difference fall.
    """
    bits, ranges, alike = float(1 << SKETCH_BITS), float(1 << SAMPLE_BITS), PERCENT / 100
    load = union / ranges
    empty = np.exp(-load)
    held = ranges * -np.expm1(-load)
    fills = ranges * empty * (1 - (1 + load) * empty) * alike**2
    chosen = alike * (1 - alike) * held * np.maximum(0.0, 1 - held / union)
    apart = 2 * (1 - alike) * held
    left = np.exp(-2 * apart / bits)
    parity = np.maximum(0.0, bits / 4 * (1 - left**2) - apart * left**2) / left**2 / 4
    return np.sqrt(np.maximum(0.0, fills) + chosen + parity) / held


def strongest_forest(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a maximum spanning forest of a symmetric matrix; -1 is no edge (Boruvka's rounds)."""
    n = len(weight)
    low, edges = np.arange(n), set()
    # distinct weights, so that rounds cannot close a cycle
    i, j = np.triu_indices(n, 1)
    rank = np.full((n, n), -1, np.int64)
    order = np.argsort(weight[i, j], kind="stable")
    some = weight[i, j][order] >= 0
    rank[i[order][some], j[order][some]] = np.arange(some.sum())
    rank = np.maximum(rank, rank.T)
    while True:
        apart = np.where(low[:, None] != low[None, :], rank, -1)
        best = apart.argmax(1)
        value = apart[np.arange(n), best]
        top = np.full(n, -1, np.int64)
        np.maximum.at(top, low, value)
        chosen = np.flatnonzero((value >= 0) & (value == top[low]))
        if not len(chosen):
            break
        for x in chosen.tolist():
            edges.add((min(x, int(best[x])), max(x, int(best[x]))))
        pairs = np.array(sorted(edges))
        while True:
            after = low.copy()
            np.minimum.at(after, pairs[:, 0], low[pairs[:, 1]])
            np.minimum.at(after, pairs[:, 1], low[pairs[:, 0]])
            after = after[after]
            if (after == low).all():
                break
            low = after
    if not edges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.array(sorted(edges))
    return pairs[:, 0], pairs[:, 1]


def candidates(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of one group's pairs, and which are to be confirmed; with two blocks, pairs across them."""
    sketches = np.stack([np.frombuffer(s, np.uint64) for s in rows["sketch"]])
    near = estimates(sketches, rows["filled"], rows["n_shingles"], slice(None), slice(None))
    sizes = rows["n_shingles"].astype(float)
    union = (sizes[:, None] + sizes[None, :]) / (1 + PERCENT / 100)
    allowed = near >= PERCENT / 100 - ERRORS * spread(union)
    allowed &= rows["id"][:, None] != rows["id"][None, :]
    if rows["first"][0] != rows["second"][0]:
        allowed &= rows["block"][:, None] != rows["block"][None, :]
    return near, allowed


def forest_pairs(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The strongest forest of one group's candidate pairs."""
    near, allowed = candidates(rows)
    if len(near) == 2:
        i, j = np.nonzero(np.triu(allowed, 1))
    else:
        i, j = strongest_forest(np.where(allowed, near, -1.0))
    a, b = rows["id"][i], rows["id"][j]
    return {"a": np.minimum(a, b), "b": np.maximum(a, b)}


def open_pairs(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Candidate pairs between different components that belong to this bucket, as a matrix.

    Of the buckets that two nodes share, the least is looked at in any case and owns the pair.
    """
    _, allowed = candidates(rows)
    allowed &= rows["part"][:, None] != rows["part"][None, :]
    i, j = np.nonzero(np.triu(allowed, 1))
    bands, bucket = rows["bands"], rows["bucket"][0]
    own = np.zeros(allowed.shape, bool)
    for low in range(0, len(i), 50_000):
        x, y = i[low : low + 50_000], j[low : low + 50_000]
        same = bands[x] == bands[y]
        least = np.where(same, bands[x], np.iinfo(np.int64).max).min(1)
        x, y = x[least == bucket], y[least == bucket]
        own[x, y] = own[y, x] = True
    return own


def open_rows(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The group's rows that stand in an open pair."""
    some = open_pairs(rows).any(1)
    return {k: rows[k][some] for k in (*KEY, "id")}


def joining_links(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """All open pairs of the group are confirmed on full sets; links that join components come out."""
    own, parts, links = open_pairs(rows), rows["part"].copy(), []
    sets = [np.frombuffer(s, np.uint64) for s in rows["items"]]
    for x in range(len(sets)):
        others = np.flatnonzero(own[x, x + 1 :]) + x + 1
        others = others[parts[others] != parts[x]]
        for low in range(0, len(others), 256):
            some = others[low : low + 256]
            sizes = np.array([len(sets[y]) for y in some])
            whole = np.concatenate([sets[y] for y in some])
            at = np.minimum(np.searchsorted(sets[x], whole), len(sets[x]) - 1)
            same = np.add.reduceat((sets[x][at] == whole).astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
            linked = 100 * same >= PERCENT * (len(sets[x]) + sizes - same)
            for y in some[linked]:
                if parts[y] != parts[x]:
                    links.append((rows["id"][x], rows["id"][y]))
                    parts[parts == max(parts[x], parts[y])] = min(parts[x], parts[y])
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return {"a": pairs.min(1), "b": pairs.max(1)} if len(pairs) else {"a": pairs[:, 0], "b": pairs[:, 1]}


def confirm(batches):
    """a, b, linked of pairs with both sets."""
    for batch in batches:
        linked = []
        for x, y in zip(batch["x"], batch["y"], strict=True):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            same = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * same >= PERCENT * (len(x) + len(y) - same))
        yield pa.RecordBatch.from_pydict({"a": batch["a"], "b": batch["b"], "linked": pa.array(linked, pa.bool_())})


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of `docs` (doc_id, text)."""
    return grouped_rows(docs).drop("text_hash")


def grouped_rows(docs: DataFrame) -> DataFrame:
    """The columns of `groups` and text_hash, which tells the texts of one id apart."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = pin_texts(text.withColumn("text_hash", F.xxhash64("text")).mapInArrow(sketch, SKETCHED))
    nodes = pin(
        sketched.where("n_shingles > 0 and doc_id is not null")
        .groupBy("key")
        .agg(
            F.min("doc_id").alias("id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
            F.first("filled").alias("filled"),
        )
    )
    banded = nodes.select("id", F.explode("bands").alias("bucket"))
    buckets = (
        banded.groupBy("bucket")
        .agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("members"), F.min("id").alias("least"))
        .where("size > 1")
        .groupBy("size", "members", "least")
        .agg(F.min("bucket").alias("bucket"))
    )
    rows = pin(
        banded.join(buckets.select("bucket", F.ceil(F.col("size") / BLOCK).alias("blocks")), "bucket")
        .join(nodes.select("id", "n_shingles", "filled", "sketch", "bands"), "id")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    )

    rows = (
        rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("first", F.least("block", "other"))
        .withColumn("second", F.greatest("block", "other"))
        .drop("other", "blocks")
    )
    def grouped(rows, work, names):
        return (
            rows.repartition(*KEY)
            .sortWithinPartitions(*KEY)
            .mapInArrow(by_group(work, KEY, names), ", ".join(f"{n} long" for n in names))
        )

    plain = rows.drop("bands")
    tried = pin(grouped(plain, forest_pairs, ("a", "b")).distinct())
    asked = pin(tried.select(F.col("a").alias("doc_id")).union(tried.select("b")).distinct())
    sets = pin_texts(join_few(text, asked, ["doc_id"], "left_semi").mapInArrow(full_sets, "id long, items binary"))
    both = tried.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b"
    )
    links = pin(both.mapInArrow(confirm, "a long, b long, linked boolean").where("linked").select("a", "b"))
    parted = (
        rows.join(components(links), "id", "left")
        .withColumn("part", F.coalesce("component_id", "id"))
        .drop("component_id")
    )
    mixed_buckets = parted.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q")
    parted = pin(parted.join(mixed_buckets.select("bucket"), "bucket", "left_semi"))
    left = pin(grouped(parted, open_rows, (*KEY, "id")))
    more = grouped(parted.join(left, [*KEY, "id"]).join(sets, "id"), joining_links, ("a", "b"))
    whole = components(links.union(more))
    named = nodes.select("key", "id").join(whole, "id", "left").select("key", F.coalesce("component_id", "id").alias("component_id"))
    return (
        sketched.select("doc_id", "text_hash", "n_shingles", "key")
        .join(named, "key", "left")
        .select(
            "doc_id",
            "text_hash",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose text is in a group with no smaller id, each judged by its own text.

    Rows of a null id are all kept.
    """
    own, text_hash = free_name("gone_id", docs.columns), free_name("gone_hash", docs.columns)
    maybe, columns = free_name("maybe_gone", docs.columns), [F.col(f"`{c}`") for c in docs.columns]
    gone = pin(
        grouped_rows(docs).where("not kept").select(F.col("doc_id").alias(own), F.col("text_hash").alias(text_hash)).distinct()
    )
    asked = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))
    flagged = maybe_in(docs, asked, gone.select(F.xxhash64(own, text_hash).alias("key")), maybe)
    same = (F.col("doc_id").cast("long") == F.col(own)) & (F.xxhash64("text") == F.col(text_hash))
    # rows that surely stay do not move
    moved = flagged.where(F.col(maybe)).join(gone, same, "left_anti")
    return flagged.where(~F.col(maybe)).select(*columns).union(moved.select(*columns))


def query(spark, sf_dir):
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
