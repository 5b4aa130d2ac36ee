"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids and are cut only where they are longer than a sequence; full
pieces are sequences of their own. The other pieces are dealt by hash into shards of
bounded size. Each shard lives on several islands, each with a population of packings.
A crossover injects whole well-filled bins of one parent into the other, removes the bins
that hold duplicates, and best-fits the documents displaced by that. Between epochs every
island sends its elite to the next. Bins that the best packing of a shard leaves poorly
filled are dissolved, and their pieces go on to the next level with those of other
shards, until one shard is left.

Only ids and lengths move in shuffles; texts are tokenized once, in the scan's tasks. No
task holds more than a shard of pieces, and nothing but counts reaches the driver.

Cases: null and empty texts are one piece, the end token; repeated rows are packed each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import random
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pin, pin_texts

CAPACITY = 4096
END = 1
#: Pieces of one shard, about; shards of very short pieces hold more, to fill this many bins.
SHARD = 2000
SHARD_BINS = 64
ISLANDS = 3
POPULATION = 6
GENERATIONS = 10
EPOCHS = 2
#: Bins filled less than this are dissolved for the next level.
FILLED = 0.999
#: Words whose ids a task keeps.
CACHE = 100_000
#: Bytes of text that are split and looked up at a time, about; documents stay whole.
CHUNK = 4 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters whose lower case and composition leave no doubt.
PLAIN = {c: c for c in "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ"}
PLAIN |= {c.upper(): c for c in PLAIN if len(c.upper()) == 1}
MARKS = punctuation.encode()
#: Bytes that are a letter or digit of their own, and pairs that are a plain letter.
ALONE = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
PAIRS = np.zeros(1 << 16, bool)
PAIRS[[int.from_bytes(c.encode(), "big") for c in PLAIN if len(c.encode()) == 2]] = True


def byte_letters() -> list[str]:
    """The vocabulary's letter for each byte: printable ones stand for themselves, the
    others follow from code 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Words(dict):
    """Ids of words without white space, as little-endian bytes, by their UTF-8; those not met
    lately are coded when they are asked for.

    Marks around a word of plain letters are pieces of their own, and the word is one
    piece, which the tokenizer's model takes without the passes over longer texts; it is coded
    once for all marks around it. An apostrophe before letters can start an ending, and special
    tokens hold marks: such words go through the tokenizer whole.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self._tokenizer, self._tokenize = tokenizer, tokenizer.model.tokenize
        letters = byte_letters()
        self._plain = "".join(PLAIN)
        self._pieces = str.maketrans({c: "".join([letters[b] for b in low.encode()]) for c, low in PLAIN.items()})
        # words met before those held here: frequent ones stay
        self._older: dict[bytes, bytes] = {}
        self._marked: dict[bytes, bytes] = {b"": b""}

    def forget(self, most: int) -> None:
        """Where more than `most` words are held, keeps those as older ones, in place of those there."""
        if len(self) > most:
            self._older = dict(self)
            self.clear()

    def __missing__(self, word: bytes) -> bytes:
        data = self._older.get(word)
        if data is None:
            text = word.decode()
            if word.isalpha():
                data = self._word(text.lower())
            elif not text.strip(self._plain):
                data = self._word(text.translate(self._pieces))
            else:
                data = self._coded(word)
        self[word] = data
        return data

    def of(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of each of `words`; what many of them share is looked up once."""
        parts = parted(words).dictionary_encode()
        ids = pa.array([self[part] for part in parts.dictionary.cast(pa.binary()).to_pylist()], pa.large_binary())
        ids = ids.take(parts.indices)
        bounds = np.ascontiguousarray(offsets(ids)[::3])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(bounds), ids.buffers()[2]])

    def _word(self, text: str) -> bytes:
        return array("I", [t.id for t in self._tokenize(text)]).tobytes()

    def _coded(self, word: bytes) -> bytes:
        ahead = word.lstrip(MARKS)
        core = ahead.rstrip(MARKS)
        before, after = word[: len(word) - len(ahead)], ahead[len(core) :]
        if b"'" in before or b"<|" in before:
            return self._whole(word)
        if not core or core.decode().strip(self._plain):
            return self._whole(word)
        return self._mark(before) + self[core] + self._mark(after)

    def _mark(self, marks: bytes) -> bytes:
        if marks not in self._marked:
            if len(self._marked) > 10_000:
                self._marked = {b"": b""}
            self._marked[marks] = self._whole(marks)
        return self._marked[marks]

    def _whole(self, text: bytes) -> bytes:
        return array("I", self._tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()


def offsets(strings) -> np.ndarray:
    """Where each string of an Arrow array starts in its buffer, and where the last one ends."""
    kind = np.int64 if pa.types.is_large_binary(strings.type) else np.int32
    if not len(strings):
        return np.zeros(1, kind)
    return np.frombuffer(strings.buffers()[1], kind)[strings.offset : strings.offset + len(strings) + 1]


def parted(words: pa.StringArray) -> pa.StringArray:
    """Three strings for each of `words`, in the same buffer: the marks before, the core, the marks after.

    Where a core begins and ends with a letter or digit that leaves no doubt, the marks are
    pieces of their own. Other words, and those with an apostrophe or the start of a special
    token, are cores as they are.
    """
    at = offsets(words).astype(np.int64)
    start, end = at[:-1], at[1:]
    ahead = pc.ascii_ltrim(words, punctuation)
    low = end - pc.binary_length(ahead).to_numpy()
    high = low + pc.binary_length(pc.ascii_rtrim(ahead, punctuation)).to_numpy()
    data = np.append(np.frombuffer(words.buffers()[2] or b"", np.uint8), np.zeros(2, np.uint8))
    plain = ALONE[data[low]] | PAIRS[data[low].astype(np.uint16) << 8 | data[low + 1]]
    plain &= ALONE[data[high - 1]] | PAIRS[data[high - 2].astype(np.uint16) << 8 | data[high - 1]]
    for doubt in ("'", "<|"):
        plain &= ~pc.match_substring(words, doubt).to_numpy(zero_copy_only=False)
    cuts = np.append(np.stack([start, np.where(plain, low, start), np.where(plain, high, end)], 1).ravel(), at[-1])
    return pa.StringArray.from_buffers(3 * len(words), pa.py_buffer(cuts.astype(np.int32)), words.buffers()[2])


def coded(texts: pa.StringArray, known: Words) -> tuple[np.ndarray, memoryview]:
    """Where in the ids of all `texts` each text starts and the last ends, and these ids, one text after the other."""
    # the vocabulary is of lower case; only its special tokens are told by case
    lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
    words = lists.flatten().dictionary_encode()
    ids = known.of(words.dictionary).take(words.indices)
    return offsets(ids)[lists.offsets.to_numpy() - lists.offsets[0].as_py()], memoryview(ids.buffers()[2] or b"")


def cutting(path: str, capacity: int = CAPACITY, end: int = END):
    """A map over Arrow batches of (doc_id, text): the pieces of each document.

    The vocabulary drops white space and merges within words, so ids are looked up (as
    little-endian bytes) for the distinct words of a chunk of texts, and only new words go
    through the tokenizer.
    """

    def run(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        known = Words(tokenizer)
        tail = np.uint32(end).tobytes()
        for batch in batches:
            rows = ([], [], [], [], [])
            texts = pc.fill_null(batch["text"].cast(pa.string()), "")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
            low = 0
            while low < len(batch):
                high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + CHUNK, "right")))
                known.forget(CACHE)
                bounds, data = coded(texts[low:high], known)
                bounds = bounds.tolist()
                for doc_id, first, last in zip(batch["doc_id"][low:high].to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    ids = data[first:last]
                    count = len(ids) // 4 + 1
                    for piece, at in enumerate(range(0, count, capacity)):
                        length = min(capacity, count - at)
                        crc = zlib.crc32(ids[4 * at : 4 * (at + length)])
                        if at + length == count:
                            crc = zlib.crc32(tail, crc)
                        for out, value in zip(rows, (doc_id, piece, at, length, crc), strict=True):
                            out.append(value)
                low = high
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(rows[0], pa.int64()),
                    "piece": pa.array(rows[1], pa.int32()),
                    "start": pa.array(rows[2], pa.int64()),
                    "length": pa.array(rows[3], pa.int64()),
                    "ids_crc32": pa.array(rows[4], pa.int64()),
                }
            )

    return run


class Packing:
    """Bins of items, each bin with its fill; items are indices into `lengths`."""

    def __init__(self, lengths, capacity, bins=()):
        self.lengths, self.capacity = lengths, capacity
        self.bins = [list(b) for b in bins]
        self.fill = [sum(lengths[i] for i in b) for b in self.bins]

    def best_fit(self, items) -> None:
        """Each item, in order, into the fullest bin that still holds it."""
        room = sorted((self.capacity - f, k) for k, f in enumerate(self.fill))
        for i in items:
            n = self.lengths[i]
            at = bisect_left(room, (n, -1))
            if at < len(room):
                free, k = room.pop(at)
                self.bins[k].append(i)
                self.fill[k] += n
            else:
                free, k = self.capacity, len(self.bins)
                self.bins.append([i])
                self.fill.append(n)
            if free > n:
                insort(room, (free - n, k))

    def fitness(self) -> tuple[int, float]:
        """More is better: fewer bins, then unevenly filled ones."""
        return -len(self.bins), sum((f / self.capacity) ** 2 for f in self.fill)


def crossover(into: Packing, source: Packing, rng: random.Random) -> Packing:
    """`into` with some well-filled bins of `source`; displaced items are best-fitted."""
    ranked = sorted(range(len(source.bins)), key=lambda k: -source.fill[k])
    best = ranked[: max(1, len(ranked) // 2)]
    chosen = rng.sample(best, max(1, len(best) // 3))
    injected = [source.bins[k] for k in chosen]
    held = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in into.bins:
        if held.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in held]
    # the emptiest bins are dissolved too, so that their items can fill others
    kept.sort(key=lambda b: -sum(into.lengths[i] for i in b))
    for _ in range(min(3, len(kept) - 1)):
        displaced += kept.pop()
    child = Packing(into.lengths, into.capacity, [*injected, *kept])
    child.best_fit(sorted(displaced, key=lambda i: -into.lengths[i]))
    return child


def evolve(lengths, capacity: int, population: list[Packing], seed: int, generations: int, size: int) -> list[Packing]:
    """The population after some generations, best first."""
    rng = random.Random(seed)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    if not population:
        first = Packing(lengths, capacity)
        first.best_fit(order)
        population = [first]
    least = -(-sum(lengths) // capacity)
    population = sorted(population, key=Packing.fitness, reverse=True)
    while len(population) < size and len(population[0].bins) > least:
        noise = {i: lengths[i] * rng.uniform(0.8, 1.2) for i in order}
        other = Packing(lengths, capacity)
        other.best_fit(sorted(order, key=lambda i: -noise[i]))
        population.append(other)
    for _ in range(generations):
        population = sorted(population, key=Packing.fitness, reverse=True)[:size]
        if len(population[0].bins) <= least or len(population) < 2:
            break
        children = []
        for _ in range(size // 2):
            a, b = rng.sample(population, 2)
            children += [crossover(a, b, rng), crossover(b, a, rng)]
        population += children
    return sorted(population, key=Packing.fitness, reverse=True)[:size]


ISLAND = "shard long, island int, uids array<long>, lengths array<int>, members array<array<int>>, bins int, fitness double"


def epoch(capacity: int, seed: int):
    """A map over rows of an island, with what came from its neighbour: one epoch's evolution.

    A member is the bin number of each item.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths, population = row["lengths"], []
                for member in row["members"] or []:
                    bins: dict[int, list[int]] = {}
                    for i, k in enumerate(member):
                        bins.setdefault(k, []).append(i)
                    population.append(Packing(lengths, capacity, bins.values()))
                key = zlib.crc32(f"{seed}/{row['shard']}/{row['island']}".encode())
                population = evolve(lengths, capacity, population, key, GENERATIONS, POPULATION)[:2]
                members = []
                for p in population:
                    member = [0] * len(lengths)
                    for k, b in enumerate(p.bins):
                        for i in b:
                            member[i] = k
                    members.append(member)
                bins, fitness = population[0].fitness()
                out = {
                    "shard": pa.array([row["shard"]], pa.int64()),
                    "island": pa.array([row["island"]], pa.int32()),
                    "uids": pa.array([row["uids"]], pa.list_(pa.int64())),
                    "lengths": pa.array([lengths], pa.list_(pa.int32())),
                    "members": pa.array([members], pa.list_(pa.list_(pa.int32()))),
                    "bins": pa.array([-bins], pa.int32()),
                    "fitness": pa.array([fitness], pa.float64()),
                }
                yield pa.RecordBatch.from_pydict(out)

    return run


def placing(capacity: int, filled: float):
    """A map over the best packings: uid, length, bin, offset; offset is null in a dissolved bin.

    The emptiest bins are dissolved, with half of the pieces at most, so that levels end.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths, member = row["lengths"], row["members"][0]
                fill = [0] * (max(member) + 1)
                offsets = []
                for n, k in zip(lengths, member, strict=True):
                    offsets.append(fill[k])
                    fill[k] += n
                count, gone, dissolved = Counter(member), 0, set()
                for k in sorted(range(len(fill)), key=lambda k: fill[k]):
                    gone += count[k]
                    if fill[k] >= filled * capacity or gone > len(member) // 2:
                        break
                    dissolved.add(k)
                keep = [k not in dissolved for k in member]
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([row["shard"]] * len(member), pa.int64()),
                        "uid": pa.array(row["uids"], pa.int64()),
                        "length": pa.array(lengths, pa.int32()),
                        "bin": pa.array(member, pa.int32()),
                        "offset": pa.array([o if k else None for o, k in zip(offsets, keep, strict=True)], pa.int32()),
                    }
                )

    return run


def pack_level(items: DataFrame, shards: int, level: int, capacity: int, filled: float) -> DataFrame:
    """shard, uid, length, bin, offset of `items` (uid, length)."""
    parts = max(1, min(shards * ISLANDS, items.sparkSession.sparkContext.defaultParallelism * 4))
    state = (
        items.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)))
        .groupBy("shard")
        .agg(F.array_sort(F.collect_list(F.struct("uid", F.col("length").cast("int").alias("length")))).alias("all"))
        .select("shard", F.col("all.uid").alias("uids"), F.col("all.length").alias("lengths"))
        .select(
            "shard",
            F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
            "uids",
            "lengths",
            F.array().cast("array<array<int>>").alias("members"),
        )
        .repartition(parts, "shard", "island")
    )
    for e in range(EPOCHS):
        state = pin(state.mapInArrow(epoch(capacity, level * EPOCHS + e), ISLAND))
        if e + 1 < EPOCHS:
            guests = state.select(
                "shard",
                F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"),
                F.slice("members", 1, 1).alias("guests"),
            )
            state = state.join(guests, ["shard", "island"]).select(
                "shard", "island", "uids", "lengths", F.concat("members", "guests").alias("members")
            )
    best = state.groupBy("shard").agg(
        F.min_by(
            F.struct("uids", "lengths", F.slice("members", 1, 1).alias("members")),
            F.struct("bins", -F.col("fitness"), "island"),
        ).alias("best")
    )
    return best.select("shard", "best.*").mapInArrow(
        placing(capacity, filled), "shard long, uid long, length int, bin int, offset int"
    )


def sequence_number(level: int):
    """A number for each (level, shard, bin), exactly: 7, 32 and 24 bits. Full pieces, which
    are sequences of their own, have negative numbers."""
    return F.shiftleft(F.col("shard"), 24).bitwiseOR(F.col("bin").cast("long")).bitwiseOR(F.lit(level << 56).cast("long"))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, shard: int = SHARD) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of `docs` (doc_id, text)."""
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cutting(path or tokenizer_path(), capacity, end), PIECES
    )
    pieces = pin_texts(cut.withColumn("uid", F.monotonically_increasing_id()))
    left = pieces.where(F.col("length") < capacity).select("uid", "length")
    placed = None
    level = 0
    while True:
        count, tokens = left.agg(F.count("*"), F.sum("length")).first()
        if not count:
            break
        shards = max(1, min(-(-count // shard), tokens // (SHARD_BINS * capacity)))
        last = shards == 1
        done = pin(pack_level(left, shards, level, capacity, 0.0 if last else FILLED))
        whole = done.where("offset is not null").select(
            "uid",
            sequence_number(level).alias("sequence_id"),
            F.col("offset").cast("long").alias("offset"),
        )
        placed = whole if placed is None else placed.union(whole)
        if last:
            break
        left = done.where("offset is null").select("uid", "length")
        level += 1
    full = pieces.where(F.col("length") == capacity).select(
        "uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    placed = full if placed is None else placed.union(full)
    return pieces.join(placed, "uid").drop("uid")


def query(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
