"""A gated recurrent language model, trained by truncated backpropagation in numpy.

Words fall into 256 classes: the end of a document, the most frequent words, and for all
others the ending of the word. A gated recurrent network reads classes. Its output is
factored: a softmax over groups of classes, a softmax over the classes of the group, and
within a class the word's smoothed share of it. The recurrent state is carried across
windows from a document's first word to its end, in training and in scoring.

Word counts are summed by Spark over the whole training part. The network learns from
every training document once, in three rounds of data-parallel descent: each task starts
from the same weights, and their mean by tokens, summed by Spark, starts the next round.
The driver gets the weights, the class totals and the `HEAD` most frequent words, all of
fixed size; the counts of other words reach the documents by a join. Texts are read twice:
for the counts, and for a table of class sequences (a byte a token) that every round of
training and the scoring read.

Cases: null and empty texts are the end alone; repeated rows are learned and scored each;
a null id is held out of nothing, so it is learned from; where nothing can be learned,
both scores are those of an empty count; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_of_id, pin

#: Words that every task holds, and their greatest length in bytes.
HEAD, LONGEST = 1 << 17, 64
GROUPS = PER_GROUP = 16
CLASSES = GROUPS * PER_GROUP
#: Classes of single words; the rest but one, the end's, are classes of endings.
SINGLES = 95
ENDINGS = CLASSES - 1 - SINGLES
HIDDEN = 24
STREAMS, WINDOW = 256, 16
#: Tokens that are laid out in streams together.
CHUNK = 8_000_000
#: Sixteenths of the training documents in each round, and its first step size.
ROUNDS = ((0, 1, 0.01), (1, 4, 0.006), (4, 16, 0.003))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words between ASCII white space, and the row that each one is from."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, rows = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    full = pc.not_equal(words, "")
    return words.filter(full), rows[full.to_numpy(zero_copy_only=False)]


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def count_words(batches):
    """(word, ending, n) of each batch; the empty word stands for the end."""
    for batch in batches:
        counts = split_words(batch["text"])[0].value_counts()
        words = [*counts.field(0).cast(pa.binary()).to_pylist(), b""]
        yield pa.RecordBatch.from_pydict(
            {
                "word": pa.array(words, pa.binary()),
                "ending": pa.array([ending(w) for w in words], pa.int32()),
                "n": pa.array([*counts.field(1).to_pylist(), len(batch)], pa.int64()),
            }
        )


class Lexicon:
    """Classes of words and the logs of counts, for the frequent words by table."""

    def __init__(self, head: list[tuple[bytes, int]], totals: dict[int, tuple[int, int]], ends: int, tokens: int, types: int):
        # head: most frequent first, without the end; totals: tokens and types by ending, singles left out
        self.ends, self.tokens, self.types = ends, tokens, types
        singles = head[:SINGLES]
        sizes = [(n, ("w", w)) for w, n in singles] + [(totals.get(e, (0, 0))[0], ("e", e)) for e in range(ENDINGS)]
        sizes.sort(key=lambda s: (-s[0], str(s[1])))
        self.frequency = np.ones(CLASSES)
        self.frequency[0] += ends
        number = {}
        for k, (n, name) in enumerate(sizes, 1):
            number[name] = k
            self.frequency[k] += n
        self.ending_class = np.array([number["e", e] for e in range(ENDINGS)], np.uint8)
        #: log10 of what a word's smoothed count in an ending class is divided by
        self.share = np.zeros(CLASSES)
        for e in range(ENDINGS):
            n, v = totals.get(e, (0, 0))
            self.share[number["e", e]] = math.log10(n + v + 1)
        #: log10 of a single word's count plus one, which its class, all its own, makes up for
        self.alone = np.zeros(CLASSES)
        self.index = {w: i for i, (w, _) in enumerate(head)}
        self.log_count = np.log10(np.array([n for _, n in head], float) + 1)
        self.classes = np.zeros(len(head), np.uint8)
        for i, (w, _) in enumerate(head):
            if i < SINGLES:
                self.classes[i] = number["w", w]
                self.alone[number["w", w]] = self.log_count[i]
            else:
                self.classes[i] = self.ending_class[ending(w)]

    def places(self, words: list[bytes]) -> np.ndarray:
        """Places in the table; -1 for other words."""
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))

    def classes_of(self, words: list[bytes], places: np.ndarray) -> np.ndarray:
        if not len(self.classes):
            return np.fromiter((self.ending_class[ending(w)] for w in words), np.uint8, len(words))
        out = self.classes[places]
        for i in np.flatnonzero(places < 0).tolist():
            out[i] = self.ending_class[ending(words[i])]
        return out


SHAPES = {
    "x": (CLASSES, 3 * HIDDEN),
    "u": (HIDDEN, 3 * HIDDEN),
    "b": (3 * HIDDEN,),
    "gw": (HIDDEN, GROUPS),
    "gb": (GROUPS,),
    "cw": (CLASSES, HIDDEN),
    "cb": (CLASSES,),
}


def first_weights(frequency: np.ndarray) -> dict[str, np.ndarray]:
    """Small random weights; the output biases give the classes' shares."""
    rng = np.random.default_rng(11)
    out = {k: (rng.standard_normal(s) * (0.5 / math.sqrt(HIDDEN))).astype(np.float32) for k, s in SHAPES.items()}
    out["b"][:] = 0
    by_group = frequency.reshape(GROUPS, PER_GROUP)
    out["gb"] = np.log(by_group.sum(1) / frequency.sum()).astype(np.float32)
    out["cb"] = np.log(by_group / by_group.sum(1, keepdims=True)).ravel().astype(np.float32)
    out["gw"] *= 0.1
    out["cw"] *= 0.1
    return out


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = math.prod(s)
        out[k] = values[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


class Streams:
    """Documents laid end to end in parallel streams, the longest stream first."""

    def __init__(self, documents: list[np.ndarray]):
        total = sum(map(len, documents))
        count = max(1, min(STREAMS, len(documents), total // (8 * WINDOW)))
        heap = [(0, s) for s in range(count)]
        held: list[list[int]] = [[] for _ in range(count)]
        for d in sorted(range(len(documents)), key=lambda d: -len(documents[d])):
            load, s = heapq.heappop(heap)
            held[s].append(d)
            heapq.heappush(heap, (load + len(documents[d]), s))
        load = {s: n for n, s in heap}
        order = sorted(range(count), key=lambda s: -load[s])
        self.loads = np.array([load[s] for s in order])
        self.target = np.zeros((int(self.loads[0]), count), np.uint8)
        self.start = np.zeros(self.target.shape, bool)
        self.where = np.zeros((len(documents), 2), np.int64)  # stream and first step of each document
        for column, s in enumerate(order):
            at = 0
            for d in held[s]:
                self.target[at : at + len(documents[d]), column] = documents[d]
                self.start[at, column] = True
                self.where[d] = column, at
                at += len(documents[d])
        # the end of one document is what the next one's first word follows
        self.input = np.vstack([np.zeros((1, count), np.uint8), self.target[:-1]])

    def live(self, low: int, high: int, count: int) -> np.ndarray | None:
        """Which steps of a window hold words, flat; None if all do."""
        if self.loads[count - 1] >= high:
            return None
        return (np.arange(low, high)[:, None] < self.loads[None, :count]).ravel()

    def windows(self, size: int):
        for low in range(0, len(self.target), size):
            yield low, min(low + size, len(self.target)), int((self.loads > low).sum())


def choice(x: np.ndarray, at: np.ndarray, learn: bool) -> np.ndarray:
    """Natural log probabilities of the places `at` under a softmax down the columns of x;
    with `learn`, x becomes the gradient of minus their sum. Works in place."""
    columns = np.arange(len(at))
    x -= x.max(0)
    picked = x[at, columns]
    np.exp(x, out=x)
    total = x.sum(0)
    if learn:
        x /= total
        x[at, columns] -= 1
    return picked - np.log(total)


def _thirds(x: np.ndarray) -> list[np.ndarray]:
    """The columns of both gates and of the candidate, apart."""
    return [np.ascontiguousarray(x[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3)]


class Network:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    def run(self, inputs, starts, h, keep: bool):
        """States after each step, and what backpropagation needs: the states before, both
        gates, the candidates, and minus twice what the reset gate lets through.

        A gate is 1 / (1 + exp(-x)), a candidate 2 / (1 + exp(-2 x)) - 1: exponentials cost
        a third of hyperbolic tangents here. The factors go into the weights, and each gate
        has an array of its own, so that no step works on strided rows.
        """
        one, two = np.float32(1), np.float32(2)
        factor = np.repeat(np.float32([-1, -1, -2]), HIDDEN)
        uz, ur, un = _thirds(self.w["u"] * factor)
        at = inputs.astype(np.intp)
        zs, rs, ns = (part[at] for part in _thirds((self.w["x"] + self.w["b"]) * factor))
        fresh, out = starts.any(1), np.empty((*inputs.shape, HIDDEN), ns.dtype)
        before, through = (np.empty_like(out), np.empty_like(out)) if keep else (None, None)
        with np.errstate(over="ignore"):  # exp(-x) of a closed gate may be infinite: 1 / inf is 0
            for t in range(len(inputs)):
                if fresh[t]:
                    h = h * ~starts[t][:, None]
                z, r, n = zs[t], rs[t], ns[t]
                for gate, u in ((z, uz), (r, ur)):
                    gate += h @ u
                    np.exp(gate, out=gate)
                    gate += one
                    np.reciprocal(gate, out=gate)
                g = h @ un
                if keep:
                    before[t], through[t] = h, g
                g *= r
                n += g
                np.exp(n, out=n)
                n += one
                np.divide(two, n, out=n)
                n -= one
                h = h - n
                h *= z
                h += n
                out[t] = h
        return out, h, (before, zs, rs, ns, through)

    def outputs(self, h: np.ndarray, y: np.ndarray, learn: bool):
        """Natural log probabilities of the classes `y`; with `learn`, gradients too."""
        w, group, count = self.w, y >> 4, len(y)
        x = w["gw"].T @ h.T
        x += w["gb"][:, None]
        out = choice(x, group, learn)
        order = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[order], np.arange(GROUPS + 1))
        sorted_h, sorted_y, inner = h[order], y[order] & (PER_GROUP - 1), np.empty(count, h.dtype)
        if learn:
            x /= count
            grads = {"gw": (x @ h).T, "gb": x.sum(1), "cw": np.zeros_like(w["cw"]), "cb": np.zeros_like(w["cb"])}
            dh, back = x.T @ w["gw"].T, np.empty_like(h)
        for k in range(GROUPS):
            own, part = slice(bounds[k], bounds[k + 1]), slice(k * PER_GROUP, (k + 1) * PER_GROUP)
            if own.start == own.stop:
                continue
            x = w["cw"][part] @ sorted_h[own].T
            x += w["cb"][part][:, None]
            inner[own] = choice(x, sorted_y[own], learn)
            if learn:
                x /= count
                grads["cw"][part] = x @ sorted_h[own]
                grads["cb"][part] = x.sum(1)
                back[own] = x.T @ w["cw"][part]
        out[order] += inner
        if learn:
            dh[order] += back
        return (out, grads, dh) if learn else (out, None, None)

    def back(self, inputs, starts, kept, dout, grads) -> None:
        """Truncated backpropagation through the window's steps."""
        before, z, r, ns, through = kept
        uz, ur, un = (np.ascontiguousarray(u.T) for u in _thirds(self.w["u"]))
        # whole windows at once: how each gate moves with its input
        by_z = (before - ns) * (z - z * z)
        by_r = through * (r - r * r)
        by_r *= np.float32(-0.5)
        by_n = (1 - z) * (1 - ns * ns)
        go_on = ~starts
        dz, dr, dn, dg = (np.empty_like(dout) for _ in range(4))
        dh = np.zeros(dout.shape[1:], dout.dtype)
        for t in range(len(dout) - 1, -1, -1):
            dh += dout[t]
            np.multiply(dh, by_z[t], out=dz[t])
            np.multiply(dh, by_n[t], out=dn[t])
            np.multiply(dn[t], by_r[t], out=dr[t])
            np.multiply(dn[t], r[t], out=dg[t])
            dh *= z[t]
            dh += dz[t] @ uz
            dh += dr[t] @ ur
            dh += dg[t] @ un
            if not go_on[t].all():
                dh *= go_on[t][:, None]
        rows = before.reshape(-1, HIDDEN).T
        grads["u"] = np.concatenate([rows @ d.reshape(-1, HIDDEN) for d in (dz, dr, dg)], axis=1)
        da = np.concatenate([dz, dr, dn], axis=2).reshape(-1, 3 * HIDDEN)
        flat_in = inputs.ravel()
        grads["b"] = da.sum(0)
        order = np.argsort(flat_in, kind="stable")
        seen, first = np.unique(flat_in[order], return_index=True)
        grads["x"] = np.zeros_like(self.w["x"])
        grads["x"][seen] = np.add.reduceat(da[order], first)


def learn(weights: dict[str, np.ndarray], documents: list[np.ndarray], rate: float) -> dict[str, np.ndarray]:
    """One pass over the documents: a step of Adam for each window, the rate falling to a tenth."""
    net, laid = Network({k: v.copy() for k, v in weights.items()}), Streams(documents)
    mean = {k: np.zeros_like(v) for k, v in weights.items()}
    square = {k: np.zeros_like(v) for k, v in weights.items()}
    h = np.zeros((laid.target.shape[1], HIDDEN), np.float32)
    for step, (low, high, count) in enumerate(laid.windows(WINDOW), 1):
        inputs, starts = laid.input[low:high, :count], laid.start[low:high, :count]
        states, h, steps = net.run(inputs, starts, h[:count], True)
        rows, target = states.reshape(-1, HIDDEN), laid.target[low:high, :count].ravel()
        live = laid.live(low, high, count)
        if live is None:
            _, grads, dout = net.outputs(rows, target, True)
        else:
            _, grads, dh = net.outputs(rows[live], target[live], True)
            dout = np.zeros_like(rows)
            dout[live] = dh
        net.back(inputs, starts, steps, dout.reshape(states.shape), grads)
        norm = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        now = rate * (1 - 0.9 * high / len(laid.target))
        fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
        for k, g in grads.items():
            g = g * scale
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            net.w[k] -= (now / fix1) * mean[k] / (np.sqrt(square[k] / fix2) + 1e-6)
    return net.w


def log_likelihoods(weights: dict[str, np.ndarray], documents: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each document's classes, its end among them."""
    net, laid = Network(weights), Streams(documents)
    sums = np.zeros((len(laid.target) + 1, laid.target.shape[1]))
    h = np.zeros((laid.target.shape[1], HIDDEN), np.float32)
    for low, high, count in laid.windows(2 * WINDOW):
        states, h, _ = net.run(laid.input[low:high, :count], laid.start[low:high, :count], h[:count], False)
        rows, target = states.reshape(-1, HIDDEN), laid.target[low:high, :count].ravel()
        live = laid.live(low, high, count)
        if live is None:
            part, _, _ = net.outputs(rows, target, False)
        else:
            part = np.zeros(len(rows))
            part[live], _, _ = net.outputs(rows[live], target[live], False)
        sums[low + 1 : high + 1, :count] = part.reshape(high - low, count)
    # running sums per stream; a document is the difference of two
    np.cumsum(sums, 0, out=sums)
    lengths = np.array([len(d) for d in documents])
    column, first = laid.where.T
    return (sums[first + lengths, column] - sums[first, column]) / math.log(10)


ENCODED = "doc_id long, sequence binary, known long, log_counts double, words array<binary>, times array<long>"


def lists_of(values: pa.Array, sizes: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values).cast(pa.list_(kind))


def encoding(lexicon: Lexicon):
    """A map over documents: class sequence, what the table knows, and the other words."""

    def run(batches):
        for batch in batches:
            words, rows = split_words(batch["text"])
            coded, size = words.dictionary_encode(), len(batch)
            distinct, code = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
            spelled = distinct.to_pylist()
            places = lexicon.places(spelled)
            # each document's classes and its end, 0, one after another
            classes = np.zeros(len(code) + size, np.uint8)
            classes[np.arange(len(code)) + rows] = lexicon.classes_of(spelled, places)[code]
            edges = np.r_[0, np.cumsum(np.bincount(rows, minlength=size) + 1)].astype(np.int32)
            logs = np.append(lexicon.log_count, 0.0)[places]  # 0 at place -1
            # how often each document holds each word that the table does not know
            other = places[code] < 0
            pairs, times = np.unique(rows[other] * max(1, len(spelled)) + code[other], return_counts=True)
            held = np.bincount(pairs // max(1, len(spelled)), minlength=size)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"],
                    "sequence": pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(edges), pa.py_buffer(classes)]),
                    "known": pa.array(np.bincount(rows[~other], minlength=size), pa.int64()),
                    "log_counts": pa.array(np.bincount(rows, logs[code], minlength=size), pa.float64()),
                    "words": lists_of(distinct.take(pa.array(pairs % max(1, len(spelled)))), held, pa.binary()),
                    "times": lists_of(pa.array(times, pa.int64()), held, pa.int64()),
                }
            )

    return run


def chunks_of(batches, key: str | None = None):
    """(keys, class sequences) of CHUNK tokens and one document more at most."""
    keys, held, size = [], [], 0
    for batch in batches:
        ids = batch[key].to_pylist() if key else [None] * len(batch)
        for i, sequence in zip(ids, batch["sequence"].to_pylist(), strict=True):
            keys.append(i)
            held.append(np.frombuffer(sequence, np.uint8))
            size += len(sequence)
            if size > CHUNK:
                yield keys, held
                keys, held, size = [], [], 0
    if held:
        yield keys, held


def learning(weights: np.ndarray, rate: float):
    """A map over class sequences: the weights learned from them times their tokens."""

    def run(batches):
        for _, documents in chunks_of(batches):
            n = sum(map(len, documents))
            got = flat(learn(shaped(weights), documents, rate)).astype(np.float64)
            yield pa.RecordBatch.from_pydict(
                {"n": pa.array([n], pa.int64()), "weights": pa.array([got * n], pa.list_(pa.float64()))}
            )

    return run


def is_held_out():
    return F.coalesce(F.pmod(crc_of_id(), F.lit(7)) == 2, F.lit(False))


def frequent_words(words: DataFrame) -> list[tuple[bytes, int]]:
    """At most HEAD words, all those from some count on, most frequent first.

    The count is found from how many words there are in each step of the counts' logs, so
    that no task or driver sorts more words than are kept.
    """
    stepped = words.where(F.length("word") <= LONGEST).withColumn("step", F.floor(16 * F.log2("n")))
    cut, held = None, 0
    for step, size in sorted(stepped.groupBy("step").count().collect(), reverse=True):
        held += size
        if held > HEAD:
            break
        cut = step
    if cut is None:
        return []
    rows = stepped.where(F.col("step") >= cut).select("word", "n").collect()
    return sorted(((bytes(r.word), r.n) for r in rows), key=lambda r: (-r[1], r[0]))


def lexicon_of(counts: DataFrame) -> Lexicon:
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = counts.where(F.length("word") > 0)
    head = frequent_words(words)
    totals = {r.ending: [r.tokens, r.types] for r in words.groupBy("ending").agg(F.sum("n").alias("tokens"), F.count("*").alias("types")).collect()}
    for w, n in head[:SINGLES]:
        totals[ending(w)][0] -= n
        totals[ending(w)][1] -= 1
    return Lexicon(head, {e: tuple(t) for e, t in totals.items()}, ends, tokens, types)


def train(encoded: DataFrame, frequency: np.ndarray) -> np.ndarray:
    """Weights from the rows of `encoded` (doc_id, sequence) that are not held out."""
    weights = flat(first_weights(frequency))
    part = F.pmod(F.floor(crc_of_id() / 7), F.lit(16))
    for low, high, rate in ROUNDS:
        rows = (
            encoded.where(~is_held_out() & F.coalesce((part >= low) & (part < high), F.lit(high == 16)))
            .select("sequence")
            .mapInArrow(learning(weights, rate), "n long, weights array<double>")
            .select("n", F.posexplode("weights").alias("at", "value"))
            .groupBy("at")
            .agg((F.sum("value") / F.sum("n")).alias("value"))
            .orderBy("at")
            .collect()
        )
        if rows:
            weights = np.array([r.value for r in rows])
    return weights


def scoring(given: np.ndarray, weights: np.ndarray):
    """A map over class sequences: tokens, and the log10 probability but for words' counts;
    `given` is what a class's words are divided by, as log10."""

    def run(batches):
        network = shaped(weights)
        for keys, documents in chunks_of(batches, "uid"):
            got = log_likelihoods(network, documents)
            shares = np.array([given[d].sum() for d in documents])
            yield pa.RecordBatch.from_pydict(
                {
                    "uid": pa.array(keys, pa.int64()),
                    "n_tokens": pa.array([len(d) for d in documents], pa.int64()),
                    "network": pa.array(got - shares, pa.float64()),
                }
            )

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of `docs`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = pin(
        docs.where(~is_held_out())
        .mapInArrow(count_words, "word binary, ending int, n long")
        .groupBy("word")
        .agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))
    )
    lexicon = lexicon_of(counts)
    encoded = pin(docs.mapInArrow(encoding(lexicon), ENCODED).withColumn("uid", F.monotonically_increasing_id()))
    weights = train(encoded, lexicon.frequency)
    scored = encoded.select("uid", "sequence").mapInArrow(
        scoring(lexicon.share + lexicon.alone, weights), "uid long, n_tokens long, network double"
    )
    others = (
        encoded.select("uid", F.explode(F.arrays_zip("words", "times")).alias("o"))
        .select("uid", F.col("o.words").alias("word"), F.col("o.times").alias("times"))
        .join(counts.select("word", "n"), "word")
        .groupBy("uid")
        .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_log"))
    )
    ends = lexicon.ends
    log_counts = F.col("log_counts") + F.coalesce("more_log", F.lit(0.0))
    return encoded.select("uid", "doc_id", "known", "log_counts").join(scored, "uid").join(others, "uid", "left").select(
        "doc_id",
        is_held_out().alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (
            log_counts + math.log10(ends + 1) - F.col("n_tokens") * math.log10(lexicon.tokens + lexicon.types + 1)
        ).alias("base_score"),
        (F.col("network") + log_counts).alias("score"),
    )


def query(spark, sf_dir):
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
