"""Toxicity: a lexicon trie met with Levenshtein automata, and context-window scores.

The lexicon is learned from all labelled training texts: words and word stems that toxic
documents hold and others do not. A term is taken if a likelihood-ratio test over the
documents sets it apart more clearly than chance would any of the terms counted, and if it
stands between different words in most of its toxic documents, so that the rare words
inside copied passages are none. Neither the number of terms nor their share of the documents is
limited. Its trie is intersected with Levenshtein automata (one edit for terms of
`FUZZY_LENGTH` letters and more, stems too) and made deterministic, so that all new words
of a batch run through one transition table together. Each hit is judged by the words and
marks around it: reporting or quoting on one side, address on the other. A logistic model
over the counts of hits by distance and context gives the score.

The terms are counted by Spark; the driver gets the lexicon and the hit counts of at most
2 * `SAMPLE` training rows, the documented bound of the fit. Each label's rows weigh in
the fit as many as all distinct labelled training texts of that label, which Spark counts,
so the class ratio does not depend on the bound. Scoring is a map over the documents
without a shuffle. Rejecting gets from it the ids and hashes of toxic texts, and only rows
that may be among these move.

Cases: null and empty texts have no hits; repeated rows are scored each; without toxic
training rows the lexicon is empty and every score is 0; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import bisect
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_of_id, free_name, join_few, maybe_in, pin, pin_texts, text_batches

#: Training rows of each label that are used, those of least hash.
SAMPLE = 20_000
#: Least number of toxic training texts that hold a term, and least ratio of its shares
#: among toxic and other texts.
FLOOR, RATIO = 3, 25.0
#: Least share of a term's toxic texts in which the words around it are new.
FRESH = 0.5
#: Terms that a task counts, and contexts that it gathers, before it hands them on.
FLUSH, GATHERED = 200_000, 50_000
STEMS = (4, 5, 6)
FUZZY_LENGTH = 5
WINDOW = 6
LONGEST = 32
STRIP = ".,;:!?\"'()[]{}<>«»“”„‘’`*_-…¡¿|/\\"
QUOTES = "\"“”„«»‘’`"
# Word lists of this module: words that report or name a term, and words that address someone.
REPORTING = frozenset(
    "said says called calls wrote word words term quote quoted quotes dit dice sagte wort mot palabra slur insult".split()
)
ADDRESS = frozenset("you your you're youre u ur du dein dich ihr tu vous votre te tú usted ustedes eres".split())
FEATURES = 7


def clean(token: str) -> str:
    return token.strip(STRIP)


def words_in(tokens: list[str]) -> set[str]:
    return {w for w in map(clean, set(tokens)) if 3 <= len(w) < LONGEST - 1}


def terms_of(word: str) -> list[str]:
    """The word and its stems."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def count_terms(batches):
    """(term, toxic, other): documents with each word and stem, by label."""
    counts = (Counter(), Counter())

    def out():
        terms = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_pydict(
            {
                "term": pa.array(terms, pa.string()),
                "toxic": pa.array([counts[1][t] for t in terms], pa.int64()),
                "other": pa.array([counts[0][t] for t in terms], pa.int64()),
            }
        )

    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"].to_pylist(), strict=True):
            words = words_in((text.as_py() or "").lower().split())
            counts[1 if toxic else 0].update({t for w in words for t in terms_of(w)})
            if len(counts[0]) + len(counts[1]) > FLUSH:
                yield out()
                for c in counts:
                    c.clear()
    yield out()


def find_contexts(batches):
    """(term, around): for each text's words and stems, a hash of the words around the first."""
    for batch in batches:
        found: set[tuple[str, int]] = set()
        # one text is held at a time, not those of the batch
        for text in batch["text"]:
            words = [clean(w) for w in (text.as_py() or "").lower().split()]
            seen: set[str] = set()
            for i, word in enumerate(words):
                if word in seen or not 3 <= len(word) < LONGEST - 1:
                    continue
                before, after = words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""
                around = zlib.crc32(f"{before} {after}".encode())
                found.update((t, around) for t in terms_of(word) if t not in seen)
                seen.update(terms_of(word))
            if len(found) > GATHERED:
                yield _contexts(found)
                found.clear()
        yield _contexts(found)


def _contexts(found) -> pa.RecordBatch:
    pairs = list(found)
    return pa.RecordBatch.from_pydict(
        {"term": pa.array([t for t, _ in pairs], pa.string()), "around": pa.array([c for _, c in pairs], pa.int64())}
    )


def significance(toxic: int, other: int):
    """The log-likelihood ratio of a term's columns `toxic` and `other`, of so many texts of each label."""

    def x_log_x(v):
        return F.when(v > 0, v * F.log(v)).otherwise(0.0)

    a, c = F.col("toxic").cast("double"), F.col("other").cast("double")
    n = float(toxic + other)
    cells = x_log_x(a) + x_log_x(c) + x_log_x(toxic - a) + x_log_x(other - c)
    edges = x_log_x(a + c) + x_log_x(n - a - c) + sum(v * math.log(v) for v in (toxic, other) if v)
    return 2 * (cells - edges + n * math.log(n))


def choose_terms(held: dict[str, int]) -> list[str]:
    """The words, and the shortest stems that stand for several of them; `held` has texts by term."""
    words = sorted(t for t in held if not t.endswith("*"))
    lexicon: list[str] = []
    for stem in sorted((t for t in held if t.endswith("*")), key=lambda t: (len(t), t)):
        root = stem[:-1]
        low = bisect.bisect_left(words, root)
        own = itertools.takewhile(lambda w: w.startswith(root), itertools.islice(words, low, None))
        covered = any(f"{root[:n]}*" in lexicon for n in STEMS)
        if not covered and max((held[w] for w in own), default=0) < 0.8 * held[stem]:
            lexicon.append(stem)
    return sorted(lexicon + words)


class Automaton:
    """The lexicon's trie met with the Levenshtein automata, as one transition table.

    Accepting states tell the least distance at which a term is met: 0 or 1. A stem
    accepts whatever follows it; short stems and words are met without edits only.
    """

    def __init__(self, lexicon: list[str]):
        self.letters = sorted({c for t in lexicon for c in t.rstrip("*")})
        self._index = {c: i + 1 for i, c in enumerate(self.letters)}
        nodes: list[dict[str, int]] = [{}]
        ends: list[tuple[bool, bool]] = [(False, False)]  # a word ends here; a stem ends here
        fuzzy: set[int] = {0}  # nodes on the way to a term that may hold an edit
        long: set[int] = set()  # their ends
        for term in lexicon:
            stem, letters, at = term.endswith("*"), term.rstrip("*"), 0
            path = [0]
            for c in letters:
                if c not in nodes[at]:
                    nodes.append({})
                    ends.append((False, False))
                    nodes[at][c] = len(nodes) - 1
                at = nodes[at][c]
                path.append(at)
            ends[at] = (ends[at][0] or not stem, ends[at][1] or stem)
            if len(letters) >= FUZZY_LENGTH:
                fuzzy.update(path)
                long.add(at)
        self._nodes, self._ends, self._fuzzy, self._long = nodes, ends, fuzzy, long
        self._build()

    def _at(self, node: int, edits: int) -> tuple[int, int]:
        """A state; -1 stands for the end of a stem, which whatever follows keeps."""
        met = self._ends[node][1] and (edits == 0 or node in self._long)
        return (-1 if met else node), edits

    def _closed(self, states):
        out, todo = set(), list(states)
        while todo:
            state = todo.pop()
            if state in out:
                continue
            out.add(state)
            node, edits = state
            if node >= 0 and edits == 0:
                todo += [self._at(n, 1) for n in self._nodes[node].values() if n in self._fuzzy]
        return frozenset(s for s in out if s[1] == 0 or (s[0], 0) not in out)

    def _after(self, states, letter):
        got = set()
        for node, edits in states:
            if node < 0:
                got.add((node, edits))
                continue
            nxt = self._nodes[node].get(letter)
            if nxt is not None and (edits == 0 or nxt in self._fuzzy):
                got.add(self._at(nxt, edits))
            if edits == 0:
                got.update(self._at(n, 1) for n in self._nodes[node].values() if n in self._fuzzy)
                if node in self._fuzzy:
                    got.add((node, 1))
        return self._closed(got)

    def _build(self):
        start = self._closed({(0, 0)})
        number, order, table = {start: 1, frozenset(): 0}, [start], [[0] * (len(self.letters) + 1)]
        accept = [2]
        for states in order:
            row = []
            for letter in [None, *self.letters]:
                nxt = self._after(states, letter)
                if nxt not in number:
                    number[nxt] = len(number)
                    order.append(nxt)
                row.append(number[nxt])
            table.append(row)
            accept.append(
                min((e for n, e in states if n < 0 or (self._ends[n][0] and (e == 0 or n in self._long))), default=2)
            )
        self.table, self.accept = np.array(table, np.int32), np.array(accept, np.int8)

    def distances(self, words: list[str]) -> np.ndarray:
        """0 or 1 for words that meet a term at that distance, 2 for others."""
        if not words or not self.letters:
            return np.full(len(words), 2, np.int8)
        codes = np.array(words, f"U{LONGEST}").view(np.uint32).reshape(len(words), LONGEST)
        top = max(map(ord, self.letters)) + 2
        classes = np.zeros(top, np.int32)
        for c, i in self._index.items():
            classes[ord(c)] = i
        lengths = (codes != 0).sum(1)
        state = np.ones(len(words), np.int32)
        for i in range(int(lengths.max(initial=0))):
            live = i < lengths
            step = self.table[state, classes[np.minimum(codes[:, i], top - 1)]]
            state = np.where(live, step, state)
        return self.accept[state]


class Finder:
    """Hit counts of texts: by distance, in quoting and in other contexts."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.known, self.hits = automaton, set(), {}

    def learn(self, token_lists) -> None:
        if len(self.known) > 300_000:
            self.known.clear()
        new = list(set().union(*token_lists) - self.known)
        self.known.update(new)
        for word, d in zip(new, self.automaton.distances([clean(w) for w in new]).tolist(), strict=True):
            if d < 2:
                self.hits[word] = d

    def features(self, tokens: list[str]) -> list[float]:
        """Hits: exact, exact and quoted, misspelled, misspelled and quoted; addressed hits; any; density."""
        counts = [0, 0, 0, 0, 0]
        if not self.hits.keys().isdisjoint(tokens):
            inside = np.cumsum([sum(map(t.count, QUOTES)) for t in tokens])
            for i, token in enumerate(tokens):
                d = self.hits.get(token)
                if d is None:
                    continue
                around = [clean(t) for t in tokens[max(0, i - WINDOW) : i + WINDOW + 1]]
                marked = (inside[i] - inside[i - 1] if i else inside[i]) >= 2 or (i and inside[i - 1] % 2 == 1)
                addressed = not ADDRESS.isdisjoint(around)
                quoted = bool(marked) or (not addressed and not REPORTING.isdisjoint(around))
                counts[2 * d + quoted] += 1
                counts[4] += addressed and not quoted
        plain = counts[0] + counts[2]
        return [*np.log1p(counts).tolist(), float(counts[0] > 0), 10.0 * plain / (10 + len(tokens))]


def feature_rows(finder: Finder, texts: pa.Array, size: int = 256) -> list[list[float]]:
    """Features of each text; only `size` texts are held as words at a time."""
    rows = []
    for low in range(0, len(texts), size):
        tokens = [(t or "").lower().split() for t in texts[low : low + size].to_pylist()]
        finder.learn(tokens)
        rows += [finder.features(t) for t in tokens]
    return rows


def finding(lexicon: list[str], also: str | None):
    """A map over Arrow batches: doc_id, the features, and the column `also`."""

    def run(batches):
        finder = Finder(Automaton(lexicon))
        for batch in batches:
            rows = feature_rows(finder, batch["text"])
            out = {"doc_id": batch["doc_id"], "features": pa.array(rows, pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_pydict(out | ({also: batch[also]} if also else {}))

    return run


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last weight is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]),
            x.T @ (weight * (y - p)) - ridge * w,
        )
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn_terms(docs: DataFrame, keys: DataFrame, toxic: int, other: int) -> dict[str, int]:
    """Terms of the lexicon and the toxic texts that hold them, from the texts of `keys`
    (key, toxic, doc_id; one for each distinct text, so many of either label)."""

    def texts(which: str) -> DataFrame:
        hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
        return join_few(hashed, keys.where(which), ["doc_id", "key"]).select("text", "toxic")

    counts = pin_texts(
        texts("toxic in (0, 1)").mapInArrow(count_terms, "term string, toxic long, other long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    )
    # of all terms less than one would pass by chance
    least = 2 * math.log(2 * max(1, counts.count()))
    marked = counts.where(
        (F.col("toxic") >= FLOOR)
        & (F.col("toxic") / toxic >= RATIO * (F.col("other") + 0.5) / max(1, other))
        & (significance(toxic, other) >= least)
    ).select("term", "toxic")
    fresh = (
        texts("toxic = 1")
        .mapInArrow(find_contexts, "term string, around long")
        .join(marked, "term")
        .distinct()
        .groupBy("term", "toxic")
        .count()
        .where(F.col("count") >= FRESH * F.col("toxic"))
    )
    with text_batches(docs.sparkSession):
        return {r.term: r.toxic for r in fresh.select("term", "toxic").collect()}


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray | None]:
    """Lexicon and weights from the labelled rows whose crc32 of the id mod 5 is not 0."""
    hashed = docs.where((crc_of_id() % 5 != 0) & F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("key")
    )
    keys = pin(
        hashed.join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id")
        .groupBy("key")
        .agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    )
    whole = dict(keys.where("toxic in (0, 1)").groupBy("toxic").count().collect())
    if not whole.get(1):
        return [], None
    parts = [keys.where(F.col("toxic") == v).orderBy("key").limit(SAMPLE) for v in (0, 1)]
    picked = pin(parts[0].union(parts[1]))
    # at most 2 * SAMPLE rows of three numbers
    sample = pin(
        docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
        .join(F.broadcast(picked), ["doc_id", "key"])
        .dropDuplicates(["key"])
        .select("doc_id", "text", "toxic")
    )
    sizes = dict(sample.groupBy("toxic").count().collect())
    lexicon = choose_terms(learn_terms(docs, keys, whole[1], whole.get(0, 0)))
    with text_batches(docs.sparkSession):
        rows = sample.mapInArrow(finding(lexicon, "toxic"), "doc_id long, features array<double>, toxic int").collect()
    x, y = np.array([r.features for r in rows]), np.array([float(r.toxic) for r in rows])
    return lexicon, fit(x, y, np.array([whole[r.toxic] / sizes[r.toxic] for r in rows]))


def probabilities(x: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
    if weights is None:
        return np.zeros(len(x))
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of `docs` (doc_id, text)."""
    lexicon, weights = train(docs, labels)
    ask = finding(lexicon, None)

    def run(batches):
        for batch in ask(batches):
            p = probabilities(np.array(batch["features"].to_pylist()).reshape(-1, FEATURES), weights)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": pa.array(p, pa.float64())})

    scored = pin_texts(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    )
    return scored.select(
        "doc_id",
        F.coalesce(crc_of_id() % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, each judged by its own text.

    Workers get ids and texts alone, and give the id and the hash of the text where it is toxic.
    """
    lexicon, weights = train(docs, labels)
    own, text_hash = free_name("gone_id", docs.columns), free_name("gone_hash", docs.columns)
    maybe, columns = free_name("maybe_gone", docs.columns), [F.col(f"`{c}`") for c in docs.columns]

    def run(batches):
        finder = Finder(Automaton(lexicon))
        for batch in batches:
            x = np.array(feature_rows(finder, batch["text"])).reshape(-1, FEATURES)
            yield batch.select([own, text_hash]).filter(pa.array(probabilities(x, weights) >= 0.5))

    asked = docs.select(F.col("doc_id").alias(own), F.xxhash64("text").alias(text_hash), "text")
    gone = pin_texts(asked.mapInArrow(run, asked.drop("text").schema).distinct())
    key = F.xxhash64("doc_id", F.xxhash64("text"))
    flagged = maybe_in(docs, key, gone.select(F.xxhash64(own, text_hash).alias("key")), maybe)
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(text_hash))
    # rows that surely stay do not move
    moved = flagged.where(F.col(maybe)).join(gone, same, "left_anti")
    return flagged.where(~F.col(maybe)).select(*columns).union(moved.select(*columns))


def query(spark, sf_dir):
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
