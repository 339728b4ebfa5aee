"""Document scores by masked pseudo-likelihood.

A small network (numpy) predicts each word from the two words on either side: their
vectors, weighted by place, are summed and squashed, a softmax gives the word's
class, and the corpus' counts give the word within its class.  A document's score
is the sum of these conditional log-probabilities over all its words.  Words that are
not among the commonest have a vector and a class in common, but each its own
probability within the class, joined in by word from the table of counts.

Word counts cover the whole corpus.  The network learns from every document too:
in each of ROUNDS rounds each task trains on another share of the positions of all its
texts, so on every position once, and the weights of the tasks are averaged by a grouped
sum of whole numbers (so their order does not matter).  What reaches the driver has a
fixed size: the commonest words and the averaged weights.

A text is cut into words twice: once to count them, once to write it as numbers,
the ranks of its words and the words that have none; the rounds and the scoring
read the numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlens.llm.common import coarse, written
from partlens.llm.token_counts import _bounded
from partlens.session import cut_lineage

#: Words with a vector of their own, classes (the commonest words have one each), size of vectors, words seen on either side.
VOCABULARY, CLASSES, OWN_CLASS, SIZE, SIDE = 4_096, 128, 64, 16, 2
#: Positions are learned from STEP at a time; weights are averaged ROUNDS times; SCALE makes them whole numbers.
STEP, ROUNDS, RATE, SCALE = 4_096, 2, 0.05, 1 << 24
SCORED_AT_ONCE, RANKS_AT_ONCE, AT_ONCE = 16_384, 300_000, 1_024
#: Different words that a task counts before it hands its counts on.
COUNTED = 200_000


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than space and x09-x0D; none for a null text."""
    return (text or "").encode().split()


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` (bytes) and ``n`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                if len(counts) > COUNTED:
                    yield handed(counts)
                    counts = Counter()
        yield handed(counts)

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """The commonest words by rank, the class of each, and the log-probability of a word within its class."""

    place: dict[bytes, int]
    kind: np.ndarray
    within: np.ndarray

    @classmethod
    def of(cls, counted: DataFrame, vocabulary: int = VOCABULARY) -> Words:
        """The last entry stands for all other words: ``within`` has one over their mass, to be multiplied by a word's own count."""
        # Words per bucket of counts (a bounded number of rows) tell from which count on there are enough; only those are ordered.
        sizes = counted.groupBy(coarse(F.col("n")).alias("from")).count().orderBy(F.desc("from")).collect()
        enough = np.cumsum([r["count"] for r in sizes]) >= vocabulary
        least = sizes[int(enough.argmax())]["from"] if enough.any() else 0
        top = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(vocabulary).collect()
        total = counted.agg(F.sum("n")).first()[0] or 0
        place = {bytes(r.word): i for i, r in enumerate(top)}
        n = np.array([r.n for r in top], np.float64)
        kind = np.array([i if i < OWN_CLASS else OWN_CLASS + (i - OWN_CLASS) % (CLASSES - OWN_CLASS - 1) for i in range(len(top))] + [CLASSES - 1], np.int64)
        mass = np.bincount(kind[:-1], n, CLASSES)
        within = np.log(n) - np.log(mass[kind[:-1]])
        return cls(place, kind, np.append(within, -np.log(max(total - n.sum(), 1))))

    @property
    def other(self) -> int:
        return len(self.place)

    def ranks(self, found: list[bytes]) -> np.ndarray:
        get, other = self.place.get, self.other
        return np.fromiter((get(w, other) for w in found), np.uint16, len(found))


class Network:
    """Vectors (the last one stands for the edge of a text), weights by place, and the class layer, in one flat array."""

    def __init__(self, entries: int, flat: np.ndarray | None = None, seed: int = 17):
        self.entries = entries
        shapes = [(entries + 1, SIZE), (2 * SIDE, SIZE), (SIZE,), (SIZE, CLASSES), (CLASSES,)]
        sizes = [int(np.prod(s)) for s in shapes]
        if flat is None:
            rng = np.random.default_rng(seed)
            scales = [0.3, 0.0, 0.0, 1 / np.sqrt(SIZE), 0.0]
            flat = np.concatenate([rng.normal(0, 1, n) * s for n, s in zip(sizes, scales, strict=True)])
            flat[sizes[0] : sizes[0] + sizes[1]] = 1 + rng.normal(0, 0.3, sizes[1])
        self.flat = flat.astype(np.float32)
        self.vector, self.weight, self.shift, self.out, self.bias = (p.reshape(s) for p, s in zip(np.split(self.flat, np.cumsum(sizes)[:-1]), shapes, strict=True))

    def hidden(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = self.vector[around]
        return seen, np.tanh(np.einsum("nks,ks->ns", seen, self.weight) + self.shift)

    def log_probability(self, around: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Of the class at each position, given the words around it."""
        out = np.empty(len(kind), np.float32)
        for at in range(0, len(kind), AT_ONCE):
            own = kind[at : at + AT_ONCE]
            score = self.hidden(around[at : at + AT_ONCE])[1] @ self.out
            score += self.bias
            score -= score.max(1, keepdims=True)
            told = score[np.arange(len(own)), own]
            np.exp(score, out=score)
            out[at : at + AT_ONCE] = told - np.log(score.sum(1))
        return out

    def learn(self, around: np.ndarray, kind: np.ndarray, grown: np.ndarray, rate: float = RATE) -> None:
        """One step of Adagrad; ``grown`` holds the squares so far, like ``flat``."""
        n = len(kind)
        step = Network(self.entries, np.zeros_like(self.flat))
        each = np.empty((*around.shape, SIZE), np.float32)
        # The gradient is summed over slices that stay in a processor's cache.
        for at in range(0, n, AT_ONCE):
            own = kind[at : at + AT_ONCE]
            seen, h = self.hidden(around[at : at + AT_ONCE])
            score = h @ self.out
            score += self.bias
            score -= score.max(1, keepdims=True)
            np.exp(score, out=score)
            score /= score.sum(1, keepdims=True)
            score[np.arange(len(own)), own] -= 1
            score /= n
            step.out += h.T @ score
            step.bias += score.sum(0)
            inner = (score @ self.out.T) * (1 - h * h)
            step.weight += np.einsum("nks,ns->ks", seen, inner)
            step.shift += inner.sum(0)
            np.multiply(inner[:, None, :], self.weight, out=each[at : at + AT_ONCE])
        # Ranks fit 16 bits, and those are sorted by digits.
        ids = around.ravel().astype(np.uint16)
        by = np.argsort(ids, kind="stable")
        ids = ids[by]
        first = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
        step.vector[ids[first]] = np.add.reduceat(each.reshape(-1, SIZE)[by], first)
        grown += step.flat * step.flat
        self.flat -= rate * step.flat / (np.sqrt(grown) + 1e-6)


def encode(docs: DataFrame, words: Words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row``, ``id``, ``n_words``, ``ranks`` (16-bit numbers, that of ``words.other`` for all others) and ``rare`` (the others, how often) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = shared.value.other
        for batch in batches:
            for part in _bounded(batch):
                ranks, counts, lengths = [], [], []
                for text in part.column(1).to_pylist():
                    found = words_of(text)
                    row = shared.value.ranks(found)
                    ranks.append(row.tobytes())
                    counts.append(Counter([found[i] for i in np.flatnonzero(row == other).tolist()]))
                    lengths.append(len(found))
                ends = np.cumsum([0, *map(len, counts)])
                rare = [pa.array([w for c in counts for w in c], pa.binary()), pa.array([k for c in counts for k in c.values()], pa.int64())]
                rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(rare, names=["word", "times"]))
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(0), pa.array(lengths, pa.int64()), pa.array(ranks, pa.binary()), rare], names=["row", "id", "n_words", "ranks", "rare"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return written(rows.mapInArrow(run, "row long, id long, n_words long, ranks binary, rare array<struct<word: binary, times: long>>"), "words")


def laid_out(texts: list[bytes], edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of all texts in a row with the edge mark around each text; the places of words; the text of each."""
    found = [np.frombuffer(t, np.uint16) for t in texts]
    lengths = np.array([f.size for f in found], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    places = np.arange(owner.size) + SIDE * (owner + 1)
    row = np.full(owner.size + SIDE * (len(texts) + 1), edge, np.int64)
    row[places] = np.concatenate(found) if found else []
    return row, places, owner


def encoded(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return laid_out([words.ranks(words_of(t)).tobytes() for t in texts], words.other + 1)


def _parts(batches: Iterator[pa.RecordBatch], ranks: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about RANKS_AT_ONCE ranks, a longer text alone."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(ranks)).to_numpy(zero_copy_only=False)) // 2
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + RANKS_AT_ONCE, "right")))
            yield batch.slice(at, to - at)
            at = to


_AROUND = np.array([k for k in range(-SIDE, SIDE + 1) if k])


def _round(rows: DataFrame, words, flat: np.ndarray, turn: int, rounds: int) -> DataFrame:
    """``i`` and whole-number sums: of weights times positions, and of positions (at -1); ``rows`` are texts, or what ``encode`` made of them."""
    numbers = rows if "ranks" in rows.columns else encode(rows, words.value, "id")
    start = rows.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        net, learned = Network(known.other + 1, start.value.copy()), 0
        grown = np.full_like(net.flat, 1e-8)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for part in _parts(batches, 0):
            row, places, _ = laid_out(part.column(0).to_pylist(), known.other + 1)
            places = places[places % rounds == turn]
            held.append((row[places[:, None] + _AROUND], known.kind[row[places]]))
            around, kind = (np.concatenate(x) for x in zip(*held, strict=True))
            full = len(kind) - len(kind) % STEP
            for at in range(0, full, STEP):
                net.learn(around[at : at + STEP], kind[at : at + STEP], grown)
            learned += full
            held = [(around[full:], kind[full:])]
        rest = len(held[0][1]) if held else 0
        if rest:
            net.learn(*held[0], grown)
        learned += rest
        if learned:
            sums = np.rint(np.append(net.flat.astype(np.float64) * SCALE, 1) * learned).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(net.flat.size), -1), pa.int64()), pa.array(sums)], names=["i", "v"])

    made = numbers.select("ranks").mapInArrow(run, "i long, v long")
    return made.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))


def train(docs: DataFrame, words: Words, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> Network:
    """The network after ``rounds`` of training in all tasks and averaging by positions."""
    return _trained(encode(docs, words, id_col, text_col), words, rounds)


def _trained(numbers: DataFrame, words: Words, rounds: int = ROUNDS) -> Network:
    shared = numbers.sparkSession.sparkContext.broadcast(words)
    net = Network(words.other + 1)
    for turn in range(rounds):
        sums = {r.i: int(r.v) for r in _round(numbers, shared, net.flat, turn, rounds).collect()}
        if -1 not in sums:
            continue
        net = Network(net.entries, np.array([sums[i] / sums[-1] / SCALE for i in range(net.flat.size)]))
    return net


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_words``, ``log_likelihood`` (sum over all words) and ``per_word`` of every row.

    A text without words (null, empty, blank) scores 0 with a null ``per_word``;
    repeated rows are scored and learned from each; an empty table gives an empty result;
    other columns are not read.  The averaged weights depend on how the table is split
    into partitions, so scores of reruns agree for the same split.
    """
    counted = cut_lineage(count_words(docs, text_col))
    words = Words.of(counted)
    numbers = encode(docs, words, id_col, text_col)
    net = _trained(numbers, words)
    shared = docs.sparkSession.sparkContext.broadcast((words, net.flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat = shared.value
        network = Network(known.other + 1, flat)
        for part in _parts(batches, 3):
            row, places, owner = laid_out(part.column(3).to_pylist(), known.other + 1)
            told = [
                network.log_probability(row[here[:, None] + _AROUND], known.kind[row[here]]) + known.within[row[here]]
                for here in (places[at : at + SCORED_AT_ONCE] for at in range(0, places.size, SCORED_AT_ONCE))
            ]
            sums = np.bincount(owner, np.concatenate(told) if told else None, part.num_rows).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sums, pa.float64())], names=["row", "id", "n_words", "known"])

    # Whole numbers, so that the order of the sum does not matter.
    own = counted.select("word", F.round(F.log("n") * SCALE).cast("long").alias("own"))
    each = numbers.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times").join(own, "word")
    sums = each.groupBy("row").agg(F.sum(F.col("times") * F.col("own")).alias("more"))
    value = F.col("known") + F.coalesce("more", F.lit(0)) / F.lit(float(SCALE))
    told = numbers.select("row", "id", "n_words", "ranks").mapInArrow(run, "row long, id long, n_words long, known double")
    scored = told.join(sums, "row", "left").withColumn("log_likelihood", value)
    return scored.select("id", "n_words", "log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("per_word"))
