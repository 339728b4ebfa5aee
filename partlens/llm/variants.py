"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

One edit changes the letter counts of a word by an L1 distance of two at most: a
replaced letter takes one count down and one up, an added letter takes one up.  So
for each pair of lengths (equal, or one apart) a word asks a k-d tree for all
boxes it can reach with that many steps, and the order of the letters is compared
only for the words found there.

The words are spread by a tree fitted on a bounded sample of them.  Its boxes are
known by their cuts, so the search misses nothing however the sample falls; it only
evens out the shares.  A share beyond its bound is dealt into parts that all of its
visitors ask.  Each task builds a tree over its own words and streams the visitors.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlens.llm.common import written
from partlens.session import cut_lineage

#: Shortest word, fewest occurrences, and how many times as often a form must occur.
LENGTH, OCCURRENCES, TIMES = 7, 2, 10
#: A run loses a letter if this divides its hash.
DIVISOR = 31
#: Letters are counted by their low five bits; the last coordinate is the length.
LETTERS = 32
#: Words of a share, most shares told apart by cuts, sampled words for each of them, and words of a leaf.
SHARE_WORDS, MOST_CELLS, SAMPLED, LEAF = 16_384, 16_384, 16, 12
#: Words counted by a task before it hands them on, visitors searched at once, pairs weighed at once, letters compared side by side.
HELD_WORDS, AT_ONCE, PAIRS_AT_ONCE, WIDTH = 200_000, 4_096, 2_000_000, 64


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``, ``n``: the runs of letters with some letters taken out, LENGTH letters or more, that occur OCCURRENCES times or more.

    A null text holds no runs; a null id is hashed as an empty string.  Tasks add up
    their own words before the shuffle, so that a frequent word is no hot key.
    """
    runs = re.compile(rf"[a-zÀ-ÿ]{{{LENGTH},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                start, words = zlib.crc32(f"{'' if id_ is None else id_}:".encode()), []
                for word in runs.findall(text.encode().lower().decode()):
                    h = zlib.crc32(word.encode(), start)
                    if h % DIVISOR == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LENGTH:
                            continue
                    words.append(word)
                held.update(words)
                if len(held) >= HELD_WORDS:
                    yield told()
        yield told()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("length(text) > 0")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def letter_counts(words: list[bytes]) -> np.ndarray:
    """Counts of the letters (by their low five bits) and the length of each word: no edit moves one of them by more than one."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(b"".join(words), np.uint8) & (LETTERS - 1)
    counts = np.bincount(np.repeat(np.arange(len(words)) * LETTERS, sizes) + letters, minlength=len(words) * LETTERS)
    return np.concatenate([counts.reshape(-1, LETTERS), sizes[:, None]], axis=1).astype(np.int32)


@dataclass
class Tree:
    """A k-d tree: each node cuts one coordinate (``dim``, -1 at a leaf) into values up to ``at`` and beyond; leaves hold ``order[first:last]``."""

    dim: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray
    first: np.ndarray
    last: np.ndarray
    order: np.ndarray

    @classmethod
    def over(cls, vectors: np.ndarray, leaf: int) -> Tree:
        """Cut at the coordinate whose mean splits the vectors most evenly, down to ``leaf`` of them or until all are equal."""
        nodes: list[list[int]] = []
        order = np.arange(len(vectors))
        open_ = [(0, len(vectors), -1)]
        while open_:
            first, last, parent = open_.pop()
            place = len(nodes)
            if parent >= 0:
                # The right side is taken from the stack first, so the left one is told its place afterwards.
                nodes[parent][3 if nodes[parent][3] < 0 else 2] = place
            nodes.append([-1, 0, -1, -1, first, last])
            n = last - first
            if n <= leaf:
                continue
            own = vectors[order[first:last]]
            cut = own.mean(axis=0).astype(np.int64)
            low = (own <= cut).sum(axis=0)
            dim = int(np.abs(2 * low - n).argmin())
            if low[dim] in (0, n):
                continue
            below = own[:, dim] <= cut[dim]
            order[first:last] = np.concatenate([order[first:last][below], order[first:last][~below]])
            nodes[place][:2] = [dim, int(cut[dim])]
            middle = first + int(low[dim])
            open_ += [(first, middle, place), (middle, last, place)]
        return cls(*np.array(nodes, np.int64).reshape(-1, 6).T, order)

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf (as a node) that each vector belongs to."""
        node = np.zeros(len(vectors), np.int64)
        inner = np.flatnonzero(self.dim[node] >= 0)
        while inner.size:
            at = node[inner]
            node[inner] = np.where(vectors[inner, self.dim[at]] <= self.at[at], self.left[at], self.right[at])
            inner = inner[self.dim[node[inner]] >= 0]
        return node

    def reach(self, vectors: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray]:
        """(vector, leaf) for all leaves whose box a vector reaches by one edit to a word of equal length, or to one letter more.

        A box across a cut is reached by a step up or down in that coordinate: one
        up for an added letter, one up and one down for a replaced one.
        """
        vectors = vectors + np.eye(1, LETTERS + 1, LETTERS, dtype=vectors.dtype) if longer else vectors
        who, node = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        up, down = np.ones(len(vectors), bool), np.full(len(vectors), not longer)
        found = []
        while who.size:
            leaf = self.dim[node] < 0
            if leaf.any():
                found.append((who[leaf], node[leaf]))
                who, node, up, down = who[~leaf], node[~leaf], up[~leaf], down[~leaf]
            dim = self.dim[node]
            over = vectors[who, dim] - self.at[node]
            letter = dim < LETTERS
            rise, fall = letter & up & (over == 0), letter & down & (over == 1)
            near = np.where(over <= 0, self.left[node], self.right[node])
            node = np.concatenate([near, self.right[node[rise]], self.left[node[fall]]])
            who = np.concatenate([who, who[rise], who[fall]])
            up, down = np.concatenate([up, np.zeros(rise.sum(), bool), up[fall]]), np.concatenate([down, down[rise], np.zeros(fall.sum(), bool)])
        return (np.concatenate([w for w, _ in found]), np.concatenate([n for _, n in found])) if found else (who, node)


class Words:
    """Words with what the search compares: counts, their last two bits in one number, and the letters from either end."""

    def __init__(self, words: list[bytes], n: np.ndarray):
        self.words, self.n = words, n
        self.vectors = letter_counts(words)
        self.size = self.vectors[:, LETTERS].astype(np.int64)
        self.bits = ((self.vectors[:, :LETTERS].astype(np.uint64) & np.uint64(3)) << (2 * np.arange(LETTERS)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
        width = min(WIDTH, int(self.size.max(initial=1)))
        short = [w if len(w) <= WIDTH else b"" for w in words]
        self.head = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in short), np.uint8).reshape(-1, width)
        self.tail = np.frombuffer(b"".join(w.rjust(width, b"\0") for w in short), np.uint8).reshape(-1, width)


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether two different words of lengths at most one apart differ by one added, taken out or replaced letter."""
    most, least = max(len(a), len(b)), min(len(a), len(b))
    head = next((i for i in range(least) if a[i] != b[i]), least)
    tail = next((i for i in range(least) if a[-1 - i] != b[-1 - i]), least)
    return head + tail >= most - 1


def _alike(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Which of the pairs are one edit apart: what they share from the front and from the back leaves one letter at most."""
    width = min(a.head.shape[1], b.head.shape[1])
    least, most = np.minimum(a.size[i], b.size[j]), np.maximum(a.size[i], b.size[j])
    heads = a.head[i, :width] != b.head[j, :width]
    tails = (a.tail[i, -width:] != b.tail[j, -width:])[:, ::-1]
    shared = [np.minimum(np.where(x.any(axis=1), x.argmax(axis=1), width), least) for x in (heads, tails)]
    alike = shared[0] + shared[1] >= most - 1
    for k in np.flatnonzero(most > WIDTH):
        alike[k] = one_edit(a.words[i[k]], b.words[j[k]])
    return alike


def _pairs(visitors: Words, home: Words, tree: Tree, longer: bool, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (visitor, home word) one edit apart, the home word as long or one letter longer; ``own``: the visitors are the home words, each pair once."""
    for start in range(0, len(visitors.words), AT_ONCE):
        who, leaf = tree.reach(visitors.vectors[start : start + AT_ONCE], longer)
        who, first, count = who + start, tree.first[leaf], (tree.last - tree.first)[leaf]
        ends = np.cumsum(count)
        at = 0
        while at < len(who):
            # A leaf of equal vectors may hold many words: as many rows are opened as fit, one row in slices.
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
            for shift in range(0, int(count[at:to].max()), PAIRS_AT_ONCE):
                n = np.clip(count[at:to] - shift, 0, PAIRS_AT_ONCE)
                i = np.repeat(who[at:to], n)
                j = tree.order[np.repeat(first[at:to] + shift - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                apart = visitors.bits[i] ^ home.bits[j]
                fit = (np.bitwise_count((apart | apart >> np.uint64(1)) & np.uint64(0x5555555555555555)) <= 2) & (home.size[j] == visitors.size[i] + longer)
                if own and not longer:
                    fit &= i < j
                i, j = i[fit], j[fit]
                alike = _alike(visitors, i, home, j)
                if alike.any():
                    yield i[alike], j[alike]
            at = to


def _told(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> pa.RecordBatch:
    """For each word of ``a`` in the pairs: how many it is near, and the commonest of them (of equals, the smallest)."""
    spell = np.empty(len(b.words), np.int64)
    spell[sorted(range(len(b.words)), key=b.words.__getitem__)] = np.arange(len(b.words))
    order = np.lexsort([spell[j], -b.n[j], i])
    i, j = i[order], j[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if i.size else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(i)]]))
    return pa.RecordBatch.from_arrays(
        [pa.array([a.words[k].decode("latin-1") for k in i[first]], pa.string()), pa.array(count, pa.int64()),
         pa.array(b.n[j[first]], pa.int64()), pa.array([b.words[k].decode("latin-1") for k in j[first]], pa.string())],
        names=["word", "n_near", "form_n", "form"],
    )


def _search(home: Words, tree: Tree, visitors: Words, same: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Both sides of all pairs of a share's words with each other (``same`` None) or with visitors; ``same`` says which of those may meet words of their length."""
    for longer in (False, True):
        asking = visitors
        if same is not None and not longer:
            if not same.any():
                continue
            asking = Words([w for w, s in zip(visitors.words, same.tolist(), strict=True) if s], visitors.n[same])
        pairs = list(_pairs(asking, home, tree, longer, same is None))
        if pairs:
            i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
            yield _told(asking, i, home, j)
            yield _told(home, j, asking, i)


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (share, home, word, n), sorted by share and with its own words first: the near words found in it."""
    share, own, home, tree = None, [], None, None

    def words_of(rows: pa.Table | pa.RecordBatch) -> Words:
        return Words([w.encode("latin-1") for w in rows.column("word").to_pylist()], rows.column("n").to_numpy())

    def built() -> Iterator[pa.RecordBatch]:
        nonlocal home, tree, own
        home = words_of(pa.Table.from_batches(own))
        tree, own = Tree.over(home.vectors, LEAF), []
        yield from _search(home, tree, home, None)

    for batch in batches:
        shares = batch.column("share").to_numpy()
        cuts = [0, *(np.flatnonzero(shares[1:] != shares[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if share != shares[a]:
                if own:
                    yield from built()
                share, home = int(shares[a]), None
            homes = part.column("home").to_numpy()
            n_own = int(np.searchsorted(homes != share, True))
            if n_own:
                own.append(part.slice(0, n_own))
            if n_own < part.num_rows:
                if home is None:
                    if not own:
                        continue
                    yield from built()
                visitors = part.slice(n_own)
                yield from _search(home, tree, words_of(visitors), homes[n_own:] < share)
    if own:
        yield from built()


def near_words(words: DataFrame, share_words: int = SHARE_WORDS) -> DataFrame:
    """``word``, ``n_near``, ``form_n``, ``form`` (``word``, ``n``): partial results by share, to be added up by word.

    Of two words of equal length the one of the lower share visits the other's; of
    two lengths the shorter one visits.  So each pair is met once.
    """
    total = words.count()
    wanted = min(MOST_CELLS, max(1, -(-total // share_words)))
    # The sample is taken by a hash, so that reruns cut alike; about SAMPLED words for each share and never more than twice that of MOST_CELLS.
    drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(max(1, total // (SAMPLED * wanted)))) == 0).select("word").limit(2 * SAMPLED * MOST_CELLS)
    sample = [r.word.encode("latin-1") for r in drawn.collect()] if wanted > 1 else []
    cells = Tree.over(letter_counts(sorted(sample)) if sample else np.zeros((0, LETTERS + 1), np.int32), SAMPLED)
    cells = Tree(cells.dim, cells.at, cells.left, cells.right, cells.first, cells.last, np.zeros(0, np.int64))
    spread = words.sparkSession.sparkContext.broadcast(cells)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = spread.value.home(letter_counts([w.encode("latin-1") for w in batch.column("word").to_pylist()]))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *batch.columns], names=["cell", *batch.schema.names])

    # One row for each cell, at most two for each of MOST_CELLS: how many parts it is dealt into.
    sizes = words.select("word").mapInArrow(at_home, "cell long, word string").groupBy("cell").count().collect()
    first = np.zeros(len(cells.dim) + 1, np.int64)
    for r in sizes:
        first[r["cell"] + 1] = -(-r["count"] // share_words)
    first = np.cumsum(np.maximum(first, np.concatenate([[0], cells.dim < 0])))
    starts = words.sparkSession.sparkContext.broadcast(first)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, first = spread.value, starts.value
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
                vectors = letter_counts(words)
                cell = cells.home(vectors)
                dealt = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
                home = first[cell] + dealt % (first[cell + 1] - first[cell])
                goals = [(np.arange(len(words)), home)]
                for longer in (False, True):
                    who, node = cells.reach(vectors, longer)
                    parts = first[node + 1] - first[node]
                    who, share = np.repeat(who, parts), np.repeat(first[node] - (np.cumsum(parts) - parts), parts) + np.arange(parts.sum())
                    wanted = share != home[who] if longer else share > home[who]
                    goals.append((who[wanted], share[wanted]))
                # A word that may visit a share for both lengths goes there once.
                both = np.unique(np.concatenate([w * np.int64(first[-1]) + s for w, s in goals]))
                who, share = both // first[-1], both % first[-1]
                rows = batch.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([pa.array(share, pa.int64()), pa.array(home[who], pa.int64()), *rows.columns], names=["share", "home", "word", "n"])

    routed = words.select("word", "n").mapInArrow(visits, "share long, home long, word string, n long")
    tasks = int(max(1, min(first[-1], 100_000)))
    dealt = routed.repartition(tasks, "share").sortWithinPartitions("share", F.col("home") != F.col("share"))
    return dealt.mapInArrow(_shares, "word string, n_near long, form_n long, form string")


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` of rows ``word``, ``form``: forms followed to the last.

    A form occurs TIMES times as often as its word, so a chain is no longer than the
    digits of the largest count, and following two steps at once takes a few rounds.
    """
    led = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        on = led.select(F.col("word").alias("via"), F.col("root").alias("next"))
        step = cut_lineage(led.join(on, F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        led = step.select("word", "root")
        if step.where("moved").isEmpty():
            return led


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share_words: int = SHARE_WORDS) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word that ``counted_words`` gives.

    ``form``: the near word of largest ``n`` (ties: the smallest), if that is TIMES
    times the word's or more, else null.  ``root``: the end of the forms, the word
    itself if it has none.  Null texts hold no words, repeated rows count each, other
    columns are not read, an empty table gives an empty result.
    """
    words = written(counted_words(docs, id_col, text_col), "words")
    near = near_words(words, share_words).select("word", F.lit(None).cast("long").alias("n"), "n_near", "form_n", "form")
    nothing = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"), F.lit(None).cast("string").alias("form"))
    best = F.min(F.when(F.col("form_n").isNotNull(), F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("w"))))
    met = nothing.unionByName(near).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    often = -F.col("best.m") >= TIMES * F.col("n")
    told = written(met.select("word", F.when(often, F.col("best.w")).alias("form"), "n", "n_near", F.when(often, -F.col("best.m")).alias("form_n")), "forms")
    led = roots(told.where("form is not null")).withColumnRenamed("word", "from")
    return told.join(led, F.col("word") == F.col("from"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
