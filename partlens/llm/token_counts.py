"""Token counts by prefix dynamic programming over a SentencePiece BPE vocabulary.

The encoding of a prefix ends in exactly one piece ``t``, and what stands before it
is the encoding of the shorter prefix; so ``count[i] = count[i - len(t)] + 1`` for
the one ``t`` that may follow the last piece there.  Two neighbours may stand
together if encoding just the two gives them back.  One pass stores the count at
every prefix; totals, truncation and budgets are then looked up.

Pieces never run across some places (before a space mark that follows another
character, around line ends and tabs, if the vocabulary has no piece across them),
so a text is cut there and the prefix counts of each distinct part are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
LONE = "\n\r\t"
#: Parts (and neighbours) remembered in a task; beyond that the memory is emptied and filled anew.
REMEMBERED = 200_000
#: Pairs of pieces whose standing together is remembered.
PAIRS = 1_500_000
#: Keys and marks of the search: a trie's entry for the piece that ends there, and what a prefix ends in.
PIECE, START, UNKNOWN, NOTHING = 0, -1, -2, -3
#: Characters of text that are counted at a time.
CHARS_AT_ONCE = 2_000_000


def safe_parts(pieces: list[str]) -> tuple[re.Pattern[str], str]:
    """A pattern that cuts a marked text where no piece runs across, and the characters that always stand alone."""
    across = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
    lone = "".join(c for c in LONE if not any(c in pair for pair in across))
    out = re.escape(lone)
    if not any(b == MARK and a != MARK for a, b in across):
        parts = rf"{MARK}+[^{MARK}{out}]*|[^{MARK}{out}]+"
    else:
        parts = rf"[^{out}]+" if lone else r"(?s:.+)"
    return re.compile(parts + (rf"|[{out}]" if lone else "")), lone


def words_of(text: str) -> list[str] | None:
    """A text cut at single spaces and before line ends, if that cuts it as ``safe_parts`` would (no runs of spaces, no marks).

    A word that begins with a line end follows it without a mark; each other
    word stands for itself with a mark in front.
    """
    if "  " in text or MARK in text or text[0] == " ":
        return None
    return text.replace("\n", " \n").split(" ")


class Remembered(dict):
    """What ``make`` gives for a key, remembered for a bounded number of keys."""

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            # What was met since the last time is kept for one more round; what is met again moves on.
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


class PrefixCounter:
    """Exact token counts of every prefix, as the library encodes it without begin or end tokens."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.library.get_piece_size()
        plain = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        plain.sort(key=lambda i: -self.library.get_score(i))
        #: Pieces by the order in which they are merged; a piece is known by its place from here on.
        self.texts = [self.library.id_to_piece(i) for i in plain]
        self.place = {t: i for i, t in enumerate(self.texts)}
        self.trie: dict = {}
        for i, t in enumerate(self.texts):
            node = self.trie
            for c in t:
                node = node.setdefault(c, {})
            node[PIECE] = i
        self.part, self.lone = safe_parts(self.texts)
        self.prefix = self._starts_with_mark()
        self.quick = self.prefix and "\n" in self.lone and self.part.match(f"a{MARK}").end() == 1
        self.known: dict[str, bytes] = {}
        self.totals = Remembered(self._word, 2 * REMEMBERED)
        self.together: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}

    def _starts_with_mark(self) -> bool:
        return self.library.encode("a", out_type=str)[0].startswith(MARK)

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """A short text encoded by its merges (the first-ranked neighbours join first, the leftmost of equals), and the last two joined."""
        made, joined = list(text), None
        while len(made) > 1:
            best, at = len(self.texts), -1
            for i in range(len(made) - 1):
                rank = self.place.get(made[i] + made[i + 1], best)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                break
            joined = (made[at], made[at + 1])
            made[at : at + 2] = [made[at] + made[at + 1]]
        return made, joined

    def _halves(self, piece: int) -> tuple[int, int] | None:
        """The two pieces that a piece is merged from; (piece, piece) for a character; None if its text is not encoded as itself."""
        if piece not in self.halves:
            made, joined = self._merged(self.texts[piece])
            found = None
            if made == [self.texts[piece]]:
                found = (self.place.get(joined[0], UNKNOWN), self.place.get(joined[1], UNKNOWN)) if joined else (piece, piece)
            self.halves[piece] = found
        return self.halves[piece]

    def _stand(self, a: int, b: int) -> bool:
        """Whether encoding the two pieces together gives them back.

        Undone merge by merge, latest first, no pair that ever touched at their
        border may have a merge ranked before the one that covered it.
        """
        if self._halves(b) is None:
            return False
        if a == START:
            return True
        if self._halves(a) is None:
            return False
        before = len(self.texts)
        while True:
            joint = self.place.get(self.texts[a] + self.texts[b])
            if joint is not None and joint < before:
                return False
            left, right = self._halves(a), self._halves(b)
            if a > b:
                # On the left the border pair must merge before the left piece does; an equal rank goes to the leftmost.
                before, inner = a, left[1]
                if inner == a:
                    before, inner = b + 1, right[0]
                    if inner == b:
                        return True
                    b = inner
                else:
                    a = inner
            else:
                before, inner = b + 1, right[0]
                if inner == b:
                    before, inner = a, left[1]
                    if inner == a:
                        return True
                    a = inner
                else:
                    b = inner
            if a == UNKNOWN or b == UNKNOWN:
                return True

    def _count(self, part: str) -> list[int]:
        n, size = len(part), len(self.texts)
        counts, last = [0] * (n + 1), [NOTHING] * (n + 1)
        last[0] = START
        together, trie = self.together, self.trie
        for j in range(n):
            a = last[j]
            if a == NOTHING:
                return [0, *(self._library(part[:i]) for i in range(1, n + 1))]
            node, k, base = trie, j, counts[j] + 1
            while k < n:
                node = node.get(part[k])
                if node is None:
                    break
                k += 1
                b = node.get(PIECE)
                if b is None or last[k] != NOTHING:
                    continue
                at = a * size + b
                fits = together.get(at)
                if fits is None:
                    if len(together) > PAIRS:
                        together.clear()
                    fits = together[at] = self._stand(START if a == UNKNOWN else a, b)
                if fits:
                    counts[k], last[k] = base, b
            if last[j + 1] == NOTHING and part[j] not in self.place:
                counts[j + 1], last[j + 1] = base - 1 + len(part[j].encode()), UNKNOWN
        if last[n] == NOTHING:
            return [0, *(self._library(part[:i]) for i in range(1, n + 1))]
        return counts

    def _library(self, part: str) -> int:
        """The library's count of a part, set apart from the mark that it puts in front."""
        if self.prefix and part[0] == MARK:
            return len(self.library.encode(part[1:])) if len(part) > 1 else 1
        front = "\n" if "\n" in self.lone else ""
        return len(self.library.encode(front + part)) - (len(self.library.encode(front)) if front else 0)

    def _part(self, part: str) -> bytes | list[int]:
        """The counts at every prefix of a part: bytes for a short one, which is remembered."""
        counts = self.known.get(part)
        if counts is None:
            counts = self._count(part)
            if counts[-1] < 256 and len(part) < 256:
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                counts = self.known[part] = bytes(counts)
        return counts

    def _parts(self, text: str) -> list[str]:
        marked = text.replace(" ", MARK)
        return self.part.findall(MARK + marked if self.prefix else marked)

    def total(self, text: str) -> int:
        if not text:
            return 0
        words = words_of(text) if self.quick else None
        if words is not None:
            return sum(map(self.totals.__getitem__, words))
        return sum(self._part(p)[-1] for p in self._parts(text))

    def _word(self, word: str) -> int:
        """The count of a word that ``words_of`` gave."""
        parts = self.part.findall(word if word[:1] == "\n" else MARK + word)
        return sum(self._count(p)[-1] for p in parts)

    def prefixes(self, text: str) -> np.ndarray:
        """``counts[i]``: tokens of the first ``i`` characters; as long as the text and one more."""
        if not text:
            return np.zeros(1, np.int32)
        found = [self._part(p) for p in self._parts(text)]
        before = np.cumsum([0, *(c[-1] for c in found)])
        whole = np.concatenate([np.array(list(c[1:]), np.int64) + b for c, b in zip(found, before, strict=False)])
        counts = np.concatenate([[0], whole[1 if self.prefix else 0 :]])
        return counts.astype(np.int32)


@lru_cache(maxsize=2)
def counter(model: str) -> PrefixCounter:
    return PrefixCounter(model)


def count_tokens(docs: DataFrame, model: str, budget: int = 4096, store: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_bytes``, ``n_tokens`` and ``fits`` (characters of the longest prefix within ``budget``) of every row.

    ``store`` adds ``prefix_counts``, from which ``tokens_upto`` and ``cut_at`` answer
    any other question.  A null text counts as empty: no bytes, no tokens.
    Repeated rows are counted each; other columns are not read; an empty table
    gives an empty result.
    """
    kinds = "id long, n_bytes long, n_tokens long, fits long" + (", prefix_counts array<int>" if store else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for batch in batches:
            for rows in _bounded(batch):
                texts = [t or "" for t in rows.column(1).to_pylist()]
                stored = [count.prefixes(t) for t in texts] if store else None
                totals = [int(c[-1]) for c in stored] if store else [count.total(t) for t in texts]
                fits = [len(t) if n <= budget else int(np.flatnonzero(count.prefixes(t) <= budget)[-1]) for t, n in zip(texts, totals, strict=True)]
                columns = [rows.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(totals, pa.int64()), pa.array(fits, pa.int64())]
                names = ["id", "n_bytes", "n_tokens", "fits"]
                if store:
                    columns, names = [*columns, pa.array([c.tolist() for c in stored], pa.list_(pa.int32()))], [*names, "prefix_counts"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, kinds)


def _bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHARS_AT_ONCE characters of its second column, a longer text alone."""
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = int(sizes[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + CHARS_AT_ONCE, "right")))
        yield batch.slice(at, to - at)
        at = to


def tokens_upto(n_chars: Column, prefix_counts: str = "prefix_counts") -> Column:
    """Column: tokens of the first ``n_chars`` characters, from the stored counts."""
    return F.element_at(F.col(prefix_counts), (F.least(n_chars, F.size(prefix_counts) - 1) + 1).cast("int"))


def cut_at(budget: int, prefix_counts: str = "prefix_counts") -> Column:
    """Column: characters of the longest prefix with at most ``budget`` tokens, from the stored counts."""
    counts = F.col(prefix_counts)
    return F.array_max(F.transform(counts, lambda c, i: F.when(c <= budget, i)))
