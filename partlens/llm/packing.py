"""Packing token sequences: best-fit decreasing over a segment tree of remaining capacities.

A document's ids are cut into full windows as long as they fill one; these are
sequences of their own.  What is left of each document is dealt into shares of a
bounded number of pieces, and in a share the longest piece goes first, each into
the open window with the least room that still takes it.  A segment tree over
capacities finds that window in as many steps as the capacity has binary digits.

Only numbers are shuffled: where a piece starts, how long it is, and the checksum of
its ids, which is taken where the text is read.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlens.llm.common import written
from partlens.llm.token_counts import Remembered

#: Tokens of a sequence, the id that ends a document, and pieces packed together by one task.
CAPACITY, END, SHARE_PIECES = 2_048, 1, 32_768
#: Characters that are told apart without the library: Latin letters, and the marks and spaces of general punctuation.
PLAIN = [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x2060), 0x20AC]
#: Characters of a text that are encoded at a time, distinct words remembered, and pieces handed on at once.
CHARS_AT_ONCE, REMEMBERED, ROWS_AT_ONCE = 1_000_000, 500_000, 8_192
#: Fixed value: the white space of Unicode.
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _class(codes: Iterable[int]) -> str:
    """The inside of a character class, as ranges."""
    codes = sorted(codes)
    starts = [i for i, c in enumerate(codes) if not i or c != codes[i - 1] + 1]
    return "".join(f"\\U{codes[a]:08x}-\\U{codes[b - 1]:08x}" for a, b in zip(starts, [*starts[1:], len(codes)], strict=True))


class ByteCodec:
    """Ids of whole texts, as the library's byte-level vocabulary gives them without begin or end tokens.

    The library encodes each distinct word once.  Words are told apart as it does it:
    contractions, letters, digits or other marks with one space in front, and runs
    of white space.  A text with characters beyond PLAIN, or with the string of a
    special token, is left to the library as it stands.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        letters, digits = (_class(c for c in PLAIN if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
        blank = _class(SPACES)
        self.word = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+| ?[^{blank}{letters}{digits}]+|[{blank}]+(?![^{blank}])|[{blank}]+")
        special = "|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values())
        self.beyond = re.compile(f"[^{_class(PLAIN)}]" + (f"|{special}" if special else ""))
        # A single space between two words never lies inside one.
        self.between = re.compile(r"(?<=\S) (?=\S)")
        self.words = Remembered(self._library, REMEMBERED)

    def _library(self, text: str) -> bytes:
        ids = array("I", self.library.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def ids(self, text: str) -> Iterator[bytes]:
        """The ids as little-endian 32-bit numbers, for one slice of the text after another."""
        at = 0
        while at < len(text):
            found = self.between.search(text, at + CHARS_AT_ONCE)
            to = found.start() if found else len(text)
            part = text[at:to]
            yield self._library(part) if self.beyond.search(part) else b"".join(map(self.words.__getitem__, self.word.findall(part)))
            at = to


@lru_cache(maxsize=2)
def codec(path: str) -> ByteCodec:
    return ByteCodec(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``turn`` (and ``ids``, 32-bit numbers as bytes) of every document's windows and its rest.

    ``turn`` numbers the rows of a task; it holds once the rows are written.
    """
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, turn long" + (", ids binary" if with_ids else "")
    width = 4 * capacity

    def cut(codec: ByteCodec, text: str) -> tuple[list[int], list[int], list[bytes]]:
        lengths, sums, kept, held = [], [], [], b""

        def put(piece: bytes) -> None:
            lengths.append(len(piece) // 4)
            sums.append(zlib.crc32(piece))
            if with_ids:
                kept.append(piece)

        for part in codec.ids(text):
            held += part
            full = len(held) - len(held) % width
            for i in range(0, full, width):
                put(held[i : i + width])
            held = held[full:]
        put(held + np.array([END], "<u4").tobytes())
        return lengths, sums, kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        turn = TaskContext.get().partitionId() << 33
        rows: list[list] = [[] for _ in range(7)]

        def told() -> pa.RecordBatch:
            nonlocal rows
            columns = [pa.array(r, pa.int64()) for r in rows[:6]] + ([pa.array(rows[6], pa.binary())] if with_ids else [])
            rows = [[] for _ in range(7)]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "turn", "ids"][: len(columns)])

        for batch in batches:
            for at in range(batch.num_rows):
                id_, text = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                lengths, sums, kept = cut(own, text or "")
                n, total = len(lengths), sum(lengths)
                for column, values in zip(rows, ([id_] * n, range(0, n * capacity, capacity), lengths, sums, [total] * n, range(turn, turn + n), kept), strict=True):
                    column.extend(values)
                turn += n
                if len(rows[0]) >= ROWS_AT_ONCE:
                    yield told()
        yield told()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, kinds)


class Capacities:
    """A segment tree over 0..most: which remaining capacities some open window has, and the windows of each."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.open = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = room + self.size
        while node:
            self.open[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int]:
        """The least room of ``need`` or more and a window that has it, which is no longer open; (-1, -1) if there is none."""
        node = need + self.size
        while not self.open[node]:
            # Up until a right neighbour has an open window; past the last one there is none.
            while node & 1:
                node >>= 1
            if not node:
                return -1, -1
            node += 1
        while node < self.size:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            self.open[node] -= 1
            node >>= 1
        return room, self.windows[room].pop()


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """The window and the place in it of each piece; ``lengths`` fall."""
    tree, windows, offsets, made = Capacities(capacity), [], [], 0
    for length in lengths:
        room, window = tree.take(length)
        if window < 0:
            room, window, made = capacity, made, made + 1
        windows.append(window)
        offsets.append(capacity - room)
        if room > length:
            tree.add(room - length, window)
    return windows, offsets


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, share_pieces: int = SHARE_PIECES, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: every id of every document, END after each, in sequences of at most ``capacity``.

    ``with_ids`` adds the ids themselves.  A null text is empty and still ends with
    END; null ids stay null; repeated rows are packed each; other columns are not read;
    an empty table gives an empty result.
    """
    made = written(pieces(docs, tokenizer, capacity, with_ids, id_col, text_col), "pieces")
    shares = max(1, -(-made.count() // share_pieces))
    names = [c for c in made.columns if c != "turn"]
    kinds = ", ".join(f"{c} {dict(made.dtypes)[c].replace('bigint', 'long')}" for c in names) + ", sequence_id long, offset long"

    def placed(share: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lengths = rows.column("length").to_numpy()
        order = np.lexsort([rows.column("turn").to_numpy(), -lengths])
        windows, offsets = best_fit(lengths[order].tolist(), capacity)
        out = rows.select(names).take(pa.array(order))
        out = out.append_column("sequence_id", pa.array(np.array(windows, np.int64) + (share << 32))).append_column("offset", pa.array(offsets, pa.int64()))
        yield from out.to_batches(max_chunksize=ROWS_AT_ONCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, share = [], -1
        for batch in batches:
            own = batch.column("share").to_numpy()
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    if held and own[a] != share:
                        yield from placed(share, pa.Table.from_batches(held))
                        held = []
                    share = int(own[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield from placed(share, pa.Table.from_batches(held))

    dealt = made.withColumn("share", F.pmod(F.xxhash64("turn"), F.lit(shares)))
    return dealt.repartition(min(shares, 100_000), "share").sortWithinPartitions("share").mapInArrow(run, kinds)
