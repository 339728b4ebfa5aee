"""Removal of long repeats by suffix arrays built in two stages.

Every 200-byte string holds a smallest 32-byte gram (by hash, the leftmost of
equals): its anchor.  Equal strings have equal anchors, so each text is described
by its anchors and, for each, the run of string starts it stands for (about one row
for 85 bytes).  Anchors met once fall away.  Of the others, stretches that are equal
as a whole repeat as a whole; the distinct rest of each anchor meets in one task,
where a suffix array of the stretches and the common prefixes of neighbours tell
which 200-byte strings occur twice.

An anchor with too many distinct stretches for a task (a passage that a third of all
texts share) is dealt again: the starts are taken in runs of 16, and then singly,
and the bytes that all strings of a run share become part of the key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from partlens.llm.common import free_names, marked, once, place_of, plain_names, whole_groups, written
from partlens.session import cut_lineage

LENGTH = 200
GRAM = 32
#: Starts of strings that are looked at together; their place fits the low bits of a hash.
PLACE_BITS = 19
PIECE = (1 << PLACE_BITS) - 1024
#: Distinct stretches of an anchor that one task takes, bytes that share a suffix array, and the runs of starts dealt again.
MOST_STRETCHES = 2_000
BYTES_AT_ONCE = 400_000
STEPS = (16, 1)
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash's base and of its inverse, modulo 2^64."""
    n = PIECE + LENGTH + 1
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For each run of starts with one anchor: hash of the anchor, hash of the stretch, first and last start, the anchor's place."""
    found = []
    for at in range(0, len(data) - length + 1, PIECE):
        found.append(_anchors(data[at : at + PIECE + length - 1], at, length, gram))
    if not found:
        return (np.empty(0, np.int64), np.empty(0, np.int64), *(np.empty(0, np.int64) for _ in range(3)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(data: bytes, at: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    up, down = _powers()
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    grams = _mixed((sums[gram:] - sums[: n - gram + 1]) * down[: n - gram + 1])
    width = length - gram + 1
    place = np.arange(grams.size, dtype=np.uint64)
    keys = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | place
    # The least of every run of `width` keys, from running minima of blocks forwards and backwards.
    blocks = -(-keys.size // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[: keys.size] = keys
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(back[:starts], ahead[width - 1 : width - 1 + starts])
    spot = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(spot[1:] != spot[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [starts - 1]])
    anchor = spot[first]
    stretch = _mixed((sums[last + length] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    return grams[anchor].view(np.int64), stretch.view(np.int64), first + at, last + at, anchor + at


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Starts of all suffixes of ``text`` (uint8) in order of their first ``depth`` bytes or more.

    Suffixes smaller than their successor are sorted directly.  Each other one is
    its first byte before a smaller suffix, so a scan of the buckets by first byte
    meets them in order: a bucket's larger ones come first, put there by the scan of
    smaller buckets and of itself, then its sorted ones.
    """
    n = text.size
    if n == 0:
        return np.empty(0, np.int64)
    falls = np.zeros(n, bool)
    falls[n - 1] = True
    change = np.flatnonzero(text[1:] != text[:-1])
    if change.size:
        # Equal bytes are decided by the next change; the end of the text is smaller than anything.
        falls[: change[-1] + 1] = np.repeat(text[change] > text[change + 1], np.diff(np.concatenate([[-1], change])))
        falls[change[-1] + 1 :] = True
    else:
        falls[:] = True
    small = np.flatnonzero(~falls)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[small]
    small = small[np.argsort(rows.view(f"S{depth}").ravel(), kind="stable")]
    of_small = np.searchsorted(text[small], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))
    done = []

    def induce(places: np.ndarray, least: int) -> np.ndarray:
        """Puts the larger predecessors of ``places`` into their buckets; returns those of this bucket itself."""
        before = places[places > 0] - 1
        before = before[falls[before]]
        byte = text[before]
        further = byte > least
        by = np.argsort(byte[further], kind="stable")
        ordered, values = before[further][by], byte[further][by]
        cuts = np.flatnonzero(np.diff(values)) + 1
        for part in np.split(ordered, cuts) if ordered.size else ():
            waiting[text[part[0]]].append(part)
        return before[byte == least]

    for byte in range(256):
        made = waiting[byte]
        i = 0
        while i < len(made):
            # Runs of one byte put their own predecessors behind them, round by round.
            if made[i].size:
                done.append(made[i])
                made.append(induce(made[i], byte))
            i += 1
        own = small[of_small[byte] : of_small[byte + 1]]
        if own.size:
            done.append(own)
            induce(own, byte)
    return np.concatenate(done)


def repeated_starts(stretches: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each stretch, whether the ``length`` bytes from each start also stand at another start, here or in another stretch."""
    text = np.frombuffer(b"".join(stretches), np.uint8)
    sizes = np.array([len(s) for s in stretches])
    ends = np.cumsum(sizes)
    counted = np.ones(text.size, bool)
    for back in range(1, length):
        counted[np.maximum(ends - back, ends - sizes)] = False
    order = suffix_array(text, length)
    order = order[counted[order]]
    rows = np.lib.stride_tricks.sliding_window_view(text, length)
    twice = np.zeros(text.size, bool)
    for at in range(0, order.size - 1, 1 << 16):
        here, after = order[at : at + (1 << 16)], order[at + 1 : at + (1 << 16) + 1]
        here = here[: after.size]
        # A common prefix of the whole length; the last bytes are compared first, as most neighbours differ there.
        near = np.flatnonzero((text[here + length - 1] == text[after + length - 1]) & (text[here + length // 2] == text[after + length // 2]))
        near = near[(rows[here[near]] == rows[after[near]]).all(1)]
        twice[here[near]] = True
        twice[after[near]] = True
    return np.split(twice, ends[:-1])


def _names(id_col: str, text_col: str) -> tuple[Column, Column]:
    """An id and a key without nulls that name a row by its id and text."""
    id_, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return F.coalesce(id_, F.lit(0)), F.xxhash64(text, text.isNull(), id_.isNull())


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    id_, key = _names(id_col, text_col)
    return docs.select(id_.alias("id"), key.alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _all_anchors(rows: DataFrame) -> DataFrame:
    """``g`` (anchor), ``c`` (stretch), ``id``, ``key``, ``lo``, ``hi``, ``a`` for each run of starts of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [anchors(t.encode()) for t in part.column(2).to_pylist()]
                row = pa.array(np.repeat(np.arange(len(found)), [f[0].size for f in found]))
                values = [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([values[0], values[1], part.column(0).take(row), part.column(1).take(row), *values[2:]], names=["g", "c", "id", "key", "lo", "hi", "a"])

    return rows.mapInArrow(run, "g long, c long, id long, key long, lo long, hi long, a long")


def _with_ranges(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``text`` and the ``wanted`` ranges of each named text, once."""
    ranges = wanted.groupBy(F.col("o.id").alias("rid"), F.col("o.key").alias("rkey")).agg(F.collect_list(F.struct("g", "n", "o.lo", "o.hi", "o.a")).alias("ranges"))
    rows = marked(rows, wanted.select("o.id", "o.key")).where("__maybe")
    met = rows.join(ranges, (F.col("id") == F.col("rid")) & (F.col("key") == F.col("rkey")))
    return once(met, "id", "key").select("id", "key", "text", "ranges")


def _matches(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id``, ``key``, ``lo``, ``hi`` (bytes lo..hi-1) that suffix arrays of the wanted stretches find repeated."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, ranges = batch.column(2)[i].as_py().encode(), batch.column(3)[i].as_py()
                yield pa.RecordBatch.from_pylist(
                    [{"g": r["g"], "n": r["n"], "id": batch.column(0)[i].as_py(), "key": batch.column(1)[i].as_py(), "lo": r["lo"], "part": data[r["lo"] : r["hi"] + LENGTH]} for r in ranges],
                    schema=pa.schema([("g", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("lo", pa.int64()), ("part", pa.binary())]),
                )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 0, lambda b: np.array([len(p) for p in b.column(5).to_pylist()]), BYTES_AT_ONCE):
            out: tuple[list, ...] = ([], [], [], [])
            flags = repeated_starts(batch.column(5).to_pylist())
            for i, (n, id_, key, lo) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True)):
                if n > 1 or not flags[i].any():
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[False], flags[i], [False]]).astype(np.int8)))
                for first, end in zip(edge[::2], edge[1::2], strict=True):
                    for column, value in zip(out, (id_, key, lo + int(first), lo + int(end) - 1 + LENGTH), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["id", "key", "lo", "hi"])

    parts = _with_ranges(rows, wanted).mapInArrow(cut, "g long, n long, id long, key long, lo long, part binary")
    return parts.repartition("g").sortWithinPartitions("g").mapInArrow(sort, "id long, key long, lo long, hi long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _dealt_again(rows: DataFrame, wanted: DataFrame, step: int) -> DataFrame:
    """The wanted stretches as runs of ``step`` starts, counted from the anchor; what all strings of a run share joins the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, ranges, made = batch.column(2)[i].as_py().encode(), batch.column(3)[i].as_py(), []
                for r in ranges:
                    a = r["a"]
                    for k in range((a - r["hi"]) // step, (a - r["lo"]) // step + 1):
                        first, last = a - (k + 1) * step + 1, a - k * step
                        lo, hi = max(r["lo"], first), min(r["hi"], last)
                        group = xxhash.xxh64_intdigest(data[last : first + LENGTH] + b"%d,%d" % (r["g"], k), step)
                        made.append({"g": _signed(group), "c": _signed(xxhash.xxh64_intdigest(data[lo : hi + LENGTH])), "lo": lo, "hi": hi, "a": a})
                table = pa.RecordBatch.from_pylist(made, schema=pa.schema([(c, pa.int64()) for c in ("g", "c", "lo", "hi", "a")]))
                same = pa.array(np.zeros(len(made), np.int64))
                at = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [table.column(0), table.column(1), at.column(0).take(same), at.column(1).take(same), table.column(2), table.column(3), table.column(4)],
                    names=["g", "c", "id", "key", "lo", "hi", "a"],
                )

    return _with_ranges(rows, wanted).mapInArrow(run, "g long, c long, id long, key long, lo long, hi long, a long")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_STRETCHES) -> DataFrame:
    """``id``, ``key`` (see ``_names``), ``lo``, ``hi``: ranges of bytes (hi not included) that together are all bytes to remove; they may overlap."""
    rows = _named(docs, id_col, text_col)
    found, places = [], written(_all_anchors(rows), "anchors")
    for step in (*STEPS, None):
        # Tables that hot anchors are joined with are cut off first, so that the join's shuffles can be split where one is hot.
        shared = cut_lineage(places.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"))
        places = written(places.join(shared, "g", "left_semi"), "shared")
        kinds = places.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("id", "key", "lo", "hi", "a")).alias("o"))
        kinds = cut_lineage(kinds)
        groups = kinds.groupBy("g").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1")
        again = kinds.where("n > 1").select("g", "c")
        found.append(places.join(again, ["g", "c"], "left_semi").select("id", "key", "lo", (F.col("hi") + LENGTH).alias("hi")))
        mixed = kinds.join(cut_lineage(groups), "g")
        found.append(_matches(rows, mixed.where(F.col("kinds") <= most)))
        large = mixed.where(F.col("kinds") > most)
        if step is None or large.isEmpty():
            break
        places = written(_dealt_again(rows, large, step), "anchors")
    made = found[0]
    for part in found[1:]:
        made = made.unionByName(part)
    return made


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_STRETCHES) -> DataFrame:
    """The rows and columns of ``docs`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept_text`` behind them.

    ``kept_text`` is what is left as characters: one that lost a byte is gone.  A
    text shorter than 200 bytes, empty or null loses nothing (null: no bytes,
    ``kept_text`` null); rows that repeat a text each lose all that another row
    has, and of equal texts every one; an empty table gives an empty result; other
    columns are handed on, whatever their names: a new column whose name is taken,
    in any case, gets underscores behind it.
    """
    plain, id_at, text_at = plain_names(docs), place_of(docs, id_col), place_of(docs, text_col)
    columns = plain.columns
    found = cut_lineage(repeats(plain, id_at, text_at, most).distinct())
    spans = found.groupBy(F.col("id").alias("__sid"), F.col("key").alias("__skey")).agg(F.collect_list(F.struct("lo", "hi")).alias("__spans"))
    id_, key = _names(id_at, text_at)
    rows = marked(plain.withColumns({"__id": id_, "__key": key, "__text": F.col(text_at).cast("string")}), found.select(F.col("id").alias("__id"), F.col("key").alias("__key")), ("__id", "__key"))
    met = rows.where("__maybe").join(spans, (F.col("__id") == F.col("__sid")) & (F.col("__key") == F.col("__skey")), "left")
    met = met.select(*columns, "__text", "__spans")
    whole = rows.where("not __maybe").select(*columns, "__text", F.lit(None).cast(met.schema["__spans"].dataType).alias("__spans"))
    met = met.unionByName(whole)
    made = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans_of = batch.column(len(columns)), batch.column(len(columns) + 1)
            found = [_cut(texts[i].as_py(), spans_of[i]) for i in range(batch.num_rows)]
            new = [pa.array([f[k] for f in found], kind) for k, (_, kind) in enumerate(made)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *new], names=[*columns, *[name for name, _ in made]])

    kinds = StructType([*plain.schema.fields, *[StructField(n, StringType() if k == pa.string() else LongType()) for n, k in made]])
    return met.mapInArrow(run, kinds).toDF(*docs.columns, *free_names([name for name, _ in made], docs.columns))


def _cut(text: str | None, spans: pa.ListScalar) -> tuple[int, int, int, str, str | None]:
    data = (text or "").encode()
    if not spans.is_valid or not len(spans.values):
        return len(data), 0, 0, hashlib.sha256(data).hexdigest(), text
    lo, hi = (spans.values.field(k).to_numpy() for k in (0, 1))
    delta = np.zeros(len(data) + 1, np.int64)
    np.add.at(delta, lo, 1)
    np.add.at(delta, hi, -1)
    gone = np.cumsum(delta[:-1]) > 0
    bytes_ = np.frombuffer(data, np.uint8)
    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    digest = hashlib.sha256(bytes_[~gone].tobytes()).hexdigest()
    char = np.cumsum((bytes_ & 0xC0) != 0x80) - 1
    lost = np.zeros(char[-1] + 1, bool)
    lost[char[gone]] = True
    return len(data), int(gone.sum()), runs, digest, bytes_[~lost[char]].tobytes().decode()
