"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, so neighbours share long bit patterns.
Each node of the index holds the bits all its members share (mask and pattern);
what a node shares beyond its parent is compared once, the differences add up on
the way down, and a whole group falls away as soon as the sum passes the limit.

On the cluster the distinct fingerprints are dealt by blocks of bits: two that
differ in ``d`` bits agree in one of ``d + 1`` blocks, so each pair meets in some
task.  A block value too common for one task is dealt again by blocks of the bits
left; after four dealings a group has at most 2^20 distinct members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlens.llm.common import components, forest, row_key
from partlens.session import cut_lineage

SHINGLES_AT_ONCE = 65_536
LEAF, FAN = 8, 8
#: Rows whose whole groups share an index, and (query, node) pairs that are weighed at a time.
CHUNK_ROWS, PAIRS_AT_ONCE = 4_096, 1 << 22
#: Blocks of bits by which fingerprints are dealt, and dealt again where a group is larger than GROUP_ROWS.
DEALINGS = 4
GROUP_ROWS = 20_000


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles as an unsigned number; zero for a text without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < size:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[size - 1 :] - 1).tolist()
    n = len(stops)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = range(at, min(n, at + SHINGLES_AT_ONCE))
        h = np.fromiter((xxhash.xxh64_intdigest(line[starts[i] : stops[i]], seed) for i in part), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order (the inverse of the reflected Gray code)."""
    rank = codes.copy()
    for by in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(by)
    return rank


class GrayIndex:
    """Distinct fingerprints in Gray order under nodes of shared bits."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        all_of, any_of, fan = self.codes, self.codes, LEAF
        while True:
            cuts = np.arange(0, all_of.size, fan)
            all_of, any_of = np.bitwise_and.reduceat(all_of, cuts), np.bitwise_or.reduceat(any_of, cuts)
            mask = ~(all_of ^ any_of)
            self.levels.append((mask, all_of & mask))
            if all_of.size <= FAN:
                break
            fan = FAN
        self.levels.reverse()

    def pairs(self, first: int, last: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (query, member) with at most ``limit`` differing bits, for the queries first..last-1, query < member."""
        q = np.arange(first, last)
        mask, pattern = self.levels[0]
        who, node = np.repeat(q, mask.size), np.tile(np.arange(mask.size), q.size)
        diff = np.bitwise_count((self.codes[who] ^ pattern[node]) & mask[node])
        below = LEAF * FAN ** (len(self.levels) - 1)
        for depth in range(len(self.levels)):
            live = (diff <= limit) & ((node + 1) * below > who + 1)
            who, node, diff = who[live], node[live], diff[live]
            if depth + 1 == len(self.levels):
                break
            deeper, more = self.levels[depth + 1]
            child = (node[:, None] * FAN + np.arange(FAN)).ravel()
            there = child < deeper.size
            child, parent = child[there], np.repeat(node, FAN)[there]
            who, diff = np.repeat(who, FAN)[there], np.repeat(diff, FAN)[there]
            new = deeper[child] & ~mask[parent]
            diff = diff + np.bitwise_count((self.codes[who] ^ more[child]) & new)
            node, mask, below = child, deeper, below // FAN
        member = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
        who = np.repeat(who, LEAF)
        there = (member < self.codes.size) & (member > who)
        who, member = who[there], member[there]
        near = np.bitwise_count(self.codes[who] ^ self.codes[member]) <= limit
        return who[near], member[near]

    def forest(self, limit: int) -> np.ndarray:
        """The smallest place of each fingerprint's component within this index."""
        label = np.arange(self.codes.size)
        at_once = max(16, PAIRS_AT_ONCE // self.codes.size)
        for first in range(0, self.codes.size, at_once):
            a, b = self.pairs(first, min(self.codes.size, first + at_once), limit)
            apart = label[a] != label[b]
            if apart.any():
                label = forest(label.size, np.concatenate([label[a[apart]], np.arange(label.size)]), np.concatenate([label[b[apart]], label]))
        return label


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: tuple[str, ...] = ("text",)) -> DataFrame:
    """``id``, ``key`` (of the columns ``key``) and ``code`` (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.int64())], names=["id", "key", "code"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(*key).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, key long, code long")


def _blocks(free: list[int], parts: int) -> list[list[int]]:
    """The given bits in ``parts`` runs of nearly equal length."""
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [free[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(bits: list[int]) -> int:
    mask = sum(1 << bit for bit in bits)
    return mask - (1 << 64) * (mask >= 1 << 63)


def dealt(codes: DataFrame, limit: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``code`` and the ``group`` it is compared in, once for each block; groups too large are dealt again.

    A group is a hash of the block values it came by: two groups that fall
    together are compared in one task, which costs time and changes no result.
    """
    free_of: dict[int, list[int]] = {0: list(range(64))}
    rows, done = codes.select("code", F.lit(0).alias("way"), F.lit(0).cast("long").alias("group")), []
    for dealing in range(DEALINGS):
        deal, deeper = F.lit(None), {}
        for way, free in free_of.items():
            made = []
            for block in _blocks(free, limit + 1):
                to = len(deeper)
                deeper[to] = [bit for bit in free if bit not in block]
                value = F.col("code").bitwiseAND(F.lit(_signed(block)))
                made.append(F.struct(F.lit(to).alias("way"), F.xxhash64("group", F.lit(to), value).alias("group")))
            deal = F.when(F.col("way") == way, F.array(*made)).otherwise(deal)
        rows, free_of = rows.select("code", F.explode(deal).alias("g")).select("code", "g.way", "g.group"), deeper
        if dealing + 1 < DEALINGS:
            large = cut_lineage(rows.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > group_rows).select("group"))
            if not large.isEmpty():
                done.append(rows.join(large, "group", "left_anti"))
                rows = rows.join(large, "group", "left_semi")
                continue
        done.append(rows)
        break
    return reduce(DataFrame.unionByName, done).select("code", "group")


def links(codes: DataFrame, limit: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links ``a``, ``b`` that join distinct ``code``s just as all pairs within ``limit`` bits would (a forest per task, never all pairs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _whole_groups(batches):
            index = GrayIndex(np.unique(chunk).view(np.uint64))
            root = index.codes[index.forest(limit)]
            apart = root != index.codes
            yield pa.RecordBatch.from_arrays([pa.array(index.codes[apart].view(np.int64)), pa.array(root[apart].view(np.int64))], names=["a", "b"])

    groups = dealt(codes, limit, group_rows)
    alone = groups.repartition("group").sortWithinPartitions("group")
    return alone.mapInArrow(run, "a long, b long").distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The codes of a task's rows, sorted by group, in chunks that cut no group."""
    code, group = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        code = np.concatenate([code, batch.column(0).to_numpy()])
        group = np.concatenate([group, batch.column(1).to_numpy()])
        if code.size >= CHUNK_ROWS and group[-1] != group[0]:
            cut = np.searchsorted(group, group[-1])
            ends = np.flatnonzero(np.diff(group[:cut])) + 1
            yield from _cut(code[:cut], ends)
            code, group = code[cut:], group[cut:]
    if code.size:
        yield from _cut(code, np.flatnonzero(np.diff(group)) + 1)


def _cut(code: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    while at < code.size:
        k = np.searchsorted(ends, at + CHUNK_ROWS)
        to = int(ends[k]) if k < ends.size else code.size
        yield code[at:to]
        at = to


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: tuple[str, ...] = ("text",), limit: int = 3, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """``id``, ``key``, ``fingerprint`` (16 hex digits), ``component`` (smallest id reachable), ``root`` (smallest code reachable) for every row of ``docs``.

    Null and blank texts have fingerprint zero and are linked like any other; a
    row counts as often as it stands in the table; a component whose ids are all
    null has a null ``component``, and two components may have the same smallest id,
    so groups are told apart by ``root``; other columns are not read; an empty table
    gives an empty result.
    """
    prints = cut_lineage(with_fingerprints(docs, id_col, text_col, key))
    codes = cut_lineage(prints.groupBy("code").agg(F.min("id").alias("first")))
    roots = components(links(codes, limit, group_rows))
    named = codes.join(roots, codes["code"] == roots["node"], "left").select("code", "first", F.coalesce("root", "code").alias("root"))
    named = cut_lineage(named)
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    of_code = named.join(least, "root").select(F.col("code").alias("c"), "component", "root")
    return prints.join(of_code, prints["code"] == of_code["c"]).select(
        "id", "key", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component", "root"
    )
