"""Groups of texts that share most of their word shingles: SimHash neighbours first, then an exact set join.

Texts with the same set of shingles are one node.  First pass: each node has a
64-bit SimHash over its distinct shingles; codes that the Gray-order index of
``simhash`` links, and codes that stand next to each other in Gray order under some
rotations of the bits, are weighed by the exact Jaccard of the sets.  So a large
group of copies is one component before anything is compared in it.

Second pass, exact for a Jaccard of SIMILAR: two sets that are so alike share a
shingle among the first fifth (and one more) of each, under any one order of all
shingles.  The order is by how often a shingle occurs, rarest first, as a count
sketch of a fixed size tells it; what a sketch gets wrong changes the work and never
the result.  Texts that share a frequent passage do not meet on it.  Nodes that meet,
have different roots, and could reach the Jaccard by their sizes, by what is left
of each set behind the shingle, and by the parities of their sets, are weighed: the
nearest ones of each node first, then all that have different roots even so.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.llm import simhash
from partlens.llm.common import _names, components, marked, once, row_key, whole_groups, written
from partlens.session import cut_lineage

#: Words of a shingle, and the similarity of texts of one group (as a fraction).
SHINGLE, SIMILAR = 5, (4, 5)
#: Differing bits that the index links, those of neighbours that are weighed, and the turns of the bits under which neighbours are looked for.
LINKED, LIMIT, TURNS = 3, 16, (0, 16, 32, 48)
#: Counters of the sketch, the parts it is added up in, and steps of a level for each doubling of a count.
SLOTS, PARTS, STEPS = 1 << 22, 64, 5
#: Shingles counted at once, rows of a task held together, and rows of a shingle that one task compares.
COUNTED, ROWS_AT_ONCE, GROUP_ROWS = 1 << 20, 1 << 16, 20_000
#: Nodes that share a shingle from which on it is dealt in blocks, and bits of the parities that all pairs must pass.
MANY, PARITIES = 64, 1_024
#: Pairs whose parities are compared at once.
PAIRS_AT_ONCE = 8_192
#: Nodes whose prefix a task remembers to have handed on.
SEEN = 200_000
SEED = 42


def _mixed(x: np.ndarray) -> np.ndarray:
    """The last step of SplitMix64: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a text of fewer words is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    made = np.full(n, min(size, len(words)), np.uint64)
    for k in range(min(size, len(words))):
        made = _mixed(made * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(made)


def node_of(found: np.ndarray) -> int:
    """The name of a set of shingles, as a signed number."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def code_of(found: np.ndarray) -> int:
    """The 64-bit SimHash of a set of shingles, as a signed number; zero for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, found.size, simhash.SHINGLES_AT_ONCE):
        ones += np.unpackbits(found[at : at + simhash.SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > found.size, bitorder="little").view(np.int64)[0])


def parities(found: np.ndarray) -> bytes:
    """PARITIES bits: whether an odd number of the set's shingles falls on each.  Two sets differ in as many shingles as bits or more."""
    odd = np.bincount((found >> np.uint64(40)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1
    return np.packbits(odd.astype(bool)).tobytes()


class Counts:
    """How often shingles occur, by hash in SLOTS counters: never too few, too many where others share the counter."""

    def __init__(self) -> None:
        self.counts, self.held, self.size = np.zeros(SLOTS, np.int64), [], 0

    def add(self, found: np.ndarray) -> None:
        self.held.append(found)
        self.size += found.size
        if self.size >= COUNTED:
            self._count()

    def _count(self) -> None:
        if self.held:
            self.counts += np.bincount(slots(np.concatenate(self.held)), minlength=SLOTS)
            self.held, self.size = [], 0

    def parts(self) -> Iterator[tuple[int, bytes]]:
        self._count()
        for i, part in enumerate(self.counts.reshape(PARTS, -1)):
            if part.any():
                yield i, zlib.compress(part.tobytes(), 1)


def slots(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(SLOTS - 1)).astype(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str, key: tuple[str, ...]) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), row_key(*key).alias("key"), F.col(text_col).cast("string").alias("text"))


def _noted(rows: DataFrame) -> DataFrame:
    """``id``, ``key``, ``node``, ``code`` of every row; and each task's counts, as rows with ``part`` and ``counts``."""
    names = ["id", "key", "node", "code", "part", "counts"]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            nodes, codes = [], []
            for text in batch.column(2):
                found = shingles(text.as_py())
                counts.add(found)
                nodes.append(node_of(found))
                codes.append(code_of(found))
            columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(codes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(batch.num_rows, k) for k in kinds[4:])], names=names)
        for part, told in counts.parts():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds[:4]), pa.array([part], pa.int32()), pa.array([told], pa.binary())], names=names)

    return rows.mapInArrow(run, "id long, key long, node long, code long, part int, counts binary")


def _levels(noted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The level of each counter (STEPS for each doubling), and whether its count is over MANY: SLOTS bytes and bits, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None

        def told() -> pa.RecordBatch:
            level = np.rint(STEPS * np.log2(1.0 + total)).clip(0, 255).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary()), pa.array([np.packbits(total > MANY).tobytes()], pa.binary())], names=["part", "level", "often"])

        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i != part:
                    if part is not None:
                        yield told()
                    part, total = i, np.zeros(SLOTS // PARTS, np.int64)
                total += np.frombuffer(zlib.decompress(counts.as_py()), np.int64)
        if part is not None:
            yield told()

    rows = noted.where("part is not null").select("part", "counts").repartition(PARTS, "part").sortWithinPartitions("part")
    level, often = np.zeros((PARTS, SLOTS // PARTS), np.uint8), np.zeros((PARTS, SLOTS // PARTS // 8), np.uint8)
    for r in rows.mapInArrow(run, "part int, level binary, often binary").collect():
        level[r.part], often[r.part] = np.frombuffer(r.level, np.uint8), np.frombuffer(r.often, np.uint8)
    return level.ravel(), np.unpackbits(often.ravel()).astype(bool)


def _turned(code: Column, by: int) -> Column:
    return code if not by else F.shiftleft(code, by).bitwiseOR(F.shiftrightunsigned(code, 64 - by))


def _gray(code: Column) -> Column:
    """The place of a code in Gray order."""
    for by in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, by))
    return code


def _neighbours(nodes: DataFrame) -> DataFrame:
    """``a``, ``b``: nodes that stand next to each other in Gray order, under one of TURNS of their bits, and differ in few bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            turn, code, node = (batch.column(i).to_numpy() for i in range(3))
            if last is not None:
                turn, code, node = (np.concatenate([x, y]) for x, y in zip(last, (turn, code, node), strict=True))
            last = turn[-1:], code[-1:], node[-1:]
            near = (np.bitwise_count((code[1:] ^ code[:-1]).view(np.uint64)) <= LIMIT) & (turn[1:] == turn[:-1])
            a, b = node[:-1][near], node[1:][near]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    turned = F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), _gray(_turned(F.col("code"), t)).alias("rank")) for t in TURNS]))
    rows = nodes.select("code", "node", turned.alias("t")).select("t.turn", "code", "node", "t.rank")
    # Many nodes may have the same code, so the node is part of the order that is dealt out.
    rows = rows.repartitionByRange("turn", "rank", "node").sortWithinPartitions("turn", "rank", "node").select("turn", "code", "node")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _linked(nodes: DataFrame) -> DataFrame:
    """``a``, ``b``: a node of each code and one of the code that the Gray-order index links it to."""
    codes = cut_lineage(nodes.groupBy("code").agg(F.min("node").alias("node")))
    links = simhash.links(codes.select("code"), LINKED)
    first = links.join(codes.select(F.col("code").alias("a"), F.col("node").alias("x")), "a")
    both = first.join(codes.select(F.col("code").alias("b"), F.col("node").alias("y")), "b")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def prefix_size(n: int) -> int:
    """How many of ``n`` ordered shingles are enough to meet every set of a Jaccard of SIMILAR."""
    part, whole = SIMILAR
    return n - -(-part * n // whole) + 1


def _prefixes(rows: DataFrame, level: np.ndarray, often: np.ndarray) -> DataFrame:
    """``node``, ``size``, ``first``: the rarest shingles (``often``: whether they may be in over MANY sets) and ``bits``, the parities, of each node."""
    spread = rows.sparkSession.sparkContext.broadcast((level, np.packbits(often)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, often = spread.value[0], np.unpackbits(spread.value[1]).astype(bool)
        seen: set[int] = set()
        for batch in batches:
            nodes, sizes, firsts, oftens, bits = [], [], [], [], []
            for text in batch.column(0):
                found = shingles(text.as_py())
                node = node_of(found)
                if not found.size or node in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(node)
                at = slots(found)
                rarest = np.argsort(level[at], kind="stable")[: prefix_size(found.size)]
                nodes.append(node)
                sizes.append(found.size)
                firsts.append(found[rarest].view(np.int64))
                oftens.append(often[at[rarest]])
                bits.append(parities(found))
            columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(oftens, pa.list_(pa.bool_())), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "first", "often", "bits"])

    found = rows.select("text").mapInArrow(run, "node long, size long, first array<long>, often array<boolean>, bits binary")
    return found.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "first", "often", "bits")])


def _fitting(group: np.ndarray, root: np.ndarray, size: np.ndarray, rest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of two rows of a group, by slices: of different roots, and similar as far as their sizes and what is left behind the shingle tell."""
    part, whole = SIMILAR
    place = np.arange(group.size)
    fresh = np.flatnonzero(group[1:] != group[:-1]) + 1
    end = np.append(fresh, group.size)[np.searchsorted(fresh, place, side="right")]
    # Rows of a group are sorted by root: those after the run of a row's own root have other ones.
    run_ends = np.flatnonzero((group[1:] != group[:-1]) | (root[1:] != root[:-1])) + 1
    other = np.append(run_ends, group.size)[np.searchsorted(run_ends, place, side="right")]
    while True:
        place, other, end = (x[other < end] for x in (place, other, end))
        if not place.size:
            return
        most = 1 + np.minimum(rest[place], rest[other])
        fit = (part + whole) * most >= part * (size[place] + size[other])
        yield place[fit], other[fit]
        other = other + 1


def _paired(cool: DataFrame) -> DataFrame:
    """The rows of ``cool`` (``group``, ``root``, ``node``, ``size``, ``rest``) that fit one of another root in their group; no group has over MANY.

    ``group`` is then a hash of the nodes that are left of the group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches, 0, lambda b: np.ones(b.num_rows, np.int64), ROWS_AT_ONCE):
            group, root, node, size, rest = (column.to_numpy() for column in chunk.columns)
            paired = np.zeros(group.size, bool)
            for place, other in _fitting(group, root, size, rest):
                paired[place] = paired[other] = True
            group, root, node, size, rest = (x[paired] for x in (group, root, node, size, rest))
            if group.size:
                starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                same = np.bitwise_xor.reduceat(_mixed(node.view(np.uint64)), starts).view(np.int64)
                group = np.repeat(same, np.diff(np.append(starts, group.size)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (group, root, node, size, rest)], names=["group", "root", "node", "size", "rest"])

    return cool.repartition("group").sortWithinPartitions("group", "root", "node").mapInArrow(run, "group long, root long, node long, size long, rest long")


def _shared(rooted: DataFrame) -> DataFrame:
    """``node``, ``group``, ``n``, ``size``, ``rest``: the nodes that share a shingle of their prefixes with one of another root; ``n`` is about a group's size, if large.

    Nodes that share many shingles stand in one group for all those that the same nodes
    share, with the most that is left of each set behind any of them; should two groups
    have one hash, more nodes meet.
    """
    rows = rooted.select("node", "root", "size", F.posexplode(F.arrays_zip("first", "often")).alias("at", "s"))
    rows = rows.select(F.col("s.first").alias("group"), "root", "node", "size", (F.col("size") - 1 - F.col("at")).alias("rest"), F.col("s.often").alias("often"))
    # Exact counts of those that may be in many sets; the sketch only tells which to count.
    many = rows.where("often").groupBy("group").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("same")).where(F.col("n") > MANY)
    watched = rows.where("often").join(cut_lineage(many), "group", "left")
    cool = rows.where("not often").unionByName(watched.where("n is null").drop("n", "same")).drop("often")
    hot = watched.where("n is not null").select(F.col("same").alias("group"), "root", "node", "size", "rest", "n")
    both = _paired(cool).withColumn("n", F.lit(1).cast("long")).unionByName(hot)
    return cut_lineage(both.repartition("node").groupBy("node", "group", "n", "size").agg(F.max("rest").alias("rest")))


def _meeting(rooted: DataFrame, shared: DataFrame | None = None, nearest: bool = False) -> DataFrame:
    """``a``, ``b``: nodes of different roots that share a shingle of their prefixes and could be similar by their sizes and parities.

    ``nearest``: of each node and group only the pair with the fewest differing
    parities, so that there are no more pairs than rows of ``shared``.
    """
    part, whole = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches, 0, lambda b: np.ones(b.num_rows, np.int64), ROWS_AT_ONCE):
            group, root, node, size, rest, side = (chunk.column(i).to_numpy() for i in range(6))
            bits = np.frombuffer(b"".join(chunk.column(6).to_pylist()), np.uint64).reshape(-1, PARITIES // 64)
            least, partner = np.full(group.size, PARITIES + 1), np.full(group.size, -1)
            for place, other in _fitting(group, root, size, rest):
                meet = (side[place] < 0) | (side[place] != side[other])
                place, other = place[meet], other[meet]
                for at in range(0, place.size, PAIRS_AT_ONCE):
                    x, y = place[at : at + PAIRS_AT_ONCE], other[at : at + PAIRS_AT_ONCE]
                    apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                    near = (part + whole) * apart <= (whole - part) * (size[x] + size[y])
                    x, y, apart = x[near], y[near], apart[near]
                    if nearest:
                        for one, two in ((x, y), (y, x)):
                            less = apart < least[one]
                            least[one[less]], partner[one[less]] = apart[less], two[less]
                    elif x.size:
                        yield pairs_of(node[x], node[y])
            if nearest and (partner >= 0).any():
                yield pairs_of(node[partner >= 0], node[partner[partner >= 0]])

    def pairs_of(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    # Most shingles are in one set only, so parities are dealt out to the shared ones alone.
    told = (_shared(rooted) if shared is None else shared).join(rooted.select("node", "root", "bits"), "node").withColumn("blocks", F.ceil(F.col("n") / GROUP_ROWS))
    # A shingle of very many sets is dealt in blocks: each two blocks meet in a group of their own, and so does each block with itself.
    told = told.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # Within a block with itself all rows meet (side -1); in a group of two blocks only rows of different ones.
    group = F.xxhash64("group", F.least("own", "met"), F.greatest("own", "met"))
    side = F.when(F.col("own") == F.col("met"), F.lit(-1)).otherwise(F.col("own")).cast("long")
    told = told.select(group.alias("group"), "root", "node", "size", "rest", side.alias("side"), "bits")
    met = told.repartition("group").sortWithinPartitions("group", "root", "node")
    return met.mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, of_node: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: tuple[str, ...] = ("text",)) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose sets of shingles have a Jaccard of SIMILAR or more; ``of_node`` names a row (``id``, ``key``) of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["of", "found"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(of_node, "node")
    wid, wkey = _names(F.col("id"), F.col("key"))
    wanted = cut_lineage(wanted.select("node", wid.alias("__wid"), wkey.alias("__wkey")))
    id_, key_ = _names(F.col(id_col), row_key(*key))
    rows = docs.select(id_.alias("__id"), key_.alias("__key"), F.col(text_col).cast("string").alias("text"))
    rows = marked(rows, wanted.select(F.col("__wid").alias("__id"), F.col("__wkey").alias("__key")), ("__id", "__key")).where("__maybe")
    rows = rows.join(wanted, (F.col("__id") == F.col("__wid")) & (F.col("__key") == F.col("__wkey")))
    sets = once(rows.select("__id", "__key", "node", "text"), "__id", "__key").select("node", "text").mapInArrow(run, "of long, found array<long>")
    sets = cut_lineage(sets)
    first = pairs.join(sets.select(F.col("of").alias("a"), F.col("found").alias("x")), "a")
    both = first.join(sets.select(F.col("of").alias("b"), F.col("found").alias("y")), "b")
    part, whole = SIMILAR
    common = F.size(F.array_intersect("x", "y"))
    return both.where((part + whole) * common >= part * (F.size("x") + F.size("y"))).select("a", "b")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: tuple[str, ...] = ("text",)) -> DataFrame:
    """``id``, ``key`` and ``root`` (the same for all rows of a group) of every row of ``docs``.

    Null and blank texts have the same, empty set; a row counts as often as it
    stands in the table; other columns are not read; an empty table gives an empty result.
    """
    texts = _texts(docs, id_col, text_col, key)
    noted = written(_noted(texts), "noted")
    rows = noted.where("part is null").select("id", "key", "node", "code")
    per_node = rows.groupBy("node").agg(F.first("code").alias("code"), F.min(F.struct("id", "key")).alias("r"))
    nodes = cut_lineage(per_node.select("node", "code", "r.id", "r.key"))
    of_node = nodes.select("node", "id", "key")
    near = cut_lineage(_linked(nodes).unionByName(_neighbours(nodes)).distinct())
    # Links found later are joined to the stars that are known, not to all links once more.
    roots = cut_lineage(components(cut_lineage(confirmed(near, docs, of_node, id_col, text_col, key))))
    rooted = written(_under(_prefixes(texts, *_levels(noted)), roots), "prefixes")
    # The nearest of each node first: a large group of near copies is one component, or few, before all pairs of different roots are looked at.
    shared, told = _shared(rooted), rooted.select("node", "root", "bits")
    for nearest in (True, False):
        others = cut_lineage(_meeting(told, shared, nearest).join(near, ["a", "b"], "left_anti"))
        links = cut_lineage(confirmed(others, docs, of_node, id_col, text_col, key))
        links = links.unionByName(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        # Narrow rows out of files: as many tasks read them as a shuffle has.
        roots = cut_lineage(components(links.coalesce(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
        near, told = near.unionByName(others), _under(told.drop("root"), roots) if nearest else told
    return _under(rows.select("id", "key", "node"), roots).select("id", "key", "root")


def _under(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the ``root`` of each ``node``: its own where ``roots`` (of :func:`components`) does not have it."""
    return rows.join(roots.select(F.col("node").alias("of"), "root"), F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("root", "node")).drop("of")


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the ``root`` of each ``node`` that ``links`` tell."""
    return _under(rows, components(links))
