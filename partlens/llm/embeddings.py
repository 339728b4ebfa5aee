"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one for each shard of a label.

Equal vectors are one class.  The classes of a label are spread over shards of a
bounded size; a graph is built in each, and every class queries every shard of its
label.  A beam is widened for a query as long as its worst member still links, and
for a whole block until an audit of some of its queries against all of the shard
finds the links it should.  Cosines are verified in double precision.  A task hands
on a count for each query and the links of a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlens.llm.common import components, forest
from partlens.session import cut_lineage

THRESHOLD = 0.93
#: Neighbours of a node in the lowest layer and above, candidates when building, the first beam, nodes expanded at a time.
NEIGHBOURS, ABOVE, BUILD_BEAM, FIRST_BEAM, EXPAND = 24, 12, 48, 48, 4
#: Blocks that query a shard in one task; others of the same shard have the graph built for them again.
TASK_BLOCKS = 16
#: Classes of a shard, queries of a block, queries searched at once, and audited queries of a block with the recall they must reach.
SHARD_ROWS, BLOCK_ROWS, AT_ONCE, AUDITED, RECALL = 8_192, 2_048, 256, 128, 1.0


class Graph:
    """A hierarchical navigable small-world graph over unit vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.float32)
        n = len(vectors)
        # A place in a fixed pseudo-random order gives the layer: each holds 1/16 of the one below.
        level = np.zeros(n, np.int64)
        rank = np.random.default_rng(7).permutation(n)
        size = n // 16
        while size >= 1:
            level += rank < size
            size //= 16
        self.order = np.argsort(-level, kind="stable")
        self.layers: list[np.ndarray] = []
        for layer in range(int(level.max(initial=0)), -1, -1):
            members = int(np.count_nonzero(level >= layer))
            self.layers.append(np.full((members, NEIGHBOURS if layer == 0 else ABOVE), -1, np.int32))
        self.points = self.vectors[self.order]
        for depth in range(len(self.layers)):
            self._build(depth)
            self._reach(depth)

    def _reach(self, depth: int) -> None:
        """Links every node that no walk from the first one meets to and from the nearest node that one does."""
        links = self.layers[depth]
        n = len(links)
        met = np.zeros(n, bool)
        front = np.zeros(1, np.int64)
        while True:
            while front.size:
                met[front] = True
                near = np.unique(links[front])
                front = near[(near >= 0) & ~met[np.maximum(near, 0)]]
            apart = np.flatnonzero(~met)
            if not apart.size:
                break
            there = np.flatnonzero(met)
            apart = apart[:AT_ONCE]
            to = there[np.argmax(self.points[apart] @ self.points[there].T, axis=1)]
            source, target = np.concatenate([to, apart]), np.concatenate([apart, to])
            by = np.argsort(source, kind="stable")
            source, target = source[by], target[by]
            _, first, count = np.unique(source, return_index=True, return_counts=True)
            column = np.arange(source.size) - np.repeat(first, count)
            more = np.full((n, int(count.max())), -1, np.int32)
            more[source, column] = target
            links = np.concatenate([links, more], axis=1)
            front = apart
        self.layers[depth] = links

    def _build(self, depth: int) -> None:
        links = self.layers[depth]
        n, degree = links.shape
        at = 1
        while at < n:
            # Nodes are added in batches that at most double the layer; those of a batch see each other directly.
            to = min(n, at + min(AT_ONCE, at))
            new = np.arange(at, to)
            start = self._entry(self.points[new], depth)
            start[start >= at] = 0
            ids, sims = self._beam(self.points[new], depth, start, BUILD_BEAM, at)
            among = self.points[new] @ self.points[new].T
            np.fill_diagonal(among, -2)
            ids = np.concatenate([ids, np.broadcast_to(new, among.shape)], axis=1)
            sims = np.concatenate([sims, among], axis=1)
            links[new] = self._diverse(ids, sims, degree)
            self._back(links, new)
            at = to

    def _back(self, links: np.ndarray, new: np.ndarray) -> None:
        """Adds the new nodes to the lists of those they point at; a full list keeps its diverse nearest."""
        source, target = np.repeat(new, links.shape[1]), links[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        most = 0
        for at in range(0, nodes.size, AT_ONCE):
            part, begins, counts = nodes[at : at + AT_ONCE], first[at : at + AT_ONCE], count[at : at + AT_ONCE]
            most = counts.max()
            more = np.full((part.size, most), -1, np.int64)
            column = np.arange(most)
            there = column < counts[:, None]
            more[there] = source[(begins[:, None] + column)[there]]
            ids = np.concatenate([links[part], more], axis=1)
            sims = np.einsum("bkd,bd->bk", self.points[ids], self.points[part])
            sims[ids < 0] = -2
            links[part] = self._diverse(ids, sims, links.shape[1])

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
        """Of candidates by similarity those nearer to the node than to any taken before; places left go to the nearest others."""
        width = min(ids.shape[1], BUILD_BEAM)
        by = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
        ids = np.where(sims > -2, ids, -1)
        points = self.points[ids]
        between = np.einsum("bkd,bld->bkl", points, points)
        taken = np.zeros(ids.shape, bool)
        for k in range(width):
            closest = np.where(taken, between[:, k], -2).max(1)
            taken[:, k] = (ids[:, k] >= 0) & (closest < sims[:, k]) & (taken.sum(1) < degree)
        # Equal standing: taken first, then the nearest of the rest.
        rank = np.argsort(np.where(ids < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :degree]
        out = np.full((ids.shape[0], degree), -1, np.int32)
        out[:, : rank.shape[1]] = np.take_along_axis(ids, rank, 1)
        return out

    def _entry(self, queries: np.ndarray, depth: int) -> np.ndarray:
        """The nearest node that a greedy walk through the layers above finds for each query."""
        start = np.zeros(len(queries), np.int64)
        for above in range(depth):
            ids, _ = self._beam(queries, above, start, 4, self.layers[above].shape[0])
            start = ids[:, 0]
        return start

    def _beam(self, queries: np.ndarray, depth: int, start: np.ndarray, width: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes found for each query, best first; -1 with -2 where there are fewer."""
        links = self.layers[depth]
        b = len(queries)
        rows = np.arange(b)
        seen = np.zeros((b, limit), bool)
        ids = np.full((b, width), -1, np.int64)
        sims = np.full((b, width), -2, np.float32)
        open_ = np.zeros((b, width), bool)
        ids[:, 0], open_[:, 0] = start, True
        sims[:, 0] = np.einsum("bd,bd->b", queries, self.points[start])
        seen[rows, start] = True
        active = rows
        while active.size:
            mine = np.where(open_[active], sims[active], -3)
            pick = np.argpartition(-mine, min(EXPAND, width) - 1, axis=1)[:, :EXPAND]
            chosen = np.take_along_axis(open_[active], pick, 1)
            nodes = np.where(chosen, np.take_along_axis(ids[active], pick, 1), -1)
            np.put_along_axis(mine, pick, -3, 1)
            kept_open = mine > -3
            near = links[nodes].astype(np.int64)
            near[nodes < 0] = -1
            near = near.reshape(active.size, -1)
            new = (near >= 0) & (near < limit)
            new &= ~seen[active[:, None], np.where(new, near, 0)]
            near = np.where(new, near, -1)
            # A node reached twice in one step is taken once.
            by = np.argsort(near, axis=1)
            near = np.take_along_axis(near, by, 1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            who, place = np.nonzero(near >= 0)
            at = near[who, place]
            seen[active[who], at] = True
            got = np.full(near.shape, -2, np.float32)
            got[who, place] = np.einsum("kd,kd->k", self.points[at], queries[active[who]])
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_sims = np.concatenate([sims[active], got], axis=1)
            all_open = np.concatenate([kept_open, near >= 0], axis=1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[active], sims[active] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            open_[active] = np.take_along_axis(all_open, best, 1) & (sims[active] > -2)
            active = active[open_[active].any(1)]
        by = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)

    def near(self, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) pairs with a similarity of about ``least`` or more; a beam that is full of them is doubled."""
        n, depth = len(self.points), len(self.layers) - 1
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(queries), AT_ONCE):
            left, width = np.arange(at, min(len(queries), at + AT_ONCE)), min(beam, n)
            while left.size:
                ids, sims = self._beam(queries[left], depth, self._entry(queries[left], depth), width, n)
                full = (sims[:, -1] >= least - 0.05) if width < n else np.zeros(left.size, bool)
                who, place = np.nonzero((sims >= least) & ~full[:, None])
                found.append((left[who], self.order[ids[who, place]]))
                left, width = left[full], min(2 * width, n)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2


def shard_links(members: np.ndarray, queries: np.ndarray, threshold: float = THRESHOLD, graph: Graph | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, member) whose cosine is at least ``threshold``, by the graph of the members; unit vectors in double precision."""
    graph = graph or Graph(members)
    q32, m32 = queries.astype(np.float32), members.astype(np.float32)
    least, beam = threshold - 1e-4, FIRST_BEAM
    audit = np.unique(np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(np.int64))
    true_q, true_m = np.nonzero(q32[audit] @ m32.T >= least)
    truth = np.sort(audit[true_q] * len(members) + true_m)
    while True:
        who, member = graph.near(q32, least, beam)
        hit = np.isin(truth, who * len(members) + member).sum()
        if hit >= RECALL * truth.size or beam >= len(members):
            break
        beam *= 2
    close = np.concatenate([np.einsum("kd,kd->k", queries[who[i : i + 65_536]], members[member[i : i + 65_536]]) for i in range(0, max(1, who.size), 65_536)])
    linked = close >= threshold
    return who[linked], member[linked]


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``id``, ``n_links``, ``component`` and ``kept`` for every row of ``vectors``.

    Rows are linked within a label (not null) if their cosine reaches
    ``threshold``.  A null or zero vector, one with a null or not finite part and
    one without a label link with nothing and are components of their own, as are
    rows with a null id among themselves; vectors of different lengths are not
    compared.  Rows that repeat a vector are linked to each other; an empty table
    gives an empty result; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.expr("label is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = rows.where("sound").groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    classes = cut_lineage(classes.select("label", F.size("v").alias("dim"), "v", "first", "n", F.monotonically_increasing_id().alias("c")))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("rows"))
    spread = sizes.select("label", "dim", F.ceil(F.col("rows") / shard_rows).alias("shards"), F.ceil(F.col("rows") / block_rows).alias("blocks"))
    placed = classes.join(spread, ["label", "dim"])
    turn = F.pmod(F.xxhash64("c"), F.col("shards"))
    zero = F.lit(0).cast("long")
    parts = F.explode(F.sequence(zero, F.ceil(F.col("blocks") / TASK_BLOCKS) - 1))
    members = placed.select("label", "dim", turn.alias("shard"), parts.alias("part"), F.lit(-1).cast("long").alias("block"), "c", "n", "v")
    queries = placed.withColumn("block", F.pmod(F.xxhash64("c", F.lit(1)), F.col("blocks")))
    queries = queries.select("label", "dim", F.explode(F.sequence(zero, F.col("shards") - 1)).alias("shard"), F.expr(f"block div {TASK_BLOCKS}").alias("part"), "block", "c", "n", "v")
    both = members.unionByName(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, own, weight, unit = None, None, None, None
        for blk, table in _blocks(batches):
            ids, counts = table.column(5).to_numpy(), table.column(6).to_numpy()
            made = _unit(table.column(7))
            if blk < 0:
                own, weight, unit = ids, counts, made
                graph = Graph(unit)
                continue
            q, m = shard_links(unit, made, threshold, graph)
            other = ids[q] != own[m]
            q, m = q[other], m[other]
            links = np.bincount(q, weight[m], len(ids)).astype(np.int64)
            nodes, at = np.unique(np.concatenate([ids, own]), return_inverse=True)
            root = nodes[forest(nodes.size, at[: len(ids)][q], at[len(ids) :][m])]
            touched = np.zeros(nodes.size, bool)
            touched[at[: len(ids)][q]] = touched[at[len(ids) :][m]] = True
            joined = touched & (root != nodes)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.nulls(len(ids), pa.int64())], names=["c", "links", "root"])
            yield pa.RecordBatch.from_arrays([pa.array(nodes[joined]), pa.nulls(int(joined.sum()), pa.int64()), pa.array(root[joined])], names=["c", "links", "root"])

    # A task meets each shard's members first (block -1), then the blocks that query it.
    keys = ["label", "dim", "shard", "part"]
    dealt = both.repartition(*keys).sortWithinPartitions(*keys, "block")
    made = cut_lineage(dealt.mapInArrow(run, "c long, links long, root long"))
    links = made.where("links is not null").groupBy("c").agg(F.sum("links").alias("links"))
    roots = components(made.where("root is not null").select(F.col("c").alias("a"), F.col("root").alias("b")))
    known = classes.join(links, "c", "left").join(roots, classes["c"] == roots["node"], "left")
    known = cut_lineage(known.select("label", "v", "first", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "c").alias("root")))
    lowest = known.groupBy("root").agg(F.min("first").alias("component"))
    found = known.join(lowest, "root").select(F.col("label").alias("l"), F.col("v").alias("w"), (F.col("links") + F.col("n") - 1).alias("links"), "component")
    good = rows.where("sound").join(found, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))).select("id", "links", "component")
    alone = rows.where("not sound").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    every = good.unionByName(alone)
    return every.select("id", F.col("links").alias("n_links"), "component", F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def _unit(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows of length one in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block, rows) of a task's sorted rows: each shard's members as block -1, then its blocks of queries."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        names = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
        at = 0
        for i, name in enumerate(names):
            if name != now:
                if i > at:
                    held.append(batch.slice(at, i - at))
                if held:
                    yield now[4], pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, at, now = [], i, name
        held.append(batch.slice(at))
    if held:
        yield now[4], pa.Table.from_batches(held).combine_chunks().to_batches()[0]
