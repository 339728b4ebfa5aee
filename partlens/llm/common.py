"""Helpers the operators share: the word pattern, row keys, bounded broadcasts and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partlens.session import cut_lineage

#: A word is a run of characters other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters between words.
BLANKS = " \t\n\x0b\x0c\r"


def row_key(*columns: str) -> Column:
    """A 64-bit key of the given columns (nulls apart from blanks); with the id it names a row of a table."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def coarse(value: Column) -> Column:
    """A count rounded down to its six leading binary digits: the buckets of a mergeable sketch, at most 1/32 apart."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.length(F.bin(value)) - 6)).cast("long")
    return value - value % step


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of ``keys``: of rows already sorted by them, as a join leaves them, without another sort or shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(keys[-1]))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def _names(id_: Column, key: Column) -> tuple[Column, Column]:
    """An id and key without nulls, so that joins and windows on them share a partitioning."""
    return F.coalesce(id_.cast("long"), F.lit(0)), F.xxhash64(key, id_.isNull())


def plain_names(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named by their places, ``c0`` and on: no name of a caller meets one of ours."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def place_of(docs: DataFrame, name: str) -> str:
    """The plain name of a column."""
    return f"c{docs.columns.index(name)}"


def free_names(names: list[str], taken: list[str]) -> list[str]:
    """``names``, each with underscores behind it until no other column has it in any case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def keep_rows(docs: DataFrame, kept: DataFrame, key: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` named in ``kept`` (``id``, ``key``: of the columns ``key``, ``times``), each as often as ``times`` says.

    A row that stands in ``docs`` several times counts once; ``times`` is for all
    its copies.  The texts are shuffled once: the join, the choice of one row and
    the repetition share the partitions.  Names in ``docs`` may be any.
    """
    plain = plain_names(docs)
    id_, key_ = _names(F.col(place_of(docs, id_col)), row_key(*[place_of(docs, k) for k in key]))
    named = plain.withColumns({"__id": id_, "__key": key_})
    kid, kkey = _names(F.col("id"), F.col("key"))
    keys = kept.groupBy(kid.alias("__kid"), kkey.alias("__kkey")).agg(F.sum("times").cast("int").alias("__times"))
    rows = named.join(keys, (F.col("__id") == F.col("__kid")) & (F.col("__key") == F.col("__kkey"))).where("__times > 0")
    rows = once(rows, "__id", "__key").withColumn("__time", F.explode(F.sequence(F.lit(1), "__times")))
    return rows.select(*plain.columns).toDF(*docs.columns)


#: Bits of the mark table by which rows without a partner are left out of a shuffle: it is broadcast and never larger than this.
MARK_BITS = 1 << 23


def marked(rows: DataFrame, wanted: DataFrame, keys: tuple[str, str] = ("id", "key")) -> DataFrame:
    """``rows`` with ``__maybe``: false only where no row of ``wanted`` has the same keys.

    One bit for each hash of the keys: at most MARK_BITS of them, whatever the size
    of ``wanted``, so the broadcast is bounded; a fuller table only lets more rows pass.
    """
    spot = F.pmod(F.xxhash64(*keys), F.lit(MARK_BITS))
    bits = wanted.select(spot.alias("spot")).groupBy(F.expr("spot div 64").alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("__bits"))
    placed = rows.withColumn("__spot", spot).withColumn("__at", F.expr("__spot div 64"))
    met = placed.join(F.broadcast(bits), F.col("__at") == F.col("__word"), "left")
    maybe = F.coalesce(F.expr("shiftright(__bits, cast(__spot % 64 as int)) & 1 = 1"), F.lit(False))
    return met.withColumn("__maybe", maybe).drop("__spot", "__at", "__word", "__bits")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 joined by edges (a, b): the smallest node of each one's component."""
    label = np.arange(n)
    while a.size:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


#: Links that one task joins to a forest at once.
LINKS_AT_ONCE = 1 << 20


def _forests(links: DataFrame) -> DataFrame:
    """``u``, ``v`` (``v`` < ``u``): the links that a task holds as stars around the smallest node; never more of them than ``links``."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = np.concatenate([b.column(i).to_numpy() for i in (0, 1) for b in held])
        nodes, at = np.unique(ends, return_inverse=True)
        root = nodes[forest(nodes.size, *np.split(at, 2))]
        child = root != nodes
        return pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(root[child])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= LINKS_AT_ONCE:
                yield stars(held)
                held = []
        if held:
            yield stars(held)

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def _all_stars(links: DataFrame) -> bool:
    """Whether no node of ``links`` has two different smaller ones, or a smaller and a larger one."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("up")), F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("up")))).alias("e")).select("e.*")
    told = ends.groupBy("node").agg(F.min("up").alias("least"), F.max("up").alias("most"), F.max(F.col("up").isNull()).alias("top"))
    return told.where("least <> most or (top and least is not null)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (its component's smallest node) for the nodes of ``edges`` (``a``, ``b``: long, not null).

    Alternates the large-star and small-star steps (Kiveris et al. 2014): every
    step is a grouped minimum and a join, so no component and no hub is ever held
    by one task.  A round makes no more links or partitions than it was given; what a
    task holds it joins to a forest at once.  Each round is checkpointed; the rounds end
    when all links are stars, so links that are stars from the start take none.
    Empty input gives an empty result.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = cut_lineage(_forests(links))
    while not _all_stars(links):
        both = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        met = large.join(low, F.col("u") == F.col("w"))
        # The link to the smallest one stays, all others go from there to it.
        links = cut_lineage(_forests(met.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))))
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), "v"), F.struct(F.col("v").alias("node"), "v"))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.min("v").alias("root"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the session names in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="partlens-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut, and a lost executor costs nothing made before."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_groups(batches: Iterator[pa.RecordBatch], key: int, weight: Callable[[pa.RecordBatch], np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    """A task's rows, sorted by column ``key``, in batches of about ``most`` weight that cut no group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[bool(held) and keys[0] != held[-1].column(key)[-1].as_py()], keys[1:] != keys[:-1]])) if batch.num_rows else []
        load = np.concatenate([[0], np.cumsum(weight(batch))])
        at = 0
        for start in starts:
            if size + load[start] - load[at] >= most:
                held.append(batch.slice(at, start - at))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, at = [], 0, start
        held.append(batch.slice(at))
        size += load[-1] - load[at]
    held = [b for b in held if b.num_rows]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
