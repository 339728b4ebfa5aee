"""Plan shapes that keep hot keys, fan-outs and broadcasts bounded."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

# Rows of a table that may travel inside one value (a packed requirement list).
PACK_ROWS = 512
# Copies of a broadcast pack list, one per salt value.
SALTS = 8


def as_columns(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` holds no more than ``rows`` rows; reads at most ``rows + 1`` of them."""
    return df.limit(rows + 1).count() <= rows


def spread(df: DataFrame) -> DataFrame:
    """Rows of a source over all cores before a CPU-heavy step, where its files give fewer partitions than that.

    A source of many files already has its partitions and is returned unchanged,
    so nothing large is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that must not be sent whole through the driver.

    Spark plans a broadcast by the bytes of the rows before an explode, compressed;
    a side that grows with the input is therefore named as one to be shuffled.
    """
    return df.hint("merge")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each key group, ranked from 1.

    A ``row_number() <= k`` filter lets Spark cut every partition to ``k`` rows
    per key before the shuffle, so a hot key costs ``k`` rows per partition.
    """
    window = Window.partitionBy(*as_columns(keys)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def clamp_k(k: float | None, default: int, ceiling: int | None = None) -> int:
    """A usable result size: junk becomes the default; only a ceiling that the caller names lowers the rest."""
    if isinstance(k, bool) or not isinstance(k, (int, float)) or not 1 <= k < float("inf"):
        return default
    return int(k) if ceiling is None else min(int(k), ceiling)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order``.  A partial aggregate, so hot keys combine map-side."""
    pick = F.min_by(F.struct(*keep), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*")


def block_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Sequence[Column], name: str
) -> DataFrame:
    """0-based position of every row in its key group, without sorting a whole group in one task.

    ``block`` must be non-decreasing along ``order`` and cut every group into
    pieces of bounded size.  Positions are counted inside a block and shifted by
    the rows of the earlier blocks, which is a sum over one row per block.
    """
    blocks = [f"_block{i}" for i in range(len(block))]
    tagged = df.withColumns(dict(zip(blocks, block)))
    key_cols = as_columns(keys)
    inside = Window.partitionBy(*key_cols, *blocks).orderBy(*order)
    sizes = tagged.groupBy(*keys, *blocks).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*key_cols).orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    same = [tagged[c].eqNullSafe(offsets[c]) for c in [*keys, *blocks]]
    joined = tagged.withColumn("_inside", F.row_number().over(inside) - 1).alias("l")
    on = None
    for c in [*keys, *blocks]:
        term = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        on = term if on is None else on & term
    out = joined.join(offsets.alias("r"), on)
    return out.select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("l._inside") + F.col("r._offset")).cast("int").alias(name),
    )


def pair_with_all(
    rows: DataFrame,
    small: DataFrame,
    as_name: str,
    keep: Callable[[Column], Column] | None = None,
    pack_rows: int = PACK_ROWS,
) -> DataFrame:
    """Every row of ``rows`` with every row of ``small`` as a struct column, for operators that ask every pair.

    ``small`` is counted first.  Up to ``pack_rows`` it becomes one array value
    that is broadcast and exploded next to each row: a narrow step that moves no
    row of ``rows``.  Beyond that it is cut into packs of about that size, spread
    by hash, and each pack meets the rows through a shuffled equi-join on
    (pack, salt), so no task holds more than a pack and a slice of ``rows``.
    ``keep(struct)`` drops elements before they become rows.
    """
    bounded = at_most(small, pack_rows)
    packs = 1 if bounded else 2 * -(-small.count() // pack_rows)
    salts = SALTS if bounded else int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = (
        small.select(
            F.pmod(F.xxhash64(*small.columns), F.lit(packs)).cast("int").alias("_packno"),
            F.struct(*small.columns).alias("_entry"),
        )
        .groupBy("_packno")
        .agg(F.collect_list("_entry").alias("_pack"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    if bounded:
        packed = F.broadcast(packed)
    scalars = [f.name for f in rows.schema.fields if isinstance(f.dataType, AtomicType)]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*scalars), F.lit(salts)).cast("int"))
    if packs == 1:
        joined = salted.join(packed.drop("_packno"), "_salt")
    else:
        numbered = salted.withColumn("_packno", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
        joined = numbered.join(packed, ["_packno", "_salt"])
    elements = F.col("_pack") if keep is None else F.filter("_pack", keep)
    return joined.select(*rows.columns, F.explode(elements).alias(as_name))
