"""Distinct values of a key as pages of bounded length, however many a key has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.plans.scale import block_row_number

PAGE = 1_000


def default_block(df: DataFrame, value: str) -> Column:
    """Blocks that do not fall along the values: 1,024 whole numbers, or what begins with the same two characters."""
    kind = dict(df.dtypes)[value]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.shiftright(F.col(value).cast("long"), 10)
    return F.substring(F.col(value).cast("string"), 1, 2)


def paged_sets(df: DataFrame, keys: Sequence[str], value: str, size: int = PAGE, block: Column | None = None) -> DataFrame:
    """(keys, page, n, entries): the distinct values of every key in rising order, at most ``size`` to a page; ``n`` counts all of the key.

    Equal pairs combine before the shuffle.  Places are counted inside blocks of
    neighbouring values and shifted by the blocks before, so a key with a third of the
    rows is sorted by many tasks and no array grows with it.  NULL values are left out.
    """
    pairs = df.filter(F.col(value).isNotNull()).select(*keys, value).distinct()
    placed = block_row_number(pairs, keys, [value], [default_block(df, value) if block is None else block], "_place")
    counted = placed.groupBy(*keys, F.floor(F.col("_place") / size).cast("int").alias("page"))
    pages = counted.agg(F.array_sort(F.collect_list(value)).alias("entries"))
    totals = pages.groupBy(*keys).agg(F.sum(F.size("entries")).alias("n"))
    on = None
    for k in keys:
        same = F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}"))
        on = same if on is None else on & same
    joined = pages.alias("p").join(totals.alias("t"), on)
    return joined.select(*[F.col(f"p.{k}") for k in keys], "page", "n", "entries")
