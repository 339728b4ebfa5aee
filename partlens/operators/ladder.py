"""Nearest values within a group, by position on the sorted ladder of distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ladder_positions(points: DataFrame, probes: DataFrame, keys: Sequence[str], value: str,
                     block: Column | None = None) -> DataFrame:
    """(keys, value, is_point, position) of every distinct value; position counts the points below it.

    Distinct values are aggregated map-side first.  Counting runs inside blocks
    of neighbouring values (``block``, by default the whole-number part) and is
    shifted by the points of earlier blocks, so no group is sorted in one task.
    """
    tagged = points.select(*keys, value, F.lit(1).alias("is_point")).unionByName(
        probes.select(*keys, value, F.lit(0).alias("is_point"))
    )
    rungs = tagged.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.max("is_point").alias("is_point"))
    rungs = rungs.withColumn("_block", F.floor(F.col(value)) if block is None else block)
    inside = Window.partitionBy(*keys, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rungs.groupBy(*keys, "_block").agg(F.sum("is_point").alias("_points"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_block", F.coalesce(F.sum("_points").over(earlier), F.lit(0)).alias("_offset"))
    counted = rungs.withColumn("_inside", F.coalesce(F.sum("is_point").over(inside), F.lit(0)))
    joined = counted.join(offsets, [*keys, "_block"])
    return joined.select(*keys, value, "is_point", (F.col("_inside") + F.col("_offset")).alias("position"))


def neighbours(points: DataFrame, probes: DataFrame, keys: Sequence[str], value: str, above: int, below: int) -> DataFrame:
    """For every distinct probe the ``above`` nearest points at or over it and the ``below`` nearest under it.

    Returns (keys, value, neighbour).  Each probe meets at most ``above + below``
    rungs through an equi-join on the rung number.
    """
    ladder = ladder_positions(points, probes, keys, value)
    rungs = ladder.filter("is_point = 1").select(*keys, F.col(value).alias("neighbour"), F.col("position").alias("rung"))
    wanted = probes.select(*keys, value).distinct().join(ladder, [*keys, value]).withColumn(
        "rung", F.explode(F.sequence(F.col("position") - below, F.col("position") + (above - 1)))
    )
    return wanted.join(rungs, [*keys, "rung"]).select(*keys, value, "neighbour")


# Rungs that one task counts together.
BLOCK = 1 << 16


def code_runs(rungs: DataFrame, keys: Sequence[str], value: str, low: str, high: str, block: Column | None = None) -> DataFrame:
    """Rungs (keys, value) with ``position``, ``run`` and ``offset``, all from 0.

    ``low`` and ``high`` are the smallest and largest code of a rung.  A run is a row of
    neighbouring rungs that all hold one and the same code; every other rung is a run
    of its own.  So two neighbouring runs never hold the same single code.  Runs are
    counted in blocks of positions, as positions are in blocks of values.
    """
    places = ladder_positions(rungs, rungs.limit(0), keys, value, block).select(*keys, value, "position")
    placed = rungs.select(*keys, value, low, high).join(places, [*keys, value])
    before = placed.select(*keys, (F.col("position") + 1).alias("position"), F.col(low).alias("_low"), F.col(high).alias("_high"))
    same = (F.col(low) == F.col(high)) & (F.col("_low") == F.col("_high")) & (F.col(low) == F.col("_low"))
    marked = placed.join(before, [*keys, "position"], "left").withColumn("_starts", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("_block", F.floor(F.col("position") / BLOCK)).drop("_low", "_high")
    inside = Window.partitionBy(*keys, "_block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    sizes = marked.groupBy(*keys, "_block").agg(F.sum("_starts").alias("_runs"), F.max(F.when(F.col("_starts") == 1, F.col("position"))).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*keys, "_block", F.coalesce(F.sum("_runs").over(earlier), F.lit(0)).alias("_shift"), F.max("_last").over(earlier).alias("_carried"))
    start = F.max(F.when(F.col("_starts") == 1, F.col("position"))).over(inside)
    counted = marked.withColumns({"_within": F.sum("_starts").over(inside), "_start": start}).join(shifts, [*keys, "_block"])
    return counted.select(
        *keys, value, "position", (F.col("_within") + F.col("_shift") - 1).alias("run"),
        (F.col("position") - F.coalesce("_start", "_carried")).alias("offset"),
    )
