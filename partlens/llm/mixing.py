"""Mixing sources to target weights by systematic sampling.

Within a source the documents stand in order of size; each is expected
target / size-of-the-source times, the running sum of these expectations starts at
one random offset, and a document is emitted once for every whole number its step
crosses.  The order by size keeps the words taken within about one document of the
target.

The running sum is built from bounded pieces: places of rows within (source, size
class, salt), places of salts within a size class, places of size classes within a
source.  A source, or a size, that holds a third of all rows is thus spread over
many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partlens.llm.common import coarse, row_key
from partlens.session import cut_lineage

WEIGHTS = (1, 2, 3)
#: No document is expected more often.
MOST = 3
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source_key``, ``source_size`` and ``target`` (words) of every source.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum
    of all sizes; a target stops at ``most`` times its source's size.  Sources in
    order of (limit / weight) are filled first, so the one level that all others
    reach follows from running sums; there is one row for each source.
    """
    sums = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy("source_key")) - 1) % len(weights) + 1
    rows = sums.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn).cast("long"))
    rows = rows.withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy((F.col("cap") / F.col("weight")), "source_key")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.select(
        "source_key", "source_size", "weight", "cap", F.row_number().over(order).alias("place"),
        (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("rest"),
        F.sum("weight").over(after).alias("shares"),
    )
    free = F.col("rest") * F.col("weight") <= F.col("cap") * F.col("shares")
    first = F.min(F.when(free, F.struct("place", "rest", "shares"))).over(Window.partitionBy())
    rows = rows.withColumn("first", first)
    share = (F.col("weight") * F.col("first.rest")).cast("double") / F.col("first.shares").cast("double")
    target = F.when(F.col("place") < F.col("first.place"), F.col("cap").cast("double")).otherwise(share)
    return rows.select("source_key", "source_size", target.alias("target"))


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key: tuple[str, ...] = ("text",)) -> DataFrame:
    """``id``, ``key``, ``source_key`` and ``size`` (words; none for a null text) of every row."""
    words = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    source = F.col(source_col)
    return docs.select(
        F.col(id_col).alias("id"), row_key(*key).alias("key"), F.size(words).cast("long").alias("size"),
        F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source)).alias("source_key"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key: tuple[str, ...] = ("text",), weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``id``, ``key``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words) for every row of ``docs``.

    Null texts have size 0 and are emitted like others; null sources are a
    source of their own, last in order; equal rows each have their place; a source
    without words has target 0 and no copies; reruns agree, as the order and the
    offset (a digest of seed and source) depend on values alone.
    """
    sizes = cut_lineage(sizes_of(docs, id_col, text_col, source_col, key).withColumns({
        "class": coarse(F.col("size")), "salt": F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 2),
    }))
    pieces = sizes.groupBy("source_key", "class", "salt").agg(F.count("*").alias("n"))
    classes = pieces.groupBy("source_key", "class").agg(F.sum("n").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("source_key", "class", F.coalesce(F.sum("n").over(before(Window.partitionBy("source_key").orderBy("class"))), F.lit(0)).alias("base"))
    digest = F.substring(F.md5(F.concat(F.lit(seed), F.lit("/"), "source_key")), 1, 8)
    offset = F.conv(digest, 16, 10).cast("double") / F.lit(4294967296.0)
    sources = targets(sizes, weights, most).withColumn("offset", offset)
    classes = classes.join(sources, "source_key")
    within = F.coalesce(F.sum("n").over(before(Window.partitionBy("source_key", "class").orderBy("salt"))), F.lit(0))
    pieces = pieces.withColumn("within", within).join(classes, ["source_key", "class"])
    rows = sizes.withColumn("place", F.row_number().over(Window.partitionBy("source_key", "class", "salt").orderBy("size", "id", "key")))
    rows = rows.join(pieces.drop("n"), ["source_key", "class", "salt"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    rows = rows.withColumns({"rate": rate, "place": (F.col("base") + F.col("within") + F.col("place")).cast("double")})
    crossed = F.floor(F.col("offset") + F.col("place") * F.col("rate")) - F.floor(F.col("offset") + (F.col("place") - 1) * F.col("rate"))
    copies = F.least(crossed, F.lit(most)).cast("long")
    return rows.select("id", "key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
