"""Image matching on page layouts: rows to thumbnails, heroes to families, best assignment, manifest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlens.plans.scale import first_by
from partlens.session import cut_lineage

# Layout limits in page units, and the precedence of match methods.
PAGE_WIDE, MIN_AREA, THUMB_MAX_H, HERO_MIN_H, TOLERANCE, TEXT_H = 0.7, 500, 100, 71, 45.0, 11
# Distances of a group's rows and images that are held at once.
PAIRS_AT_ONCE = 1 << 22
METHODS = ["row_aligned", "page_hero", "family_hero", "family_hero_loose"]


def usable_images(images: DataFrame) -> DataFrame:
    """Images that are neither page-wide bands nor pictograms, with centre and area."""
    kept = images.filter((F.col("w") < F.col("page_width") * PAGE_WIDE) & (F.col("w") * F.col("h") >= MIN_AREA))
    return kept.withColumns({"centre": F.col("top") + F.col("h") / 2, "area": F.col("w") * F.col("h")})


def _groups(items: DataFrame) -> DataFrame:
    """Items with ``grp``: those of one page that an ordered pass over its images may have to see together.

    A page is cut where neighbouring centres lie further apart than the tolerance,
    found on the extremes of its cells of that height.  A page that prints a number
    twice is one group, as a claimed number is gone everywhere on it.
    """
    cells = items.groupBy("page", "cell").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    order = Window.partitionBy("page").orderBy("cell")
    apart = F.coalesce(F.col("low") - F.lag("high").over(order) > TOLERANCE, F.lit(True)).cast("int")
    cut = cells.withColumn("grp", F.sum(apart).over(order.rowsBetween(Window.unboundedPreceding, 0))).select("page", "cell", "grp")
    numbers = items.filter(~F.col("image")).groupBy("page", "name").agg(F.count("*").alias("n"))
    whole = numbers.filter("n > 1").select("page").distinct().withColumn("whole", F.lit(True))
    return items.join(cut.join(whole, "page", "left"), ["page", "cell"]).withColumn("grp", F.when(F.col("whole"), 0).otherwise(F.col("grp")))


def _claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Claims in the order of the images; rows (page, grp, image, value, name) come sorted, a group's text rows before its images."""
    made: list[list] = [[], [], [], []]
    group, numbers, places, thumbs, page_of = None, [], [], [], None

    def fold() -> None:
        if not numbers or not thumbs:
            return
        place, centres = np.array(places), np.array([c for c, _ in thumbs])
        # How near the nearest image of the group is to each row: only an image as near as that may claim it.
        nearest = np.abs(place[:, None] - centres).min(axis=1) if place.size * centres.size <= PAIRS_AT_ONCE else np.array([np.abs(centres - p).min() for p in place])
        rows_of: dict[str, list[int]] = {}
        for i, number in enumerate(numbers):
            rows_of.setdefault(number, []).append(i)
        taken = np.zeros(len(numbers), bool)
        for centre, image in thumbs:
            away = np.where(taken, np.inf, np.abs(place - centre))
            best = int(away.argmin())
            if away[best] > TOLERANCE or nearest[best] < away[best]:
                continue
            taken[rows_of[numbers[best]]] = True
            for column, value in zip(made, (page_of, numbers[best], image, centre - place[best]), strict=True):
                column.append(value)

    def told(kind: pa.DataType) -> pa.RecordBatch:
        nonlocal made
        columns = [pa.array(made[0], kind), pa.array(made[1], pa.string()), pa.array(made[2], pa.string()), pa.array(made[3], pa.float64())]
        made = [[], [], [], []]
        return pa.RecordBatch.from_arrays(columns, names=["page", "order_number", "image_id", "offset"])

    kind = None
    for batch in batches:
        kind = batch.schema.field("page").type
        for page, grp, image, value, name in zip(*(batch.column(c).to_pylist() for c in ("page", "grp", "image", "value", "name")), strict=True):
            if (page, grp) != group:
                fold()
                group, numbers, places, thumbs, page_of = (page, grp), [], [], [], page
            if image:
                thumbs.append((value, name))
            else:
                numbers.append(name)
                places.append(value)
        if made[0]:
            yield told(kind)
    if group is not None:
        fold()
        yield told(kind)


def row_image_match(images: DataFrame, rows: DataFrame) -> DataFrame:
    """Thumbnails and the rows that they claim, one after another, on every page.

    In the order of the images (``ord`` where there is one, else the id) each takes the
    nearest row that is still free, if it lies within the tolerance and no other
    thumbnail of the page lies nearer to it; of rows equally near the first (``ord``,
    else the upper one).  What a task folds is a group of :func:`_groups`.
    """
    def order(df: DataFrame, other: Column) -> Column:
        return F.col("ord").cast("double") if "ord" in df.columns else other

    thumbs = usable_images(images).filter(F.col("h") <= THUMB_MAX_H)
    centre = (F.col("top") + TEXT_H / 2).cast("double")
    items = thumbs.select("page", F.col("centre").cast("double").alias("value"), F.lit(True).alias("image"), F.col("image_id").cast("string").alias("name"), order(thumbs, F.lit(0.0)).alias("turn")).unionByName(
        rows.select("page", centre.alias("value"), F.lit(False).alias("image"), F.col("order_number").cast("string").alias("name"), order(rows, centre).alias("turn"))
    )
    items = items.filter("value is not null").withColumn("cell", F.floor(F.col("value") / TOLERANCE))
    kind = dict(items.dtypes)["page"]
    dealt = _groups(items).repartition("page", "grp").sortWithinPartitions("page", "grp", "image", "turn", "name")
    claims = dealt.select("page", "grp", "image", "value", "name").mapInArrow(_claims, f"page {kind}, order_number string, image_id string, offset double")
    sizes = thumbs.select("page", F.col("image_id").cast("string").alias("image_id"), "sha", "area")
    return claims.join(first_by(sizes, ["page", "image_id"], ["sha"], ["sha", "area"]), ["page", "image_id"]).select("page", "order_number", "image_id", "sha", "area", "offset")


def page_heroes(images: DataFrame, matched: DataFrame) -> DataFrame:
    """The largest tall image of a page that no row has claimed, and whether it had rivals."""
    free = usable_images(images).filter(F.col("h") >= HERO_MIN_H).join(matched.select("page", "image_id"), ["page", "image_id"], "left_anti")
    order = F.struct((-F.col("area")).alias("a"), F.col("image_id").alias("i"))
    return free.groupBy("page").agg(
        F.min_by(F.struct("image_id", "sha", "area"), order).alias("_h"), (F.count("*") > 1).alias("ambiguous")
    ).select("page", "_h.*", "ambiguous")


def propose(images: DataFrame, rows: DataFrame, products: DataFrame) -> DataFrame:
    """Every proposed (order_number, image) with its method: own row, page hero, subfamily hero, family hero.

    ``rows`` places order numbers on pages; only products take a hero.
    """
    # Each is read by several branches below; what is kept is a few narrow columns.
    matched = cut_lineage(row_image_match(images, rows))
    heroes = page_heroes(images, matched)
    placed = rows.select("page", "order_number").distinct()
    parts = cut_lineage(products.filter("row_type = 'product'").select(
        "order_number", F.concat_ws("|", "category", F.coalesce("family", F.lit("null"))).alias("fam"), F.coalesce("subfamily", F.lit("")).alias("sub")
    ))
    on_page = cut_lineage(placed.join(parts, "order_number").join(heroes, "page"))
    pick = F.struct("page", "image_id", "sha", "area")
    by_sub = on_page.groupBy("fam", "sub").agg(F.min_by(pick, "page").alias("s"))
    by_fam = on_page.groupBy("fam").agg(F.min_by(pick, "page").alias("f"))
    cascade = parts.join(by_sub, ["fam", "sub"], "left").join(by_fam, "fam", "left").withColumn("hero", F.coalesce("s", "f")).filter("hero is not null")
    cols = ["order_number", "page", "image_id", "sha", "area"]
    return (
        matched.select(*cols, F.lit("row_aligned").alias("method"), F.lit(False).alias("low_confidence"))
        .unionByName(on_page.select(*cols, F.lit("page_hero").alias("method"), F.col("ambiguous").alias("low_confidence")))
        .unionByName(
            cascade.select(
                "order_number", "hero.page", "hero.image_id", "hero.sha", "hero.area",
                F.when(F.col("s").isNotNull(), "family_hero").otherwise("family_hero_loose").alias("method"),
                F.lit(True).alias("low_confidence"),
            )
        )
    )


def method_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in METHODS]), c)


def best_assignment(proposals: DataFrame) -> DataFrame:
    """One image per order number: the better method, then the larger image."""
    ranked = proposals.withColumns({"_m": method_rank(F.col("method")), "_a": -F.col("area")})
    keep = [c for c in proposals.columns if c != "order_number"]
    return first_by(ranked, ["order_number"], ["_m", "_a", "page", "image_id"], keep)


def manifest(products: DataFrame, assigned: DataFrame, all_rows: DataFrame) -> DataFrame:
    """Every product row with its image, how it was matched, and the printed code of the image's page."""
    printed = first_by(all_rows, ["pdf_page"], ["ord"], ["source_page"]).select((F.col("pdf_page") + 1).alias("page"), F.col("source_page").alias("image_page"))
    out = products.join(assigned.select("order_number", "page", F.col("sha").alias("image"), "method", F.col("low_confidence").alias("_shaky")), "order_number", "left")
    return out.join(printed, "page", "left").withColumn("family_photo", F.col("image").isNotNull() & F.coalesce("_shaky", F.lit(False))).drop("_shaky")


def image_summary(products: DataFrame, assigned: DataFrame) -> DataFrame:
    """Rows and distinct images per match method; rows without an image count as ``none``."""
    joined = products.select("order_number").join(assigned.select("order_number", "sha", "method"), "order_number", "left")
    return joined.groupBy(F.coalesce("method", F.lit("none")).alias("method")).agg(
        F.count("*").alias("rows"), F.count_distinct("sha").alias("images")
    )
