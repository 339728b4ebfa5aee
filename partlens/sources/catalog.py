"""Catalog readers and writers: strict, null-honest, with errors that name file and line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partlens.functions.nulls import flatten_map, null_honest, rename_fields
from partlens.sources.schemas import (
    COMPETITOR,
    CROSSREF,
    FAMILY,
    PRODUCT,
    PRODUCT_IDENTITY,
    PRODUCT_NUMBERS,
    PRODUCT_TEXT,
    ROW_TYPES,
    complete,
)

# What an order number looks like, and the columns a family rollup must have.
ORDER_NUMBER = "^\\d{7}$"
FAMILY_REQUIRED = ["section", "category", "family", "product_variants", "accessory_rows", "n_pages", "pages"]
CONFIDENCE = ["high", "medium", "low"]


def _raw_product_ddl() -> str:
    """Everything as text first, so that a number typed as text and text typed as a number both survive."""
    text = [*PRODUCT_IDENTITY, *PRODUCT_TEXT, *PRODUCT_NUMBERS, "pdf_page", "occurrences"]
    return (
        ", ".join(f"{c} STRING" for c in text)
        + ", also_on_pages ARRAY<STRING>, other_specs MAP<STRING,STRING>, provenance MAP<STRING,STRING>, "
        "low_confidence ARRAY<STRING>"
    )


def product_problem() -> Column:
    """What is wrong with a product row's identity, or NULL."""
    shown = F.coalesce(F.col("order_number"), F.lit("nothing"))
    out = F.when(F.col("_bad_json"), "not valid JSON").when(
        F.col("order_number").isNull() | ~F.col("order_number").rlike(ORDER_NUMBER),
        F.concat(F.lit("order_number must be 7 digits, got "), shown),
    ).when(
        F.col("row_type").isNull() | ~F.col("row_type").isin(*ROW_TYPES),
        F.concat(F.lit("row_type must be one of " + "/".join(ROW_TYPES) + " for "), shown),
    )
    for name in ("category", "section", "source_page", "pdf_page"):
        out = out.when(F.col(name).isNull(), F.concat(F.lit(f"missing {name} for "), shown))
    return out


def parse_products(lines: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Typed products out of lines (``file``, ``line``, ``value``), with a ``problem`` column.

    Blank lines are skipped.  ``names`` renames the keys inside ``provenance``
    and the entries of ``low_confidence`` along with their fields.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    ddl = _raw_product_ddl() + ", _corrupt STRING"
    place = ["file", "line", *(["ord"] if "ord" in lines.columns else [])]
    raw = lines.filter(F.trim("value") != "").select(*place, F.from_json("value", ddl, options).alias("r"))
    rows = raw.select(
        *place,
        (F.col("r").isNull() | F.col("r._corrupt").isNotNull()).alias("_bad_json"),
        *[null_honest(F.col(f"r.{c}")).alias(c) for c in PRODUCT_IDENTITY],
        *[null_honest(F.col(f"r.{c}"), "double").cast("int").alias(c) for c in ("pdf_page", "occurrences")],
        F.coalesce(null_honest(F.col("r.also_on_pages"), "array"), F.array().cast("array<string>")).alias("also_on_pages"),
        *[null_honest(F.col(f"r.{c}")).alias(c) for c in PRODUCT_TEXT],
        *[null_honest(F.col(f"r.{c}"), "double").alias(c) for c in PRODUCT_NUMBERS],
        *[flatten_map(F.col(f"r.{c}")).alias(c) for c in ("other_specs", "provenance")],
        null_honest(F.col("r.low_confidence"), "array").alias("low_confidence"),
    )
    rows = rows.withColumn("occurrences", F.coalesce("occurrences", F.size("also_on_pages") + 1))
    rows = rows.withColumn("problem", product_problem()).drop("_bad_json")
    if names:
        rows = rename_fields(rows, names, ("provenance",), ("low_confidence",))
    return rows


def read_lines(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Text lines with their file, 1-based line number and ``ord``, the 0-based position over all files by path, read in splits.

    A row's place inside its split comes from row ids that grow by one; the lines
    before the split are a sum over one row per split.  So any split of the files
    gives the same numbers.  The sums go to every task, one row for each split that the
    driver plans, and no line is shuffled.  ``sep`` cuts lines there only.
    """
    reader = spark.read if sep is None else spark.read.option("lineSep", sep)
    rows = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    blocks = rows.groupBy("file", "block").agg(F.min("id").alias("first_id"), F.count("*").alias("lines"))
    # One row for each split of a file, in the order of the files.
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    starts = blocks.select("file", "block", "first_id", "lines", zero(F.sum("lines").over(before)).alias("before"), zero(F.sum("lines").over(inside)).alias("above"))
    return _placed(rows, starts)


def _placed(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """``rows`` (file, block, id, value) numbered by ``starts``, one row for each split; a split that was not counted fails the read."""
    numbered = rows.join(F.broadcast(starts), ["file", "block"], "left")
    place = F.col("id") - F.col("first_id")
    # Lines are counted first and read afterwards; should the cores, and so the splits, change between, no line is lost or misplaced in silence.
    counted = F.when(place.between(0, F.col("lines") - 1), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("splits changed while reading "), "file")).cast("boolean"))
    numbered = numbered.where(counted)
    # A mark of the encoding stands before the first line of a file.
    value = F.when((F.col("above") == 0) & (place == 0), F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    return numbered.select("file", (F.col("above") + place + 1).alias("line"), (F.col("before") + place).alias("ord"), value.alias("value"))


def read_catalog_jsonl(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """Strict product reader: any row with a bad identity fails the load with its file and line; ``ord`` is the row's position.

    The check is a filter over every row, so it costs no extra pass; use
    :func:`catalog_rejects` to list all bad rows instead.
    """
    rows = parse_products(read_lines(spark, path), names)
    message = F.concat_ws(":", "file", "line", "problem")
    # A filter: unlike a column it is not pruned when the caller reads other columns or only counts.
    checked = rows.where(F.when(F.col("problem").isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    out = checked.drop("file", "line", "problem")
    return out if names else complete(out, PRODUCT + ", ord BIGINT")


def catalog_rejects(spark: SparkSession, path: str) -> DataFrame:
    """File, line and problem of every row the strict reader would refuse."""
    return parse_products(read_lines(spark, path)).filter("problem is not null").select("file", "line", "problem")


def read_all_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows before de-duplication, as (order_number, row_type, section, pdf_page, source_page, ord).

    ``ord`` numbers the rows in file order for every later tie-break.
    """
    ddl = "order_number STRING, row_type STRING, section STRING, pdf_page INT, source_page STRING"
    lines = read_lines(spark, path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", ddl).alias("r"), "ord").select("r.*", "ord")


def read_families_csv(spark: SparkSession, path: str) -> DataFrame:
    """Family rollup: columns found by header, quoted fields and line breaks, ``;`` lists, counts as numbers."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8", inferSchema=False)
    clean = {c: c.replace("﻿", "").strip() for c in raw.columns}
    raw = raw.withColumnsRenamed({k: v for k, v in clean.items() if k != v})
    missing = [c for c in FAMILY_REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"{path}: missing required column(s) {', '.join(missing)}")
    text = {c: null_honest(F.col(c)) for c in raw.columns}

    def must(name: str, value: Column) -> Column:
        who = F.concat(F.lit(f"{path}: family row without a usable {name}: "), F.coalesce(text["family"], F.lit("?")))
        return F.coalesce(value, F.raise_error(who).cast("string"))

    rows = raw.select(
        *[must(c, text[c]).alias(c) for c in ("section", "category", "family")],
        *[
            must(c, null_honest(F.col(c), "double").cast("int").cast("string")).cast("int").alias(c)
            for c in ("product_variants", "accessory_rows", "n_pages")
        ],
        F.coalesce(
            F.filter(F.transform(F.split(text["pages"], ";"), lambda p: F.trim(p)), lambda p: p != ""),
            F.array().cast("array<string>"),
        ).alias("pages"),
        *([text["product_url"].alias("product_url")] if "product_url" in raw.columns else []),
    )
    return complete(rows, FAMILY)


def read_competitors(spark: SparkSession, path: str) -> DataFrame:
    """Lenient nested reader: rows without identity are dropped, nested entries without their key field too.

    ``ord`` keeps file order for ranking ties.
    """
    lines = read_lines(spark, path).filter(F.trim("value") != "")
    # Out of an array: filters on the fields are not pushed below it, where each would parse the line again.
    raw = lines.select(F.explode(F.array(F.from_json("value", COMPETITOR))).alias("r"), "ord").select("r.*", "ord")

    def keep(array: str, key: str) -> Column:
        kept = F.filter(array, lambda e: F.trim(e[key]) != "")
        return F.coalesce(kept, F.slice(F.col(array), 1, 0), F.array().cast(raw.schema[array].dataType))

    texts = [f.name for f in raw.schema.fields if f.dataType.simpleString() == "string"]
    rows = raw.withColumns({c: F.when(F.trim(c) != "", F.col(c)) for c in texts})
    rows = rows.filter("vendor is not null and product_category is not null and source_page is not null")
    empty = F.array().cast("array<string>")
    return rows.withColumns(
        {
            "sensing_modes": keep("sensing_modes", "mode"),
            "outputs": keep("outputs", "type"),
            "connections": keep("connections", "type"),
            "features": F.coalesce("features", empty),
            "low_confidence": F.coalesce("low_confidence", empty),
            "source_pages": F.when(F.size("source_pages") > 0, F.col("source_pages")).otherwise(F.array("source_page")),
        }
    )


def read_crossref(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """Judged equivalences: blanks are NULL, odd confidence words are NULL, rows without a mode are dropped.

    ``names`` maps the file's column names to those of the schema.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    raw = raw.withColumnsRenamed({k: v for k, v in (names or {}).items() if k in raw.columns})
    absent = {c.split()[0]: F.lit(None).cast("string") for c in CROSSREF.split(", ") if c.split()[0] not in raw.columns}
    raw = raw.withColumns(absent) if absent else raw
    blank = {c: null_honest(F.col(c)) for c in raw.columns}
    level = F.lower(blank["confidence"])
    rows = raw.select(
        *[blank[c].alias(c) for c in ("from_series", "from_model", "from_mode")],
        null_honest(F.col("from_range_max_mm"), "double").alias("from_range_max_mm"),
        *[blank[c].alias(c) for c in ("to_type_code", "to_order_number", "to_family")],
        F.coalesce(F.lower(blank["adequate"]) == "true", F.lit(False)).alias("adequate"),
        F.when(level.isin(*CONFIDENCE), level).alias("confidence"),
        F.coalesce("rationale", F.lit("")).alias("rationale"),
        F.coalesce(blank["source"], F.lit("")).alias("source"),
    )
    return rows.filter("from_mode is not null")


def read_enriched(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The enriched table as (products, accessories); two pushed-down filters on one source."""
    table = spark.read.parquet(path)
    return table.filter("row_type = 'product'"), table.filter("row_type = 'accessory'")


def write_pruned(df: DataFrame, drop: list[str], path: str) -> None:
    df.drop(*drop).write.mode("overwrite").parquet(path)


def write_catalog_view(view: DataFrame, path: str) -> None:
    """The slim view as JSON lines, one object per row."""
    view.write.mode("overwrite").json(path)
