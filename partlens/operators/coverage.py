"""Coverage, counts, de-duplication, disputes and trace summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType

from partlens.functions.text import number_text
from partlens.plans.scale import first_by

# Order of confidence levels from worst to best.
SEVERITY = ["low", "medium", "high"]


def is_stated(column: str, kind: DataType) -> Column:
    """Stated: not NULL, and not an empty list or blank text."""
    c = F.col(column)
    if isinstance(kind, ArrayType):
        return F.coalesce(F.size(c), F.lit(0)) > 0
    if isinstance(kind, StringType):
        return F.coalesce(F.trim(c) != "", F.lit(False))
    return c.isNotNull()


def _long(counts: DataFrame, names: Sequence[str], value: str) -> DataFrame:
    """One row per name out of a one-row table with a column per name."""
    cells = [F.struct(F.lit(n).alias("field"), F.col(f"_{i}").alias(value)) for i, n in enumerate(names)]
    keep = [c for c in counts.columns if not c.startswith("_")]
    return counts.select(*keep, F.inline(F.array(*cells)))


def coverage(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, total, stated, pct): one aggregate pass, whatever the number of fields."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    counts = df.agg(
        F.count("*").alias("total"),
        *[F.count_if(is_stated(f, kinds[f])).alias(f"_{i}") for i, f in enumerate(fields)],
    )
    pct = F.round(100 * F.try_divide(F.col("stated"), F.col("total")), 1)
    return _long(counts, fields, "stated").select("field", "total", "stated", pct.alias("pct"))


def coverage_with_source(view: DataFrame, fields: Sequence[str], prose: str = "prose") -> DataFrame:
    """(field, present, from_prose): how often a field is stated, and how often it was read from prose."""
    present = view.agg(*[F.count_if(F.col(f).isNotNull()).alias(f"_{i}") for i, f in enumerate(fields)])
    from_prose = view.agg(*[F.count_if(F.array_contains(prose, f)).alias(f"_{i}") for i, f in enumerate(fields)])
    return _long(present, fields, "present").join(_long(from_prose, fields, "from_prose"), "field")


def view_coverage(view: DataFrame, fields: Sequence[str], prose: str = "prose") -> DataFrame:
    """Totals of a solver view: solvable rows, rows with any prose field, distinct families."""
    solver_fields = F.array(*[F.lit(f) for f in fields])
    return view.agg(
        F.count("*").alias("sensing"),
        F.count_if(F.col("range_max_mm").isNotNull() & F.col("output").isNotNull()).alias("solvable"),
        F.count_if(F.arrays_overlap(F.col(prose), solver_fields)).alias("any_prose"),
        F.count_distinct("family").alias("families"),
    )


def coverage_lift(before: DataFrame, after: DataFrame, tracked: Sequence[tuple[str, str | None]]) -> DataFrame:
    """(field, baseline_field, before, after, pcts, lift) of enriched fields against their raw counterparts."""
    kinds_b = {f.name: f.dataType for f in before.schema.fields}
    kinds_a = {f.name: f.dataType for f in after.schema.fields}
    fields = [f for f, _ in tracked]
    raw = [F.count_if(is_stated(b, kinds_b[b])) if b else F.lit(0).cast("bigint") for _, b in tracked]
    counts_b = before.agg(F.count("*").alias("n"), *[c.alias(f"_{i}") for i, c in enumerate(raw)])
    counts_a = after.agg(*[F.count_if(is_stated(f, kinds_a[f])).alias(f"_{i}") for i, f in enumerate(fields)])
    names = F.create_map(*[x for f, b in tracked for x in (F.lit(f), F.lit(b).cast("string"))])
    joined = _long(counts_b, fields, "before").join(_long(counts_a, fields, "after"), "field")
    pct = lambda c: F.round(100 * F.try_divide(F.col(c), F.col("n")), 1)
    return joined.select(
        "field", F.element_at(names, F.col("field")).alias("baseline_field"), "before", "after",
        pct("before").alias("before_pct"), pct("after").alias("after_pct"), (F.col("after") - F.col("before")).alias("lift"),
    )


def count_by(df: DataFrame, column: str, missing: str | None = "unclassified") -> DataFrame:
    """(value, rows); NULLs are counted under ``missing``, or left out when it is None."""
    rows = df if missing else df.filter(F.col(column).isNotNull())
    value = F.coalesce(F.col(column).cast("string"), F.lit(missing)) if missing else F.col(column).cast("string")
    return rows.groupBy(value.alias("value")).agg(F.count("*").alias("rows"))


def dedup_first(df: DataFrame, key: str, order: Sequence[str], page: str) -> DataFrame:
    """The first row of every key, how often it occurs, and the other pages it is on.

    A partial aggregate: a key that holds a third of the rows combines map-side,
    and only its distinct pages travel.
    """
    keep = [c for c in df.columns if c != key]
    first = first_by(df, [key], order, keep)
    seen = df.groupBy(key).agg(F.count("*").alias("occurrences"), F.array_sort(F.collect_set(page)).alias("_pages"))
    joined = first.join(seen, key)
    return joined.withColumn("also_on_pages", F.array_except("_pages", F.array(page))).drop("_pages")


def id_coverage(expected: DataFrame, extracted: DataFrame, key: str, pattern: str | None = None, section: str | None = None) -> DataFrame:
    """Totals of a comparison of expected and extracted ids: missing, unexpected, repeated and malformed.

    With ``section`` (a column of both) a row per section; an id is compared within its section.
    """
    by = [section] if section else []
    e = expected.select(*by, F.col(key).cast("string").alias(key)).distinct().withColumn("_e", F.lit(1))
    x = extracted.select(*by, F.col(key).cast("string").alias(key)).groupBy(*by, key).agg(F.count("*").alias("_x"))
    both = e.join(x, [*by, key], "full_outer")
    bad = ~F.col(key).rlike(pattern) if pattern else F.lit(False)
    counted = both.groupBy(*by).agg(
        F.coalesce(F.sum("_x"), F.lit(0)).alias("rows_extracted") if by else F.sum("_x").alias("rows_extracted"),
        F.count("_x").alias("distinct_ids"),
        F.count("_e").alias("expected_ids"),
        F.count_if(F.col("_e").isNotNull() & F.col("_x").isNull()).alias("missing"),
        F.count_if(F.col("_e").isNull() & F.col("_x").isNotNull()).alias("unexpected"),
        F.coalesce(F.sum(F.when(F.col("_x") > 1, 1)), F.lit(0)).alias("repeated"),
        F.count_if(F.col("_x").isNotNull() & bad).alias("bad_ids"),
    )
    found = F.col("expected_ids") - F.col("missing")
    return counted.withColumn("coverage_pct", F.round(100 * F.try_divide(found, F.col("expected_ids")), 1))


def missing_ids(expected: DataFrame, extracted: DataFrame, key: str) -> DataFrame:
    return expected.select(key).distinct().join(extracted.select(key), key, "left_anti")


def spec_audit(described: DataFrame, disputes: DataFrame | None = None) -> DataFrame:
    """Per part: stated rows, disputed rows, rows below high confidence."""
    rows = described.filter("stated")
    if disputes is not None:
        marks = disputes.select("order_number", "field").distinct().withColumn("disputed", F.lit(True))
        rows = rows.join(marks, ["order_number", "field"], "left")
    else:
        rows = rows.withColumn("disputed", F.lit(None).cast("boolean"))
    return rows.groupBy("order_number").agg(
        F.count("*").alias("rows"),
        F.count_if(F.coalesce("disputed", F.lit(False))).alias("disputed"),
        F.count_if("low_confidence").alias("below_high"),
    )


def disputes(readings: DataFrame) -> DataFrame:
    """Every disputed (part, field) once, with the runs that read it.

    ``readings`` is (run_id, part_id, field, confidence, disputed, ord).
    """
    found = readings.filter("disputed").groupBy("part_id", "field").agg(
        F.min_by("confidence", "ord").alias("confidence"), F.array_sort(F.collect_set("run_id")).alias("runs")
    )
    return found


def flagged(readings: DataFrame) -> DataFrame:
    """Readings below high confidence, each (part, field) once as first read, with its severity rank."""
    below = readings.filter(F.col("confidence") != "high")
    first = first_by(below, ["part_id", "field"], ["ord"], ["confidence", "disputed"])
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("confidence")) - 1
    return first.withColumn("severity", rank.cast("int"))


def brand_coverage(rows: DataFrame, brand: str, document: str) -> DataFrame:
    """Per brand its documents, rows, share of all rows and rows per document."""
    per = rows.groupBy(F.col(brand).alias("brand")).agg(F.count_distinct(document).alias("documents"), F.count("*").alias("rows"))
    total = per.agg(F.sum("rows").alias("_all")).withColumn("_one", F.lit(1))
    joined = per.withColumn("_one", F.lit(1)).join(total, "_one")
    return joined.select(
        "brand", "documents", "rows",
        F.round(100 * F.try_divide(F.col("rows"), F.col("_all")), 1).alias("share_pct"),
        F.round(F.try_divide(F.col("rows"), F.col("documents")), 1).alias("rows_per_document"),
    )


def cited_lines(citations: DataFrame) -> DataFrame:
    """Quoted lines per document page: how many distinct ones, and how often they are used."""
    return citations.groupBy("doc_id", "page").agg(F.count_distinct("snippet").alias("lines"), F.count("*").alias("uses"))


def view_summary(view: DataFrame) -> DataFrame:
    """Totals of a catalog view with images."""
    with_image = F.count("image")
    return view.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("row_type") == "product").alias("products"),
        F.count_if(F.col("row_type") == "accessory").alias("accessories"),
        with_image.alias("with_image"),
        F.round(100 * F.try_divide(with_image, F.count("*")), 1).alias("coverage_pct"),
        F.count_if(F.col("image").isNotNull() & F.col("family_photo")).alias("family_photos"),
        F.count_distinct("category").alias("categories"),
    )


# Event types a trace summary counts apart.
TOOL_CALL, ATTACK, UPHELD = "tool.call", "challenger.attack", "upheld"


def _finite(c: Column) -> Column:
    value = c.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def trace_summary(events: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Per run: events, span in ms, tool calls, attacks and upheld ones.  Works on a batch and on a stream."""
    verdict = F.get_json_object("payload", "$.challenge.verdict")
    attack = F.col("type") == ATTACK
    at = _finite(F.col("at"))
    return events.groupBy(*keys).agg(
        F.count("*").alias("events"),
        F.coalesce(F.max(at) - F.min(at), F.lit(0.0)).alias("ms"),
        F.count_if(F.col("type") == TOOL_CALL).alias("tool_calls"),
        F.count_if(attack).alias("attacks"),
        F.count_if(attack & F.coalesce(verdict == UPHELD, F.lit(False))).alias("upheld"),
    )


def trace_counts(events: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return events.groupBy(*keys, "type").agg(F.count("*").alias("events"))


def faceted_filter(view: DataFrame, category: str | None = None, kind: str | None = None, only_images: bool = False,
                   text: str = "") -> DataFrame:
    """Rows of a catalog view by category, row type, image and a substring of their identity."""
    out = view
    if category:
        out = out.filter(F.col("category") == category)
    if kind:
        out = out.filter(F.col("row_type") == kind)
    if only_images:
        out = out.filter("image is not null")
    needle = text.strip().lower()
    if needle:
        parts = ["order_number", "type_code", "family", "subfamily", "name", "category"]
        stated = [F.nullif(F.col(c), F.lit("")) for c in parts]
        out = out.filter(F.contains(F.lower(F.concat_ws(" ", *stated)), F.lit(needle)))
    return out


def spec_list(rows: DataFrame, fields: Sequence[tuple[str, str, str | None]], specs: str = "other_specs") -> DataFrame:
    """Ordered labelled "value unit" entries of every row, then its open specs, and a headline.

    ``fields`` is (column, label, unit).  Low confidence marks fields on the
    row's list and every open spec.
    """

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    show = lambda f: number_text(F.col(f)) if kinds[f] in ("double", "float") else F.col(f).cast("string")
    entries = [
        F.struct(
            F.lit(label).alias("label"),
            (F.concat(show(f), F.lit(f" {unit}")) if unit else F.nullif(show(f), F.lit(""))).alias("value"),
            F.coalesce(F.array_contains("low_confidence", f), F.lit(False)).alias("low"),
        )
        for f, label, unit in fields
    ]
    open_specs = F.transform(
        F.map_entries(specs), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("value"), F.lit(True).alias("low"))
    )
    none = F.array().cast("array<struct<label:string,value:string,low:boolean>>")
    every = F.concat(F.array(*entries), F.coalesce(open_specs, none))
    headline = F.coalesce(
        F.concat(F.lit("≤ "), number_text(F.col("sensing_range_max_mm")), F.lit(" mm")), F.col("enclosure_rating"), F.col("connection")
    )
    return rows.withColumns({"specs": F.filter(every, lambda e: F.coalesce(e["value"] != "", F.lit(False))), "headline": headline})


def part_record(view: DataFrame, fields: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Long-form spec rows of a solver view; a field on the prose list has medium confidence."""
    kinds = {f.name: f.dataType.simpleString() for f in view.schema.fields}

    show = lambda f: number_text(F.col(f)) if kinds[f] in ("double", "float") else F.col(f).cast("string")
    cells = [
        F.when(
            F.col(f).isNotNull(),
            F.struct(F.lit(f).alias("field"), F.lit(label).alias("label"), show(f).alias("value"), F.lit(unit).alias("unit"),
                     F.when(F.array_contains("prose", f), "medium").otherwise("high").alias("confidence")),
        )
        for f, label, unit in fields
    ]
    return view.select("order_number", F.inline(F.array_compact(F.array(*cells))))


