"""Documents and chunks: one document per family, one card per family and per row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlens.functions.text import fold_print, keywords, number_text
from partlens.plans.scale import block_row_number, first_by, top_k

# Key of rows without a family, soft word limits of the cards.
NO_FAMILY = "(no family)"
ROW_CARD_WORDS, FAMILY_CARD_WORDS = 105, 170
SURFACE_ROWS = 40

Translate = Callable[[Column], Column]


def document_id(section: Column, family: Column) -> Column:
    return F.concat(F.lit("family:"), section, F.lit(":"), F.coalesce(family, F.lit(NO_FAMILY)))


def word_count(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\\s+")))


def clamp_words(c: Column, limit: int) -> Column:
    words = F.split(F.trim(c), "\\s+")
    return F.when(F.size(words) <= limit, F.trim(c)).otherwise(F.concat(F.array_join(F.slice(words, 1, limit), " "), F.lit(" …")))


def within_budget(lines: Column, limit: int, used: Column | int = 0) -> Column:
    """Lines in order until the word budget is reached; the line that crosses it is kept."""
    start = F.struct((used if isinstance(used, Column) else F.lit(used)).cast("int").alias("words"), F.array().cast("array<string>").alias("kept"))
    return F.aggregate(
        F.array_compact(lines),
        start,
        lambda s, line: F.when(s["words"] >= limit, s).otherwise(
            F.struct((s["words"] + word_count(line)).alias("words"), F.concat(s["kept"], F.array(line)).alias("kept"))
        ),
    )["kept"]


def _short(c: Column) -> Column:
    return number_text(c, 3)


def format_mm(c: Column) -> Column:
    """A length in every unit an engineer would type."""
    others = F.array_compact(
        F.array(
            F.when((c >= 10) & (c < 1000), F.concat(_short(c / 10), F.lit(" cm"))),
            F.when(c >= 100, F.concat(_short(c / 1000), F.lit(" m"))),
            F.when((c > 0) & (c < 1), F.concat(_short(c * 1000), F.lit(" µm"))),
        )
    )
    base = F.concat(_short(c), F.lit(" mm"))
    return F.when(F.size(others) > 0, F.concat(base, F.lit(" ("), F.array_join(others, " / "), F.lit(")"))).otherwise(base)


def format_temp(c: Column) -> Column:
    return F.concat(_short(c), F.lit(" °C ("), _short(F.floor(c * 9 / 5 + 32.5)), F.lit(" °F)"))


def _two_units(c: Column, unit: str, big: str, small: str | None = None) -> Column:
    base = F.concat(_short(c), F.lit(f" {unit}"))
    out = F.when(c >= 1000, F.concat(base, F.lit(" ("), _short(c / 1000), F.lit(f" {big})")))
    if small:
        out = out.when((c > 0) & (c < 1), F.concat(base, F.lit(" ("), _short(c * 1000), F.lit(f" {small})")))
    return out.otherwise(base)


def format_hz(c: Column) -> Column:
    return _two_units(c, "Hz", "kHz")


def format_ms(c: Column) -> Column:
    return _two_units(c, "ms", "s", "µs")


def format_ma(c: Column) -> Column:
    return _two_units(c, "mA", "A")


def format_range(low: Column, high: Column, fmt: Callable[[Column], Column]) -> Column:
    return (
        F.when(low == high, fmt(high))
        .when(low.isNotNull() & high.isNotNull(), F.concat(fmt(low), F.lit(" ... "), fmt(high)))
        .when(high.isNotNull(), F.concat(F.lit("≤ "), fmt(high)))
        .when(low.isNotNull(), F.concat(F.lit("≥ "), fmt(low)))
    )


def split_category(c: Column) -> Column:
    """struct<name, other>: a category and the translation printed in brackets behind it."""
    pattern = "^(.*?)\\s*\\(([^)]*)\\)\\s*$"
    has = c.rlike(pattern)
    return F.struct(
        F.when(has, F.trim(F.regexp_extract(c, pattern, 1))).otherwise(F.trim(c)).alias("name"),
        F.when(has, F.trim(F.regexp_extract(c, pattern, 2))).alias("other"),
    )


def _category_line(c: Column) -> Column:
    parts = split_category(c)
    return F.concat(parts["name"], F.coalesce(F.concat(F.lit(" ("), parts["other"], F.lit(")")), F.lit("")))


def _two_tongues(c: Column, translate: Translate | None) -> Column:
    text = F.nullif(F.trim(c), F.lit(""))
    if translate is None:
        return text
    return F.concat(text, F.coalesce(F.concat(F.lit(" — "), translate(text)), F.lit("")))


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(label + " "), value)


SURFACE = [
    "product_name", "short_description", "category", "sensor_principle", "detection_principle", "light_type",
    "connection", "housing_material", "scope_of_delivery", "switching_output", "interface",
]


def surface(specs: str = "other_specs") -> Column:
    """All printed text of a row, for the keyword triggers."""
    none = F.array().cast("array<string>")
    return F.concat_ws(
        " ; ", *SURFACE, F.coalesce(F.map_keys(specs), none), F.coalesce(F.map_values(specs), none)
    )


def row_card(translate: Translate | None = None, triggers: Sequence[tuple[str, Sequence[str]]] = ()) -> Column:
    """The search text of a catalog row: identity always, then facts while the word budget lasts."""
    c = F.col
    two = lambda name: _two_tongues(c(name), translate)
    stripped = F.regexp_replace("type_code", "[^A-Za-z0-9]", "")
    identity = F.concat_ws(
        " · ", "type_code", F.when((stripped != "") & (stripped != c("type_code")), stripped), "order_number",
        F.when(c("family").isNotNull(), F.concat_ws(" ", "family", "subfamily")),
        "row_type", "source_page",
    )
    accessory = c("row_type") == "accessory"
    required = F.array_compact(
        F.array(
            identity, two("product_name"),
            F.when(accessory, clamp_words(two("short_description"), 44)), _category_line(c("category")),
        )
    )
    joined = lambda *names: F.nullif(F.concat_ws(" · ", *[two(n) for n in names]), F.lit(""))
    volts = lambda v: F.concat(_short(v), F.lit(" V"))
    enclosure = F.nullif(
        F.concat_ws(" · ", F.trim("enclosure_rating"), _labelled("housing", two("housing_material"))), F.lit("")
    )
    entries = F.slice(F.map_entries("other_specs"), 1, 4)
    nothing = F.array().cast("array<string>")
    extra = F.coalesce(
        F.transform(
            F.filter(entries, lambda e: F.trim(e["value"]) != ""),
            lambda e: F.concat(
                _two_keys(e["key"], translate), F.lit(": "), clamp_words(_two_tongues(e["value"], translate), 16)
            ),
        ),
        nothing,
    )
    resolution = F.concat(_short(c("resolution_value")), F.coalesce(F.concat(F.lit(" "), c("resolution_unit")), F.lit("")))
    optional = F.concat(
        F.array(
            _labelled("sensing range", format_range(c("sensing_range_min_mm"), c("sensing_range_max_mm"), format_mm)),
            _labelled("output", joined("switching_output", "output_function")),
            _labelled("connection", two("connection")),
            _labelled("principle", joined("sensor_principle", "detection_principle")),
            _labelled("light", two("light_type")),
            _labelled("enclosure", enclosure),
            _labelled("supply voltage", format_range(c("supply_voltage_min_v"), c("supply_voltage_max_v"), volts)),
            _labelled("output current ≤", format_ma(c("output_current_max_ma"))),
            _labelled("response time", format_ms(c("response_time_ms"))),
            _labelled("switching frequency", format_hz(c("switching_frequency_hz"))),
            _labelled("operating temperature", format_range(c("operating_temp_min_c"), c("operating_temp_max_c"), format_temp)),
            _labelled("resolution", _two_tongues(resolution, translate)),
            F.when(c("row_type") == "product", clamp_words(two("short_description"), 30)),
            _labelled("interface", two("interface")),
            _labelled("light spot", two("light_spot")),
            _labelled("adjustment", two("adjustment")),
            _labelled("scope of delivery", clamp_words(two("scope_of_delivery"), 24)),
        ),
        extra,
        F.array("product_url"),
    )
    return _card(required, optional, ROW_CARD_WORDS, _keyword_line(keywords(surface(), triggers) if triggers else None))


def _two_keys(key: Column, translate: Translate | None) -> Column:
    if translate is None:
        return key
    return F.concat(key, F.coalesce(F.concat(F.lit(" / "), translate(key)), F.lit("")))


def _keyword_line(words: Column | None) -> Column:
    if words is None:
        return F.lit(None).cast("string")
    return F.when(F.size(words) > 0, F.concat(F.lit("keywords: "), F.array_join(words, ", ")))


def _card(required: Column, optional: Column, limit: int, last: Column) -> Column:
    used = F.aggregate(required, F.lit(0), lambda n, line: n + word_count(line))
    kept = within_budget(optional, limit, used)
    return F.array_join(F.concat(required, kept, F.array_compact(F.array(last))), "\n")


def top_distinct(df: DataFrame, group: Sequence[str], value: Column, n: int, name: str, ord_col: str = "ord") -> DataFrame:
    """Per group the ``n`` most frequent values, compared folded, shown as first spelled; one bounded array."""
    trimmed = F.trim(value)
    keyed = df.select(*group, ord_col, trimmed.alias("_shown"), fold_print(trimmed).alias("_key")).filter("_shown != ''")
    counted = keyed.groupBy(*group, "_key").agg(
        F.count("*").alias("_n"), F.min_by("_shown", ord_col).alias("_shown"), F.min(ord_col).alias("_first")
    )
    best = top_k(counted, group, [F.desc("_n"), F.asc("_first")], n)
    listed = F.array_sort(F.collect_list(F.struct("rank", "_shown")))
    return best.groupBy(*group).agg(F.transform(listed, lambda e: e["_shown"]).alias(name))


def envelope(df: DataFrame, group: Sequence[str], low: str, high: str) -> DataFrame:
    """Smallest low and largest high per group; a group without lows starts at its smallest high."""
    return df.groupBy(*group).agg(
        F.coalesce(F.min(low), F.min(high)).alias("low"), F.max(high).alias("high")
    ).filter("high is not null")


def family_rollup(products: DataFrame) -> DataFrame:
    """Variants, accessories and distinct pages of every (section, family)."""
    return products.groupBy("section", F.coalesce("family", F.lit(NO_FAMILY)).alias("family")).agg(
        F.count_if(F.col("row_type") == "product").cast("int").alias("product_variants"),
        F.count_if(F.col("row_type") == "accessory").cast("int").alias("accessory_rows"),
        F.count_distinct("source_page").cast("int").alias("n_pages"),
    )


def numbered_rows(products: DataFrame) -> DataFrame:
    """Rows with document_id and chunk_index: 1.. by page, then input order.

    Positions are counted in blocks of one page and 65,536 input positions, so
    a family holding a third of the catalog is numbered by many tasks.
    """
    rows = products.withColumn("document_id", document_id(F.col("section"), F.col("family")))
    blocks = [F.col("pdf_page"), F.shiftright("ord", 16)]
    placed = block_row_number(rows, ["document_id"], ["pdf_page", "ord"], blocks, "chunk_index")
    return placed.withColumn("chunk_index", F.col("chunk_index") + 1)


def family_cards(rows: DataFrame, families: DataFrame | None = None, translate: Translate | None = None,
                 triggers: Sequence[tuple[str, Sequence[str]]] = ()) -> DataFrame:
    """One card per document out of grouped facts; every list on it is a small top-n."""
    key = ["document_id"]
    head = first_by(rows, key, ["pdf_page", "ord"], ["section", "family", "category", "source_page", "pdf_page"])
    counts = rows.groupBy(*key).agg(
        F.count_if(F.col("row_type") == "product").alias("variants"),
        F.count_if(F.col("row_type") != "product").alias("accessories"),
        F.coalesce(F.min("sensing_range_min_mm"), F.min("sensing_range_max_mm")).alias("low"),
        F.max("sensing_range_max_mm").alias("high"),
        F.min_by("product_url", F.when(F.col("product_url").isNotNull(), F.struct("pdf_page", "ord"))).alias("row_url"),
    )
    code_head = F.regexp_extract("type_code", "^[A-Za-z]+[0-9]*", 0)
    lists = {
        "pages": (F.col("source_page"), 8),
        "names": (F.col("product_name"), 2),
        "subfamilies": (F.col("subfamily"), 8),
        "prefixes": (F.when(F.length(code_head) >= 2, code_head), 6),
        "sensors": (F.col("sensor_principle"), 3),
        "detections": (F.col("detection_principle"), 3),
        "lights": (F.col("light_type"), 3),
        "outputs": (F.col("switching_output"), 5),
        "connections": (F.col("connection"), 3),
        "ratings": (F.col("enclosure_rating"), 3),
        "housings": (F.col("housing_material"), 2),
    }
    out = head.join(counts, "document_id")
    for name, (value, n) in lists.items():
        out = out.join(top_distinct(rows, key, value, n, name, "chunk_index"), key, "left")
    if families is not None:
        rolled = families.select(document_id(F.col("section"), F.col("family")).alias("document_id"),
                                 F.col("pages").alias("roll_pages"), F.col("product_url").alias("roll_url"))
        out = out.join(rolled, key, "left")
    else:
        out = out.withColumns({"roll_pages": F.lit(None).cast("array<string>"), "roll_url": F.lit(None).cast("string")})
    none = F.array().cast("array<string>")
    many = lambda name: F.nullif(
        F.array_join(F.transform(F.coalesce(name, none), lambda v: _two_tongues(v, translate)), "; "), F.lit("")
    )
    plain = lambda name: F.nullif(F.array_join(F.coalesce(name, none), ", "), F.lit(""))
    pages = F.when(F.size("roll_pages") > 0, F.col("roll_pages")).otherwise(F.col("pages"))
    title = F.coalesce(
        F.concat("family", F.lit(" family")), F.concat(F.lit("section "), "section", F.lit(" shared parts, no family heading"))
    )
    header = F.concat_ws(
        " · ", title, _category_line(F.col("category")), F.concat(F.lit("section "), "section"),
        F.concat(F.lit("pages "), F.array_join(F.slice(F.coalesce(pages, none), 1, 8), ", ")),
        F.concat(F.col("variants"), F.lit(" variants, "), F.col("accessories"), F.lit(" accessories")),
    )
    required = F.array_compact(F.array(header, many("names")))
    principles = F.nullif(F.concat_ws("; ", many("sensors"), many("detections")), F.lit(""))
    optional = F.array(
        _labelled("subfamilies", plain("subfamilies")),
        _labelled("type codes", plain("prefixes")),
        _labelled("principles", principles),
        _labelled("light", many("lights")),
        _labelled("sensing range across the family", F.when(F.col("high").isNotNull(), format_range(F.col("low"), F.col("high"), format_mm))),
        _labelled("outputs", plain("outputs")),
        _labelled("connections", many("connections")),
        _labelled("enclosure", plain("ratings")),
        _labelled("housing", many("housings")),
        F.coalesce("roll_url", "row_url"),
    )
    if triggers:
        found = rows.filter(F.col("chunk_index") <= SURFACE_ROWS).groupBy(*key).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", surface().alias("t")))), lambda e: e["t"]), " ; ").alias("_surface")
        )
        out = out.join(found, key, "left")
        words = keywords(F.concat_ws(" ; ", "category", "_surface"), triggers, 12)
    else:
        words = None
    return out.select("document_id", "section", "family", "category", "source_page", "pdf_page",
                      _card(required, optional, FAMILY_CARD_WORDS, _keyword_line(words)).alias("text"))


def build_documents(products: DataFrame, families: DataFrame | None = None, translate: Translate | None = None,
                    triggers: Sequence[tuple[str, Sequence[str]]] = ()) -> DataFrame:
    """Chunks of every document: the family card first, then one row card per product in page order.

    ``products`` needs ``ord``, the input position.
    """
    rows = numbered_rows(products)
    none = F.lit(None).cast("string")
    cards = family_cards(rows, families, translate, triggers).select(
        F.col("document_id").alias("id"), F.lit("family").alias("kind"), "document_id", F.lit(0).alias("chunk_index"), "text",
        none.alias("order_number"), "family", "section", "category", none.alias("row_type"), "source_page", "pdf_page",
    )
    own = rows.select(
        F.concat(F.lit("sku:"), "order_number").alias("id"), F.lit("sku").alias("kind"), "document_id", "chunk_index",
        row_card(translate, triggers).alias("text"), "order_number", "family", "section", "category", "row_type",
        "source_page", "pdf_page",
    )
    return cards.unionByName(own)


def document_order(chunks: DataFrame, name: str = "place") -> DataFrame:
    """The documents of chunks with their 0-based place by section, then family; a document without a family comes last in its section."""
    documents = chunks.groupBy("document_id").agg(F.min("section").alias("section"), F.min("family").alias("family"))
    ordered = documents.withColumn("_last", F.col("family").isNull())
    # Places are counted per section and shifted by the documents of the sections before: one row for each section is ordered as a whole.
    inside = Window.partitionBy("section").orderBy("_last", "family", "document_id")
    counted = ordered.withColumn("_inside", F.row_number().over(inside) - 1)
    sizes = ordered.groupBy("section").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(F.col("section").alias("_section"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    out = counted.join(shifts, F.col("section").eqNullSafe(F.col("_section")))
    return out.select("document_id", "section", "family", (F.col("_inside") + F.col("_shift")).cast("int").alias(name))


def group_chunks(chunks: DataFrame, slice_rows: int = 1000) -> DataFrame:
    """The ordered chunk ids and texts of every document, in slices of bounded size.

    A document of up to ``slice_rows`` chunks is one row; a longer one is several,
    numbered in order, so no task collects a whole hot document.
    """
    sliced = chunks.withColumn("slice", F.floor(F.col("chunk_index") / slice_rows).cast("int"))
    listed = F.array_sort(F.collect_list(F.struct("chunk_index", "id", "text")))
    return sliced.groupBy("document_id", "slice").agg(listed.alias("_c")).select(
        "document_id", "slice", F.transform("_c", lambda c: c["id"]).alias("ids"), F.transform("_c", lambda c: c["text"]).alias("texts")
    )


def cite(results: DataFrame, chunks: DataFrame, products: DataFrame, families: DataFrame) -> DataFrame:
    """Citations of found chunks (item): row identity, and the family's link where the row has none."""
    c = chunks.select(F.col("id").alias("item"), "kind", "order_number", "section", "family", "source_page", "pdf_page")
    p = products.select("order_number", "type_code", "product_url")
    f = families.groupBy("section", "family").agg(F.min("product_url").alias("family_url"))
    out = results.join(c, "item").join(p, "order_number", "left").join(f, ["section", "family"], "left")
    return out.withColumn("product_url", F.coalesce("product_url", "family_url")).drop("family_url")
