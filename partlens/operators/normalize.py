"""Printed catalog text to typed, comparable columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.functions.text import field_key, fold, let
from partlens.functions.units import parse_ip

# The words the catalog prints, on folded text.
ANALOG_RANGE = "\\d+(?:[.,]\\d+)?\\s*(?:ma|v)\\s*(?:\\.{2,}|…)\\s*\\d+(?:[.,]\\d+)?\\s*(?:ma|v)"
FOOTNOTE = "\\s*\\d+\\)"
OUTPUT_TOKENS = "pnp|npn|contrafase|rele|relay|conmutador"
MAX_OUTPUTS = 8
PINS = "(\\d+)\\s*(?:polos|polo|pines|pin)\\b"
MIN_PINS, MAX_PINS = 2, 12
SENSOR_PRINCIPLES = [
    ("ultrasonid", "ultrasonic"),
    ("inductiv", "inductive"),
    ("capacitiv", "capacitive"),
    ("emisor-receptor|emisor receptor", "through-beam"),
    ("reflexion", "retroreflective"),
    ("deteccion sobre objeto", "diffuse"),
]
DETECTION_PRINCIPLES = [
    ("supresion del fondo", "background-suppression"),
    ("supresion del primer plano", "foreground-suppression"),
    ("autocolimacion", "retroreflective"),
    ("lente doble|doble lente", "retroreflective"),
    ("energetica", "diffuse"),
    ("inductiv", "inductive"),
]
CATEGORY_PRINCIPLES = [
    ("encoder", "encoder"),
    ("vision", "vision"),
    ("identificacion", "identification"),
    ("fluidos", "fluid"),
    ("interruptores de seguridad", "safety-switch"),
    ("control de seguridad", "safety-controller"),
    ("rejillas fotoelectricas", "light-grid"),
    ("magneticos para cilindros", "magnetic"),
]
HOUSINGS = [
    ("inoxidable|1\\.4\\d{3}|\\b3(?:04|16)l?\\b", "stainless-steel"),
    ("aluminio|metal|laton|acero|cinc|zinc", "metal"),
    ("plastico|abs|pbt|pvdf|pmma|ppsu|pei|pom|tpu", "plastic"),
]


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The value of the first rule whose pattern occurs in the text."""
    out = None
    for pattern, value in rules:
        hit = text.rlike(pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def _first_group(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def parse_output(c: Column) -> Column:
    """struct<type, count, current_ma, io_link> of a switching-output text."""
    return let(fold(F.regexp_replace(c, FOOTNOTE, "")), _output_of)


def _output_of(text: Column) -> Column:
    pnp, npn = F.contains(text, F.lit("pnp")), F.contains(text, F.lit("npn"))
    kind = (
        F.when(F.contains(text, F.lit("contrafase")), "push-pull")
        .when(text.rlike("\\brele\\b|\\brelay\\b"), "relay")
        .when(pnp & npn, "PNP/NPN")
        .when(pnp, "PNP")
        .when(npn, "NPN")
        .when(text.rlike(ANALOG_RANGE), "analog")
    )
    outside_ranges = F.regexp_replace(text, ANALOG_RANGE, " ")
    current = F.regexp_replace(_first_group(outside_ranges, "(\\d+(?:[.,]\\d+)?)\\s*ma\\b"), ",", ".").cast("double")
    before = F.when(text.rlike(OUTPUT_TOKENS), F.regexp_extract(text, f"^(.*?)(?:{OUTPUT_TOKENS})", 1))
    numbers = F.array_distinct(F.regexp_extract_all(before, F.lit("\\d+"), F.lit(0)))
    only = F.when(F.size(numbers) == 1, F.try_element_at(numbers, F.lit(1)).try_cast("int"))
    return F.struct(
        kind.alias("type"),
        F.when(only.between(1, MAX_OUTPUTS), only).alias("count"),
        current.alias("current_ma"),
        F.when(text.rlike("io-?link"), F.lit(True)).alias("io_link"),
    )


def parse_connection(c: Column) -> Column:
    """struct<connector, pins>; two different threads say nothing."""
    return let(fold(c), _connection_of)


def _connection_of(text: Column) -> Column:
    threads = F.array_distinct(F.regexp_extract_all(text, F.lit("\\bm(5|8|12)\\b"), F.lit(1)))
    pins = F.array_distinct(F.regexp_extract_all(text, F.lit(PINS), F.lit(1)))
    pin = F.when(F.size(pins) == 1, F.try_element_at(pins, F.lit(1)).try_cast("int"))
    connector = (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(None))
        .when(F.size(threads) > 1, F.lit(None))
        .when(F.size(threads) == 1, F.concat(F.lit("M"), F.try_element_at(threads, F.lit(1))))
        .when(text.rlike("borne|terminal"), "terminal")
        .when(F.contains(text, F.lit("cable")), "cable")
        .otherwise("other")
    )
    return F.struct(
        connector.alias("connector"),
        F.when((F.size(threads) == 1) & pin.between(MIN_PINS, MAX_PINS), pin).alias("pins"),
    )


def parse_principle(sensor: Column, detection: Column, category: Column, row_type: Column) -> Column:
    """struct<principle, source>: the sensor text first, refined by the detection text, the category last."""
    rule = lambda c, rules: let(fold(c), lambda text: first_match(text, rules))
    by_category = F.when(row_type == "product", rule(category, CATEGORY_PRINCIPLES))
    found = F.struct(
        rule(sensor, SENSOR_PRINCIPLES).alias("sensor"),
        rule(detection, DETECTION_PRINCIPLES).alias("detection"),
        by_category.alias("category"),
    )
    return let(found, _principle_of)


def _principle_of(found: Column) -> Column:
    by_sensor, by_detection, by_category = found["sensor"], found["detection"], found["category"]
    suppression = by_detection.isin("background-suppression", "foreground-suppression")
    use_detection = by_detection.isNotNull() & (by_sensor.isNull() | ((by_sensor == "diffuse") & suppression))
    principle = F.when(use_detection, by_detection).otherwise(F.coalesce(by_sensor, by_category))
    source = (
        F.when(use_detection, "detection_principle")
        .when(by_sensor.isNotNull(), "sensor_principle")
        .when(by_category.isNotNull(), "category")
    )
    return F.struct(principle.alias("principle"), source.alias("source"))


def parse_housing(c: Column) -> Column:
    return let(fold(c), lambda text: first_match(text, HOUSINGS))


def parse_light(c: Column) -> Column:
    """Laser, then infrared, then one colour; several colours are rgb or nothing."""
    return let(fold(c), _light_of)


def _light_of(text: Column) -> Column:
    red, green, blue, white = (F.contains(text, F.lit(w)) for w in ("roj", "verde", "azul", "blanc"))
    colours = sum((x.cast("int") for x in (green, blue, white)), red.cast("int"))
    return (
        F.when(F.contains(text, F.lit("laser")), "laser")
        .when(F.contains(text, F.lit("infrarroj")), "infrared")
        .when(red & green & blue, "rgb")
        .when(colours > 1, F.lit(None))
        .when(red, "red")
        .when(green, "green")
        .when(white, "white")
        .when(text.rlike("\\buv\\b"), "other")
    )


PASS_THROUGH = [
    "sensing_range_min_mm", "sensing_range_max_mm", "response_time_ms", "switching_frequency_hz",
    "supply_voltage_min_v", "supply_voltage_max_v", "operating_temp_min_c", "operating_temp_max_c",
]


def normalize_spec(products: DataFrame) -> DataFrame:
    """One normalized spec row per product row; a narrow projection of the catalog table."""
    parsed = products.select(
        "order_number",
        F.col("low_confidence").alias("_flags"),
        parse_output(F.col("switching_output")).alias("_out"),
        F.col("output_current_max_ma").alias("_current"),
        parse_connection(F.col("connection")).alias("_conn"),
        parse_ip(F.col("enclosure_rating"), "worst").alias("_ip"),
        parse_principle(*(F.col(c) for c in ("sensor_principle", "detection_principle", "category", "row_type"))).alias("_principle"),
        parse_housing(F.col("housing_material")).alias("housing"),
        parse_light(F.col("light_type")).alias("light"),
        *PASS_THROUGH,
    ).select(
        "order_number",
        "_flags",
        F.col("_out.type").alias("output_type"),
        F.col("_out.io_link").alias("io_link"),
        F.col("_out.count").alias("output_count"),
        F.coalesce("_current", "_out.current_ma").alias("output_current_max_ma"),
        F.col("_current").isNotNull().alias("_own_current"),
        F.col("_conn.connector").alias("connector"),
        F.col("_conn.pins").alias("connector_pins"),
        F.col("_ip.ip").alias("ip_rating"),
        F.col("_ip.ip69k").alias("ip69k"),
        *PASS_THROUGH,
        F.col("_principle.principle").alias("principle"),
        F.col("_principle.source").alias("principle_source"),
        "housing",
        "light",
    )
    flags = F.transform("_flags", lambda f: field_key(f))

    def flagged(field: str, source: str | Column) -> Column:
        key = F.lit(source.replace("_", "")) if isinstance(source, str) else field_key(source)
        return F.when(F.col(field).isNotNull() & F.array_contains(flags, key), F.lit(field))

    current_source = F.when(F.col("_own_current"), "output_current_max_ma").otherwise("switching_output")
    principle = F.when(F.col("principle_source") == "category", F.lit("principle")).otherwise(
        flagged("principle", F.col("principle_source"))
    )
    marks = [
        flagged("output_type", "switching_output"),
        flagged("io_link", "switching_output"),
        flagged("output_count", "switching_output"),
        flagged("output_current_max_ma", current_source),
        flagged("connector", "connection"),
        flagged("connector_pins", "connection"),
        flagged("ip_rating", "enclosure_rating"),
        flagged("ip69k", "enclosure_rating"),
        *[flagged(c, c) for c in PASS_THROUGH],
        principle,
        flagged("housing", "housing_material"),
        flagged("light", "light_type"),
    ]
    return parsed.withColumn("low_confidence", F.array_compact(F.array(*marks))).drop("_flags", "_own_current")


def solver_view(products: DataFrame, categories: list[str]) -> DataFrame:
    """Products of the sensing categories with their own coarser normalization and the prose flags that apply."""
    up = F.upper("switching_output")
    low_conn = F.lower("connection")
    pins = F.coalesce(_first_group(low_conn, "(\\d+)\\s*polos"), F.lit("4"))
    hay = F.lower(F.concat_ws(" ", "detection_principle", "sensor_principle", "product_name"))
    view = products.filter(
        (F.col("row_type") == "product")
        & F.col("category").isin(*categories)
        & F.col("type_code").isNotNull()
        & F.col("order_number").isNotNull()
    ).select(
        "order_number",
        "type_code",
        "family",
        "category",
        F.col("product_name").alias("name"),
        F.col("source_page").alias("page"),
        "pdf_page",
        F.col("sensing_range_max_mm").alias("range_max_mm"),
        F.col("sensing_range_min_mm").alias("range_min_mm"),
        F.col("response_time_ms").alias("response_ms"),
        F.col("switching_frequency_hz").alias("switching_hz"),
        F.col("operating_temp_min_c").alias("temp_min_c"),
        F.col("operating_temp_max_c").alias("temp_max_c"),
        F.col("supply_voltage_min_v").alias("supply_min_v"),
        F.col("supply_voltage_max_v").alias("supply_max_v"),
        F.when(F.contains(up, F.lit("PNP")) & F.contains(up, F.lit("NPN")), "PNP/NPN")
        .when(F.contains(up, F.lit("PNP")), "PNP")
        .when(F.contains(up, F.lit("NPN")), "NPN")
        .alias("output"),
        F.when(F.contains(low_conn, F.lit("m12")), F.concat(F.lit("M12 "), pins, F.lit("-pin")))
        .when(F.contains(low_conn, F.lit("m8")), F.concat(F.lit("M8 "), pins, F.lit("-pin")))
        .when(F.contains(low_conn, F.lit("cable")), "Cable")
        .alias("connection"),
        parse_ip(F.col("enclosure_rating"), "first")["ip"].alias("ip_rating"),
        F.when(hay.rlike("supresi[óo]n de fondo"), "background-suppression")
        .when(hay.rlike("energ[ée]tica"), "energetic")
        .when(hay.rlike("r[ée]flex"), "retroreflective")
        .when(F.contains(hay, F.lit("barrera")), "through-beam")
        .alias("principle"),
        "light_type",
        F.col("housing_material").alias("housing"),
        "output_function",
        "low_confidence",
    )
    names = F.create_map(*[F.lit(x) for pair in VIEW_NAMES.items() for x in pair])
    stored = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in sorted(set(VIEW_NAMES.values()))]))
    prose = F.array_sort(F.array_distinct(F.array_compact(F.transform("low_confidence", lambda f: F.try_element_at(names, f)))))
    kept = F.coalesce(F.array_intersect(prose, stored), F.array().cast("array<string>"))
    return view.withColumn("prose", kept).drop("low_confidence")


# Catalog field behind each column of the solver view.
VIEW_NAMES = {
    "sensing_range_max_mm": "range_max_mm",
    "sensing_range_min_mm": "range_min_mm",
    "switching_output": "output",
    "connection": "connection",
    "enclosure_rating": "ip_rating",
    "response_time_ms": "response_ms",
    "switching_frequency_hz": "switching_hz",
    "operating_temp_min_c": "temp_min_c",
    "operating_temp_max_c": "temp_max_c",
    "supply_voltage_min_v": "supply_min_v",
    "supply_voltage_max_v": "supply_max_v",
    "output_function": "output_function",
    "light_type": "light_type",
    "housing_material": "housing",
    "sensor_principle": "principle",
    "detection_principle": "principle",
    "product_name": "name",
}
