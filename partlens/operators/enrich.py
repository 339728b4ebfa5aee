"""Enrichment: class, mode, mined specs, protocols, search text, provenance and coverage lift."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.functions.text import number_text, strip_accents
from partlens.functions.units import euro_number, extract_protocols, parse_ip, parse_mm, parse_ms, parse_temp_range

# Solution class of each catalog category, and the classes that are safety devices.
SOLUTION_CLASS = {
    "Fotocelulas (Photoelectric sensors)": "photoelectric",
    "Sensores de fluidos (Fluid sensors)": "fluid",
    "Dispositivos de proteccion optoelectronicos (Optoelectronic protective devices)": "safety_optoelectronic",
    "Sensores de proximidad (Proximity sensors)": "proximity",
    "Sensores de distancia (Distance sensors)": "distance",
    "Soluciones de identificacion (Identification)": "identification",
    "Sensores de registro (Registration/contrast sensors)": "registration",
    "Interruptores de seguridad (Safety switches)": "safety_switch",
    "Encoders": "encoder",
    "Sensores magneticos para cilindros (Magnetic cylinder sensors)": "magnetic_cylinder",
    "Soluciones de control de seguridad sens:Control (Safety control)": "safety_controller",
    "Rejillas fotoelectricas (Light grids)": "light_grid",
    "Vision (Vision)": "vision",
}
SAFETY_CLASSES = ["safety_optoelectronic", "safety_switch", "safety_controller", "light_grid"]
# Sensing mode of a stated principle.
PRINCIPLE_MODES = [
    ("fotocelula de deteccion sobre objeto", "diffuse"),
    ("barrera fotoelectrica de reflexion", "retroreflective"),
    ("barrera emisor-receptor", "opposed"),
    ("ultrasonidos", "ultrasonic"),
    ("tecnologia de ultrasonidos", "ultrasonic"),
    ("inductivos", "inductive"),
    ("capacitivos", "capacitive"),
]
# Fixed values: (solution class or None for any, column, pattern, mode).  The first rule that holds wins.
MODE_RULES = [
    (None, "name", "ultrasonid", "ultrasonic"),
    ("photoelectric", "name", "emisor-receptor|barrera unidireccional", "opposed"),
    ("photoelectric", "name", "reflexion", "retroreflective"),
    ("photoelectric", "name", "deteccion sobre objeto|difus", "diffuse"),
    ("photoelectric", "type", "^W[SE]\\d", "opposed"),
    ("photoelectric", "type", "^WL\\d", "retroreflective"),
    ("photoelectric", "type", "^(WT|GT)", "diffuse"),
    ("proximity", "name", "inductiv", "inductive"),
    ("proximity", "name", "capacitiv", "capacitive"),
    ("proximity", "type", "^(IM|IQ|IME)", "inductive"),
    ("proximity", "type", "^CM", "capacitive"),
    ("registration", "name", "horquilla", "fork"),
    ("registration", "name", "contraste", "contrast"),
    ("registration", "name", "luminescen", "luminescence"),
    ("registration", "name", "color", "color"),
    ("registration", "type", "^(WF|WFM)", "fork"),
    ("registration", "type", "^(KT|KTM)", "contrast"),
    ("distance", "type", "^(UM|UC)", "ultrasonic"),
    ("distance", "name", "hddm|tiempo de vuelo", "laser_tof"),
    ("distance", "type", "^(OD)", "laser_triangulation"),
    ("distance", "type", "^(D[XLST]|DT|DL)", "laser_tof"),
    ("identification", "name", "camara|basado en camara", "camera"),
    ("identification", "name", "codigos de barras|escaner|lector", "barcode_laser"),
    ("identification", "name", "rfid", "rfid"),
    ("encoder", "name", "incremental", "encoder_incremental"),
    ("encoder", "name", "absolut", "encoder_absolute"),
    ("encoder", "name", "cable", "encoder_wire_draw"),
    ("safety_optoelectronic", "name", "cortina", "safety_light_curtain"),
    ("safety_optoelectronic", "name", "multihaz", "safety_multibeam"),
    ("safety_optoelectronic", "name", "monohaz", "safety_single_beam"),
    ("safety_optoelectronic", "name", "escaner laser|laser de seguridad", "safety_laser_scanner"),
    ("magnetic_cylinder", "name", "", "magnetic"),
]
MEASURAND_RULES = [
    ("fluid", "name", "nivel", "level"),
    ("fluid", "name", "presion", "pressure"),
    ("fluid", "name", "temperatura", "temperature"),
    ("fluid", "name", "caudal|flujo", "flow"),
    ("fluid", "type", "^(LF|UP|MHF)", "level"),
    ("fluid", "type", "^(PB)", "pressure"),
    ("fluid", "type", "^(TB)", "temperature"),
]


def _as_text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _first_int(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "\\d+", 0), F.lit("")).cast("int")


@dataclass(frozen=True)
class Miner:
    """A label pattern, the field it fills and the parser of its value."""

    label: str
    field: str
    parse: Callable[[Column], Column] = _as_text
    kind: str = "string"


# Labels of the open spec list and the typed fields they fill.
MINERS = [
    Miner("^tipo de montaje$", "mounting_type"),
    Miner("^(carcasa|forma de la carcasa|dise[ñn]o de la carcasa)$", "housing_form"),
    Miner("^conexi[óo]n a proceso$", "process_connection"),
    Miner("^longitud de sonda$", "probe_length_mm", parse_mm, "double"),
    Miner("^presi[óo]n de proceso$", "process_pressure_raw"),
    Miner("^(campo de medici[óo]n|alcance|alcance l[íi]mite)$", "measuring_range_raw"),
    Miner("^altura del campo de protecci[óo]n$", "protective_field_height_mm", parse_mm, "double"),
    Miner("^n[úu]mero de haces$", "beam_count", _first_int, "int"),
    Miner("^se[ñn]al de salida$", "output_signal"),
    Miner("^(ancho de horquilla)$", "fork_width_mm", parse_mm, "double"),
    Miner("^(profundidad de horquilla)$", "fork_depth_mm", parse_mm, "double"),
    Miner("^ventana de lectura$", "reading_window_raw"),
    Miner("^enfoque$", "focus"),
    Miner("^di[áa]metro del eje$", "shaft_diameter_raw"),
    Miner("^junta$", "seal_material"),
]
AMBIENT_LABEL = "temperatura ambiente|temperatura de servicio|temperatura de funcionamiento"
RESPONSE_LABEL = "^tiempo de respuesta$"
RESOLUTION_LABEL = "^resoluci[óo]n$"
PROCESS_TEMP_LABEL = "^temperatura de proceso$"
RANGE_LABELS = ["Distancia de detección", "Distancia de conmutación Sn"]
SPEC_SOURCE = "other_specs"


def mined(specs: Column, label: str, parse: Callable[[Column], Column]) -> Column:
    """struct<value, why> of the first entry whose label matches and whose value parses."""
    entries = F.filter(F.map_entries(specs), lambda e: F.trim(e["key"]).rlike("(?iu)" + label))
    parsed = F.transform(
        entries,
        lambda e: F.struct(
            parse(e["value"]).alias("value"),
            F.concat(F.lit(SPEC_SOURCE + "["), e["key"], F.lit("]: "), e["value"]).alias("why"),
        ),
    )
    return F.try_element_at(F.filter(parsed, lambda p: p["value"].isNotNull()), F.lit(1))


def mine_map(df: DataFrame, specs: str, miners: Sequence[Miner] = MINERS) -> DataFrame:
    """Typed columns out of an open map column, with ``<field>_why`` naming the entry used.

    A narrow projection: the rules are few, the entries of a row are already together.
    """
    found = df.withColumns({f"_{m.field}": mined(F.col(specs), m.label, m.parse) for m in miners})
    out = found.withColumns(
        {
            **{m.field: F.col(f"_{m.field}.value").cast(m.kind) for m in miners},
            **{f"{m.field}_why": F.col(f"_{m.field}.why") for m in miners},
        }
    )
    return out.drop(*[f"_{m.field}" for m in miners])


def solution_class(category: Column, table: dict[str, str] | None = None) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in (table or SOLUTION_CLASS).items() for x in pair])
    return F.try_element_at(lookup, category)


def _rule_chain(rules: list[tuple], klass: Column, name: Column, code: Column) -> Column:
    """struct<value, why> of the first rule that holds."""
    out = None
    for wanted, column, pattern, value in rules:
        text = name if column == "name" else code
        hit = text.rlike(pattern)
        if wanted is not None:
            hit = (klass == wanted) & hit
        why = f"{column} matches {pattern}" if pattern else f"class {wanted}"
        entry = F.struct(F.lit(value).alias("value"), F.lit(why).alias("why"))
        out = F.when(hit, entry) if out is None else out.when(hit, entry)
    return out


def _loose(c: Column) -> Column:
    return F.lower(strip_accents(F.coalesce(c, F.lit(""))))


def _name_text() -> Column:
    return F.concat_ws(" ", *[_loose(F.col(c)) for c in ("product_name", "short_description", "family")])


def derive_mode(klass: Column) -> Column:
    """struct<value, why>: the stated principle, else words of the name, else the code prefix per class."""
    stated = _loose(F.col("sensor_principle"))
    by_principle = None
    why = F.concat(F.lit("sensor_principle: "), F.col("sensor_principle"))
    for words, mode in PRINCIPLE_MODES:
        entry = F.struct(F.lit(mode).alias("value"), why.alias("why"))
        hit = F.contains(stated, F.lit(words))
        by_principle = F.when(hit, entry) if by_principle is None else by_principle.when(hit, entry)
    code = F.upper(F.coalesce("type_code", F.lit("")))
    return F.coalesce(by_principle, _rule_chain(MODE_RULES, klass, _name_text(), code))


def derive_measurand(klass: Column) -> Column:
    return _rule_chain(MEASURAND_RULES, klass, _name_text(), F.upper(F.coalesce("type_code", F.lit(""))))


BLOB_COLUMNS = [
    "product_name", "short_description", "family", "subfamily", "type_code", "category",
    "sensor_principle", "detection_principle", "light_type", "connection",
]


def search_blob(specs: str = SPEC_SOURCE) -> Column:
    """All searchable text of a row, folded, parts separated by a bar; blanks left out."""
    none = F.array().cast("array<string>")
    parts = F.concat(
        F.array(*[F.col(c) for c in BLOB_COLUMNS]),
        F.coalesce(F.map_keys(specs), none),
        F.coalesce(F.map_values(specs), none),
    )
    stated = F.filter(parts, lambda p: F.trim(p) != "")
    return F.lower(strip_accents(F.array_join(stated, " | ")))


def fallback_fill(df: DataFrame) -> DataFrame:
    """Fill temperature, response, resolution, range and safety resolution from the spec list; never overwrite."""
    specs = F.col(SPEC_SOURCE)
    step = df.withColumns(
        {
            "_temp": F.when(F.col("operating_temp_min_c").isNull(), mined(specs, AMBIENT_LABEL, parse_temp_range)),
            "_process": mined(specs, PROCESS_TEMP_LABEL, parse_temp_range),
            "_response": F.when(F.col("response_time_ms").isNull(), mined(specs, RESPONSE_LABEL, parse_ms)),
            "_resolution": F.when(F.col("resolution_value").isNull(), mined(specs, RESOLUTION_LABEL, lambda v: v)),
        }
    )
    mined_range = F.coalesce(parse_mm(F.col("measuring_range_raw")), *[parse_mm(F.try_element_at(specs, F.lit(k))) for k in RANGE_LABELS])
    step = step.withColumns(
        {
            "process_temp_min_c": F.col("_process.value.min"),
            "process_temp_max_c": F.col("_process.value.max"),
            "operating_temp_min_c": F.coalesce("operating_temp_min_c", "_temp.value.min"),
            "operating_temp_max_c": F.coalesce("_temp.value.max", "operating_temp_max_c"),
            "response_time_ms": F.coalesce("response_time_ms", "_response.value"),
            "resolution_value": F.coalesce(number_text(F.col("resolution_value")), "_resolution.value"),
            "_range": F.when(F.col("sensing_range_max_mm").isNull(), mined_range),
        }
    )
    resolution = F.col("resolution_value")
    bare = F.when(resolution.rlike("^\\s*\\d+([.,]\\d+)?\\s*$"), euro_number(resolution))
    return step.withColumns(
        {
            "safety_resolution_mm": F.when(
                F.col("solution_class") == "safety_optoelectronic", F.coalesce(parse_mm(resolution), bare)
            ),
            "sensing_range_max_mm": F.coalesce("sensing_range_max_mm", "_range"),
        }
    )


def enrich(products: DataFrame, classes: dict[str, str] | None = None, miners: Sequence[Miner] = MINERS) -> DataFrame:
    """The whole enrichment as one narrow projection chain; accessory links are a separate join."""
    klass = solution_class(F.col("category"), classes)
    base = products.withColumn("solution_class", klass)
    base = base.withColumns(
        {
            "is_safety_product": F.coalesce(F.col("solution_class").isin(*SAFETY_CLASSES), F.lit(False)),
            "_mode": derive_mode(F.col("solution_class")),
            "_measurand": derive_measurand(F.col("solution_class")),
            "_ip": parse_ip(F.col("enclosure_rating"), "best_axis"),
        }
    )
    base = fallback_fill(mine_map(base, SPEC_SOURCE, miners))
    none = F.array().cast("array<string>")
    sources = F.concat(
        F.array("interface", "output_signal", "connection"), F.coalesce(F.map_values(SPEC_SOURCE), none)
    )
    base = base.withColumns(
        {
            "sensing_mode": F.col("_mode.value"),
            "measurand": F.col("_measurand.value"),
            "ip_ingress": F.col("_ip.solid"),
            "ip_water": F.col("_ip.liquid"),
            "washdown_capable": F.col("_ip.washdown"),
            "protocols": extract_protocols(sources),
            "search_blob": search_blob(),
        }
    )
    why = {
        "solution_class": F.concat(F.lit("category: "), F.when(F.col("solution_class").isNotNull(), F.col("category"))),
        "sensing_mode": F.col("_mode.why"),
        "measurand": F.col("_measurand.why"),
        "ip_rating": F.when(F.col("_ip").isNotNull(), F.concat(F.lit("enclosure_rating: "), "enclosure_rating")),
        **{m.field: F.col(f"{m.field}_why") for m in miners},
        "process_temp": F.col("_process.why"),
        "operating_temp": F.col("_temp.why"),
        "response_time_ms": F.col("_response.why"),
        "resolution_value": F.col("_resolution.why"),
        "safety_resolution_mm": F.when(
            F.col("safety_resolution_mm").isNotNull(), F.concat(F.lit("resolution_value: "), "resolution_value")
        ),
        "sensing_range_max_mm": F.when(F.col("_range").isNotNull(), F.lit("mined from the spec list")),
        "protocols": F.when(F.size("protocols") > 0, F.lit("matched in interface, output signal or spec list")),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in why.items()])
    derived = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    helpers = [c for c in base.columns if c.startswith("_")] + [f"{m.field}_why" for m in miners]
    return base.withColumn("derived_from", derived).drop(*helpers)


# Enriched field and the raw field it is compared with in the lift report.
TRACKED = [
    ("sensing_mode", "sensor_principle"),
    ("sensing_range_max_mm", "sensing_range_max_mm"),
    ("ip_ingress", "enclosure_rating"),
    ("protocols", "interface"),
    ("mounting_type", None),
    ("housing_form", None),
    ("process_connection", None),
    ("process_temp_min_c", None),
    ("operating_temp_min_c", "operating_temp_min_c"),
    ("protective_field_height_mm", None),
    ("measuring_range_raw", None),
    ("response_time_ms", "response_time_ms"),
    ("resolution_value", "resolution_value"),
    ("measurand", None),
    ("solution_class", None),
]
