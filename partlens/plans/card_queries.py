"""Cards of whole documents, every line of them, beside the same cards in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from partlens.operators import chunks as C
from partlens.plans import tables as T
from partlens.plans.registry import query
from partlens.sources.schemas import PRODUCT, complete

TRIGGERS = [("red", ["rot", "Rojo"]), ("laser", ["beam"]), ("screw", ["fixing", "rojo"]), ("mini", ["small"])]
SURFACE = ["product_name", "short_description", "category", "sensor_principle", "detection_principle", "light_type", "connection", "housing_material", "scope_of_delivery", "switching_output", "interface"]


def _number(c: str) -> str:
    return f"regexp_replace(round({c}, 3)::decimal(30, 3)::varchar, '\\.?0+$', '')"


def _mm(c: str) -> str:
    others = f"list_filter([CASE WHEN {c} >= 10 AND {c} < 1000 THEN {_number(c + ' / 10')} || ' cm' END, CASE WHEN {c} >= 100 THEN {_number(c + ' / 1000')} || ' m' END, CASE WHEN {c} > 0 AND {c} < 1 THEN {_number(c + ' * 1000')} || ' µm' END], lambda x: x IS NOT NULL)"
    return f"({_number(c)} || ' mm' || CASE WHEN len({others}) > 0 THEN ' (' || array_to_string({others}, ' / ') || ')' ELSE '' END)"


def _two(c: str, unit: str, big: str, small: str | None = None) -> str:
    less = f" WHEN {c} > 0 AND {c} < 1 THEN ' (' || {_number(c + ' * 1000')} || ' {small})'" if small else ""
    return f"({_number(c)} || ' {unit}' || CASE WHEN {c} >= 1000 THEN ' (' || {_number(c + ' / 1000')} || ' {big})'{less} ELSE '' END)"


def _temp(c: str) -> str:
    fahrenheit = _number(f"floor({c} * 9 / 5 + 32.5::double)")
    return f"({_number(c)} || ' °C (' || {fahrenheit} || ' °F)')"


def _volts(c: str) -> str:
    return f"({_number(c)} || ' V')"


def _range(low: str, high: str, form) -> str:
    return (f"CASE WHEN {low} = {high} THEN {form(high)} WHEN {low} IS NOT NULL AND {high} IS NOT NULL THEN {form(low)} || ' ... ' || {form(high)} "
            f"WHEN {high} IS NOT NULL THEN '≤ ' || {form(high)} WHEN {low} IS NOT NULL THEN '≥ ' || {form(low)} END")


def _text(c: str) -> str:
    return f"nullif(trim({c}), '')"


def _clamp(c: str, n: int) -> str:
    words = f"regexp_split_to_array(trim({c}), '\\s+')"
    return f"CASE WHEN len({words}) <= {n} THEN trim({c}) ELSE array_to_string({words}[:{n}], ' ') || ' …' END"


def _joined(*names: str) -> str:
    return "nullif(concat_ws(' · ', " + ", ".join(_text(n) for n in names) + "), '')"


def _words(lines: str) -> str:
    return f"coalesce(list_sum(list_transform({lines}, lambda y: CASE WHEN trim(y) = '' THEN 0 ELSE len(regexp_split_to_array(trim(y), '\\s+')) END)), 0)"


def _card(limit: int) -> str:
    """The lines ``required``, of ``optional`` those before which the words have not reached the limit, and the keywords ``last``."""
    kept = f"list_filter(optional, lambda x, i: {_words('required')} + {_words('optional[:i - 1]')} < {limit})"
    return f"array_to_string(list_concat(list_concat(required, {kept}), list_filter([last], lambda x: x IS NOT NULL)), chr(10))"


CATEGORY = "regexp_replace(category, '^(.*?)\\s*\\(([^)]*)\\)\\s*$', '\\1 (\\2)')"
STRIPPED = "regexp_replace(type_code, '[^A-Za-z0-9]', '', 'g')"
IDENTITY = (f"concat_ws(' · ', type_code, CASE WHEN {STRIPPED} <> '' AND {STRIPPED} <> type_code THEN {STRIPPED} END, order_number, "
            "CASE WHEN family IS NOT NULL THEN concat_ws(' ', family, subfamily) END, row_type, source_page)")
ENCLOSURE = "nullif(concat_ws(' · ', trim(enclosure_rating), 'housing ' || nullif(trim(housing_material), '')), '')"


def _entry(k: int) -> str:
    """The k-th open field of a row."""
    name, value = (f"split_part(spec_text, '|', {2 * k - 1 + i})" for i in (0, 1))
    return f"CASE WHEN trim({value}) <> '' THEN {name} || ': ' || {_clamp(_text(value), 16)} END"


OPTIONAL = [
    "'sensing range ' || " + _range("sensing_range_min_mm", "sensing_range_max_mm", _mm),
    "'output ' || " + _joined("switching_output", "output_function"),
    "'connection ' || " + _text("connection"),
    "'principle ' || " + _joined("sensor_principle", "detection_principle"),
    "'light ' || " + _text("light_type"),
    "'enclosure ' || " + ENCLOSURE,
    "'supply voltage ' || " + _range("supply_voltage_min_v", "supply_voltage_max_v", _volts),
    "'output current ≤ ' || " + _two("output_current_max_ma", "mA", "A"),
    "'response time ' || " + _two("response_time_ms", "ms", "s", "µs"),
    "'switching frequency ' || " + _two("switching_frequency_hz", "Hz", "kHz"),
    "'operating temperature ' || " + _range("operating_temp_min_c", "operating_temp_max_c", _temp),
    f"'resolution ' || nullif(trim({_number('resolution_value')} || coalesce(' ' || resolution_unit, '')), '')",
    f"CASE WHEN row_type = 'product' THEN {_clamp(_text('short_description'), 30)} END",
    "'interface ' || " + _text("interface"),
    "'light spot ' || " + _text("light_spot"),
    "'adjustment ' || " + _text("adjustment"),
    f"'scope of delivery ' || {_clamp(_text('scope_of_delivery'), 24)}",
    *(_entry(k) for k in range(1, 5)),
    "product_url",
]
SPECS = "CASE WHEN spec_text IS NOT NULL THEN concat_ws(' ; ', " + ", ".join(f"split_part(spec_text, '|', {i})" for i in (*range(1, 10, 2), *range(2, 11, 2))) + ") END"
SURFACE_SQL = "lower(concat_ws(' ; ', " + ", ".join(SURFACE) + f", {SPECS}))"


def _keywords(surface: str, limit: int) -> str:
    """Words of the triggers that begin a word of the text, the first of those that differ in case only."""
    names = [(w, t) for t, words in TRIGGERS for w in words]
    hits = lambda t: f"regexp_matches({surface}, '(^|[^a-z0-9]){t}')"
    parts = []
    for i, (w, t) in enumerate(names):
        earlier = [hits(u) for v, u in names[:i] if v.lower() == w.lower()]
        parts.append(f"CASE WHEN {hits(t)}" + "".join(f" AND NOT {e}" for e in earlier) + f" THEN '{w}' END")
    return f"'keywords: ' || nullif(array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)[:{limit}], ', '), '')"


ROW_LINES = (
    f"list_filter([{IDENTITY}, {_text('product_name')}, CASE WHEN row_type = 'accessory' THEN {_clamp(_text('short_description'), 44)} END, {CATEGORY}], lambda x: x IS NOT NULL) AS required, "
    f"list_filter([{', '.join(OPTIONAL)}], lambda x: x IS NOT NULL) AS optional, {_keywords(SURFACE_SQL, 14)} AS last"
)

LISTS = {
    "pages": ("source_page", 8), "names": ("product_name", 2), "subfamilies": ("subfamily", 8),
    "prefixes": ("CASE WHEN length(regexp_extract(type_code, '^[A-Za-z]+[0-9]*')) >= 2 THEN regexp_extract(type_code, '^[A-Za-z]+[0-9]*') END", 6),
    "sensors": ("sensor_principle", 3), "detections": ("detection_principle", 3), "lights": ("light_type", 3), "outputs": ("switching_output", 5),
    "connections": ("connection", 3), "ratings": ("enclosure_rating", 3), "housings": ("housing_material", 2),
}
LISTS_SQL = " UNION ALL ".join(f"SELECT document_id, chunk_index, '{name}' AS list, {n} AS most, trim({value}) AS shown FROM n" for name, (value, n) in LISTS.items())


def _many(name: str, by: str = "; ") -> str:
    return f"nullif(array_to_string(coalesce({name}, []), '{by}'), '')"


FAMILY_REQUIRED = (
    "list_filter([concat_ws(' · ', coalesce(family || ' family', 'section ' || section || ' shared parts, no family heading'), " + CATEGORY + ", 'section ' || section, "
    "'pages ' || array_to_string(coalesce(pages, []), ', '), variants || ' variants, ' || accessories || ' accessories'), " + _many("names") + "], lambda x: x IS NOT NULL)"
)
FAMILY_OPTIONAL = "list_filter([" + ", ".join([
    "'subfamilies ' || " + _many("subfamilies", ", "), "'type codes ' || " + _many("prefixes", ", "),
    f"'principles ' || nullif(concat_ws('; ', {_many('sensors')}, {_many('detections')}), '')", "'light ' || " + _many("lights"),
    "'sensing range across the family ' || CASE WHEN high IS NOT NULL THEN " + _range("low", "high", _mm) + " END",
    "'outputs ' || " + _many("outputs", ", "), "'connections ' || " + _many("connections"), "'enclosure ' || " + _many("ratings", ", "), "'housing ' || " + _many("housings"), "row_url",
]) + "], lambda x: x IS NOT NULL)"

DOCUMENTS_SQL = f"""WITH d AS (SELECT *, concat('family:', section, ':', coalesce(family, '(no family)')) AS document_id FROM {{shown}}),
n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY pdf_page, ord) AS chunk_index FROM d),
lines AS (SELECT *, {ROW_LINES} FROM n),
listed AS ({LISTS_SQL}),
counted AS (SELECT document_id, list, most, lower(shown) AS k, count(*) AS times, min_by(shown, chunk_index) AS shown, min(chunk_index) AS first FROM listed WHERE shown <> '' GROUP BY document_id, list, most, lower(shown)),
placed AS (SELECT *, row_number() OVER (PARTITION BY document_id, list ORDER BY times DESC, first) AS rn FROM counted),
tops AS (SELECT document_id, {", ".join(f"list(shown ORDER BY rn) FILTER (WHERE list = '{name}' AND rn <= most) AS {name}" for name in LISTS)} FROM placed GROUP BY document_id),
fam AS (SELECT document_id, min(section) AS section, min(family) AS family, min(category) AS category, count(*) FILTER (WHERE row_type = 'product') AS variants, count(*) FILTER (WHERE row_type <> 'product') AS accessories,
  coalesce(min(sensing_range_min_mm), min(sensing_range_max_mm)) AS low, max(sensing_range_max_mm) AS high, min_by(product_url, chunk_index) FILTER (WHERE product_url IS NOT NULL) AS row_url,
  string_agg({SURFACE_SQL}, ' ; ' ORDER BY chunk_index) FILTER (WHERE chunk_index <= 40) AS surface FROM n GROUP BY document_id),
facts AS (SELECT fam.document_id, {FAMILY_REQUIRED} AS required, {FAMILY_OPTIONAL} AS optional, {_keywords("lower(concat_ws(' ; ', category, surface))", 12)} AS last FROM fam JOIN tops ON tops.document_id = fam.document_id)
SELECT 'sku:' || order_number AS id, 'sku' AS kind, document_id, chunk_index, md5({_card(105)}) AS card FROM lines
UNION ALL SELECT document_id, 'family', document_id, 0, md5({_card(170)}) FROM facts"""


def shown(spark, sf):
    rows = T.derive(spark, sf, "shown")
    pieces = F.split("spec_text", "[|]")
    keys = F.filter(pieces, lambda x, i: i % 2 == 0)
    values = F.filter(pieces, lambda x, i: i % 2 == 1)
    return complete(rows.withColumn("other_specs", F.map_from_arrays(keys, values)), PRODUCT + ", ord BIGINT")


@query(DOCUMENTS_SQL)
def document_cards(spark, sf):
    """Every card of every document in full: the family's first, then one per row in page order."""
    out = C.build_documents(shown(spark, sf), triggers=TRIGGERS)
    return out.select("id", "kind", "document_id", "chunk_index", F.md5("text").alias("card"))
