"""Text-to-column queries over the documents, and over printed catalog text made from the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from partlens.functions import text as X
from partlens.functions import units as U
from partlens.functions.describe import parse_description as describe_column
from partlens.operators import enrich as EN
from partlens.operators import gloss as G
from partlens.operators import normalize as N
from partlens.operators.bom import looks_like_part, looks_like_quantity, quantity
from partlens.operators.match import map_housing
from partlens.plans import tables as T
from partlens.plans.registry import query
from partlens.plans.scale import spread
from partlens.sources.schemas import PRODUCT, complete

FOLD = "trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({FOLD}) AS folded, md5(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))) AS heading, md5(regexp_replace(upper(replace(text, 'ß', 'SS')), '[^A-Z0-9]+', '', 'g')) AS part_key FROM documents")
def fold(spark, sf):
    c = F.col("text")
    return spread(T.read(spark, sf, "documents")).select("doc_id", F.md5(X.fold(c)).alias("folded"), F.md5(X.header_key(c)).alias("heading"), F.md5(X.part_key(c)).alias("part_key"))


_count = lambda words: "len(regexp_extract_all(concat(' ', regexp_replace(lower(text), '[^a-z0-9_]', '  ', 'g'), ' '), ' (?:" + "|".join(words) + ") '))"
# The most frequent words of the documents of sf0.001 in each of the two languages.
ES_WORDS = ["de", "la", "que", "el", "en", "y", "se", "los", "las", "del", "con", "un", "por", "una"]
EN_WORDS = ["the", "of", "and", "to", "a", "is", "in", "that", "it", "for", "on", "was", "with"]


@query(f"SELECT doc_id, CASE WHEN regexp_matches(lower(text), '[áéíóúñ¿¡]') THEN 'es' WHEN {_count(ES_WORDS)} >= {_count(EN_WORDS)} THEN 'es' ELSE 'en' END AS language FROM documents")
def detect_language(spark, sf):
    out = X.detect_language(F.col("text"), "es", "en", ES_WORDS, EN_WORDS, "áéíóúñ¿¡")
    return spread(T.read(spark, sf, "documents")).select("doc_id", out.alias("language"))


# The most frequent longer words of the conversations of sf0.001.
STOP = ["thble", "thing", "thtion", "ontion", "ertion", "enein", "ering", "reing", "aning"]
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


@query(f"""SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^a-z0-9]+'),
  lambda w: length(w) > 4 AND NOT list_contains({STOP_SQL}, w)), ' ') AS words FROM conversations""")
def problem_keywords(spark, sf):
    return T.read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(X.problem_keywords(F.col("text"), STOP), " ").alias("words"))


GLOSS = {"the": "el", "for the": "para el", "of": "de", "with": "con", "le": "the", "en": "in", "der": "the", "und": "and"}


@query(f"""WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[™®]', '', 'g')), '[‐-―]', '-', 'g'), '[“”‘’]', '"', 'g'), '\\s+', ' ', 'g') AS t0 FROM documents),
g AS (SELECT doc_id, trim(t0) AS t FROM f),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[a-z0-9]+') AS words FROM g),
c AS (SELECT doc_id, list_count(list_filter(words, lambda x: x IN ('the', 'of', 'with', 'le', 'en', 'der', 'und'))) AS hits,
  len(regexp_extract_all(concat(' ', t, ' '), '[^a-z0-9]for the[^a-z0-9]')) AS pairs FROM w)
SELECT doc_id, hits, pairs, hits + pairs > 0 AS changed FROM c""")
def gloss(spark, sf):
    """Words of a small glossary found in each text, and whether the gloss changed it."""
    rows = spread(T.read(spark, sf, "documents")).select("doc_id", "text", X.fold_print(F.col("text")).alias("start"))
    start, out = F.col("start"), X.gloss(F.col("text"), GLOSS)
    words = F.regexp_extract_all(start, F.lit("[a-z0-9]+"), F.lit(0))
    hits = F.size(F.filter(words, lambda w: w.isin(*[k for k in GLOSS if " " not in k])))
    pairs = F.regexp_count(F.concat(F.lit(" "), start, F.lit(" ")), F.lit("[^a-z0-9]for the[^a-z0-9]"))
    return rows.select("doc_id", hits.alias("hits"), pairs.alias("pairs"), out.isNotNull().alias("changed"))


# A dictionary out of the data: every word of the benchmark texts stands for itself in brackets.
GLOSSARY_SQL = "SELECT phrase, concat('<', phrase, '>') AS told FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]+')) AS phrase FROM benchmark) x WHERE length(phrase) >= 5"
PRINT_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[™®]', '', 'g')), '[‐-―]', '-', 'g'), '[“”‘’]', '"', 'g'), '\s+', ' ', 'g'))"""


@query("WITH g AS (" + GLOSSARY_SQL + "), m AS (SELECT map_from_entries(list((phrase, told))) AS words FROM g), f AS (SELECT doc_id, " + PRINT_SQL + """ AS t FROM documents),
o AS (SELECT doc_id, t, array_to_string(list_transform(regexp_extract_all(t, '[a-z0-9]+|[^a-z0-9]'), lambda x: coalesce(words[x], x)), '') AS told FROM f, m)
SELECT doc_id, CASE WHEN t <> '' AND told <> t THEN md5(told) END AS told FROM o""")
def gloss_texts(spark, sf):
    """Whole texts with all words of a large dictionary replaced in one walk."""
    words = T.read(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower(X.strip_accents(F.col("text"))), F.lit("[a-z0-9]+"), F.lit(0))).alias("phrase"))
    terms = words.distinct().filter(F.length("phrase") >= 5).select("phrase", F.concat(F.lit("<"), "phrase", F.lit(">")).alias("told"))
    out = G.gloss_texts(spread(T.read(spark, sf, "documents").select("doc_id", "text")), "text", terms, name="told")
    return out.select("doc_id", F.md5("told").alias("told"))


TRIGGERS = [("the", ["article", "Definite"]), ("un", ["article", "indefinite"]), ("license", ["license", "terms"]), ("copyright", ["terms", "notice"]), ("que", ["question"])]
_trigger = lambda t: f"regexp_matches(t, '(^|[^a-z0-9]){t}')"


@query(f"""WITH f AS (SELECT doc_id, {FOLD} AS t FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN {_trigger('the')} THEN 'article,Definite' END,
  CASE WHEN {_trigger('un')} THEN CASE WHEN {_trigger('the')} THEN 'indefinite' ELSE 'article,indefinite' END END,
  CASE WHEN {_trigger('license')} THEN 'license,terms' END,
  CASE WHEN {_trigger('copyright')} THEN CASE WHEN {_trigger('license')} THEN 'notice' ELSE 'terms,notice' END END,
  CASE WHEN {_trigger('que')} THEN 'question' END) AS words FROM f""")
def keywords(spark, sf):
    return spread(T.read(spark, sf, "documents")).select("doc_id", F.array_join(X.keywords(F.col("text"), TRIGGERS), ",").alias("words"))


@query("""SELECT page_id, regexp_matches(html, '\\b[0-9]{7}\\b') AS has_id, len(regexp_extract_all(regexp_replace(html, '\\b[0-9]{7}\\b', '#######', 'g'), '#######')) AS masked,
  md5(regexp_replace(html, '\\b[0-9]{7}\\b', '[part number removed]', 'g')) AS redacted FROM pages""")
def redact_ids(spark, sf):
    c = F.col("html")
    none = F.lit(None).cast("string")
    red = X.redact_foreign_ids(c, none)
    return spread(T.read(spark, sf, "pages")).select("page_id", c.rlike(X.ORDER_NUMBER_IN_TEXT).alias("has_id"), F.regexp_count(c, F.lit(X.ORDER_NUMBER_IN_TEXT)).cast("int").alias("masked"), F.md5(red).alias("redacted"))


@query("SELECT event_id, (props::json->>'k')::int AS k, regexp_matches(concat('WT', event_id, '-', upper(event_type), user_id), '\\b[A-Z]{2,4}[0-9]{1,3}[A-Z]?-[A-Z0-9]{5,}\\b') OR event_id >= 1000000 AND event_id <= 9999999 AS has_reference FROM events")
def contains_part_reference(spark, sf):
    text = F.concat(F.lit("WT"), "event_id", F.lit("-"), F.upper("event_type"), "user_id")
    rows = T.read(spark, sf, "events")
    plain = F.when(F.col("event_id").between(1000000, 9999999), F.concat(text, F.lit(" "), "event_id")).otherwise(text)
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), X.contains_part_reference(plain).alias("has_reference"))


# Printed catalog text with known content: the SQL side reads the numbers, the Spark side the words.
PRINTED = """
SELECT ord, order_number, row_type, section, family, pdf_page,
  CASE WHEN output_type = 'PNP' THEN concat('2 PNP, ', cast(pdf_page AS string), ' mA 1)') WHEN output_type = 'NPN' THEN concat('NPN ', cast(pdf_page AS string), ',5 mA; IO-Link')
    WHEN output_type = 'PNP/NPN' THEN 'PNP/NPN seleccionable' WHEN output_type = 'push-pull' THEN '1 Contrafase, PNP' WHEN output_type = 'unknown' THEN '4 mA ... 20 mA' WHEN pdf_page > 46 THEN 'relé' END AS switching_output,
  CASE WHEN connector = 'M8' THEN concat('Conector macho M8, ', cast(connector_pins AS string), ' polos') WHEN connector = 'M12' THEN concat('M12 de ', cast(connector_pins AS string), ' pines')
    WHEN connector = 'cable' THEN 'Cable, 2 m' WHEN connector = 'unknown' THEN 'M8 y M12, 4 polos' WHEN pdf_page > 25 THEN 'Bornes' ELSE 'Otra' END AS connection,
  CASE WHEN ip_rating = 69 THEN 'IP 67, IP 69K' WHEN ip_rating = 67 THEN 'IP67 (IP 65)' WHEN ip_rating = 65 THEN 'ip 65' END AS enclosure_rating,
  CASE section WHEN 'STANDARD' THEN 'Fotocélula de detección sobre objeto' WHEN 'LARGE' THEN 'Barrera emisor-receptor' END AS sensor_principle,
  CASE WHEN pdf_page > 35 AND section IN ('STANDARD', 'LARGE') THEN 'Supresión del fondo' END AS detection_principle,
  category,
  CASE housing WHEN 'metal' THEN 'Aluminio' WHEN 'plastic' THEN 'Plástico PBT' WHEN 'other' THEN 'Acero inoxidable 1.4404' END AS housing_material,
  CASE light WHEN 'laser' THEN 'Láser, luz roja' WHEN 'red' THEN 'LED, luz roja' WHEN 'other' THEN 'LED roja y verde' END AS light_type,
  concat(CASE WHEN pdf_page <= 25 THEN '1.020 mm' ELSE '2,5 m' END, ' ', cast(pdf_page AS string), ' mm') AS length_text,
  concat('-', cast(pdf_page AS string), ' °C ... +', cast(pdf_page + 20 AS string), ' °C') AS temp_text,
  CASE WHEN pdf_page <= 20 THEN concat('≤ ', cast(pdf_page AS string), ',5 ms') WHEN pdf_page <= 40 THEN concat(cast(pdf_page AS string), '0 µs') ELSE 'rápido' END AS time_text,
  type_code, product_name, flags
FROM {catalog}
"""
T.DERIVED["printed"] = PRINTED


def _printed(spark, sf):
    return T.derive(spark, sf, "printed")


@query("""SELECT order_number, CASE WHEN pdf_page <= 10 THEN 'PNP' WHEN pdf_page <= 20 THEN 'NPN' WHEN pdf_page <= 26 THEN 'PNP/NPN' WHEN pdf_page <= 32 THEN 'push-pull' WHEN pdf_page <= 38 THEN 'analog' WHEN pdf_page > 46 THEN 'relay' END AS output_type,
  CASE WHEN pdf_page <= 10 THEN 2 WHEN pdf_page BETWEEN 27 AND 32 THEN 1 END AS output_count,
  CASE WHEN pdf_page <= 10 THEN pdf_page::double WHEN pdf_page <= 20 THEN pdf_page + 0.5::double END AS current_ma,
  CASE WHEN pdf_page BETWEEN 11 AND 20 THEN true END AS io_link FROM {printed}""")
def parse_output(spark, sf):
    out = N.parse_output(F.col("switching_output"))
    return _printed(spark, sf).select("order_number", out["type"].alias("output_type"), out["count"].alias("output_count"), out["current_ma"].alias("current_ma"), out["io_link"].alias("io_link"))


@query("""SELECT order_number, CASE WHEN length(product_name) <= 8 THEN 'M8' WHEN length(product_name) <= 9 THEN 'M12' WHEN length(product_name) <= 10 THEN 'cable' WHEN length(product_name) <= 11 THEN NULL WHEN pdf_page > 25 THEN 'terminal' ELSE 'other' END AS connector,
  CASE WHEN length(product_name) <= 9 THEN CASE WHEN pdf_page > 25 THEN 4 ELSE 5 END END AS pins FROM {printed}""")
def parse_connection(spark, sf):
    out = N.parse_connection(F.col("connection"))
    return _printed(spark, sf).select("order_number", out["connector"].alias("connector"), out["pins"].alias("pins"))


@query("""SELECT order_number, CASE enclosure_rating WHEN 'IP 67, IP 69K' THEN 67 WHEN 'IP67 (IP 65)' THEN 65 WHEN 'ip 65' THEN 65 END AS worst, CASE enclosure_rating WHEN 'IP 67, IP 69K' THEN true END AS ip69k,
  CASE enclosure_rating WHEN 'IP 67, IP 69K' THEN 67 WHEN 'IP67 (IP 65)' THEN 67 WHEN 'ip 65' THEN 65 END AS first_rating, CASE WHEN enclosure_rating IS NOT NULL THEN 6 END AS solid,
  CASE enclosure_rating WHEN 'IP 67, IP 69K' THEN 9 WHEN 'IP67 (IP 65)' THEN 7 WHEN 'ip 65' THEN 5 END AS liquid, CASE WHEN enclosure_rating IS NOT NULL THEN enclosure_rating = 'IP 67, IP 69K' END AS washdown FROM {printed}""")
def parse_ip(spark, sf):
    c = F.col("enclosure_rating")
    worst, first, axis = (U.parse_ip(c, m) for m in ("worst", "first", "best_axis"))
    return _printed(spark, sf).select("order_number", worst["ip"].alias("worst"), worst["ip69k"].alias("ip69k"), first["ip"].alias("first_rating"), axis["solid"].alias("solid"),
                                      axis["liquid"].alias("liquid"), axis["washdown"].alias("washdown"))


PRINCIPLE_SQL = "CASE section WHEN 'STANDARD' THEN CASE WHEN pdf_page > 35 THEN 'background-suppression' ELSE 'diffuse' END WHEN 'LARGE' THEN 'through-beam' WHEN 'MEDIUM' THEN CASE WHEN row_type = 'product' THEN 'encoder' END WHEN 'PROMO' THEN CASE WHEN row_type = 'product' THEN 'fluid' END WHEN 'ECONOMY' THEN CASE WHEN row_type = 'product' THEN 'vision' END END"


@query(f"""SELECT order_number, {PRINCIPLE_SQL} AS principle,
  CASE WHEN section = 'STANDARD' AND pdf_page > 35 THEN 'detection_principle' WHEN section IN ('STANDARD', 'LARGE') THEN 'sensor_principle' WHEN section IN ('MEDIUM', 'PROMO', 'ECONOMY') AND row_type = 'product' THEN 'category' END AS source,
  CASE housing_material WHEN 'Aluminio' THEN 'metal' WHEN 'Plástico PBT' THEN 'plastic' WHEN 'Acero inoxidable 1.4404' THEN 'stainless-steel' END AS housing,
  CASE light_type WHEN 'Láser, luz roja' THEN 'laser' WHEN 'LED, luz roja' THEN 'red' END AS light FROM {{printed}}""")
def parse_principle(spark, sf):
    out = N.parse_principle(*(F.col(c) for c in ("sensor_principle", "detection_principle", "category", "row_type")))
    return _printed(spark, sf).select("order_number", out["principle"].alias("principle"), out["source"].alias("source"),
                                      N.parse_housing(F.col("housing_material")).alias("housing"), N.parse_light(F.col("light_type")).alias("light"))


@query("""SELECT order_number, concat_ws(',', CASE WHEN flagged AND switching_output IS NOT NULL THEN 'output_type' END, CASE WHEN flagged AND pdf_page <= 20 THEN 'io_link' END, NULL,
  CASE WHEN flagged THEN 'output_current_max_ma' END, CASE WHEN flagged AND c THEN 'connector' END, CASE WHEN flagged AND length(product_name) <= 9 THEN 'connector_pins' END,
  CASE WHEN section IN ('MEDIUM', 'PROMO', 'ECONOMY') AND row_type = 'product' THEN 'principle' END) AS low_confidence
FROM (SELECT *, flags LIKE 'switching%' AS flagged, length(product_name) NOT BETWEEN 11 AND 11 AS c FROM {printed}) x""")
def normalize_spec(spark, sf):
    """The low-confidence list that normalization carries over from the printed fields."""
    rows = complete(_printed(spark, sf).withColumn("low_confidence", T.split_list("flags")), PRODUCT)
    return N.normalize_spec(rows).select("order_number", F.array_join("low_confidence", ",").alias("low_confidence"))


@query("""SELECT order_number, pdf_page::double AS plain, CASE WHEN pdf_page <= 25 THEN greatest(1020, pdf_page)::double ELSE pdf_page::double END AS mm, -pdf_page::double AS lo, (pdf_page + 20)::double AS hi,
  CASE WHEN pdf_page <= 20 THEN pdf_page + 0.5::double WHEN pdf_page <= 40 THEN pdf_page / 100::double END AS ms, (pdf_page * 10)::double AS from_cm, 25.0::double AS celsius, round(1000 + pdf_page / 10::double, 6) AS euro FROM {printed}""")
def parse_units(spark, sf):
    """Numbers, lengths, temperatures and times out of printed text."""
    rows = _printed(spark, sf)
    page = F.col("pdf_page").cast("string")
    temp = U.parse_temp_range(F.col("temp_text"))
    euro = F.concat(F.lit("1.00"), F.floor(F.col("pdf_page") / 10).cast("string"), F.lit(","), (F.col("pdf_page") - F.floor(F.col("pdf_page") / 10) * 10).cast("string"))
    return rows.select(
        "order_number", U.euro_number(page).alias("plain"), U.parse_mm(F.col("length_text")).alias("mm"), temp["min"].alias("lo"), temp["max"].alias("hi"),
        U.parse_ms(F.col("time_text")).alias("ms"), U.asserted_value(F.concat(page, F.lit(" cm")), F.lit("mm")).alias("from_cm"),
        U.asserted_value(F.lit("77 °F"), F.lit("C")).alias("celsius"), F.round(U.euro_number(euro), 6).alias("euro"),
    )


@query("""SELECT order_number, concat_ws(',', CASE WHEN pdf_page BETWEEN 11 AND 20 THEN 'IO-Link' WHEN pdf_page BETWEEN 33 AND 38 THEN '4-20mA' END,
  CASE WHEN section = 'MEDIUM' THEN 'SSI,RS-422' WHEN section = 'PROMO' THEN 'EtherNet/IP,Ethernet' END) AS protocols FROM {printed}""")
def extract_protocols(spark, sf):
    bus = F.when(F.col("section") == "MEDIUM", "SSI / RS-422").when(F.col("section") == "PROMO", "EtherNet/IP")
    return _printed(spark, sf).select("order_number", F.array_join(U.extract_protocols(F.array("switching_output", bus)), ",").alias("protocols"))


SPECS_SQL = """specs AS (SELECT order_number, section, pdf_page, product_name, type_code, family, category, row_type, light_type, enclosure_rating, switching_output,
  CASE WHEN pdf_page <= 30 THEN concat(cast(pdf_page AS string), ' mm') ELSE 'sin dato' END AS field_height,
  CASE WHEN pdf_page <= 15 THEN concat('1.', lpad(cast(pdf_page AS string), 3, '0'), ' mm') END AS reach, concat(cast(pdf_page AS string), ' haces') AS beams, time_text, temp_text FROM {printed})"""


def _with_specs(spark, sf):
    rows = T.run(spark, sf, "WITH " + SPECS_SQL + " SELECT * FROM specs")
    labels = {"Altura del campo de protección": "field_height", "Alcance": "reach", "Número de haces": "beams", "Tiempo de respuesta": "time_text",
              "Temperatura ambiente": "temp_text"}
    entries = F.array(*[F.struct(F.lit(label).alias("key"), F.col(c).alias("value")) for label, c in labels.items()])
    return rows.withColumn("other_specs", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))


@query("WITH " + SPECS_SQL + """ SELECT order_number, CASE WHEN pdf_page <= 30 THEN pdf_page::double END AS protective_field_height_mm, reach AS measuring_range_raw, pdf_page AS beam_count,
  CASE WHEN pdf_page <= 30 THEN concat('other_specs[Altura del campo de protección]: ', field_height) END AS why FROM specs""")
def mine_map(spark, sf):
    out = EN.mine_map(_with_specs(spark, sf), "other_specs")
    return out.select("order_number", "protective_field_height_mm", "measuring_range_raw", "beam_count", F.col("protective_field_height_mm_why").alias("why"))


@query("WITH " + SPECS_SQL + """ SELECT order_number,
  CASE section WHEN 'STANDARD' THEN 'photoelectric' WHEN 'LARGE' THEN 'proximity' WHEN 'SMALL' THEN 'distance' WHEN 'MEDIUM' THEN 'encoder' WHEN 'PROMO' THEN 'fluid' ELSE 'vision' END AS solution_class,
  CASE WHEN pdf_page <= 15 THEN (1000 + pdf_page)::double END AS sensing_range_max_mm, -pdf_page::double AS operating_temp_min_c, (pdf_page + 20)::double AS operating_temp_max_c,
  CASE WHEN pdf_page <= 20 THEN pdf_page + 0.5::double WHEN pdf_page <= 40 THEN pdf_page / 100::double END AS response_time_ms,
  CASE enclosure_rating WHEN 'IP 67, IP 69K' THEN 9 WHEN 'IP67 (IP 65)' THEN 7 WHEN 'ip 65' THEN 5 END AS ip_water, md5(lower(strip_accents(concat_ws(' | ', product_name, family, type_code, category, light_type,
    'Altura del campo de protección', CASE WHEN reach IS NOT NULL THEN 'Alcance' END, 'Número de haces', 'Tiempo de respuesta', 'Temperatura ambiente', field_height, reach, beams, time_text, temp_text)))) AS blob FROM specs""")
def enrich(spark, sf):
    """Class, fallbacks and search text of rows whose facts are only in the open spec list."""
    rows = _with_specs(spark, sf)
    full = complete(rows, PRODUCT)
    out = EN.enrich(full)
    return out.select("order_number", "solution_class", "sensing_range_max_mm", "operating_temp_min_c", "operating_temp_max_c", "response_time_ms", "ip_water", F.md5("search_blob").alias("blob"))


# Names that carry a mode, a measurand or only a code prefix.
MODES_SQL = """named AS (SELECT ord, section, pdf_page, category,
  CASE WHEN pdf_page <= 10 THEN 'Sensor por ultrasonidos' WHEN pdf_page <= 20 THEN 'Barrera de reflexión' WHEN pdf_page <= 30 THEN 'Sensor inductivo de nivel' WHEN pdf_page <= 40 THEN 'Encoder incremental' END AS name_text,
  CASE WHEN pdf_page > 45 THEN 'Barrera emisor-receptor' END AS principle_text,
  concat(CASE section WHEN 'STANDARD' THEN 'WL1' WHEN 'LARGE' THEN 'CM' WHEN 'SMALL' THEN 'OD' WHEN 'PROMO' THEN 'PB' ELSE 'X' END, cast(ord AS string)) AS code FROM {printed})"""


@query("WITH " + MODES_SQL + """ SELECT ord, CASE WHEN pdf_page > 45 THEN 'opposed' WHEN pdf_page <= 10 THEN 'ultrasonic'
  WHEN section = 'STANDARD' THEN CASE WHEN pdf_page <= 20 THEN 'retroreflective' WHEN pdf_page > 20 THEN 'retroreflective' END
  WHEN section = 'LARGE' THEN CASE WHEN pdf_page BETWEEN 21 AND 30 THEN 'inductive' ELSE 'capacitive' END WHEN section = 'SMALL' THEN 'laser_triangulation'
  WHEN section = 'MEDIUM' AND pdf_page BETWEEN 31 AND 40 THEN 'encoder_incremental' END AS mode,
  CASE WHEN section = 'PROMO' THEN CASE WHEN pdf_page BETWEEN 21 AND 30 THEN 'level' ELSE 'pressure' END END AS measurand FROM named""")
def derive_mode(spark, sf):
    rows = T.run(spark, sf, "WITH " + MODES_SQL + " SELECT * FROM named")
    none = F.lit(None).cast("string")
    base = rows.select("ord", "category", F.col("name_text").alias("product_name"), none.alias("short_description"), none.alias("family"),
                       F.col("principle_text").alias("sensor_principle"), F.col("code").alias("type_code"))
    base = base.withColumn("solution_class", EN.solution_class(F.col("category")))
    k = F.col("solution_class")
    return base.select("ord", EN.derive_mode(k)["value"].alias("mode"), EN.derive_measurand(k)["value"].alias("measurand"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS qty, true AS is_qty, l_partkey >= 10000 AS digits_part, true AS code_part, CASE WHEN l_returnflag = 'R' THEN 1250.0::double ELSE l_quantity + 0.5::double END AS odd_qty FROM lineitem""")
def quantities(spark, sf):
    """Quantities and part shapes of every line, as a purchasing export would print them."""
    q = F.col("l_quantity").cast("int").cast("string")
    odd = F.when(F.col("l_returnflag") == "R", "1,250").otherwise(F.concat(q, F.lit(",5 pcs")))
    return T.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", quantity(F.concat(q, F.lit(" pcs"))).alias("qty"), looks_like_quantity(F.concat(q, F.lit(" pcs"))).alias("is_qty"),
        looks_like_part(F.col("l_partkey").cast("string")).alias("digits_part"), looks_like_part(F.concat(F.lit("WT-"), F.col("l_partkey").cast("string"))).alias("code_part"), quantity(odd).alias("odd_qty"),
    )


DESCRIPTIONS = """concat(CASE WHEN l_returnflag = 'R' THEN 'Caja negra' WHEN l_returnflag = 'A' THEN 'Detectar cartón' ELSE 'Pieza' END, ' a ', cast(cast(l_quantity AS int) AS string), CASE WHEN l_linenumber <= 2 THEN ' cm' WHEN l_linenumber <= 5 THEN ' mm' ELSE ' m' END, CASE WHEN l_linestatus = 'O' THEN ', salida NPN' ELSE '' END)"""


@query(f"""WITH d AS (SELECT l_returnflag, l_linenumber, l_linestatus, l_quantity, {DESCRIPTIONS} AS t FROM lineitem)
SELECT t AS text, count(*) AS n, min(CASE l_returnflag WHEN 'R' THEN '6pct' WHEN 'A' THEN '20pct' END) AS remission, min(cast(l_quantity * CASE WHEN l_linenumber <= 2 THEN 10 WHEN l_linenumber <= 5 THEN 1 ELSE 1000 END AS bigint)) AS distance_mm,
  min(CASE WHEN l_linestatus = 'O' THEN 'NPN' ELSE 'PNP' END) AS output, min(CASE WHEN l_linestatus = 'O' THEN 'stated' ELSE 'assumed' END) AS output_origin FROM d GROUP BY t""")
def parse_description(spark, sf):
    texts = T.read(spark, sf, "lineitem").select(F.expr(DESCRIPTIONS).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    out = describe_column(F.col("text"))
    return texts.select("text", "n", out["remission"].alias("remission"), out["distance_mm"].alias("distance_mm"), out["output"].alias("output"), out["output_origin"].alias("output_origin"))


@query("""SELECT a.vec_id, round(coalesce(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 0), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine(spark, sf):
    """Similarity of every vector to the next one."""
    e = T.read(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(U.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN r < 1 THEN 0 WHEN r < 1.3::double THEN 0.7::double + (r - 1) WHEN r <= 2 THEN 1 ELSE greatest(0.35::double, 1 - (r - 2) * 0.075::double) END, 6) AS fit
FROM (SELECT *, l_quantity / 10 AS r FROM lineitem) x""")
def range_fit(spark, sf):
    return T.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(U.range_fit(F.lit(10.0), F.col("l_quantity")), 6).alias("fit"))


@query("SELECT p_partkey, CASE p_type WHEN 'LARGE' THEN 'stainless-steel,other' WHEN 'SMALL' THEN 'metal' WHEN 'PROMO' THEN 'plastic,metal' ELSE '' END AS housing FROM part")
def map_housings(spark, sf):
    text = F.when(F.col("p_type") == "LARGE", "Stainless steel and glass").when(F.col("p_type") == "SMALL", "die-cast zinc").when(F.col("p_type") == "PROMO", "PBT plastic, steel clip").otherwise("")
    return T.read(spark, sf, "part").select("p_partkey", F.array_join(map_housing(text), ",").alias("housing"))
