"""Catalog-shaped tables derived from the given tables, in SQL that Spark and DuckDB both read.

``{name}`` stands for a given or an earlier derived table.  Lists are written
as ``a|b`` text and split on either side.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.sources.schemas import PRODUCT, REQUIREMENT, SCORING_REQUIREMENT, SPEC, complete

GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

LINE_STATS = """
SELECT l_partkey,
  count(*) AS n_lines,
  max(CASE WHEN l_returnflag = 'R' AND l_tax >= 0.07 THEN l_quantity END) AS q_hi,
  min(CASE WHEN l_returnflag = 'A' AND l_tax <= 0.01 THEN l_quantity END) AS q_lo,
  max(CASE WHEN l_returnflag = 'N' AND l_discount >= 0.1 THEN l_quantity END) AS q_slow,
  min(CASE WHEN l_linestatus = 'F' AND l_discount <= 0.0 THEN l_quantity END) AS q_volt,
  max(CASE WHEN l_linestatus = 'O' AND l_tax >= 0.08 THEN l_quantity END) AS q_temp
FROM {lineitem} GROUP BY l_partkey
"""

CATALOG = """
SELECT p_partkey AS ord,
  cast(p_partkey + 1000000 AS string) AS order_number,
  CASE WHEN p_size <= 8 THEN 'accessory' ELSE 'product' END AS row_type,
  p_type AS section,
  CASE WHEN p_size <> 50 THEN p_brand END AS family,
  CASE p_type WHEN 'STANDARD' THEN 'Fotocelulas (Photoelectric sensors)'
    WHEN 'LARGE' THEN 'Sensores de proximidad (Proximity sensors)'
    WHEN 'SMALL' THEN 'Sensores de distancia (Distance sensors)'
    WHEN 'MEDIUM' THEN 'Encoders'
    WHEN 'PROMO' THEN 'Sensores de fluidos (Fluid sensors)'
    ELSE 'Vision (Vision)' END AS category,
  concat('P-', cast(p_size AS string)) AS source_page,
  p_size AS pdf_page,
  concat(upper(replace(p_name, ' ', '-')), '-', cast(p_partkey AS string)) AS type_code,
  p_name AS product_name,
  CASE WHEN p_size <= 30 THEN concat('www.example.com/', lower(p_brand)) END AS product_url,
  CASE WHEN p_size <= 10 THEN 'PNP' WHEN p_size <= 20 THEN 'NPN' WHEN p_size <= 26 THEN 'PNP/NPN'
    WHEN p_size <= 32 THEN 'push-pull' WHEN p_size <= 38 THEN 'unknown' END AS output_type,
  CASE WHEN p_size > 40 THEN true END AS io_link,
  CASE WHEN length(p_name) <= 8 THEN 'M8' WHEN length(p_name) <= 9 THEN 'M12'
    WHEN length(p_name) <= 10 THEN 'cable' WHEN length(p_name) <= 11 THEN 'unknown' END AS connector,
  CASE WHEN length(p_name) <= 9 THEN CASE WHEN p_size > 25 THEN 4 ELSE 5 END END AS connector_pins,
  CASE WHEN n_lines > 32 THEN 67 WHEN n_lines > 28 THEN 65 WHEN n_lines > 25 THEN 69 END AS ip_rating,
  CASE WHEN n_lines > 25 AND n_lines <= 28 THEN true END AS ip69k,
  q_lo * 10 AS sensing_range_min_mm,
  q_hi * 40 AS sensing_range_max_mm,
  q_slow / 10 AS response_time_ms,
  q_slow * 100 AS switching_frequency_hz,
  CASE WHEN q_volt IS NOT NULL AND p_size > 5 THEN cast(10 AS double) END AS supply_voltage_min_v,
  q_volt + 10 AS supply_voltage_max_v,
  0 - q_temp AS operating_temp_min_c,
  CASE WHEN p_size < 45 THEN q_temp + 30 END AS operating_temp_max_c,
  CASE p_type WHEN 'STANDARD' THEN 'diffuse' WHEN 'LARGE' THEN 'through-beam' WHEN 'MEDIUM' THEN 'encoder'
    WHEN 'PROMO' THEN 'fluid' END AS principle,
  CASE WHEN p_type IN ('STANDARD', 'LARGE') THEN 'sensor_principle'
    WHEN p_type IN ('MEDIUM', 'PROMO') THEN 'category' END AS principle_source,
  CASE WHEN p_size <= 12 THEN 'metal' WHEN p_size <= 24 THEN 'plastic' WHEN p_size <= 30 THEN 'other' END AS housing,
  CASE WHEN p_size > 42 THEN 'laser' WHEN p_size > 30 THEN 'red' WHEN p_size > 27 THEN 'other' END AS light,
  CASE WHEN p_size BETWEEN 14 AND 18 THEN 'switching_output|connection'
    WHEN p_size BETWEEN 43 AND 47 THEN 'sensing_range_max_mm' END AS flags
FROM {part} LEFT JOIN {line_stats} ON l_partkey = p_partkey
"""

# One requirement per nation: their number does not grow with the data.
REQS = """
SELECT concat('nation-', cast(n_nationkey AS string)) AS req_id,
  CASE n_regionkey WHEN 0 THEN 'PNP|PNP/NPN' WHEN 1 THEN 'NPN' WHEN 2 THEN 'push-pull|relay' END AS output_type,
  CASE n_nationkey WHEN 23 THEN true WHEN 24 THEN false END AS io_link,
  CASE WHEN n_nationkey < 10 THEN 'M8|M12' WHEN n_nationkey < 14 THEN 'cable' END AS connector,
  CASE WHEN n_nationkey BETWEEN 5 AND 9 THEN 4 END AS connector_pins,
  CASE WHEN n_regionkey IN (1, 3) THEN 65 END AS min_ip_rating,
  CASE WHEN n_nationkey IN (20, 21) THEN true WHEN n_nationkey = 22 THEN false END AS ip69k,
  CASE WHEN n_regionkey = 3 THEN cast(-20 AS double) END AS temp_lo,
  CASE WHEN n_regionkey IN (1, 3) THEN cast(60 AS double) END AS temp_hi,
  CASE WHEN n_regionkey IN (0, 2) THEN floor(max(c_acctbal) / 25) END AS range_lo,
  CASE WHEN n_regionkey IN (2, 4) THEN floor(max(c_acctbal) / 12) END AS range_hi,
  CASE WHEN n_regionkey = 0 THEN cast(3 AS double) END AS response_hi,
  CASE WHEN n_regionkey = 4 THEN cast(1000 AS double) END AS freq_lo,
  CASE WHEN n_regionkey = 2 THEN cast(24 AS double) END AS volt_lo,
  CASE WHEN n_regionkey IN (2, 3) THEN cast(30 AS double) END AS volt_hi,
  CASE WHEN n_nationkey > 15 THEN 'diffuse|through-beam' END AS principle,
  CASE WHEN n_regionkey = 4 THEN 'metal|plastic' END AS housing,
  CASE WHEN n_nationkey IN (2, 4, 6) THEN 'laser|red' END AS light,
  CASE WHEN n_nationkey IN (3, 8, 13) THEN 'standard|promo' END AS section,
  CASE WHEN n_regionkey = 1 THEN 'product' END AS row_type,
  CASE WHEN n_nationkey = 11 THEN 'brand#1|brand#2|brand#3' END AS family
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
GROUP BY n_nationkey, n_regionkey
"""

ENRICHED = """
SELECT ord, order_number, type_code, family, section, row_type, category, source_page, product_url, product_name,
  CASE section WHEN 'STANDARD' THEN 'photoelectric' WHEN 'LARGE' THEN 'proximity' WHEN 'SMALL' THEN 'distance'
    WHEN 'MEDIUM' THEN 'encoder' WHEN 'PROMO' THEN 'safety_optoelectronic' END AS solution_class,
  section = 'PROMO' AS is_safety_product,
  CASE WHEN pdf_page <= 12 THEN 'diffuse' WHEN pdf_page <= 24 THEN 'opposed' WHEN pdf_page <= 36 THEN 'retroreflective' END AS sensing_mode,
  sensing_range_min_mm, sensing_range_max_mm,
  CASE WHEN output_type <> 'unknown' THEN lower(output_type) END AS switching_output,
  CASE WHEN ip_rating IS NOT NULL THEN concat('IP', cast(ip_rating AS string)) END AS enclosure_rating,
  CASE WHEN ip_rating IS NOT NULL AND pdf_page > 3 THEN 6 END AS ip_ingress,
  CASE ip_rating WHEN 67 THEN 7 WHEN 65 THEN 5 WHEN 69 THEN 9 END AS ip_water,
  CASE WHEN ip_rating IS NOT NULL THEN ip_rating = 69 END AS washdown_capable,
  operating_temp_min_c, operating_temp_max_c, response_time_ms,
  CASE WHEN section = 'PROMO' THEN sensing_range_max_mm END AS protective_field_height_mm,
  CASE WHEN section = 'PROMO' THEN sensing_range_min_mm / 10 END AS safety_resolution_mm,
  CASE WHEN io_link THEN 'IO-Link|USB' WHEN connector = 'M12' THEN 'SSI' END AS protocol_list,
  lower(concat(product_name, ' | ', section)) AS search_blob
FROM {catalog}
"""

SCORING_REQS = """
SELECT concat('nation-', cast(n_nationkey AS string)) AS req_id,
  CASE n_regionkey WHEN 0 THEN 'photoelectric|proximity' WHEN 1 THEN 'safety_optoelectronic' WHEN 2 THEN 'distance' END AS class_list,
  CASE WHEN n_nationkey < 12 THEN 'opposed|diffuse' END AS preferred_list,
  CASE WHEN n_nationkey BETWEEN 8 AND 15 THEN 'retroreflective' END AS discouraged_list,
  CASE WHEN n_regionkey IN (0, 2, 3) THEN floor(max(c_acctbal) / 12) END AS target_distance_mm,
  CASE WHEN n_regionkey = 1 THEN cast(900 AS double) END AS field_height_mm,
  CASE WHEN n_regionkey = 1 THEN cast(30 AS double) END AS safety_resolution_mm,
  CASE WHEN n_nationkey IN (1, 4, 7, 12) THEN 6 END AS min_ip_ingress,
  CASE WHEN n_nationkey IN (1, 5, 7, 13) THEN 7 END AS min_ip_water,
  n_nationkey IN (2, 16) AS washdown,
  CASE WHEN n_regionkey = 4 THEN cast(-20 AS double) END AS min_temp_c,
  CASE WHEN n_nationkey IN (9, 14, 19, 24) THEN cast(55 AS double) END AS max_temp_c,
  CASE WHEN n_regionkey IN (3, 4) THEN 'io-link|profinet' END AS protocol_list,
  CASE WHEN n_nationkey IN (0, 3, 10) THEN 'PNP' END AS switching_output,
  CASE WHEN n_regionkey = 2 THEN cast(2 AS double) END AS max_response_ms,
  CASE WHEN n_nationkey > 10 THEN 'red|bolt|standard' END AS keyword_list,
  CASE WHEN n_nationkey > 12 THEN 'es' ELSE 'en' END AS language,
  n_nationkey = 17 AS safety_related,
  CASE WHEN n_nationkey = 18 THEN '100 EUR/unit' END AS budget
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
GROUP BY n_nationkey, n_regionkey
"""

# Searchable cards of the catalog: one per product and one per family; a vector and a question each by number.
CARDS = """
SELECT concat('sku:', order_number) AS id, 'sku' AS kind, concat('family:', section, ':', coalesce(family, '(no family)')) AS document_id,
  order_number, family, section, source_page, pdf_page, ord, concat_ws(' ', product_name, type_code, category, family, row_type) AS text
FROM {catalog}
UNION ALL
SELECT concat('family:', section, ':', coalesce(family, '(no family)')), 'family', concat('family:', section, ':', coalesce(family, '(no family)')),
  NULL, family, section, min(source_page), min(pdf_page), min(ord), concat_ws(' ', 'family', section, max(category), family)
FROM {catalog} GROUP BY section, family
"""

CARD_VECTORS = "SELECT id AS chunk_id, embedding FROM {cards} JOIN {embeddings} ON vec_id = ord % 500"

# A question per requirement, one without a requirement, and a blank one.
CARD_QUERIES = """
SELECT req_id AS query_id, req_id, embedding,
  concat_ws(' ', 'red bolt', replace(section, '|', ' '), replace(connector, '|', ' '), replace(family, '|', ' ')) AS text
FROM {reqs} JOIN {embeddings} ON concat('nation-', cast(vec_id AS string)) = req_id
UNION ALL
SELECT CASE vec_id WHEN 40 THEN 'free' ELSE 'blank' END, NULL, embedding, CASE vec_id WHEN 40 THEN 'blue bolt family' ELSE ' ' END
FROM {embeddings} WHERE vec_id IN (40, 41)
"""

# The catalog as it is printed: every text and number that a card can show, for some of the rows.
SHOWN = """
SELECT ord, order_number, row_type, section, family, category, source_page, pdf_page, type_code, product_name, product_url,
  CASE WHEN pdf_page % 4 = 0 THEN 'mini' END AS subfamily, output_type AS switching_output,
  CASE WHEN pdf_page % 3 = 0 THEN 'light/dark' END AS output_function, connector AS connection, principle AS sensor_principle,
  CASE WHEN pdf_page % 5 = 0 THEN 'background' END AS detection_principle, light AS light_type,
  CASE WHEN ip_rating IS NOT NULL THEN concat('IP ', cast(ip_rating AS string)) END AS enclosure_rating, housing AS housing_material,
  CASE WHEN pdf_page % 7 = 0 THEN repeat(concat(product_name, ' '), 25) END AS short_description,
  CASE WHEN io_link THEN 'IO-Link' END AS interface, CASE WHEN pdf_page % 2 = 0 THEN 'round spot' END AS light_spot,
  CASE WHEN pdf_page % 9 = 0 THEN ' teach-in ' END AS adjustment, CASE WHEN pdf_page % 6 = 0 THEN repeat('screw ', 30) END AS scope_of_delivery,
  sensing_range_min_mm, sensing_range_max_mm, supply_voltage_min_v, supply_voltage_max_v, response_time_ms, switching_frequency_hz,
  operating_temp_min_c, operating_temp_max_c, CASE WHEN pdf_page % 8 = 0 THEN cast(0.25 AS double) END AS resolution_value,
  CASE WHEN pdf_page % 16 = 0 THEN 'mm' END AS resolution_unit, cast(pdf_page * 30 AS double) AS output_current_max_ma,
  CASE WHEN pdf_page % 3 = 1 THEN concat('weight|', cast(pdf_page AS string), ' g|blank| |note|', repeat('text ', 20), '|made in|here|fifth|lost') END AS spec_text
FROM {catalog}
"""

DERIVED = {
    "line_stats": LINE_STATS,
    "catalog": CATALOG,
    "reqs": REQS,
    "enriched": ENRICHED,
    "scoring_reqs": SCORING_REQS,
    "shown": SHOWN,
    "cards": CARDS,
    "card_vectors": CARD_VECTORS,
    "card_queries": CARD_QUERIES,
}


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", sql)))


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def derive(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table, or a derived one built from the given tables it names."""
    return read(spark, sf, name) if name in GIVEN else run(spark, sf, DERIVED[name])


def run(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{n: derive(spark, sf, n) for n in names_in(sql)})


def oracle(sql: str) -> str:
    """The same text for DuckDB: derived tables become CTEs in order of need."""
    needed: list[str] = []

    def need(text: str) -> None:
        for n in names_in(text):
            if n in DERIVED and n not in needed:
                need(DERIVED[n])
                needed.append(n)

    need(sql)
    plain = lambda text: re.sub(r"\{([a-z]\w*)\}", r"\1", text).strip()
    ctes = [f"{n} AS ({plain(DERIVED[n])})" for n in needed]
    body = plain(sql)
    if not ctes:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return head + ", ".join(ctes) + ", " + body[len(head):]
    return "WITH " + ", ".join(ctes) + " " + body


def split_list(name: str):
    return F.when(F.col(name).isNotNull(), F.split(name, r"\|"))


def products(spark: SparkSession, sf: str) -> DataFrame:
    """The derived catalog in the product schema, with ``ord``; spec columns travel along for :func:`specs`."""
    return derive(spark, sf, "catalog")


def specs(spark: SparkSession, sf: str) -> DataFrame:
    return complete(derive(spark, sf, "catalog").withColumn("low_confidence", split_list("flags")), SPEC)


def requirements(spark: SparkSession, sf: str) -> DataFrame:
    rows = derive(spark, sf, "reqs")
    lists = ["output_type", "connector", "principle", "housing", "light", "section", "row_type", "family"]
    none = F.lit(None).cast("double")

    def span(low, high):
        low = F.col(low).cast("double") if low else none
        high = F.col(high).cast("double") if high else none
        return F.when(low.isNotNull() | high.isNotNull(), F.struct(low.alias("min"), high.alias("max")))

    spans = {
        "operating_temp_c": span("temp_lo", "temp_hi"),
        "sensing_range_mm": span("range_lo", "range_hi"),
        "response_time_ms": span(None, "response_hi"),
        "switching_frequency_hz": span("freq_lo", None),
        "supply_voltage_v": span("volt_lo", "volt_hi"),
    }
    return complete(rows.withColumns({**{c: split_list(c) for c in lists}, **spans}), REQUIREMENT)


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    rows = derive(spark, sf, "enriched")
    return rows.withColumn("protocols", split_list("protocol_list"))


def scoring_requirements(spark: SparkSession, sf: str) -> DataFrame:
    rows = derive(spark, sf, "scoring_reqs")
    modes = lambda c: F.transform(split_list(c), lambda m: F.struct(m.alias("mode"), F.lit("").alias("reason")))
    return complete(
        rows.withColumns(
            {
                "solution_classes": split_list("class_list"),
                "preferred_modes": modes("preferred_list"),
                "discouraged_modes": modes("discouraged_list"),
                "protocols": split_list("protocol_list"),
                "keywords": split_list("keyword_list"),
                "target_distance_mm": F.col("target_distance_mm").cast("double"),
            }
        ),
        SCORING_REQUIREMENT,
    )


def full_products(spark: SparkSession, sf: str) -> DataFrame:
    """The derived catalog with every column of the product schema, and ``ord``."""
    rows = derive(spark, sf, "catalog").withColumn("low_confidence", split_list("flags"))
    return complete(rows, PRODUCT + ", ord BIGINT")
