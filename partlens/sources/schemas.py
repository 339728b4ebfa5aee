"""Table schemas, as Spark DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PRODUCT_TEXT = [
    "type_code", "family", "subfamily", "product_name", "product_url", "resolution_unit", "switching_output",
    "output_function", "connection", "scope_of_delivery", "sensor_principle", "detection_principle", "light_type",
    "light_spot", "adjustment", "enclosure_rating", "housing_material", "interface", "short_description",
]
PRODUCT_NUMBERS = [
    "sensing_range_min_mm", "sensing_range_max_mm", "supply_voltage_min_v", "supply_voltage_max_v",
    "output_current_max_ma", "response_time_ms", "switching_frequency_hz", "operating_temp_min_c",
    "operating_temp_max_c", "resolution_value",
]
PRODUCT_IDENTITY = ["order_number", "row_type", "category", "section", "source_page"]
ROW_TYPES = ["product", "accessory"]

PRODUCT = (
    "order_number STRING, row_type STRING, category STRING, section STRING, source_page STRING, pdf_page INT, "
    "occurrences INT, also_on_pages ARRAY<STRING>, "
    + ", ".join(f"{c} STRING" for c in PRODUCT_TEXT)
    + ", "
    + ", ".join(f"{c} DOUBLE" for c in PRODUCT_NUMBERS)
    + ", other_specs MAP<STRING,STRING>, provenance MAP<STRING,STRING>, low_confidence ARRAY<STRING>"
)
FAMILY = (
    "section STRING, category STRING, family STRING, product_variants INT, accessory_rows INT, n_pages INT, "
    "pages ARRAY<STRING>, product_url STRING"
)
SPEC = (
    "order_number STRING, output_type STRING, io_link BOOLEAN, output_count INT, output_current_max_ma DOUBLE, "
    "connector STRING, connector_pins INT, ip_rating INT, ip69k BOOLEAN, sensing_range_min_mm DOUBLE, "
    "sensing_range_max_mm DOUBLE, response_time_ms DOUBLE, switching_frequency_hz DOUBLE, "
    "supply_voltage_min_v DOUBLE, supply_voltage_max_v DOUBLE, operating_temp_min_c DOUBLE, "
    "operating_temp_max_c DOUBLE, principle STRING, principle_source STRING, housing STRING, light STRING, "
    "low_confidence ARRAY<STRING>"
)
_INTERVAL = "STRUCT<min:DOUBLE,max:DOUBLE>"
REQUIREMENT = (
    "req_id STRING, output_type ARRAY<STRING>, io_link BOOLEAN, connector ARRAY<STRING>, connector_pins INT, "
    "min_ip_rating INT, ip69k BOOLEAN, "
    f"operating_temp_c {_INTERVAL}, sensing_range_mm {_INTERVAL}, response_time_ms {_INTERVAL}, "
    f"switching_frequency_hz {_INTERVAL}, supply_voltage_v {_INTERVAL}, "
    "principle ARRAY<STRING>, housing ARRAY<STRING>, light ARRAY<STRING>, section ARRAY<STRING>, "
    "row_type ARRAY<STRING>, family ARRAY<STRING>"
)
_MODE = "ARRAY<STRUCT<mode:STRING,reason:STRING>>"
SCORING_REQUIREMENT = (
    f"req_id STRING, solution_classes ARRAY<STRING>, preferred_modes {_MODE}, discouraged_modes {_MODE}, "
    "target_distance_mm DOUBLE, field_height_mm DOUBLE, safety_resolution_mm DOUBLE, min_ip_ingress INT, "
    "min_ip_water INT, washdown BOOLEAN, min_temp_c DOUBLE, max_temp_c DOUBLE, protocols ARRAY<STRING>, "
    "switching_output STRING, max_response_ms DOUBLE, keywords ARRAY<STRING>, language STRING, "
    "safety_related BOOLEAN, budget STRING"
)
ENRICHED = (
    "order_number STRING, type_code STRING, family STRING, subfamily STRING, row_type STRING, category STRING, "
    "section STRING, source_page STRING, product_url STRING, product_name STRING, short_description STRING, "
    "solution_class STRING, is_safety_product BOOLEAN, sensing_mode STRING, measurand STRING, "
    "sensing_range_min_mm DOUBLE, sensing_range_max_mm DOUBLE, switching_output STRING, output_function STRING, "
    "connection STRING, enclosure_rating STRING, ip_ingress INT, ip_water INT, washdown_capable BOOLEAN, "
    "housing_material STRING, operating_temp_min_c DOUBLE, operating_temp_max_c DOUBLE, resolution_value STRING, "
    "resolution_unit STRING, interface STRING, response_time_ms DOUBLE, supply_voltage_min_v DOUBLE, "
    "supply_voltage_max_v DOUBLE, sensor_principle STRING, detection_principle STRING, light_type STRING, "
    "scope_of_delivery STRING, protective_field_height_mm DOUBLE, safety_resolution_mm DOUBLE, "
    "protocols ARRAY<STRING>, search_blob STRING, other_specs MAP<STRING,STRING>, "
    "derived_from MAP<STRING,STRING>, low_confidence ARRAY<STRING>, accessory_order_numbers ARRAY<STRING>"
)
COMPETITOR = (
    "vendor STRING, series STRING, model STRING, product_category STRING, product_subtype STRING, "
    "description STRING, source_page INT, source_pages ARRAY<INT>, "
    "sensing_modes ARRAY<STRUCT<mode:STRING,variant:STRING,range_max_mm:DOUBLE,focus_mm:DOUBLE,material:STRING>>, "
    "outputs ARRAY<STRUCT<type:STRING,detail:STRING,current_ma:DOUBLE>>, "
    "connections ARRAY<STRUCT<type:STRING,detail:STRING>>, features ARRAY<STRING>, housing_material STRING, "
    "enclosure_rating STRING, operating_temp_min_c DOUBLE, operating_temp_max_c DOUBLE, "
    "supply_voltage_dc_min_v DOUBLE, supply_voltage_dc_max_v DOUBLE, supply_voltage_ac_raw STRING, "
    "dimensions_mm STRING, other_specs MAP<STRING,STRING>, provenance MAP<STRING,STRING>, low_confidence ARRAY<STRING>"
)
CROSSREF = (
    "from_series STRING, from_model STRING, from_mode STRING, from_range_max_mm DOUBLE, to_type_code STRING, "
    "to_order_number STRING, to_family STRING, adequate BOOLEAN, confidence STRING, rationale STRING, source STRING"
)
CHUNK = (
    "id STRING, kind STRING, document_id STRING, chunk_index INT, text STRING, order_number STRING, family STRING, "
    "section STRING, category STRING, row_type STRING, source_page STRING, pdf_page INT"
)
TRACE = "run_id STRING, type STRING, at DOUBLE, label STRING, payload STRING"


def complete(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with exactly the columns of a schema; the ones it lacks are typed NULLs."""
    schema = StructType.fromDDL(ddl)
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
