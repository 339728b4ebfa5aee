"""Long-form specs, comparisons, sufficiency of a requirement, questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.functions.text import field_key, number_text
from partlens.plans.scale import top_k
from partlens.sources.schemas import PRODUCT, REQUIREMENT, SPEC, complete

# Fixed values: (field, label, kind, catalog fields behind it, column that holds the value).
SPEC_FIELDS = [
    ("principle", "Sensing principle", "normalized", ["sensor_principle", "detection_principle"], "spec"),
    ("sensing_range_min_mm", "Sensing range, minimum (mm)", "normalized", ["sensing_range_min_mm"], "spec"),
    ("sensing_range_max_mm", "Sensing range, maximum (mm)", "normalized", ["sensing_range_max_mm"], "spec"),
    ("output_type", "Switching output type", "normalized", ["switching_output"], "spec"),
    ("output_count", "Number of switching outputs", "normalized", ["switching_output"], "spec"),
    ("io_link", "IO-Link", "flag", ["switching_output", "interface"], "spec"),
    ("output_current_max_ma", "Max output current (mA)", "normalized", ["output_current_max_ma", "switching_output"], "spec"),
    ("output_function", "Output function (light/dark operate)", "text", ["output_function"], "product"),
    ("response_time_ms", "Response time (ms)", "normalized", ["response_time_ms"], "spec"),
    ("switching_frequency_hz", "Switching frequency (Hz)", "normalized", ["switching_frequency_hz"], "spec"),
    ("supply_voltage_min_v", "Supply voltage, minimum (V)", "normalized", ["supply_voltage_min_v"], "spec"),
    ("supply_voltage_max_v", "Supply voltage, maximum (V)", "normalized", ["supply_voltage_max_v"], "spec"),
    ("connector", "Connection type", "normalized", ["connection"], "spec"),
    ("connector_pins", "Connector pin count", "normalized", ["connection"], "spec"),
    ("ip_rating", "IP enclosure rating", "normalized", ["enclosure_rating"], "spec"),
    ("ip69k", "IP69K washdown", "flag", ["enclosure_rating"], "spec"),
    ("operating_temp_min_c", "Operating temperature, minimum (°C)", "normalized", ["operating_temp_min_c"], "spec"),
    ("operating_temp_max_c", "Operating temperature, maximum (°C)", "normalized", ["operating_temp_max_c"], "spec"),
    ("housing", "Housing material", "normalized", ["housing_material"], "spec"),
    ("light", "Light source", "normalized", ["light_type"], "spec"),
    ("light_spot", "Light spot", "text", ["light_spot"], "product"),
    ("adjustment", "Adjustment", "text", ["adjustment"], "product"),
    ("interface", "Interface", "text", ["interface"], "product"),
    ("resolution", "Resolution", "text", ["resolution_value", "resolution_unit"], "product"),
    ("scope_of_delivery", "Scope of delivery", "text", ["scope_of_delivery"], "product"),
]
_NUMERIC = {c.split()[0] for c in (SPEC + ", " + PRODUCT).split(", ") if c.split()[1] in ("INT", "DOUBLE")}


def _as_text(c: Column, name: str, boolean: bool = False) -> Column:
    if boolean:
        return F.when(c, "true").when(~c, "false")
    return number_text(c) if name in _NUMERIC else c.cast("string")


def describe_specs(products: DataFrame, specs: DataFrame) -> DataFrame:
    """The whole spec surface in long form, stated or not, one row per (product, field).

    A flag is only ever asserted.  ``catalog_text`` is the printed wording:
    provenance first, then the raw value.
    """
    p, s = complete(products, PRODUCT).alias("p"), complete(specs, SPEC).alias("s")
    joined = p.join(s, F.col("p.order_number") == F.col("s.order_number"), "left")
    no_flags = F.array().cast("array<string>")
    flags = F.transform(
        F.concat(F.coalesce("p.low_confidence", no_flags), F.coalesce("s.low_confidence", no_flags)), lambda f: field_key(f)
    )
    cells = []
    for position, (field, label, kind, sources, holder) in enumerate(SPEC_FIELDS):
        if field == "resolution":
            unit = F.coalesce(F.concat(F.lit(" "), F.col("p.resolution_unit")), F.lit(""))
            value = F.concat(number_text(F.col("p.resolution_value")), unit)
        else:
            value = _as_text(F.col(f"{'s' if holder == 'spec' else 'p'}.{field}"), field, kind == "flag")
        stated = (value == "true") if kind == "flag" else value.isNotNull()
        stated = F.coalesce(stated, F.lit(False))
        quoted = [F.nullif(F.trim(F.try_element_at("p.provenance", F.lit(k))), F.lit("")) for k in sources]
        raw = [F.nullif(F.trim(_as_text(F.col(f"p.{k}"), k)), F.lit("")) for k in sources]
        text = F.coalesce(*quoted, *raw)
        names = F.array(*[F.lit(n.replace("_", "")) for n in [field, *sources]])
        cells.append(
            F.struct(
                F.lit(position).alias("position"), F.lit(field).alias("field"), F.lit(label).alias("label"),
                stated.alias("stated"), value.alias("value"),
                (F.when(stated, text) if kind == "flag" else text).alias("catalog_text"),
                (stated & F.coalesce(F.arrays_overlap(flags, names), F.lit(False))).alias("low_confidence"),
            )
        )
    return joined.select(F.col("p.order_number").alias("order_number"), F.inline(F.array(*cells)))


def not_stated(described: DataFrame) -> DataFrame:
    """The silent fields of every product, in field order; a product has a fixed number of fields."""
    silent = F.filter(F.array_sort(F.collect_list(F.struct("position", "field", "stated"))), lambda c: ~c["stated"])
    return described.groupBy("order_number").agg(F.transform(silent, lambda c: c["field"]).alias("not_stated"))


def silent_columns(fields: list[str]) -> Column:
    """The names of the given columns that are NULL on a row."""
    return F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))


def compare(described: DataFrame, groups: DataFrame, differences_only: bool = False) -> DataFrame:
    """Field by field over groups of parts (group_id, order_number).

    A field is comparable only if every found part states it; ``identical`` is
    NULL where it is not.  A group holds 2 to 5 parts, checked here.
    """
    sizes = groups.groupBy("group_id").agg(F.count_distinct("order_number").alias("asked"), F.count("*").alias("rows"))
    problem = F.when((F.col("asked") < 2) | (F.col("asked") > 5) | (F.col("asked") != F.col("rows")),
                     F.concat(F.lit("a comparison needs 2 to 5 distinct parts: group "), F.col("group_id").cast("string")))
    # A filter: unlike a column it is not pruned when the caller reads other columns or only counts.
    sizes = sizes.where(F.when(problem.isNull(), F.lit(True)).otherwise(F.raise_error(problem).cast("boolean")))
    cells = groups.join(described, "order_number")
    silent = F.array_sort(F.collect_list(F.when(~F.col("stated"), F.col("order_number"))))
    fields = cells.groupBy("group_id", "position", "field").agg(
        F.count("*").alias("found"),
        F.bool_and("stated").alias("comparable"),
        F.count_distinct(F.when(F.col("stated"), F.col("value"))).alias("_values"),
        silent.alias("not_stated_for"),
    )
    out = fields.join(sizes, "group_id").filter("found >= 2").select(
        "group_id", "position", "field", "comparable",
        F.when(F.col("comparable"), F.col("_values") == 1).alias("identical"),
        "not_stated_for",
        (F.col("asked") - F.col("found")).alias("missing_parts"),
    )
    return out.filter("not comparable or not identical") if differences_only else out


# Comparison row -> spec columns, polarity and unit.
COMPARISON_FIELDS = [
    ("principle", ["principle"], None),
    ("sensing_range_mm", ["sensing_range_min_mm", "sensing_range_max_mm"], "higher"),
    ("response_time_ms", ["response_time_ms"], "lower"),
    ("switching_frequency_hz", ["switching_frequency_hz"], "higher"),
    ("output_type", ["output_type"], None),
    ("io_link", ["io_link"], None),
    ("connector", ["connector"], None),
    ("connector_pins", ["connector_pins"], None),
    ("min_ip_rating", ["ip_rating"], "higher"),
    ("ip69k", ["ip69k"], None),
    ("operating_temp_c", ["operating_temp_min_c", "operating_temp_max_c"], None),
    ("supply_voltage_v", ["supply_voltage_min_v", "supply_voltage_max_v"], None),
    ("housing", ["housing"], None),
    ("light", ["light"], None),
]


def delta(requested: Column, value: Column, polarity: str) -> Column:
    """struct<gap, favourable>: the signed gap to what was asked; an exact hit is not favourable."""
    gap = value - requested
    favourable = gap > 0 if polarity == "higher" else gap < 0
    return F.when(gap.isNotNull(), F.struct(gap.alias("gap"), favourable.alias("favourable")))


def _asked(field: str) -> Column:
    """The largest magnitude a requirement names for a field."""
    if field == "min_ip_rating":
        return F.col("r.min_ip_rating").cast("double")
    want = F.col(f"r.{field}")
    return F.greatest(want["min"], want["max"])


def comparison(solved: DataFrame, specs: DataFrame, reqs: DataFrame) -> DataFrame:
    """Every comparison field of every solved row: match, better, worse, or unknown when either side is silent.

    ``solved`` carries req_id, order_number and verdicts.
    """
    s, r = complete(specs, SPEC).alias("s"), complete(reqs, REQUIREMENT).alias("r")
    rows = solved.alias("v").join(s, F.col("v.order_number") == F.col("s.order_number"), "left").join(
        r, F.col("v.req_id") == F.col("r.req_id")
    )
    cells = []
    for position, (field, columns, polarity) in enumerate(COMPARISON_FIELDS):
        verdict = F.try_element_at(F.filter("v.verdicts", _about(field)), F.lit(1))["status"]
        value = F.col(f"s.{columns[-1]}")
        flag = field in ("io_link", "ip69k")
        stated = F.coalesce(*[F.col(f"s.{c}").isNotNull() if not flag else F.col(f"s.{c}") for c in columns[:1]], F.lit(False))
        for c in columns[1:]:
            stated = stated | F.col(f"s.{c}").isNotNull()
        change = F.lit(None).cast("struct<gap:double,favourable:boolean>")
        if polarity:
            change = F.when(verdict != "unknown", delta(_asked(field), value.cast("double"), polarity))
        status = (
            F.when(verdict.isNull() | (verdict == "unknown") | ~stated, "unknown")
            .when(verdict == "fail", "worse")
            .when(F.coalesce(change["favourable"], F.lit(False)), "better")
            .otherwise("match")
        )
        cells.append(
            F.struct(F.lit(position).alias("position"), F.lit(field).alias("field"), status.alias("status"),
                     change["gap"].alias("gap"), stated.alias("cited"))
        )
    return rows.select(F.col("v.req_id").alias("req_id"), F.col("v.order_number").alias("order_number"), F.inline(F.array(*cells)))


# Requirement fields by what they can do for a search.
BOUNDED = ["sensing_range_mm", "response_time_ms", "switching_frequency_hz", "supply_voltage_v", "operating_temp_c"]
ELECTRICAL = ["output_type", "connector", "connector_pins", "io_link", "min_ip_rating", "ip69k"]
LISTS = ["principle", "output_type", "connector", "housing", "light", "section", "family"]
TRACKED_FIELDS = [
    "principle", "sensing_range_mm", "response_time_ms", "switching_frequency_hz", "output_type", "connector",
    "connector_pins", "min_ip_rating", "ip69k", "io_link", "supply_voltage_v", "operating_temp_c", "housing", "light",
]
STATED_ORDER = [
    "principle", "sensing_range_mm", "response_time_ms", "switching_frequency_hz", "supply_voltage_v",
    "operating_temp_c", "output_type", "connector", "connector_pins", "min_ip_rating", "ip69k", "io_link",
    "housing", "light", "section", "family",
]
QUESTION_RANK = [
    "part_number", "description", "principle", "sensing_range_mm", "output_type", "connector", "min_ip_rating",
    "response_time_ms", "switching_frequency_hz", "connector_pins", "io_link", "operating_temp_c",
    "supply_voltage_v", "housing", "light",
]
ANCHOR_BREADTH, MAX_QUESTIONS = 2, 4


def _states(field: str) -> Column:
    c = F.col(field)
    if field in BOUNDED:
        ok = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
        return ok(c["min"]) | ok(c["max"])
    if field in LISTS:
        return F.coalesce(F.exists(c, lambda v: v.isNotNull() & (v != "unknown")), F.lit(False))
    return c.isNotNull()


def stated_fields() -> Column:
    """The fields a requirement really constrains, in a fixed order."""
    return F.array_compact(F.array(*[F.when(_states(f), F.lit(f)) for f in STATED_ORDER]))


def sufficiency(reqs: DataFrame) -> DataFrame:
    """Whether a requirement can be searched: anchored, and with something a candidate can fail on."""
    req = complete(reqs, REQUIREMENT).withColumn("stated", stated_fields())
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    principles = size(F.filter("principle", lambda p: p != "unknown"))
    anchored = (
        principles.between(1, ANCHOR_BREADTH) | size("section").between(1, ANCHOR_BREADTH) | (size("family") >= 1)
    )
    order = F.array(*[F.lit(f) for f in [*BOUNDED, *ELECTRICAL]])
    tracked = F.array(*[F.lit(f) for f in TRACKED_FIELDS])
    out = req.select(
        "req_id", "stated",
        anchored.alias("anchored"),
        F.array_intersect(order, F.col("stated")).alias("discriminators"),
        F.array_except(tracked, F.col("stated")).alias("missing"),
        principles.alias("_principles"),
    )
    found = F.size("discriminators")
    out = out.withColumn("sufficient", F.col("anchored") & (found > 0))
    reason = (
        F.when(F.col("sufficient"), F.concat(F.lit("anchored, with "), found, F.lit(" constraint(s) to verify")))
        .when(~F.col("anchored") & (found == 0), "nothing anchors the search and nothing can be verified")
        .when(~F.col("anchored") & (F.col("_principles") > ANCHOR_BREADTH), "too many sensing principles to anchor the search")
        .when(~F.col("anchored"), "no principle, section or family anchors the search")
        .otherwise("anchored, but nothing a candidate could fail on")
    )
    return out.withColumn("reason", reason).drop("_principles")


def question_queue(assessed: DataFrame, limit: int = MAX_QUESTIONS) -> DataFrame:
    """The next questions of every insufficient requirement, most discriminating first, at most ``limit``."""
    rank = F.array(*[F.lit(q) for q in QUESTION_RANK])
    useful = F.array(*[F.lit(q) for q in QUESTION_RANK if q in BOUNDED or q in ELECTRICAL])
    nothing = F.array().cast("array<string>")
    anchor = F.when(~F.col("anchored"), F.array(F.lit("principle"))).otherwise(nothing)
    open_fields = F.when(F.size("discriminators") == 0, F.array_except(useful, F.col("stated"))).otherwise(nothing)
    wanted = F.slice(F.concat(anchor, open_fields), 1, limit)
    asked = assessed.filter("not sufficient").select("req_id", F.explode(wanted).alias("field"))
    placed = asked.withColumn("place", F.array_position(rank, F.col("field")))
    return top_k(placed, ["req_id"], [F.asc("place")], limit).select("req_id", "rank", "field")


def _outside(allowed: list[str]) -> Callable[[Column], Column]:
    return lambda v: ~v.isin(*allowed)


def _about(field: str) -> Callable[[Column], Column]:
    return lambda v: v["field"] == field


def validate_requirements(reqs: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """One row per problem of a requirement: value outside its domain, empty or inverted interval, nothing stated."""
    unknown = [c for c in reqs.columns if c not in {x.split()[0] for x in REQUIREMENT.split(", ")}]
    if unknown:
        raise ValueError(f"unknown requirement field(s): {', '.join(unknown)}")
    req = complete(reqs, REQUIREMENT)
    checks = []
    for field, allowed in domains.items():
        odd = F.filter(field, _outside(allowed))
        checks.append((field, F.size(odd) > 0, F.concat(F.lit("value not allowed: "), F.array_join(odd, ", "))))
    for field in BOUNDED:
        want = F.col(field)
        checks.append((field, want.isNotNull() & want["min"].isNull() & want["max"].isNull(), F.lit("interval without a bound")))
        checks.append((field, want["min"] > want["max"], F.lit("interval with min above max")))
    every = [_states(f) for f in STATED_ORDER] + [F.coalesce(F.size("row_type"), F.lit(0)) > 0]
    anything = every[0]
    for e in every[1:]:
        anything = anything | e
    checks.append((None, ~anything, F.lit("no constraint stated")))
    told = [
        F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(field).cast("string").alias("field"), why.alias("problem")))
        for field, bad, why in checks
    ]
    return req.select("req_id", F.inline(F.array_compact(F.array(*told))))


def list_family(products: DataFrame, names: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """Every asked family with its counts, pages and link; a family the catalog lacks comes back as not found."""
    asked = names.select(F.col("family").alias("asked"), F.lower("family").alias("key"))
    rows = products.filter("family is not null").groupBy(F.lower("family").alias("key")).agg(
        F.min("section").alias("section"), F.min("category").alias("category"),
        F.count_if(F.col("row_type") == "product").alias("variants"),
        F.count_if(F.col("row_type") == "accessory").alias("accessories"),
        F.array_sort(F.collect_set("source_page")).alias("pages"),
        F.min("product_url").alias("row_url"),
    )
    out = asked.join(rows, "key", "left")
    if families is not None:
        urls = families.groupBy(F.lower("family").alias("key")).agg(F.min("product_url").alias("url"))
        out = out.join(urls, "key", "left").withColumn("product_url", F.coalesce("url", "row_url")).drop("url", "row_url")
    else:
        out = out.withColumnRenamed("row_url", "product_url")
    return out.withColumn("found", F.col("section").isNotNull()).drop("key")


def family_members(products: DataFrame, names: DataFrame, include_accessories: bool = True) -> DataFrame:
    """The rows of the asked families, without case."""
    asked = names.select(F.lower("family").alias("key")).distinct()
    rows = products if include_accessories else products.filter("row_type = 'product'")
    return rows.withColumn("key", F.lower("family")).join(asked, "key", "left_semi").drop("key")


def get_product(products: DataFrame, specs: DataFrame, ids: DataFrame) -> DataFrame:
    """Each asked id with its spec surface; an id the catalog lacks comes back as not found."""
    described = describe_specs(products.join(ids.select("order_number"), "order_number", "left_semi"), specs)
    asked = ids.select("order_number").distinct()
    return asked.join(described, "order_number", "left").withColumn("found", F.col("field").isNotNull())


