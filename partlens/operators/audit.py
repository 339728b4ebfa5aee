"""Challenges, confidence, losses, first survivors, fact checks and compatibility checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.functions.text import field_key, number_text, quoted_in, squeeze
from partlens.functions.units import asserted_value, close_to
from partlens.plans.scale import first_by
from partlens.session import cut_lineage

# How many ranked candidates are attacked, and the order of confidence levels.
MAX_CHALLENGED = 4
LEVELS = ["low", "medium", "high"]
DENIAL = "(?i)\\b(no|not|none|without|lacks?|lacking|missing|absent|unsupported|false|sin)\\b"


def challenges(solved: DataFrame) -> DataFrame:
    """Every objection the verdicts raise, in long form: fails are fatal and upheld, silence is major and unverifiable."""
    v = F.col("v")
    rows = solved.select("req_id", "order_number", F.explode("verdicts").alias("v"))
    shaky = (v["status"] == "pass") & v["low_confidence"]
    severity = F.when(v["status"] == "fail", "fatal").when(v["status"] == "unknown", "major").when(shaky, "minor")
    return rows.withColumn("severity", severity).filter("severity is not null").select(
        "req_id", "order_number", v["field"].alias("field"), "severity",
        F.when(F.col("severity") == "fatal", "upheld").otherwise("unverifiable").alias("verdict"),
        v["detail"].alias("evidence"),
    )


def survives(objections: Column) -> Column:
    """Whether an array of objections holds no upheld fatal one."""
    return ~F.exists(objections, lambda c: (c["severity"] == "fatal") & (c["verdict"] == "upheld"))


def judge(solved: DataFrame) -> DataFrame:
    """Confidence and survival of solved rows from their own verdicts, without a join."""
    serious = F.exists("verdicts", lambda v: v["status"].isin("fail", "unknown"))
    level = (
        F.when((F.size("verdicts") == 0) | (F.col("failed") > 0) | (F.col("unknown") > 0), "low")
        .when(serious, "medium")
        .otherwise("high")
    )
    return solved.withColumns({"confidence": level, "survives": F.col("failed") == 0})


def survival(raised: DataFrame, solved: DataFrame) -> DataFrame:
    """survives per solved row, as one aggregate over the objections."""
    dead = raised.filter("severity = 'fatal' and verdict = 'upheld'").select("req_id", "order_number").distinct()
    dead = dead.withColumn("_dead", F.lit(True))
    return solved.join(dead, ["req_id", "order_number"], "left").withColumn("survives", F.col("_dead").isNull()).drop("_dead")


def confidence(solved: DataFrame, raised: DataFrame | None = None) -> DataFrame:
    """low on no verdicts, a fail or an unknown; medium on a serious objection; else high."""
    rows = solved
    if raised is not None:
        serious = raised.filter("severity in ('fatal', 'major') and verdict in ('upheld', 'unverifiable')")
        marked = serious.select("req_id", "order_number").distinct().withColumn("_serious", F.lit(True))
        rows = rows.join(marked, ["req_id", "order_number"], "left")
    else:
        rows = rows.withColumn("_serious", F.lit(None).cast("boolean"))
    level = (
        F.when((F.size("verdicts") == 0) | (F.col("failed") > 0) | (F.col("unknown") > 0), "low")
        .when(F.col("_serious"), "medium")
        .otherwise("high")
    )
    return rows.withColumn("confidence", level).drop("_serious")


def cap_confidence(claimed: Column, n_checks: Column, n_warnings: Column, n_unverified: Column, n_dropped: Column) -> Column:
    """A claimed level, never above what the checks allow."""
    place = lambda c: F.array_position(F.array(*[F.lit(x) for x in LEVELS]), c)
    cap = (
        F.when((n_checks == 0) | (n_warnings > 0), "low")
        .when((n_unverified > 0) | (n_dropped > 0), "medium")
        .otherwise("high")
    )
    return F.when(place(claimed) <= place(cap), claimed).otherwise(cap)


def losses() -> Column:
    """What is given up with a solved row: violations first, then what cannot be confirmed; distinct."""
    fails = F.transform(F.filter("verdicts", lambda v: v["status"] == "fail"), lambda v: F.concat(v["field"], F.lit(": "), v["detail"]))
    silent = F.transform(F.filter("verdicts", lambda v: v["status"] == "unknown"), lambda v: F.concat(F.lit("unverifiable: "), v["detail"]))
    return F.array_distinct(F.concat(fails, silent))


def tradeoffs() -> Column:
    fails = F.transform(F.filter("verdicts", lambda v: v["status"] == "fail"), lambda v: F.concat(F.lit("violates: "), v["detail"]))
    risks = F.transform(
        F.filter("verdicts", lambda v: (v["status"] == "unknown") | ((v["status"] == "pass") & v["low_confidence"])),
        lambda v: F.concat(F.lit("unquantified risk: "), v["field"]),
    )
    return F.array_distinct(F.concat(fails, risks))


def first_survivor(ranked: DataFrame, ceiling: int = MAX_CHALLENGED) -> DataFrame:
    """Per requirement the first surviving candidate among the best ``ceiling``, and what died before it.

    ``ranked`` carries req_id, order_number, rank and survives.  The cut comes
    first, so an aggregate over a handful of rows per requirement remains.
    """
    head = ranked.filter(F.col("rank") <= ceiling)
    alive = F.min(F.when(F.col("survives"), F.col("rank")))
    summary = head.groupBy("req_id").agg(
        alive.alias("survivor_rank"),
        F.count("*").alias("n_head"),
        F.min_by("order_number", "rank").alias("closest"),
        F.map_from_entries(F.collect_list(F.struct("rank", "order_number"))).alias("_by_rank"),
    )
    at = lambda r: F.try_element_at("_by_rank", r)
    rank = F.col("survivor_rank")
    return summary.select(
        "req_id",
        at(rank).alias("order_number"),
        F.coalesce(rank, F.col("n_head")).cast("int").alias("n_challenged"),
        F.when(rank > 1, at(rank - 1)).alias("promoted_from"),
        F.when(rank.isNull(), F.col("closest")).alias("closest"),
    )


def fact_check(claims: DataFrame, described: DataFrame, units: dict[str, str]) -> DataFrame:
    """Test each claim (claim_id, order_number, field, asserted, verdict) against the long-form specs.

    A claim the catalog contradicts is refuted; an upheld claim on a silent field
    becomes unverifiable; anything else keeps its verdict.  Text agrees by
    containment, numbers within 5 %, a flag is only contradicted by a denial.
    """
    facts = described.select(
        "order_number", field_key(F.col("field")).alias("key"), F.col("stated"), F.col("value"), F.col("catalog_text")
    )
    asked = claims.withColumn("key", field_key(F.col("field")))
    rows = asked.join(facts, ["order_number", "key"], "left")
    lookup = F.create_map(*[F.lit(x) for pair in units.items() for x in (pair[0].replace("_", ""), pair[1])])
    unit = F.try_element_at(lookup, F.col("key"))
    number = asserted_value(F.col("asserted"), unit)
    fact_number = F.col("value").try_cast("double")
    squash = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    said = squash(F.col("asserted"))

    def agrees(text: Column) -> Column:
        folded = squash(text)
        return F.coalesce((folded != "") & (F.contains(folded, said) | F.contains(said, folded)), F.lit(False))

    is_flag = F.col("value").isin("true", "false")
    contradicted = (
        F.when(is_flag, (F.col("value") == "true") & F.col("asserted").rlike(DENIAL))
        .when(unit.isNotNull(), number.isNotNull() & ~close_to(fact_number, number))
        .otherwise((said != "") & ~agrees(F.col("value")) & ~agrees(F.col("catalog_text")))
    )
    known_field = F.col("stated").isNotNull() & F.col("asserted").isNotNull()
    checked = (
        F.when(known_field & F.col("stated") & F.coalesce(contradicted, F.lit(False)), "refuted")
        .when(known_field & ~F.col("stated") & (F.col("verdict") == "upheld"), "unverifiable")
        .otherwise(F.col("verdict"))
    )
    cited = known_field & F.col("stated")
    return rows.select("claim_id", "order_number", "field", checked.alias("verdict"),
                       F.coalesce(cited, F.lit(False)).alias("cited"))


def quote_check(claims: DataFrame, texts: DataFrame, answered: DataFrame | None = None) -> DataFrame:
    """A claim (source_id, field, status, quote) counts as stated only if its quote is in the text, or it was answered."""
    rows = claims.join(texts.select("source_id", "text"), "source_id", "left")
    if answered is None:
        rows = rows.withColumn("_answered", F.lit(False))
    else:
        marks = answered.select("source_id", "field").distinct().withColumn("_answered", F.lit(True))
        rows = rows.join(marks, ["source_id", "field"], "left")
    found = (F.col("status") == "stated") & quoted_in(F.col("quote"), F.col("text"))
    stated = F.coalesce(F.col("_answered"), F.lit(False)) | F.coalesce(found, F.lit(False))
    return rows.select("source_id", "field", "quote", stated.alias("stated"))


CABLE_ROLES = ["cable", "connector"]


def compat_checks(lines: DataFrame, designs: DataFrame) -> DataFrame:
    """Checks of every design's lines: range, output, voltage, connector, washdown and fitment.

    ``lines`` is (design_id, order_number, role) joined with its spec columns;
    ``designs`` is (design_id, sensing_distance_mm, output_type, supply_voltage_v,
    washdown).  Connector checks meet per distinct connector value of a design,
    not per pair of lines.
    """
    needed = ["design_id", "order_number", "role", "sensing_range_max_mm", "output_type", "supply_voltage_min_v", "supply_voltage_max_v", "ip_rating", "ip69k", "connector"]
    # A few narrow columns that the checks of rows, designs and connectors read.
    lines = cut_lineage(lines.select(*needed))
    rows = lines.join(designs.withColumnRenamed("output_type", "want_output"), "design_id")
    ok = lambda c: F.when(c, "ok").otherwise("warning")
    sensor = F.col("role") == "sensor"
    stated_output = F.col("output_type").isNotNull() & (F.col("output_type") != "unknown")
    fits = (F.col("output_type") == F.col("want_output")) | (F.col("output_type") == "PNP/NPN") | (F.col("want_output") == "PNP/NPN")
    powered = F.col("supply_voltage_v").isNotNull()
    has_window = F.col("supply_voltage_min_v").isNotNull() | F.col("supply_voltage_max_v").isNotNull()
    in_window = F.coalesce(F.col("supply_voltage_v") >= F.col("supply_voltage_min_v"), F.lit(True)) & F.coalesce(
        F.col("supply_voltage_v") <= F.col("supply_voltage_max_v"), F.lit(True)
    )
    of_row = {
        "range": (sensor & F.col("sensing_distance_mm").isNotNull(),
                  F.when(F.col("sensing_range_max_mm").isNull(), "unverified").otherwise(ok(F.col("sensing_range_max_mm") >= F.col("sensing_distance_mm")))),
        "output": (sensor & F.col("want_output").isNotNull(), F.when(~stated_output, "unverified").otherwise(ok(fits))),
        "voltage": (powered & has_window, ok(in_window)),
        "washdown": (sensor & F.col("washdown"), F.when(F.col("ip_rating").isNull(), "unverified").otherwise(ok(F.coalesce(F.col("ip69k"), F.lit(False))))),
    }
    made = F.array_compact(F.array(*[F.when(asked, F.struct(F.lit(kind).alias("check"), status.alias("status"))) for kind, (asked, status) in of_row.items()]))
    none = F.lit(None).cast("string")
    rows_told = rows.select("design_id", "order_number", F.explode(made).alias("c")).select("design_id", "c.check", "order_number", none.alias("with"), "c.status")
    seen = rows.groupBy("design_id").agg(F.bool_or(powered).alias("powered"), F.bool_or(powered & has_window).alias("window"), F.bool_or(~sensor).alias("extras"))
    dark = F.when(F.col("powered") & ~F.col("window"), F.lit("voltage"))
    told = F.array_compact(F.array(dark, F.when(F.col("extras"), F.lit("fitment"))))
    designs_told = seen.select("design_id", F.explode(told).alias("check"), none.alias("order_number"), none.alias("with"), F.lit("unverified").alias("status"))
    return rows_told.unionByName(designs_told).unionByName(connector_compat(lines))


def connector_compat(lines: DataFrame) -> DataFrame:
    """Each sensor against each distinct cordset connector of its design; a plug without any cordset is a warning.

    Cordsets are reduced to one row per (design, connector) with their smallest
    order number and count, so a design with many alike lines makes few checks.
    """
    known = F.when(F.col("connector") != "unknown", F.col("connector"))
    sensors = lines.filter("role = 'sensor'").select("design_id", "order_number", known.alias("plug"), "connector")
    cords = (
        lines.filter(F.col("role").isin(*CABLE_ROLES))
        .groupBy("design_id", known.alias("socket"))
        .agg(F.min("order_number").alias("with"))
    )
    met = sensors.join(cords, "design_id").select(
        "design_id", F.lit("connector").alias("check"), "order_number", "with",
        F.when(F.col("plug").isNull() | F.col("socket").isNull(), "unverified")
        .when(F.col("plug") == F.col("socket"), "ok")
        .otherwise("warning").alias("status"),
    )
    bare = sensors.filter("connector is not null and connector <> 'cable'").join(cords.select("design_id"), "design_id", "left_anti")
    missing = bare.select("design_id", F.lit("cordset").alias("check"), "order_number",
                          F.lit(None).cast("string").alias("with"), F.lit("warning").alias("status"))
    return met.unionByName(missing)


def distinct_citations(cited: DataFrame, order: str = "ord") -> DataFrame:
    """Citations of each report (report_id, source_page, pdf_page, order_number) once, where first cited."""
    return first_by(cited, ["report_id", "source_page", "pdf_page", "order_number"], [order], [order])


def retrieval_query(reqs: DataFrame, terms: dict[str, dict[str, str]], max_chars: int = 600) -> DataFrame:
    """Search text of a requirement: its description, then the words each constraint stands for."""
    def words(field: str) -> Column:
        table = terms.get(field)
        values = F.filter(field, lambda v: v.isNotNull() & (v != "unknown"))
        if table:
            lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
            values = F.transform(values, lambda v: F.try_element_at(lookup, v))
        return F.nullif(F.array_join(F.array_compact(values), " "), F.lit(""))

    distance = F.coalesce("sensing_range_mm.max", "sensing_range_mm.min")
    parts = F.concat_ws(
        " ",
        F.col("description") if "description" in reqs.columns else F.lit(None).cast("string"),
        *[words(f) for f in ("principle", "housing", "light", "output_type", "connector")],
        F.when(F.col("io_link"), "IO-Link"),
        F.concat(F.lit("IP "), number_text(F.col("min_ip_rating"))),
        F.when(F.col("ip69k"), "IP 69K"),
        F.concat(number_text(distance), F.lit(" mm")),
        F.concat(number_text(F.col("response_time_ms.max")), F.lit(" ms")),
    )
    return reqs.select("req_id", F.rtrim(F.substring(squeeze(parts), 1, max_chars)).alias("text"))
