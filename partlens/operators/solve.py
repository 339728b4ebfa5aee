"""Constraint solving: verdicts per (requirement, product), ranking by evidence, totals."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.functions import verdicts as V
from partlens.plans.scale import clamp_k, pair_with_all, shuffled, top_k
from partlens.sources.schemas import REQUIREMENT, SPEC, complete

STRUCTURE = ["section", "row_type", "family"]
SPEC_COLUMNS = [c.split()[0] for c in SPEC.split(", ")]


def attach_specs(products: DataFrame, specs: DataFrame) -> DataFrame:
    """Products with their normalized spec; a product without one keeps all-NULL fields."""
    spec = complete(specs, SPEC)
    base = products.select("order_number", *STRUCTURE)
    return base.join(spec, "order_number", "left")


def constraint_verdicts(req: Column, details: bool = True) -> list[V.Verdict]:
    """Every constraint of a requirement struct against the columns of :func:`attach_specs`."""
    c = F.col
    flag = lambda field: V.low_confidence_flag(c("low_confidence"), field) if details else None

    def enum(field: str, label: str, inconclusive: str) -> V.Verdict:
        return V.verdict_enum(field, label, c(field), req[field], (inconclusive,), flag(field))

    return [
        enum("output_type", "output type", "unknown"),
        V.verdict_flag("io_link", "IO-Link", c("io_link"), req["io_link"], flag("io_link")),
        enum("connector", "connection", "unknown"),
        V.verdict_exact("connector_pins", "pin count", c("connector_pins"), req["connector_pins"], flag("connector_pins")),
        V.verdict_min("min_ip_rating", "enclosure rating", c("ip_rating"), req["min_ip_rating"], flag("min_ip_rating")),
        V.verdict_flag_with_witness("ip69k", "IP69K rating", c("ip69k"), c("ip_rating"), req["ip69k"], flag("ip69k")),
        V.verdict_contains("operating_temp_c", "operating temperature", "°C", c("operating_temp_min_c"),
                           c("operating_temp_max_c"), req["operating_temp_c"], flag("operating_temp_c")),
        V.verdict_window_cover("sensing_range_mm", "sensing range", "mm", c("sensing_range_min_mm"),
                               c("sensing_range_max_mm"), req["sensing_range_mm"], flag("sensing_range_mm")),
        V.verdict_scalar("response_time_ms", "response time", "ms", c("response_time_ms"),
                         req["response_time_ms"], flag("response_time_ms")),
        V.verdict_scalar("switching_frequency_hz", "switching frequency", "Hz", c("switching_frequency_hz"),
                         req["switching_frequency_hz"], flag("switching_frequency_hz")),
        V.verdict_within("supply_voltage_v", "supply voltage", "V", c("supply_voltage_min_v"),
                         c("supply_voltage_max_v"), req["supply_voltage_v"], flag("supply_voltage_v")),
        V.downgrade_inferred(enum("principle", "sensing principle", "unknown"), c("principle_source")),
        enum("housing", "housing", "other"),
        enum("light", "light source", "other"),
        V.verdict_structural("section", "catalog section", c("section"), req["section"]),
        V.verdict_structural("row_type", "row type", c("row_type"), req["row_type"], ignore_case=False),
        V.verdict_structural("family", "family", c("family"), req["family"]),
    ]


def _count(n: int, status: str) -> Column:
    total = F.lit(0)
    for i in range(n):
        total = total + F.when(F.col(f"_s{i}") == status, 1).otherwise(0)
    return total


def evaluate(pairs: DataFrame, req: str = "req", details: bool = True) -> DataFrame:
    """Verdicts and counters of (product, requirement) rows made by :func:`attach_specs` plus a struct ``req``.

    Statuses are columns of their own first, so that each is computed once and
    read by all three counters.
    """
    verdicts = constraint_verdicts(F.col(req), details)
    n = len(verdicts)
    staged = [v.status.alias(f"_s{i}") for i, v in enumerate(verdicts)]
    if details:
        staged += [v.detail().alias(f"_d{i}") for i, v in enumerate(verdicts)]
        staged += [v.flagged.alias(f"_f{i}") for i, v in enumerate(verdicts)]
    rows = pairs.select(F.col(f"{req}.req_id").alias("req_id"), "order_number", *staged)
    out = [
        "req_id",
        "order_number",
        _count(n, V.PASS).alias("passed"),
        _count(n, V.FAIL).alias("failed"),
        _count(n, V.UNKNOWN).alias("unknown"),
    ]
    if details:
        told = [V.Verdict(v.field, F.col(f"_s{i}"), partial(F.col, f"_d{i}"), F.col(f"_f{i}")).struct() for i, v in enumerate(verdicts)]
        out.append(F.array_compact(F.array(*told)).alias("verdicts"))
    return rows.select(*out).withColumn("viable", F.col("failed") == 0)


def _structure_may_hold(row_req: Column) -> Column:
    """False only where a stated section, row type or family of the row contradicts the requirement."""
    ok = F.lit(True)
    for name in STRUCTURE:
        wanted = F.array_compact(row_req[name])
        value = F.col(name)
        if name != "row_type":
            wanted, value = F.transform(wanted, lambda x: F.upper(x)), F.upper(value)
        silent = (F.coalesce(F.size(wanted), F.lit(0)) <= 0) | value.isNull()
        ok = ok & (silent | F.array_contains(wanted, value))
    return ok


def solve_order() -> list[Column]:
    return [F.col("viable").desc(), F.col("failed"), F.col("unknown"), F.col("passed").desc(), F.col("order_number")]


def _pairs(products: DataFrame, specs: DataFrame, reqs: DataFrame, viable_only: bool) -> DataFrame:
    keep = _structure_may_hold if viable_only else None
    return pair_with_all(attach_specs(products, specs), complete(reqs, REQUIREMENT), "req", keep)


def solve(products: DataFrame, specs: DataFrame, reqs: DataFrame, k: int | None = None,
          viable_only: bool = False, details: bool = True) -> DataFrame:
    """The best ``k`` products of every requirement, ordered by how well the catalog evidences them.

    Pairs are ranked on five narrow columns; the verdict texts are built for the
    winners only.
    """
    k = clamp_k(k, 20)
    counted = evaluate(_pairs(products, specs, reqs, viable_only), details=False)
    if viable_only:
        counted = counted.filter("viable")
    best = top_k(counted, ["req_id"], solve_order(), k)
    if not details:
        return best
    return explain(best, products, specs, reqs)


def explain(ranked: DataFrame, products: DataFrame, specs: DataFrame, reqs: DataFrame) -> DataFrame:
    """Verdict details for given (req_id, order_number) rows, through equi-joins only."""
    req = complete(reqs, REQUIREMENT)
    packed = req.select(F.col("req_id"), F.struct(*req.columns).alias("req"))
    pairs = ranked.select("req_id", "order_number").join(attach_specs(products, specs), "order_number")
    told = evaluate(pairs.join(packed, "req_id")).select("req_id", "order_number", "verdicts")
    return ranked.join(told, ["req_id", "order_number"])


def solve_candidates(products: DataFrame, specs: DataFrame, reqs: DataFrame, candidates: DataFrame,
                     k: int | None = None) -> DataFrame:
    """Solve each requirement over its own candidate list (req_id, order_number).

    An id the catalog does not carry is ignored; a requirement without rows in
    ``candidates`` has an empty list and yields nothing; a row with a NULL order number
    stands for the whole catalog.
    """
    n = clamp_k(k, 20)
    listed = candidates.select("req_id", "order_number").distinct()
    req = complete(reqs, REQUIREMENT)
    packed = req.select(F.col("req_id"), F.struct(*req.columns).alias("req"))
    pairs = listed.join(attach_specs(products, specs), "order_number").join(packed, "req_id")
    whole = listed.filter("order_number is null").select("req_id").distinct()
    some = top_k(evaluate(pairs.join(whole, "req_id", "left_anti")), ["req_id"], solve_order(), n)
    free = req.join(whole, "req_id", "left_semi")
    return some if free.isEmpty() else some.unionByName(solve(products, specs, free, n).select(*some.columns))


def prefilter(products: DataFrame, specs: DataFrame, reqs: DataFrame) -> DataFrame:
    """(req_id, order_number) of every product without a stated violation."""
    counted = evaluate(_pairs(products, specs, reqs, viable_only=True), details=False)
    return counted.filter("viable").select("req_id", "order_number")


def prefilter_pairs(products: DataFrame, specs: DataFrame, reqs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (req_id, order_number) without a stated violation; only these are evaluated."""
    req = complete(reqs, REQUIREMENT)
    packed = req.select("req_id", F.struct(*req.columns).alias("req"))
    named = pairs.select("req_id", "order_number").distinct()
    # Catalog and specs grow with the input; the bytes of their files say little of what a broadcast of them takes.
    met = named.join(shuffled(attach_specs(products, shuffled(specs))), "order_number").join(packed, "req_id")
    return evaluate(met, details=False).filter("viable").select("req_id", "order_number")


def solve_totals(products: DataFrame, specs: DataFrame, reqs: DataFrame) -> DataFrame:
    """Evaluated, viable, disqualified and fully verified products per requirement."""
    counted = evaluate(_pairs(products, specs, reqs, viable_only=False), details=False)
    return counted.groupBy("req_id").agg(
        F.count("*").alias("evaluated"),
        F.count_if("viable").alias("viable"),
        F.count_if(~F.col("viable")).alias("disqualified"),
        F.count_if(F.col("viable") & (F.col("unknown") == 0)).alias("fully_verified"),
    )


def expand_enum(reqs: DataFrame, rules: dict[str, dict[str, list[str]]]) -> DataFrame:
    """Add the values that also satisfy a requested one, e.g. output PNP is met by PNP/NPN."""
    changes = {}
    for field, table in rules.items():
        lookup = F.create_map(*[x for v, more in table.items() for x in (F.lit(v), F.array(*[F.lit(m) for m in more]))])
        nothing = F.array().cast("array<string>")
        extra = F.flatten(F.transform(field, lambda v: F.coalesce(F.try_element_at(lookup, v), nothing)))
        changes[field] = F.array_distinct(F.concat(F.col(field), extra))
    return reqs.withColumns(changes)


def evidence_summary(solved: DataFrame) -> DataFrame:
    """Which constraints of a solved row could not be verified, and a sentence about the evidence."""
    silent = F.transform(F.filter("verdicts", lambda v: v["status"] == V.UNKNOWN), lambda v: v["field"])
    text = (
        F.when(F.col("failed") > 0, F.concat(F.lit("Disqualified: "), F.col("failed"), F.lit(" stated value(s) violate the requirement.")))
        .when(F.col("unknown") == 0, F.concat(F.lit("All "), F.col("passed"), F.lit(" constraint(s) verified.")))
        .otherwise(F.concat(F.col("passed"), F.lit(" verified, "), F.col("unknown"), F.lit(" unverified: "),
                            F.array_join("unverified", ", "), F.lit(".")))
    )
    return solved.withColumn("unverified", silent).withColumn("evidence", text)
