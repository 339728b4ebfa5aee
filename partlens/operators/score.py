"""Weighted fit and evidence scoring with ordered relaxation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlens.functions.text import number_text
from partlens.functions.units import range_fit
from partlens.operators.links import top_accessories
from partlens.plans.scale import clamp_k, pair_with_all, top_k
from partlens.session import cut_lineage
from partlens.sources.schemas import ENRICHED, SCORING_REQUIREMENT, complete

NOT_APPLICABLE, UNVERIFIED, SATISFIED, VIOLATED = "not_applicable", "unverified", "satisfied", "violated"
# How much of the rank is owed to fit alone, and how much evidence adds.
FIT_SHARE, EVIDENCE_SHARE = 0.55, 0.45


@dataclass(frozen=True)
class Outcome:
    """One scoring constraint: its status, its score in 0..1 and the reason, as columns."""

    status: Column
    score: Column
    detail: Callable[[], Column]


def _outcome(asked: Column, silent: Column, violated: Column, score: Column | float,
             detail: Callable[[], Column]) -> Outcome:
    """Absent request, absent value, violation, match: in that order."""
    status = (
        F.when(~F.coalesce(asked, F.lit(False)), NOT_APPLICABLE)
        .when(F.coalesce(violated, F.lit(False)), VIOLATED)
        .when(silent, UNVERIFIED)
        .otherwise(SATISFIED)
    )
    value = score if isinstance(score, Column) else F.lit(float(score))
    return Outcome(status, F.when(status == SATISFIED, value).otherwise(0.0), detail)


def _number(c: Column) -> Callable[[], Column]:
    return lambda: number_text(c)


def _say(*parts: str | Column | Callable[[], Column]) -> Callable[[], Column]:
    """A reason, built only when it is asked for."""

    def build() -> Column:
        columns = [F.lit(p) if isinstance(p, str) else p if isinstance(p, Column) else p() for p in parts]
        return F.concat(*[F.coalesce(c.cast("string"), F.lit("not stated")) for c in columns])

    return build


def _filled(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0)) > 0


def solution_class(p: Column, r: Column) -> Outcome:
    wanted = r["solution_classes"]
    value = p["solution_class"]
    return _outcome(_filled(wanted), value.isNull(), ~F.array_contains(wanted, value), 1,
                    _say("solution class ", value))


def sensing_mode(p: Column, r: Column) -> Outcome:
    mode = p["sensing_mode"]
    same = lambda m: m["mode"] == mode
    preferred, discouraged = r["preferred_modes"], r["discouraged_modes"]
    unsuitable = F.coalesce(F.exists(discouraged, same), F.lit(False))
    place = F.array_position(F.transform(preferred, lambda m: m["mode"]), mode)
    score = F.when(place > 0, F.greatest(F.lit(0.5), 1 - (place - 1) * 0.15)).otherwise(0.25)
    return _outcome(_filled(preferred) | unsuitable, mode.isNull(), unsuitable, score, _say("sensing mode ", mode))


def sensing_range(p: Column, r: Column) -> Outcome:
    target, low, high = r["target_distance_mm"], p["sensing_range_min_mm"], p["sensing_range_max_mm"]
    violated = F.coalesce(target < low, F.lit(False)) | F.coalesce(high < target, F.lit(False))
    return _outcome(target.isNotNull(), high.isNull(), violated, range_fit(target, high),
                    _say("reaches ", _number(high), " mm for a target at ", _number(target), " mm"))


def field_height(p: Column, r: Column) -> Outcome:
    needed, stated = r["field_height_mm"], p["protective_field_height_mm"]
    score = F.greatest(F.lit(0.5), 1 - (stated / needed - 1) * 0.4)
    return _outcome(needed.isNotNull(), stated.isNull(), stated < needed, score,
                    _say("protective field of ", _number(stated), " mm for ", _number(needed), " mm"))


def safety_resolution(p: Column, r: Column) -> Outcome:
    needed, stated = r["safety_resolution_mm"], p["safety_resolution_mm"]
    return _outcome(needed.isNotNull(), stated.isNull(), stated > needed, 1,
                    _say("resolution of ", _number(stated), " mm for ", _number(needed), " mm"))


def ingress(p: Column, r: Column, half_open: str = "violate") -> Outcome:
    """``half_open`` says what a rating with only one stated digit means for the other one."""
    solid, liquid = p["ip_ingress"], p["ip_water"]
    want_solid, want_liquid = r["min_ip_ingress"], r["min_ip_water"]
    washdown = F.coalesce(r["washdown"], F.lit(False))
    silent = solid.isNull() & liquid.isNull()
    if half_open == "violate":
        short = F.coalesce(F.coalesce(solid, F.lit(0)) < want_solid, F.lit(False)) | F.coalesce(
            F.coalesce(liquid, F.lit(0)) < want_liquid, F.lit(False)
        )
        unsure = silent
    else:
        short = F.coalesce(solid < want_solid, F.lit(False)) | F.coalesce(liquid < want_liquid, F.lit(False))
        unsure = silent | (want_solid.isNotNull() & solid.isNull()) | (want_liquid.isNotNull() & liquid.isNull())
    no_washdown = washdown & ~F.coalesce(p["washdown_capable"], F.lit(False))
    asked = want_solid.isNotNull() | want_liquid.isNotNull() | washdown
    return _outcome(asked, unsure, ~silent & (no_washdown | short), 1, _say("rated ", p["enclosure_rating"]))


def temperature(p: Column, r: Column, half_open: str = "violate") -> Outcome:
    low, high = p["operating_temp_min_c"], p["operating_temp_max_c"]
    want_low, want_high = r["min_temp_c"], r["max_temp_c"]
    silent = low.isNull() & high.isNull()
    open_side = (want_low.isNotNull() & low.isNull()) | (want_high.isNotNull() & high.isNull())
    beyond = F.coalesce(low > want_low, F.lit(False)) | F.coalesce(high < want_high, F.lit(False))
    if half_open == "violate":
        violated, unsure = ~silent & (beyond | open_side), silent
    else:
        violated, unsure = beyond, silent | open_side
    return _outcome(want_low.isNotNull() | want_high.isNotNull(), unsure, violated, 1,
                    _say("rated ", _number(low), " to ", _number(high), " °C"))


def switching_output(p: Column, r: Column) -> Outcome:
    wanted, stated = r["switching_output"], p["switching_output"]
    return _outcome(wanted.isNotNull(), stated.isNull(), ~F.contains(F.upper(stated), wanted), 1, _say("output ", stated))


def response_time(p: Column, r: Column) -> Outcome:
    wanted, stated = r["max_response_ms"], p["response_time_ms"]
    return _outcome(wanted.isNotNull(), stated.isNull(), stated > wanted, 1, _say("responds in ", _number(stated), " ms"))


def protocols(p: Column, r: Column) -> Outcome:
    """Soft: a list that lacks a protocol does not prove the device lacks it."""
    lower = lambda a: F.transform(a, lambda x: F.lower(x))
    wanted, stated = r["protocols"], p["protocols"]
    hits = F.filter(stated, lambda x: F.array_contains(lower(wanted), F.lower(x)))
    return _outcome(_filled(wanted), ~_filled(stated), F.lit(False), F.size(hits) / F.size(wanted),
                    _say("protocols ", F.array_join(hits, ", ")))


def keywords(p: Column, r: Column) -> Outcome:
    wanted = r["keywords"]
    hits = F.filter(wanted, lambda k: F.contains(p["search_blob"], F.lower(k)))
    return _outcome(_filled(wanted), F.lit(False), F.lit(False), F.size(hits) / F.size(wanted),
                    _say("text mentions ", F.array_join(hits, ", ")))


@dataclass(frozen=True)
class Constraint:
    name: str
    weight: float
    hard: bool
    build: Callable[[Column, Column], Outcome]


# Weight of each constraint, and whether violating it excludes a product.
CONSTRAINTS = [
    Constraint("solution_class", 3.0, True, solution_class),
    Constraint("sensing_mode", 3.0, True, sensing_mode),
    Constraint("sensing_range", 2.5, True, sensing_range),
    Constraint("protective_field_height", 2.5, True, field_height),
    Constraint("safety_resolution", 2.5, True, safety_resolution),
    Constraint("ingress_protection", 2.0, True, ingress),
    Constraint("ambient_temperature", 1.5, True, temperature),
    Constraint("switching_output", 1.0, True, switching_output),
    Constraint("response_time", 1.0, True, response_time),
    Constraint("communication_protocol", 1.5, False, protocols),
    Constraint("application_keywords", 1.0, False, keywords),
]


def relaxation_order(constraints: list[Constraint]) -> list[str]:
    """Hard constraints, cheapest first; declaration order among equals."""
    return [c.name for c in sorted((c for c in constraints if c.hard), key=lambda c: c.weight)]


def fit_evidence(outcomes: list[tuple[Constraint, Outcome]]) -> tuple[Column, Column, Column]:
    """(fit, evidence, rank score) of a row; weights are summed in declaration order."""
    verified = applicable = earned = F.lit(0.0)
    for c, o in outcomes:
        known = o.status.isin(SATISFIED, VIOLATED)
        verified = verified + F.when(known, c.weight).otherwise(0.0)
        applicable = applicable + F.when(o.status != NOT_APPLICABLE, c.weight).otherwise(0.0)
        earned = earned + F.when(known, o.score * c.weight).otherwise(0.0)
    fit = F.when(verified == 0, 0.0).otherwise(earned / verified)
    evidence = F.when(applicable == 0, 1.0).otherwise(verified / applicable)
    return fit, evidence, fit * (FIT_SHARE + EVIDENCE_SHARE * evidence)


def fit_evidence_long(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """The same scores out of long-form outcomes (status, score, weight) as one grouped aggregate."""
    known = F.col("status").isin(SATISFIED, VIOLATED)
    sums = outcomes.groupBy(*keys).agg(
        F.sum(F.when(known, F.col("weight")).otherwise(0.0)).alias("verified"),
        F.sum(F.when(F.col("status") != NOT_APPLICABLE, F.col("weight")).otherwise(0.0)).alias("applicable"),
        F.sum(F.when(known, F.col("score") * F.col("weight")).otherwise(0.0)).alias("earned"),
    )
    fit = F.when(F.col("verified") == 0, 0.0).otherwise(F.col("earned") / F.col("verified"))
    evidence = F.when(F.col("applicable") == 0, 1.0).otherwise(F.col("verified") / F.col("applicable"))
    scored = sums.select(*keys, fit.alias("fit"), evidence.alias("evidence"))
    return scored.withColumn("rank_score", F.col("fit") * (FIT_SHARE + EVIDENCE_SHARE * F.col("evidence")))


def score_pairs(pairs: DataFrame, constraints: list[Constraint] = CONSTRAINTS, details: bool = False) -> DataFrame:
    """Scores of rows with struct columns ``p`` (product) and ``r`` (requirement).

    ``level`` is the place in the relaxation order of the last hard constraint
    the row violates (0 when it violates none): the number of constraints that
    must be given up before the row survives.
    """
    made = [(c, c.build(F.col("p"), F.col("r"))) for c in constraints]
    staged = [F.col("r.req_id").alias("req_id"), F.col("p.order_number").alias("order_number"), F.col("p.ord").alias("ord")]
    for i, (_, o) in enumerate(made):
        staged += [o.status.alias(f"_s{i}"), o.score.alias(f"_v{i}")] + ([o.detail().alias(f"_d{i}")] if details else [])
    rows = pairs.select(*staged)
    built = [(c, Outcome(F.col(f"_s{i}"), F.col(f"_v{i}"), partial(F.col, f"_d{i}"))) for i, c in enumerate(constraints)]
    fit, evidence, _ = fit_evidence(built)
    place = {name: i + 1 for i, name in enumerate(relaxation_order(constraints))}
    level = F.lit(0)
    excluded = []
    for c, o in built:
        if c.hard:
            level = F.greatest(level, F.when(o.status == VIOLATED, place[c.name]).otherwise(0))
            excluded.append(F.when(o.status == VIOLATED, F.lit(c.name)))
    out = [
        "req_id",
        "order_number",
        "ord",
        fit.alias("fit"),
        evidence.alias("evidence"),
        level.alias("level"),
        F.coalesce(*excluded).alias("violates"),
    ]
    if details:
        entries = [
            F.struct(F.lit(c.name).alias("constraint"), o.status.alias("status"), o.score.alias("score"),
                     F.lit(c.weight).alias("weight"), F.lit(c.hard).alias("hard"), o.detail().alias("detail"))
            for c, o in built
        ]
        out.append(F.array(*entries).alias("outcomes"))
    rank_score = F.col("fit") * (FIT_SHARE + EVIDENCE_SHARE * F.col("evidence"))
    return rows.select(*out).withColumn("rank_score", rank_score)


def _with_ord(products: DataFrame) -> DataFrame:
    """Products of the enriched schema with ``ord``, the input position that breaks ties."""
    full = complete(products, ENRICHED + (", ord BIGINT" if "ord" in products.columns else ""))
    return full if "ord" in products.columns else full.withColumn("ord", F.monotonically_increasing_id())


def _all_pairs(products: DataFrame, reqs: DataFrame) -> DataFrame:
    rows = _with_ord(products)
    packed = rows.select("order_number", F.struct(*rows.columns).alias("p"))
    return pair_with_all(packed, complete(reqs, SCORING_REQUIREMENT), "r")


def with_relaxation(scored: DataFrame) -> DataFrame:
    """Add ``req_level``: the fewest constraints to give up so that any product of the requirement survives.

    One aggregate and an equi-join; nothing is scored twice per step.
    """
    levels = scored.groupBy("req_id").agg(
        F.min("level").alias("req_level"), F.count("*").alias("pool"),
    )
    return scored.join(levels, "req_id").withColumn("survives", F.col("level") <= F.col("req_level"))


def excluded_by(req_level: Column, outcomes: Column, constraints: list[Constraint] = CONSTRAINTS) -> Column:
    """First violated hard constraint in declaration order that is not among the ones given up."""
    order = F.array(*[F.lit(n) for n in relaxation_order(constraints)])
    given_up = F.slice(order, F.lit(1), req_level)
    counted = F.filter(
        outcomes, lambda o: (o["status"] == VIOLATED) & o["hard"] & ~F.array_contains(given_up, o["constraint"])
    )
    return F.try_element_at(counted, F.lit(1))["constraint"]


def relaxed_names(req_level: Column, constraints: list[Constraint] = CONSTRAINTS) -> Column:
    order = F.array(*[F.lit(n) for n in relaxation_order(constraints)])
    return F.when(req_level > 0, F.array_join(F.slice(order, F.lit(1), req_level), ", "))


# Scored rows that a task gathers before it ranks them.
GATHERED = 100_000


def best_by_level(scored: DataFrame, limit: int) -> DataFrame:
    """What each task knows of its scored rows, read once: for every (req_id, level) how many there are (``n``), and the best ``limit`` rows.

    Only the rows of a requirement's lowest level can survive, and a task's lowest
    level is never under the lowest of all, so rows are kept of that level alone.  The
    counts stand in rows without an order number.
    """
    names = ["req_id", "level", "n", "order_number", "ord", "fit", "evidence", "rank_score"]

    def compact(rows: pa.Table) -> pa.Table:
        req = rows.column("req_id").combine_chunks().dictionary_encode()
        req = (req.chunk(0) if isinstance(req, pa.ChunkedArray) else req).indices.to_numpy()
        level, score, place = (rows.column(c).to_numpy() for c in ("level", "rank_score", "ord"))
        order = np.lexsort((place, -score, level, req))
        first = np.concatenate([[True], req[order][1:] != req[order][:-1]])
        starts = np.flatnonzero(first)[np.cumsum(first) - 1]
        kept = (level[order] == level[order][starts]) & (np.arange(len(order)) - starts < limit)
        return rows.take(pa.array(order[kept]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, int]] = Counter()
        held: list[pa.Table] = []
        schema = None
        for batch in batches:
            schema = batch.schema
            found = pa.Table.from_batches([batch])
            tally = found.group_by(["req_id", "level"]).aggregate([([], "count_all")])
            for req, level, n in zip(*(tally.column(c).to_pylist() for c in ("req_id", "level", "count_all")), strict=True):
                counts[req, level] += n
            held.append(found)
            if sum(t.num_rows for t in held) >= GATHERED:
                held = [compact(pa.concat_tables(held))]
        if not counts:
            return
        told = pa.table({"req_id": pa.array([r for r, _ in counts], pa.string()), "level": pa.array([v for _, v in counts], pa.int32()), "n": pa.array(counts.values(), pa.int64())})
        best = compact(pa.concat_tables(held))
        for rows in (told, best):
            columns = [rows.column(c) if c in rows.column_names else pa.nulls(rows.num_rows, pa.int64() if c == "n" else schema.field(c).type) for c in names]
            yield from pa.table(columns, names=names).to_batches()

    narrow = scored.select("req_id", "order_number", F.col("ord").cast("long").alias("ord"), "fit", "evidence", F.col("level").cast("int").alias("level"), "rank_score")
    return narrow.mapInArrow(run, "req_id string, level int, n long, order_number string, ord long, fit double, evidence double, rank_score double")


def score_catalog(products: DataFrame, reqs: DataFrame, limit: int = 12, include_accessories: bool = False,
                  constraints: list[Constraint] = CONSTRAINTS) -> DataFrame:
    """The best surviving products per requirement, with the relaxation that let them survive and true totals.

    The pairs are scored once: each task counts its levels and keeps the best rows of
    the lowest one, and the level of a requirement is chosen from what the tasks tell.
    """
    pool = products if include_accessories else products.filter("row_type = 'product'")
    k = clamp_k(limit, 12)
    told = cut_lineage(best_by_level(score_pairs(_all_pairs(pool, reqs), constraints), k))
    counts = told.filter("n is not null").groupBy("req_id", "level").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("req_id").agg(F.min("level").alias("req_level"), F.min_by("n", "level").alias("survivors"), F.sum("n").alias("_all"))
    totals = totals.select("req_id", "req_level", "survivors", (F.col("_all") - F.col("survivors")).alias("excluded"))
    alive = told.filter("n is null").drop("n").join(totals, "req_id").filter("level = req_level")
    best = top_k(alive, ["req_id"], [F.desc("rank_score"), F.asc("ord")], k)
    return best.withColumn("relaxed", relaxed_names(F.col("req_level"), constraints))


def excluded_products(products: DataFrame, reqs: DataFrame, constraints: list[Constraint] = CONSTRAINTS) -> DataFrame:
    """Every excluded (requirement, product) with the constraint that excluded it."""
    pool = products.filter("row_type = 'product'")
    scored = with_relaxation(score_pairs(_all_pairs(pool, reqs), constraints, details=True)).filter("not survives")
    return scored.select("req_id", "order_number", excluded_by(F.col("req_level"), F.col("outcomes")).alias("excluded_by"))


def violation_counts(products: DataFrame, reqs: DataFrame, constraints: list[Constraint] = CONSTRAINTS) -> DataFrame:
    """(req_id, mask, products): how many products violate exactly the hard constraints whose bits, in declaration order, are set.

    One pass over the pairs and one partial aggregate: a requirement has at most as
    many rows as there are sets of hard constraints.
    """
    hard = [c for c in constraints if c.hard]
    mask = F.lit(0)
    for i, c in enumerate(hard):
        mask = mask + F.when(c.build(F.col("p"), F.col("r")).status == VIOLATED, 1 << i).otherwise(0)
    pool = products.filter("row_type = 'product'")
    return _all_pairs(pool, reqs).select(F.col("r.req_id").alias("req_id"), mask.alias("mask")).groupBy("req_id", "mask").agg(F.count("*").alias("products"))


def excluded_counts(products: DataFrame, reqs: DataFrame, constraints: list[Constraint] = CONSTRAINTS) -> DataFrame:
    """(req_id, excluded_by, products): how many products each constraint excludes once the requirement is relaxed as far as it must be."""
    counted = cut_lineage(violation_counts(products, reqs, constraints))
    hard = [c.name for c in constraints if c.hard]
    place = {name: i + 1 for i, name in enumerate(relaxation_order(constraints))}
    violated = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    level = F.greatest(F.lit(0), *[F.when(violated(i), place[n]).otherwise(0) for i, n in enumerate(hard)])
    placed = counted.withColumn("level", level)
    levels = placed.groupBy("req_id").agg(F.min("level").alias("req_level"))
    out = placed.join(levels, "req_id").filter("level > req_level")
    first = F.coalesce(*[F.when(violated(i) & (F.col("req_level") < place[n]), n) for i, n in enumerate(hard)])
    return out.groupBy("req_id", first.alias("excluded_by")).agg(F.sum("products").alias("products"))


def reasons(outcomes: Column, facts: Column, limit: int = 4) -> Column:
    """The details that earned most, else the product's stated facts."""
    earned = F.filter(outcomes, lambda o: (o["status"] == SATISFIED) & (o["score"] > 0))
    keyed = F.transform(
        earned,
        lambda o, i: F.struct((-o["weight"] * o["score"]).alias("gain"), i.alias("i"), o["detail"].alias("detail")),
    )
    best = F.transform(F.slice(F.array_sort(keyed), 1, limit), lambda o: o["detail"])
    return F.when(F.size(best) > 0, best).otherwise(F.slice(facts, 1, limit))


# Notices of a consultation, by language.
NOTICES = {
    "relaxed": {"en": "Nothing satisfies every stated constraint; given up: ", "es": "Nada cumple todas las restricciones; se omite: "},
    "undiagnosed": {"en": "Ranked by text and range only; no sensing principle was stated.",
                    "es": "Orden por texto y alcance; no se indicó principio de detección."},
    "safety": {"en": "Safety device: a risk assessment is still required.",
               "es": "Producto de seguridad: se requiere una evaluación de riesgos."},
    "none": {"en": "No product satisfies the stated constraints.", "es": "Ningún producto cumple las restricciones."},
    "budget": {"en": "Budget not applied: the catalog carries no prices: ", "es": "Presupuesto no aplicado: el catálogo no incluye precios: "},
}


def _notice(kind: str) -> Column:
    text = NOTICES[kind]
    return F.when(F.col("language") == "es", text["es"]).otherwise(text["en"])


def consult(products: DataFrame, reqs: DataFrame, limit: int = 8, alternatives: int = 3, accessories: int = 6) -> DataFrame:
    """One row per requirement: primary, alternatives, accessories, what is unverified, and notices."""
    req = complete(reqs, SCORING_REQUIREMENT)
    rows = _with_ord(products)
    ranked = score_catalog(products, reqs, limit)
    wanted = cut_lineage(ranked.filter(F.col("rank") <= 1 + alternatives))
    # At most 1 + alternatives rows per requirement, with all that is told of them: the catalog is read once for it.
    shown = cut_lineage(wanted.join(rows.select("order_number", F.struct(*rows.columns).alias("p")), "order_number"))
    pairs = shown.select("req_id", "p").join(req.select("req_id", F.struct(*req.columns).alias("r")), "req_id")
    told = score_pairs(pairs.drop("req_id"), details=True).select("req_id", "order_number", "outcomes")
    facts = F.array_compact(
        F.array(
            F.concat(F.lit("detection principle: "), "p.sensing_mode"),
            F.concat(F.lit("sensing range up to "), number_text(F.col("p.sensing_range_max_mm")), F.lit(" mm")),
            F.concat(F.lit("enclosure rating "), "p.enclosure_rating"),
            F.concat(F.lit("output "), "p.switching_output"),
            F.concat(F.lit("connection: "), "p.connection"),
            F.concat(F.lit("listed on page "), "p.source_page"),
        )
    )
    unverified = F.transform(F.filter("outcomes", lambda o: o["status"] == UNVERIFIED), lambda o: o["constraint"])
    answers = shown.join(told, ["req_id", "order_number"]).select(
        "req_id", "rank", "survivors", "excluded", "relaxed", "p.is_safety_product",
        F.struct(
            "rank", "order_number", "p.type_code", "p.family", "p.solution_class", "p.sensing_mode",
            F.round("fit", 3).alias("fit"), F.round("evidence", 3).alias("evidence"),
            reasons(F.col("outcomes"), facts).alias("why"),
            unverified.alias("unverified"),
        ).alias("answer"),
    )
    # At most 1 + alternatives rows per requirement reach the aggregate.
    grouped = answers.groupBy("req_id").agg(
        F.array_sort(F.collect_list("answer")).alias("answers"),
        F.max("survivors").alias("survivors"),
        F.max("excluded").alias("excluded"),
        F.max("relaxed").alias("relaxed"),
        F.bool_or("is_safety_product").alias("safety_seen"),
    )
    primary = shown.filter("rank = 1").select("req_id", "order_number", "p.family", "p.source_page", "p.row_type")
    offered = top_accessories(
        primary.filter("row_type = 'product'").select("order_number", "family", "source_page").distinct(),
        rows.filter("row_type = 'accessory'").select("order_number", "family", "source_page", "ord"),
        accessories,
    )
    extras = primary.select("req_id", "order_number").join(offered, "order_number").select("req_id", F.col("accessories").alias("complete_with"))
    out = req.select("req_id", "language", "solution_classes", "preferred_modes", "keywords", "safety_related", "budget")
    out = out.join(grouped, "req_id", "left").join(extras, "req_id", "left")
    no_anchor = ~_filled(F.col("solution_classes")) & ~_filled(F.col("preferred_modes")) & _filled(F.col("keywords"))
    safety = F.coalesce(F.col("safety_related"), F.lit(False)) | F.coalesce(F.col("safety_seen"), F.lit(False))
    return out.select(
        "req_id",
        F.try_element_at("answers", F.lit(1)).alias("recommendation"),
        F.slice("answers", 2, alternatives).alias("alternatives"),
        "complete_with",
        F.coalesce("survivors", F.lit(0)).alias("survivors"),
        F.coalesce("excluded", F.lit(0)).alias("excluded"),
        F.array_compact(
            F.array(
                F.concat(_notice("relaxed"), F.col("relaxed")),
                F.when(no_anchor, _notice("undiagnosed")),
                F.when(F.col("answers").isNull(), _notice("none")),
                F.when(safety, _notice("safety")),
            )
        ).alias("notices"),
        F.concat(_notice("budget"), F.col("budget")).alias("not_applied"),
    )
