"""Cross-vendor equivalence, interchange within a catalog, and derated solving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.operators.ladder import code_runs, ladder_positions, neighbours
from partlens.plans.scale import pair_with_all, top_k
from partlens.session import cut_lineage

# The score of a range ratio, and how many candidates are kept.
SCORE_TOP, SCORE_SLOPE, REACH_BONUS, KEPT = 100.0, 60.0, 8.0, 5
# Quality bands on |ln ratio|: the observed bands leave room between them.
BANDS = (("strong", 0.35), ("moderate", 1.0), ("weak", 1.8))
# Derating factor of a target's reflectivity, and the soft penalties.
REMISSION_FACTOR = {"90pct": 1.0, "20pct": 2.0, "6pct": 3.0}
CONNECTION_PENALTY, RESPONSE_PENALTY, LIGHT_PENALTY = 0.35, 0.4, 0.2
SHORTLIST = 6


def ratio_score(ratio: Column) -> Column:
    base = F.greatest(F.lit(0.0), F.lit(SCORE_TOP) - SCORE_SLOPE * F.abs(F.ln(ratio)))
    return F.least(F.lit(SCORE_TOP), base + F.when(ratio >= 1, REACH_BONUS).otherwise(0.0))


def quality(ratio: Column, bands: tuple = BANDS) -> Column:
    gap = F.abs(F.ln(ratio))
    out = None
    for name, edge in bands:
        out = F.when(gap <= edge, name) if out is None else out.when(gap <= edge, name)
    return out.otherwise("poor")


def equivalence_candidates(ours: DataFrame, theirs: DataFrame, k: int = KEPT) -> DataFrame:
    """For every product of ``ours`` (id, mode, range_max_mm) the best part of ``theirs`` of the same mode.

    The score falls with the distance of the ranges on either side, so the best
    ``k`` parts sit on the nearest ``k`` rungs above and below.  Products are
    reduced to distinct (mode, range) questions and parts to ``k`` per (mode,
    range) rung before they meet.  No range yields ``no-range`` and score 0, no
    part of the mode yields ``GAP``.
    """
    asked = ours.select("mode", F.col("range_max_mm").alias("value")).filter("mode is not null").distinct()
    rungs = top_k(
        theirs.filter("mode is not null and range_max_mm > 0").select("mode", F.col("range_max_mm").alias("value"), "id"),
        ["mode", "value"], [F.asc("id")], k,
    ).drop("rank")
    near = neighbours(rungs.select("mode", "value").distinct(), asked.filter("value > 0"), ["mode"], "value", k, k)
    options = near.join(
        rungs.select("mode", F.col("value").alias("neighbour"), F.col("id").alias("part_id")), ["mode", "neighbour"]
    )
    ratio = F.col("neighbour") / F.col("value")
    options = options.withColumn("ratio", ratio).withColumn("score", ratio_score(ratio))
    order = [F.desc("score"), F.asc(F.abs(F.ln("ratio"))), F.asc("part_id")]
    best = top_k(options, ["mode", "value"], order, k)
    # At most k rows per question reach the aggregate.
    listed = best.groupBy("mode", "value").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "part_id"))), lambda e: e["part_id"]).alias("ids"),
        F.min_by(F.struct("part_id", "neighbour", "ratio", "score"), F.col("rank")).alias("top"),
    )
    counts = theirs.filter("mode is not null").groupBy("mode").agg(
        F.count("*").alias("n_candidates"),
        F.min_by("id", F.struct(F.col("range_max_mm").isNull(), F.col("id"))).alias("any_part"),
    )
    out = ours.select("id", "mode", "range_max_mm").withColumn("value", F.col("range_max_mm"))
    out = out.join(counts, "mode", "left").join(listed, ["mode", "value"], "left")
    kind = (
        F.when(F.col("n_candidates").isNull(), "GAP")
        .when(F.col("top").isNull(), "no-range")
        .otherwise(quality(F.col("top.ratio")))
    )
    empty = F.array().cast(theirs.select(F.array("id")).schema[0].dataType)
    return out.select(
        "id", "mode", "range_max_mm",
        F.coalesce("top.part_id", "any_part").alias("part_id"),
        F.col("top.neighbour").alias("part_range_max_mm"),
        F.col("top.ratio").alias("ratio"),
        kind.alias("quality"),
        F.coalesce("top.score", F.lit(0.0)).alias("score"),
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.coalesce(F.slice("ids", 2, k - 1), empty).alias("alternatives"),
    )


SIGNATURE = ["category", "range_max_mm", "output", "connection", "light_type"]
SLOT = ["category", "output", "connection", "light_type"]


def _differs(a: Column, b: Column) -> Column:
    """Both stated and different."""
    return F.coalesce(a != b, F.lit(False))


def first_k_of_other_codes(df: DataFrame, keys: list[str], code: str, order: list[Column], k: int) -> DataFrame:
    """Per key the rows that can be among its first ``k`` once any single code is left out.

    ``k`` rows of each code, and of the codes the ``k + 1`` that start earliest:
    a later code is preceded by ``k`` rows of other codes in every case.
    """
    within = top_k(df, [*keys, code], order, k)
    starts = top_k(within.filter("rank = 1").drop("rank"), keys, order, k + 1).select(*keys, code)
    return within.drop("rank").join(starts, [*keys, code], "left_semi")


def _stated(df: DataFrame, columns: list[str]) -> DataFrame:
    """Join keys for columns that may be NULL: each as text that tells NULL from every value."""
    return df.withColumns({f"_{c}": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns})


def rungs_over(rungs: DataFrame, probes: DataFrame, keys: list[str], value: str, code: str, k: int) -> DataFrame:
    """(keys, value, neighbour): for every probe the rungs at or over it that hold its first ``k`` parts, whichever single code is left out.

    ``rungs`` holds parts (keys, value, code).  From a probe upward the first ``k`` rungs
    of its own run (:func:`partlens.operators.ladder.code_runs`) and of the next
    ``2 k + 2`` runs are enough: of two neighbouring runs at most one holds the left-out
    code alone, and ``k`` rungs of one code hold ``k`` of its parts.
    """
    steps = rungs.groupBy(*keys, value).agg(F.min(code).alias("_first_code"), F.max(code).alias("_last_code"))
    runs = cut_lineage(code_runs(steps, keys, value, "_first_code", "_last_code"))
    asked = probes.select(*keys, value).distinct()
    start = ladder_positions(steps.select(*keys, value), asked, keys, value).select(*keys, value, "position")
    entry = asked.join(start, [*keys, value]).join(runs.select(*keys, "position", F.col("run").alias("_run"), F.col("offset").alias("_offset")), [*keys, "position"])
    wanted = entry.withColumn("_ahead", F.explode(F.sequence(F.lit(0), F.lit(2 * k + 2)))).withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    wanted = wanted.select(*keys, value, (F.col("_run") + F.col("_ahead")).alias("run"), (F.when(F.col("_ahead") == 0, F.col("_offset")).otherwise(0) + F.col("_step")).alias("offset"))
    return wanted.join(runs.select(*keys, "run", "offset", F.col(value).alias("neighbour")), [*keys, "run", "offset"]).select(*keys, value, "neighbour")


def interchange(catalog: DataFrame, k: int = SHORTLIST) -> DataFrame:
    """Stand-ins for every part of a catalog: same category, at least the range, a compatible output.

    Parts that ask the same question (:data:`SIGNATURE`) are answered once, and
    candidates of one slot (:data:`SLOT`) differ only in range, so the best ones
    are the next rungs at or over the asked range, as many as leave ``k`` parts when
    the asking part's own type code is left out, in however many ranges it comes.
    A part with neither a range nor an output is not defensible and gets no stand-in.
    """
    slot, other = [f"_{c}" for c in SLOT], [f"c_{c}" for c in SLOT[1:]]
    rows = catalog.select("order_number", "type_code", *SIGNATURE).filter("type_code is not null")
    # A few narrow columns that every branch below reads.
    rows = cut_lineage(rows)
    questions = rows.select(*SIGNATURE).filter("range_max_mm is not null or output is not null").distinct()
    renamed = rows.select(*SLOT).distinct().select("category", *[F.col(c).alias(f"c_{c}") for c in SLOT[1:]])
    paired = questions.join(renamed, "category").filter(
        F.col("output").isNull() | (F.col("c_output") == F.col("output")) | (F.col("c_output") == "PNP/NPN")
    )
    # Questions and parts meet on the part's side of the slot.
    asked = _stated(paired, ["category", *other]).withColumnsRenamed({f"_{c}": f"_{c[2:]}" for c in other}).withColumn("value", F.col("range_max_mm"))
    asked = cut_lineage(asked)
    slotted = _stated(rows, SLOT).select(*slot, F.col("range_max_mm").alias("value"), "order_number", "type_code")
    by_number = [F.asc("order_number")]
    priced, ranged = slotted.filter("value is not null"), asked.filter("value is not null")
    rungs = first_k_of_other_codes(priced, [*slot, "value"], "type_code", by_number, k)
    near = rungs_over(priced, ranged, slot, "value", "type_code", k)
    # Parts of one slot differ in range only, so they are cut for each asked range, before the questions that share it multiply them.
    parts = near.join(rungs.select(*slot, F.col("value").alias("neighbour"), "order_number", "type_code"), [*slot, "neighbour"])
    parts = first_k_of_other_codes(parts, [*slot, "value"], "type_code", [F.asc("neighbour"), *by_number], k)
    offers_ranged = ranged.join(parts, [*slot, "value"])
    any_range = first_k_of_other_codes(slotted, slot, "type_code", by_number, k).withColumnRenamed("value", "neighbour")
    offers_open = asked.filter("value is null").join(any_range, slot)
    gap = F.when(F.col("value").isNotNull(), (F.col("neighbour") - F.col("value")) / F.greatest(F.col("value"), F.lit(1.0)))
    penalty = (
        F.coalesce(gap, F.lit(0.0))
        + F.when(_differs(F.col("connection"), F.col("c_connection")), CONNECTION_PENALTY).otherwise(0.0)
        + F.when(_differs(F.col("light_type"), F.col("c_light_type")), LIGHT_PENALTY).otherwise(0.0)
    )
    columns = [*SIGNATURE, F.col("order_number").alias("candidate"), F.col("type_code").alias("candidate_code"),
               F.col("neighbour").alias("candidate_range"), penalty.alias("penalty")]
    offers = offers_ranged.select(*columns).unionByName(offers_open.select(*columns))
    signature = [f"_{c}" for c in SIGNATURE]
    offers = _stated(offers, SIGNATURE).withColumn("score", 1 / (1 + F.col("penalty")))
    order = [F.desc("score"), F.asc("candidate")]
    short = first_k_of_other_codes(offers, signature, "candidate_code", order, k).select(
        *signature, "candidate", "candidate_code", "candidate_range", "score"
    )
    # The list of a question has at most k rows of k + 1 codes; a part's own come out of it where it lies, so that no task sorts parts times offers.
    better = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(-F.col("score")).alias("_least")
    listed = short.groupBy(*signature).agg(F.array_sort(F.collect_list(F.struct(better, "candidate", "candidate_code", "candidate_range", "score"))).alias("_offers"))
    own = F.slice(F.filter("_offers", lambda o: o["candidate_code"] != F.col("type_code")), 1, k)
    per_part = _stated(rows, SIGNATURE).join(listed, signature).select("order_number", own.alias("_offers"))
    # A number that the catalog has twice is ranked once.
    ranked = per_part.groupBy("order_number").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_offers"))), 1, k).alias("_offers"))
    ranked = ranked.select("order_number", F.posexplode("_offers").alias("_at", "_o"))
    return ranked.select("order_number", (F.col("_at") + 1).alias("rank"), "_o.candidate", "_o.candidate_range", F.round("_o.score", 6).alias("score"))


def derated_solve(catalog: DataFrame, asks: DataFrame, k: int = SHORTLIST) -> DataFrame:
    """Parts that reach a distance on a dark target, three-way: ranked, rejected, or set aside as unverifiable.

    ``asks`` is (ask_id, distance_mm, remission, output, connection, min_ip,
    max_response_ms).  The pairing of few asks with the catalog is a bounded pack.
    """
    return top_k(_derated(catalog, asks).filter("status = 'ranked'"), ["ask_id"], [F.desc("score"), F.asc("order_number")], k).select(
        "ask_id", "rank", "order_number", "required_mm", F.round("score", 6).alias("score"), "n_losses"
    )


def derated_totals(catalog: DataFrame, asks: DataFrame) -> DataFrame:
    return _derated(catalog, asks).groupBy("ask_id", "required_mm").agg(
        F.count("*").alias("catalogue"),
        F.count_if(F.col("status") == "ranked").alias("after_hard"),
        F.count_if(F.col("status") == "unverifiable").alias("unverifiable"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
    )


def _derated(catalog: DataFrame, asks: DataFrame) -> DataFrame:
    factors = F.create_map(*[F.lit(x) for pair in REMISSION_FACTOR.items() for x in pair])
    factor = F.coalesce(F.try_element_at(factors, F.col("remission")), F.lit(1.0))
    # Halves round up, as a distance is never negative.
    prepared = asks.withColumn("required_mm", F.floor(F.col("distance_mm") * factor + 0.5).cast("double"))
    rows = catalog.select("order_number", "range_max_mm", "output", "connection", "ip_rating", "response_ms")
    pairs = pair_with_all(rows, prepared, "a")
    a = lambda c: F.col("a")[c]
    false = F.lit(False)
    rejected = (
        F.coalesce(F.col("range_max_mm") < a("required_mm"), false)
        | F.coalesce((F.col("output") != a("output")) & (F.col("output") != "PNP/NPN"), false)
        | F.coalesce(F.col("ip_rating") < a("min_ip"), false)
    )
    unknown = (
        F.col("range_max_mm").isNull()
        | (a("output").isNotNull() & F.col("output").isNull())
        | (a("min_ip").isNotNull() & F.col("ip_rating").isNull())
    )
    other_plug = _differs(F.col("connection"), a("connection"))
    too_slow = F.coalesce(F.col("response_ms") > a("max_response_ms"), false)
    penalty = (
        F.abs(F.col("range_max_mm") - a("required_mm")) / F.greatest(a("required_mm"), F.lit(1.0))
        + F.when(other_plug, CONNECTION_PENALTY).otherwise(0.0)
        + F.when(too_slow, RESPONSE_PENALTY).otherwise(0.0)
    )
    return pairs.select(
        a("ask_id").alias("ask_id"), a("required_mm").alias("required_mm"), "order_number",
        F.when(rejected, "rejected").when(unknown, "unverifiable").otherwise("ranked").alias("status"),
        (1 / (1 + penalty)).alias("score"),
        (other_plug.cast("int") + too_slow.cast("int")).alias("n_losses"),
    )


def crossref_summary(crossref: DataFrame) -> DataFrame:
    """Totals of a judgement table and counts per confidence, per series (NULL series = no series)."""
    return crossref.groupBy("from_series").agg(
        F.count("*").alias("rows"),
        F.count("to_order_number").alias("with_part"),
        F.count_if(F.col("to_order_number").isNull()).alias("gaps"),
        F.count_if(F.col("adequate")).alias("adequate"),
        *[F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")],
    )
