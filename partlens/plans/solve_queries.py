"""Solver, scoring and audit queries over the derived catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from partlens.operators import audit as A
from partlens.operators import compare as CP
from partlens.operators import links as L
from partlens.operators import score as SC
from partlens.operators import solve as S
from partlens.plans import tables as T
from partlens.plans.registry import query
from partlens.session import cut_lineage


def _enum(field: str, sentinel: str | None = None, upper: bool = False) -> str:
    value = f"upper(c.{field})" if upper else f"c.{field}"
    wanted = f"upper(r.{field})" if upper else f"r.{field}"
    unresolved = f"WHEN c.{field} = '{sentinel}' THEN 'unknown' " if sentinel else ""
    return (
        f"CASE WHEN r.{field} IS NULL THEN NULL WHEN c.{field} IS NULL THEN 'unknown' "
        f"WHEN list_contains(string_split({wanted}, '|'), {value}) THEN 'pass' {unresolved}ELSE 'fail' END"
    )


STATUS_SQL = {
    "output_type": _enum("output_type", "unknown"),
    "io_link": "CASE WHEN r.io_link IS NULL THEN NULL WHEN c.io_link IS NULL THEN 'unknown' WHEN c.io_link = r.io_link THEN 'pass' ELSE 'fail' END",
    "connector": _enum("connector", "unknown"),
    "connector_pins": "CASE WHEN r.connector_pins IS NULL THEN NULL WHEN c.connector_pins IS NULL THEN 'unknown' WHEN c.connector_pins = r.connector_pins THEN 'pass' ELSE 'fail' END",
    "min_ip_rating": "CASE WHEN r.min_ip_rating IS NULL THEN NULL WHEN c.ip_rating IS NULL THEN 'unknown' WHEN c.ip_rating >= r.min_ip_rating THEN 'pass' ELSE 'fail' END",
    "ip69k": "CASE WHEN r.ip69k IS NULL THEN NULL WHEN c.ip69k IS NULL AND c.ip_rating IS NULL THEN 'unknown' WHEN coalesce(c.ip69k, false) = r.ip69k THEN 'pass' ELSE 'fail' END",
    "operating_temp_c": """CASE WHEN r.temp_lo IS NULL AND r.temp_hi IS NULL THEN NULL
      WHEN c.operating_temp_min_c IS NULL AND c.operating_temp_max_c IS NULL THEN 'unknown'
      WHEN c.operating_temp_min_c > r.temp_lo OR c.operating_temp_max_c < r.temp_hi THEN 'fail'
      WHEN (r.temp_lo IS NOT NULL AND c.operating_temp_min_c IS NULL) OR (r.temp_hi IS NOT NULL AND c.operating_temp_max_c IS NULL) THEN 'unknown' ELSE 'pass' END""",
    "sensing_range_mm": """CASE WHEN r.range_lo IS NULL AND r.range_hi IS NULL THEN NULL
      WHEN c.sensing_range_min_mm IS NULL AND c.sensing_range_max_mm IS NULL THEN 'unknown'
      WHEN coalesce(r.range_hi, r.range_lo) > c.sensing_range_max_mm OR coalesce(r.range_lo, r.range_hi) < c.sensing_range_min_mm THEN 'fail'
      WHEN c.sensing_range_max_mm IS NULL THEN 'unknown' ELSE 'pass' END""",
    "response_time_ms": "CASE WHEN r.response_hi IS NULL THEN NULL WHEN c.response_time_ms IS NULL THEN 'unknown' WHEN c.response_time_ms > r.response_hi THEN 'fail' ELSE 'pass' END",
    "switching_frequency_hz": "CASE WHEN r.freq_lo IS NULL THEN NULL WHEN c.switching_frequency_hz IS NULL THEN 'unknown' WHEN c.switching_frequency_hz < r.freq_lo THEN 'fail' ELSE 'pass' END",
    "supply_voltage_v": """CASE WHEN r.volt_lo IS NULL AND r.volt_hi IS NULL THEN NULL
      WHEN c.supply_voltage_min_v IS NULL AND c.supply_voltage_max_v IS NULL THEN 'unknown'
      WHEN coalesce(r.volt_lo, r.volt_hi) < c.supply_voltage_min_v OR coalesce(r.volt_hi, r.volt_lo) > c.supply_voltage_max_v THEN 'fail'
      WHEN c.supply_voltage_min_v IS NULL OR c.supply_voltage_max_v IS NULL THEN 'unknown' ELSE 'pass' END""",
    "principle": f"CASE WHEN ({_enum('principle', 'unknown')}) = 'fail' AND c.principle_source = 'category' THEN 'unknown' ELSE {_enum('principle', 'unknown')} END",
    "housing": _enum("housing", "other"),
    "light": _enum("light", "other"),
    "section": _enum("section", upper=True),
    "row_type": _enum("row_type"),
    "family": _enum("family", upper=True),
}


def _sum(status: str) -> str:
    return " + ".join(f"(CASE WHEN st_{f} = '{status}' THEN 1 ELSE 0 END)" for f in STATUS_SQL)


PAIRS_SQL = (
    "WITH pairs AS (SELECT r.req_id, c.order_number, c.section, c.flags, "
    + ", ".join(f"{sql} AS st_{f}" for f, sql in STATUS_SQL.items())
    + " FROM {catalog} c CROSS JOIN {reqs} r), counted AS (SELECT *, "
    + f"{_sum('pass')} AS passed, {_sum('fail')} AS failed, {_sum('unknown')} AS unknown FROM pairs), "
    + "ranked AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY (failed = 0) DESC, failed, unknown, passed DESC, order_number) AS rnk FROM counted) "
)
SOLVED_COLUMNS = ["req_id", "rank", "order_number", "passed", "failed", "unknown", "viable"]


def _solve(spark, sf, **options):
    return S.solve(T.products(spark, sf), T.specs(spark, sf), T.requirements(spark, sf), **options)


@query(PAIRS_SQL + "SELECT req_id, rnk AS rank, order_number, passed, failed, unknown, failed = 0 AS viable FROM ranked WHERE rnk <= 20")
def solve_topk(spark, sf):
    return _solve(spark, sf, details=False).select(*SOLVED_COLUMNS)


@query(PAIRS_SQL + """, alive AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY unknown, passed DESC, order_number) AS r2
  FROM counted WHERE failed = 0)
SELECT req_id, r2 AS rank, order_number, passed, unknown FROM alive WHERE r2 <= 5""")
def solve_viable_topk(spark, sf):
    return _solve(spark, sf, k=5, viable_only=True, details=False).select("req_id", "rank", "order_number", "passed", "unknown")


@query(PAIRS_SQL + """SELECT req_id, count(*) AS evaluated, sum(CASE WHEN failed = 0 THEN 1 ELSE 0 END) AS viable,
  sum(CASE WHEN failed > 0 THEN 1 ELSE 0 END) AS disqualified,
  sum(CASE WHEN failed = 0 AND unknown = 0 THEN 1 ELSE 0 END) AS fully_verified FROM counted GROUP BY req_id""")
def solve_totals(spark, sf):
    return S.solve_totals(T.products(spark, sf), T.specs(spark, sf), T.requirements(spark, sf))


@query(PAIRS_SQL + "SELECT req_id, section, count(*) AS kept FROM counted WHERE failed = 0 GROUP BY req_id, section")
def prefilter(spark, sf):
    kept = S.prefilter(T.products(spark, sf), T.specs(spark, sf), T.requirements(spark, sf))
    sections = T.products(spark, sf).select("order_number", "section")
    return kept.join(sections, "order_number").groupBy("req_id", "section").agg(F.count("*").alias("kept"))


def _status_long() -> str:
    return " UNION ALL ".join(
        f"SELECT req_id, '{f}' AS field, st_{f} AS status, count(*) AS products FROM pairs WHERE st_{f} IS NOT NULL GROUP BY req_id, st_{f}"
        for f in STATUS_SQL
    )


@query(PAIRS_SQL + _status_long())
def verdict_statuses(spark, sf):
    """Every verdict of every (requirement, product) pair, counted by field and status."""
    pairs = S._pairs(T.products(spark, sf), T.specs(spark, sf), T.requirements(spark, sf), viable_only=False)
    verdicts = S.constraint_verdicts(F.col("req"))
    cells = F.array(*[F.struct(F.lit(v.field).alias("field"), v.status.alias("status")) for v in verdicts])
    rows = pairs.select(F.col("req.req_id").alias("req_id"), F.inline(cells)).filter("status is not null")
    return rows.groupBy("req_id", "field", "status").agg(F.count("*").alias("products"))


CANDIDATES_SQL = """, listed AS (SELECT DISTINCT concat('nation-', cast(s_nationkey AS string)) AS req_id,
  cast(l_partkey + 1000000 AS string) AS order_number
  FROM {supplier} JOIN {lineitem} ON l_suppkey = s_suppkey),
again AS (SELECT counted.*, row_number() OVER (PARTITION BY counted.req_id ORDER BY (failed = 0) DESC, failed, unknown, passed DESC, counted.order_number) AS r2
  FROM counted JOIN listed ON counted.req_id = listed.req_id AND counted.order_number = listed.order_number) """


@query(PAIRS_SQL + CANDIDATES_SQL + "SELECT req_id, r2 AS rank, order_number, passed, failed, unknown, failed = 0 AS viable FROM again WHERE r2 <= 10")
def solve_candidates(spark, sf):
    """Each nation's requirement solved over the parts its suppliers ship."""
    lots = T.read(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    listed = lots.join(T.read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("req_id"),
        (F.col("l_partkey") + 1000000).cast("string").alias("order_number"),
    )
    return S.solve_candidates(T.products(spark, sf), T.specs(spark, sf), T.requirements(spark, sf), listed, 10).select(*SOLVED_COLUMNS)


@query("""WITH r AS (SELECT req_id, output_type FROM {reqs} WHERE output_type IS NOT NULL)
SELECT req_id, CASE output_type WHEN 'PNP|PNP/NPN' THEN 'PNP|PNP/NPN' WHEN 'NPN' THEN 'NPN|PNP/NPN' ELSE output_type END AS outputs FROM r""")
def expand_enum(spark, sf):
    rules = {"output_type": {"PNP": ["PNP/NPN"], "NPN": ["PNP/NPN"]}}
    rows = S.expand_enum(T.requirements(spark, sf).filter("output_type is not null"), rules)
    return rows.select("req_id", F.array_join("output_type", "|").alias("outputs"))


def _joined(status: str, what: str = "'{f}'") -> str:
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN st_{f} = '{status}' THEN {what.format(f=f)} END" for f in STATUS_SQL) + ")"


@query(PAIRS_SQL + f"""SELECT req_id, rnk AS rank, order_number, {_joined('unknown')} AS unverified,
  CASE WHEN failed > 0 THEN concat('Disqualified: ', failed, ' stated value(s) violate the requirement.')
    WHEN unknown = 0 THEN concat('All ', passed, ' constraint(s) verified.')
    ELSE concat(passed, ' verified, ', unknown, ' unverified: ', {_joined('unknown')}, '.') END AS evidence
FROM ranked WHERE rnk <= 3""")
def evidence_summary(spark, sf):
    rows = S.evidence_summary(_solve(spark, sf, k=3))
    return rows.select("req_id", "rank", "order_number", F.array_join("unverified", ", ").alias("unverified"), "evidence")


@query(PAIRS_SQL + f""", alive AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY unknown, passed DESC, order_number) AS place, count(*) OVER (PARTITION BY req_id) AS n FROM counted WHERE failed = 0)
SELECT req_id, place AS rank, order_number, {_joined('unknown')} AS unverified, n AS viable FROM alive WHERE place <= 6""")
def solve_constraints(spark, sf):
    """The call as a user makes it: the viable products with what could not be verified, and how many there are in all."""
    from partlens.plans.tools import solve_constraints as call

    ranked, totals = call({"product": T.products(spark, sf), "spec": T.specs(spark, sf)}, T.requirements(spark, sf), top=6)
    joined = ranked.select("req_id", "rank", "order_number", F.array_join("unverified", ", ").alias("unverified")).join(totals.select("req_id", "viable"), "req_id")
    return joined


LOW_FLAGS = {
    "output_type": "flags LIKE '%switching_output%'", "io_link": "flags LIKE '%switching_output%'",
    "connector": "flags LIKE '%connection%'", "connector_pins": "flags LIKE '%connection%'",
    "sensing_range_mm": "flags LIKE '%sensing_range_max_mm%'",
}


def _challenge_sql() -> str:
    parts = []
    for f in STATUS_SQL:
        low = LOW_FLAGS.get(f, "false")
        parts.append(
            f"SELECT req_id, order_number, '{f}' AS field, CASE WHEN st_{f} = 'fail' THEN 'fatal' WHEN st_{f} = 'unknown' THEN 'major' "
            f"WHEN {low} THEN 'minor' END AS severity FROM top WHERE st_{f} IS NOT NULL"
        )
    return " UNION ALL ".join(parts)


TOP4_SQL = PAIRS_SQL + ", top AS (SELECT * FROM ranked WHERE rnk <= 4), raised AS (SELECT *, CASE WHEN severity = 'fatal' THEN 'upheld' ELSE 'unverifiable' END AS verdict FROM (" + _challenge_sql() + ") x WHERE severity IS NOT NULL) "


def _top4(spark, sf):
    return _solve(spark, sf, k=4)


@query(TOP4_SQL + "SELECT req_id, order_number, field, severity, verdict FROM raised")
def challenges(spark, sf):
    return A.challenges(_top4(spark, sf)).drop("evidence")


CONFIDENCE_SQL = TOP4_SQL + """, judged AS (SELECT req_id, rnk, order_number, failed, unknown,
  CASE WHEN passed + failed + unknown = 0 OR failed > 0 OR unknown > 0 THEN 'low'
    WHEN EXISTS (SELECT 1 FROM raised x WHERE x.req_id = top.req_id AND x.order_number = top.order_number AND severity IN ('fatal', 'major')) THEN 'medium'
    ELSE 'high' END AS confidence,
  NOT EXISTS (SELECT 1 FROM raised x WHERE x.req_id = top.req_id AND x.order_number = top.order_number AND severity = 'fatal') AS survives FROM top) """


def _judged(spark, sf):
    return A.judge(_top4(spark, sf))


@query(CONFIDENCE_SQL + "SELECT req_id, rnk AS rank, order_number, confidence, survives FROM judged")
def confidence(spark, sf):
    solved = cut_lineage(_top4(spark, sf))
    raised = A.challenges(solved)
    return A.survival(raised, A.confidence(solved, raised)).select("req_id", "rank", "order_number", "confidence", "survives")


@query(CONFIDENCE_SQL + """, firsts AS (SELECT req_id, min(CASE WHEN survives THEN rnk END) AS sr, count(*) AS n FROM judged GROUP BY req_id)
SELECT f.req_id, s.order_number, coalesce(sr, n) AS n_challenged, p.order_number AS promoted_from,
  CASE WHEN sr IS NULL THEN c.order_number END AS closest
FROM firsts f LEFT JOIN judged s ON s.req_id = f.req_id AND s.rnk = sr
LEFT JOIN judged p ON p.req_id = f.req_id AND p.rnk = sr - 1
LEFT JOIN judged c ON c.req_id = f.req_id AND c.rnk = 1""")
def first_survivor(spark, sf):
    return A.first_survivor(_judged(spark, sf))


@query(TOP4_SQL + f"""SELECT req_id, order_number, {_joined('fail')} AS violated, {_joined('unknown')} AS unconfirmed FROM top""")
def losses(spark, sf):
    """The fields behind the losses of the best four; the wording is checked in the tests."""
    rows = _top4(spark, sf).withColumn("losses", A.losses())
    names = lambda status: F.array_join(F.transform(F.filter("verdicts", lambda v: v["status"] == status), lambda v: v["field"]), ", ")
    counted = F.size("losses") == F.col("failed") + F.col("unknown")
    return rows.filter(counted).select("req_id", "order_number", names("fail").alias("violated"), names("unknown").alias("unconfirmed"))


COMPARISON_DELTA = {
    "sensing_range_mm": ("c.sensing_range_max_mm", "CASE WHEN r.range_lo IS NULL THEN r.range_hi WHEN r.range_hi IS NULL THEN r.range_lo ELSE greatest(r.range_lo, r.range_hi) END", ">"),
    "response_time_ms": ("c.response_time_ms", "r.response_hi", "<"),
    "switching_frequency_hz": ("c.switching_frequency_hz", "r.freq_lo", ">"),
    "min_ip_rating": ("c.ip_rating", "r.min_ip_rating", ">"),
}
COMPARISON_STATED = {
    "principle": "c.principle IS NOT NULL", "sensing_range_mm": "c.sensing_range_min_mm IS NOT NULL OR c.sensing_range_max_mm IS NOT NULL",
    "response_time_ms": "c.response_time_ms IS NOT NULL", "switching_frequency_hz": "c.switching_frequency_hz IS NOT NULL",
    "output_type": "c.output_type IS NOT NULL", "io_link": "coalesce(c.io_link, false)", "connector": "c.connector IS NOT NULL",
    "connector_pins": "c.connector_pins IS NOT NULL", "min_ip_rating": "c.ip_rating IS NOT NULL", "ip69k": "coalesce(c.ip69k, false)",
    "operating_temp_c": "c.operating_temp_min_c IS NOT NULL OR c.operating_temp_max_c IS NOT NULL",
    "supply_voltage_v": "c.supply_voltage_min_v IS NOT NULL OR c.supply_voltage_max_v IS NOT NULL",
    "housing": "c.housing IS NOT NULL", "light": "c.light IS NOT NULL",
}


def _comparison_sql() -> str:
    parts = []
    for i, (f, stated) in enumerate(COMPARISON_STATED.items()):
        value, asked, sign = COMPARISON_DELTA.get(f, ("NULL::double", "NULL::double", ">"))
        gap = f"CASE WHEN st_{f} <> 'unknown' THEN ({value})::double - ({asked})::double END"
        parts.append(
            f"SELECT t.req_id, t.order_number, {i} AS position, '{f}' AS field, "
            f"CASE WHEN st_{f} IS NULL OR st_{f} = 'unknown' OR NOT ({stated}) THEN 'unknown' WHEN st_{f} = 'fail' THEN 'worse' "
            f"WHEN coalesce(({gap}) {sign} 0, false) THEN 'better' ELSE 'match' END AS status, round({gap}, 6) AS gap, ({stated}) AS cited "
            "FROM top t JOIN {catalog} c ON c.order_number = t.order_number JOIN {reqs} r ON r.req_id = t.req_id"
        )
    return " UNION ALL ".join(parts)


@query(TOP4_SQL + _comparison_sql())
def comparison(spark, sf):
    rows = CP.comparison(_top4(spark, sf), T.specs(spark, sf), T.requirements(spark, sf))
    return rows.select("req_id", "order_number", "position", "field", "status", F.round("gap", 6).alias("gap"), "cited")


# --- scoring ---------------------------------------------------------------

OUTCOME_SQL = {
    "solution_class": (3.0, True, "r.class_list IS NOT NULL", "p.solution_class IS NULL", "NOT list_contains(string_split(r.class_list, '|'), p.solution_class)", "1.0"),
    "sensing_mode": (3.0, True, "r.preferred_list IS NOT NULL OR coalesce(r.discouraged_list = p.sensing_mode, false)", "p.sensing_mode IS NULL",
                     "coalesce(r.discouraged_list = p.sensing_mode, false)",
                     "CASE WHEN list_position(string_split(r.preferred_list, '|'), p.sensing_mode) > 0 THEN greatest(0.5::double, 1 - (list_position(string_split(r.preferred_list, '|'), p.sensing_mode) - 1) * 0.15::double) ELSE 0.25::double END"),
    "sensing_range": (2.5, True, "r.target_distance_mm IS NOT NULL", "p.sensing_range_max_mm IS NULL",
                      "coalesce(r.target_distance_mm < p.sensing_range_min_mm, false) OR coalesce(p.sensing_range_max_mm < r.target_distance_mm, false)",
                      "CASE WHEN p.sensing_range_max_mm / r.target_distance_mm < 1.3::double THEN 0.7::double + (p.sensing_range_max_mm / r.target_distance_mm - 1) WHEN p.sensing_range_max_mm / r.target_distance_mm <= 2 THEN 1.0::double ELSE greatest(0.35::double, 1 - (p.sensing_range_max_mm / r.target_distance_mm - 2) * 0.075::double) END"),
    "protective_field_height": (2.5, True, "r.field_height_mm IS NOT NULL", "p.protective_field_height_mm IS NULL", "p.protective_field_height_mm < r.field_height_mm",
                                "greatest(0.5::double, 1 - (p.protective_field_height_mm / r.field_height_mm - 1) * 0.4::double)"),
    "safety_resolution": (2.5, True, "r.safety_resolution_mm IS NOT NULL", "p.safety_resolution_mm IS NULL", "p.safety_resolution_mm > r.safety_resolution_mm", "1.0"),
    "ingress_protection": (2.0, True, "r.min_ip_ingress IS NOT NULL OR r.min_ip_water IS NOT NULL OR r.washdown", "p.ip_ingress IS NULL AND p.ip_water IS NULL",
                           "NOT (p.ip_ingress IS NULL AND p.ip_water IS NULL) AND ((r.washdown AND NOT coalesce(p.washdown_capable, false)) OR coalesce(coalesce(p.ip_ingress, 0) < r.min_ip_ingress, false) OR coalesce(coalesce(p.ip_water, 0) < r.min_ip_water, false))", "1.0"),
    "ambient_temperature": (1.5, True, "r.min_temp_c IS NOT NULL OR r.max_temp_c IS NOT NULL", "p.operating_temp_min_c IS NULL AND p.operating_temp_max_c IS NULL",
                            "NOT (p.operating_temp_min_c IS NULL AND p.operating_temp_max_c IS NULL) AND (coalesce(coalesce(p.operating_temp_min_c, 1e308) > r.min_temp_c, false) OR coalesce(coalesce(p.operating_temp_max_c, -1e308) < r.max_temp_c, false))", "1.0"),
    "switching_output": (1.0, True, "r.switching_output IS NOT NULL", "p.switching_output IS NULL", "NOT contains(upper(p.switching_output), r.switching_output)", "1.0"),
    "response_time": (1.0, True, "r.max_response_ms IS NOT NULL", "p.response_time_ms IS NULL", "p.response_time_ms > r.max_response_ms", "1.0"),
    "communication_protocol": (1.5, False, "r.protocol_list IS NOT NULL", "p.protocol_list IS NULL", "false",
                               "len(list_filter(string_split(p.protocol_list, '|'), lambda x: list_contains(string_split(r.protocol_list, '|'), lower(x))))::double / len(string_split(r.protocol_list, '|'))"),
    "application_keywords": (1.0, False, "r.keyword_list IS NOT NULL", "false", "false",
                             "len(list_filter(string_split(r.keyword_list, '|'), lambda k: contains(p.search_blob, k)))::double / len(string_split(r.keyword_list, '|'))"),
}
RELAX_ORDER = ["switching_output", "response_time", "ambient_temperature", "ingress_protection", "sensing_range",
               "protective_field_height", "safety_resolution", "solution_class", "sensing_mode"]


def _scored_sql() -> str:
    status, score = [], []
    for n, (_, _, asked, silent, bad, value) in OUTCOME_SQL.items():
        status.append(
            f"CASE WHEN NOT coalesce({asked}, false) THEN 'not_applicable' WHEN coalesce({bad}, false) THEN 'violated' WHEN {silent} THEN 'unverified' ELSE 'satisfied' END AS s_{n}"
        )
        score.append(f"{value} AS v_{n}")
    known = lambda n: f"s_{n} IN ('satisfied', 'violated')"
    verified = " + ".join(f"(CASE WHEN {known(n)} THEN {w}::double ELSE 0 END)" for n, (w, *_) in OUTCOME_SQL.items())
    applicable = " + ".join(f"(CASE WHEN s_{n} <> 'not_applicable' THEN {w}::double ELSE 0 END)" for n, (w, *_) in OUTCOME_SQL.items())
    earned = " + ".join(f"(CASE WHEN s_{n} = 'satisfied' THEN v_{n} * {w}::double ELSE 0 END)" for n, (w, *_) in OUTCOME_SQL.items())
    level = "greatest(0, " + ", ".join(f"CASE WHEN s_{n} = 'violated' THEN {i + 1} ELSE 0 END" for i, n in enumerate(RELAX_ORDER)) + ")"
    return (
        "WITH raw AS (SELECT r.req_id, p.order_number, p.ord, " + ", ".join(status + score)
        + " FROM {enriched} p CROSS JOIN {scoring_reqs} r WHERE p.row_type = 'product'), sums AS (SELECT *, "
        + f"{verified} AS verified, {applicable} AS applicable, {earned} AS earned, {level} AS level FROM raw), "
        + "fits AS (SELECT *, CASE WHEN verified = 0 THEN 0 ELSE earned / verified END AS fit, CASE WHEN applicable = 0 THEN 1 ELSE verified / applicable END AS evidence FROM sums), "
        + "scored AS (SELECT *, fit * (0.55::double + 0.45::double * evidence) AS rank_score, min(level) OVER (PARTITION BY req_id) AS req_level FROM fits), "
        + "ranked AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY rank_score DESC, ord) AS rnk FROM scored WHERE level <= req_level) "
    )


SCORED_SQL = _scored_sql()
RELAXED_SQL = "CASE req_level " + " ".join(f"WHEN {i + 1} THEN '{', '.join(RELAX_ORDER[: i + 1])}'" for i in range(len(RELAX_ORDER))) + " END"


@query(SCORED_SQL + f"""SELECT req_id, rnk AS rank, order_number, round(fit, 6) AS fit, round(evidence, 6) AS evidence,
  round(rank_score, 6) AS rank_score, {RELAXED_SQL} AS relaxed FROM ranked WHERE rnk <= 12""")
def score_catalog(spark, sf):
    best = SC.score_catalog(T.enriched(spark, sf), T.scoring_requirements(spark, sf))
    r6 = lambda c: F.round(c, 6).alias(c)
    return best.select("req_id", "rank", "order_number", r6("fit"), r6("evidence"), r6("rank_score"), "relaxed")


@query(SCORED_SQL + """SELECT req_id, req_level, sum(CASE WHEN level <= req_level THEN 1 ELSE 0 END) AS survivors,
  sum(CASE WHEN level > req_level THEN 1 ELSE 0 END) AS excluded FROM scored GROUP BY req_id, req_level""")
def relaxation(spark, sf):
    pool = T.enriched(spark, sf).filter("row_type = 'product'")
    scored = SC.with_relaxation(SC.score_pairs(SC._all_pairs(pool, T.scoring_requirements(spark, sf))))
    return scored.groupBy("req_id", "req_level").agg(
        F.count_if("survives").alias("survivors"), F.count_if(~F.col("survives")).alias("excluded")
    )


def _excluded_by_sql() -> str:
    cases = " ".join(
        f"WHEN s_{n} = 'violated' AND {RELAX_ORDER.index(n) + 1} > req_level THEN '{n}'" for n, (_, hard, *_) in OUTCOME_SQL.items() if hard
    )
    return SCORED_SQL + f"SELECT req_id, CASE {cases} END AS excluded_by, count(*) AS products FROM scored WHERE level > req_level GROUP BY 1, 2"


@query(_excluded_by_sql())
def excluded_by(spark, sf):
    return SC.excluded_counts(T.enriched(spark, sf), T.scoring_requirements(spark, sf))


@query("""WITH o AS (SELECT l_suppkey,
  CASE WHEN l_returnflag = 'A' THEN 'satisfied' WHEN l_returnflag = 'R' THEN 'violated' WHEN l_linestatus = 'O' THEN 'unverified' ELSE 'not_applicable' END AS status,
  CASE WHEN l_returnflag = 'A' THEN l_discount * 10 ELSE 0 END AS score, l_quantity AS weight FROM {lineitem}),
s AS (SELECT l_suppkey, sum(CASE WHEN status IN ('satisfied', 'violated') THEN weight ELSE 0 END) AS v,
  sum(CASE WHEN status <> 'not_applicable' THEN weight ELSE 0 END) AS a,
  sum(CASE WHEN status IN ('satisfied', 'violated') THEN score * weight ELSE 0 END) AS e FROM o GROUP BY l_suppkey),
f AS (SELECT l_suppkey, CASE WHEN v = 0 THEN 0 ELSE e / v END AS fit, CASE WHEN a = 0 THEN 1 ELSE v / a END AS evidence FROM s)
SELECT l_suppkey, round(fit, 6) AS fit, round(evidence, 6) AS evidence, round(fit * (0.55::double + 0.45::double * evidence), 6) AS rank_score FROM f""")
def fit_evidence(spark, sf):
    """Lines as outcomes of their supplier: returned is a violation, accepted a match."""
    status = (
        F.when(F.col("l_returnflag") == "A", "satisfied").when(F.col("l_returnflag") == "R", "violated")
        .when(F.col("l_linestatus") == "O", "unverified").otherwise("not_applicable")
    )
    rows = T.read(spark, sf, "lineitem").select(
        "l_suppkey", status.alias("status"),
        F.when(F.col("l_returnflag") == "A", F.col("l_discount") * 10).otherwise(0.0).alias("score"), F.col("l_quantity").alias("weight"),
    )
    out = SC.fit_evidence_long(rows, ["l_suppkey"])
    return out.select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("fit", "evidence", "rank_score")])


ACCESSORY_SQL = """acc AS (SELECT order_number, family, source_page, ord FROM {catalog} WHERE row_type = 'accessory'),
links AS (SELECT p.order_number, a.order_number AS accessory, 0 AS scope, a.ord FROM {catalog} p JOIN acc a ON a.family = p.family WHERE p.row_type = 'product'
  UNION ALL SELECT p.order_number, a.order_number, 1, a.ord FROM {catalog} p JOIN acc a ON a.source_page = p.source_page WHERE p.row_type = 'product'),
firsts AS (SELECT order_number, accessory, min(scope) AS scope, min(ord) AS ord FROM links GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY order_number ORDER BY scope, ord) AS rn FROM firsts)"""


@query("WITH " + ACCESSORY_SQL + """ SELECT p.order_number, coalesce(string_agg(accessory, ',' ORDER BY rn), '') AS accessories FROM {catalog} p
LEFT JOIN placed ON placed.order_number = p.order_number AND rn <= 6 WHERE p.row_type = 'product' GROUP BY p.order_number""")
def top_accessories(spark, sf):
    rows = T.products(spark, sf)
    out = L.top_accessories(rows.filter("row_type = 'product'"), rows.filter("row_type = 'accessory'"))
    return out.select("order_number", F.array_join("accessories", ",").alias("accessories"))


@query("WITH " + ACCESSORY_SQL + """ SELECT p.order_number, count(accessory) AS n_accessories FROM {catalog} p
LEFT JOIN firsts ON firsts.order_number = p.order_number WHERE p.row_type = 'product' GROUP BY p.order_number""")
def accessory_links(spark, sf):
    rows = T.products(spark, sf)
    return L.accessory_counts(rows.filter("row_type = 'product'"), rows.filter("row_type = 'accessory'"))


def _num(value: str) -> str:
    return f"regexp_replace(round({value}, 6)::decimal(30, 6)::varchar, '\\.?0+$', '')"


def _told(*parts: str) -> str:
    return "concat(" + ", ".join(f"coalesce(({p})::varchar, 'not stated')" for p in parts) + ")"


DETAIL_SQL = {
    "solution_class": _told("'solution class '", "p.solution_class"),
    "sensing_mode": _told("'sensing mode '", "p.sensing_mode"),
    "sensing_range": _told("'reaches '", _num("p.sensing_range_max_mm"), "' mm for a target at '", _num("r.target_distance_mm"), "' mm'"),
    "protective_field_height": _told("'protective field of '", _num("p.protective_field_height_mm"), "' mm for '", _num("r.field_height_mm"), "' mm'"),
    "safety_resolution": _told("'resolution of '", _num("p.safety_resolution_mm"), "' mm for '", _num("r.safety_resolution_mm"), "' mm'"),
    "ingress_protection": _told("'rated '", "p.enclosure_rating"),
    "ambient_temperature": _told("'rated '", _num("p.operating_temp_min_c"), "' to '", _num("p.operating_temp_max_c"), "' °C'"),
    "switching_output": _told("'output '", "p.switching_output"),
    "response_time": _told("'responds in '", _num("p.response_time_ms"), "' ms'"),
    "communication_protocol": _told("'protocols '", "array_to_string(list_filter(string_split(p.protocol_list, '|'), lambda x: list_contains(string_split(r.protocol_list, '|'), lower(x))), ', ')"),
    "application_keywords": _told("'text mentions '", "array_to_string(list_filter(string_split(r.keyword_list, '|'), lambda k: contains(p.search_blob, k)), ', ')"),
}
FACTS_SQL = f"""list_filter(['detection principle: ' || p.sensing_mode, 'sensing range up to ' || {_num('p.sensing_range_max_mm')} || ' mm', 'enclosure rating ' || p.enclosure_rating,
  'output ' || p.switching_output, 'listed on page ' || p.source_page], lambda x: x IS NOT NULL)"""
WHY_SQL = f"""gains AS (SELECT k.req_id, {FACTS_SQL} AS facts, list_sort(list_filter([{", ".join(f"{{'gain': -{w}::double * k.v_{n}::double, 'i': {i}, 's': k.s_{n}, 'd': {DETAIL_SQL[n]}}}" for i, (n, (w, *_)) in enumerate(OUTCOME_SQL.items()))}],
  lambda o: o.s = 'satisfied' AND o.gain < 0)) AS best FROM ranked k JOIN {{enriched}} p ON p.order_number = k.order_number JOIN {{scoring_reqs}} r ON r.req_id = k.req_id WHERE rnk = 1),
why AS (SELECT req_id, array_to_string(CASE WHEN len(best) > 0 THEN list_transform(best[:4], lambda o: o.d) ELSE facts[:4] END, '; ') AS why FROM gains)"""


@query(SCORED_SQL + ", " + ACCESSORY_SQL + ", " + WHY_SQL + """, picks AS (SELECT req_id, max(CASE WHEN rnk = 1 THEN order_number END) AS recommended,
  string_agg(order_number, ',' ORDER BY rnk) FILTER (WHERE rnk BETWEEN 2 AND 4) AS alternatives, max(req_level) AS req_level, count(*) AS survivors,
  bool_or(ord IN (SELECT ord FROM {enriched} WHERE is_safety_product) AND rnk <= 4) AS safe FROM ranked GROUP BY req_id),
rest AS (SELECT req_id, count(*) FILTER (WHERE level > req_level) AS excluded FROM scored GROUP BY req_id),
extras AS (SELECT order_number, string_agg(accessory, ',' ORDER BY rn) AS complete_with FROM placed WHERE rn <= 6 GROUP BY order_number)
SELECT r.req_id, recommended, coalesce(alternatives, '') AS alternatives, why, CASE WHEN recommended IS NOT NULL THEN coalesce(complete_with, '') END AS complete_with,
  coalesce(survivors, 0) AS survivors, coalesce(excluded, 0) AS excluded,
  (CASE WHEN req_level > 0 THEN 1 ELSE 0 END) + (CASE WHEN class_list IS NULL AND preferred_list IS NULL AND keyword_list IS NOT NULL THEN 1 ELSE 0 END)
  + (CASE WHEN recommended IS NULL THEN 1 ELSE 0 END) + (CASE WHEN safety_related OR coalesce(safe, false) THEN 1 ELSE 0 END) AS n_notices,
  budget IS NOT NULL AS has_not_applied
FROM {scoring_reqs} r LEFT JOIN picks ON picks.req_id = r.req_id LEFT JOIN rest ON rest.req_id = r.req_id LEFT JOIN why ON why.req_id = r.req_id LEFT JOIN extras ON extras.order_number = recommended""")
def consult(spark, sf):
    out = SC.consult(T.enriched(spark, sf), T.scoring_requirements(spark, sf))
    return out.select(
        "req_id", F.col("recommendation.order_number").alias("recommended"),
        F.coalesce(F.array_join(F.transform("alternatives", lambda a: a["order_number"]), ","), F.lit("")).alias("alternatives"),
        F.array_join("recommendation.why", "; ").alias("why"), F.array_join("complete_with", ",").alias("complete_with"), "survivors", "excluded",
        F.size("notices").alias("n_notices"), F.col("not_applied").isNotNull().alias("has_not_applied"),
    )


# --- requirement checks ----------------------------------------------------

STATED_SQL = {
    "principle": "principle IS NOT NULL", "sensing_range_mm": "range_lo IS NOT NULL OR range_hi IS NOT NULL", "response_time_ms": "response_hi IS NOT NULL",
    "switching_frequency_hz": "freq_lo IS NOT NULL", "supply_voltage_v": "volt_lo IS NOT NULL OR volt_hi IS NOT NULL",
    "operating_temp_c": "temp_lo IS NOT NULL OR temp_hi IS NOT NULL", "output_type": "output_type IS NOT NULL", "connector": "connector IS NOT NULL",
    "connector_pins": "connector_pins IS NOT NULL", "min_ip_rating": "min_ip_rating IS NOT NULL", "ip69k": "ip69k IS NOT NULL", "io_link": "io_link IS NOT NULL",
    "housing": "housing IS NOT NULL", "light": "light IS NOT NULL", "section": "section IS NOT NULL", "family": "family IS NOT NULL",
}
ANCHOR_SQL = "(principle IS NOT NULL OR section IS NOT NULL OR family IS NOT NULL)"
DISCRIMINATORS = [*CP.BOUNDED, *CP.ELECTRICAL]
_list = lambda names, negate=False: "concat_ws(',', " + ", ".join(f"CASE WHEN {'NOT ' if negate else ''}({STATED_SQL[n]}) THEN '{n}' END" for n in names) + ")"


@query("SELECT req_id, " + _list(CP.STATED_ORDER) + " AS stated, " + ANCHOR_SQL + " AS anchored, " + _list(DISCRIMINATORS) + " AS discriminators, "
       + _list(CP.TRACKED_FIELDS, True) + " AS missing, " + ANCHOR_SQL + " AND " + _list(DISCRIMINATORS) + " <> '' AS sufficient FROM {reqs}")
def sufficiency(spark, sf):
    rows = CP.sufficiency(T.requirements(spark, sf))
    return rows.select("req_id", *[F.array_join(c, ",").alias(c) for c in ("stated", "discriminators", "missing")], "anchored", "sufficient")


_useful = [q for q in CP.QUESTION_RANK if q in DISCRIMINATORS]


# The open questions of the requirements in ``told``, which says whether they are anchored and what was found.
QUESTIONS_SQL = "SELECT req_id, 'principle' AS field, 2 AS place FROM told WHERE NOT anchored" + "".join(
    f" UNION ALL SELECT req_id, '{f}', {CP.QUESTION_RANK.index(f)} FROM told WHERE found = '' AND NOT ({STATED_SQL[f]})" for f in _useful
)


@query("WITH told AS (SELECT *, " + ANCHOR_SQL + " AS anchored, " + _list(DISCRIMINATORS) + " AS found FROM {reqs}), q AS (" + QUESTIONS_SQL
       + "), o AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY place) AS rank FROM q) SELECT req_id, rank, field FROM o WHERE rank <= 4")
def question_queue(spark, sf):
    return CP.question_queue(CP.sufficiency(T.requirements(spark, sf)))


@query("""SELECT req_id, 'output_type' AS field, 'value not allowed: relay' AS problem FROM {reqs} WHERE output_type = 'push-pull|relay'
UNION ALL SELECT req_id, 'sensing_range_mm', 'interval with min above max' FROM {reqs} WHERE range_lo > range_hi
UNION ALL SELECT req_id, NULL, 'no constraint stated' FROM {reqs} WHERE row_type IS NULL AND """ + _list(CP.STATED_ORDER) + " = ''")
def validate_requirements(spark, sf):
    return CP.validate_requirements(T.requirements(spark, sf), {"output_type": ["PNP", "NPN", "PNP/NPN", "push-pull"]})


TERMS = {"principle": {"diffuse": "diffuse sensor", "through-beam": "through-beam pair"}, "housing": {"metal": "metal housing", "plastic": "plastic housing"}}


@query("""SELECT req_id, concat_ws(' ', CASE WHEN principle IS NOT NULL THEN 'diffuse sensor through-beam pair' END,
  CASE WHEN housing IS NOT NULL THEN 'metal housing plastic housing' END, replace(light, '|', ' '), replace(output_type, '|', ' '),
  replace(connector, '|', ' '), CASE WHEN io_link THEN 'IO-Link' END, CASE WHEN min_ip_rating IS NOT NULL THEN 'IP 65' END,
  CASE WHEN ip69k THEN 'IP 69K' END, CASE WHEN coalesce(range_hi, range_lo) IS NOT NULL THEN concat(coalesce(range_hi, range_lo)::bigint, ' mm') END,
  CASE WHEN response_hi IS NOT NULL THEN '3 ms' END) AS text FROM {reqs}""")
def retrieval_query(spark, sf):
    return A.retrieval_query(T.requirements(spark, sf), TERMS)


@query("""WITH s AS (SELECT l_suppkey, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.1 AND l_tax >= 0.08 THEN 1 ELSE 0 END) AS w,
  sum(CASE WHEN l_linestatus = 'O' AND l_discount >= 0.1 AND l_tax >= 0.08 THEN 1 ELSE 0 END) AS u FROM {lineitem} GROUP BY l_suppkey),
c AS (SELECT *, CASE WHEN n > 620 THEN 'high' WHEN n > 580 THEN 'medium' ELSE 'low' END AS claimed, CASE WHEN w > 0 THEN 0 WHEN u > 0 THEN 1 ELSE 2 END AS cap FROM s)
SELECT l_suppkey, claimed, CASE WHEN claimed = 'low' OR cap = 0 THEN 'low' WHEN claimed = 'medium' OR cap = 1 THEN 'medium' ELSE 'high' END AS capped FROM c""")
def cap_confidence(spark, sf):
    """A supplier's claimed level, capped by the warnings and open checks among its lines."""
    rare = (F.col("l_discount") >= 0.1) & (F.col("l_tax") >= 0.08)
    rows = T.read(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.count_if((F.col("l_returnflag") == "R") & rare).alias("w"), F.count_if((F.col("l_linestatus") == "O") & rare).alias("u")
    )
    claimed = F.when(F.col("n") > 620, "high").when(F.col("n") > 580, "medium").otherwise("low")
    rows = rows.withColumn("claimed", claimed)
    return rows.select("l_suppkey", "claimed", A.cap_confidence(F.col("claimed"), F.col("n"), F.col("w"), F.col("u"), F.lit(0)).alias("capped"))
