"""Part resolution, equivalence and lookup queries over the derived catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from partlens.functions.text import part_key
from partlens.operators import audit as A
from partlens.operators import compare as CP
from partlens.operators import equivalence as E
from partlens.operators import match as M
from partlens.plans import tables as T
from partlens.plans.registry import query

# Parts as another vendor's records: the brand is the series, the part name and key the model.
RECORDS_SQL = """records AS (SELECT p_partkey AS ord, 'Acme' AS vendor, p_brand AS series,
  concat(p_brand, '-', upper(substr(p_name, 1, 3)), cast(p_partkey AS string)) AS model, p_size AS richness FROM {part})"""
# Orders ask for parts in several spellings; the last ones are no known part.
ASKED_SQL = """asked AS (SELECT part AS query_id, part FROM (SELECT DISTINCT CASE
  WHEN l_returnflag = 'R' THEN lower(p_brand)
  WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN concat('ACME ', p_brand, ' ', upper(substr(p_name, 1, 3)), cast(p_partkey AS string))
  WHEN l_returnflag = 'A' THEN concat(p_brand, '/X-', cast(l_linenumber AS string))
  ELSE concat('zz', cast(l_linenumber AS string)) END AS part
  FROM {lineitem} JOIN {part} ON p_partkey = l_partkey) x)"""


def _records(spark, sf):
    return T.run(spark, sf, "WITH " + RECORDS_SQL + " SELECT * FROM records")


def _asked(spark, sf):
    return T.run(spark, sf, "WITH " + ASKED_SQL + " SELECT * FROM asked")


@query("WITH " + RECORDS_SQL + ", " + ASKED_SQL + """, k AS (SELECT query_id, regexp_replace(upper(part), '[^A-Z0-9]+', '', 'g') AS k0 FROM asked),
q AS (SELECT query_id, CASE WHEN k0 LIKE 'ACME%' AND length(k0) > 4 THEN substr(k0, 5) ELSE k0 END AS key FROM k),
keys AS (SELECT regexp_replace(upper(model), '[^A-Z0-9]+', '', 'g') AS key, 'model' AS kind, ord, richness, series, model FROM records
  UNION ALL SELECT regexp_replace(upper(series), '[^A-Z0-9]+', '', 'g'), 'series', ord, richness, series, model FROM records),
best AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY richness DESC, ord, kind) AS rn, count(*) OVER (PARTITION BY key) - 1 AS n_alt FROM keys),
exact AS (SELECT query_id, b.key, b.kind, b.series, b.model, b.n_alt FROM q JOIN best b ON b.key = q.key AND b.rn = 1),
sbest AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY richness DESC, ord) AS rn, count(*) OVER (PARTITION BY key) - 1 AS n_alt FROM keys WHERE kind = 'series' AND length(key) >= 3),
pre AS (SELECT query_id, b.key, 'series-prefix' AS kind, b.series, b.model, b.n_alt,
  row_number() OVER (PARTITION BY query_id ORDER BY length(b.key) DESC) AS pr FROM q JOIN (SELECT * FROM sbest WHERE rn = 1) b ON starts_with(q.key, b.key) AND length(q.key) > length(b.key)
  WHERE query_id NOT IN (SELECT query_id FROM exact)),
hits AS (SELECT * FROM exact UNION ALL SELECT query_id, key, kind, series, model, n_alt FROM pre WHERE pr = 1)
SELECT part, kind, key AS matched_key, series, model, n_alt AS n_alternatives FROM asked LEFT JOIN hits USING (query_id)""")
def resolve_part(spark, sf):
    return M.resolve_part(_asked(spark, sf), _records(spark, sf)).drop("query_id", "vendor")


@query("WITH " + RECORDS_SQL + """, b AS (SELECT regexp_replace(upper(series), '[^A-Z0-9]+', '', 'g') AS key, ord, richness FROM records),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY richness DESC, ord) AS place FROM b) SELECT key, place, ord, richness FROM r WHERE place <= 3""")
def richness_rank(spark, sf):
    """The three richest records of every series, file order among equals."""
    rows = _records(spark, sf).select(part_key(F.col("series")).alias("key"), "ord", "richness")
    return E.top_k(rows, ["key"], [F.desc("richness"), F.asc("ord")], 3, "place")


CODES_SQL = "codes AS (SELECT order_number, type_code, lower(type_code) AS code, ord FROM {catalog})"
# Typed codes: exact, order number, cut short, with a suffix, with a wrong tail.
TYPED_SQL = """typed AS (SELECT c.ord AS query_id, CASE WHEN pdf_page <= 10 THEN lower(type_code) WHEN pdf_page <= 20 THEN concat(' ', order_number, ' ')
  WHEN pdf_page <= 30 THEN substr(type_code, 1, length(type_code) - 1) WHEN pdf_page <= 40 THEN concat(type_code, '-k9')
  ELSE concat(substr(type_code, 1, 5), 'qq') END AS part FROM {catalog} c)"""


def _typed(spark, sf):
    return T.run(spark, sf, "WITH " + TYPED_SQL + " SELECT * FROM typed")


@query("WITH " + CODES_SQL + ", " + TYPED_SQL + """, k AS (SELECT query_id, part, lower(replace(part, ' ', '')) AS key FROM typed)
SELECT k.query_id, k.part, coalesce(a.order_number, b.order_number) AS order_number, coalesce(a.type_code, b.type_code) AS type_code,
  CASE WHEN a.code IS NOT NULL THEN 'type_code' WHEN b.code IS NOT NULL THEN 'order_number' END AS kind
FROM k LEFT JOIN codes a ON a.code = k.key LEFT JOIN codes b ON b.order_number = k.key""")
def find_exact(spark, sf):
    return M.find_exact(_typed(spark, sf), T.products(spark, sf))


@query("WITH " + CODES_SQL + ", " + TYPED_SQL + """, k AS (SELECT query_id, lower(replace(part, ' ', '')) AS key FROM typed),
m AS (SELECT query_id, c.order_number, c.type_code, c.code, key,
  list_max(list_transform(range(0, least(length(key), length(code)) + 1), lambda n: CASE WHEN substr(key, 1, n) = substr(code, 1, n) THEN n ELSE 0 END)) AS shared
  FROM k JOIN codes c ON c.code <> k.key AND (substr(c.code, 1, 4) = substr(k.key, 1, 4) OR (length(key) >= 5 AND contains(c.code, k.key)) OR (length(c.code) >= 5 AND length(key) >= 5 AND contains(k.key, c.code)))
  WHERE length(key) >= 3),
s AS (SELECT *, CASE WHEN shared >= 4 THEN 100 + shared WHEN length(key) >= 5 AND contains(code, key) THEN 50 WHEN length(key) >= 5 AND length(code) >= 5 AND contains(key, code) THEN 40 END AS score FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code) AS rank FROM s WHERE score IS NOT NULL)
SELECT query_id, rank, type_code, order_number, score FROM r WHERE rank <= 5""")
def near_miss(spark, sf):
    return M.near_miss(_typed(spark, sf), T.products(spark, sf)).drop("reason")


@query("WITH " + CODES_SQL + ", " + TYPED_SQL + """, t AS (SELECT query_id, part FROM typed UNION ALL SELECT ord + 100000000, product_name FROM {catalog}),
k AS (SELECT t.*, lower(replace(part, ' ', '')) AS key FROM t)
SELECT query_id, part, CASE WHEN key IN (SELECT code FROM codes) OR key IN (SELECT order_number FROM codes) THEN 'part'
  WHEN regexp_matches(trim(part), '^[0-9]{6,}$') THEN 'part' WHEN len(string_split(trim(part), ' ')) >= 3 THEN 'describe'
  WHEN regexp_matches(part, '[A-Za-z]') AND regexp_matches(part, '[0-9]') THEN 'part' ELSE 'describe' END AS mode FROM k""")
def classify_input(spark, sf):
    rows = T.products(spark, sf)
    texts = _typed(spark, sf).unionByName(rows.select((F.col("ord") + 100000000).alias("query_id"), F.col("product_name").alias("part")))
    return M.classify_input(texts, rows)


# Judged equivalences: one per part, by brand (series) and type (mode).
CROSSREF_SQL = """crossref AS (SELECT p_brand AS from_series, concat(p_brand, '-', cast(p_partkey AS string)) AS from_model,
  CASE WHEN p_size <= 25 THEN lower(p_type) ELSE concat(p_type, ' (variant)') END AS from_mode,
  CASE WHEN p_size <= 44 THEN cast(p_partkey AS string) END AS to_order_number, p_size > 5 AND p_size <= 44 AS adequate,
  CASE WHEN p_size <= 10 THEN 'low' WHEN p_size <= 20 THEN 'medium' WHEN p_size <= 44 THEN 'high' END AS confidence FROM {part})"""


def _crossref(spark, sf):
    return T.run(spark, sf, "WITH " + CROSSREF_SQL + " SELECT * FROM crossref")


@query("WITH " + CROSSREF_SQL + """ SELECT from_series, count(*) AS rows, count(to_order_number) AS with_part, count(*) - count(to_order_number) AS gaps,
  sum(CASE WHEN adequate THEN 1 ELSE 0 END) AS adequate, sum(CASE WHEN confidence = 'high' THEN 1 ELSE 0 END) AS high,
  sum(CASE WHEN confidence = 'medium' THEN 1 ELSE 0 END) AS medium, sum(CASE WHEN confidence = 'low' THEN 1 ELSE 0 END) AS low FROM crossref GROUP BY from_series""")
def crossref_summary(spark, sf):
    return E.crossref_summary(_crossref(spark, sf))


GAP_ASKED_SQL = """asked AS (SELECT p_partkey AS query_id, CASE WHEN p_size <= 25 THEN lower(p_brand) ELSE concat(p_brand, ' ', cast(p_partkey AS string)) END AS part,
  CASE WHEN p_size <= 12 THEN NULL WHEN p_size <= 40 THEN 'economy' ELSE lower(p_type) END AS mode FROM {part})"""


@query("WITH " + CROSSREF_SQL + ", " + GAP_ASKED_SQL + """, g AS (SELECT DISTINCT key, mode FROM (
  SELECT upper(replace(from_series, '#', '')) AS key, lower(trim(string_split(from_mode, '(')[1])) AS mode FROM crossref WHERE to_order_number IS NULL
  UNION ALL SELECT upper(replace(replace(from_model, '#', ''), '-', '')), lower(trim(string_split(from_mode, '(')[1])) FROM crossref WHERE to_order_number IS NULL) x)
SELECT a.query_id, a.mode, EXISTS (SELECT 1 FROM g WHERE g.key = upper(replace(replace(a.part, '#', ''), ' ', '')) AND (a.mode IS NULL OR g.mode = a.mode)) AS known_gap FROM asked a""")
def known_gap(spark, sf):
    asked = T.run(spark, sf, "WITH " + GAP_ASKED_SQL + " SELECT * FROM asked")
    return M.known_gap(asked, _crossref(spark, sf).filter("to_order_number is null")).drop("part")


@query("WITH " + CROSSREF_SQL + ", " + GAP_ASKED_SQL + """, c AS (SELECT *, upper(replace(from_series, '#', '')) AS sk, upper(replace(replace(from_model, '#', ''), '-', '')) AS mk FROM crossref),
q AS (SELECT DISTINCT upper(replace(replace(part, '#', ''), ' ', '')) AS key FROM asked)
SELECT key AS query_id, count(*) AS judgements, count(to_order_number) AS with_part FROM q JOIN c ON c.sk = q.key OR c.mk = q.key GROUP BY key""")
def prior_recommendations(spark, sf):
    """Judgements behind every distinct asked key."""
    asked = T.run(spark, sf, "WITH " + GAP_ASKED_SQL + " SELECT * FROM asked")
    keys = asked.select(part_key(F.col("part")).alias("query_id")).distinct().withColumn("part", F.col("query_id"))
    found = M.prior_recommendations(keys, _crossref(spark, sf))
    return found.groupBy("query_id").agg(F.count("*").alias("judgements"), F.count("to_order_number").alias("with_part"))


SIDES_SQL = """ours AS (SELECT order_number AS id, CASE WHEN section <> 'ECONOMY' THEN section ELSE 'none' END AS mode, sensing_range_max_mm AS range_max_mm FROM {catalog} WHERE pdf_page <= 25),
theirs AS (SELECT order_number AS id, section AS mode, sensing_range_max_mm * 3 / 4 AS range_max_mm FROM {catalog} WHERE pdf_page > 25 AND section <> 'ECONOMY')"""


@query("WITH " + SIDES_SQL + """, n AS (SELECT mode, count(*) AS n_candidates FROM theirs GROUP BY mode),
anyp AS (SELECT mode, id, row_number() OVER (PARTITION BY mode ORDER BY range_max_mm IS NULL, id) AS rn FROM theirs),
p AS (SELECT o.id, o.mode, o.range_max_mm, t.id AS part_id, t.range_max_mm AS pr, t.range_max_mm / o.range_max_mm AS ratio FROM ours o JOIN theirs t ON t.mode = o.mode WHERE t.range_max_mm IS NOT NULL AND o.range_max_mm IS NOT NULL),
s AS (SELECT *, least(100::double, greatest(0::double, 100 - 60 * abs(ln(ratio))) + CASE WHEN ratio >= 1 THEN 8 ELSE 0 END) AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, abs(ln(ratio)), part_id) AS rn FROM s),
alts AS (SELECT id, string_agg(part_id, ',' ORDER BY rn) AS alternatives FROM r WHERE rn BETWEEN 2 AND 5 GROUP BY id)
SELECT o.id, o.mode, coalesce(r.part_id, a.id) AS part_id, round(r.ratio, 6) AS ratio,
  CASE WHEN n.n_candidates IS NULL THEN 'GAP' WHEN r.id IS NULL THEN 'no-range' WHEN abs(ln(r.ratio)) <= 0.35 THEN 'strong'
    WHEN abs(ln(r.ratio)) <= 1.0 THEN 'moderate' WHEN abs(ln(r.ratio)) <= 1.8 THEN 'weak' ELSE 'poor' END AS quality,
  round(coalesce(r.score, 0), 6) AS score, coalesce(n.n_candidates, 0) AS n_candidates, coalesce(alternatives, '') AS alternatives
FROM ours o LEFT JOIN n ON n.mode = o.mode LEFT JOIN r ON r.id = o.id AND r.rn = 1 LEFT JOIN anyp a ON a.mode = o.mode AND a.rn = 1 LEFT JOIN alts ON alts.id = o.id""")
def equivalence_candidates(spark, sf):
    ours = T.run(spark, sf, "WITH " + SIDES_SQL + " SELECT * FROM ours")
    theirs = T.run(spark, sf, "WITH " + SIDES_SQL + " SELECT * FROM theirs")
    out = E.equivalence_candidates(ours, theirs)
    return out.select("id", "mode", "part_id", F.round("ratio", 6).alias("ratio"), "quality", F.round("score", 6).alias("score"),
                      "n_candidates", F.array_join("alternatives", ",").alias("alternatives"))


VIEW_SQL = """v AS (SELECT order_number, type_code, section AS category, sensing_range_max_mm AS range_max_mm,
  CASE WHEN output_type IN ('PNP', 'NPN', 'PNP/NPN') THEN output_type END AS output, CASE WHEN connector <> 'unknown' THEN connector END AS connection,
  light AS light_type, ip_rating, response_time_ms AS response_ms FROM {catalog})"""


def _view(spark, sf):
    return T.run(spark, sf, "WITH " + VIEW_SQL + " SELECT * FROM v")


@query("WITH " + VIEW_SQL + """, p AS (SELECT a.order_number, b.order_number AS candidate, b.range_max_mm AS candidate_range,
  1 / (1 + (coalesce((b.range_max_mm - a.range_max_mm) / greatest(a.range_max_mm, 1::double), 0::double)
    + CASE WHEN a.connection <> b.connection THEN 0.35::double ELSE 0 END + CASE WHEN a.light_type <> b.light_type THEN 0.2::double ELSE 0 END)) AS score
  FROM v a JOIN v b ON b.category = a.category AND b.type_code <> a.type_code
  WHERE (a.range_max_mm IS NOT NULL OR a.output IS NOT NULL) AND (a.range_max_mm IS NULL OR b.range_max_mm >= a.range_max_mm)
    AND (a.output IS NULL OR b.output = a.output OR b.output = 'PNP/NPN')),
r AS (SELECT *, row_number() OVER (PARTITION BY order_number ORDER BY score DESC, candidate) AS rank FROM p)
SELECT order_number, rank, candidate, candidate_range, round(score, 6) AS score FROM r WHERE rank <= 6""")
def interchange(spark, sf):
    return E.interchange(_view(spark, sf))


ASKS_SQL = """asks AS (SELECT concat('nation-', cast(n_nationkey AS string)) AS ask_id, floor(max(c_acctbal) / 20) AS distance_mm,
  CASE n_regionkey WHEN 0 THEN '90pct' WHEN 1 THEN '20pct' WHEN 2 THEN '6pct' ELSE 'other' END AS remission,
  CASE WHEN n_nationkey < 12 THEN 'PNP' WHEN n_nationkey < 18 THEN 'NPN' END AS output, CASE WHEN n_regionkey > 1 THEN 'M8' END AS connection,
  CASE WHEN n_nationkey IN (3, 6, 9, 21) THEN 65 END AS min_ip, CASE WHEN n_regionkey = 3 THEN cast(2 AS double) END AS max_response_ms
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey)"""
DERATED_SQL = "WITH " + VIEW_SQL + ", " + ASKS_SQL + """, q AS (SELECT *, floor(distance_mm * CASE remission WHEN '20pct' THEN 2 WHEN '6pct' THEN 3 ELSE 1 END + 0.5::double) AS required_mm FROM asks),
p AS (SELECT q.ask_id, q.required_mm, v.order_number,
  CASE WHEN coalesce(v.range_max_mm < q.required_mm, false) OR coalesce(v.output <> q.output AND v.output <> 'PNP/NPN', false) OR coalesce(v.ip_rating < q.min_ip, false) THEN 'rejected'
    WHEN v.range_max_mm IS NULL OR (q.output IS NOT NULL AND v.output IS NULL) OR (q.min_ip IS NOT NULL AND v.ip_rating IS NULL) THEN 'unverifiable' ELSE 'ranked' END AS status,
  1 / (1 + (abs(v.range_max_mm - q.required_mm) / greatest(q.required_mm, 1::double) + CASE WHEN v.connection <> q.connection THEN 0.35::double ELSE 0 END
    + CASE WHEN v.response_ms > q.max_response_ms THEN 0.4::double ELSE 0 END)) AS score,
  CASE WHEN v.connection <> q.connection THEN 1 ELSE 0 END + CASE WHEN v.response_ms > q.max_response_ms THEN 1 ELSE 0 END AS n_losses
  FROM q CROSS JOIN v) """


def _asks(spark, sf):
    return T.run(spark, sf, "WITH " + ASKS_SQL + " SELECT * FROM asks").withColumn("distance_mm", F.col("distance_mm").cast("double"))


@query(DERATED_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY score DESC, order_number) AS rank FROM p WHERE status = 'ranked')
SELECT ask_id, rank, order_number, required_mm, round(score, 6) AS score, n_losses FROM r WHERE rank <= 6""")
def derated_solve(spark, sf):
    return E.derated_solve(_view(spark, sf), _asks(spark, sf))


@query(DERATED_SQL + """SELECT ask_id, required_mm, count(*) AS catalogue, sum(CASE WHEN status = 'ranked' THEN 1 ELSE 0 END) AS after_hard,
  sum(CASE WHEN status = 'unverifiable' THEN 1 ELSE 0 END) AS unverifiable, sum(CASE WHEN status = 'rejected' THEN 1 ELSE 0 END) AS rejected FROM p GROUP BY ask_id, required_mm""")
def derated_totals(spark, sf):
    return E.derated_totals(_view(spark, sf), _asks(spark, sf))


# Proposals: each order proposes its lines' parts; the first line is the primary.  Allowed are parts shipped in 1998 or later.
PROPOSED_SQL = """proposed AS (SELECT DISTINCT l_orderkey AS req_id, l_partkey AS order_number, CASE WHEN l_linenumber = 1 THEN 'primary' ELSE 'alternative' END AS role FROM {lineitem}),
allowed AS (SELECT DISTINCT l_orderkey AS req_id, l_partkey AS order_number FROM {lineitem} WHERE l_quantity > 10)"""


@query("WITH " + PROPOSED_SQL + """, pr AS (SELECT p.req_id, min(p.order_number) AS primary_id, bool_and(a.req_id IS NOT NULL) AS ok FROM proposed p
  LEFT JOIN allowed a ON a.req_id = p.req_id AND a.order_number = p.order_number WHERE role = 'primary' GROUP BY p.req_id),
s AS (SELECT p.req_id, p.order_number, p.role, CASE WHEN a.req_id IS NULL THEN 'dropped' WHEN NOT coalesce(pr.ok, false) THEN 'void' ELSE 'kept' END AS status
  FROM proposed p LEFT JOIN allowed a ON a.req_id = p.req_id AND a.order_number = p.order_number LEFT JOIN pr ON pr.req_id = p.req_id
  WHERE NOT (p.role <> 'primary' AND coalesce(p.order_number = pr.primary_id, false)))
SELECT role, status, count(*) AS n, count(DISTINCT req_id) AS requests FROM s GROUP BY role, status""")
def whitelist(spark, sf):
    lines = T.read(spark, sf, "lineitem")
    proposed = lines.select(F.col("l_orderkey").alias("req_id"), F.col("l_partkey").alias("order_number"),
                            F.when(F.col("l_linenumber") == 1, "primary").otherwise("alternative").alias("role"))
    allowed = lines.filter("l_quantity > 10").select(F.col("l_orderkey").alias("req_id"), F.col("l_partkey").alias("order_number"))
    out = M.whitelist(proposed, allowed)
    return out.groupBy("role", "status").agg(F.count("*").alias("n"), F.count_distinct("req_id").alias("requests"))


# Competitor records with modes, housing and ratings in words.
COMPETITOR_SQL = """rec AS (SELECT p_partkey AS id, CASE WHEN p_size <= 20 THEN 'Diffuse' WHEN p_size <= 30 THEN 'fixed-field (long)' WHEN p_size <= 40 THEN 'fiber optic' ELSE 'opposed' END AS m1,
  CASE WHEN p_type IN ('LARGE', 'SMALL') THEN 'diffuse' END AS m2, q_hi AS r1, q_lo AS r2,
  CASE p_type WHEN 'LARGE' THEN 'Stainless steel and glass' WHEN 'SMALL' THEN 'die-cast zinc' WHEN 'PROMO' THEN 'PBT plastic, steel clip' END AS housing_text,
  CASE WHEN p_size > 35 THEN 'IP 69K' WHEN p_size > 5 THEN 'rated IP67 (IP 65)' END AS rating FROM {part} LEFT JOIN {line_stats} ON l_partkey = p_partkey)"""


@query("WITH " + COMPETITOR_SQL + """, m AS (SELECT *, CASE WHEN id IS NULL THEN NULL WHEN m1 = 'Diffuse' THEN 'diffuse' WHEN m1 LIKE 'fixed%' THEN 'background-suppression' WHEN m1 = 'opposed' THEN 'through-beam' END AS p1,
  m2 AS p2 FROM rec)
SELECT id, coalesce(CASE WHEN p1 IS NULL THEN p2 WHEN p2 IS NULL OR p2 = p1 THEN p1 ELSE concat(p1, '|', p2) END, '') AS principles,
  CASE WHEN p1 IS NOT NULL AND (p2 IS NULL OR p2 = p1) THEN CASE WHEN p2 IS NULL THEN r1 ELSE coalesce(greatest(r1, r2), r1, r2) END WHEN p1 IS NULL AND p2 IS NOT NULL THEN r2 END AS reach,
  coalesce(CASE housing_text WHEN 'Stainless steel and glass' THEN 'stainless-steel|other' WHEN 'die-cast zinc' THEN 'metal' WHEN 'PBT plastic, steel clip' THEN 'plastic|metal' END, '') AS housing,
  CASE rating WHEN 'IP 69K' THEN 69 WHEN 'rated IP67 (IP 65)' THEN 67 END AS min_ip_rating, CASE rating WHEN 'IP 69K' THEN true END AS ip69k FROM m""")
def to_requirement(spark, sf):
    """Requirements stated by competitor records of one or two sensing modes."""
    rows = T.run(spark, sf, "WITH " + COMPETITOR_SQL + " SELECT * FROM rec")
    mode = lambda m, r: F.when(F.col(m).isNotNull(), F.struct(F.col(m).alias("mode"), F.col(r).alias("range_max_mm")))
    none = F.lit(None).cast("double")
    records = rows.select("id", F.array_compact(F.array(mode("m1", "r1"), mode("m2", "r2"))).alias("sensing_modes"),
                          F.col("housing_text").alias("housing_material"), F.col("rating").alias("enclosure_rating"),
                          none.alias("operating_temp_min_c"), none.alias("operating_temp_max_c"))
    out = M.to_requirement(records)
    text = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    return out.select("id", text("principle").alias("principles"), F.col("sensing_range_mm.min").alias("reach"), text("housing").alias("housing"), "min_ip_rating", "ip69k")


# --- long-form specs and comparisons ----------------------------------------

DESCRIBED_FIELDS = ["principle", "sensing_range_min_mm", "sensing_range_max_mm", "output_type", "io_link", "response_time_ms", "switching_frequency_hz",
                    "supply_voltage_min_v", "supply_voltage_max_v", "connector", "connector_pins", "ip_rating", "ip69k", "operating_temp_min_c",
                    "operating_temp_max_c", "housing", "light"]
LOW_SQL = {"output_type": "switching_output", "connector": "connection", "connector_pins": "connection", "sensing_range_max_mm": "sensing_range_max_mm",
           "io_link": "switching_output"}
DESCRIBED_SQL = "described AS (" + " UNION ALL ".join(
    f"SELECT order_number, '{f}' AS field, {'coalesce(' + f + ', false)' if f in ('io_link', 'ip69k') else f + ' IS NOT NULL'} AS stated, {f}::varchar AS value, "
    + (f"coalesce(flags LIKE '%{LOW_SQL[f]}%', false)" if f in LOW_SQL else "false") + " AS low FROM {catalog}" for f in DESCRIBED_FIELDS) + ")"


def _described(spark, sf):
    return CP.describe_specs(T.full_products(spark, sf), T.specs(spark, sf))


@query("WITH " + DESCRIBED_SQL + " SELECT field, sum(CASE WHEN stated THEN 1 ELSE 0 END) AS stated, sum(CASE WHEN NOT stated THEN 1 ELSE 0 END) AS silent, "
       "sum(CASE WHEN stated AND low THEN 1 ELSE 0 END) AS low_confidence, count(DISTINCT CASE WHEN stated THEN value END) AS distinct_values FROM described GROUP BY field")
def describe_specs(spark, sf):
    rows = _described(spark, sf).filter(F.col("field").isin(*DESCRIBED_FIELDS))
    return rows.groupBy("field").agg(
        F.count_if("stated").alias("stated"), F.count_if(~F.col("stated")).alias("silent"), F.count_if("low_confidence").alias("low_confidence"),
        F.count_distinct(F.when(F.col("stated"), F.col("value"))).alias("distinct_values"),
    )


@query("WITH " + DESCRIBED_SQL + """ SELECT order_number, count(*) FILTER (WHERE stated) AS rows, 0 AS disputed, count(*) FILTER (WHERE stated AND low) AS below_high
FROM described GROUP BY order_number HAVING count(*) FILTER (WHERE stated) > 0""")
def spec_audit(spark, sf):
    from partlens.operators.coverage import spec_audit as audit

    return audit(_described(spark, sf).filter(F.col("field").isin(*DESCRIBED_FIELDS)))


SILENT = ["principle", "sensing_range_max_mm", "output_type", "ip_rating", "housing"]


@query("SELECT order_number, concat_ws(',', " + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in SILENT) + ") AS silent FROM {catalog}")
def not_stated(spark, sf):
    return T.products(spark, sf).select("order_number", F.array_join(CP.silent_columns(SILENT), ",").alias("silent"))


# Parts compared in pairs: every part with the one behind it in the same brand and type.
GROUPS_SQL = """pairs AS (SELECT order_number AS group_id, order_number, lead(order_number) OVER (PARTITION BY section, source_page ORDER BY order_number) AS other FROM {catalog}),
groups AS (SELECT group_id, order_number FROM pairs WHERE other IS NOT NULL UNION ALL SELECT group_id, other FROM pairs WHERE other IS NOT NULL)"""


@query("WITH " + DESCRIBED_SQL + ", " + GROUPS_SQL + """, cells AS (SELECT g.group_id, d.* FROM groups g JOIN described d ON d.order_number = g.order_number)
SELECT group_id, field, bool_and(stated) AS comparable, CASE WHEN bool_and(stated) THEN count(DISTINCT value) = 1 END AS identical,
  coalesce(string_agg(order_number, ',' ORDER BY order_number) FILTER (WHERE NOT stated), '') AS not_stated_for FROM cells GROUP BY group_id, field""")
def compared_parts(spark, sf):
    """Every field of every group of parts: comparable, identical, and who does not state it."""
    groups = T.run(spark, sf, "WITH " + GROUPS_SQL + " SELECT * FROM groups")
    out = CP.compare(_described(spark, sf).filter(F.col("field").isin(*DESCRIBED_FIELDS)), groups)
    return out.select("group_id", "field", "comparable", "identical", F.array_join("not_stated_for", ",").alias("not_stated_for"))


@query("WITH " + DESCRIBED_SQL + ", " + GROUPS_SQL + """, cells AS (SELECT g.group_id, d.* FROM groups g JOIN described d ON d.order_number = g.order_number),
f AS (SELECT group_id, field, bool_and(stated) AS comparable, count(DISTINCT CASE WHEN stated THEN value END) AS n FROM cells GROUP BY group_id, field)
SELECT field, count(*) AS groups, sum(CASE WHEN comparable THEN 1 ELSE 0 END) AS comparable, sum(CASE WHEN comparable AND n = 1 THEN 1 ELSE 0 END) AS identical FROM f GROUP BY field""")
def compare_parts(spark, sf):
    groups = T.run(spark, sf, "WITH " + GROUPS_SQL + " SELECT * FROM groups")
    out = CP.compare(_described(spark, sf).filter(F.col("field").isin(*DESCRIBED_FIELDS)), groups)
    return out.groupBy("field").agg(F.count("*").alias("groups"), F.count_if("comparable").alias("comparable"), F.count_if("identical").alias("identical"))


@query("""WITH asked AS (SELECT DISTINCT upper(p_brand) AS asked FROM {part} UNION ALL SELECT 'no such family'),
r AS (SELECT lower(family) AS key, min(section) AS section, sum(CASE WHEN row_type = 'product' THEN 1 ELSE 0 END) AS variants,
  sum(CASE WHEN row_type = 'accessory' THEN 1 ELSE 0 END) AS accessories, count(DISTINCT source_page) AS n_pages, min(product_url) AS product_url FROM {catalog} WHERE family IS NOT NULL GROUP BY 1)
SELECT asked, section, variants, accessories, n_pages, product_url, section IS NOT NULL AS found FROM asked LEFT JOIN r ON r.key = lower(asked)""")
def list_family(spark, sf):
    rows = T.full_products(spark, sf)
    names = T.read(spark, sf, "part").select(F.upper("p_brand").alias("family")).distinct()
    names = names.unionByName(spark.createDataFrame([("no such family",)], "family string"))
    out = CP.list_family(rows, names)
    return out.select("asked", "section", "variants", "accessories", F.size("pages").alias("n_pages"), "product_url", "found")


@query("WITH " + DESCRIBED_SQL + """, ids AS (SELECT DISTINCT cast(l_partkey + 1000000 + CASE WHEN l_quantity >= 50 THEN 900000000 ELSE 0 END AS string) AS order_number FROM {lineitem})
SELECT i.order_number, count(CASE WHEN stated THEN 1 END) AS stated, bool_or(d.field IS NOT NULL) AS found FROM ids i LEFT JOIN described d ON d.order_number = i.order_number GROUP BY i.order_number""")
def get_product(spark, sf):
    """Asked ids, some of which the catalog does not carry."""
    lots = T.read(spark, sf, "lineitem")
    ids = lots.select((F.col("l_partkey") + 1000000 + F.when(F.col("l_quantity") >= 50, 900000000).otherwise(0)).cast("string").alias("order_number"))
    out = CP.get_product(T.full_products(spark, sf), T.specs(spark, sf), ids)
    kept = out.filter(F.col("field").isNull() | F.col("field").isin(*DESCRIBED_FIELDS))
    return kept.groupBy("order_number").agg(F.count_if("stated").alias("stated"), F.bool_or("found").alias("found"))


@query("WITH " + DESCRIBED_SQL + """, claims AS (SELECT l_orderkey * 10 + l_linenumber AS claim_id, cast(l_partkey + 1000000 AS string) AS order_number,
  CASE WHEN l_returnflag = 'R' THEN 'sensing_range_max_mm' WHEN l_returnflag = 'A' THEN 'output_type' ELSE 'housing' END AS field, l_quantity * 4 AS cm, l_returnflag, l_linestatus FROM {lineitem}),
j AS (SELECT c.*, d.stated, d.value FROM claims c LEFT JOIN described d ON d.order_number = c.order_number AND d.field = c.field),
v AS (SELECT field, CASE WHEN stated AND field = 'sensing_range_max_mm' AND NOT abs(value::double - cm * 10) <= greatest(1e-6, 0.05::double * greatest(abs(value::double), abs(cm * 10))) THEN 'refuted'
  WHEN stated AND field = 'output_type' AND NOT contains(regexp_replace(lower(value), '[^a-z0-9]', '', 'g'), 'npn') THEN 'refuted'
  WHEN stated AND field = 'housing' AND value <> 'metal' THEN 'refuted'
  WHEN NOT stated AND l_linestatus = 'O' THEN 'unverifiable' WHEN l_linestatus = 'O' THEN 'upheld' ELSE 'unverifiable' END AS verdict, coalesce(stated, false) AS cited FROM j)
SELECT field, verdict, cited, count(*) AS claims FROM v GROUP BY field, verdict, cited""")
def fact_check(spark, sf):
    """Claims about shipped parts, each tested against the long-form specs."""
    lines = T.read(spark, sf, "lineitem")
    field = F.when(F.col("l_returnflag") == "R", "sensing_range_max_mm").when(F.col("l_returnflag") == "A", "output_type").otherwise("housing")
    said = F.when(F.col("l_returnflag") == "R", F.concat((F.col("l_quantity") * 4).cast("int").cast("string"), F.lit(" cm"))).when(F.col("l_returnflag") == "A", "NPN").otherwise("Metal")
    claims = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), (F.col("l_partkey") + 1000000).cast("string").alias("order_number"),
                          field.alias("field"), said.alias("asserted"), F.when(F.col("l_linestatus") == "O", "upheld").otherwise("unverifiable").alias("verdict"))
    out = A.fact_check(claims, _described(spark, sf), {"sensing_range_max_mm": "mm"})
    return out.groupBy("field", "verdict", "cited").agg(F.count("*").alias("claims"))


# Designs: every order is a design, its lines are sensors, cables or brackets.
LINES_SQL = """lines AS (SELECT DISTINCT l_orderkey AS design_id, order_number, CASE WHEN pdf_page > 20 THEN 'sensor' WHEN pdf_page > 8 THEN 'cable' ELSE 'bracket' END AS role, c.* EXCLUDE (order_number)
  FROM {lineitem} JOIN {catalog} c ON c.ord = l_partkey),
designs AS (SELECT o_orderkey AS design_id, CASE WHEN o_orderstatus <> 'P' THEN cast(800 AS double) END AS sensing_distance_mm, CASE WHEN o_orderpriority LIKE '1%' THEN 'PNP' WHEN o_orderpriority LIKE '2%' THEN 'push-pull' END AS want,
  CASE WHEN o_orderpriority NOT LIKE '5%' THEN cast(24 AS double) END AS volts, o_orderpriority LIKE '3%' AS washdown FROM {orders}),
j AS (SELECT l.*, d.* EXCLUDE (design_id) FROM lines l JOIN designs d ON d.design_id = l.design_id)"""
COMPAT_SQL = "WITH " + LINES_SQL + """, plugs AS (SELECT design_id, order_number, CASE WHEN connector <> 'unknown' THEN connector END AS plug, connector FROM lines WHERE role = 'sensor'),
socks AS (SELECT DISTINCT design_id, CASE WHEN connector <> 'unknown' THEN connector END AS socket FROM lines WHERE role = 'cable'),
checks AS (
  SELECT 'range' AS "check", CASE WHEN sensing_range_max_mm IS NULL THEN 'unverified' WHEN sensing_range_max_mm >= sensing_distance_mm THEN 'ok' ELSE 'warning' END AS status FROM j WHERE role = 'sensor' AND sensing_distance_mm IS NOT NULL
  UNION ALL SELECT 'output', CASE WHEN output_type IS NULL OR output_type = 'unknown' THEN 'unverified' WHEN output_type = want OR output_type = 'PNP/NPN' THEN 'ok' ELSE 'warning' END FROM j WHERE role = 'sensor' AND want IS NOT NULL
  UNION ALL SELECT 'voltage', CASE WHEN coalesce(volts >= supply_voltage_min_v, true) AND coalesce(volts <= supply_voltage_max_v, true) THEN 'ok' ELSE 'warning' END FROM j WHERE volts IS NOT NULL AND (supply_voltage_min_v IS NOT NULL OR supply_voltage_max_v IS NOT NULL)
  UNION ALL SELECT 'voltage', 'unverified' FROM (SELECT design_id FROM j WHERE volts IS NOT NULL GROUP BY design_id HAVING NOT bool_or(supply_voltage_min_v IS NOT NULL OR supply_voltage_max_v IS NOT NULL)) x
  UNION ALL SELECT 'connector', CASE WHEN plug IS NULL OR socket IS NULL THEN 'unverified' WHEN plug = socket THEN 'ok' ELSE 'warning' END FROM plugs p JOIN socks s ON s.design_id = p.design_id
  UNION ALL SELECT 'cordset', 'warning' FROM plugs p WHERE connector IS NOT NULL AND connector <> 'cable' AND design_id NOT IN (SELECT design_id FROM socks)
  UNION ALL SELECT 'washdown', CASE WHEN ip_rating IS NULL THEN 'unverified' WHEN ip69k THEN 'ok' ELSE 'warning' END FROM j WHERE role = 'sensor' AND washdown
  UNION ALL SELECT 'fitment', 'unverified' FROM (SELECT DISTINCT design_id FROM j WHERE role <> 'sensor') y)
SELECT "check", status, count(*) AS n FROM checks GROUP BY 1, 2"""


@query(COMPAT_SQL)
def compat_checks(spark, sf):
    rows = T.products(spark, sf)
    role = F.when(F.col("pdf_page") > 20, "sensor").when(F.col("pdf_page") > 8, "cable").otherwise("bracket")
    picked = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("design_id"), F.col("l_partkey").alias("ord")).distinct()
    lines = picked.join(rows, "ord").withColumn("role", role)
    o = T.read(spark, sf, "orders")
    starts = lambda n: F.col("o_orderpriority").startswith(n)
    designs = o.select(
        F.col("o_orderkey").alias("design_id"), F.when(F.col("o_orderstatus") != "P", 800.0).alias("sensing_distance_mm"),
        F.when(starts("1"), "PNP").when(starts("2"), "push-pull").alias("output_type"), F.when(~starts("5"), 24.0).alias("supply_voltage_v"), starts("3").alias("washdown"),
    )
    return A.compat_checks(lines, designs).groupBy("check", "status").agg(F.count("*").alias("n"))
