"""Retrieval, chunk, coverage, bill-of-materials, image and trace queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from partlens.operators import audit as A
from partlens.operators import bom as B
from partlens.operators import chunks as C
from partlens.operators import coverage as CV
from partlens.operators import images as IM
from partlens.operators import match as M
from partlens.operators import normalize as N
from partlens.operators import paged as PG
from partlens.operators import retrieval as R
from partlens.plans import tables as T
from partlens.plans import tools
from partlens.plans.build_index import index_tables, search_tables
from partlens.plans.registry import query
from partlens.plans.scale import block_row_number, spread, top_k
from partlens.plans.search import hybrid_search, retrieved_ids
from partlens.plans.solve_queries import ANCHOR_SQL, CONFIDENCE_SQL, DISCRIMINATORS, PAIRS_SQL, QUESTIONS_SQL, _list
from partlens.session import cut_lineage, shared_folder
from partlens.sources import posting_store as PS
from partlens.sources.bom_files import split_boms
from partlens.sources.index_store import provenance, read_index, write_index
from partlens.streaming.bom import audit_files, audited_lines
from partlens.streaming.trace import latest_summary, summarize_stream, write_summary

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in R.STOPWORDS) + "]"


def _tokens_sql(text: str) -> str:
    t = f"lower(strip_accents({text}))"
    squash = "lambda w: regexp_replace(w, '[^a-z0-9]+', '', 'g')"
    return (
        f"list_concat(list_concat(regexp_extract_all({t}, '[a-z0-9]+'), list_transform(regexp_extract_all({t}, '[a-z0-9]+(?:[^a-z0-9\\s]+[a-z0-9]+)+'), {squash})), "
        f"list_transform(regexp_extract_all({t}, '(?:^|[^a-z0-9])[a-z]{{1,3}}[^a-z0-9]*\\s[^a-z0-9]*[0-9][a-z0-9]*'), {squash}))"
    )


TERM_SQL = f"""CASE WHEN length(token) < 2 THEN NULL WHEN regexp_matches(token, '[0-9]') THEN token WHEN list_contains({STOP_SQL}, token) THEN NULL
  WHEN token IN ('series', 'species') THEN token WHEN token LIKE '%ies' AND length(token) >= 5 THEN concat(substr(token, 1, length(token) - 3), 'y')
  WHEN token LIKE '%ing' AND length(token) >= 6 THEN substr(token, 1, length(token) - 3) WHEN token LIKE '%ed' AND length(token) >= 5 AND token NOT LIKE '%eed' THEN substr(token, 1, length(token) - 2)
  WHEN token LIKE '%s' AND length(token) >= 4 AND NOT regexp_matches(token, '(ss|us|is)$') THEN substr(token, 1, length(token) - 1) ELSE token END"""


def _postings_sql(table: str, id_: str) -> str:
    return f"""raw AS MATERIALIZED (SELECT {id_} AS id, {_tokens_sql('text')} AS tokens FROM {table}),
lens AS (SELECT id, len(list_distinct(tokens)) AS length FROM raw), tok AS (SELECT id, unnest(tokens) AS token FROM raw),
post AS MATERIALIZED (SELECT term, id, count(*) AS tf FROM (SELECT id, {TERM_SQL} AS term FROM tok) x WHERE term IS NOT NULL GROUP BY term, id)"""


def _bm25_sql(queries: str, id_: str) -> str:
    return f""", st AS (SELECT count(*)::double AS n, avg(length) AS al FROM lens), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qtok AS (SELECT {id_} AS query_id, unnest({_tokens_sql('text')}) AS token FROM {queries}),
qterm AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, {TERM_SQL} AS term FROM qtok) x WHERE term IS NOT NULL GROUP BY query_id, term),
w AS (SELECT q.query_id, p.id AS item, qtf * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (0.5::double + tf * 2.2::double / (tf + 1.2::double * (0.3::double + 0.7::double * l.length / al))) AS s
  FROM qterm q JOIN post p ON p.term = q.term JOIN dfs d ON d.term = q.term JOIN lens l ON l.id = p.id, st),
bm AS (SELECT query_id, item, round(sum(s), 9) AS score FROM w GROUP BY query_id, item)"""


POSTINGS_SQL = _postings_sql("documents", "doc_id")


def _documents(spark, sf):
    return spread(T.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("WITH " + POSTINGS_SQL + " SELECT term, count(*) AS df, sum(tf) AS total_tf FROM post GROUP BY term")
def term_stats(spark, sf):
    return R.term_stats(R.build_postings(_documents(spark, sf)))


@query("WITH " + POSTINGS_SQL + " SELECT p.id, terms, p.tokens, length FROM (SELECT id, count(*) AS terms, sum(tf) AS tokens FROM post GROUP BY id) p JOIN lens ON lens.id = p.id")
def postings(spark, sf):
    post = R.build_postings(_documents(spark, sf))
    return post.groupBy("id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"), F.max("length").alias("length"))


@query("WITH " + POSTINGS_SQL + " SELECT count(*) AS n_docs, round(avg(length), 6) AS avg_length FROM lens")
def corpus_stats(spark, sf):
    return R.corpus_stats(R.doc_lengths(_documents(spark, sf))).select("n_docs", F.round("avg_length", 6).alias("avg_length"))


BM25_SQL = POSTINGS_SQL + _bm25_sql("benchmark", "item_id") + """,
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) - 1 AS rank FROM bm)"""


def _queries(spark, sf):
    return T.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark, sf, k):
    return R.bm25_over(_queries(spark, sf), _documents(spark, sf), k)


@query("WITH " + BM25_SQL + " SELECT query_id, rank, item, round(score, 5) AS score FROM bmr WHERE rank < 10")
def bm25_topk(spark, sf):
    return _bm25(spark, sf, 10).select("query_id", "rank", "item", F.round("score", 5).alias("score"))


@query("WITH " + BM25_SQL + " SELECT query_id, rank, item, round(score, 5) AS score FROM bmr WHERE rank < 10")
def index_search(spark, sf):
    """The same search out of postings that are written, read back and checked first."""
    version = f"{shared_folder(spark)}/postings"
    PS.write_postings(_documents(spark, sf), version)
    stored = PS.read_postings(spark, version)
    PS.validate_postings(stored)
    return PS.search(_queries(spark, sf), stored, 10).select("query_id", "rank", "item", F.round("score", 5).alias("score"))


# One query vector per label: the mean of its vectors, so queries stay few at any scale.
DENSE_SQL = """e AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings), dims AS (SELECT label, unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM e),
means AS (SELECT label, i, round(avg(x), 9) AS m FROM dims GROUP BY label, i), q AS (SELECT label AS query_id, list(m ORDER BY i) AS qv FROM means GROUP BY label),
sims AS (SELECT query_id, vec_id AS item, round(list_cosine_similarity(qv, v), 9) AS score FROM q CROSS JOIN e),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) - 1 AS rank FROM sims)"""


def _centroids(spark, sf):
    dims = T.read(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = dims.groupBy("label", "i").agg(F.round(F.avg("x"), 9).alias("m"))
    # One row per dimension of each label: a fixed number of rows per group.
    listed = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy("label").agg(F.transform(listed, lambda e: e["m"]).alias("embedding")).select(F.col("label").alias("query_id"), "embedding")


@query("WITH " + DENSE_SQL + " SELECT query_id, rank, item, round(score, 6) AS score FROM dr WHERE rank < 10")
def dense_topk(spark, sf):
    vectors = T.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return R.dense_search(_centroids(spark, sf), vectors, 10).select("query_id", "rank", "item", F.round("score", 6).alias("score"))


LANES_SQL = BM25_SQL + """, l1 AS (SELECT query_id, item, rank FROM bmr WHERE rank < 20), l2s AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, item) - 1 AS rank
  FROM (SELECT query_id, item, n_chars FROM bmr JOIN documents ON doc_id = item WHERE rank < 60) x), l2 AS (SELECT * FROM l2s WHERE rank < 20),
u AS (SELECT coalesce(l1.query_id, l2.query_id) AS query_id, coalesce(l1.item, l2.item) AS item, l1.rank AS bm25_rank, l2.rank AS dense_rank FROM l1 FULL JOIN l2 ON l1.query_id = l2.query_id AND l1.item = l2.item),
f AS (SELECT *, coalesce(1 / (60::double + bm25_rank), 0) + coalesce(0.5::double / (60::double + dense_rank), 0) AS rrf FROM u),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, item) - 1 AS fused_rank FROM f)"""


def _fused(spark, sf):
    """The lexical lane fused with a second lane that orders its candidates by length."""
    # A few rows for each query, read three times.
    lexical = cut_lineage(_bm25(spark, sf, 60))
    sizes = T.read(spark, sf, "documents").select(F.col("doc_id").alias("item"), "n_chars")
    second = top_k(lexical.drop("rank").join(sizes, "item"), ["query_id"], [F.desc("n_chars"), F.asc("item")], 20)
    lanes = lexical.filter("rank < 20").select("query_id", "item", "rank", F.lit("bm25").alias("lane")).unionByName(
        second.select("query_id", "item", (F.col("rank") - 1).alias("rank"), F.lit("dense").alias("lane"))
    )
    return R.rrf(lanes, ["bm25", "dense"], weights={"dense": 0.5})


@query("WITH " + LANES_SQL + " SELECT query_id, item, bm25_rank, dense_rank, fused_rank, round(rrf, 9) AS rrf_score FROM fr")
def rrf_fuse(spark, sf):
    return _fused(spark, sf).withColumn("rrf_score", F.round("rrf_score", 9))


@query("WITH " + LANES_SQL + """, m AS (SELECT fr.*, CASE WHEN fused_rank < 10 THEN quality * 1.0::double END AS s FROM fr LEFT JOIN labels ON doc_id = item),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, fused_rank) - 1 AS rank FROM m)
SELECT query_id, rank, item, CASE WHEN s IS NOT NULL THEN rank END AS rerank_rank, fused_rank FROM r WHERE rank < 10""")
def merge_rerank(spark, sf):
    scores = T.read(spark, sf, "labels").select(F.col("doc_id").alias("item"), F.col("quality").cast("double").alias("rerank_score"))
    fused = _fused(spark, sf)
    reranked = fused.join(scores, "item").select("query_id", "item", "rerank_score")
    return R.merge_rerank(fused, reranked, window=10, k=10).select("query_id", "rank", "item", "rerank_rank", "fused_rank")


@query("WITH " + LANES_SQL + " SELECT query_id, bool_or(bm25_rank IS NOT NULL) AS bm25, bool_or(dense_rank IS NOT NULL) AS dense, false AS rerank FROM fr GROUP BY query_id")
def lane_status(spark, sf):
    fused = R.merge_rerank(_fused(spark, sf), None, k=100)
    return R.lane_status(fused, ["bm25", "dense", "rerank"])


def _index(spark, sf):
    return search_tables({**index_tables(T.full_products(spark, sf)), "spec": T.specs(spark, sf)})


CARD_SEARCH_SQL = PAIRS_SQL + ", " + _postings_sql("{cards}", "id") + _bm25_sql("{card_queries}", "query_id") + """,
alive AS (SELECT req_id, order_number FROM counted WHERE failed = 0),
allowed AS (SELECT q.query_id, c.id AS item FROM {card_queries} q JOIN {cards} c ON q.req_id IS NULL WHERE trim(q.text) <> ''
  UNION ALL SELECT q.query_id, c.id FROM {card_queries} q JOIN alive a ON a.req_id = q.req_id JOIN {cards} c ON c.order_number = a.order_number
  UNION ALL SELECT DISTINCT q.query_id, c.document_id FROM {card_queries} q JOIN alive a ON a.req_id = q.req_id JOIN {cards} c ON c.order_number = a.order_number),
l1 AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) - 1 AS rank FROM bm JOIN allowed USING (query_id, item)),
sims AS (SELECT query_id, item, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) AS score FROM allowed JOIN {card_queries} q USING (query_id) JOIN {card_vectors} v ON v.chunk_id = item),
l2 AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) - 1 AS rank FROM sims),
u AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.item, b.item) AS item, a.rank AS bm25_rank, b.rank AS dense_rank FROM (SELECT * FROM l1 WHERE rank < 60) a FULL JOIN (SELECT * FROM l2 WHERE rank < 60) b ON a.query_id = b.query_id AND a.item = b.item),
f AS (SELECT *, coalesce(1 / (60::double + bm25_rank), 0) + coalesce(1 / (60::double + dense_rank), 0) AS rrf FROM u),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, item) - 1 AS fused_rank FROM f),
urls AS (SELECT section, family, min(product_url) AS url FROM {catalog} GROUP BY section, family),
cited AS (SELECT fr.*, c.kind, c.order_number, c.section, c.family, c.source_page, coalesce(p.product_url, u.url) AS product_url, p.type_code
  FROM fr JOIN {cards} c ON c.id = item LEFT JOIN {catalog} p ON p.order_number = c.order_number LEFT JOIN urls u ON u.section = c.section AND u.family = c.family)"""


def _card_index(spark, sf):
    """The cards and their catalog as an index that is written, read back and checked."""
    products = T.full_products(spark, sf)
    families = products.groupBy("section", "family").agg(F.min("product_url").alias("product_url"))
    tables = {"chunk": T.derive(spark, sf, "cards"), "vector": T.derive(spark, sf, "card_vectors"), "product": products, "spec": T.specs(spark, sf), "family": families}
    path = f"{shared_folder(spark)}/index"
    write_index(tables, path, "derived")
    return read_index(spark, path)


@query(CARD_SEARCH_SQL + " SELECT query_id, fused_rank AS rank, item, kind, bm25_rank, dense_rank, order_number, type_code, source_page, product_url FROM cited WHERE fused_rank < 10")
def hybrid_topk(spark, sf):
    """Questions searched over the cards of a stored index in both lanes, each over what its requirement allows."""
    found = hybrid_search(_card_index(spark, sf), T.derive(spark, sf, "card_queries"), T.requirements(spark, sf), top=10)
    return found.select("query_id", "rank", "item", "kind", "bm25_rank", "dense_rank", "order_number", "type_code", "source_page", "product_url")


@query(CARD_SEARCH_SQL + """ SELECT query_id, order_number, min(fused_rank) AS rank FROM cited WHERE fused_rank < 25 AND order_number IS NOT NULL GROUP BY query_id, order_number""")
def search_catalog(spark, sf):
    """The products among the first 25 hits of every question, each at its best place."""
    return retrieved_ids(tools.search_catalog(_card_index(spark, sf), T.derive(spark, sf, "card_queries"), T.requirements(spark, sf), top=25))


STATS_FIELDS = ["output_type", "ip_rating", "light"]


@query("WITH t AS (SELECT * FROM {catalog}), n AS (SELECT count(*) AS chunk_count, count(*) FILTER (WHERE kind = 'family') AS family_card_count, count(DISTINCT document_id) AS document_count FROM {cards}), "
       + "v AS (SELECT count(*) AS embedded_count, max(len(embedding)) AS embedding_width FROM {card_vectors}) "
       + " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS stated, round(100.0::double * count({f}) / count(*), 1) AS pct, max(chunk_count) AS chunk_count, max(family_card_count) AS family_card_count, max(document_count) AS document_count, max(embedded_count) AS embedded_count, max(embedding_width) AS embedding_width FROM t, n, v" for f in STATS_FIELDS))
def index_stats(spark, sf):
    """Counts of a stored index beside the coverage of some of its fields."""
    counts, fields = tools.index_stats(_card_index(spark, sf), STATS_FIELDS, "derived")
    one = counts.select(F.lit(1).alias("_one"), "chunk_count", "family_card_count", "document_count", "embedded_count", "embedding_width")
    return fields.withColumn("_one", F.lit(1)).join(one, "_one").select("field", "stated", "pct", *one.columns[1:])


MIGRATE_SQL = CONFIDENCE_SQL + ", firsts AS (SELECT req_id, min(CASE WHEN survives THEN rnk END) AS sr, count(*) AS n FROM judged GROUP BY req_id), " + f"""
told AS (SELECT *, {ANCHOR_SQL} AS anchored, {_list(DISCRIMINATORS)} AS found FROM {{reqs}}), asked AS ({QUESTIONS_SQL}),
asks AS (SELECT req_id, string_agg(field, ',' ORDER BY place) AS questions FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY place) AS turn FROM asked) x WHERE turn <= 4 GROUP BY req_id)
SELECT t.req_id, CASE WHEN NOT (anchored AND found <> '') THEN 'needs_input' WHEN sr IS NOT NULL THEN 'recommendation' ELSE 'no_equivalent' END AS outcome,
  CASE WHEN sr IS NOT NULL THEN j.order_number END AS order_number, CASE WHEN sr IS NULL THEN j.order_number END AS closest,
  coalesce(sr, n) AS n_challenged, j.failed + j.unknown AS n_losses, j.confidence, coalesce(questions, '') AS questions
FROM told t LEFT JOIN firsts f ON f.req_id = t.req_id AND anchored AND found <> '' LEFT JOIN judged j ON j.req_id = f.req_id AND j.rnk = coalesce(sr, 1) LEFT JOIN asks a ON a.req_id = t.req_id"""


@query(MIGRATE_SQL)
def migrate(spark, sf):
    """An outcome per requirement: questions, a recommendation, or the closest part."""
    from partlens.plans.migration import migrate as run

    out = run({"product": T.products(spark, sf), "spec": T.specs(spark, sf)}, T.requirements(spark, sf))
    return out.select("req_id", "outcome", "order_number", "closest", "n_challenged", F.nullif(F.size("losses"), F.lit(-1)).alias("n_losses"), "confidence",
                      F.coalesce(F.array_join("questions", ","), F.lit("")).alias("questions"))


# --- chunks ------------------------------------------------------------------

DOC_SQL = """d AS (SELECT *, concat('family:', section, ':', coalesce(family, '(no family)')) AS document_id FROM {catalog}),
n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY pdf_page, ord) AS chunk_index FROM d)"""


@query("WITH " + DOC_SQL + """ SELECT concat('sku:', order_number) AS id, 'sku' AS kind, document_id, chunk_index FROM n
UNION ALL SELECT DISTINCT document_id, 'family', document_id, 0 FROM n""")
def build_documents(spark, sf):
    return C.build_documents(T.full_products(spark, sf)).select("id", "kind", "document_id", "chunk_index")


_mm = lambda v: f"concat({v}::bigint, ' mm', CASE WHEN {v} >= 100 AND {v} < 1000 THEN concat(' (', rtrim(rtrim(({v} / 10)::decimal(18,3)::varchar, '0'), '.'), ' cm / ', rtrim(rtrim(({v} / 1000)::decimal(18,3)::varchar, '0'), '.'), ' m)') WHEN {v} >= 10 AND {v} < 100 THEN concat(' (', rtrim(rtrim(({v} / 10)::decimal(18,3)::varchar, '0'), '.'), ' cm)') WHEN {v} >= 1000 THEN concat(' (', rtrim(rtrim(({v} / 1000)::decimal(18,3)::varchar, '0'), '.'), ' m)') ELSE '' END)"


@query("""SELECT order_number, md5(concat_ws(chr(10), concat_ws(' · ', type_code, regexp_replace(type_code, '[^A-Za-z0-9]', '', 'g'), order_number, family, row_type, source_page), product_name,
  CASE section WHEN 'STANDARD' THEN 'Fotocelulas (Photoelectric sensors)' ELSE category END,
  CASE WHEN sensing_range_min_mm = sensing_range_max_mm THEN concat('sensing range ', """ + _mm("sensing_range_max_mm") + """) WHEN sensing_range_min_mm IS NOT NULL AND sensing_range_max_mm IS NOT NULL THEN concat('sensing range ', """ + _mm("sensing_range_min_mm") + ", ' ... ', " + _mm("sensing_range_max_mm") + """)
    WHEN sensing_range_max_mm IS NOT NULL THEN concat('sensing range ≤ ', """ + _mm("sensing_range_max_mm") + ") WHEN sensing_range_min_mm IS NOT NULL THEN concat('sensing range ≥ ', " + _mm("sensing_range_min_mm") + """) END, product_url)) AS card FROM {catalog}""")
def row_cards(spark, sf):
    """Row cards of identity, name, category, range and link."""
    rows = T.full_products(spark, sf)
    unused = ["supply_voltage_min_v", "supply_voltage_max_v", "response_time_ms", "switching_frequency_hz", "operating_temp_min_c", "operating_temp_max_c"]
    plain = rows.withColumns({c: F.lit(None).cast("double") for c in unused})
    return plain.select("order_number", F.md5(C.row_card()).alias("card"))


@query("""SELECT conv_id AS document_id, 0 AS slice, count(*) AS chunks, md5(string_agg(text, '|' ORDER BY turn)) AS joined FROM conversations GROUP BY conv_id""")
def group_chunks(spark, sf):
    """Turns of every conversation as the ordered chunks of a document."""
    turns = T.read(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    out = C.group_chunks(turns)
    return out.select("document_id", "slice", F.size("ids").alias("chunks"), F.md5(F.array_join("texts", "|")).alias("joined"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS position FROM lineitem")
def chunk_index(spark, sf):
    """Position of every line in its supplier's history, counted in day blocks."""
    rows = T.read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    out = block_row_number(rows, ["l_suppkey"], order, [F.col("l_shipdate")], "position")
    return out.drop("l_extendedprice", "l_shipdate")


@query("""WITH c AS (SELECT source AS grp, lang AS v, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY source, lang),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, f) AS rn FROM c) SELECT grp, string_agg(v, ',' ORDER BY rn) AS top FROM r WHERE rn <= 3 GROUP BY grp""")
def top_distinct(spark, sf):
    rows = T.read(spark, sf, "documents").select(F.col("source").alias("grp"), "lang", F.col("doc_id").alias("ord"))
    return C.top_distinct(rows, ["grp"], F.col("lang"), 3, "top").select("grp", F.array_join("top", ",").alias("top"))


@query("SELECT section, family, coalesce(min(sensing_range_min_mm), min(sensing_range_max_mm)) AS low, max(sensing_range_max_mm) AS high FROM {catalog} GROUP BY section, family HAVING max(sensing_range_max_mm) IS NOT NULL")
def envelope(spark, sf):
    return C.envelope(T.products(spark, sf), ["section", "family"], "sensing_range_min_mm", "sensing_range_max_mm")


@query("""SELECT section, coalesce(family, '(no family)') AS family, sum(CASE WHEN row_type = 'product' THEN 1 ELSE 0 END) AS product_variants, sum(CASE WHEN row_type = 'accessory' THEN 1 ELSE 0 END) AS accessory_rows,
  count(DISTINCT source_page) AS n_pages FROM {catalog} GROUP BY 1, 2""")
def family_rollup(spark, sf):
    return C.family_rollup(T.products(spark, sf))


# --- coverage ----------------------------------------------------------------

FIELDS = ["principle", "sensing_range_min_mm", "sensing_range_max_mm", "output_type", "ip_rating", "response_time_ms", "housing", "light"]


@query("WITH t AS (SELECT * FROM {catalog}) " + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS total, count({f}) AS stated, round(100.0::double * count({f}) / count(*), 1) AS pct FROM t" for f in FIELDS))
def coverage(spark, sf):
    return CV.coverage(T.specs(spark, sf), FIELDS)


@query("WITH t AS (SELECT * FROM {catalog}) " + " UNION ALL ".join(
    f"SELECT '{f}' AS field, count({f}) AS present, sum(CASE WHEN {f} IS NOT NULL AND flags LIKE '%{g}%' THEN 1 ELSE 0 END) AS from_prose FROM t"
    for f, g in [("sensing_range_max_mm", "sensing_range_max_mm"), ("output_type", "switching_output"), ("connector", "connection")]))
def coverage_with_source(spark, sf):
    names = {"sensing_range_max_mm": "sensing_range_max_mm", "output_type": "switching_output", "connector": "connection"}
    rows = T.products(spark, sf)
    prose = F.array_compact(F.array(*[F.when(F.col(f).isNotNull() & F.coalesce(F.contains("flags", F.lit(g)), F.lit(False)), F.lit(f)) for f, g in names.items()]))
    return CV.coverage_with_source(rows.withColumn("prose", prose), list(names))


@query("""SELECT 'ip_rating' AS field, 'enclosure' AS baseline_field, count(CASE WHEN n_lines > 32 THEN 1 END) AS before, count(CASE WHEN n_lines > 25 THEN 1 END) AS after, count(CASE WHEN n_lines > 25 THEN 1 END) - count(CASE WHEN n_lines > 32 THEN 1 END) AS lift FROM {part} LEFT JOIN {line_stats} ON l_partkey = p_partkey
UNION ALL SELECT 'principle', NULL, 0, count(CASE WHEN p_type IN ('STANDARD', 'LARGE', 'MEDIUM', 'PROMO') THEN 1 END), count(CASE WHEN p_type IN ('STANDARD', 'LARGE', 'MEDIUM', 'PROMO') THEN 1 END) FROM {part}""")
def coverage_lift(spark, sf):
    rows = T.products(spark, sf)
    before = rows.select(F.when(F.col("ip_rating") == 67, "IP 67").alias("enclosure"))
    return CV.coverage_lift(before, rows, [("ip_rating", "enclosure"), ("principle", None)]).select("field", "baseline_field", "before", "after", "lift")


@query("SELECT coalesce(output_type, 'unclassified') AS value, count(*) AS rows FROM {catalog} GROUP BY 1")
def count_by(spark, sf):
    return CV.count_by(T.products(spark, sf), "output_type")


@query("""WITH r AS (SELECT md5(text) AS key, doc_id, source, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents),
a AS (SELECT key, count(*) AS occurrences, count(DISTINCT source) - 1 AS other_sources FROM r GROUP BY key) SELECT r.doc_id, r.source, occurrences, other_sources FROM r JOIN a ON a.key = r.key WHERE rn = 1""")
def dedup_first(spark, sf):
    """Exact copies of a text: the first one, how many there are, and in how many other sources."""
    rows = T.read(spark, sf, "documents").select(F.md5("text").alias("key"), "doc_id", "source")
    out = CV.dedup_first(rows, "key", ["doc_id"], "source")
    return out.select("doc_id", "source", "occurrences", F.size("also_on_pages").alias("other_sources"))


@query("""WITH e AS (SELECT DISTINCT cast(o_orderkey AS varchar) AS k FROM orders), x AS (SELECT cast(l_orderkey AS varchar) AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT sum(n) AS rows_extracted, count(x.k) AS distinct_ids, count(e.k) AS expected_ids, sum(CASE WHEN x.k IS NULL THEN 1 ELSE 0 END) AS missing, sum(CASE WHEN e.k IS NULL THEN 1 ELSE 0 END) AS unexpected,
  sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS repeated, sum(CASE WHEN x.k IS NOT NULL AND length(x.k) < 3 THEN 1 ELSE 0 END) AS bad_ids,
  round(100.0::double * (count(e.k) - sum(CASE WHEN x.k IS NULL THEN 1 ELSE 0 END)) / count(e.k), 1) AS coverage_pct FROM e FULL JOIN x ON e.k = x.k""")
def id_coverage(spark, sf):
    orders = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    lines = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    return CV.id_coverage(orders, lines, "id", "^\\d{3,}$")


READINGS_SQL = """readings AS (SELECT l_suppkey AS run_id, l_partkey AS part_id, l_returnflag AS field, CASE WHEN l_quantity <= 2 THEN 'low' WHEN l_quantity <= 5 THEN 'medium' ELSE 'high' END AS confidence, l_discount >= 0.1 AS disputed,
  l_orderkey * 10 + l_linenumber AS o1, l_extendedprice AS o2 FROM {lineitem})"""


def _readings(spark, sf):
    return T.run(spark, sf, "WITH " + READINGS_SQL + " SELECT * FROM readings").withColumn("ord", F.struct("o1", "o2"))


@query("WITH " + READINGS_SQL + " SELECT part_id, field, count(DISTINCT run_id) AS runs, min(run_id) AS first_run FROM readings WHERE disputed GROUP BY part_id, field")
def disputes(spark, sf):
    return CV.disputes(_readings(spark, sf)).select("part_id", "field", F.size("runs").alias("runs"), F.element_at("runs", 1).alias("first_run"))


@query("WITH " + READINGS_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY part_id, field ORDER BY o1, o2) AS rn FROM readings WHERE confidence <> 'high')
SELECT part_id, field, confidence, disputed, CASE confidence WHEN 'low' THEN 0 ELSE 1 END AS severity FROM r WHERE rn = 1""")
def flagged(spark, sf):
    return CV.flagged(_readings(spark, sf))


@query("SELECT source AS brand, count(DISTINCT lang) AS documents, count(*) AS rows, round(100.0::double * count(*) / (SELECT count(*) FROM documents), 1) AS share_pct, round(count(*)::double / count(DISTINCT lang), 1) AS rows_per_document FROM documents GROUP BY source")
def brand_coverage(spark, sf):
    return CV.brand_coverage(T.read(spark, sf, "documents"), "source", "lang")


@query("SELECT l_suppkey AS doc_id, l_linenumber AS page, count(DISTINCT l_partkey) AS lines, count(*) AS uses FROM lineitem GROUP BY 1, 2")
def cited_lines(spark, sf):
    cited = T.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("snippet"))
    return CV.cited_lines(cited)


@query("""WITH c AS (SELECT l_orderkey AS report_id, l_suppkey AS source_page, l_linenumber AS pdf_page, l_partkey AS order_number FROM lineitem)
SELECT report_id, count(*) AS citations FROM (SELECT DISTINCT * FROM c) x GROUP BY report_id""")
def distinct_citations(spark, sf):
    cited = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_suppkey").alias("source_page"), F.col("l_linenumber").alias("pdf_page"), F.col("l_partkey").alias("order_number"), F.col("l_quantity").alias("ord"))
    return A.distinct_citations(cited).groupBy("report_id").agg(F.count("*").alias("citations"))


@query("""WITH c AS (SELECT conv_id, turn, text, role, substr(text, 1, 20) AS quote FROM conversations), q AS (SELECT c.conv_id, c.turn, n.text AS source, c.quote, c.role FROM c JOIN c n ON n.conv_id = c.conv_id AND n.turn = c.turn),
f AS (SELECT *, trim(regexp_replace(lower(quote), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS fq, trim(regexp_replace(lower(source), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS ft FROM q)
SELECT conv_id, turn, role = 'user' AND fq <> '' AND contains(ft, fq) AS stated FROM f""")
def quote_check(spark, sf):
    """The head of every turn quoted against the turn; only the user's turns claim to be stated."""
    turns = T.read(spark, sf, "conversations").withColumn("source_id", F.struct("conv_id", "turn"))
    claims = turns.select("source_id", F.lit("text").alias("field"), F.when(F.col("role") == "user", "stated").otherwise("assumed").alias("status"), F.substring("text", 1, 20).alias("quote"))
    out = A.quote_check(claims, turns.select("source_id", "text"))
    return out.select("source_id.conv_id", "source_id.turn", "stated")


VIEW = ["Fotocelulas (Photoelectric sensors)", "Sensores de proximidad (Proximity sensors)", "Sensores de distancia (Distance sensors)"]


@query("""SELECT order_number, range_max_mm, output, connection, ip_rating, principle FROM (SELECT order_number, category, row_type, NULL::double AS range_max_mm,
  CASE WHEN pdf_page <= 10 THEN 'PNP' WHEN pdf_page <= 20 THEN 'NPN' WHEN pdf_page <= 26 THEN 'PNP/NPN' WHEN pdf_page <= 32 THEN 'PNP' END AS output,
  CASE WHEN length(product_name) <= 8 THEN concat('M8 ', CASE WHEN pdf_page > 25 THEN 4 ELSE 5 END, '-pin') WHEN length(product_name) <= 9 THEN 'M12 4-pin' WHEN length(product_name) <= 10 THEN 'Cable' WHEN length(product_name) <= 11 THEN 'M12 4-pin' END AS connection,
  CASE enclosure_rating WHEN 'ip 65' THEN 65 WHEN 'IP67 (IP 65)' THEN 67 WHEN 'IP 67, IP 69K' THEN 67 END AS ip_rating, CASE WHEN section = 'LARGE' THEN 'through-beam' END AS principle FROM {printed}) x
WHERE row_type = 'product' AND (category LIKE 'Foto%' OR category LIKE '%proximidad%' OR category LIKE '%distancia%')""")
def solver_view(spark, sf):
    from partlens.sources.schemas import PRODUCT, complete

    out = N.solver_view(complete(T.derive(spark, sf, "printed"), PRODUCT), VIEW)
    return out.select("order_number", "range_max_mm", "output", "connection", "ip_rating", "principle")


@query("""SELECT order_number, product_name, family FROM {catalog} WHERE row_type = 'product' AND contains(lower(concat_ws(' ', order_number, type_code, family, product_name, category)), 'bolt')""")
def faceted_filter(spark, sf):
    rows = T.products(spark, sf).withColumns({"name": F.col("product_name"), "subfamily": F.lit(None).cast("string")})
    return CV.faceted_filter(rows, kind="product", text=" Bolt ").select("order_number", "product_name", "family")


@query("SELECT category, count(DISTINCT order_number) AS ids, sum(CASE WHEN sensing_range_max_mm >= 1000 THEN 1 ELSE 0 END) AS far, sum(CASE WHEN section = 'LARGE' AND output_type = 'PNP' THEN 1 ELSE 0 END) AS pnp FROM {catalog} GROUP BY category")
def analyst_counts(spark, sf):
    """The dataset's own analyst questions: ids per category, long ranges, one section with one output."""
    return T.products(spark, sf).groupBy("category").agg(
        F.count_distinct("order_number").alias("ids"), F.count_if(F.col("sensing_range_max_mm") >= 1000).alias("far"),
        F.count_if((F.col("section") == "LARGE") & (F.col("output_type") == "PNP")).alias("pnp"),
    )


@query("""SELECT order_number, concat_ws('; ', CASE WHEN sensing_range_max_mm IS NOT NULL THEN concat('Range=', sensing_range_max_mm::bigint, ' mm') END, CASE WHEN connector IS NOT NULL THEN concat('Plug=', connector) END) AS specs,
  CASE WHEN sensing_range_max_mm IS NOT NULL THEN concat('≤ ', sensing_range_max_mm::bigint, ' mm') ELSE connector END AS headline FROM {catalog}""")
def spec_list(spark, sf):
    rows = T.full_products(spark, sf).join(T.products(spark, sf).select("order_number", "connector"), "order_number").withColumn("connection", F.col("connector"))
    out = CV.spec_list(rows, [("sensing_range_max_mm", "Range", "mm"), ("connection", "Plug", None)])
    return out.select("order_number", F.array_join(F.transform("specs", lambda s: F.concat(s["label"], F.lit("="), s["value"])), "; ").alias("specs"), "headline")


@query("""SELECT 'range_max_mm' AS field, 'medium' AS confidence, count(*) AS rows FROM {catalog} WHERE sensing_range_max_mm IS NOT NULL AND flags LIKE '%sensing%' HAVING count(*) > 0
UNION ALL SELECT 'range_max_mm', 'high', count(*) FROM {catalog} WHERE sensing_range_max_mm IS NOT NULL AND coalesce(flags, '') NOT LIKE '%sensing%'
UNION ALL SELECT 'output', 'high', count(*) FROM {catalog} WHERE output_type IS NOT NULL""")
def part_record(spark, sf):
    rows = T.products(spark, sf).select("order_number", F.col("sensing_range_max_mm").alias("range_max_mm"), F.col("output_type").alias("output"),
                                        F.when(F.contains("flags", F.lit("sensing")), F.array(F.lit("range_max_mm"))).alias("prose"))
    out = CV.part_record(rows, [("range_max_mm", "Sensing range", "mm"), ("output", "Output type", "-")])
    return out.groupBy("field", "confidence").agg(F.count("*").alias("rows"))


@query("""WITH d AS (SELECT DISTINCT concat('family:', section, ':', coalesce(family, '(no family)')) AS doc FROM {catalog})
SELECT (SELECT count(*) FROM {catalog}) + (SELECT count(*) FROM d) AS chunk_count, (SELECT count(*) FROM d) AS family_card_count, 0 AS embedded_count, (SELECT count(*) FROM {catalog}) AS product_count, (SELECT count(*) FROM d) AS document_count""")
def index_provenance(spark, sf):
    out = provenance(index_tables(T.full_products(spark, sf)), "derived", "now")
    return out.select("chunk_count", "family_card_count", "embedded_count", "product_count", "document_count")


@query("WITH " + READINGS_SQL + """, r AS (SELECT DISTINCT part_id, field, run_id FROM readings), p AS (SELECT *, (row_number() OVER (PARTITION BY part_id, field ORDER BY run_id) - 1) // 4 AS page, count(*) OVER (PARTITION BY part_id, field) AS n FROM r)
SELECT part_id, field, page, max(n) AS n, string_agg(run_id, ',' ORDER BY run_id) AS runs FROM p GROUP BY part_id, field, page""")
def reading_runs(spark, sf):
    """All runs that read a field of a part, in pages of four."""
    out = PG.paged_sets(_readings(spark, sf), ["part_id", "field"], "run_id", 4)
    return out.select("part_id", "field", "page", "n", F.array_join("entries", ",").alias("runs"))


@query("""WITH d AS (SELECT DISTINCT lang, source, md5(text) AS key FROM documents), p AS (SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY key) - 1) // 50 AS page, count(*) OVER (PARTITION BY lang, source) AS n FROM d)
SELECT lang, source, page, max(n) AS n, count(*) AS entries, min(key) AS first, max(key) AS last FROM p GROUP BY lang, source, page""")
def source_texts(spark, sf):
    """The different texts of every language and source, in pages of fifty: a few keys hold all rows."""
    rows = T.read(spark, sf, "documents").select("lang", "source", F.md5("text").alias("key"))
    out = PG.paged_sets(rows, ["lang", "source"], "key", 50)
    return out.select("lang", "source", "page", "n", F.size("entries").alias("entries"), F.get("entries", F.lit(0)).alias("first"), F.element_at("entries", -1).alias("last"))


# --- traces --------------------------------------------------------------------

TRACE_SQL = """SELECT user_id AS run_id, CASE event_type WHEN 'click' THEN 'tool.call' WHEN 'error' THEN 'challenger.attack' ELSE event_type END AS type, event_id * 1.0 AS at_ms, event_type AS label,
  CASE WHEN value > 5 THEN 'upheld' ELSE 'unverifiable' END AS verdict FROM events"""


def _as_trace(e):
    """The events table, batch or stream, in the shape of a trace."""
    kind = F.when(F.col("event_type") == "click", "tool.call").when(F.col("event_type") == "error", "challenger.attack").otherwise(F.col("event_type"))
    verdict = F.when(F.col("value") > 5, "upheld").otherwise("unverifiable")
    payload = F.concat(F.lit('{"challenge": {"verdict": "'), verdict, F.lit('"}}'))
    return e.select(F.col("user_id").cast("string").alias("run_id"), kind.alias("type"), F.col("event_id").cast("double").alias("at"), F.col("event_type").alias("label"), payload.alias("payload"))


TRACE_SUMMARY_SQL = f"""SELECT run_id::varchar AS run_id, count(*) AS events, max(at_ms)::double - min(at_ms)::double AS ms, sum(CASE WHEN type = 'tool.call' THEN 1 ELSE 0 END) AS tool_calls, sum(CASE WHEN type = 'challenger.attack' THEN 1 ELSE 0 END) AS attacks,
  sum(CASE WHEN type = 'challenger.attack' AND verdict = 'upheld' THEN 1 ELSE 0 END) AS upheld FROM ({TRACE_SQL}) x GROUP BY run_id"""


@query(TRACE_SUMMARY_SQL)
def trace_summary(spark, sf):
    return CV.trace_summary(_as_trace(T.read(spark, sf, "events")))


@query(TRACE_SUMMARY_SQL)
def trace_summary_stream(spark, sf):
    """The same summary from a stream over the events table."""
    folder = shared_folder(spark)
    schema = T.read(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    events = _as_trace(stream)
    write_summary(summarize_stream(events), f"{folder}/out", f"{folder}/state").awaitTermination()
    return latest_summary(spark.read.parquet(f"{folder}/out"))


# --- bills of materials ----------------------------------------------------------

RECORDS_SQL = "SELECT p_partkey AS ord, 'Acme' AS vendor, concat('BR', p_brand) AS series, concat('MX-', cast(p_partkey AS string)) AS model, p_size AS richness FROM {part}"


def _bom_files(spark, sf):
    """One file per order: a heading in one of three styles, then a line per item."""
    lines = T.read(spark, sf, "lineitem").join(T.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    sep = F.when(F.col("o_orderstatus") == "O", ";").otherwise(",")
    part = F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat(F.lit("MX-"), F.col("l_partkey").cast("string")))
    row = F.concat(part, sep, F.col("l_quantity").cast("int").cast("string"), sep, F.lit('"Acme"'))
    head = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("Part No"), sep, F.lit("Qty"), sep, F.lit("Vendor\n")))
    # An order has at most a handful of lines.
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", row.alias("row"))
    grouped = lines.groupBy("l_orderkey", "o_orderstatus").agg(F.first(head).alias("head"), F.array_sort(F.collect_list(entry)).alias("rows"))
    return grouped.select(F.col("l_orderkey").cast("string").alias("file"), "o_orderstatus", F.concat("head", F.array_join(F.transform("rows", lambda r: r["row"]), "\n")).alias("value"))


def _bom_rows(spark, sf):
    return B.bom_rows(split_boms(_bom_files(spark, sf)), ["acme"])


BOM_SQL = """b AS (SELECT l_orderkey, o_orderstatus, l_quantity, CASE WHEN l_returnflag <> 'R' THEN l_partkey END AS part, count(*) FILTER (WHERE l_returnflag <> 'R') OVER (PARTITION BY l_orderkey) AS stated FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


BOM_AUDIT_SQL = "WITH " + BOM_SQL + """ SELECT o_orderstatus, count(*) AS lines, sum(CASE WHEN part IS NULL THEN 1 ELSE 0 END) AS unprocessable, sum(CASE WHEN part IS NOT NULL THEN 1 ELSE 0 END) AS resolved,
  sum(l_quantity) AS quantity, count(*) AS with_vendor FROM b GROUP BY o_orderstatus"""


def _audit_totals(spark, sf, audited):
    status = T.read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("file"), "o_orderstatus")
    return audited.join(status, "file").groupBy("o_orderstatus").agg(
        F.count("*").alias("lines"), F.count_if(F.col("status") == "unprocessable").alias("unprocessable"), F.count_if(F.col("status") == "resolved").alias("resolved"),
        F.sum("quantity").alias("quantity"), F.count("vendor").alias("with_vendor"),
    )


@query(BOM_AUDIT_SQL)
def bom_audit(spark, sf):
    """Every line of every file, with a heading or without, split, read and resolved."""
    return _audit_totals(spark, sf, B.bom_audit(_bom_rows(spark, sf), T.run(spark, sf, RECORDS_SQL)))


@query(BOM_AUDIT_SQL)
def bom_audit_stream(spark, sf):
    """The same audit from a stream of whole files, a folder for each batch."""
    folder = shared_folder(spark)
    _bom_files(spark, sf).select("file", "value").write.parquet(f"{folder}/files")
    files = spark.readStream.schema("file STRING, value STRING").option("maxFilesPerTrigger", 64).parquet(f"{folder}/files")
    audit_files(files, T.run(spark, sf, RECORDS_SQL), ["acme"], f"{folder}/out", f"{folder}/state").awaitTermination()
    return _audit_totals(spark, sf, audited_lines(spark, f"{folder}/out"))


@query("""WITH s AS (SELECT l_orderkey, max(CASE WHEN o_orderstatus <> 'P' OR l_returnflag <> 'R' THEN 1 ELSE 0 END) AS told FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey)
SELECT role, col, count(*) AS files FROM (SELECT 'part_number' AS role, 0 AS col FROM s WHERE told > 0 UNION ALL SELECT 'vendor', 2 FROM s UNION ALL SELECT 'quantity', 1 FROM s) x GROUP BY role, col""")
def bom_roles(spark, sf):
    """Roles told by the heading, or from the cells alone in files without one."""
    roles = B.column_roles(split_boms(_bom_files(spark, sf)), ["acme"])
    return roles.groupBy("role", "col").agg(F.count("*").alias("files"))


# --- images ------------------------------------------------------------------------

LAYOUT_SQL = """img AS (SELECT o_orderkey AS page, concat('i', cast(o_custkey AS string)) AS image_id, cast(floor(o_totalprice / 600) AS int) AS top, 10 AS left_at,
  CASE WHEN o_orderstatus = 'F' THEN 700 WHEN o_orderstatus = 'P' THEN 90 ELSE 60 END AS w, CASE WHEN o_orderpriority LIKE '1%' THEN 200 ELSE 40 END AS h, cast(o_custkey AS string) AS sha, 900 AS page_width FROM {orders}),
rws AS (SELECT l_orderkey AS page, cast(l_partkey + 1000000 AS string) AS order_number, cast(l_quantity * 16 AS int) AS top FROM {lineitem})"""


def _layout(spark, sf):
    images = T.run(spark, sf, "WITH " + LAYOUT_SQL + " SELECT page, image_id, top, left_at, w, h, sha, page_width FROM img")
    rows = T.run(spark, sf, "WITH " + LAYOUT_SQL + " SELECT * FROM rws")
    return images, rows


MATCH_SQL = "WITH " + LAYOUT_SQL + """, use AS (SELECT *, top + h / 2.0::double AS centre, w * h AS area FROM img WHERE w < page_width * 0.7::double AND w * h >= 500), th AS (SELECT * FROM use WHERE h <= 100),
pr AS (SELECT page, top + 5.5::double AS pos, min(order_number) AS order_number FROM rws GROUP BY page, top),
near AS (SELECT t.page, t.image_id, t.sha, t.area, t.centre, p.order_number, p.pos, row_number() OVER (PARTITION BY t.page, t.image_id ORDER BY abs(t.centre - p.pos), p.pos) AS rn FROM th t JOIN pr p ON p.page = t.page),
matched AS (SELECT * FROM near WHERE rn = 1 AND abs(centre - pos) <= 45)"""


@query(MATCH_SQL + " SELECT page, order_number, image_id, centre - pos AS \"offset\" FROM matched")
def row_image_match(spark, sf):
    """Thumbnails to rows; a page of this layout has one image, so nearest is mutual."""
    images, rows = _layout(spark, sf)
    return IM.row_image_match(images, rows).select("page", "order_number", "image_id", "offset")


# Pages of many images: the orders of 32 keys, their lines as rows, the images in the order of their keys.
CROWDED_SQL = """img AS (SELECT cast(floor(o_orderkey / 32) AS int) AS page, cast(o_orderkey AS string) AS image_id, o_orderkey AS ord, cast(floor(o_totalprice / 600) AS int) * 2 AS top, 10 AS left_at,
  60 AS w, CASE WHEN o_orderpriority LIKE '1%' THEN 200 ELSE 40 END AS h, cast(o_custkey AS string) AS sha, 900 AS page_width FROM {orders}),
rws AS (SELECT cast(floor(l_orderkey / 32) AS int) AS page, cast(l_partkey AS string) AS order_number, cast(l_quantity * 16 AS int) AS top, min(l_orderkey * 8 + l_linenumber) AS ord FROM {lineitem} GROUP BY 1, 2, 3)"""


@query("WITH RECURSIVE " + CROWDED_SQL + """, th AS (SELECT *, top + h / 2.0::double AS centre, row_number() OVER (PARTITION BY page ORDER BY ord, image_id) AS seq FROM img WHERE w < page_width * 0.7::double AND w * h >= 500 AND h <= 100),
pr AS MATERIALIZED (SELECT r.page, r.order_number, r.ord, r.top + 5.5::double AS pos, min(abs(t.centre - (r.top + 5.5::double))) AS nearest FROM rws r JOIN th t ON t.page = r.page GROUP BY r.page, r.order_number, r.ord, r.top),
fold AS (SELECT DISTINCT page, 0::bigint AS seq, []::varchar[] AS taken, NULL::varchar AS order_number, NULL::varchar AS image_id, NULL::double AS "offset" FROM pr
  UNION ALL SELECT page, seq, CASE WHEN claims THEN list_append(taken, number) ELSE taken END, CASE WHEN claims THEN number END, CASE WHEN claims THEN image END, CASE WHEN claims THEN away END
  FROM (SELECT f.page, t.seq, f.taken, p.order_number AS number, t.image_id AS image, t.centre - p.pos AS away, abs(t.centre - p.pos) <= 45 AND p.nearest >= abs(t.centre - p.pos) AS claims,
      row_number() OVER (PARTITION BY f.page ORDER BY abs(t.centre - p.pos), p.ord, p.order_number) AS rn
    FROM fold f JOIN th t ON t.page = f.page AND t.seq = f.seq + 1 JOIN pr p ON p.page = f.page AND NOT list_contains(f.taken, p.order_number)) x WHERE rn = 1)
SELECT page, order_number, image_id, "offset" FROM fold WHERE order_number IS NOT NULL""")
def image_claims(spark, sf):
    """Thumbnails of crowded pages claim their rows one after another."""
    images = T.run(spark, sf, "WITH " + CROWDED_SQL + " SELECT * FROM img")
    rows = T.run(spark, sf, "WITH " + CROWDED_SQL + " SELECT * FROM rws")
    return IM.row_image_match(images, rows).select("page", "order_number", "image_id", "offset")


ASSIGN_SQL = MATCH_SQL + """, heroes AS (SELECT page, image_id, sha, area FROM use WHERE h >= 71 AND (page, image_id) NOT IN (SELECT page, image_id FROM matched)),
parts AS (SELECT order_number, concat(category, '|', coalesce(family, 'null')) AS fam FROM {catalog} WHERE row_type = 'product'),
onp AS (SELECT DISTINCT p.order_number, p.fam, h.page, h.image_id, h.sha, h.area FROM rws r JOIN parts p ON p.order_number = r.order_number JOIN heroes h ON h.page = r.page),
famh AS (SELECT * FROM (SELECT fam, page, image_id, sha, area, row_number() OVER (PARTITION BY fam ORDER BY page) AS rn FROM onp) x WHERE rn = 1),
prop AS (SELECT order_number, page, image_id, sha, area, 1 AS m FROM matched UNION ALL SELECT order_number, page, image_id, sha, area, 2 FROM onp
  UNION ALL SELECT p.order_number, f.page, f.image_id, f.sha, f.area, 3 FROM parts p JOIN famh f ON f.fam = p.fam),
best AS (SELECT *, row_number() OVER (PARTITION BY order_number ORDER BY m, area DESC, page, image_id) AS rn FROM prop)"""


@query(ASSIGN_SQL + " SELECT order_number, page, image_id, CASE m WHEN 1 THEN 'row_aligned' WHEN 2 THEN 'page_hero' ELSE 'family_hero' END AS method FROM best WHERE rn = 1")
def best_assignment(spark, sf):
    images, rows = _layout(spark, sf)
    return IM.best_assignment(IM.propose(images, rows, T.full_products(spark, sf))).select("order_number", "page", "image_id", "method")


@query(ASSIGN_SQL + """, j AS (SELECT c.order_number, c.row_type, c.category, b.sha, CASE b.m WHEN 1 THEN 'row_aligned' WHEN 2 THEN 'page_hero' WHEN 3 THEN 'family_hero' ELSE 'none' END AS method FROM {catalog} c LEFT JOIN best b ON b.order_number = c.order_number AND b.rn = 1)
SELECT method, count(*) AS rows, count(DISTINCT sha) AS images FROM j GROUP BY method""")
def image_summary(spark, sf):
    images, rows = _layout(spark, sf)
    products = T.full_products(spark, sf)
    return IM.image_summary(products, IM.best_assignment(IM.propose(images, rows, products)))


@query(ASSIGN_SQL + """, j AS (SELECT c.*, b.sha, b.m FROM {catalog} c LEFT JOIN best b ON b.order_number = c.order_number AND b.rn = 1)
SELECT count(*) AS total, sum(CASE WHEN row_type = 'product' THEN 1 ELSE 0 END) AS products, sum(CASE WHEN row_type = 'accessory' THEN 1 ELSE 0 END) AS accessories, count(sha) AS with_image,
  round(100.0::double * count(sha) / count(*), 1) AS coverage_pct, sum(CASE WHEN m = 3 THEN 1 ELSE 0 END) AS family_photos, count(DISTINCT category) AS categories FROM j""")
def view_summary(spark, sf):
    images, rows = _layout(spark, sf)
    products = T.full_products(spark, sf)
    assigned = IM.best_assignment(IM.propose(images, rows, products))
    pages = products.select("pdf_page", "source_page", "ord")
    return CV.view_summary(IM.manifest(products, assigned, pages))
