"""Tables written as the files that readers take, read back strictly or leniently, and held against the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from partlens.functions.nulls import flatten_map, null_honest, rename_fields
from partlens.operators import chunks as C
from partlens.operators import coverage as CV
from partlens.operators import match as M
from partlens.operators import solve as S
from partlens.plans import corpus_queries as CQ
from partlens.plans import tables as T
from partlens.plans.registry import query
from partlens.plans.solve_queries import CANDIDATES_SQL, PAIRS_SQL, SOLVED_COLUMNS
from partlens.session import shared_folder
from partlens.sources import catalog, index_store
from partlens.sources.bom_files import read_boms
from partlens.sources.trace import read_trace, write_trace

# Files at least, and the rows that a task sorts into one of them.
FILES, FILE_ROWS = 6, 200_000


def _lines(rows, order: list[str], path: str, value="value", **options) -> str:
    """Rows as text files, more of them for more rows; the files' names follow the order.

    ``value`` is made of rows that are in their place, so only the columns it reads and
    those of the order are shuffled, not its text.  ``options`` are the writer's.
    """
    files = max(FILES, -(-rows.count() // FILE_ROWS))
    placed = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    placed.select(value).write.options(**options).text(path)
    return path


def _json_files(spark, rows, fields: dict, *order: str, **options) -> str:
    entry = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return _lines(rows, [*order], f"{shared_folder(spark)}/files", entry.alias("value"), **options)


def _catalog_fields():
    c = F.col
    return {
        "order_number": c("order_number"), "row_type": c("row_type"), "category": c("category"), "section": F.concat(F.lit(" "), c("section")), "source_page": c("source_page"),
        # Numbers and texts as sources write them: a number as text, blanks for nothing, not a number.
        "pdf_page": c("pdf_page").cast("string"), "type_code": F.concat(F.lit("  "), c("type_code"), F.lit("\t")), "family": F.coalesce("family", F.lit(" ")),
        "product_url": F.coalesce("product_url", F.lit("")), "sensing_range_max_mm": F.coalesce(c("sensing_range_max_mm").cast("string"), F.lit("NaN")),
        "also_on_pages": F.array(c("source_page"), F.lit(""), F.concat("source_page", F.lit("b"))),
        "other_specs": F.create_map(F.lit("size"), c("pdf_page").cast("string"), F.lit("none"), F.lit(""), F.lit("nested"), F.to_json(F.create_map(F.lit("kind"), c("row_type"), F.lit("blank"), F.lit(" ")))),
        "provenance": F.create_map(F.lit("product_name"), c("product_name")),
        "low_confidence": F.split(F.coalesce("flags", F.lit("")), "[|]"),
    }


READ_SQL = "SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, order_number, section, family, type_code, product_url, sensing_range_max_mm, pdf_page"


@query(READ_SQL + """, 3 AS occurrences, concat('nested.kind=', row_type, ';size=', pdf_page) AS specs, coalesce(replace(flags, '|', ','), '') AS low_confidence FROM {catalog}""")
def read_catalog(spark, sf):
    """The catalog out of JSON lines in several files, every row in its place."""
    path = _json_files(spark, T.products(spark, sf), _catalog_fields(), "ord")
    rows = catalog.read_catalog_jsonl(spark, path)
    specs = F.array_join(F.array_sort(F.transform(F.map_entries("other_specs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return rows.select("ord", "order_number", "section", "family", "type_code", "product_url", "sensing_range_max_mm", "pdf_page", "occurrences", specs.alias("specs"),
                       F.coalesce(F.array_join("low_confidence", ","), F.lit("")).alias("low_confidence"))


@query("SELECT order_number, type_code AS code, sensing_range_max_mm AS reach, 'name' AS provenance_of, coalesce(replace(replace(flags, '|', ','), 'sensing_range_max_mm', 'reach'), '') AS low_confidence FROM {catalog}")
def read_renamed(spark, sf):
    """The same files with fields renamed, in the columns, in the keys of the provenance and in the flags."""
    path = _json_files(spark, T.products(spark, sf), _catalog_fields(), "ord")
    rows = catalog.read_catalog_jsonl(spark, path, {"type_code": "code", "sensing_range_max_mm": "reach", "product_name": "name"})
    return rows.select("order_number", "code", "reach", F.array_join(F.map_keys("provenance"), ",").alias("provenance_of"), F.coalesce(F.array_join("low_confidence", ","), F.lit("")).alias("low_confidence"))


@query("""SELECT CASE WHEN l_partkey % 3 = 0 THEN 'order_number must be 7 digits, got 12' WHEN l_partkey % 5 = 0 THEN 'row_type must be one of product/accessory for 1234567' WHEN l_partkey % 7 = 0 THEN 'missing section for 1234567' ELSE 'not valid JSON' END AS problem, count(*) AS rows
FROM {lineitem} WHERE l_partkey % 3 = 0 OR l_partkey % 5 = 0 OR l_partkey % 7 = 0 OR l_partkey % 11 = 0 GROUP BY 1""")
def catalog_rejects(spark, sf):
    """What the strict reader would refuse, line by line."""
    k = F.col("l_partkey")
    lines = T.read(spark, sf, "lineitem").select("l_partkey", "l_orderkey")
    good = {"order_number": F.when(k % 3 == 0, "12").otherwise("1234567"), "row_type": F.when(k % 5 == 0, "part").otherwise("product"), "category": F.lit("c"),
            "section": F.when(k % 7 == 0, "").otherwise("s"), "source_page": F.lit("1"), "pdf_page": F.lit(1)}
    entry = F.to_json(F.struct(*[c.alias(n) for n, c in good.items()]))
    broken = (k % 11 == 0) & (k % 3 != 0) & (k % 5 != 0) & (k % 7 != 0)
    path = _lines(lines.select(F.when(broken, "{broken").otherwise(entry).alias("value"), "l_orderkey"), ["l_orderkey"], f"{shared_folder(spark)}/files")
    return catalog.catalog_rejects(spark, path).groupBy("problem").agg(F.count("*").alias("rows"))


@query("SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, order_number, row_type, section, pdf_page, source_page FROM {catalog}")
def read_all_rows(spark, sf):
    names = ["order_number", "row_type", "section", "pdf_page", "source_page"]
    path = _json_files(spark, T.products(spark, sf), {n: F.col(n) for n in names}, "ord")
    return catalog.read_all_rows(spark, path).select("ord", *names)


@query("""SELECT section, coalesce(family, '(no family), "other"') AS family, count(*) FILTER (WHERE row_type = 'product') AS product_variants, count(*) FILTER (WHERE row_type = 'accessory') AS accessory_rows, count(DISTINCT source_page) AS n_pages,
  string_agg(DISTINCT source_page, ',' ORDER BY source_page) AS pages, min(product_url) AS product_url FROM {catalog} GROUP BY section, family""")
def read_families(spark, sf):
    """The family rollup out of quoted, semicolon-listed CSV files, each with its heading."""
    rolled = T.products(spark, sf).groupBy("section", "family").agg(
        F.count_if(F.col("row_type") == "product").alias("product_variants"), F.count_if(F.col("row_type") == "accessory").alias("accessory_rows"),
        F.count_distinct("source_page").alias("n_pages"), F.array_join(F.array_sort(F.collect_set("source_page")), " ; ").alias("pages"), F.min("product_url").alias("product_url"),
    )
    rows = rolled.withColumns({"family": F.coalesce("family", F.lit('(no family), "other"')), "category": F.lit("line\nbreak"), "product_variants": F.col("product_variants").cast("double")})
    path = f"{shared_folder(spark)}/families"
    rows.repartition(3, "section", "family").write.csv(path, header=True, escape='"', quoteAll=True)
    found = catalog.read_families_csv(spark, path)
    return found.select("section", "family", "product_variants", "accessory_rows", "n_pages", F.array_join(F.array_sort("pages"), ",").alias("pages"), "product_url")


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]
COMPETITOR_SQL = """rows AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) - 1 AS ord, l_partkey, l_linenumber, l_returnflag, l_quantity FROM {lineitem})"""


def _competitors(spark, sf):
    """Lines as records of competitors: some without a vendor, some with entries that say nothing."""
    flag, n = F.col("l_returnflag"), F.col("l_linenumber")
    mode = lambda name, reach: F.struct(name.alias("mode"), reach.alias("range_max_mm"))
    fields = {
        "vendor": F.when(F.col("l_partkey") % 7 == 0, " ").otherwise("Acme"), "series": F.concat(F.lit("S"), n.cast("string")), "model": F.concat(F.lit("M"), F.col("l_partkey").cast("string")),
        "product_category": F.lit("sensor"), "source_page": n, "sensing_modes": F.array(mode(flag, F.col("l_quantity")), mode(F.lit(" "), F.lit(1.0))),
        "outputs": F.when(n > 3, F.array(F.struct(F.lit("PNP").alias("type"), F.lit("x").alias("detail")))), "housing_material": F.when(flag == "N", "").otherwise("metal"),
        "features": F.when(n == 1, F.array(F.lit("a"), F.lit("b"))),
    }
    # As text the records are many times the table; a compressed file is read in one piece, of some FILE_ROWS records.
    return catalog.read_competitors(spark, _json_files(spark, T.read(spark, sf, "lineitem"), fields, *LINE_ORDER, compression="gzip"))


@query("WITH " + COMPETITOR_SQL + """ SELECT ord, concat('M', l_partkey) AS model, l_returnflag AS modes, CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END AS outputs, CASE WHEN l_linenumber = 1 THEN 2 ELSE 0 END AS features,
  2 + CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END + CASE WHEN l_linenumber = 1 THEN 2 ELSE 0 END + CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS richness FROM rows WHERE l_partkey % 7 <> 0""")
def read_competitors(spark, sf):
    """Nested records in their place, with how much each of them states."""
    rows = _competitors(spark, sf)
    return rows.select("ord", "model", F.array_join(F.transform("sensing_modes", lambda m: m["mode"]), ",").alias("modes"), F.size("outputs").alias("outputs"), F.size("features").alias("features"), M.richness().alias("richness"))


@query("""SELECT s_name AS from_model, CASE WHEN s_nationkey < 20 THEN s_name END AS to_type_code, s_nationkey % 2 = 0 AS adequate, CASE s_nationkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS confidence, s_acctbal AS from_range_max_mm
FROM {supplier} WHERE s_nationkey <> 3""")
def read_crossref(spark, sf):
    """Judged equivalences out of CSV files: odd words of confidence, blanks, rows without a mode."""
    n = F.col("s_nationkey")
    rows = T.read(spark, sf, "supplier").select(
        F.lit("line, one").alias("series"), F.col("s_name").alias("from_model"), F.when(n == 3, " ").otherwise("diffuse").alias("from_mode"), F.col("s_acctbal").alias("from_range_max_mm"),
        F.when(n < 20, F.col("s_name")).otherwise("").alias("to_type_code"), F.lit("").alias("to_order_number"), F.lit(" ").alias("to_family"),
        F.when(n % 2 == 0, "True").otherwise("maybe").alias("adequate"),
        F.when(n % 4 == 0, "HIGH").when(n % 4 == 1, "low").otherwise("certain").alias("confidence"), F.lit('said "so"\ntwice').alias("rationale"),
    )
    path = f"{shared_folder(spark)}/crossref"
    rows.write.csv(path, header=True, escape='"', quoteAll=True)
    found = catalog.read_crossref(spark, path, {"series": "from_series"})
    return found.filter("from_series = 'line, one' and rationale like 'said \"so\"%twice'").select("from_model", "to_type_code", "adequate", "confidence", "from_range_max_mm")


@query("SELECT vec_id, md5(array_to_string(list_transform(embedding, lambda x: round(x::double, 4)::decimal(12, 4)::varchar), ',')) AS vector FROM embeddings")
def vector_text(spark, sf):
    """Vectors as base64 text and back."""
    rows = T.read(spark, sf, "embeddings").select("vec_id", "embedding")
    path = f"{shared_folder(spark)}/vectors"
    index_store.encode_vectors(rows, "embedding").write.json(path)
    back = index_store.decode_vectors(spark.read.schema("vec_id BIGINT, embedding STRING").json(path), "embedding", 64)
    told = F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double"), 4).cast("decimal(12,4)").cast("string")), ",")
    return back.select("vec_id", F.md5(told).alias("vector"))


@query(CQ.TRACE_SUMMARY_SQL)
def trace_files(spark, sf):
    """The trace summary out of newline-delimited files."""
    path = f"{shared_folder(spark)}/trace"
    write_trace(CQ._as_trace(T.read(spark, sf, "events")), path)
    return CV.trace_summary(read_trace(spark, path))


@query("SELECT order_number, type_code, family FROM {catalog}")
def view_files(spark, sf):
    """The slim view as JSON lines."""
    path = f"{shared_folder(spark)}/view"
    catalog.write_catalog_view(T.products(spark, sf).select("order_number", "type_code", "family"), path)
    return spark.read.schema("order_number STRING, type_code STRING, family STRING").json(path)


@query("SELECT row_type, count(*) AS rows, count(DISTINCT solution_class) AS classes, false AS has_blob FROM {enriched} GROUP BY row_type")
def enriched_files(spark, sf):
    """The enriched table without its search text, read back as products and accessories."""
    path = f"{shared_folder(spark)}/enriched"
    catalog.write_pruned(T.derive(spark, sf, "enriched"), ["search_blob", "protocol_list"], path)
    products, accessories = catalog.read_enriched(spark, path)
    both = products.unionByName(accessories)
    return both.groupBy("row_type").agg(F.count("*").alias("rows"), F.count_distinct("solution_class").alias("classes"), F.lit("search_blob" in both.columns).alias("has_blob"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS place FROM {lineitem})
SELECT l_suppkey AS supplier, place - 1 AS record, 2 * place - 1 AS line, l_partkey::varchar AS part, concat('two', chr(10), 'lines; of ', l_orderkey) AS note FROM l""")
def read_bom_files(spark, sf):
    """A bill of materials per supplier, its notes broken over two lines, read in splits."""
    rows = T.read(spark, sf, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.concat("l_partkey", F.lit(';"two\nlines; of '), "l_orderkey", F.lit('"')).alias("value")
    )
    path = f"{shared_folder(spark)}/boms"
    # A file for each supplier, written by more tasks for more rows.
    tasks = max(8, -(-rows.count() // FILE_ROWS))
    rows.repartition(tasks, "l_suppkey").sortWithinPartitions("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").select("l_suppkey", "value").write.partitionBy("l_suppkey").text(path)
    found = read_boms(spark, f"{path}/*")
    supplier = F.regexp_extract("file", "l_suppkey=([0-9]+)", 1).cast("int")
    return found.select(supplier.alias("supplier"), "record", "line", F.get("cells", F.lit(0)).alias("part"), F.get("cells", F.lit(1)).alias("note"))


# --- small rules over the given tables ---------------------------------------------

EVENTS_AS_FIELDS = """SELECT event_id, nullif(trim(event_type), 'view') AS word, CASE WHEN value < 5 THEN NULL ELSE value END AS number,
  CASE WHEN value < 5 THEN 'a=1' ELSE concat('a=1;b.c=', event_type) END AS flat FROM events"""


@query(EVENTS_AS_FIELDS)
def null_honest_fields(spark, sf):
    """Blank texts, numbers that are none, and nested records of every event."""
    e = T.read(spark, sf, "events")
    word = F.when(F.trim("event_type") == "view", "  \t ").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" ")))
    number = F.when(F.col("value") < 5, "Infinity").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    nested = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.when(F.col("value") < 5, '{"c": " "}').otherwise(F.to_json(F.create_map(F.lit("c"), F.col("event_type")))), F.lit("d"), F.lit(""))
    flat = F.transform(F.map_entries(flatten_map(nested)), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return e.select("event_id", null_honest(word).alias("word"), null_honest(number, "double").alias("number"), F.array_join(F.array_sort(flat), ";").alias("flat"))


@query("SELECT event_id, event_type AS kind, concat('kind,', user_id % 3) AS keys, CASE WHEN user_id % 2 = 0 THEN 'kind' ELSE 'other' END AS entries FROM events")
def renamed_fields(spark, sf):
    e = T.read(spark, sf, "events").select(
        "event_id", "event_type", F.create_map(F.lit("event_type"), F.lit("x"), (F.col("user_id") % 3).cast("string"), F.lit("y")).alias("m"),
        F.array(F.when(F.col("user_id") % 2 == 0, "event_type").otherwise("other")).alias("a"),
    )
    out = rename_fields(e, {"event_type": "kind", "absent": "never"}, ("m",), ("a",))
    return out.select("event_id", "kind", F.array_join(F.map_keys("m"), ",").alias("keys"), F.array_join("a", ",").alias("entries"))


@query("""WITH e AS (SELECT DISTINCT o_orderstatus AS section, cast(o_orderkey AS varchar) AS k FROM orders WHERE o_orderkey % 10 <> 1), x AS (SELECT l_linestatus AS section, cast(l_orderkey AS varchar) AS k, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT coalesce(e.section, x.section) AS section, coalesce(sum(n), 0) AS rows_extracted, count(x.k) AS distinct_ids, count(e.k) AS expected_ids, sum(CASE WHEN x.k IS NULL THEN 1 ELSE 0 END) AS missing, sum(CASE WHEN e.k IS NULL THEN 1 ELSE 0 END) AS unexpected,
  sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS repeated, sum(CASE WHEN x.k IS NOT NULL AND length(x.k) < 3 THEN 1 ELSE 0 END) AS bad_ids,
  round(100.0::double * (count(e.k) - sum(CASE WHEN x.k IS NULL THEN 1 ELSE 0 END)) / nullif(count(e.k), 0), 1) AS coverage_pct FROM e FULL JOIN x ON e.k = x.k AND e.section = x.section GROUP BY 1""")
def id_coverage_by_section(spark, sf):
    orders = T.read(spark, sf, "orders").filter("o_orderkey % 10 <> 1").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("section"))
    lines = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("section"))
    return CV.id_coverage(orders, lines, "id", "^\\d{3,}$", "section")


@query("""SELECT document_id, row_number() OVER (ORDER BY section, family IS NULL, family) - 1 AS place FROM (SELECT DISTINCT document_id, section, family FROM {cards}) x""")
def document_order(spark, sf):
    return C.document_order(T.derive(spark, sf, "cards")).select("document_id", "place")


@query(PAIRS_SQL + CANDIDATES_SQL + """, own AS (SELECT req_id, r2 AS rank, order_number, passed, failed, unknown FROM again WHERE r2 <= 10 AND req_id <> 'nation-5')
SELECT req_id, rank, order_number, passed, failed, unknown, failed = 0 AS viable FROM own UNION ALL SELECT req_id, rnk, order_number, passed, failed, unknown, failed = 0 FROM ranked WHERE rnk <= 10 AND req_id = 'nation-5'""")
def solve_listed(spark, sf):
    """Requirements over the parts that their suppliers ship; one of them over the whole catalog, some of the ids unknown."""
    lots = T.read(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    listed = lots.join(T.read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("req_id"), (F.col("l_partkey") + 1000000).cast("string").alias("order_number")
    )
    wide = spark.sql("SELECT 'nation-5' AS req_id, cast(NULL AS string) AS order_number UNION ALL SELECT 'nation-6', 'no such part'")
    return S.solve_candidates(T.products(spark, sf), T.specs(spark, sf), T.requirements(spark, sf), listed.unionByName(wide), 10).select(*SOLVED_COLUMNS)


@query("""SELECT 'far' AS question, order_number, type_code, sensing_range_max_mm AS value, 0 AS place FROM {catalog} WHERE sensing_range_max_mm >= 1000
UNION ALL SELECT 'family', order_number, type_code, NULL, row_number() OVER (ORDER BY type_code) FROM {catalog} WHERE family = 'Brand#1'""")
def analyst_rows(spark, sf):
    """The analysts' other questions: parts that reach far, and one family by type code."""
    rows = T.products(spark, sf)
    far = rows.filter("sensing_range_max_mm >= 1000").select(F.lit("far").alias("question"), "order_number", "type_code", F.col("sensing_range_max_mm").alias("value"), F.lit(0).alias("place"))
    one = rows.filter("family = 'Brand#1'")
    placed = CQ.top_k(one, ["family"], [F.asc("type_code")], 2**31 - 1, "place")
    return far.unionByName(placed.select(F.lit("family").alias("question"), "order_number", "type_code", F.lit(None).cast("double").alias("value"), "place"))
