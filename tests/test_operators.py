"""Hand-computed rows per operator, and brute force where a closed form replaces a loop."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from partlens.functions import nulls, text, units
from partlens.functions import verdicts as V
from partlens.operators import audit, bom, chunks, compare, equivalence, retrieval, score, solve
from partlens.plans import scale
from partlens.sources import bom_files, catalog, index_store, trace
from partlens.sources.schemas import ENRICHED, SCORING_REQUIREMENT, complete
from partlens.streaming.bom import audit_stream, write_audit


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
    return row.select(column.alias("x")).first()["x"]


def span(low, high):
    d = lambda v: F.lit(v).cast("double")
    return F.struct(d(low).alias("min"), d(high).alias("max"))


def d(v):
    return F.lit(v).cast("double")


@pytest.mark.parametrize(
    "low, high, want, status",
    [
        (10, 300, (200, None), "pass"), (10, 300, (400, None), "fail"), (250, 300, (200, None), "fail"), (None, 300, (200, None), "pass"),
        (10, None, (200, None), "unknown"), (None, None, (200, None), "unknown"), (None, 100, (200, None), "fail"), (10, 300, (None, None), None),
    ],
)
def test_window(spark, low, high, want, status):
    v = V.verdict_window_cover("f", "range", "mm", d(low), d(high), span(*want))
    assert one(spark, v.status) == status


@pytest.mark.parametrize(
    "low, high, want, status",
    [(10, 30, (24, 24), "pass"), (None, 30, (24, None), "unknown"), (10, 30, (36, None), "fail"), (30, None, (24, None), "fail"), (None, None, (24, None), "unknown")],
)
def test_within(spark, low, high, want, status):
    assert one(spark, V.verdict_within("f", "supply", "V", d(low), d(high), span(*want)).status) == status


@pytest.mark.parametrize(
    "low, high, want, status",
    [(-20, None, (-10, None), "pass"), (-20, None, (-10, 50), "unknown"), (0, None, (-10, 50), "fail"), (-20, 60, (-10, 50), "pass")],
)
def test_contains(spark, low, high, want, status):
    assert one(spark, V.verdict_contains("f", "temp", "C", d(low), d(high), span(*want)).status) == status


def test_enum_and_flags(spark):
    s = lambda v: F.lit(v).cast("string")
    allowed = F.array(F.lit("PNP"))
    empty = F.array().cast("array<string>")
    assert one(spark, V.verdict_enum("f", "out", s(None), allowed, ("unknown",)).status) == "unknown"
    assert one(spark, V.verdict_enum("f", "out", s("unknown"), allowed, ("unknown",)).status) == "unknown"
    assert one(spark, V.verdict_enum("f", "out", s("NPN"), allowed, ("unknown",)).status) == "fail"
    assert one(spark, V.verdict_enum("f", "out", s("NPN"), empty).status) is None
    b = lambda v: F.lit(v).cast("boolean")
    i = lambda v: F.lit(v).cast("int")
    assert one(spark, V.verdict_flag_with_witness("f", "IP69K", b(None), i(None), b(True)).status) == "unknown"
    assert one(spark, V.verdict_flag_with_witness("f", "IP69K", b(None), i(67), b(True)).status) == "fail"
    assert one(spark, V.verdict_flag_with_witness("f", "IP69K", b(True), i(None), b(True)).status) == "pass"
    inferred = V.downgrade_inferred(V.verdict_enum("f", "principle", s("fluid"), allowed), s("category"))
    assert one(spark, inferred.status) == "unknown"


def test_nulls_never_lower_viability(spark):
    reqs = spark.createDataFrame([("r", ["PNP"], {"min": 200.0, "max": None})], "req_id string, output_type array<string>, sensing_range_mm struct<min:double,max:double>")
    full = [(str(i), random.choice(["PNP", "NPN"]), float(random.randint(50, 400))) for i in range(40)]
    holes = [(i, o if random.random() < 0.5 else None, r if random.random() < 0.5 else None) for i, o, r in full]
    ddl = "order_number string, output_type string, sensing_range_max_mm double"
    products = spark.createDataFrame([(i, "A", "product", None) for i, _, _ in full], "order_number string, section string, row_type string, family string")
    kept = [set(r.order_number for r in solve.prefilter(products, spark.createDataFrame(x, ddl), reqs).collect()) for x in (full, holes)]
    assert kept[0] <= kept[1]


def test_pairing_beyond_a_pack(spark):
    rows = spark.range(50).withColumn("name", F.col("id").cast("string"))
    small = spark.range(30).select(F.col("id").alias("k"))
    out = scale.pair_with_all(rows, small, "s", pack_rows=4)
    assert out.select("id", "s.k").distinct().count() == 1500 == out.count()


def test_block_numbers_match_a_plain_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randint(0, 3), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, p int, o long")
    out = scale.block_row_number(df, ["k"], ["p", "o"], [F.col("p"), F.shiftright("o", 4)], "i").collect()
    for key in "ab":
        got = sorted((r.p, r.o, r.i) for r in out if r.k == key)
        assert [g[2] for g in got] == list(range(len(got)))


def test_relaxation_equals_the_loop(spark):
    rng = random.Random(7)
    order = score.relaxation_order(score.CONSTRAINTS)
    place = {n: i + 1 for i, n in enumerate(order)}
    for _ in range(300):
        violated = [set(rng.sample(order, rng.randint(0, 5))) for _ in range(rng.randint(1, 6))]
        ignored = 0
        while not any(v <= set(order[:ignored]) for v in violated):
            ignored += 1
        level = min(max((place[n] for n in v), default=0) for v in violated)
        assert level == ignored


def test_scoring_absent_never_excludes(spark):
    req = complete(spark.createDataFrame([("r", 300.0, 5.0)], "req_id string, target_distance_mm double, max_response_ms double"), SCORING_REQUIREMENT)
    rows = [("1", "product", 400.0, 4.0, 0), ("2", "product", None, None, 1), ("3", "product", 200.0, 4.0, 2), ("4", "accessory", 400.0, 4.0, 3)]
    products = complete(spark.createDataFrame(rows, "order_number string, row_type string, sensing_range_max_mm double, response_time_ms double, ord long"), ENRICHED + ", ord BIGINT")
    out = {r.order_number: r for r in score.score_catalog(products, req).collect()}
    assert set(out) == {"1", "2"} and out["1"].rank == 1
    assert out["2"].fit == 0 and out["2"].evidence == 0 and out["1"].evidence == 1
    assert out["1"].excluded == 1


def test_half_stated_temperature(spark):
    p = F.struct(F.lit(None).cast("double").alias("operating_temp_min_c"), F.lit(60.0).alias("operating_temp_max_c"))
    r = F.struct(F.lit(-10.0).alias("min_temp_c"), F.lit(50.0).alias("max_temp_c"))
    assert one(spark, score.temperature(p, r).status) == "violated"
    assert one(spark, score.temperature(p, r, half_open="unverified").status) == "unverified"


@pytest.mark.parametrize("ratio, expected", [(1.0, 100.0), (1.25, 94.6), (2.0, 66.4), (2 / 3, 75.7), (3 / 14, 7.6), (8.0, 8.0)])
def test_ratio_score(spark, ratio, expected):
    assert round(one(spark, equivalence.ratio_score(F.lit(ratio))), 1) == expected


def test_interchange_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = [
        (f"{i:04d}", f"T{i}", rng.choice("AB"), rng.choice([None, 100.0, 150.0, 150.5, 400.0]), rng.choice([None, "PNP", "NPN", "PNP/NPN"]), rng.choice([None, "M8", "M12"]), rng.choice([None, "red"]))
        for i in range(60)
    ]
    df = spark.createDataFrame(rows, "order_number string, type_code string, category string, range_max_mm double, output string, connection string, light_type string")
    got = {}
    for r in equivalence.interchange(df, 4).collect():
        got.setdefault(r.order_number, []).append((r["rank"], r.candidate))
    for a in rows:
        best = []
        for b in rows:
            if b[1] == a[1] or b[2] != a[2] or (a[3] is None and a[4] is None):
                continue
            if a[3] is not None and (b[3] is None or b[3] < a[3]):
                continue
            if a[4] is not None and b[4] != a[4] and b[4] != "PNP/NPN":
                continue
            cost = 0.0 if a[3] is None else (b[3] - a[3]) / max(a[3], 1)
            cost += 0.35 if a[5] and b[5] and a[5] != b[5] else 0
            cost += 0.2 if a[6] and b[6] and a[6] != b[6] else 0
            best.append((-1 / (1 + cost), b[0]))
        assert [c for _, c in sorted(got.get(a[0], []))] == [c for _, c in sorted(best)[:4]], a


def test_rrf_by_hand(spark):
    lanes = spark.createDataFrame([("q", "bm25", 1, 0), ("q", "bm25", 2, 1), ("q", "dense", 2, 0), ("q", "dense", 2, 5)], "query_id string, lane string, item int, rank int")
    out = {r.item: r for r in retrieval.rrf(lanes, ["bm25", "dense"], k=-1).collect()}
    assert math.isclose(out[2].rrf_score, 1 / 61 + 1 / 60) and out[2].fused_rank == 0
    assert math.isclose(out[1].rrf_score, 1 / 60) and out[1].dense_rank is None


def test_rerank_keeps_what_the_reranker_left_out(spark):
    fused = spark.createDataFrame([("q", i, i) for i in range(5)], "query_id string, item int, fused_rank int")
    scores = spark.createDataFrame([("q", 3, 0.9)], "query_id string, item int, rerank_score double")
    out = retrieval.merge_rerank(fused, scores, k=4).orderBy("rank").collect()
    assert [r.item for r in out] == [3, 0, 1, 2] and [r.rerank_rank for r in out] == [0, None, None, None]


def test_dense_edge_cases(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [1.0, 0.0])], "id int, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    for block in (1024, 1):
        out = retrieval.dense_search(queries, vectors, 10, block=block).orderBy("rank").collect()
        assert [(r.item, r.score) for r in out] == [(1, 1.0), (5, 1.0), (2, 0.0), (3, 0.0)]


def test_tokens(spark):
    got = one(spark, retrieval.tokenize(F.lit("Sensor WTB4-3 IP 67 áé")))
    assert set(got) == {"sensor", "wtb4", "3", "wtb43", "ip", "67", "ip67", "ae"}
    assert one(spark, retrieval.term(F.lit("categories"))) == "category"
    assert one(spark, retrieval.term(F.lit("with"))) is None


def test_blank_query_finds_nothing(spark):
    docs = spark.createDataFrame([(1, "red bolt")], "id int, text string")
    queries = spark.createDataFrame([("a", "   "), ("b", "the"), ("c", "bolt")], "query_id string, text string")
    out = retrieval.bm25_search(queries, retrieval.build_postings(docs), retrieval.corpus_stats(retrieval.doc_lengths(docs)))
    assert [r.query_id for r in out.collect()] == ["c"]


def test_null_honest_and_flatten(spark):
    row = spark.createDataFrame([({"a": " x ", "b": "", "c": '{"d": "1"}'},)], "m map<string,string>")
    assert row.select(nulls.flatten_map(F.col("m")).alias("m")).first().m == {"a": "x", "c.d": "1"}
    assert one(spark, nulls.null_honest(F.lit(" NaN "), "double")) is None
    assert one(spark, nulls.null_honest(F.lit("  "), "string")) is None


def test_units(spark):
    for raw, value in [("1.020", 1020.0), ("0,25", 0.25), ("1.234,56", 1234.56), ("+7", 7.0), ("x", None)]:
        assert one(spark, units.euro_number(F.lit(raw))) == value
    assert one(spark, units.parse_mm(F.lit("2 m, 0,5 m"))) == 2000.0
    assert one(spark, units.asserted_value(F.lit("50 °F"), F.lit("C"))) == 10.0


def test_gloss_longest_match(spark):
    terms = {"sensor de proximidad": "proximity sensor", "sensor": "sensor!", "con": "with"}
    assert one(spark, text.gloss(F.lit("Sensor de proximidad con cable"), terms)) == "proximity sensor with cable"
    assert one(spark, text.gloss(F.lit("nada"), terms)) is None


def test_word_budget_keeps_the_line_that_crosses(spark):
    lines = F.array(*[F.lit(x) for x in ("a b", "c d e", "f")])
    assert one(spark, chunks.within_budget(lines, 4)) == ["a b", "c d e"]


def test_bom_splitting():
    raw = '﻿Part No;Qty\r\n"A;1";2\r"x\n""y""";3\n;;\n'
    body = raw.lstrip("﻿")
    records = list(bom_files.split_records(body, bom_files.sniff_delimiter(body)))
    assert records == [(1, ["Part No", "Qty"]), (2, ["A;1", "2"]), (3, ['x\n"y"', "3"]), (5, ["", "", ""])]


def test_bom_counter_column(spark):
    files = spark.createDataFrame([("f", "Item,Ref,Cantidad\n1,WT-100,2\n2,WT-200,3")], "file string, value string")
    rows = bom.bom_rows(bom_files.split_boms(files), ["acme"]).orderBy("line").collect()
    assert [(r.line, r.quantity, r.raw["Ref"]) for r in rows] == [(2, 2.0, "WT-100"), (3, 3.0, "WT-200")]


def test_catalog_reader(spark, tmp_path):
    good = {"order_number": 1234567, "row_type": "product", "category": "c", "section": "B", "source_page": "B-1", "pdf_page": "3",
            "sensing_range_max_mm": "300", "family": "  ", "provenance": {"switching_output": "x", "other_specs": {"a": "b"}}}
    path = tmp_path / "p.jsonl"
    path.write_text(json.dumps(good) + "\n\n" + json.dumps({**good, "order_number": "123456"}) + "\nnot json\n")
    told = [(r.line, r.problem) for r in catalog.catalog_rejects(spark, str(path)).orderBy("line").collect()]
    assert [t[0] for t in told] == [3, 4]
    path.write_text(json.dumps(good) + "\n")
    row = catalog.read_catalog_jsonl(spark, str(path)).first()
    assert row.order_number == "1234567" and row.sensing_range_max_mm == 300.0 and row.family is None
    assert row.also_on_pages == [] and row.occurrences == 1 and row.provenance["other_specs.a"] == "b"
    path.write_text(json.dumps({**good, "order_number": "12"}) + "\n")
    with pytest.raises(Exception, match="p.jsonl"):
        catalog.read_catalog_jsonl(spark, str(path)).collect()


def test_families_csv(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text('﻿family,section,category,product_variants,accessory_rows,n_pages,pages,product_url\r\n"G, ""6""",B,cat,3,1,2,B-1; B-2 ;,\r\n', encoding="utf-8")
    row = catalog.read_families_csv(spark, str(path)).first()
    assert row.family == 'G, "6"' and row.pages == ["B-1", "B-2"] and row.product_url is None and row.product_variants == 3
    path.write_text("family,section\nx,y\n")
    with pytest.raises(ValueError, match="category"):
        catalog.read_families_csv(spark, str(path))


def test_vectors_round_trip(spark):
    df = spark.createDataFrame([(1, [1.5, -2.0]), (2, None)], "id int, v array<float>")
    back = {r.id: r.v for r in index_store.decode_vectors(index_store.encode_vectors(df, "v"), "v", 2).collect()}
    assert back == {1: [1.5, -2.0], 2: None}
    with pytest.raises(Exception, match="wrong length"):
        index_store.decode_vectors(index_store.encode_vectors(df, "v"), "v", 3).collect()


def test_trace_rejects_broken_lines(spark, tmp_path):
    path = tmp_path / "t.ndjson"
    path.write_text('{"type": "a", "at": 1, "label": "x"}\n')
    assert trace.read_trace(spark, str(path)).count() == 1
    path.write_text('{"type": "a", "at": 1\n')
    with pytest.raises(Exception, match="not a trace event"):
        trace.read_trace(spark, str(path)).collect()


def test_bom_stream(spark, tmp_path):
    spark.createDataFrame([("MX-1",), (None,), ("zz",)], "part_number string").write.parquet(str(tmp_path / "in"))
    parts = spark.createDataFrame([("MX1", "Acme")], "key string, vendor string")
    stream = spark.readStream.schema("part_number string").parquet(str(tmp_path / "in"))
    write_audit(audit_stream(stream, parts), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted(r.status for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == ["resolved", "unknown", "unprocessable"]


def test_compare_refuses_odd_groups(spark):
    described = spark.createDataFrame([("1", 0, "f", True, "x")], "order_number string, position int, field string, stated boolean, value string")
    groups = spark.createDataFrame([("g", "1")], "group_id string, order_number string")
    with pytest.raises(Exception, match="2 to 5"):
        compare.compare(described, groups).collect()


def test_redaction(spark):
    assert one(spark, text.redact_foreign_ids(F.lit("use 1234567 not 7654321"), F.lit("1234567"))) == "use 1234567 not [part number removed]"


def test_cap_confidence(spark):
    cap = lambda *n: one(spark, audit.cap_confidence(F.lit("high"), *[F.lit(x) for x in n]))
    assert [cap(0, 0, 0, 0), cap(3, 1, 0, 0), cap(3, 0, 1, 0), cap(3, 0, 0, 1), cap(3, 0, 0, 0)] == ["low", "low", "medium", "medium", "high"]


def test_plan_shapes(spark):
    """No Cartesian product, and the cut to k rows sits below the shuffle."""
    sf = "/root/testdata/sf0.001"
    import __spark_entry__ as entry

    df = entry.queries()["solve_topk"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "WindowGroupLimit" in plan


