"""The stored index, both lanes and their refill, against plain loops; file order in any split."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from partlens.operators import equivalence, images, postings, retrieval, score
from partlens.plans import search, tables
from partlens.sources import bom_files, catalog, index_store, posting_store

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of a few bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "64b", "spark.sql.files.openCostInBytes": "1b"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def odd_texts(n, seed=4):
    rng = random.Random(seed)
    bits = ["ip", "IP", "67", " ", "  ", "-", "_", "WTB4", "é", "Ñ", "İ", "ß", "K", "́", "\n", "\t", "\xa0", "a", "the", "Sensors", "categories", "being", "freed", "glass", "series", "x/y", "m", "12a", " ", "中"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_terms_are_those_of_the_columns(spark):
    docs = spark.createDataFrame([*enumerate(odd_texts(2500)), (9999, None)], "id int, text string")
    fast = {(r.term, r.id): (r.tf, r.length) for r in retrieval.build_postings(docs).collect()}
    columns = {(r.term, r.id): (r.tf, r.length) for r in retrieval.build_postings(docs, tokens=lambda c: retrieval.tokenize(c)).collect()}
    assert fast == columns and len(fast) > 2500
    assert {r.id: r.length for r in retrieval.doc_lengths(docs).collect()} == {r.id: max(r.length, 0) for r in retrieval.doc_lengths(docs, tokens=lambda c: retrieval.tokenize(F.coalesce(c, F.lit("")))).collect()}


def test_long_runs_without_words_are_read_in_linear_time():
    counts, length = postings.TermReader().count("ab " + "- \n" * 200_000 + "7")
    assert counts == {"ab": 1, "ab7": 1} and length == 3


def test_texts_read_together_are_read_apart():
    """No run, joined word or glued number reaches from one text into the next, whatever bytes they hold."""
    texts = [*odd_texts(400), "ab", "12", "a\0b", "m\x1c7", "m\x0b7", None, ""]
    reader = postings.TermReader()
    at, terms, counts, lengths, names = reader.count_all(postings.pa.array(texts))
    found = [{} for _ in texts]
    for text, term, n in zip(at, names.take(postings.pa.array(terms)).to_pylist(), counts):
        found[text][term] = n
    assert [(f, n) for f, n in zip(found, lengths)] == [reader.count(t or "") for t in texts]
    assert reader.count("m\x0b7")[0] == {"m7": 1} and reader.count("m\x1c7")[0] == {"m7": 1}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


def test_stored_postings_answer_like_texts(spark, docs, questions, tmp_path):
    """Hot terms lie in several shares; the postings are joined where they lie."""
    version = str(tmp_path / "v")
    posting_store.write_postings(docs, version, buckets=4, share_rows=7)
    stored = posting_store.read_postings(spark, version)
    posting_store.validate_postings(stored)
    assert stored.term.agg(F.max("shares")).first()[0] > 3
    found = posting_store.search(questions, stored, 15)
    want = retrieval.bm25_over(questions, docs, 15)
    assert sorted(map(tuple, found.select("query_id", "rank", "item", "score").collect())) == sorted(map(tuple, want.select("query_id", "rank", "item", "score").collect()))
    hits = stored.posting.join(posting_store.asked_shares(questions, stored).hint("merge"), ["term", "share"])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    scan = next(i for i, line in enumerate(plan.splitlines()) if "posting" in line and "FileScan" in line)
    above = [line for line in plan.splitlines()[:scan] if "Exchange" in line]
    assert "Bucketed: true" in plan.splitlines()[scan] and not above, plan


def shuffled_rows(df):
    """Rows that the exchanges of a plan have written, once it has run."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        metric = node.metrics().get("shuffleRecordsWritten")
        if metric.isDefined():
            found.append(metric.get().value())
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if node.nodeName().endswith("QueryStage") else []
        for at in range(node.children().size()):
            inner.append(node.children().apply(at))
        for n in inner:
            walk(n)

    walk(plan)
    return sum(found)


def test_no_pair_of_a_chunk_and_a_query_is_shuffled(spark, docs, questions, tmp_path, monkeypatch):
    """A search sums whole chunks where they lie, in slices of them, as the join of all pairs does."""
    rows = postings.index_rows(docs).persist()
    pairs = retrieval.sum_weights(retrieval.bm25_pairs(questions, rows.filter("term is not null"), postings.corpus_stats(rows))).count()
    want = retrieval.bm25_search(questions, rows.filter("term is not null"), postings.corpus_stats(rows), 5)
    want = sorted(map(tuple, want.select("query_id", "rank", "item", "score").collect()))
    monkeypatch.setattr(retrieval, "CELLS", 700)
    found = retrieval.bm25_over(questions, docs, 5)
    assert sorted(map(tuple, found.select("query_id", "rank", "item", "score").collect())) == want and len(want) == 5 * questions.count()
    assert shuffled_rows(found) < pairs / 3
    version = str(tmp_path / "v")
    monkeypatch.setattr(posting_store, "BUCKET_ROWS", 5000)
    posting_store.write_postings(docs, version, buckets=2, share_rows=7)
    stored = posting_store.read_postings(spark, version)
    assert spark.read.parquet(f"{version}/corpus").first().buckets == -(-rows.filter("term is not null").count() // 5000) > 2
    kept = posting_store.search(questions, stored, 5)
    assert sorted(map(tuple, kept.select("query_id", "rank", "item", "score").collect())) == want


def test_many_asked_terms_meet_the_postings_in_joins(spark, docs, questions, tmp_path, monkeypatch):
    want = sorted(map(tuple, retrieval.bm25_over(questions, docs, 5).select("query_id", "rank", "item", "score").collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 3)
    assert sorted(map(tuple, retrieval.bm25_over(questions, docs, 5).select("query_id", "rank", "item", "score").collect())) == want


def test_postings_that_do_not_add_up_are_refused(spark, docs, tmp_path):
    version = str(tmp_path / "v")
    posting_store.write_postings(docs, version, buckets=2)
    stored = posting_store.read_postings(spark, version)
    short = posting_store.Postings(stored.posting.filter("tf > 1"), stored.term, stored.n_docs, stored.avg_length)
    with pytest.raises(ValueError, match="postings hold"):
        posting_store.validate_postings(short)


def test_empty_corpus(spark, docs, questions, tmp_path):
    posting_store.write_postings(docs.limit(0), str(tmp_path / "v"), buckets=2)
    stored = posting_store.read_postings(spark, str(tmp_path / "v"))
    assert stored.n_docs == 0 and posting_store.search(questions, stored).count() == 0
    assert retrieval.bm25_over(questions, docs.limit(0)).count() == 0 and retrieval.bm25_over(questions.limit(0), docs).count() == 0


def card_tables(spark, cards=None):
    products = tables.full_products(spark, SF)
    families = products.groupBy("section", "family").agg(F.min("product_url").alias("product_url"))
    chunk = tables.derive(spark, SF, "cards") if cards is None else cards
    return {"chunk": chunk, "vector": tables.derive(spark, SF, "card_vectors"), "product": products, "spec": tables.specs(spark, SF), "family": families}


def test_readers_follow_the_pointer(spark, tmp_path):
    path = str(tmp_path / "index")
    first = index_store.write_index(card_tables(spark), path, buckets=2)
    old = index_store.read_index(spark, path)
    fewer = tables.derive(spark, SF, "cards").filter("kind = 'sku'")
    vectors = tables.derive(spark, SF, "card_vectors").join(fewer.select(F.col("id").alias("chunk_id")), "chunk_id")
    second = index_store.write_index({**card_tables(spark, fewer), "vector": vectors}, path, buckets=2)
    new = index_store.read_index(spark, path)
    assert first != second and old["postings"].n_docs == old["chunk"].count() > new["postings"].n_docs == new["chunk"].count()
    posting_store.validate_postings(old["postings"])
    with pytest.raises(ValueError, match="belongs to no chunk"):
        index_store.write_index({**card_tables(spark, fewer)}, path, buckets=2)
    assert index_store.read_index(spark, path)["chunk"].count() == new["chunk"].count()


def test_refill_equals_judging_all_pairs(spark, monkeypatch):
    """With windows of one row and many rounds the lanes hold what judging every pair would leave."""
    monkeypatch.setattr(search, "FIRST_WINDOW", 1)
    monkeypatch.setattr(search, "WIDER", 3)
    rows = postings.index_rows(tables.derive(spark, SF, "cards")).persist()
    index = {**card_tables(spark), "posting": rows.filter("term is not null"), "stats": postings.corpus_stats(rows)}
    asked = tables.derive(spark, SF, "card_queries").filter("text != ' '").persist()
    reqs = tables.requirements(spark, SF)
    scores = search.lexical_scores(index, asked).persist()
    fetch = lambda part, n: retrieval.lane_rank(scores.join(part.select("query_id"), "query_id", "left_semi"), n)
    made = search.refill(index, asked, reqs, fetch, 5)
    want = retrieval.lane_rank(search.surviving(index, asked, reqs, scores), 5)
    assert sorted(map(str, made.select("query_id", "rank", "item").collect())) == sorted(map(str, want.select("query_id", "rank", "item").collect()))
    kept, all_rows = search.surviving(index, asked, reqs, scores).count(), scores.count()
    assert 0 < kept < all_rows


def test_hybrid_with_a_reranker(spark):
    """The reranker sees the texts of the fused head; what it leaves out follows."""
    rows = postings.index_rows(tables.derive(spark, SF, "cards"))
    index = {**card_tables(spark), "posting": rows.filter("term is not null"), "stats": postings.corpus_stats(rows)}
    asked = tables.derive(spark, SF, "card_queries").filter("query_id = 'free'")
    plain = search.hybrid_search(index, asked, top=8).orderBy("rank").collect()
    turned = search.hybrid_search(index, asked, top=8, rerank=lambda query, texts: [float(i) for i in range(3)]).orderBy("rank").collect()
    assert [r.item for r in turned] == [r.item for r in (plain[2], plain[1], plain[0], *plain[3:])]
    assert [r.rerank_rank for r in turned] == [0, 1, 2] + [None] * 5 and {r.rerank_rank for r in plain} == {None}


@pytest.mark.parametrize("block", [1024, 3])
def test_dense_blocks_equal_brute_force(spark, block):
    rng = np.random.default_rng(2)
    vectors = [(f"v{i:03d}", [float(x) for x in rng.integers(-2, 3, 4 if i % 9 else 3)]) for i in range(400)] + [("none", None), ("empty", [])]
    asked = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(20)] + [(99, [0.0] * 4)]
    made = retrieval.dense_search(spark.createDataFrame(asked, "query_id int, embedding array<double>"), spark.createDataFrame(vectors, "id string, embedding array<float>"), 7, block=block)
    got = {(r.query_id, r["rank"]): (r.item, r.score) for r in made.collect()}
    assert len(got) == 7 * len(asked)
    for q, v in asked:
        def cosine(w):
            a, b = np.array(v), np.array(w)
            return round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 9) + 0.0 if len(a) == len(b) and a.any() and b.any() else 0.0

        best = sorted((-cosine(w), i) for i, w in vectors if w)[:7]
        assert [got[q, n] for n in range(7)] == [(i, pytest.approx(-s)) for s, i in best]


def test_claims_equal_the_loop(spark):
    """Images claim rows in order; rows and images at the same height, and numbers printed twice on a page."""
    rng = random.Random(6)
    pics, rows = [], []
    for page in range(60):
        spread = rng.choice([60, 400, 3000])
        for i in range(rng.randint(0, 9)):
            pics.append((page, f"i{i}", rng.randint(0, 9), rng.randrange(0, spread, 5), 40, 40, f"s{i}", 900))
        rows += [(page, f"{rng.randint(0, 12):07d}", rng.randrange(0, spread, 5), n) for n in range(rng.randint(0, 9))]
    image_table = spark.createDataFrame(pics, "page int, image_id string, ord int, top int, w int, h int, sha string, page_width int")
    row_table = spark.createDataFrame(rows, "page int, order_number string, top int, ord int")
    got = sorted((r.page, r.order_number, r.image_id, r.offset) for r in images.row_image_match(image_table, row_table).collect())
    want = []
    for page in range(60):
        mine = sorted(((o, i, t + 20.0) for p, i, o, t, *_ in pics if p == page))
        lines = sorted((n, num, t + 5.5) for p, num, t, n in rows if p == page)
        taken = set()
        for o, i, centre in mine:
            free = [(abs(centre - at), n, num, at) for n, num, at in lines if num not in taken]
            if not free or min(free)[0] > 45:
                continue
            d, _, num, at = min(free)
            if any(abs(c - at) < d for _, _, c in mine):
                continue
            taken.add(num)
            want.append((page, num, i, centre - at))
    assert got == sorted(want) and len(want) > 60


def test_interchange_of_codes_with_several_ranges(spark):
    rng = random.Random(8)
    rows = [
        (f"{i:04d}", f"T{rng.choice([0, 0, 0, 1, 2, 3, i])}", rng.choice("AB"), rng.choice([None, *[float(x) for x in range(100, 160, 3)]]), rng.choice([None, "PNP", "PNP/NPN"]), rng.choice([None, "M8"]), None)
        for i in range(220)
    ]
    table = spark.createDataFrame(rows, "order_number string, type_code string, category string, range_max_mm double, output string, connection string, light_type string")
    for k in (1, 3):
        got = {}
        for r in equivalence.interchange(table, k).collect():
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
                best.append((-1 / (1 + cost), b[0]))
            assert [c for _, c in sorted(got.get(a[0], []))] == [c for _, c in sorted(best)[:k]], (k, a)


def test_best_by_level_reads_pairs_once(spark, monkeypatch):
    monkeypatch.setattr(score, "GATHERED", 50)
    rng = random.Random(9)
    rows = [(f"r{rng.randint(0, 5)}", f"{i:05d}", i, rng.random(), rng.random(), rng.randint(0, 3), round(rng.random(), 1)) for i in range(3000)]
    table = spark.createDataFrame(rows, "req_id string, order_number string, ord long, fit double, evidence double, level int, rank_score double").repartition(7)
    told = score.best_by_level(table, 4).collect()
    for req in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == req]
        low = min(r[5] for r in mine)
        assert {(v, sum(t.n for t in told if t.req_id == req and t.n is not None and t.level == v)) for v in range(4)} == {(v, sum(r[5] == v for r in mine)) for v in range(4)}
        best = sorted((-t.rank_score, t.ord) for t in told if t.req_id == req and t.n is None and t.level == low)[:4]
        assert best == sorted((-r[6], r[2]) for r in mine if r[5] == low)[:4]
    assert score.best_by_level(table.limit(0), 4).count() == 0


BOMS = {
    "a.csv": '﻿Part;Qty\n"MX-1\nsecond line; still";2\n\nMX-2;"say ""hi"""\r\nMX-3;3\rMX-4;4\n',
    "b.csv": "one, two\n" + "".join(f"MX-{i},{i}\n" for i in range(40)),
    "c.csv": 'x\t"open quote\nto the end, of the file\n',
    "d.csv": "\n \n,,\n",
}


def test_boms_in_splits_equal_whole_files(spark, tmp_path, small_splits):
    for name, text in BOMS.items():
        (tmp_path / name).write_bytes(text.encode())
    whole = bom_files.split_boms(spark.createDataFrame(list(BOMS.items()), "file string, value string"))
    read = bom_files.read_boms(spark, str(tmp_path)).withColumn("file", F.regexp_extract("file", "[^/]+$", 0))
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, whole.collect())) and read.filter("file = 'b.csv'").count() == 41


def test_file_order_in_any_split(spark, tmp_path, small_splits):
    """Rows of several files of unequal size keep their place, whatever the splits."""
    numbers = []
    for name, n in (("a.jsonl", 3), ("b.jsonl", 70), ("c.jsonl", 1), ("d.jsonl", 25)):
        own = [f"{1_000_000 + len(numbers) + i:07d}" for i in range(n)]
        numbers += own
        lines = [json.dumps({"order_number": o, "row_type": "product", "category": "c", "section": "s", "source_page": "1", "pdf_page": 1, "vendor": "v", "product_category": "p"}) for o in own]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    path = str(tmp_path)
    for read in (catalog.read_catalog_jsonl, catalog.read_all_rows):
        rows = read(spark, path)
        assert [r.order_number for r in rows.orderBy("ord").collect()] == numbers and rows.agg(F.max("ord")).first()[0] == len(numbers) - 1
        joined = rows.repartition(5).join(rows.select("order_number", F.lit(1).alias("x")), "order_number").orderBy("ord")
        assert [r.order_number for r in joined.collect()] == numbers
    assert [r.ord for r in catalog.read_competitors(spark, path.replace("*", "")).select("ord").orderBy("ord").collect()] == []
    lines = catalog.read_lines(spark, path)
    assert lines.groupBy("file").agg(F.max("line").alias("n")).agg(F.sum("n")).first()[0] == len(numbers)
