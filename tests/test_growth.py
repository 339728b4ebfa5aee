"""Steps whose memory and time must not grow faster than the input, read off their plans and counts."""

import glob
import gzip
import os

import pytest
from pyspark.sql import functions as F

from partlens.operators import bom as B
from partlens.operators import equivalence as E
from partlens.operators import match as M
from partlens.operators import solve as S
from partlens.plans import source_queries as SQ
from partlens.plans import tables as T
from partlens.sources import bom_files, catalog
from partlens.sources.bom_files import split_boms, split_records
from partlens.streaming import bom as stream


@pytest.fixture
def no_small_sides(spark):
    """No side of a join is taken as small by its size."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def plan(df):
    """The plan as it was executed."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_misses_send_no_side_to_the_driver(spark):
    codes = [f"blue-ring-{i}" for i in range(50)]
    catalog = spark.createDataFrame([(c, str(i), i) for i, c in enumerate(codes)], "type_code string, order_number string, ord long")
    queries = spark.createDataFrame([(i, c[:-1]) for i, c in enumerate(codes)], "query_id int, part string")
    found = M.near_miss(queries, catalog)
    assert "BroadcastHashJoin" not in plan(found)
    assert found.filter("query_id = 20 and rank = 1").first().type_code == "blue-ring-20"


def test_files_are_written_by_more_tasks_for_more_rows(spark, tmp_path):
    rows = spark.range(3 * SQ.FILE_ROWS * 4).select(F.col("id").cast("string").alias("value"), "id")
    path = SQ._lines(rows, ["id"], f"{tmp_path}/lines")
    files = sorted(glob.glob(f"{path}/part-*"))
    assert len(files) == 12
    firsts = [int(open(f).readline()) for f in files]
    assert firsts == sorted(firsts) and firsts[0] == 0


def test_files_are_cut_into_records_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(value):
        seen.add(1)
        return value

    files = spark.createDataFrame([(f"f{i}", f'Part No,Qty\nMX-{i},"2"\n') for i in range(20)], "file string, value string")
    counted = files.select("file", F.udf(count, "string")("value").alias("value"))
    rows = B.bom_rows(split_boms(counted), ["acme"]).collect()
    assert len(rows) == 20 and seen.value == 20
    assert rows[0].quantity == 2.0 and set(rows[0].raw) == {"Part No", "Qty"}


def test_quoted_cells_read_the_same_where_quotes_do_not_matter():
    assert list(split_records('a,"b"\r\n\n"c d",e\r,\n  \nf', ",")) == [(1, ["a", "b"]), (3, ["c d", "e"]), (4, ["", ""]), (6, ["f"])]
    assert list(split_records('" "\n"a""b",c', ",")) == [(1, [" "]), (2, ['a"b', "c"])]
    assert list(split_records('"a,b"x"c"', ",")) == [(1, ["a,bxc"])]


def test_a_stream_reduces_its_catalog_once(spark, tmp_path, monkeypatch):
    made = []
    keys = M._best_per_key
    monkeypatch.setattr(M, "_best_per_key", lambda keyed: made.append(1) or keys(keyed))
    for i in range(3):
        spark.createDataFrame([(f"f{i}", f"Part No,Qty\nMX-{i},2")], "file string, value string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/files")
    records = spark.createDataFrame([("Acme", "BR", "MX-1", 1, 1)], "vendor string, series string, model string, ord long, richness int")
    files = spark.readStream.schema("file STRING, value STRING").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/files")
    stream.audit_files(files, records, [], f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted((r.part_number, r.status) for r in stream.audited_lines(spark, f"{tmp_path}/out").collect()) == [("MX-0", "unknown"), ("MX-1", "resolved"), ("MX-2", "unknown")]
    assert len(made) == 2


def test_judging_pairs_sends_neither_catalog_nor_specs_to_the_driver(spark):
    sf = "/root/testdata/sf0.001"
    pairs = T.products(spark, sf).limit(5).select(F.lit("nation-3").alias("req_id"), "order_number")
    alive = S.prefilter_pairs(T.products(spark, sf), T.specs(spark, sf), T.requirements(spark, sf), pairs)
    sides = [line for line in plan(alive).split("Initial Plan")[0].splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in sides if "[order_number" in line]


def test_a_lookup_of_typed_codes_sends_no_side_to_every_task(spark):
    typed = spark.createDataFrame([(1, "ab-1"), (2, "1000002"), (3, "red bolt left"), (4, None)], "query_id int, part string")
    rows = spark.createDataFrame([("1000001", "AB-1", 1), ("1000002", "CD-2", 2)], "order_number string, type_code string, ord int")
    out = M.classify_input(typed, rows)
    assert {r.query_id: r["mode"] for r in out.collect()} == {1: "part", 2: "part", 3: "describe", 4: "describe"}
    assert "BroadcastHashJoin" not in plan(out)


def test_no_line_of_a_bill_of_materials_is_a_row_of_a_step(spark, tmp_path, monkeypatch):
    rows = []
    cut = bom_files.cut_lineage
    monkeypatch.setattr(bom_files, "cut_lineage", lambda df: rows.append(cut(df)) or rows[-1])
    text = "﻿Part;Note\n" + "".join(f'MX-{i};"two\nlines; ""{i}"""\n' for i in range(15_000)) + 'a\rb\nc;"open\nto the end\n'
    (tmp_path / "a.csv").write_text(text, newline="")
    want = split_boms(spark.createDataFrame([("a.csv", text)], "file string, value string")).orderBy("record").collect()
    found = bom_files.read_boms(spark, str(tmp_path)).orderBy("record").collect()
    assert [(r.record, r.cells) for r in found] == [(r.record, r.cells) for r in want] and len(found) == 15_004
    assert max(df.count() for df in rows) < 20


def test_stand_ins_are_ranked_without_sorting_parts_times_offers(spark):
    rows = [(f"{i:04d}", f"code-{i % 90}", "c", float(i % 40), "PNP", ("M8", "M12")[i % 2], None) for i in range(400)]
    # One number stands twice in the catalog, under two codes and ranges.
    rows += [("0007", "code-91", "c", 30.0, "PNP", "M8", None)]
    table = spark.createDataFrame(rows, "order_number string, type_code string, category string, range_max_mm double, output string, connection string, light_type string")
    found = E.interchange(table, 3)
    want = {}
    for a in rows:
        for b in rows:
            if a[1] != b[1] and b[3] >= a[3]:
                score = 1 / (1 + (b[3] - a[3]) / max(a[3], 1.0) + (0.35 if a[5] != b[5] else 0.0))
                want.setdefault(a[0], []).append((-score, b[0], b[3]))
    got = {}
    for r in found.orderBy("order_number", "rank").collect():
        got.setdefault(r.order_number, []).append((r["rank"], r.candidate, r.candidate_range, r.score))
    assert got == {n: [(i, c, v, round(-s, 6)) for i, (s, c, v) in enumerate(sorted(x)[:3], 1)] for n, x in want.items()}
    # The last step, from the lists of the questions on, has no window over the parts.
    assert "windowspecdefinition(order_number#" not in plan(found)


def test_lines_are_numbered_without_a_shuffle_of_lines(spark, tmp_path, no_small_sides):
    (tmp_path / "a.jsonl").write_text("\ufeffa1\na2\n")
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as file:
        file.write("\ufeffb1\n\nb3\n")
    (tmp_path / "c.jsonl").write_text("c1")
    lines = catalog.read_lines(spark, str(tmp_path))
    assert "SortMergeJoin" not in plan(lines)
    assert [(r.ord, r.line, r.value) for r in lines.orderBy("ord").collect()] == [(0, 1, "a1"), (1, 2, "a2"), (2, 1, "b1"), (3, 2, ""), (4, 3, "b3"), (5, 1, "c1")]


@pytest.mark.parametrize("starts", [[("f", 0, 0, 1)], [("f", 0, 1, 2)], [("f", 64, 0, 2)], []])
def test_lines_of_splits_that_were_not_counted_fail_the_read(spark, starts):
    rows = spark.createDataFrame([("f", 0, 0, "a"), ("f", 0, 1, "b")], "file string, block long, id long, value string")
    counted = [(*s, 0, 0) for s in starts]
    with pytest.raises(Exception, match="splits changed while reading f"):
        catalog._placed(rows, spark.createDataFrame(counted, "file string, block long, first_id long, lines long, before long, above long")).collect()


def test_records_of_competitors_take_less_disk_than_their_table(spark, tmp_path, monkeypatch):
    sf, dealt = "/root/testdata/sf0.01", []
    frame = type(spark.range(0))
    deal = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *a: dealt.extend(self.columns) or deal(self, *a))
    monkeypatch.setattr(SQ, "shared_folder", lambda spark: str(tmp_path))
    rows = SQ.read_competitors(spark, sf)
    # The text of a record is neither shuffled nor written at its full length, and is parsed once.
    assert "l_orderkey" in dealt and "value" not in dealt
    assert sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/files/part-*")) < os.path.getsize(f"{sf}/lineitem.parquet")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    lines = catalog.read_lines(spark, f"{tmp_path}/files")
    table = T.read(spark, sf, "lineitem")
    assert lines.count() == table.count() == lines.agg(F.max("ord")).first()[0] + 1 and rows.count() == table.filter("l_partkey % 7 <> 0").count()
