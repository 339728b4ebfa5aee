"""Strict readers stay strict when the checked column is not read."""

import pytest

from partlens.sources import catalog, trace


def test_broken_catalog_row_fails_any_read(spark, tmp_path):
    good = '{"order_number": "1234567", "row_type": "product", "category": "c", "section": "s", "source_page": "1", "pdf_page": 1}'
    (tmp_path / "a.jsonl").write_text(good + "\n" + good.replace("1234567", "12") + "\n")
    rows = catalog.read_catalog_jsonl(spark, str(tmp_path / "a.jsonl"))
    for read in (rows.count, rows.select("section").collect, rows.groupBy("section").count().collect):
        with pytest.raises(Exception, match="a.jsonl"):
            read()
    (tmp_path / "b.jsonl").write_text(good + "\n")
    assert catalog.read_catalog_jsonl(spark, str(tmp_path / "b.jsonl")).count() == 1


def test_broken_trace_line_fails_any_read(spark, tmp_path):
    good = '{"type": "tool", "label": "x", "at": 1}'
    (tmp_path / "a.ndjson").write_text(good + "\nnot json\n")
    rows = trace.read_trace(spark, str(tmp_path / "a.ndjson"))
    for read in (rows.count, rows.select("label").collect):
        with pytest.raises(Exception, match="not a trace event"):
            read()
