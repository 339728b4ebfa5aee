"""Results are as large as asked, each text is embedded once, and bill-of-materials cells are read as they are printed."""

import os
import uuid

from pyspark.sql import functions as F

from partlens.operators import bom as B
from partlens.operators import match as M
from partlens.operators import retrieval as R
from partlens.plans.scale import clamp_k


def test_a_large_size_is_obeyed():
    assert clamp_k(5_000, 20) == 5_000
    assert clamp_k(5_000, 20, 100) == 100
    assert [clamp_k(x, 20) for x in (None, True, 0, -3, float("nan"), float("inf"), "7")] == [20] * 7


def test_each_text_is_embedded_once(spark, tmp_path):
    folder = str(tmp_path)

    def embedder(texts):
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as file:
            file.write("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    chunks = spark.createDataFrame([("d1", 0, "c1", "one"), ("d1", 1, "c2", "three"), ("d2", 0, "c3", "a")], "document_id string, chunk_index int, id string, text string")
    found = {r.chunk_id: list(r.embedding) for r in R.embed_documents(chunks, embedder).collect()}
    assert found == {"c1": [3.0, 1.0], "c2": [5.0, 1.0], "c3": [1.0, 1.0]}
    texts = sorted(t for name in os.listdir(folder) for t in open(os.path.join(folder, name)).read().split("\n"))
    assert texts == ["a", "one", "three"]


def test_cells(spark):
    cells = ["MX-12", "12345", "1234", "12-34", "ABC", "A1", "AB 12", "AB  12", "A 1 B", "-A1", " X9 z ", "A1" * 24, "A1" * 24 + "B", "12 345", "A1\nB", ""]
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select("c", B.looks_like_part(F.col("c")).alias("p")).collect()
    assert [r.c for r in rows if r.p] == ["MX-12", "12345", "AB 12", " X9 z ", "A1" * 24]
    amounts = {"12": 12.0, "1,234": 1234.0, "1,234,567": 1234567.0, "1,5": 1.5, "1,23,4": 1.23, "12 pcs": 12.0, "4.5": 4.5, ",5": 0.5, "x": None, "1,234.5": 1.234, None: None}
    rows = spark.createDataFrame([(c,) for c in amounts], "c string").select("c", B.quantity(F.col("c")).alias("q")).collect()
    assert {r.c: r.q for r in rows} == amounts
    likely = {"12": True, "1,5 pcs": True, "12 Stk": False, "1234567": False, "3X": True, "": False}
    rows = spark.createDataFrame([(c,) for c in likely], "c string").select("c", B.looks_like_quantity(F.col("c")).alias("q")).collect()
    assert {r.c: r.q for r in rows} == likely


def test_housings(spark):
    texts = {"Stainless steel": ["stainless-steel"], "steel, ABS": ["plastic", "metal"], "acero inoxidable / zinc": ["stainless-steel", "metal"], "vidrio": ["other"], "": []}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.map_housing(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == texts
