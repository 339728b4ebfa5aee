"""Large dictionaries, codes inside codes, and the audit as a stream, against the small forms."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from partlens.functions import text
from partlens.operators import bom, gloss, match
from partlens.sources import bom_files
from partlens.streaming.bom import audit_files, audited_lines


def test_gloss_texts_equal_the_columns(spark):
    """Longest phrase first, phrases of several words and marks, rules before the lookup."""
    rng = random.Random(3)
    bits = ["red", "bolt", "red bolt", "m8", "c++", "+", "-", " ", " ", "Ünit", "unit", "x", "1", ".", "  ", "中", "_"]
    phrases = {"red": "rojo", "red bolt": "perno rojo", "red bolt m8": "PR8", "m8": "eight", "c++": "see", "unit 1": "one", "x": "", "+": "plus", "red-": "R"}
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 10))) for _ in range(1500)] + [None, ""]
    table = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for rules in ((), (("unit", "red"),)):
        made = gloss.gloss_texts(table, "t", phrases, rules).withColumn("want", text.gloss(F.col("t"), phrases, rules))
        assert made.columns == ["id", "t", "gloss", "want"] and made.filter("gloss is not null").count() > 500
        assert made.filter(~F.col("gloss").eqNullSafe(F.col("want"))).collect() == []


def test_gloss_texts_with_a_large_dictionary(spark, monkeypatch):
    terms = spark.range(100_000).select(F.concat(F.lit("word"), "id", F.lit(" of")).alias("phrase"), F.concat(F.lit("w"), "id").alias("told"))
    table = spark.range(20_000).select("id", F.concat(F.lit("A Word"), "id", F.lit(" of word"), "id").alias("t"))
    start = time.time()
    made = gloss.gloss_texts(table, "t", terms)
    assert made.filter(F.col("gloss") != F.concat(F.lit("a w"), "id", F.lit(" word"), "id")).count() == 0 and made.count() == 20_000
    assert time.time() - start < 60
    monkeypatch.setattr(gloss, "MOST_PHRASES", 1000)
    with pytest.raises(ValueError, match="phrases"):
        gloss.gloss_texts(table, "t", terms)


def test_contained_equals_all_pairs(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab1") for _ in range(rng.randint(1, n)))
    parts, wholes = sorted({word(9) for _ in range(300)}), sorted({word(16) for _ in range(300)})
    found = match.contained(spark.createDataFrame([(p,) for p in parts], "part string"), spark.createDataFrame([(w,) for w in wholes], "whole string"), 5)
    want = sorted((p, w) for p in parts for w in wholes if len(p) >= 5 and p in w)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 50


def test_audit_stream_of_whole_files(spark, tmp_path):
    """Batches of whole files hold the lines of the batch audit; a batch that runs again writes nothing twice."""
    files = [(f"f{i}", "Part No,Qty\n" + "".join(f"MX-{j},{j}\n" for j in range(i + 1))) for i in range(5)]
    records = spark.createDataFrame([(0, "Acme", "A", "MX-1", 1), (1, "Acme", "A", "MX-3", 1)], "ord int, vendor string, series string, model string, richness int")
    table = spark.createDataFrame(files, "file string, value string")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("file string, value string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    audit_files(stream(), records, [], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want = bom.bom_audit(bom.bom_rows(bom_files.split_boms(table), []), records)
    told = lambda df: sorted(map(str, df.select("file", "line", "part_number", "quantity", "status").collect()))
    assert told(audited_lines(spark, str(tmp_path / "out"))) == told(want) and want.count() == 15
    audit_files(stream(), records, [], str(tmp_path / "out"), str(tmp_path / "state2")).awaitTermination()
    assert told(audited_lines(spark, str(tmp_path / "out"))) == told(want)


def test_printed_text_is_folded_in_one_pass(spark):
    """One pattern, that of white space, goes over a text; what it gives is what one replacement after the other gives."""
    rng = random.Random(8)
    signs = ["a", "É", "ñ", "İ", "ß", "́", "‐", "—", "“", "’", "™", "®", " ", "  ", "\t", "\xa0", " ", "\n", "-", "K"]
    texts = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 12)))) for i in range(3000)] + [(3000, None), (3001, " a  b\t")]
    rows = spark.createDataFrame(texts, "id int, text string")
    plain = F.regexp_replace(F.translate("text", text.ACCENTED, text.PLAIN), "[\\u0300-\\u036f]", "")
    plain = F.regexp_replace(F.regexp_replace(plain, "[\\u2010-\\u2015]", "-"), "[\\u201c\\u201d\\u2018\\u2019]", '"')
    step = F.trim(F.regexp_replace(F.lower(F.regexp_replace(plain, "[\\u2122\\u00ae]", "")), "(?U)\\s+", " "))
    out = rows.select("id", text.fold_print(F.col("text")).alias("made"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    both = rows.select("id", text.fold_print(F.col("text")).alias("made"), step.alias("want")).collect()
    assert len(both) == 3002 and [r for r in both if r.made != r.want] == []
