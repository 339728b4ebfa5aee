"""Quality rules: fixed base rules, then fences that follow each language and source.

The fences come from mergeable quantile sketches: counts per bucket of six
leading binary digits (relative error 1/32), summed over documents, so sketches of
sources add up to those of languages and of the whole.  A document is rejected
where a measure lies far outside the middle half of its group.  Everything is
DataFrame expressions; the only rows that move are buckets and fences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partlens.llm.common import BLANKS, coarse, row_key
from partlens.session import cut_lineage

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: A measure, its expression over the base columns, and how far beyond the quartiles a document may always lie.
MEASURES = {
    "word_length": ("word_chars * 100 div n_words", 120),
    "symbols": ("n_symbols * 1000 div n_words", 80),
    "dup_lines": ("n_dup_lines * 1000 div greatest(n_lines, 1)", 500),
    "repeats": ("n_repeat_words * 1000 div n_words", 200),
    "echoes": ("n_echoes * 1000 div n_words", 200),
    "capitals": ("n_capitals * 1000 div word_chars", 200),
    "shouts": ("n_shouts * 1000 div n_words", 150),
}
#: Fences stand this many times the middle half's width beyond the quartiles.
WIDTHS = 3
#: A group of fewer documents takes the fences of its language, and a smaller language those of all documents.
GROUP_DOCS = 50


def _pairs(hashes: str, step: int) -> Column:
    """Each hash joined with the one ``step`` places on; the last ``step`` entries have no partner and are cut off later."""
    return F.expr(f"zip_with({hashes}, slice({hashes}, {step + 1}, greatest(size({hashes}), 1)), (a, b) -> xxhash64(a, b))")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", key: tuple[str, ...] = ("text",)) -> DataFrame:
    """``id``, ``key``, ``lang``, ``source`` and the base measures of every row, over the whole text.

    Eight-word windows are compared by a 64-bit hash within one text.  A null text has no words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), row_key(*key).alias("key"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text.alias("text")
    )
    solid = F.translate("text", BLANKS, "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    rows = rows.select(
        "id", "key", "lang", "source",
        F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "!?", ""))).cast("long").alias("n_shouts"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.when(F.instr("text", "\n") > 0, lines).otherwise(F.array(F.col("text"))).alias("lines"),
    )
    rows = rows.select(
        "id", "key", "lang", "source", "word_chars", "n_symbols", "n_shouts", "n_capitals",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(words, w -> xxhash64(w))").alias("h1"),
    )
    base = [c for c in rows.columns if c != "h1"] + ["n_echoes"]
    echoes = F.expr("cast(size(filter(zip_with(h1, slice(h1, 2, greatest(size(h1), 1)), (a, b) -> a = b), x -> x)) as bigint)")
    rows = rows.select(*base[:-1], echoes.alias("n_echoes"), _pairs("h1", 1).alias("h2"))
    rows = rows.select(*base, _pairs("h2", 2).alias("h4"))
    rows = rows.select(*base, _pairs("h4", 4).alias("h8"))
    rows = rows.select(*base, F.expr(f"slice(h8, 1, cast(greatest(n_words - {WINDOW - 1}, 0) as int))").alias("windows"))
    found = "sort_array(arrays_zip(windows, sequence(0, size(windows) - 1)))"
    twice = f"transform(array({found}), s -> zip_with(s, slice(s, 2, size(s)), (x, y) -> if(x.windows = y.windows, array(x.`1`, y.`1`), null)))[0]"
    places = f"sort_array(array_distinct(flatten(filter({twice}, x -> x is not null))))"
    covered = f"transform(array({places}), p -> aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least(b - a, {WINDOW})), 0, (n, x) -> n + x))[0]"
    return rows.select(
        *base, F.expr(f"cast(case when size(array_distinct(windows)) = size(windows) then 0 else {covered} end as bigint)").alias("n_repeat_words")
    ).withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))


def fences(measured: DataFrame, group_docs: int = GROUP_DOCS) -> DataFrame:
    """``lang_key``, ``source_key`` and for each measure the lowest and highest value that is kept (``lo_``, ``hi_``)."""
    rows = measured.where("not base_failed").withColumns(_group())
    values = F.array(*[F.struct(F.lit(m).alias("measure"), coarse(F.expr(e)).alias("bucket")) for m, (e, _) in MEASURES.items()])
    keyed = F.array(
        F.concat_ws("/", "lang_key", "source_key"), F.concat_ws("/", "lang_key", F.lit("")), F.lit("/")
    )
    sketch = rows.select("lang_key", "source_key", F.inline(values)).groupBy("lang_key", "source_key", "measure", "bucket").agg(F.count("*").alias("n"))
    levels = sketch.select(F.explode(keyed).alias("level"), "measure", "bucket", "n").groupBy("level", "measure", "bucket").agg(F.sum("n").alias("n"))
    of = Window.partitionBy("level", "measure")
    ranked = levels.withColumns({"total": F.sum("n").over(of), "upto": F.sum("n").over(of.orderBy("bucket"))})
    quartiles = ranked.groupBy("level", "measure").agg(
        F.max("total").alias("total"),
        F.min(F.when(F.expr("upto * 4 >= total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.expr("upto * 4 >= total * 3"), F.col("bucket"))).alias("q3"),
    )
    slack = F.coalesce(*[F.when(F.col("measure") == m, F.lit(s)) for m, (_, s) in MEASURES.items()])
    beyond = F.greatest(slack, WIDTHS * (F.col("q3") - F.col("q1")))
    edges = quartiles.select("level", "measure", "total", (F.col("q1") - beyond).alias("lo"), (F.col("q3") + beyond).alias("hi"))
    wide = edges.groupBy("level").agg(
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{side}_{m}") for m in MEASURES for side in ("lo", "hi")],
    )
    groups = sketch.select("lang_key", "source_key").distinct().select("lang_key", "source_key", F.posexplode(keyed).alias("rank", "level"))
    chosen = groups.join(wide, "level").where((F.col("total") >= group_docs) | (F.col("rank") == 2))
    limits = F.struct(*[F.col(f"{side}_{m}") for m in MEASURES for side in ("lo", "hi")])
    return chosen.groupBy("lang_key", "source_key").agg(F.min_by(limits, "rank").alias("f")).select("lang_key", "source_key", "f.*")


def _group() -> dict[str, Column]:
    """Names of a row's language and source; a null is a group of its own."""
    return {f"{c}_key": F.when(F.col(c).isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), F.col(c))) for c in ("lang", "source")}


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", key: tuple[str, ...] = ("text",), group_docs: int = GROUP_DOCS) -> DataFrame:
    """The measures of every row of ``docs``, ``base_failed`` and ``kept``.

    Null or blank texts fail the base rules; null languages and sources are
    groups; equal rows are judged alike; an empty table gives an empty result;
    columns not named are not read.
    """
    measured = cut_lineage(measure(docs, id_col, text_col, lang_col, source_col, key))
    limits = fences(measured, group_docs).withColumnsRenamed({"lang_key": "__lang", "source_key": "__source"})
    inside = F.lit(True)
    for name, (value, _) in MEASURES.items():
        inside = inside & F.expr(f"({value}) between lo_{name} and hi_{name}")
    rows = measured.withColumns(_group())
    joined = rows.join(limits, (F.col("lang_key") == F.col("__lang")) & (F.col("source_key") == F.col("__source")), "left")
    verdict = F.when(F.col("base_failed"), F.lit(False)).otherwise(inside)
    return joined.select(*measured.columns, verdict.alias("kept"))
