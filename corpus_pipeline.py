"""The corpus pipeline: quality, near-duplicates, long repeats, mixing, tokens.

``STAGES`` names the stages in order.  Each takes (spark, docs, sf_dir) and gives a
table that is written as Parquet and read again as the next one's ``docs``; all but
the last give the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.llm import mixing, piece_codec, quality, similar, suffixes
from partlens.llm.common import keep_rows, plain_names, written
from partlens.llm.queries import piece_model

#: The columns that, with the id, tell rows apart.
KEY = ("text", "lang", "source", "n_chars")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a row that stands in the table twice stays twice."""
    judged = quality.judge(docs, key=KEY)
    return keep_rows(docs, judged.where("kept").select("id", "key", F.lit(1).alias("times")), KEY)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates (five-word shingles, Jaccard 0.8 or more) the row with the smallest id (of equal ids, the smallest key)."""
    found = similar.similar_groups(docs, key=KEY)
    kept = found.groupBy("root").agg(F.min(F.struct("id", "key")).alias("r")).select("r.*", F.lit(1).alias("times"))
    return keep_rows(docs, kept, KEY)


def without_long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the characters that repeats of 200 bytes cover; ``n_chars`` is counted again."""
    cut = plain_names(suffixes.without_repeats(docs))
    kept = F.col(cut.columns[-1])
    new = {"text": kept, "n_chars": F.length(kept).cast("long")}
    return cut.select(*[new.get(c, F.col(f"c{i}")).alias(f"c{i}") for i, c in enumerate(docs.columns)]).toDF(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mix = mixing.mix(docs, key=KEY)
    return keep_rows(docs, mix.where("copies > 0").select("id", "key", F.col("copies").alias("times")), KEY)


def token_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``tokens``, ``parity`` and ``round_trip`` of every row."""
    return piece_codec.encode(docs, piece_model()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", good_documents),
    ("SimHash near-dedup", one_of_each_group),
    ("suffix-array dedup", without_long_repeats),
    ("mixing to weights", mixed_sources),
    ("SentencePiece encoding", token_rows),
]

#: Fingerprints and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
