"""The retrieval index as a folder of tables with a provenance row."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.plans.scale import shuffled
from partlens.sources import posting_store

VERSION = 2
TABLES = ["chunk", "vector", "spec", "product", "family"]


def decode_vectors(df: DataFrame, column: str, expected_width: int | None = None) -> DataFrame:
    """Base64 little-endian Float32 text to array<float>; a wrong width or broken payload fails the job."""
    raw = F.unbase64(F.col(column))
    width = F.lit(expected_width).cast("int")
    bad = F.col(column).isNotNull() & (
        (F.length(raw) % 4 != 0) | F.coalesce(F.length(raw) / 4 != width, F.lit(False))
    )
    checked = F.when(bad, F.raise_error(F.lit("vector payload has the wrong length"))).otherwise(raw)

    @F.pandas_udf("array<float>")
    def floats(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda p: None if p is None else np.frombuffer(p, dtype="<f4"))

    return df.withColumn(column, floats(checked))


def encode_vectors(df: DataFrame, column: str) -> DataFrame:
    """array<float> to base64 little-endian Float32 text; a hole in a vector fails the job."""
    hole = F.exists(column, lambda x: x.isNull() | F.isnan(x))
    whole = F.when(hole, F.raise_error(F.lit("vector holds a missing value"))).otherwise(F.col(column))

    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())

    return df.withColumn(column, F.base64(packed(whole)))


def provenance(tables: dict[str, DataFrame], source_dir: str, built_at: str | None = None) -> DataFrame:
    """Counts of the index, re-derived from its tables, and the real vector width."""
    spark = tables["chunk"].sparkSession
    stated = F.count("embedding")
    counts = [
        tables["chunk"].agg(
            F.count("*").alias("chunk_count"), F.count_if(F.col("kind") == "family").alias("family_card_count")
        ),
        tables["vector"].agg(stated.alias("embedded_count"), F.max(F.size("embedding")).alias("max_width"),
                             F.min(F.size("embedding")).alias("min_width")),
        tables["product"].agg(F.count("*").alias("product_count")),
        tables["family"].agg(F.count("*").alias("family_count")),
        tables["chunk"].select("document_id").distinct().agg(F.count("*").alias("document_count")),
    ]
    # One-row tables, side by side.
    row = spark.range(1).select(
        F.lit(VERSION).alias("version"),
        F.lit(source_dir).alias("source_dir"),
        (F.lit(built_at) if built_at else F.current_timestamp().cast("string")).alias("built_at"),
        F.lit(1).alias("_one"),
    )
    for count in counts:
        row = row.join(count.withColumn("_one", F.lit(1)), "_one")
    width = F.when(F.col("min_width") == F.col("max_width"), F.col("max_width"))
    return row.withColumn("embedding_width", width).withColumn(
        "mixed_widths", F.coalesce(F.col("min_width") != F.col("max_width"), F.lit(False))
    ).drop("_one", "min_width", "max_width")


def write_index(tables: dict[str, DataFrame], path: str, source_dir: str = "", buckets: int = posting_store.BUCKETS) -> str:
    """Write every table and the postings of the chunks under a fresh version folder, then point ``current`` at it.

    Readers follow the pointer, so they see the old index or the new one, never a mix.
    """
    spark = tables["chunk"].sparkSession
    version = f"{path}/v-{uuid.uuid4().hex}"
    for name in TABLES:
        writer = tables[name].write.mode("errorifexists")
        if name in ("chunk", "product") and "section" in tables[name].columns:
            writer = writer.partitionBy("section")
        writer.parquet(f"{version}/{name}")
    written = {name: spark.read.parquet(f"{version}/{name}") for name in TABLES}
    posting_store.write_postings(written["chunk"], version, buckets=buckets)
    provenance(written, source_dir).write.parquet(f"{version}/provenance")
    validate_index(spark, version)
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{path}/current")
    return version


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the current version, its provenance, and its ``postings`` (a :class:`partlens.sources.posting_store.Postings`)."""
    version = spark.read.parquet(f"{path}/current").first()["version"]
    validate_index(spark, version)
    tables = {name: spark.read.parquet(f"{version}/{name}") for name in [*TABLES, "provenance"]}
    return {**tables, "postings": posting_store.read_postings(spark, version)}


def validate_index(spark: SparkSession, version: str) -> None:
    """Refuse an index of another version, with counts that do not add up, or with vectors of no chunk."""
    told = spark.read.parquet(f"{version}/provenance").first()
    if told["version"] != VERSION:
        raise ValueError(f"index {version} has version {told['version']}, this build reads {VERSION}")
    chunk = spark.read.parquet(f"{version}/chunk")
    vector = spark.read.parquet(f"{version}/vector")
    if chunk.count() != told["chunk_count"]:
        raise ValueError(f"index {version}: chunk count differs from its provenance")
    if not vector.join(shuffled(chunk.select("id")), F.col("chunk_id") == F.col("id"), "left_anti").isEmpty():
        raise ValueError(f"index {version}: a vector belongs to no chunk")
    stored = posting_store.read_postings(spark, version)
    if stored.n_docs != told["chunk_count"]:
        raise ValueError(f"index {version}: postings of {stored.n_docs} chunks, but {told['chunk_count']} chunks")
    posting_store.validate_postings(stored)
    if told["mixed_widths"]:
        raise ValueError(f"index {version}: vectors of different widths")
