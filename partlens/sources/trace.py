"""Run traces as newline-delimited JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.sources.schemas import TRACE


def _checked(rows: DataFrame) -> DataFrame:
    """A line that is not an event is a hard error: the trace is evidence."""
    shape_ok = F.col("type").isNotNull() & F.col("label").isNotNull() & F.col("at").isNotNull()
    told = F.concat(F.lit("not a trace event: "), F.coalesce("_corrupt", F.to_json(F.struct("type", "label", "at"))))
    broken = F.col("_corrupt").isNotNull() | ~shape_ok
    # A filter: unlike a column it is not pruned when the caller reads other columns or only counts.
    return rows.where(F.when(broken, F.raise_error(told).cast("boolean")).otherwise(F.lit(True))).drop("_corrupt")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(TRACE + ", _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt")
    return _checked(reader.json(path))


def read_trace_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(TRACE + ", _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _checked(reader.json(path))


def write_trace(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)
