"""The trace summary over an append-only log, as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from partlens.operators.coverage import trace_summary


def summarize_stream(events: DataFrame, keys: tuple[str, ...] = ("run_id",), watermark: tuple[str, str] | None = None,
                     bucket: str | None = None) -> DataFrame:
    """Running summary per run.

    State is one row per run.  With ``watermark`` = (time column, delay) and
    ``bucket``, rows are also grouped by time window and state of closed windows
    is dropped, for logs whose runs never end in number.
    """
    if watermark and bucket:
        timed = events.withWatermark(*watermark)
        return trace_summary(timed, [*keys, F.window(watermark[0], bucket).alias("bucket")])
    return trace_summary(events, keys)


def write_summary(summary: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Keep the latest summary of every run as parquet, one folder per micro-batch, replayable after a failure."""

    def save(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (
        summary.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    )


def latest_summary(written: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """The newest row of every run among the saved micro-batches."""
    keep = [c for c in written.columns if c not in keys]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*keep), "epoch").alias("_r")).select(*keys, "_r.*").drop("epoch")
