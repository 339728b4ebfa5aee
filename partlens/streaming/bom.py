"""Bill-of-materials lines arriving file by file, each with its outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from partlens.functions.text import part_key
from partlens.operators import bom
from partlens.operators.match import part_keys
from partlens.sources.bom_files import split_boms


def audit_stream(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """Stream-static left join on the part key: every line comes out once, matched or not.

    ``parts`` is a static table with one row per ``key``.
    """
    keyed = lines.withColumn("key", part_key(F.col("part_number")))
    joined = keyed.join(parts.withColumn("_known", F.lit(True)), "key", "left")
    status = (
        F.when(F.col("part_number").isNull() | (F.col("key") == ""), "unprocessable")
        .when(F.col("_known"), "resolved")
        .otherwise("unknown")
    )
    return joined.withColumn("status", status).drop("key", "_known")


def write_audit(audited: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        audited.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def audit_files(files: DataFrame, records: DataFrame, vendors: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Audit whole files (file, value) as they arrive: every batch is one folder of audited lines under ``path``.

    The roles of a file's columns are read off all of its lines, so a batch takes files
    whole.  A batch that is run again writes its folder again, and nothing twice.
    The catalog is reduced to its keys once, not with each batch.
    """
    keys = part_keys(records)

    def audit(batch: DataFrame, number: int) -> None:
        lines = bom.bom_audit(bom.bom_rows(split_boms(batch), vendors), keys)
        lines.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return files.writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audited_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all batches that :func:`audit_files` has written."""
    return spark.read.parquet(path).drop("batch")
