"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "partlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; existing settings win on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Settings of an existing session that the wide rule expressions need.

    Verdict and score projections hold dozens of aliases over shared
    expressions; inferring filters from every combination of those aliases costs
    the optimizer far more than the filters could save.
    """
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and read it from there on.

    The folder is the one the session names in ``spark.checkpoint.dir``, so the
    copy outlives any executor.  Only a local session without that setting (a
    test run) falls back to a temporary folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="partlens-checkpoint-")
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder next to the session's checkpoints, which all executors see; a local one only for a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="partlens-run-") if base is None else f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"
