"""Session construction and durable lineage cuts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app_name: str = "rasterweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are tuned for; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    defaults.update({key.replace("_", "."): value for key, value in conf.items()})
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared folder, the one named by ``spark.checkpoint.dir``.

    Executors of a cluster have to reach it, so it must be set there. A local master, where driver
    and executor are one process, gets a private folder if none is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, cutting its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
