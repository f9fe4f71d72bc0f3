"""Labelled image trees as manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.operators.catalog import scan_paths


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, modified, bytes`` of all files below ``root``; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(
        F.regexp_replace("path", "^file:/*", "/").alias("path"),
        F.col("modificationTime").alias("modified"),
        F.col("length").alias("bytes"),
    )


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """Manifest of the image tree below ``root``."""
    return scan_paths(list_files(spark, root).select("path"), root)
