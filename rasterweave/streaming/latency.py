"""Latency reports over streams: stored sketches that merge by addition.

A sketch counts values in buckets that grow by a constant factor, so the middle of a bucket is within a
known relative error of everything in it. Buckets of equal number add up across batches, days and
models, in any order and any number of steps, and the error stays the same.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterweave.functions.scalars import safe_divide

#: relative error of a quantile; bucket of values that are not above zero
ERROR, NONE = 0.01, -(2**31)
QUANTILES = {"median_ms": 0.5, "p95_ms": 0.95}


def latency_sketch(latencies: DataFrame, keys: Sequence[str] = ("model_id",), error: float = ERROR) -> DataFrame:
    """``keys, bucket, batches, total_ms``: a few hundred rows a key at most, whatever the number of rows.

    Bucket k holds latencies above g^(k-1) and up to g^k, with g = (1 + error) / (1 - error). Values of
    zero and below share a bucket that stands for 0; missing and NaN values are left out.
    """
    if not 0 < error < 1:
        raise ValueError("the error must be between 0 and 1")
    value, growth = F.col("latency_ms").cast("double"), math.log((1 + error) / (1 - error))
    bucket = F.when(value <= 0, NONE).otherwise(F.ceil(F.ln(value) / growth)).cast("int")
    kept = latencies.where(value.isNotNull() & ~F.isnan(value))
    return kept.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("batches"), F.sum(value).alias("total_ms"))


def merged_sketch(sketches: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """One sketch from the rows of several."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("batches").alias("batches"), F.sum("total_ms").alias("total_ms"))


def sketched_report(
    sketch: DataFrame, batch_size: int = 1, keys: Sequence[str] = ("model_id",), error: float = ERROR,
    quantiles: Mapping[str, float] = QUANTILES,
) -> DataFrame:
    """Mean, throughput and quantiles of a merged sketch.

    Counts and means are exact. The quantile p of n values stands for the value of rank
    floor(p * (n - 1)), counted from 0, and is within the sketch's relative error of it.
    """
    if batch_size <= 0:
        raise ValueError("batch size must be positive")
    growth = (1 + error) / (1 - error)
    so_far = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    rows = sketch.withColumn("_upto", F.sum("batches").over(so_far)).withColumn("_n", F.sum("batches").over(Window.partitionBy(*keys)))
    middle = F.when(F.col("bucket") == NONE, 0.0).otherwise(2 * F.pow(F.lit(growth), F.col("bucket")) / (growth + 1))
    mean = F.sum("total_ms") / F.sum("batches")
    return rows.groupBy(*keys).agg(
        F.sum("batches").alias("batches"),
        mean.alias("mean_ms"),
        safe_divide(F.lit(batch_size), mean / 1000.0).alias("images_per_second"),
        *[F.min(F.when(F.col("_upto") > F.floor(p * (F.col("_n") - 1)), middle)).alias(name) for name, p in quantiles.items()],
    )


def start_latencies(
    stream: DataFrame, folder: str, progress: str, keys: Sequence[str] = ("model_id",), error: float = ERROR, **trigger
) -> StreamingQuery:
    """Store the sketch of every micro-batch under its number; a repeated batch replaces its own."""

    def store(batch: DataFrame, batch_id: int) -> None:
        latency_sketch(batch, keys, error).write.mode("overwrite").parquet(f"{folder}/n={batch_id}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", progress)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def compact(spark, folder: str, into: str, keys: Sequence[str] = ("model_id",)) -> None:
    """Merge the stored batches of ``folder`` into one sketch at ``into``, which is read in their place."""
    merged_sketch(spark.read.parquet(f"{folder}/*"), keys).write.mode("overwrite").parquet(into)
