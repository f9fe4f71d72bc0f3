"""Metrics over a stream of labelled pixels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterweave.operators.evaluation import class_metrics, confusion, summary_metrics


def streaming_confusion(pixels: DataFrame) -> DataFrame:
    """Running confusion matrix; its state is at most classes squared counters."""
    return confusion(pixels)


def start_metrics(
    pixels: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint_dir: str, **trigger
) -> StreamingQuery:
    """Call ``publish(metrics, batch_id)`` with the metrics so far after every micro-batch."""

    def run(matrix: DataFrame, batch_id: int) -> None:
        publish(summary_metrics(class_metrics(matrix)), batch_id)

    writer = streaming_confusion(pixels).writeStream.outputMode("complete").foreachBatch(run)
    return writer.option("checkpointLocation", checkpoint_dir).trigger(**(trigger or {"availableNow": True})).start()


def merge_matrices(*matrices: DataFrame) -> DataFrame:
    """Sum of matrices computed elsewhere, such as per day or per shard."""
    merged = matrices[0]
    for matrix in matrices[1:]:
        merged = merged.unionByName(matrix)
    return merged.groupBy("target_id", "pred_id").agg(F.sum("pixels").alias("pixels"))
