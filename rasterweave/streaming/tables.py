"""Helpers to run a stream over stored tables until it has caught up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.session import checkpoint_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def rocksdb_session(spark: SparkSession) -> SparkSession:
    """A session with the state store that arbitrary stateful processing needs; others keep theirs."""
    if "RocksDB" in (spark.conf.get(_PROVIDER, None) or ""):
        return spark
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set(_PROVIDER, ROCKSDB)
    return own


def stream_folder(spark: SparkSession, name: str | None = None) -> str:
    """Where a stream keeps rows and progress; with the same ``name`` it continues after a restart."""
    return f"{checkpoint_folder(spark)}/streams/{name or uuid.uuid4()}"


def stream_table(spark: SparkSession, folder: str, table: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stored table as a stream of its files, whether it is one file or a folder of them."""
    path = f"{folder}/{table}.parquet"
    stored = spark.read.parquet(path)
    reader = spark.readStream.schema(stored.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if all(f.rstrip("/").endswith(f"/{table}.parquet") for f in stored.inputFiles()):  # a file, not a folder
        return reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    return reader.parquet(path)


def run_to_table(stream: DataFrame, name: str | None = None) -> DataFrame:
    """Process everything available and return the appended rows as a table.

    Output and progress log live in the shared checkpoint folder. A lost executor is made up for; a
    restart continues where the stream stopped if it is given the same ``name``.
    """
    spark, base = stream.sparkSession, stream_folder(stream.sparkSession, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def run_to_latest(stream: DataFrame, keys: list[str], name: str | None = None) -> DataFrame:
    """Process everything available and return the last version of each key of an aggregate.

    Every batch stores the groups it changed under its own number, open windows included.
    """
    spark, base = stream.sparkSession, stream_folder(stream.sparkSession, name)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{base}/rows/n={batch_id}")

    writer = stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{base}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(stream.schema.add("_batch", "long")).parquet(f"{base}/rows/*")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in values])
