"""Helpers shared by the operators: stored intermediates, worker state, words and connected components."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.session import checkpoint_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes(range(256)).lower()
#: whether shuffle files are removed at the end of a query
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below the session's shared folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back, which also cuts its lineage.

    The write's shuffle files go when it has ended; else they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path, before = fresh_folder(spark, name), spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column name as Spark's parser takes it."""
    return "`" + name.replace("`", "``") + "`"


def boxed(df: DataFrame, *without: str, name: str = "row") -> DataFrame:
    """``df`` as one struct column, so that its columns' names cannot clash with helper columns."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns if c not in without]).alias(name))


def worker_state(key: str, make: Callable[[], object]):
    """An object kept by a Python worker from task to task, such as a loaded tokenizer."""
    kept = sys.__dict__.setdefault("_rasterweave_state", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def drop_states(prefix: str, but: str) -> None:
    """Forget this worker's objects of one kind, except the one in use."""
    kept = sys.__dict__.get("_rasterweave_state", {})
    for key in [k for k in kept if k.startswith(prefix) and k != but]:
        del kept[key]


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing of unsigned values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def native_words(text):
    """The words of :func:`words_of` as a native array column; null and empty texts have none."""
    split = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[\\x20\\x09-\\x0D]+")
    return F.filter(split, lambda w: w != "")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every endpoint of ``edges``; component is the smallest id it reaches.

    Alternates large-star and small-star steps, each of them one shuffle of the edges, until the
    edges no longer change; every step is stored, so a lost executor costs one step. An edge
    table without rows gives no rows; self loops name a node of its own component.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    nodes = stored(pairs.distinct(), "edges")
    current, before = nodes.where("u <> v"), None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        # large star: every larger neighbour is tied to the smallest node of the neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: a node and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("low").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")
        )
        current = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    alone = nodes.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    roots = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return alone.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
