"""Job documents and experiment protocols: JSON in, canonical JSON out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.functions.scalars import finite_or_null
from rasterweave.schemas import JOB, PROTOCOL

_NULLS = {"ignoreNullFields": "false"}


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """One row per job file: parsed columns, ``file_name``, ``corrupt`` text and ``problem``.

    A document whose id differs from its file name is flagged ``id_mismatch``, an unparsable one
    ``unreadable``; neither stops the read.
    """
    schema = f"{JOB}, corrupt STRING"
    rows = (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "corrupt")
        .option("pathGlobFilter", "*.json")
        .json(path)
        .select("*", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("file_name"))
    )
    problem = F.when(F.col("corrupt").isNotNull() | F.col("job_id").isNull(), "unreadable").when(
        F.col("job_id") != F.col("file_name"), "id_mismatch"
    )
    return rows.withColumn("problem", problem)


def canonical_job(jobs: DataFrame) -> DataFrame:
    """``job_id, doc``: compact JSON with sorted keys at every level.

    The opaque request members are texts that already hold JSON; they are parsed as variants,
    whose objects are kept in key order.
    """
    request = F.col("request")

    def opaque(name: str) -> Column:
        return F.try_parse_json(request[name]).alias(name)

    members = [opaque("aoi"), opaque("imagery_source"), opaque("metadata")]
    full = F.to_json(F.struct(*members), _NULLS)
    # metadata is written only when present
    slim = F.to_json(F.struct(*members[:2]), _NULLS)
    request_json = F.when(request["metadata"].isNull(), slim).otherwise(full)
    head = F.to_json(F.struct("created_at", "job_id"), _NULLS)
    tail = F.to_json(F.struct("revision", "state", "transitions", "updated_at"), _NULLS)
    body = F.concat(
        F.expr("substring(_head, 1, length(_head) - 1)"), F.lit(',"request":'), F.col("_request"), F.lit(","),
        F.expr("substring(_tail, 2)"),
    )
    return (
        jobs.withColumns({"_head": head, "_tail": tail, "_request": request_json})
        .select("job_id", body.alias("doc"))
    )


def write_lines(documents: DataFrame, path: str, column: str = "doc", mode: str = "errorifexists") -> None:
    """One JSON document per line; output files appear all at once through the commit protocol."""
    documents.select(F.col(column).alias("value")).write.mode(mode).text(path)


def strict_json(df: DataFrame, name: str = "doc") -> DataFrame:
    """Each row as JSON with sorted keys in which NaN and infinities are null."""
    columns = []
    for column in sorted(df.columns):
        kind = df.schema[column].dataType.simpleString()
        value = F.col(column)
        if kind in ("double", "float"):
            value = finite_or_null(value)
        elif kind in ("array<double>", "array<float>"):
            value = F.transform(value, finite_or_null)
        elif kind in ("map<string,double>", "map<string,float>"):
            value = F.transform_values(value, lambda _, v: finite_or_null(v))
        elif kind.startswith(("map<int,", "map<bigint,")):
            value = F.transform_keys(value, lambda k, _: k.cast("string"))
        columns.append(value.alias(column))
    return df.select(F.to_json(F.struct(*columns), _NULLS).alias(name))


def read_protocols(spark: SparkSession, path: str) -> DataFrame:
    """One row per benchmark and configured model; nested settings stay JSON texts."""
    rows = spark.read.schema(PROTOCOL).option("multiLine", "true").json(path)
    name = F.coalesce("benchmark_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))
    return rows.select(
        name.alias("benchmark_id"), F.explode("model_ids").alias("model_id"), "training", "data", "benchmark"
    )
