"""Pixel statistics of labelled samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.functions.scalars import ratio_or_zero
from rasterweave.session import checkpoint
from rasterweave.taxonomy import CLASS_IDS, IGNORE_ID, each_class


def unknown_labels(pixels: DataFrame, value: str = "target_id", class_ids: tuple[int, ...] = CLASS_IDS) -> DataFrame:
    """Values outside the taxonomy and the ignore id, with their pixel counts."""
    legal = (IGNORE_ID, *class_ids)
    return (
        pixels.where(~F.col(value).isin(*legal))
        .groupBy(F.col(value).alias("value"))
        .agg(F.count("*").alias("pixels"))
    )


def sample_class_counts(pixels: DataFrame, value: str = "target_id", strict: bool = False) -> DataFrame:
    """``sample_id, class_id, pixels`` including the ignore id: the only pass over the pixels.

    The row count is bounded by eight per sample, so everything after it is small.
    """
    label = F.col(value)
    if strict:
        message = F.concat(F.lit("unknown mask value "), label.cast("string"))
        known = label.isin(IGNORE_ID, *CLASS_IDS)
        label = F.when(known, label).otherwise(F.raise_error(message).cast("int"))
    return (
        pixels.select("sample_id", label.alias("class_id"))
        .groupBy("sample_id", "class_id")
        .agg(F.count("*").alias("pixels"))
    )


def sample_statistics(counts: DataFrame) -> DataFrame:
    """Totals, per-class counts and presence of each sample, one row per sample.

    ``counts`` comes from :func:`sample_class_counts`. Columns ``class_<id>`` hold the counts.
    """
    is_ignored = F.col("class_id") == IGNORE_ID
    zero = F.lit(0).cast("long")
    stats = counts.groupBy("sample_id").agg(
        F.sum("pixels").alias("total_pixels"),
        F.coalesce(F.sum(F.when(is_ignored, F.col("pixels"))), zero).alias("ignored_pixels"),
        *[
            F.coalesce(F.sum(F.when(F.col("class_id") == c, F.col("pixels"))), zero).alias(f"class_{c}")
            for c in CLASS_IDS
        ],
    )
    valid = F.col("total_pixels") - F.col("ignored_pixels")
    present = F.filter(
        F.array(*[F.when(F.col(f"class_{c}") > 0, F.lit(c)) for c in CLASS_IDS]),
        lambda c: c.isNotNull(),
    )
    return stats.select(
        "*",
        valid.alias("valid_pixels"),
        ratio_or_zero(valid, F.col("total_pixels")).alias("valid_fraction"),
        present.alias("present_classes"),
    )


def with_samples(stats: DataFrame, samples: DataFrame, include_unlabelled: bool = False) -> DataFrame:
    """Attach split and domain. ``include_unlabelled`` keeps samples without pixels as zero rows."""
    keys = samples.select("sample_id", "split", "domain")
    if not include_unlabelled:
        return keys.join(stats, "sample_id")
    joined = keys.join(stats, "sample_id", "left")
    numbers = [c for c in stats.columns if c not in ("sample_id", "present_classes")]
    return joined.select(
        *keys.columns,
        *[F.coalesce(c, F.lit(0).cast(stats.schema[c].dataType)).alias(c) for c in numbers],
        F.coalesce("present_classes", F.array().cast("array<int>")).alias("present_classes"),
    )


def dataset_totals(samples: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: samples, labelled samples and pixel totals. Unlabelled samples only count once."""
    labelled = stats.agg(
        F.count("*").alias("labelled_samples"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in ("total_pixels", "valid_pixels", "ignored_pixels")
        ],
    )
    return labelled.select(F.lit(samples.agg(F.count("*")).scalar()).alias("total_samples"), "*")


def _class_row(stats: DataFrame) -> DataFrame:
    """One row: valid pixels, labelled samples and an array of ``class_id, pixels, samples``."""
    sums = stats.agg(
        F.sum("valid_pixels").alias("valid"),
        F.count("*").alias("labelled"),
        *[F.coalesce(F.sum(f"class_{c}"), F.lit(0)).alias(f"p_{c}") for c in CLASS_IDS],
        *[F.count_if(F.col(f"class_{c}") > 0).alias(f"s_{c}") for c in CLASS_IDS],
    )
    entries = [
        F.struct(F.lit(c).alias("class_id"), F.col(f"p_{c}").alias("pixels"), F.col(f"s_{c}").alias("samples"))
        for c in CLASS_IDS
    ]
    return sums.select("valid", "labelled", F.array(*entries).alias("classes"))


def class_totals(stats: DataFrame) -> DataFrame:
    """``class_id, pixels, samples`` for every class, present or not."""
    return _class_row(stats).select(F.inline("classes"))


def class_frequencies(stats: DataFrame) -> DataFrame:
    """Pixel share of the valid pixels and sample share of the labelled samples, per class."""
    return _class_row(stats).select("valid", "labelled", F.inline("classes")).select(
        "class_id",
        "pixels",
        "samples",
        ratio_or_zero(F.col("pixels"), F.col("valid")).alias("pixel_frequency"),
        ratio_or_zero(F.col("samples"), F.col("labelled")).alias("sample_frequency"),
    )


def zero_filled(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per sample and class, zero where the class does not occur."""
    grid = samples.select("sample_id", each_class().alias("class_id"))
    return grid.join(counts, ["sample_id", "class_id"], "left").select(
        "sample_id", "class_id", F.coalesce("pixels", F.lit(0).cast("long")).alias("pixels")
    )


def statistics_report(samples: DataFrame, stats: DataFrame) -> DataFrame:
    """One JSON-ready row: totals plus id-keyed maps, seven entries each."""

    def as_map(column: str):
        entries = F.sort_array(F.collect_list(F.struct(F.col("class_id").cast("string"), F.col(column))))
        return F.map_from_entries(entries)

    # one pass over the pixels, however many parts of the report read the result
    stats = checkpoint(stats)
    per_class = class_frequencies(stats).agg(
        as_map("pixels").alias("class_pixel_counts"),
        as_map("samples").alias("class_sample_counts"),
        as_map("pixel_frequency").alias("class_pixel_frequencies"),
        as_map("sample_frequency").alias("class_sample_frequencies"),
    )
    totals = dataset_totals(samples, stats)
    # both sides are single rows
    return totals.join(F.broadcast(per_class), F.lit(True))
