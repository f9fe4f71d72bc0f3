"""Sampling weights, weighted draws and fixed-size batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.functions.prefix import by_ordinal, first_rows, global_index, running
from rasterweave.functions.scalars import clip, unit_draw
from rasterweave.operators.statistics import class_frequencies
from rasterweave.session import checkpoint

STRATEGIES = ("uniform", "class_balanced", "domain_balanced", "class_domain_balanced")
VARIANTS = ("sample_frequency", "pixel_frequency")
# weights are drawn as whole multiples of this unit so that prefix sums are exact
WEIGHT_UNIT = 1e-6


def unmatched_samples(sample_ids: DataFrame, stats: DataFrame) -> DataFrame:
    """Requested ids for which no statistics exist."""
    return sample_ids.join(stats, "sample_id", "left_anti").select("sample_id")


def _as_map(df: DataFrame, key: str, value: str) -> Column:
    """Scalar subquery holding a small keyed table (classes or domains) as a map."""
    return df.agg(F.map_from_entries(F.collect_list(F.struct(key, value)))).scalar()


def class_rarity(stats: DataFrame, power: float, variant: str = "sample_frequency") -> DataFrame:
    """``class_id, weight``: rarity of each class; 1 for a class that never occurs."""
    frequencies = class_frequencies(stats)
    if variant == "pixel_frequency":
        f = F.col("pixel_frequency")
        weight = F.when(f > 0, F.pow(1.0 / f, F.lit(power)))
    else:
        f = F.col("sample_frequency")
        top = frequencies.agg(F.max("sample_frequency")).scalar()
        weight = F.when(f > 0, F.pow(top / f, F.lit(power))).otherwise(1.0)
    return frequencies.select("class_id", weight.alias("weight"))


def domain_rarity(samples: DataFrame, power: float, variant: str = "sample_frequency") -> DataFrame:
    """``domain, weight`` from the sample counts of each domain, unlabelled samples included."""
    counts = samples.groupBy("domain").agg(F.count("*").alias("n"))
    reference = F.sum("n") if variant == "pixel_frequency" else F.max("n")
    top = counts.agg(reference).scalar()
    return counts.select("domain", F.pow(top / F.col("n"), F.lit(power)).alias("weight"))


def sampling_weights(
    stats: DataFrame,
    samples: DataFrame,
    strategy: str = "class_balanced",
    class_power: float = 0.5,
    domain_power: float = 1.0,
    min_weight: float = 0.25,
    max_weight: float = 4.0,
    variant: str = "sample_frequency",
    all_samples: DataFrame | None = None,
) -> DataFrame:
    """``sample_id, weight`` with mean 1.

    ``stats`` are the per-sample statistics of the labelled samples. ``variant`` chooses how class
    rarity is measured; ``pixel_frequency`` also clips a second time after normalising.
    ``all_samples`` is the manifest the domain counts come from (default ``samples``).
    Class and domain tables have at most seven and two rows and enter as scalar maps: the plan
    over the samples has no join besides the one with the manifest.
    """
    limits = {
        "strategy": strategy in STRATEGIES,
        "variant": variant in VARIANTS,
        "class_power": class_power >= 0,
        "domain_power": domain_power >= 0,
        "min_weight": 0 < min_weight <= max_weight,
    }
    if not all(limits.values()):
        raise ValueError("out of range: " + ", ".join(name for name, fits in limits.items() if not fits))
    # the weights, the class rarity and the mean all read the statistics: compute them once
    stats = checkpoint(stats)
    rows = samples.select("sample_id", "domain").join(
        stats.select("sample_id", "present_classes"), "sample_id"
    )
    factor = F.lit(1.0)
    if strategy in ("class_balanced", "class_domain_balanced"):
        rarity = _as_map(class_rarity(stats, class_power, variant), "class_id", "weight")
        found = F.filter(
            F.transform("present_classes", lambda c: F.try_element_at(F.col("_rarity"), c)),
            lambda w: w.isNotNull(),
        )
        rows = rows.withColumn("_rarity", rarity)
        total = F.aggregate(found, F.lit(0.0), lambda s, w: s + w)
        factor = factor * F.when(F.size(found) > 0, total / F.size(found)).otherwise(1.0)
    if strategy in ("domain_balanced", "class_domain_balanced"):
        source = samples if all_samples is None else all_samples
        lookup = _as_map(domain_rarity(source, domain_power, variant), "domain", "weight")
        rows = rows.withColumn("_domains", lookup)
        factor = factor * F.element_at("_domains", F.col("domain"))
    rows = rows.select("sample_id", clip(factor, min_weight, max_weight).alias("weight"))
    if variant == "pixel_frequency":
        mean = rows.agg(F.avg("weight")).scalar()
        rows = rows.select("sample_id", clip(F.col("weight") / mean, min_weight, max_weight).alias("weight"))
    return rows.select("sample_id", (F.col("weight") / rows.agg(F.avg("weight")).scalar()).alias("weight"))


def weight_intervals(weights: DataFrame, chunk_size: int = 65536, key: str = "sample_id") -> DataFrame:
    """Half-open integer intervals ``[lo, hi)`` that tile the total weight in key order.

    The key must be an integer; the prefix sum runs chunk by chunk, never in one global window.
    """
    units = F.greatest(F.round(F.col("weight") / WEIGHT_UNIT).cast("long"), F.lit(1).cast("long"))
    rows = weights.select(key, units.alias("_units"))
    placed = running(
        rows, [], [key], by_ordinal(key, chunk_size), {"hi": ("sum", F.col("_units"))}
    )
    return placed.select(key, (F.col("hi") - F.col("_units")).alias("lo"), "hi")


def _div(a: Column, b: Column) -> Column:
    """Whole-number division, exact for positions that a double cannot hold."""
    return F.call_function("div", a, b)


def draw_with_replacement(
    intervals: DataFrame,
    draws: DataFrame,
    position: str = "position",
    buckets: int = 1024,
    key: str = "sample_id",
) -> DataFrame:
    """Match each draw's position in ``[0, total)`` to the interval that contains it.

    A range join turned into an equi-join on buckets of equal weight. A draw lies in one bucket
    and an interval is listed in each bucket it touches, so even one sample holding a third of the
    weight is spread over a third of the buckets.
    """
    if buckets <= 0:
        raise ValueError("buckets must be positive")
    intervals = checkpoint(intervals)
    total = intervals.agg(F.max("hi")).scalar()
    width = F.greatest(F.ceil(total / F.lit(buckets)), F.lit(1))
    sized = intervals.withColumn("_w", width)
    listed = sized.withColumn(
        "_bucket", F.explode(F.sequence(_div(F.col("lo"), F.col("_w")), _div(F.col("hi") - 1, F.col("_w"))))
    ).drop("_w")
    placed = draws.withColumn("_bucket", _div(F.col(position), width))
    inside = (F.col(position) >= F.col("lo")) & (F.col(position) < F.col("hi"))
    return placed.join(listed, "_bucket").where(inside).select(*draws.columns, key)


def weighted_sample(
    spark: SparkSession, weights: DataFrame, n: int, seed: int, buckets: int = 1024, key: str = "sample_id",
    draw: Column | None = None,
) -> DataFrame:
    """``n`` draws with replacement: ``draw_id, sample_id``; the same seed gives the same draws.

    ``draw`` replaces the hash of ``draw_id`` that falls on the total weight.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    intervals = checkpoint(weight_intervals(weights, key=key))
    total = intervals.agg(F.max("hi")).scalar()
    draws = spark.range(n).withColumnRenamed("id", "draw_id")
    draws = draws.withColumn("position", F.pmod(F.xxhash64(F.lit(seed), F.col("draw_id")) if draw is None else draw, total))
    return draw_with_replacement(intervals, draws, buckets=buckets, key=key).select("draw_id", key)


def uniform_sample(
    samples: DataFrame, seed: int, n: int | None = None, strategy: str = "uniform", key: str = "sample_id", draw: Column | None = None
) -> DataFrame:
    """A seeded permutation with its ``position``, or its first ``n`` rows. Only the uniform strategy
    may do without replacement. ``draw`` replaces the hash that rows are ordered by."""
    if strategy != "uniform":
        raise ValueError("sampling without replacement is only defined for the uniform strategy")
    order = [F.xxhash64(F.lit(seed), F.col(key)) if draw is None else draw, F.col(key)]
    indexed = global_index(samples, order, "position")
    return indexed if n is None else indexed.where(F.col("position") < n)


def weighted_top(weights: DataFrame, n: int, seed: int, key: str = "sample_id", draw: Column | None = None) -> DataFrame:
    """``n`` distinct samples, heavier ones more likely (exponential keys).

    ``draw`` replaces the hashed draw from 0 to 1.
    """
    unit = F.greatest(unit_draw(seed, F.col(key)) if draw is None else draw, F.lit(2.0**-60))
    ordered = weights.withColumn("_key", -F.ln(unit) / F.col("weight"))
    return first_rows(ordered, ["_key", key], n).drop("_key")


def batches(samples: DataFrame, size: int, drop_last: bool = False, key: str = "sample_id", chunk_size: int = 65536) -> DataFrame:
    """Number rows in key order and cut them into batches: adds ``index`` and ``batch``.

    ``key`` is an integer ordinal. ``drop_last`` leaves out an incomplete last batch.
    """
    if size <= 0:
        raise ValueError("batch size must be positive")
    rows = running(samples, [], [key], by_ordinal(key, chunk_size), {"_n": ("sum", F.lit(1).cast("long"))})
    rows = rows.withColumn("index", F.col("_n") - 1).drop("_n")
    rows = rows.withColumn("batch", F.floor(F.col("index") / size))
    if drop_last:
        full = F.floor(samples.agg(F.count("*")).scalar() / size)
        rows = rows.where(F.col("batch") < full)
    return rows


def first_samples(samples: DataFrame, n: int, order: list) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return first_rows(samples, order, n)
