"""Exact percentiles (linear interpolation) of groups of any size.

The built-in exact ``percentile`` keeps every distinct value of a group in one buffer. Here a
mergeable sketch first brackets each requested rank; one more pass counts what lies below the
bracket, and only the bracket's own values (about 4 / accuracy of the rows) are ranked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10000


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per key with one column per named probability, NULL values left out."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    margin = 2.0 / accuracy
    bounds = [
        F.percentile_approx("_v", F.lit(edge), F.lit(accuracy)).alias(f"_{side}_{i}")
        for i, p in enumerate(probabilities.values())
        for side, edge in (("lo", max(0.0, p - margin)), ("hi", min(1.0, p + margin)))
    ]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *bounds)
    brackets = sketch.select(
        *keys,
        "_n",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("_i"),
                        (F.lit(p) * (F.col("_n") - 1)).alias("_h"),
                        F.col(f"_lo_{i}").alias("_lo"),
                        F.col(f"_hi_{i}").alias("_hi"),
                    )
                    for i, p in enumerate(probabilities.values())
                ]
            )
        ).alias("_b"),
    ).select(*keys, "_b.*")
    placed = rows.join(brackets, list(keys)) if keys else rows.join(F.broadcast(brackets), F.lit(True))
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    group = [*keys, "_i"]
    around = placed.groupBy(*group).agg(
        F.first("_h").alias("_h"),
        F.count_if(v < lo).alias("_below"),
        F.count_if(v.between(lo, hi)).alias("_inside"),
        F.max(F.when(v < lo, v)).alias("_previous"),
        F.min(F.when(v > hi, v)).alias("_next"),
    )
    order = Window.partitionBy(*group).orderBy("_v")
    ranked = (
        placed.where(v.between(lo, hi))
        .groupBy(*group, "_v")
        .agg(F.count("*").alias("_c"))
        .withColumn("_end", F.sum("_c").over(order))
    )
    picked = ranked.join(around, group)

    def at(rank: Column) -> Column:
        inner = rank - F.col("_below")
        hit = (inner >= F.col("_end") - F.col("_c")) & (inner < F.col("_end"))
        return F.max(F.when(hit, F.col("_v")))

    low, high = F.floor("_h"), F.ceil("_h")
    hits = picked.groupBy(*group).agg(
        at(low).alias("_v0"),
        at(high).alias("_v1"),
        F.first("_h").alias("_h"),
        F.first("_below").alias("_below"),
        F.first("_inside").alias("_inside"),
        F.first("_previous").alias("_previous"),
        F.first("_next").alias("_next"),
    )

    def resolve(hit: str, rank: Column) -> Column:
        # the sketch brackets a rank up to one step, which is the neighbour just outside
        gap_below, gap_above = F.col("_below") - rank, rank - F.col("_below") - F.col("_inside")
        return (
            F.when(F.col(hit).isNotNull(), F.col(hit))
            .when(gap_below == 1, F.col("_previous"))
            .when(gap_above == 0, F.col("_next"))
            .otherwise(F.raise_error(F.lit("rank outside the sketch bracket")).cast("double"))
        )

    v0, v1 = resolve("_v0", low), resolve("_v1", high)
    result = hits.select(*group, (v0 + (F.col("_h") - low) * (v1 - v0)).alias("_p"))
    return result.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_p"))).alias(n) for i, n in enumerate(probabilities)]
    )
