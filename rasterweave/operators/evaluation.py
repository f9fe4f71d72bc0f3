"""Confusion matrices and the metrics derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.functions.scalars import ignored, normalise_domain, safe_divide
from rasterweave.operators.catalog import DOMAINS
from rasterweave.taxonomy import CLASS_IDS, IGNORE_ID, class_name

SCALARS = (
    "pixel_accuracy",
    "mean_class_accuracy",
    "mean_iou",
    "frequency_weighted_iou",
    "macro_precision",
    "macro_recall",
    "macro_f1",
)


def illegal_labels(
    pixels: DataFrame,
    target: str = "target_id",
    prediction: str = "pred_id",
    class_ids: Sequence[int] = CLASS_IDS,
    ignore_ids: Sequence[int] = (IGNORE_ID,),
) -> DataFrame:
    """Offending ``(side, value, pixels)``: unknown targets, and predictions that are no class.

    A prediction equal to an ignore id is an error even where the target is ignored.
    """
    sides = F.array(
        F.struct(
            F.lit("target").alias("side"),
            F.col(target).alias("value"),
            (~F.col(target).isin(*class_ids, *ignore_ids)).alias("bad"),
        ),
        F.struct(
            F.lit("prediction").alias("side"),
            F.col(prediction).alias("value"),
            (~F.col(prediction).isin(*class_ids)).alias("bad"),
        ),
    )
    return (
        pixels.select(F.inline(F.filter(sides, lambda s: s["bad"])))
        .groupBy("side", "value")
        .agg(F.count("*").alias("pixels"))
    )


def confusion(
    pixels: DataFrame,
    by: Sequence[str] = (),
    target: str = "target_id",
    prediction: str = "pred_id",
    class_ids: Sequence[int] = CLASS_IDS,
    ignore_ids: Sequence[int] = (IGNORE_ID,),
    strict: bool = False,
    count: Column | None = None,
) -> DataFrame:
    """Long confusion matrix ``[by.., target_id, pred_id, pixels]`` of the pixels with a target.

    ``count`` weighs rows that already stand for several pixels. The combine step runs on the map
    side, so at most classes squared rows per group and task are shuffled.
    """
    t, p = F.col(target), F.col(prediction)
    if overlap := set(ignore_ids) & set(class_ids):
        raise ValueError(f"ignore ids overlap class ids: {sorted(overlap)}")
    if strict:
        bad = ~t.isin(*class_ids, *ignore_ids) | ~p.isin(*class_ids)
        message = F.format_string("illegal label: target %s, prediction %s", t, p)
        pixels = pixels.where(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True))
    rows = pixels.where(~ignored(t, tuple(ignore_ids)))
    total = F.count("*") if count is None else F.sum(count)
    return rows.groupBy(*by, t.alias("target_id"), p.alias("pred_id")).agg(total.alias("pixels"))


def confusion_by_sample(pixels: DataFrame, **options) -> DataFrame:
    """Matrix per sample: at most classes squared rows per sample, the input of every roll-up."""
    return confusion(pixels, by=["sample_id"], **options)


def domain_confusion(per_sample: DataFrame, samples: DataFrame, with_overall: bool = True) -> DataFrame:
    """Matrices per domain and, as ``all``, over everything. Unknown domains fail the job.

    Joins the already counted rows to the manifest, never the pixels.
    """
    domain = normalise_domain(F.col("domain"))
    checked = F.when(domain.isin(*DOMAINS), domain).otherwise(
        F.raise_error(F.concat(F.lit("unsupported domain: "), F.coalesce(domain, F.lit("NULL"))))
    )
    joined = per_sample.join(samples.select("sample_id", checked.alias("domain")), "sample_id")
    if not with_overall:
        return joined.groupBy("domain", "target_id", "pred_id").agg(F.sum("pixels").alias("pixels"))
    sets = [["target_id", "pred_id"], ["domain", "target_id", "pred_id"]]
    return joined.groupingSets(sets, "domain", "target_id", "pred_id").agg(
        F.sum("pixels").alias("pixels")
    ).withColumn("domain", F.coalesce("domain", F.lit("all")))


def full_matrix(matrix: DataFrame, by: Sequence[str] = (), class_ids: Sequence[int] = CLASS_IDS) -> DataFrame:
    """Matrix with every cell of every group, zero where nothing was counted.

    A group gathers at most classes squared counters into a map, so the matrix, and the pixels
    behind it, are read once.
    """
    cell = F.struct("target_id", "pred_id")
    filled = matrix.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct(cell.alias("cell"), F.col("pixels")))).alias("_counts")
    )
    cells = F.array(
        *[
            F.struct(F.lit(t).alias("target_id"), F.lit(p).alias("pred_id"))
            for t in class_ids
            for p in class_ids
        ]
    )
    zero = F.lit(0).cast("long")
    rows = F.transform(
        cells,
        lambda c: F.struct(
            c["target_id"].alias("target_id"),
            c["pred_id"].alias("pred_id"),
            F.coalesce(F.try_element_at("_counts", c), zero).alias("pixels"),
        ),
    )
    return filled.select(*by, F.inline(rows))


def pivot_matrix(matrix: DataFrame, by: Sequence[str] = (), class_ids: Sequence[int] = CLASS_IDS) -> DataFrame:
    """Wide matrix: one row per target class, one column ``pred_<id>`` per predicted class."""
    sums = [
        F.coalesce(F.sum(F.when(F.col("pred_id") == c, F.col("pixels"))), F.lit(0)).alias(f"pred_{c}")
        for c in class_ids
    ]
    return matrix.groupBy(*by, "target_id").agg(*sums)


def class_metrics(matrix: DataFrame, by: Sequence[str] = (), class_ids: Sequence[int] = CLASS_IDS) -> DataFrame:
    """Per-class IoU, precision, recall and F1 for every class; undefined values are NULL."""
    n = F.col("pixels")
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("target_id") == F.col("pred_id"), n).otherwise(zero)
    parts = F.array(
        F.struct(
            F.col("target_id").alias("class_id"), hit.alias("tp"), n.alias("actual"), zero.alias("predicted")
        ),
        F.struct(
            F.col("pred_id").alias("class_id"), zero.alias("tp"), zero.alias("actual"), n.alias("predicted")
        ),
    )
    sums = full_matrix(matrix, by, class_ids).select(*by, F.inline(parts)).groupBy(*by, "class_id").agg(
        F.sum("tp").alias("tp"), F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted")
    )
    tp, actual, predicted = F.col("tp"), F.col("actual"), F.col("predicted")
    rated = sums.select(
        "*",
        safe_divide(tp, actual + predicted - tp).alias("iou"),
        safe_divide(tp, predicted).alias("precision"),
        safe_divide(tp, actual).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", safe_divide(2.0 * p * r, p + r)).withColumn(
        "class_name", class_name(F.col("class_id"))
    )


def summary_metrics(per_class: DataFrame, by: Sequence[str] = (), f1_zero: bool = False) -> DataFrame:
    """The scalar metrics of each group.

    Means skip undefined classes. A class with no hit but with actual and predicted pixels has no
    F1 and so drops out of ``macro_f1``; ``f1_zero`` counts it as 0 instead.
    """
    total = F.sum("actual")
    f1 = F.col("f1")
    if f1_zero:
        f1 = F.when(F.col("precision").isNotNull() & F.col("recall").isNotNull(), F.coalesce(f1, F.lit(0.0)))
    weighted = F.sum(F.col("actual") * F.coalesce("iou", F.lit(0.0)))
    result = per_class.groupBy(*by).agg(
        safe_divide(F.sum("tp"), total).alias("pixel_accuracy"),
        F.avg("recall").alias("mean_class_accuracy"),
        F.avg("iou").alias("mean_iou"),
        safe_divide(weighted, total).alias("frequency_weighted_iou"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg(f1).alias("macro_f1"),
        total.alias("valid_pixels"),
    )
    return result.withColumn("macro_dice", F.col("macro_f1"))


def metrics(matrix: DataFrame, by: Sequence[str] = (), class_ids: Sequence[int] = CLASS_IDS) -> DataFrame:
    """Scalar metrics straight from a long matrix."""
    return summary_metrics(class_metrics(matrix, by, class_ids), by)


def flatten_metrics(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per group and metric name."""
    names = [*SCALARS, "valid_pixels", "macro_dice"]
    values = [F.col(n).cast("double").alias(n) for n in names]
    if not by:
        summary = summary.withColumn("_one", F.lit(1))
    ids = list(by) or ["_one"]
    long = summary.select(*ids, *values).unpivot(ids, names, "metric", "value")
    return long if by else long.drop("_one")


def offending_examples(offenders: DataFrame, limit: int = 10) -> DataFrame:
    """Per side, the text of the smallest ``limit`` offending values, as shown in an error.

    Only those values are gathered: each is kept when fewer than ``limit`` distinct smaller ones
    exist, found by a bounded sort rather than by collecting the whole side.
    """
    first = None
    for side in ("target", "prediction"):
        part = (
            offenders.where(F.col("side") == side).select("side", "value").distinct().orderBy("value").limit(limit)
        )
        first = part if first is None else first.unionByName(part)
    shown = F.transform(F.array_sort(F.collect_list("value")), lambda v: v.cast("string"))
    return first.groupBy("side").agg(F.array_join(shown, ", ").alias("examples"))
