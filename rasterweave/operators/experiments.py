"""Experiment histories: monitoring, early stopping, ranking and latency reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.functions.percentiles import exact_percentiles
from rasterweave.functions.prefix import by_ordinal, global_index, running
from rasterweave.functions.scalars import finite_or_null, ratio_or_zero, safe_divide
from rasterweave.session import checkpoint

MODES = ("min", "max")
# Phases of an epoch result and the checkpoint schema version understood.
PHASES = ("train", "val")
CHECKPOINT_SCHEMA_VERSION = 1
CHECKPOINT_KEYS = (
    "engine_state",
    "extra",
    "metadata",
    "metrics",
    "model_metadata",
    "model_state",
    "optimizer_state",
    "scaler_state",
    "scheduler_state",
    "schema_version",
    "training_config",
)

FOLD_EPOCHS = 20_000


def monitor_values(results: DataFrame, monitor: str = "loss") -> DataFrame:
    """``experiment_id, epoch, metric``: the monitored value of val if present, else of train.

    ``results`` has ``experiment_id, epoch, phase, loss, metrics`` (a map). A missing or
    non-finite value fails the job.
    """
    raw = F.col("loss") if monitor == "loss" else F.try_element_at("metrics", F.lit(monitor))
    good = finite_or_null(raw.cast("double"))
    message = F.format_string(f"no finite {monitor} in experiment %s epoch %s",
                              F.col("experiment_id").cast("string"), F.col("epoch").cast("string"))
    has_val = F.max(F.when(F.col("phase") == "val", 1).otherwise(0)).alias("_val")
    picked = results.groupBy("experiment_id", "epoch").agg(
        has_val,
        F.max(F.when(F.col("phase") == "val", good)).alias("_v"),
        F.max(F.when(F.col("phase") == "train", good)).alias("_t"),
    )
    value = F.when(F.col("_val") == 1, F.col("_v")).otherwise(F.col("_t"))
    return picked.select(
        "experiment_id", "epoch", F.coalesce(value, F.raise_error(message).cast("double")).alias("metric")
    )


def improvements(epochs: DataFrame, mode: str = "max", chunk: int = 65536) -> DataFrame:
    """Per epoch, the best value so far and whether the epoch improved it (no tolerance)."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    rows = running(
        epochs, ["experiment_id"], ["epoch"], by_ordinal("epoch", chunk),
        {"previous_best": (mode, F.col("metric"))}, inclusive=False,
    )
    better = F.col("metric") > F.col("previous_best") if mode == "max" else F.col("metric") < F.col("previous_best")
    return rows.withColumn("improved", F.coalesce(better, F.lit(True)))


_STATE = "struct<best: double, best_epoch: bigint, streak: bigint, stopped: bigint, seen: bigint>"


def _advance(mode: str, min_delta: float, patience: int | None):
    """Fold step over ``(epoch, metric)``: the tracker state after one more epoch."""

    def step(s: Column, e: Column) -> Column:
        v = e["metric"]
        gain = v < s["best"] - min_delta if mode == "min" else v > s["best"] + min_delta
        improved = F.coalesce(gain, F.lit(True))
        streak = F.when(improved, 0).otherwise(s["streak"] + 1).cast("long")
        stop = F.lit(False) if patience is None else streak > patience
        after = F.struct(
            F.when(improved, v).otherwise(s["best"]).alias("best"),
            F.when(improved, e["epoch"]).otherwise(s["best_epoch"]).alias("best_epoch"),
            streak.alias("streak"),
            F.when(stop, e["epoch"]).cast("long").alias("stopped"),
            (s["seen"] + 1).alias("seen"),
        )
        return F.when(s["stopped"].isNotNull(), s).otherwise(after)

    return step


def track_best(
    epochs: DataFrame,
    mode: str = "max",
    min_delta: float = 0.0,
    patience: int | None = None,
    limit: int = FOLD_EPOCHS,
) -> DataFrame:
    """Best epoch and early stop of each experiment.

    An epoch improves when it beats the best by more than ``min_delta``; the first always does. A
    run stops once more than ``patience`` epochs in a row bring nothing, and later epochs do not
    count. Returns ``experiment_id, best_epoch, best_metric, stopped_epoch, epochs_run``.

    The rule depends on every earlier decision, so it is a fold over the epochs in order. A fold
    sees at most ``limit`` epochs: longer histories are cut by epoch number and the tracker state,
    one row per experiment, is handed from slice to slice.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if min_delta < 0 or (patience is not None and patience < 0):
        raise ValueError("min_delta and patience must not be negative")
    step = _advance(mode, min_delta, patience)
    start = F.struct(
        F.lit(None).cast("double").alias("best"), F.lit(None).cast("long").alias("best_epoch"),
        F.lit(0).cast("long").alias("streak"), F.lit(None).cast("long").alias("stopped"),
        F.lit(0).cast("long").alias("seen"),
    )
    rows = epochs.select("experiment_id", F.col("epoch").cast("long").alias("epoch"), F.col("metric").cast("double").alias("metric"))
    span = rows.agg(F.min("epoch").alias("a"), F.max("epoch").alias("b")).first()
    first, last = (span["a"] or 0) // limit, (span["b"] or 0) // limit
    state = None
    for number in range(first, last + 1):
        part = rows if first == last else rows.where(F.floor(F.col("epoch") / limit) == number)
        grouped = part.groupBy("experiment_id").agg(
            F.array_sort(F.collect_list(F.struct("epoch", "metric"))).alias("_e")
        )
        if state is None:
            folded = grouped.select("experiment_id", F.aggregate("_e", start, step).alias("s"))
        else:
            joined = state.join(grouped, "experiment_id", "full")
            events = F.coalesce("_e", F.array().cast("array<struct<epoch: bigint, metric: double>>"))
            folded = joined.select(
                "experiment_id", F.aggregate(events, F.coalesce("s", start), step).alias("s")
            )
        state = folded if first == last else checkpoint(folded)
    return state.select(
        "experiment_id",
        F.col("s.best_epoch").alias("best_epoch"),
        F.col("s.best").alias("best_metric"),
        F.col("s.stopped").alias("stopped_epoch"),
        F.col("s.seen").alias("epochs_run"),
    )


def epoch_losses(parts: DataFrame) -> DataFrame:
    """Sample-weighted mean loss per experiment, epoch and phase; 0 without samples."""
    return parts.groupBy("experiment_id", "epoch", "phase").agg(
        ratio_or_zero(F.sum(F.col("loss") * F.col("samples")), F.sum("samples")).alias("loss"),
        F.sum("samples").alias("samples"),
    )


def latency_report(
    latencies: DataFrame, batch_size: int = 1, keys: Sequence[str] = ("model_id",), exact: bool = True
) -> DataFrame:
    """Mean, median, 95th percentile (linear interpolation) and throughput per model.

    ``exact=False`` uses a sketch with a rank error of at most 1 in 10000.
    """
    if batch_size <= 0:
        raise ValueError("batch size must be positive")
    mean = F.avg("latency_ms")
    base = latencies.groupBy(*keys).agg(
        F.count("*").alias("batches"),
        mean.alias("mean_ms"),
        safe_divide(F.lit(batch_size), mean / 1000.0).alias("images_per_second"),
        *(
            []
            if exact
            else [
                F.percentile_approx("latency_ms", p, 10000).alias(n)
                for n, p in (("median_ms", 0.5), ("p95_ms", 0.95))
            ]
        ),
    )
    if not exact:
        return base
    quantiles = exact_percentiles(latencies, keys, "latency_ms", {"median_ms": 0.5, "p95_ms": 0.95})
    return base.join(quantiles, list(keys))


def best_results(results: DataFrame, mode: str = "max") -> DataFrame:
    """Best monitored value of each model and the epoch it came from (earliest on ties)."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    signed = F.col("metric") if mode == "max" else -F.col("metric")
    best = F.max_by(F.struct("metric", "epoch"), F.struct(signed, -F.col("epoch")))
    return results.groupBy("model_id").agg(best.alias("_b")).select(
        "model_id", F.col("_b.metric").alias("best_metric"), F.col("_b.epoch").alias("best_epoch")
    )


def rank_models(best: DataFrame, mode: str = "max") -> DataFrame:
    """Add a dense ``rank`` over ``best_metric`` without a window over all models.

    The distinct metric values are numbered by a range-partitioned sort and joined back.
    """
    order = F.col("best_metric").desc() if mode == "max" else F.col("best_metric").asc()
    places = global_index(best.select("best_metric").distinct(), [order], "_place")
    return best.join(places, "best_metric").select(
        *best.columns, (F.col("_place") + 1).alias("rank")
    )


def epoch_problems(results: DataFrame) -> DataFrame:
    """Rule violations of epoch results as ``(experiment_id, epoch, problem)``."""
    counters = ("samples", "batches", "optimizer_steps", "global_step", "skipped_batches")
    problems = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("phase").isin(*PHASES), F.lit(False)), "phase"),
            F.when(F.col("epoch") < 0, "epoch"),
            *[F.when(F.col(c) < 0, c) for c in counters],
            F.when(finite_or_null(F.col("loss")).isNull(), "loss"),
        )
    )
    return results.select("experiment_id", "epoch", F.explode(problems).alias("problem"))


def checkpoint_problems(metadata: DataFrame) -> DataFrame:
    """Add ``errors`` to checkpoint metadata rows, in checking order."""
    value = F.col("best_metric")
    return metadata.withColumn(
        "errors",
        F.array_compact(
            F.array(
                F.when(F.size(F.array_except(F.array(*[F.lit(k) for k in CHECKPOINT_KEYS]), F.col("keys"))) > 0, "missing_keys"),
                F.when(~F.col("schema_version").eqNullSafe(F.lit(CHECKPOINT_SCHEMA_VERSION)), "schema_version"),
                F.when(F.col("epoch") < 0, "epoch"),
                F.when(F.col("global_step") < 0, "global_step"),
                F.when(value.isNotNull() & finite_or_null(value).isNull(), "best_metric"),
                F.when(F.col("metric_name").isNotNull() & (F.trim("metric_name") == ""), "metric_name"),
            )
        ),
    )
