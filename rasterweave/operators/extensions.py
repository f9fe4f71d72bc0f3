"""Places where callers plug in their own code."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.operators import losses

Scorer = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def score_blocks(blocks: DataFrame, make_scorer: Callable[[], Scorer], bands: Sequence[str]) -> DataFrame:
    """Score image blocks: adds ``pred_id`` and ``conf`` arrays in row-major order.

    ``make_scorer`` is called once per task and returns a function from a
    ``(bands, height, width)`` array to class ids and confidences of that height and width, so a
    model is loaded once and then sees every block of the task. No shuffle.
    """
    kept = [c for c in blocks.columns if c not in bands]
    fields = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in kept)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make_scorer()
        for part in parts:
            classes, confs = [], []
            for row in part.to_dict("records"):
                stack = np.stack([np.asarray(row[b]).reshape(row["height"], row["width"]) for b in bands])
                class_id, conf = score(stack)
                classes.append(np.asarray(class_id, dtype=np.int32).ravel())
                confs.append(np.asarray(conf, dtype=np.float64).ravel())
            yield part[kept].assign(pred_id=classes, conf=confs)

    return blocks.mapInPandas(run, f"{fields}, pred_id ARRAY<INT>, conf ARRAY<DOUBLE>")


def apply_paired(image: DataFrame, mask: DataFrame | None, transform: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """Apply one transform to an image table and its mask table; the mask may be missing."""
    return transform(image), None if mask is None else transform(mask)


def grouped_metrics(pixels: DataFrame, metrics: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Evaluate named aggregate expressions over a prediction table, built in or user-made."""
    return pixels.groupBy(*by).agg(*[m.alias(name) for name, m in metrics.items()])


_LOSSES: dict[str, Callable[[losses.LossSpec], Column]] = {}


def register_loss(name: str, build: Callable[[losses.LossSpec], Column]) -> None:
    """Register a loss as an expression over the columns of ``losses.loss_terms``."""
    if name in losses.RECIPES or name in _LOSSES:
        raise ValueError(f"loss {name!r} is already registered")
    _LOSSES[name] = build


def build_loss(name: str, spec: losses.LossSpec | None = None) -> Column:
    """A registered loss, or a built-in one with the numbers of ``spec``."""
    spec = spec or losses.loss_spec()
    if name in _LOSSES:
        return _LOSSES[name](spec)
    return losses.combined(losses.loss_spec(name, spec.class_ids, spec.ignore_id, **spec.numbers))


def observed(df: DataFrame, name: str, *measures: Column) -> DataFrame:
    """Report aggregate ``measures`` to query listeners while ``df`` flows past."""
    return df.observe(name, *(measures or (F.count(F.lit(1)).alias("rows"),)))


def read_table(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", by: Sequence[str] = ()) -> None:
    """Store a table; each write appears completely or not at all."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)
