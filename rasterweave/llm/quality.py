"""Quality scores from compression: texts like the good ones compress better with their dictionary.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text is
compressed with each of them in chunks, so that the dictionary matters throughout a long text; the
difference of the two sizes over the size of the text becomes a probability by a logistic fit on
labelled texts that built no dictionary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.common import drop_states, worker_state

#: bytes compressed at a time, and bytes added to a text's size so that a few words decide little
CHUNK, PRIOR = 1024, 40


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries and the line ``offset + slope * difference`` in log odds."""

    good: bytes
    bad: bytes
    offset: float
    slope: float
    level: int = 3


def _compressors(good: bytes, bad: bytes, level: int) -> list:
    options = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
    return [
        zstandard.ZstdCompressor(
            level=level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO), **options
        )
        for d in (good, bad)
    ]


def _difference(text: str | None, pair: list) -> float:
    """(size with the bad dictionary - size with the good one) / (size of the text + PRIOR); 0 for no text."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    if not data:
        return 0.0
    good = bad = 0
    for start in range(0, len(data), CHUNK):
        piece = data[start : start + CHUNK]
        good += len(pair[0].compress(piece))
        bad += len(pair[1].compress(piece))
    return (bad - good) / (len(data) + PRIOR)


def _dictionary(texts: list[str], size: int) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    pieces = [d[i : i + CHUNK] for d in data for i in range(0, len(d), CHUNK)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:] or b"\n" * 8


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic regression in one variable by Newton's method; the good class weighs ``share``."""
    if len(set(y.tolist())) < 2:
        return (4.0 if y.sum() else -4.0) if len(y) else 0.0, 0.0
    weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum())
    scale = max(float(np.abs(x).max()), 1e-9)
    z = np.column_stack([np.ones_like(x), x / scale])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = z.T @ (z * (weight * p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - 1e-6 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1] / scale)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = 1500,
    dictionary: int = 262_144,
    level: int = 3,
) -> CompressionModel:
    """Build the dictionaries and the calibration.

    ``sample`` bounds the labelled ids taken of each class (those with the smallest hash; of rows
    with the same id, the smallest text counts); of those, whole texts are learnt from. Two thirds build the dictionary, the rest the calibration, in which the
    classes weigh as they do among all labelled texts. Rows without an id, text or
    label of 0 or 1 are not learnt from; an id labelled both ways or twice counts once, as its
    smaller label. Without labels every score is 0.5.
    """
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).alias("_y"))
    )
    # ids alone are joined and chosen; of the texts, only the chosen ones move
    ids = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("_id")).distinct()
    labelled = ids.join(known, "_id").withColumn("_h", F.xxhash64("_id"))
    sizes = {r[0]: r[1] for r in labelled.groupBy("_y").count().collect()}
    firsts = [labelled.where(F.col("_y") == y).orderBy("_h", "_id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(firsts[0].unionByName(firsts[1]))  # at most two samples of ids
    rows = (
        docs.where(F.length(text_col) > 0)
        .select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
        .join(chosen, "_id")
        .groupBy("_y", "_h", "_id")
        .agg(F.min("_t").alias("_t"))
        .collect()
    )
    rows.sort(key=lambda r: (r["_h"], str(r["_id"])))
    taken = {y: [r["_t"] for r in rows if r["_y"] == y] for y in (0, 1)}
    build = {y: [t for i, t in enumerate(ts) if i % 3] for y, ts in taken.items()}
    good, bad = _dictionary(build[1], dictionary), _dictionary(build[0], dictionary)
    pair = _compressors(good, bad, level)
    held = [(t, y) for y, ts in taken.items() for i, t in enumerate(ts) if i % 3 == 0]
    offset, slope = _logistic(
        np.array([_difference(t, pair) for t, _ in held], dtype=float), np.array([y for _, y in held], dtype=float),
        sizes.get(1, 0) / max(1, sum(sizes.values())),
    )
    return CompressionModel(good, bad, offset, slope, level)


def score(docs: DataFrame, model: CompressionModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is good, from its whole length.

    Null and empty texts get the probability of a difference of 0. Other columns pass unchanged; a
    column named ``out`` is replaced.
    """
    # two dictionaries of fixed size
    shared = docs.sparkSession.sparkContext.broadcast((model.good, model.bad, model.level))
    offset, slope = model.offset, model.slope

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = f"zstd-{hash(shared.value)}"
        drop_states("zstd-", key)
        pair = worker_state(key, lambda: _compressors(*shared.value))
        for texts in batches:
            odds = [offset + slope * _difference(t, pair) for t in texts]
            yield pd.Series([1 / (1 + math.exp(-min(max(o, -60.0), 60.0))) for o in odds], dtype="float64")

    return docs.withColumn(out, probability(F.col(text_col)))
