"""Grids stored as NumPy files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from rasterweave.schemas import BLOCKS

_SCHEMA = f"path STRING, {BLOCKS}, confidence ARRAY<FLOAT>, error STRING"


def _decode(content: bytes) -> np.ndarray:
    grid = np.load(io.BytesIO(content), allow_pickle=False)
    if hasattr(grid, "files"):
        grid = grid["arr_0"]
    if grid.ndim != 2:
        raise ValueError(f"expected a two-dimensional grid, found {grid.ndim} dimensions")
    return grid.astype(np.float32)


def read_grids(spark: SparkSession, path: str, block: int = 256) -> DataFrame:
    """Blocks of all ``.npy`` and ``.npz`` grids below ``path``.

    The scene id is the number in the file name (NULL without one). A file that cannot be decoded
    yields one row with ``error`` set instead of failing the job. Each file is decoded in the task
    that reads it and leaves it as blocks, so no later stage holds a whole grid.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.np[yz]")
        .load(path)
        .selectExpr(
            "path", "try_cast(regexp_extract(path, '([0-9]+)[^0-9/]*$', 1) AS BIGINT) AS scene_id", "content"
        )
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                rows = []
                try:
                    grid = _decode(row.content)
                    for y in range(0, grid.shape[0], block):
                        for x in range(0, grid.shape[1], block):
                            cut = grid[y : y + block, x : x + block]
                            rows.append(
                                (row.path, row.scene_id, y // block, x // block, y, x, *cut.shape, cut.ravel(), None)
                            )
                except Exception as problem:  # any decode problem becomes a row
                    rows = [(row.path, row.scene_id, *[None] * 7, str(problem))]
                names = [f.strip().split(" ")[0] for f in f"path S, {BLOCKS}, confidence A, error S".split(", ")]
                yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, _SCHEMA)
