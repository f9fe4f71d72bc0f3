"""New imagery as a stream: score arriving tiles and keep what each batch contributes to the mosaic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterweave.operators.rasters import PIXEL_KEY, mosaic

WINNER = "scene_id BIGINT, row_idx BIGINT, col_idx BIGINT, tile_ord BIGINT, pred_id INT, conf DOUBLE"


def batch_winners(scored: DataFrame) -> DataFrame:
    """The prediction of each pixel that can still win, with its tile's ordinal, and every pixel met.

    Ties keep the earliest tile, and a pixel without a usable prediction is kept as one, so the
    mosaic of winners is that of all predictions, in whatever order the batches came.
    """
    usable = F.col("conf").isNotNull() & ~F.isnan("conf") & (F.col("conf") > -1.0)
    rank = F.when(usable, F.struct(F.col("conf"), (-F.col("tile_ord")).alias("tie"), F.col("pred_id")))
    best = scored.groupBy(*PIXEL_KEY).agg(F.max(rank).alias("w"))
    ordinal = (-F.col("w.tie")).cast("long").alias("tile_ord")
    return best.select(*PIXEL_KEY, ordinal, F.col("w.pred_id").alias("pred_id"), F.col("w.conf").alias("conf"))


def merged_mosaic(winners: DataFrame) -> DataFrame:
    """The mosaic so far, from the winners of all batches."""
    return mosaic(winners)


def start_scoring(
    tiles: DataFrame, score: Callable[[DataFrame], DataFrame], folder: str, checkpoint_dir: str, **trigger
) -> StreamingQuery:
    """Score each micro-batch of tile pixels and store its winners below ``folder``.

    ``score`` maps tile pixels to ``pred_id, conf``. A batch writes one partition under its own
    number, so repeating it after a restart replaces its rows and nothing else is rewritten.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch_winners(score(batch)).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    writer = tiles.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_dir)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_mosaic(tiles: DataFrame, folder: str) -> DataFrame:
    """The mosaic of everything stored so far; ``tiles`` names the session."""
    return merged_mosaic(tiles.sparkSession.read.schema(WINNER).parquet(f"{folder}/*"))
