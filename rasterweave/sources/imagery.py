"""Stored imagery: metadata, coverage, windows, tiles and acquisition times of a raster and a block table.

Another store takes part by giving the same two tables, however it reads them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.functions.scalars import file_stem, timestamp_in_name
from rasterweave.operators import rasters as R
from rasterweave.operators.spatial import coverage


@dataclass
class BlockImagery:
    """Imagery stored as a raster table and a block table."""

    rasters: DataFrame
    blocks: DataFrame
    values: tuple[str, ...]
    block: int = R.BLOCK

    def metadata(self) -> DataFrame:
        return R.raster_metadata(self.rasters)

    def coverage(self, aois: DataFrame) -> DataFrame:
        """Pairs of AOI and scene whose extents overlap in the scene's own system."""
        return coverage(aois, self.metadata())

    def window(self, row_off: int, col_off: int, height: int, width: int) -> DataFrame:
        """The same window of every scene; a scene that does not contain it fails the job."""
        limit = self.rasters.select("scene_id", F.col("height").alias("_rh"), F.col("width").alias("_rw"))
        R.check_window(row_off, col_off, height, width, row_off + height, col_off + width)
        outside = (F.col("_rh") < row_off + height) | (F.col("_rw") < col_off + width)
        checked = limit.where(
            F.when(outside, F.raise_error(F.lit("window lies outside the raster")).cast("boolean")).otherwise(True)
        ).select("scene_id")
        blocks = self.blocks.join(checked, "scene_id")
        return R.read_block_window(blocks, self.values, row_off, col_off, height, width, self.block)

    def windows(self, windows: DataFrame) -> DataFrame:
        """Pixels of ``window_id, scene_id, row_off, col_off, height, width``, each scene with windows of its own.

        ``row_idx`` and ``col_idx`` count from the window's corner. Windows become the blocks that they
        touch and meet the stored blocks by scene and place, so a large window is spread over its
        blocks. A window that is empty or leaves its scene fails the job, as does one of an unknown scene.
        """
        ends = self.rasters.select("scene_id", F.col("height").alias("_rh"), F.col("width").alias("_rw"))
        fits = F.expr(
            "row_off >= 0 AND col_off >= 0 AND height > 0 AND width > 0 AND row_off + height <= _rh AND col_off + width <= _rw"
        )
        bad = F.raise_error(F.lit("window lies outside the raster")).cast("boolean")
        rows = windows.join(ends, "scene_id", "left").where(F.when(F.coalesce(fits, F.lit(False)), True).otherwise(bad))
        rows = rows.select("window_id", "scene_id", "row_off", "col_off", F.expr("row_off + height").alias("_to"), F.expr("col_off + width").alias("_cto"))
        span = lambda a, b: F.explode(F.expr(f"sequence(cast({a} div {self.block} as int), cast(({b} - 1) div {self.block} as int))"))
        rows = rows.select("*", span("row_off", "_to").alias("block_row")).select("*", span("col_off", "_cto").alias("block_col"))
        met = self.blocks.join(rows, ["scene_id", "block_row", "block_col"])
        met = met.withColumn("scene_id", F.struct("window_id", "scene_id", "row_off", "col_off", "_to", "_cto"))
        pixels = R.from_blocks(met, list(self.values)).select("scene_id.*", "row_idx", "col_idx", *self.values)
        pixels = pixels.where("row_idx >= row_off AND row_idx < _to AND col_idx >= col_off AND col_idx < _cto")
        return pixels.select(
            "window_id", "scene_id", F.expr("row_idx - row_off").alias("row_idx"), F.expr("col_idx - col_off").alias("col_idx"), *self.values
        )

    def tiles(self, size: int, overlap: int) -> DataFrame:
        return R.tiles(self.rasters, size, overlap)

    def timestamps(self) -> DataFrame:
        """Acquisition time per scene from ``path`` and ``modified`` of the raster table."""
        return self.rasters.select(
            "scene_id", timestamp_in_name(file_stem(F.col("path")), F.col("modified")).alias("acquired_at")
        )
