"""From areas of interest and stored imagery to regions, as one plan over blocks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.functions import affine
from rasterweave.operators.components import label_regions
from rasterweave.operators.extensions import Scorer, score_blocks
from rasterweave.operators.patches import mosaic_blocks, tile_windows
from rasterweave.operators.rasters import BLOCK
from rasterweave.operators.spatial import clip_blocks, clip_windows, in_raster_systems
from rasterweave.session import checkpoint


class Analysis(NamedTuple):
    """Result of :func:`analyse`; ``scene_id`` of both tables is the number of a crop."""

    #: ``scene_id, aoi_id, raster_id, height, width, crs, transform`` of each crop
    crops: DataFrame
    #: blocks with ``class_id``, ``conf`` and scene-wide ``labels``
    labelled: DataFrame


def analyse(
    blocks: DataFrame,
    aois: DataFrame,
    rasters: DataFrame,
    bands: Sequence[str],
    make_scorer: Callable[[], Scorer],
    tile: int = 512,
    overlap: int = 64,
    size: int = BLOCK,
    nodata=0,
) -> Analysis:
    """Clip, tile, score, merge and label; pixels stay in block arrays all the way.

    ``aois`` has ``aoi_id, scene_id, crs, ring, holes`` (in any known system), ``rasters`` has ``scene_id, crs,
    transform, height, width``, ``blocks`` the arrays ``bands``. Each pair of AOI and scene is a crop of its own:
    outside the polygon the scorer sees ``nodata``, and cells without imagery get class 0. AOIs that miss their
    scene make no crop. Measures, outlines and features come from ``labelled`` by
    :func:`components.region_measures_of_blocks` and :func:`components.outline_edges_of_blocks`.
    """
    bands = list(bands)
    windows = clip_windows(in_raster_systems(aois, rasters), rasters).join(rasters.select("scene_id", "crs"), "scene_id")
    # numbers are given once and kept, as everything below joins on them
    crops = checkpoint(windows.select(
        F.monotonically_increasing_id().alias("scene_id"), "aoi_id", F.col("scene_id").alias("raster_id"),
        (F.col("row_to") - F.col("row_from")).cast("int").alias("height"), (F.col("col_to") - F.col("col_from")).cast("int").alias("width"),
        "crs", affine.window_transform(F.col("transform"), F.col("row_from"), F.col("col_from")).alias("transform"),
    ))
    cut = clip_blocks(blocks, aois, rasters, bands, nodata, size).withColumnRenamed("scene_id", "raster_id")
    cut = cut.join(crops.select("scene_id", "aoi_id", "raster_id"), ["aoi_id", "raster_id"])
    tiles = tile_windows(cut, bands, crops, tile, overlap)
    merged = mosaic_blocks(score_blocks(tiles, make_scorer, bands), crops, size).withColumnRenamed("pred_id", "class_id")
    return Analysis(crops, label_regions(merged, size, keep=("conf",)))
