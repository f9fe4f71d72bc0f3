"""Rasters as tables: blocks, windows, tiles, mosaics and aligned pixel joins.

Two layouts are used. ``pixels`` has one row per pixel (``scene_id, row_idx, col_idx`` and value
columns); ``blocks`` has one row per square block with one array per value in row-major order.
Blocks are what is stored: they join, filter and scan with a few thousand times fewer rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.functions import affine
from rasterweave.functions.scalars import ignored, round_half_even, tile_key
from rasterweave.functions.tiles import (
    check_layout,
    covering_tiles,
    last_tile,
    tile_start,
)
from rasterweave.taxonomy import class_name

BLOCK = 256
PIXEL_KEY = ("scene_id", "row_idx", "col_idx")
BLOCK_KEY = ("scene_id", "block_row", "block_col")


def raster_metadata(rasters: DataFrame) -> DataFrame:
    """Bounds and absolute pixel size next to ``width, height, crs``; a missing CRS is an error."""
    t = F.col("transform")
    crs = F.coalesce("crs", F.raise_error(F.lit("raster has no CRS")).cast("string"))
    return rasters.select(
        "scene_id",
        "width",
        "height",
        crs.alias("crs"),
        affine.bounds(t, F.col("width"), F.col("height")).alias("bounds"),
        F.abs(t["a"]).alias("pixel_width"),
        F.abs(t["e"]).alias("pixel_height"),
    )


# ------------------------------------------------------------------ blocks


def to_blocks(pixels: DataFrame, values: Sequence[str], size: int = BLOCK, rasters: DataFrame | None = None) -> DataFrame:
    """Gather pixels into blocks. Absent pixels become NULL elements.

    Blocks end where ``rasters`` (``scene_id, height, width``) says that the scene ends; without it
    they end at the last pixel present, which only suits layers without gaps at the edge. A group holds at most ``size * size`` pixels, however large the scene; duplicates of one
    position violate the raster model and are rejected.
    """
    if size <= 0:
        raise ValueError("block size must be positive")
    row, col = F.col("row_idx"), F.col("col_idx")
    in_block = ((row % size) * size + col % size).cast("int")
    grouped = (
        pixels.select(
            "scene_id",
            F.floor(row / size).cast("int").alias("block_row"),
            F.floor(col / size).cast("int").alias("block_col"),
            F.struct(in_block.alias("_at"), *values).alias("_p"),
        )
        .groupBy(*BLOCK_KEY)
        .agg(
            (F.floor(F.max("_p._at") / size) + 1).cast("int").alias("height"),
            (F.max(F.col("_p._at") % size) + 1).cast("int").alias("width"),
            F.collect_list("_p").alias("_cells"),
        )
    )
    if rasters is not None:
        ends = rasters.select("scene_id", F.col("height").alias("_rh"), F.col("width").alias("_rw"))
        beyond = F.raise_error(F.lit("a pixel lies outside its raster")).cast("int")
        height, width = (F.least(F.lit(size), F.col(n) - F.col(b) * size) for n, b in (("_rh", "block_row"), ("_rw", "block_col")))
        grouped = grouped.join(ends, "scene_id").withColumns(
            {
                "height": F.when(F.col("height") > height, beyond).otherwise(height.cast("int")),
                "width": F.when(F.col("width") > width, beyond).otherwise(width.cast("int")),
            }
        )
    cells_in_block = F.col("height") * F.col("width")
    positions = F.transform(
        F.sequence(F.lit(0), cells_in_block - 1),
        lambda i: (F.floor(i / F.col("width")) * size + i % F.col("width")).cast("int"),
    )
    missing = F.array_except(positions, F.col("_cells._at"))
    empty = [F.lit(None).cast(pixels.schema[v].dataType).alias(v) for v in values]
    filled = F.concat(
        F.col("_cells"), F.transform(missing, lambda i: F.struct(i.alias("_at"), *empty))
    )
    cells = F.when(F.size("_cells") == cells_in_block, F.col("_cells")).otherwise(filled)
    unique = F.when(F.size("_s") == cells_in_block, F.col("_s")).otherwise(
        F.raise_error(F.lit("two pixels at one position of a raster"))
    )
    return (
        grouped.withColumn("_s", F.array_sort(cells))
        .withColumn("_s", unique)
        .select(
            *BLOCK_KEY,
            (F.col("block_row") * size).alias("y_off"),
            (F.col("block_col") * size).alias("x_off"),
            "height",
            "width",
            *[F.col(f"_s.{v}").alias(v) for v in values],
        )
    )


def from_blocks(blocks: DataFrame, values: Sequence[str]) -> DataFrame:
    """Back to one row per pixel, inside one stage."""
    zipped = F.arrays_zip(*[F.col(v) for v in values])
    rows = blocks.select("scene_id", "y_off", "x_off", "width", F.posexplode(zipped).alias("_at", "_v"))
    return rows.select(
        "scene_id",
        (F.col("y_off") + F.floor(F.col("_at") / F.col("width"))).cast("long").alias("row_idx"),
        (F.col("x_off") + F.col("_at") % F.col("width")).cast("long").alias("col_idx"),
        *[F.col("_v")[v].alias(v) for v in values],
    )


def sort_for_storage(blocks: DataFrame) -> DataFrame:
    """Range-partition and sort so that Parquet statistics prune by scene and block."""
    return blocks.repartitionByRange(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY)


# ------------------------------------------------------------------ windows


def check_window(row_off: int, col_off: int, height: int, width: int, raster_height: int, raster_width: int) -> None:
    if row_off < 0 or col_off < 0:
        raise ValueError("window offsets must not be negative")
    if height <= 0 or width <= 0:
        raise ValueError("window size must be positive")
    if row_off + height > raster_height or col_off + width > raster_width:
        raise ValueError("window lies outside the raster")


def read_window(pixels: DataFrame, row_off: int, col_off: int, height: int, width: int) -> DataFrame:
    """Pixels of one window with offsets relative to it; a plain range filter on the scan."""
    inside = F.col("row_idx").between(row_off, row_off + height - 1) & F.col("col_idx").between(
        col_off, col_off + width - 1
    )
    return pixels.where(inside).withColumns(
        {"row_idx": F.col("row_idx") - row_off, "col_idx": F.col("col_idx") - col_off}
    )


def read_block_window(blocks: DataFrame, values: Sequence[str], row_off: int, col_off: int, height: int, width: int, size: int = BLOCK) -> DataFrame:
    """As :func:`read_window` over blocks: block ranges prune files before pixels are exploded."""
    touched = F.col("block_row").between(row_off // size, (row_off + height - 1) // size) & F.col(
        "block_col"
    ).between(col_off // size, (col_off + width - 1) // size)
    return read_window(from_blocks(blocks.where(touched), values), row_off, col_off, height, width)


# ------------------------------------------------------------------ aligned joins


def alignment_problems(left: DataFrame, right: DataFrame) -> DataFrame:
    """Scenes whose two rasters differ in shape, CRS or transform, with the first difference."""
    l, r = left.alias("l"), right.alias("r")
    joined = l.join(r, F.col("l.scene_id") == F.col("r.scene_id"), "full")
    shape = (F.col("l.width") != F.col("r.width")) | (F.col("l.height") != F.col("r.height"))
    problem = (
        F.when(F.col("l.scene_id").isNull() | F.col("r.scene_id").isNull(), "missing raster")
        .when(shape, "different shape")
        .when(~F.col("l.crs").eqNullSafe(F.col("r.crs")), "different crs")
        .when(F.col("l.transform") != F.col("r.transform"), "different transform")
    )
    return joined.select(
        F.coalesce("l.scene_id", "r.scene_id").alias("scene_id"), problem.alias("problem")
    ).where("problem IS NOT NULL")


def join_pixels(left: DataFrame, right: DataFrame, how: str = "aligned") -> DataFrame:
    """Equi-join two pixel tables of the same grid.

    ``aligned`` fails the job for a pixel that only one side has; other values of ``how`` are Spark's.
    """
    if how != "aligned":
        return left.join(right, list(PIXEL_KEY), how)
    both = left.withColumn("_own", F.lit(True)).join(right.withColumn("_other", F.lit(True)), list(PIXEL_KEY), "full")
    return both.where(F.when(F.col("_own") & F.col("_other"), True).otherwise(_unaligned())).drop("_own", "_other")


def join_blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join two block tables of the same grid: one shuffled row per block instead of per pixel.

    Blocks of one side only, or of different extent, fail the job; build sparse layers with the
    raster sizes, see :func:`to_blocks`.
    """
    extent = ("y_off", "x_off", "height", "width")
    other = right.withColumn("_other", F.struct(*extent)).drop(*extent)
    both = left.withColumn("_own", F.struct(*extent)).join(other, list(BLOCK_KEY), "full")
    same = F.coalesce(F.col("_own") == F.col("_other"), F.lit(False))
    return both.where(F.when(same, True).otherwise(_unaligned())).drop("_own", "_other")


def _unaligned() -> Column:
    return F.raise_error(F.lit("layers are not aligned")).cast("boolean")


# ------------------------------------------------------------------ tiles


def tiles(rasters: DataFrame, size: int, overlap: int) -> DataFrame:
    """One row per tile in row-major order: window, transform, bounds, id and ordinal.

    The ordinal is ``tile_row * tiles per row + tile_col``, so no window function is needed.
    """
    check_layout(size, overlap)
    last_row, last_col = last_tile(F.col("height"), size, overlap), last_tile(F.col("width"), size, overlap)
    rows = rasters.select("*", F.explode(F.sequence(F.lit(0), last_row)).alias("tile_row"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last_col)).alias("tile_col"))
    y = tile_start(F.col("tile_row"), F.col("height"), size, overlap)
    x = tile_start(F.col("tile_col"), F.col("width"), size, overlap)
    rows = rows.select(
        "scene_id",
        "crs",
        "tile_row",
        "tile_col",
        (F.col("tile_row") * (last_col + 1) + F.col("tile_col")).alias("tile_ord"),
        y.alias("row_off"),
        x.alias("col_off"),
        F.least(F.col("height"), F.lit(size)).cast("long").alias("tile_height"),
        F.least(F.col("width"), F.lit(size)).cast("long").alias("tile_width"),
        F.col("transform").alias("_t"),
    )
    moved = affine.window_transform(F.col("_t"), F.col("row_off"), F.col("col_off"))
    rows = rows.withColumn("transform", moved).drop("_t")
    return rows.withColumn(
        "bounds", affine.bounds(F.col("transform"), F.col("tile_width"), F.col("tile_height"))
    ).withColumn("tile_id", tile_key(F.col("tile_row"), F.col("tile_col")))


def assign_tiles(pixels: DataFrame, size: int, overlap: int, height: Column, width: Column) -> DataFrame:
    """Repeat each pixel once per tile that covers it (usually at most four), without a join."""
    rows = pixels.select(
        "*", F.explode(covering_tiles(F.col("row_idx"), height, size, overlap)).alias("tile_row")
    )
    rows = rows.select(
        "*", F.explode(covering_tiles(F.col("col_idx"), width, size, overlap)).alias("tile_col")
    )
    return rows.withColumn(
        "tile_ord", F.col("tile_row") * (last_tile(width, size, overlap) + 1) + F.col("tile_col")
    )


def mosaic(
    predictions: DataFrame,
    layout: tuple[int, int, Column, Column] | None = None,
    rasters: DataFrame | None = None,
) -> DataFrame:
    """Merge overlapping tile predictions: ``scene_id, row_idx, col_idx, pred_id, conf``.

    The most confident prediction wins and the earliest tile wins ties; NaN and values not above
    -1 never win. Cells without a winner get class 0 and confidence 0.

    ``layout = (size, overlap, height, width)`` lets pixels covered by a single tile bypass the
    shuffle. It reads the predictions twice, so use it on stored predictions. ``rasters`` adds
    the cells that no tile covers at all.
    """
    conf = F.col("conf")
    usable = conf.isNotNull() & ~F.isnan(conf) & (conf > -1.0)
    columns = [*PIXEL_KEY, "pred_id", "conf"]

    def settled(rows: DataFrame, winner: Column) -> DataFrame:
        found = rows.withColumn("_w", winner)
        return found.select(
            *PIXEL_KEY,
            F.coalesce("_w.pred_id", F.lit(0)).cast("int").alias("pred_id"),
            F.greatest(F.coalesce("_w.conf", F.lit(0.0)), F.lit(0.0)).alias("conf"),
        )

    candidate = F.when(
        usable, F.struct(conf.alias("conf"), (-F.col("tile_ord")).alias("tie"), F.col("pred_id"))
    )

    def contested(rows: DataFrame) -> DataFrame:
        best = rows.groupBy(*PIXEL_KEY).agg(F.max(candidate).alias("_best"))
        return settled(best, F.col("_best"))

    if layout is None:
        merged = contested(predictions)
    else:
        size, overlap, height, width = layout
        cover = F.size(covering_tiles(F.col("row_idx"), height, size, overlap)) * F.size(
            covering_tiles(F.col("col_idx"), width, size, overlap)
        )
        alone = predictions.where(cover == 1)
        shared = predictions.where(cover > 1)
        merged = settled(alone, candidate).select(*columns).unionByName(contested(shared))
    if rasters is None:
        return merged
    return full_grid(rasters).join(merged, list(PIXEL_KEY), "left").select(
        *PIXEL_KEY,
        F.coalesce("pred_id", F.lit(0)).alias("pred_id"),
        F.coalesce("conf", F.lit(0.0)).alias("conf"),
    )


def full_grid(rasters: DataFrame) -> DataFrame:
    """Every pixel position of every raster."""
    def positions(size: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(size).cast("long") - 1))

    rows = rasters.select("scene_id", "width", positions("height").alias("row_idx"))
    return rows.select("scene_id", "row_idx", positions("width").alias("col_idx"))


# ------------------------------------------------------------------ summaries


def class_histogram(pixels: DataFrame, value: str = "pred_id", by: Sequence[str] = ()) -> DataFrame:
    """Pixels per class, the no-data class included."""
    return pixels.groupBy(*by, F.col(value).alias("class_id")).agg(F.count("*").alias("pixel_count"))


def class_summary(pixels: DataFrame, value: str = "pred_id", conf: str = "conf") -> DataFrame:
    """Prediction summary of each scene: count, share, mean confidence and name of each class.

    Ordered for a reader by scene, then count descending, then id.
    """
    counts = pixels.groupBy("scene_id", F.col(value).alias("class_id")).agg(
        F.count("*").alias("pixel_count"), F.avg(conf).alias("_mean")
    )
    totals = counts.groupBy("scene_id").agg(F.sum("pixel_count").alias("_total"))
    return (
        counts.join(totals, "scene_id")
        .select(
            "scene_id",
            "class_id",
            class_name(F.col("class_id")).alias("class_name"),
            "pixel_count",
            round_half_even(F.col("pixel_count") / F.col("_total"), 4).alias("pixel_fraction"),
            round_half_even(F.col("_mean"), 4).alias("mean_confidence"),
        )
        .orderBy("scene_id", F.desc("pixel_count"), "class_id")
    )


def confidence_summary(pixels: DataFrame, conf: str = "conf", by: Sequence[str] = ("scene_id",), places: int | None = 4) -> DataFrame:
    """Mean, minimum and maximum confidence, rounded half to even (``places=None``: not rounded)."""

    def shown(value: Column, name: str) -> Column:
        return (value if places is None else round_half_even(value, places)).alias(name)

    return pixels.groupBy(*by).agg(
        shown(F.avg(conf), "mean"), shown(F.min(conf), "min"), shown(F.max(conf), "max")
    )


def with_nodata(value: Column, nodata, cast: str) -> Column:
    """Storage cast of a value column with NULL replaced by the no-data value."""
    return F.coalesce(value.cast(cast), F.lit(nodata).cast(cast))


def without_ignored(pixels: DataFrame, value: str, ignore_ids: tuple[int, ...] = (0,)) -> DataFrame:
    return pixels.where(~ignored(F.col(value), ignore_ids))
