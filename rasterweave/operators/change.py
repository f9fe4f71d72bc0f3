"""Semantic change between two dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.functions.prefix import running, shifted
from rasterweave.functions.scalars import ignored, ratio_or_zero, transition_key
from rasterweave.operators.rasters import join_pixels


def pair_dates(before: DataFrame, after: DataFrame, value: str = "class_id") -> DataFrame:
    """Pixels of both dates side by side as ``before_id`` and ``after_id``."""
    return join_pixels(
        before.withColumnRenamed(value, "before_id"), after.withColumnRenamed(value, "after_id")
    )


def flag_changes(pairs: DataFrame, ignore_ids: tuple[int, ...] = (0,)) -> DataFrame:
    """Add ``valid`` (no side ignored) and ``changed``."""
    b, a = F.col("before_id"), F.col("after_id")
    valid = ~ignored(b, ignore_ids) & ~ignored(a, ignore_ids)
    return pairs.withColumn("valid", valid).withColumn("changed", F.col("valid") & (b != a))


def change_summary(pairs: DataFrame, by: Sequence[str] = ("scene_id",), ignore_ids: tuple[int, ...] = (0,)) -> DataFrame:
    """Changed and valid pixels and their ratio (0 without valid pixels)."""
    counts = flag_changes(pairs, ignore_ids).groupBy(*by).agg(
        F.count_if("changed").alias("changed_pixels"), F.count_if("valid").alias("total_valid_pixels")
    )
    return counts.withColumn(
        "changed_fraction", ratio_or_zero(F.col("changed_pixels"), F.col("total_valid_pixels"))
    )


def transitions(pairs: DataFrame, by: Sequence[str] = ("scene_id",), ignore_ids: tuple[int, ...] = (0,)) -> DataFrame:
    """Pixels per ``before->after`` pair of the changed pixels."""
    return (
        flag_changes(pairs, ignore_ids)
        .where("changed")
        .groupBy(*by, "before_id", "after_id")
        .agg(F.count("*").alias("pixels"))
        .withColumn("transition", transition_key(F.col("before_id"), F.col("after_id")))
    )


def transition_map(counts: DataFrame, by: Sequence[str] = ("scene_id",)) -> DataFrame:
    """One map per scene; its size is bounded by the squared class count."""
    entries = F.sort_array(F.collect_list(F.struct("transition", "pixels")))
    return counts.groupBy(*by).agg(F.map_from_entries(entries).alias("transitions"))


def change_mask(pairs: DataFrame, ignore_ids: tuple[int, ...] = (0,)) -> DataFrame:
    """Mask with 1 for a changed pixel and 0 otherwise."""
    return flag_changes(pairs, ignore_ids).select(
        "scene_id", "row_idx", "col_idx", F.col("changed").cast("int").alias("class_id")
    )


def class_ids_seen(pairs: DataFrame) -> DataFrame:
    """Classes present at either date."""
    return (
        pairs.select(F.explode(F.array("before_id", "after_id")).alias("class_id")).distinct()
    )


def pair_acquisitions(images: DataFrame, time: str = "acquired_at", chunk_seconds: int = 86400) -> DataFrame:
    """Match each image of a scene with the one acquired just before it.

    Scenes are split into time chunks, so a scene with a third of all images is not one task.
    """
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    chunk = F.floor(seconds / F.lit(chunk_seconds * 1_000_000)).cast("long")
    return shifted(
        images, ["scene_id"], [time, "image_id"], chunk,
        {"before_image_id": F.col("image_id"), "before_acquired_at": F.col(time)},
    )


def nearest_acquisitions(
    requests: DataFrame, images: DataFrame, tolerance_seconds: float | None = None, time: str = "acquired_at", chunk_seconds: int = 86400
) -> DataFrame:
    """As-of pairing: each requested date with the image of its scene before it, after it and nearest to it.

    ``requests`` has ``request_id, scene_id, requested_at``, ``images`` has ``image_id, scene_id`` and ``time``.
    An image of the very date is both before and after it. Of images taken at one time the largest id
    is the one before, the smallest the one after; of two equally near images the earlier one is
    nearest. Images further away than the tolerance do not count; a date without an image has NULLs.
    Both tables are merged in order of time and cut into chunks of time, which hand on one image each.
    """
    if tolerance_seconds is not None and tolerance_seconds < 0:
        raise ValueError("tolerance must not be negative")
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    kind = dict(images.dtypes)["image_id"]
    none = F.lit(None).cast(f"struct<at: bigint, image_id: {kind}>")
    seen = F.struct(at(time).alias("at"), "image_id")
    rows = requests.select("scene_id", at("requested_at").alias("_at"), "request_id", "requested_at", none.alias("_image"))
    shots = images.where(F.col(time).isNotNull()).select(
        "scene_id", at(time).alias("_at"), seen.alias("_image"), F.col(time).alias("_time")
    )
    rows = rows.unionByName(shots.drop("_time"), allowMissingColumns=True).withColumn("_request", F.col("_image").isNull())
    chunk = F.floor(F.col("_at") / F.lit(chunk_seconds * 1_000_000)).cast("long")
    # images of a date come before its requests in either direction
    rows = running(rows, ["scene_id"], ["_at", "_request"], chunk, {"_before": ("max", F.col("_image"))})
    rows = running(rows, ["scene_id"], [F.desc("_at"), "_request"], -chunk, {"_after": ("min", F.col("_image"))})
    most = None if tolerance_seconds is None else F.lit(int(tolerance_seconds * 1_000_000))

    def within(name: str, gap: Column) -> Column:
        return F.col(name) if most is None else F.when(gap <= most, F.col(name))

    back, ahead = F.col("_at") - F.col("_before.at"), F.col("_after.at") - F.col("_at")
    rows = rows.where("_request").select("request_id", "scene_id", "requested_at", "_at", within("_before", back).alias("b"), within("_after", ahead).alias("a"))
    earlier = F.col("a").isNull() | (F.col("_at") - F.col("b.at") <= F.col("a.at") - F.col("_at"))
    nearest = F.when(F.col("b").isNotNull() & earlier, F.col("b")).otherwise(F.col("a"))
    named = {"before": F.col("b"), "after": F.col("a"), "nearest": nearest}
    return rows.select(
        "request_id", "scene_id", "requested_at",
        *[c for n, s in named.items() for c in (s["image_id"].alias(f"{n}_image_id"), F.timestamp_micros(s["at"]).alias(f"{n}_acquired_at"))],
    )


def latest_acquisition(images: DataFrame, time: str = "acquired_at") -> DataFrame:
    """Latest image of each scene: an aggregate, not a window."""
    place = F.struct(F.col(time), F.col("image_id"))
    return images.groupBy("scene_id").agg(F.max(place).alias("_last")).select(
        "scene_id", F.col("_last.image_id").alias("image_id"), F.col(f"_last.{time}").alias(time)
    )
