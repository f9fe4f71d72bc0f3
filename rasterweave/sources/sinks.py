"""Feature, raster and report outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.functions.geometry import coordinates
from rasterweave.operators.rasters import sort_for_storage, with_nodata

_NULLS = {"ignoreNullFields": "false"}


def _polygon(rings: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), F.transform(rings, coordinates).alias("coordinates"))


def feature_lines(features: DataFrame) -> DataFrame:
    """One GeoJSON Feature per row.

    ``features`` has ``scene_id, region_id, rings, class_id, area_m2, mean_confidence, crs``.
    """
    properties = F.struct("class_id", "area_m2", "mean_confidence", "crs")
    feature = F.struct(
        F.lit("Feature").alias("type"), _polygon(F.col("rings")).alias("geometry"), properties.alias("properties")
    )
    return features.select("scene_id", "region_id", F.to_json(feature, _NULLS).alias("doc"))


def change_lines(features: DataFrame) -> DataFrame:
    """One GeoJSON Feature per changed region."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        _polygon(F.col("rings")).alias("geometry"),
        F.struct(F.lit(True).alias("changed")).alias("properties"),
    )
    return features.select("scene_id", "region_id", F.to_json(feature, _NULLS).alias("doc"))


def collection_headers(features: DataFrame, crs: DataFrame, transitions: DataFrame | None = None) -> DataFrame:
    """Collection-level properties per scene: feature count, CRS and, for changes, transitions.

    Features stay newline-delimited; this row is what a reader needs to treat them as one
    collection.
    """
    counts = features.groupBy("scene_id").agg(F.count("*").alias("feature_count"))
    rows = crs.select("scene_id", "crs").join(counts, "scene_id", "left").withColumn(
        "feature_count", F.coalesce("feature_count", F.lit(0).cast("long"))
    )
    members: list[str] = ["crs", "feature_count"]
    if transitions is not None:
        rows = rows.join(transitions, "scene_id", "left").withColumn(
            "transitions", F.coalesce("transitions", F.create_map().cast("map<string,bigint>"))
        )
        members.append("transitions")
    header = F.struct(F.lit("FeatureCollection").alias("type"), F.struct(*members).alias("properties"))
    return rows.select("scene_id", F.to_json(header, _NULLS).alias("doc"))


def collections(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """One FeatureCollection document per scene, for scenes small enough to be one value."""
    gathered = lines.groupBy("scene_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region_id", "doc"))), lambda r: r["doc"]), ",").alias("_f")
    )
    body = F.concat(
        F.expr("substring(doc, 1, length(doc) - 1)"), F.lit(',"features":['), F.coalesce("_f", F.lit("")), F.lit("]}")
    )
    return headers.join(gathered, "scene_id", "left").select("scene_id", body.alias("doc"))


# Storage type and no-data value of each raster product.
PRODUCTS = {"mask": ("smallint", 0), "confidence": ("float", 0.0), "change": ("smallint", 0)}


def raster_blocks(blocks: DataFrame, products: dict[str, str]) -> DataFrame:
    """Cast block arrays for storage: ``{array column: product}``; NULL becomes no-data."""

    def stored(column: str, product: str) -> Column:
        kind, nodata = PRODUCTS[product]
        return F.transform(column, lambda v: with_nodata(v, nodata, kind))

    return blocks.withColumns({column: stored(column, product) for column, product in products.items()})


def write_rasters(blocks: DataFrame, path: str, products: dict[str, str], mode: str = "errorifexists") -> None:
    """Parquet blocks sorted by scene and block, so windows prune row groups."""
    sort_for_storage(raster_blocks(blocks, products)).write.mode(mode).parquet(path)


def prediction_reports(classes: DataFrame, confidence: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One prediction artifact per scene as JSON: class list, confidence summary, extra columns.

    ``classes`` comes from ``class_summary`` (at most one entry per class), ``confidence`` from
    ``confidence_summary`` and may carry further per-scene columns named in ``extra``.
    """
    entry = F.struct("class_id", "class_name", "pixel_count", "pixel_fraction", "mean_confidence")
    order = F.struct((-F.col("pixel_count")).alias("_n"), F.col("class_id").alias("_c"), entry.alias("_e"))
    lists = classes.groupBy("scene_id").agg(
        F.transform(F.array_sort(F.collect_list(order)), lambda o: o["_e"]).alias("classes")
    )
    summary = F.struct("mean", "min", "max").alias("confidence")
    joined = lists.join(confidence, "scene_id")
    return joined.select("scene_id", F.to_json(F.struct("classes", summary, *extra), _NULLS).alias("doc"))


def analysis_reports(histogram: DataFrame, confidence: DataFrame, areas: DataFrame) -> DataFrame:
    """Per-scene statistics block of a finished analysis as JSON."""

    def id_map(df: DataFrame, value: str, name: str) -> DataFrame:
        entries = F.sort_array(F.collect_list(F.struct(F.col("class_id").cast("string"), F.col(value))))
        return df.groupBy("scene_id").agg(F.map_from_entries(entries).alias(name))

    counts = id_map(histogram, "pixel_count", "class_pixel_counts")
    area = id_map(areas, "area_m2", "class_area_m2")
    features = areas.groupBy("scene_id").agg(F.sum("feature_count").alias("vector_feature_count"))
    rows = (
        counts.join(confidence.select("scene_id", F.col("mean").alias("mean_confidence")), "scene_id")
        .join(area, "scene_id", "left")
        .join(features, "scene_id", "left")
    )
    stats = F.struct(
        "class_area_m2", "class_pixel_counts", "mean_confidence",
        F.coalesce("vector_feature_count", F.lit(0).cast("long")).alias("vector_feature_count"),
    )
    return rows.select("scene_id", F.to_json(F.struct(stats.alias("statistics")), _NULLS).alias("doc"))
