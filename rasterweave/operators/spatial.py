"""Areas of interest: validation, extent tests and clipping."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

from rasterweave.functions import affine
from rasterweave.functions import geometry as G
from rasterweave.session import checkpoint

# Coordinate systems an AOI may use and the largest AOI in square metres.
AOI_CRS = ("EPSG:4326", "EPSG:3857")
MAX_AREA_M2 = 5_000_000.0


def parse_aois(texts: DataFrame, geojson: str = "geojson", crs: str = "crs") -> DataFrame:
    """``aoi_id, type, crs, ring, holes`` from GeoJSON texts; open rings are closed."""
    parsed = G.parse_geojson(F.col(geojson))
    return texts.withColumn("_g", parsed).select(
        "aoi_id",
        F.col("_g.type").alias("type"),
        G.normalise_crs(F.col(crs)).alias("crs"),
        G.close_ring(F.col("_g.ring")).alias("ring"),
        F.transform("_g.holes", G.close_ring).alias("holes"),
    )


def ring_crossings(aois: DataFrame) -> DataFrame:
    """``aoi_id`` of polygons with a ring that meets itself or crosses another, for rings of any length.

    Segments of the shell and the holes are placed in the cells of a square grid over their polygon
    (side: root of the segment count) that they pass through, and only segments sharing a cell are
    compared. Different rings may touch, but not cross.
    """
    rings = F.concat(F.array("ring"), F.coalesce("holes", F.array().cast(f"array<{G.RING}>")))
    total = F.aggregate(rings, F.lit(1), lambda n, r: n + F.greatest(F.size(r), F.lit(0)))
    cells = F.ceil(F.sqrt(total.cast("double"))).cast("int")
    rows = aois.select("aoi_id", G.bounds(F.col("ring")).alias("b"), cells.alias("g"), rings.alias("rings"))
    rows = rows.select("aoi_id", "b", "g", F.posexplode("rings").alias("r", "ring")).where(F.size("ring") > 1)
    rows = rows.select("aoi_id", "b", "g", "r", (F.size("ring") - 1).alias("n"),
                       F.posexplode(G.segments(F.col("ring"))).alias("i", "s"))
    s, b, g = F.col("s"), F.col("b"), F.col("g")
    dx = F.greatest((b["maxx"] - b["minx"]) / g, F.lit(1e-300))
    dy = F.greatest((b["maxy"] - b["miny"]) / g, F.lit(1e-300))

    def cell(value: Column, low: Column, step: Column) -> Column:
        return F.least(F.greatest(F.floor((value - low) / step), F.lit(0)), g - 1).cast("int")

    left, right = F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"])
    rows = rows.select(
        "*", F.explode(F.sequence(cell(left, b["minx"], dx), cell(right, b["minx"], dx))).alias("cx")
    )
    # the part of the segment inside this column of cells
    x_from = F.greatest(left, b["minx"] + F.col("cx") * dx)
    x_to = F.least(right, b["minx"] + (F.col("cx") + 1) * dx)
    slope = F.try_divide(s["y2"] - s["y1"], s["x2"] - s["x1"])
    y_at = lambda x: s["y1"] + (x - s["x1"]) * slope
    y_a = F.coalesce(y_at(x_from), s["y1"])
    y_b = F.coalesce(y_at(x_to), s["y2"])
    low, high = F.least(y_a, y_b), F.greatest(y_a, y_b)
    # one cell of slack on both sides absorbs rounding
    rows = rows.select(
        "aoi_id", "r", "i", "n", "s", "cx",
        F.explode(
            F.sequence(
                F.greatest(cell(low, b["miny"], dy) - 1, F.lit(0)),
                F.least(cell(high, b["miny"], dy) + 1, g - 1),
            )
        ).alias("cy"),
    )
    a, c = rows.alias("a"), rows.alias("c")
    same = [F.col(f"a.{k}") == F.col(f"c.{k}") for k in ("aoi_id", "cx", "cy")]
    pairs = a.join(c, [*same, F.struct("a.r", "a.i") < F.struct("c.r", "c.i")])
    following = F.col("c.i") == F.col("a.i") + 1
    closing = (F.col("a.i") == 0) & (F.col("c.i") == F.col("a.n") - 1)
    bad = (
        F.when(F.col("a.r") != F.col("c.r"), G.segments_cross(F.col("a.s"), F.col("c.s")))
        .when(following, G.folds_back(F.col("a.s"), F.col("c.s")))
        .when(closing, G.folds_back(F.col("c.s"), F.col("a.s")))
        .otherwise(G.segments_meet(F.col("a.s"), F.col("c.s")))
    )
    return pairs.where(bad).select(F.col("a.aoi_id").alias("aoi_id")).distinct()


def validate_aois(aois: DataFrame, max_area: float = MAX_AREA_M2) -> DataFrame:
    """Add ``area_m2`` and ``errors``, an ordered array of codes (empty for a usable AOI).

    ``aois`` has ``aoi_id, type, crs, ring, holes``. Rings of any length go through
    :func:`ring_crossings`; a hole that lies outside the shell is a self-intersection too.
    """
    size = F.coalesce(F.size("ring"), F.lit(0))
    crossed = ring_crossings(aois.where(size > 1)).withColumn("_crossed", F.lit(True))
    rows = aois.join(crossed, "aoi_id", "left")
    polygon = F.coalesce(F.col("type") == "Polygon", F.lit(False))
    filled = polygon & (size > 0)
    outside = F.exists("holes", lambda h: (F.size(h) > 0) & ~F.exists(h, lambda p: G.contains(F.col("ring"), p["x"], p["y"])))
    crossing = F.coalesce("_crossed", F.lit(False)) | F.coalesce(outside, F.lit(False))
    usable = filled & (size >= 4)
    known = F.coalesce(F.col("crs").isin(*AOI_CRS), F.lit(False))
    planar = F.when(usable, G.area(F.col("ring"), F.col("holes")))
    rows = rows.withColumn("area_m2", F.when(usable & known, G.area_m2(F.col("ring"), F.col("holes"), F.col("crs"))))
    codes = F.array(
        F.when(~polygon, "not_polygon"),
        F.when(polygon & (size == 0), "empty"),
        F.when(filled & (size < 4), "too_few_points"),
        F.when(usable & crossing, "self_intersection"),
        F.when(usable & ~(planar > 0), "zero_area"),
        F.when(~known, "unsupported_crs"),
        F.when(F.col("area_m2") > max_area, "too_large"),
    )
    return rows.withColumn("errors", F.array_compact(codes)).drop("_crossed")


#: a box lies in the nodes of the quadtree level whose side is at least this part of its own longer
#: side, so in (PARTS + 1) squared nodes at most; smaller sides than 2 ** LOWEST are treated alike
PARTS, LOWEST = 2, -30
#: pairs are made by so many times the tasks of a shuffle
PAIR_TASKS = 4


def _level(box: Column) -> Column:
    """Quadtree level (power of two of the nodes' side) of a box."""
    side = F.greatest(box["maxx"] - box["minx"], box["maxy"] - box["miny"])
    return F.greatest(F.ceil(F.log2(F.greatest(side / PARTS, F.lit(2.0**LOWEST)))), F.lit(LOWEST)).cast("int")


def _nodes(boxes: DataFrame, box: str, levels: Column) -> DataFrame:
    """One row per quadtree node (``at, cx, cy``) of the given levels that a box touches.

    ``starts`` tells whether the box starts in this column (1), this row (2), both (3) or none (0).
    """
    rows = boxes.select("*", F.explode(levels).alias("at"))
    side, b = F.pow(F.lit(2.0), F.col("at")), F.col(box)
    rows = rows.select("*", F.floor(b["minx"] / side).alias("_x"), F.floor(b["miny"] / side).alias("_y"), side.alias("_side"))
    rows = rows.select("*", F.explode(F.sequence("_x", F.floor(b["maxx"] / F.col("_side")))).alias("cx"))
    rows = rows.select("*", F.explode(F.sequence("_y", F.floor(b["maxy"] / F.col("_side")))).alias("cy"))
    starts = F.when(F.col("cx") == F.col("_x"), 1).otherwise(0) + F.when(F.col("cy") == F.col("_y"), 2).otherwise(0)
    return rows.withColumn("starts", starts).drop("_x", "_y", "_side")


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _apart(a: Column, r: Column) -> Column:
    return (a["maxx"] <= r["minx"]) | (a["minx"] >= r["maxx"]) | (a["maxy"] <= r["miny"]) | (a["miny"] >= r["maxy"])


def _reach(boxes: DataFrame, box: str, level: str) -> DataFrame:
    """``crs, at, _all``: the common box of each level in use; a row per system and power of two, so it may be broadcast."""
    low, high = (lambda c: F.min(F.col(box)[c]).alias(c)), (lambda c: F.max(F.col(box)[c]).alias(c))
    rows = boxes.groupBy("crs", F.col(level).alias("at")).agg(low("minx"), low("miny"), high("maxx"), high("maxy"))
    return F.broadcast(rows.select("crs", "at", F.struct("minx", "miny", "maxx", "maxy").alias("_all")))


def extent_intersects(aois: DataFrame, rasters: DataFrame) -> DataFrame:
    """Pairs of AOI and raster whose extents overlap; touching edges do not count.

    Both need ``crs`` and a ``bounds`` struct in that system. Boxes are placed in an implicit
    quadtree, each at the level of its own size, in at most (``PARTS`` + 1) squared nodes however large it
    is. A pair meets at the coarser level of the two, where the smaller box touches one to four
    nodes; of several common nodes the one holding the lower-left corner of the common part has the
    pair, which replaces a distinct: there one of the two starts in the column and one in the row, so the
    join takes no other combinations, and all that is left to compare for a pair are the boxes. A box takes part only in levels whose common box in its system it
    meets. Boxes of a metre and of a continent mix in one table. Boxes with missing or infinite bounds
    overlap nothing.
    """
    usable = lambda b: F.abs(b["minx"]) + F.abs(b["miny"]) + F.abs(b["maxx"]) + F.abs(b["maxy"]) < 1e300
    left = aois.select("aoi_id", "crs", F.col("bounds").alias("a")).where(usable(F.col("a")))
    right = rasters.select("scene_id", "crs", F.col("bounds").alias("r")).where(usable(F.col("r")))
    # each is read for its reach and in two joins; projected boxes are dear to make again. Pairs may be many times the
    # boxes, so the boxes are dealt to as many tasks as a shuffle has, however few files they come from
    left = checkpoint(left.repartition(_tasks(left), "aoi_id", "crs")).withColumn("la", _level(F.col("a")))
    right = checkpoint(right.repartition(_tasks(left), "scene_id", "crs")).withColumn("lr", _level(F.col("r")))
    reach_left, reach_right = _reach(left, "a", "la"), _reach(right, "r", "lr")

    def at_own(rows: DataFrame, box: str, level: str, others: DataFrame, keep: Column) -> DataFrame:
        """Nodes of boxes that some box of a finer level, or the same, may meet."""
        near = rows.alias("b").join(others.alias("o"), (F.col("b.crs") == F.col("o.crs")) & keep & ~_apart(F.col(box), F.col("_all")), "left_semi")
        return _nodes(near, box, F.array(F.col(level))).drop(level)

    def at_coarser(rows: DataFrame, box: str, level: str, others: DataFrame, keep: Column) -> DataFrame:
        """Nodes of boxes at the coarser levels whose boxes they may meet."""
        near = rows.join(others, "crs").where(keep & ~_apart(F.col(box), F.col("_all")))
        return _nodes(near.withColumnRenamed("at", "_to").drop("_all", level), box, F.array(F.col("_to"))).drop("_to")

    key = ["crs", "at", "cx", "cy", "starts"]

    def dealt(rows: DataFrame, box: str, name: str) -> DataFrame:
        # pairs are many times the rows, so tasks must not be joined for being short of rows
        cells = [F.col(box)[c].alias(f"{box}_{c}") for c in ("minx", "miny", "maxx", "maxy")]
        return rows.select(*key, name, *cells).repartition(PAIR_TASKS * _tasks(rows), *key)

    def pairs(a: DataFrame, r: DataFrame) -> DataFrame:
        other = F.explode(F.filter(F.array(*map(F.lit, range(4))), lambda c: F.col("starts").bitwiseOR(c) == 3))
        a = dealt(a.withColumn("starts", other), "a", "aoi_id")
        side = lambda x: {c: F.col(f"{x}_{c}") for c in ("minx", "miny", "maxx", "maxy")}
        return a.join(dealt(r, "r", "scene_id"), key).where(~_apart(side("a"), side("r"))).select("aoi_id", "scene_id")

    at, la, lr = F.col("at"), F.col("la"), F.col("lr")
    return pairs(at_own(left, "a", "la", reach_right, at <= la), at_coarser(right, "r", "lr", reach_left, at >= lr)).unionByName(
        pairs(at_coarser(left, "a", "la", reach_right, at > la), at_own(right, "r", "lr", reach_left, at < lr))
    )


def _may_reach(deg: Column, crs: Column, reach: Column) -> Column:
    """Whether the outline of a box in degrees, projected into ``crs``, may come to the box ``reach`` of that system.

    In a UTM zone it is decided by bounds of the projection: easting and northing differ by known amounts at
    most from two angles, that from the central meridian, whose sine is sin(longitude) * cos(latitude), and
    one that is at least as large as the latitude, and more than 90 degrees beyond the poles.
    """
    scale = G.UTM_SCALE * G.RECTIFYING_RADIUS
    turn = F.radians(deg["minx"] - ((G.epsg_code(crs) % 100) * 6.0 - 183.0)), F.radians(deg["maxx"] - ((G.epsg_code(crs) % 100) * 6.0 - 183.0))
    alike = lambda shift: F.floor((turn[0] + shift) / math.pi) == F.floor((turn[1] + shift) / math.pi)
    sine = F.when(alike(0.0), F.least(*[F.abs(F.sin(x)) for x in turn])).otherwise(0.0)
    sine = sine * F.cos(F.radians(F.greatest(F.abs(deg["miny"]), F.abs(deg["maxy"]))))
    wide = F.greatest(F.abs(reach["minx"] - G.UTM_EASTING), F.abs(reach["maxx"] - G.UTM_EASTING)) / scale
    beside = sine <= F.tanh(wide / (1 - G.SERIES_SHARE)) + 1e-6
    south = F.when(G.epsg_code(crs) >= 32700, G.UTM_SOUTH).otherwise(0.0)
    low, high = (reach["miny"] - south) / scale - G.SERIES_MOST, (reach["maxy"] - south) / scale + G.SERIES_MOST
    along = ((deg["miny"] <= 0) | (high >= F.radians(deg["miny"]))) & ((deg["maxy"] >= 0) | (low <= F.radians(deg["maxy"])))
    beyond = alike(math.pi / 2) & (F.pmod(F.floor((turn[0] + math.pi / 2) / math.pi), F.lit(2)) == 1)
    over_pole = (high >= math.pi / 2) | (low <= -math.pi / 2)
    return ~G.is_utm(crs) | (beside & along & (~beyond | over_pole))


def aoi_bounds_in_systems(aois: DataFrame, rasters: DataFrame) -> DataFrame:
    """``aoi_id, crs, bounds``: AOI extents in each system of ``rasters`` in which they may meet one.

    ``aois`` has ``aoi_id, crs, ring``, ``rasters`` has ``crs, bounds``. Geographic and Mercator systems take every
    AOI, a UTM zone all those that its rasters, however wide, can come near, be they zones away or across a pole.
    Edges are densified before they are projected.
    """
    box, b = G.bounds(F.col("ring")), F.col("bounds")
    usable = rasters.where(F.abs(b["minx"]) + F.abs(b["miny"]) + F.abs(b["maxx"]) + F.abs(b["maxy"]) < 1e300)
    # at most the 122 systems that are supported
    common = F.struct(*[f(b[c]).alias(c) for c, f in (("minx", F.min), ("miny", F.min), ("maxx", F.max), ("maxy", F.max))])
    systems = F.broadcast(usable.groupBy("crs").agg(common.alias("_reach")))
    # projecting is dear, and a few files would make a few tasks of it
    rows = aois.select("aoi_id", "crs", "ring").repartition(_tasks(aois), "aoi_id")
    rows = rows.select("aoi_id", F.col("crs").alias("_from"), box.alias("_box"))
    rows = checkpoint(rows.withColumn("_deg", G.densified_bounds(F.col("_box"), F.col("_from"), F.lit("EPSG:4326"))))
    rows = rows.join(systems, (F.col("_from") == F.col("crs")) | _may_reach(F.col("_deg"), F.col("crs"), F.col("_reach")))
    return rows.select("aoi_id", "crs", G.densified_bounds(F.col("_box"), F.col("_from"), F.col("crs")).alias("bounds"))


def coverage(aois: DataFrame, rasters: DataFrame) -> DataFrame:
    """Pairs of AOI and raster whose extents overlap in the raster's own system.

    ``aois`` has ``aoi_id, crs, ring``, ``rasters`` has ``scene_id, crs, bounds``. A raster or AOI in
    a system other than EPSG:4326, EPSG:3857 and the UTM zones fails the job.
    """
    named = rasters.select("scene_id", "bounds", G.normalise_crs(F.col("crs")).alias("_crs"), "crs")
    text = F.concat(F.lit("unknown coordinate system: "), F.coalesce("crs", F.lit("none")))
    named = named.select("scene_id", "bounds", F.coalesce("_crs", F.raise_error(text).cast("string")).alias("crs"))
    return extent_intersects(aoi_bounds_in_systems(aois, named), named)


def aoi_bounds_in(aois: DataFrame, target_crs: str) -> DataFrame:
    """AOI extents in another coordinate system, through densified edges."""
    box = G.densified_bounds(G.bounds(F.col("ring")), F.col("crs"), F.lit(target_crs))
    return aois.select("aoi_id", box.alias("bounds")).withColumn("crs", F.lit(target_crs))


def clip_windows(aois: DataFrame, rasters: DataFrame) -> DataFrame:
    """Crop window of each AOI in its raster: whole pixels around its extent, cut at the edge.

    ``aois`` carries ``scene_id``; the AOI ring must be in the raster's coordinate system.
    """
    joined = aois.select("aoi_id", "scene_id", "ring", "holes").join(
        rasters.select("scene_id", "transform", "width", "height"), "scene_id"
    )
    box, t = G.bounds(F.col("ring")), F.col("transform")
    corner_a = affine.to_pixel(t, box["minx"], box["miny"])
    corner_b = affine.to_pixel(t, box["maxx"], box["maxy"])
    rows = joined.withColumns({"_a": corner_a, "_b": corner_b})

    def limit(part: str, size: str) -> tuple[Column, Column]:
        low = F.floor(F.least(F.col(f"_a.{part}"), F.col(f"_b.{part}")))
        high = F.ceil(F.greatest(F.col(f"_a.{part}"), F.col(f"_b.{part}")))
        return F.greatest(low, F.lit(0)).cast("long"), F.least(high, F.col(size)).cast("long")

    row_from, row_to = limit("row", "height")
    col_from, col_to = limit("col", "width")
    return rows.select(
        "aoi_id", "scene_id", "ring", "holes", "transform",
        row_from.alias("row_from"), row_to.alias("row_to"),
        col_from.alias("col_from"), col_to.alias("col_to"),
    ).where("row_from < row_to AND col_from < col_to")


def clip(pixels: DataFrame, aois: DataFrame, rasters: DataFrame, values: list[str], nodata=0, cell: int = 64) -> DataFrame:
    """Pixels of every AOI's crop window; outside the polygon the values become ``nodata``.

    Windows are listed per ``cell x cell`` patch and equi-joined with the pixels on scene and
    patch, so neither side needs to be broadcast and a scene holding a third of all pixels is
    spread over its patches. The exact test (pixel centre in polygon) runs after the cheap one.
    """
    windows = clip_windows(aois, rasters)
    patches = windows.select(
        "*",
        F.explode(F.sequence(F.floor(F.col("row_from") / cell), F.floor((F.col("row_to") - 1) / cell))).alias("_pr"),
    )
    patches = patches.select(
        "*",
        F.explode(F.sequence(F.floor(F.col("col_from") / cell), F.floor((F.col("col_to") - 1) / cell))).alias("_pc"),
    )
    keyed = pixels.select(
        "scene_id", "row_idx", "col_idx", *values,
        F.floor(F.col("row_idx") / cell).alias("_pr"),
        F.floor(F.col("col_idx") / cell).alias("_pc"),
    )
    joined = keyed.join(patches, ["scene_id", "_pr", "_pc"]).where(
        "row_idx >= row_from AND row_idx < row_to AND col_idx >= col_from AND col_idx < col_to"
    )
    centre = affine.to_world(F.col("transform"), F.col("col_idx") + 0.5, F.col("row_idx") + 0.5)
    inside = G.polygon_contains(F.col("ring"), F.col("holes"), F.col("_xy.x"), F.col("_xy.y"))
    flagged = joined.withColumn("_xy", centre).withColumn("inside", inside)
    return flagged.select(
        "aoi_id", "scene_id",
        (F.col("row_idx") - F.col("row_from")).alias("row_idx"),
        (F.col("col_idx") - F.col("col_from")).alias("col_idx"),
        "inside",
        *[F.when(F.col("inside"), F.col(v)).otherwise(F.lit(nodata)).alias(v) for v in values],
    )


# ------------------------------------------------------------------ clipping of blocks


def in_raster_systems(aois: DataFrame, rasters: DataFrame) -> DataFrame:
    """AOIs (``aoi_id, scene_id, crs, ring, holes``) with their rings in the system of their scene."""
    systems = rasters.select("scene_id", F.col("crs").alias("_to"))
    moved = lambda ring: G.reproject(ring, F.col("crs"), F.col("_to"))
    return aois.join(systems, "scene_id").select(
        "aoi_id", "scene_id", F.col("_to").alias("crs"), moved(F.col("ring")).alias("ring"), F.transform("holes", moved).alias("holes")
    )


def row_spans(windows: DataFrame) -> DataFrame:
    """Scanlines of polygons: ``aoi_id, scene_id, row_idx, hole, col_from, col_to`` (end not included).

    A pixel is in a ring if its centre is, by the even-odd rule. Every edge is cut into the pixel rows
    that it crosses, and the crossings of a row are paired in order, so the work grows with the outline
    and not with the area. ``windows`` comes from :func:`clip_windows`; rows outside a window are left
    out, columns are cut at it. Holes are numbered from 1, 0 is the shell.
    """
    t = F.col("transform")
    rings = F.concat(F.array("ring"), F.coalesce("holes", F.array().cast(f"array<{G.RING}>")))
    inside = F.transform(rings, lambda ring: F.transform(ring, lambda p: affine.to_pixel(t, p["x"], p["y"])))
    flat = F.transform(inside, lambda ring: F.transform(ring, lambda p: F.struct(p["col"].alias("x"), p["row"].alias("y"))))
    edges = windows.select(
        "aoi_id", "scene_id", "row_from", "row_to", "col_from", "col_to", (t["e"] < 0).alias("down"), F.posexplode(flat).alias("hole", "r")
    ).where(F.size("r") > 1)
    edges = edges.select("*", F.explode(G.segments(F.col("r"))).alias("s")).drop("r")
    s = F.col("s")
    first = F.greatest(F.floor(F.least(s["y1"], s["y2"]) - 0.5).cast("long"), F.col("row_from"))
    last = F.least(F.ceil(F.greatest(s["y1"], s["y2"]) - 0.5).cast("long"), F.col("row_to") - 1)
    edges = edges.withColumns({"_a": first, "_b": last}).where("_a <= _b AND s.y1 <> s.y2")
    rows = edges.select("*", F.explode(F.sequence("_a", "_b")).alias("row_idx"))
    y = F.col("row_idx") + 0.5
    # half-open in the direction of the world's y axis, as the point test is
    crosses = F.when(F.col("down"), (s["y1"] < y) != (s["y2"] < y)).otherwise((s["y1"] > y) != (s["y2"] > y))
    at = s["x1"] + (y - s["y1"]) * (s["x2"] - s["x1"]) / (s["y2"] - s["y1"])
    rows = rows.where(crosses).select("aoi_id", "scene_id", "row_idx", "hole", "col_from", "col_to", F.ceil(at - 0.5).cast("long").alias("at"))
    found = rows.groupBy("aoi_id", "scene_id", "row_idx", "hole", "col_from", "col_to").agg(F.sort_array(F.collect_list("at")).alias("_c"))
    pairs = F.transform(
        F.sequence(F.lit(0), (F.size("_c") / 2).cast("int") - 1),
        lambda k: F.struct(
            F.greatest(F.get("_c", 2 * k), F.col("col_from")).alias("col_from"), F.least(F.get("_c", 2 * k + 1), F.col("col_to")).alias("col_to")
        ),
    )
    found = found.where("size(_c) > 1").select("aoi_id", "scene_id", "row_idx", "hole", F.explode(pairs).alias("p"))
    return found.select("aoi_id", "scene_id", "row_idx", "hole", "p.*").where("col_from < col_to")


def _masked(block: dict, values: list[str], nodata) -> dict:
    """A block cut to its window, with ``nodata`` where its spans do not reach."""
    top, left = block["y0"] - block["y_off"], block["x0"] - block["x_off"]
    h, w = block["y1"] - block["y0"], block["x1"] - block["x0"]
    inside, holes = np.zeros((h, w), bool), np.zeros((h, w), bool)
    for span in block["spans"]:
        target = holes if span["hole"] else inside
        row, a, b = span["row_idx"] - block["y0"], max(span["col_from"] - block["x0"], 0), min(span["col_to"] - block["x0"], w)
        if 0 <= row < h and a < b:
            target[row, a:b] = True
    inside &= ~holes
    out = {"inside": inside.ravel()}
    for v in values:
        cells = np.empty(len(block[v]), object)
        cells[:] = block[v]
        part = cells.reshape(block["height"], block["width"])[top : top + h, left : left + w].copy()
        part[~inside] = nodata
        out[v] = part.ravel()
    return out


def clip_blocks(blocks: DataFrame, aois: DataFrame, rasters: DataFrame, values: list[str], nodata=0, size: int = 256) -> DataFrame:
    """As :func:`clip`, from blocks to blocks: the crop window of every AOI, ``nodata`` outside it.

    ``aois`` has ``aoi_id, scene_id, crs, ring, holes`` in any known system, ``rasters`` also ``crs``;
    ``size`` is the side of the stored blocks. The result has ``y_off`` and ``x_off`` from the window's
    corner, ``inside`` flags and ``covered`` (``all``, ``part``, ``none``). How much of a block the spans
    of its rows cover decides whether its cells have to be looked at: a block that lies inside passes as
    it is, one outside is filled, and only those that the outline or the window's edge cuts are masked,
    by whole row spans. A pair of AOI and block row holds the spans of at most ``size`` rows.
    """
    windows = checkpoint(clip_windows(in_raster_systems(aois, rasters), rasters))
    key = ["aoi_id", "scene_id", "block_row"]
    spans = row_spans(windows).select("aoi_id", "scene_id", F.expr(f"cast(row_idx div {size} as int)").alias("block_row"),
                                      F.struct("row_idx", "hole", "col_from", "col_to").alias("s"))
    spans = spans.groupBy(*key).agg(F.collect_list("s").alias("spans"))
    places = windows.drop("ring", "holes", "transform").select(
        "*", F.explode(F.expr(f"sequence(cast(row_from div {size} as int), cast((row_to - 1) div {size} as int))")).alias("block_row")
    ).join(spans, key, "left")
    places = places.select(
        "*", F.explode(F.expr(f"sequence(cast(col_from div {size} as int), cast((col_to - 1) div {size} as int))")).alias("block_col")
    )
    rows = places.join(blocks, ["scene_id", "block_row", "block_col"])
    rows = rows.withColumns({
        "y0": F.greatest("row_from", "y_off"), "y1": F.least("row_to", F.col("y_off") + F.col("height")),
        "x0": F.greatest("col_from", "x_off"), "x1": F.least("col_to", F.col("x_off") + F.col("width")),
    }).where("y0 < y1 AND x0 < x1")
    own = "filter(coalesce(spans, array()), s -> s.col_to > x0 AND s.col_from < x1)"
    rows = rows.withColumn("spans", F.expr(own))
    cells = "aggregate(filter(spans, s -> s.hole = 0), 0L, (n, s) -> n + least(s.col_to, x1) - greatest(s.col_from, x0))"
    holes = "exists(spans, s -> s.hole > 0)"
    rows = rows.withColumn("_n", F.expr(cells)).withColumn("covered", F.expr(
        f"case when _n = 0 then 'none' when NOT {holes} AND _n = (y1 - y0) * (x1 - x0) then 'all' else 'part' end"
    ))
    whole = F.expr("y0 = y_off AND x0 = x_off AND y1 = y_off + height AND x1 = x_off + width")
    plain = (F.col("covered") == "none") | ((F.col("covered") == "all") & whole)
    area = F.expr("cast((y1 - y0) * (x1 - x0) as int)")
    kinds = {v: blocks.schema[v].dataType for v in values}
    empty = {v: F.array_repeat(F.lit(nodata).cast(kinds[v].elementType), area) for v in values}
    place = [
        "aoi_id", "scene_id", "block_row", "block_col", F.expr("y0 - row_from").alias("y_off"), F.expr("x0 - col_from").alias("x_off"),
        F.expr("cast(y1 - y0 as int)").alias("height"), F.expr("cast(x1 - x0 as int)").alias("width"), "covered",
    ]
    inside = F.col("covered") == "all"
    passed = rows.where(plain).select(
        *place, F.array_repeat(inside, area).alias("inside"), *[F.when(inside, F.col(v)).otherwise(empty[v]).alias(v) for v in values]
    )
    names = ["y0", "y1", "x0", "x1", "y_off", "x_off", "height", "width", "spans", *values]
    cut = StructType([StructField("inside", ArrayType(BooleanType())), *[StructField(v, kinds[v]) for v in values]])

    @F.pandas_udf(cut)
    def masked(parts: pd.DataFrame) -> pd.DataFrame:
        done = [_masked(row, values, nodata) for row in parts.to_dict("records")]
        return pd.DataFrame({n: [d[n] for d in done] for n in ["inside", *values]})

    hidden = rows.where(~plain).withColumn("_m", masked(F.struct(*names)))
    return passed.unionByName(hidden.select(*place, F.col("_m.inside").alias("inside"), *[F.col(f"_m.{v}").alias(v) for v in values]))
