"""Affine pixel transforms as struct columns ``a, b, c, d, e, f``.

``x = a * col + b * row + c`` and ``y = d * col + e * row + f``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRANSFORM = "STRUCT<a: DOUBLE, b: DOUBLE, c: DOUBLE, d: DOUBLE, e: DOUBLE, f: DOUBLE>"


def transform_of(a, b, c, d, e, f) -> Column:
    return F.struct(*[F.lit(v).cast("double").alias(n) for n, v in zip("abcdef", (a, b, c, d, e, f))])


def to_world(t: Column, col: Column, row: Column) -> Column:
    """Struct ``x, y`` of a pixel corner (or, with halves added, of a pixel centre)."""
    return F.struct(
        (t["a"] * col + t["b"] * row + t["c"]).alias("x"),
        (t["d"] * col + t["e"] * row + t["f"]).alias("y"),
    )


def to_pixel(t: Column, x: Column, y: Column) -> Column:
    """Struct ``col, row`` as fractional pixel coordinates: the inverse of :func:`to_world`."""
    det = t["a"] * t["e"] - t["b"] * t["d"]
    dx, dy = x - t["c"], y - t["f"]
    return F.struct(
        ((t["e"] * dx - t["b"] * dy) / det).alias("col"),
        ((t["a"] * dy - t["d"] * dx) / det).alias("row"),
    )


def window_transform(t: Column, row_off: Column, col_off: Column) -> Column:
    """Transform of the sub-raster that starts at ``(row_off, col_off)``."""
    origin = to_world(t, col_off, row_off)
    return t.withField("c", origin["x"]).withField("f", origin["y"])


def bounds(t: Column, width: Column, height: Column) -> Column:
    """Struct ``minx, miny, maxx, maxy`` around the four corners of a raster."""
    zero = F.lit(0.0)
    corners = [to_world(t, col, row) for col in (zero, width) for row in (zero, height)]
    xs, ys = [p["x"] for p in corners], [p["y"] for p in corners]
    return F.struct(
        F.least(*xs).alias("minx"), F.least(*ys).alias("miny"), F.greatest(*xs).alias("maxx"), F.greatest(*ys).alias("maxy")
    )


def pixel_area(t: Column) -> Column:
    """Area of a pixel in squared units of the coordinate system."""
    return F.abs(t["a"] * t["e"] - t["b"] * t["d"])


def pixel_offset(inner: Column, outer: Column) -> Column:
    """Whole-pixel struct ``row_off, col_off`` of one grid inside another, half to even."""
    at = to_pixel(outer, inner["c"], inner["f"])
    return F.struct(F.rint(at["row"]).cast("long").alias("row_off"), F.rint(at["col"]).cast("long").alias("col_off"))
