"""Polygons as column expressions: rings are ``ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>``.

The first and last point of a ring are the same. Projections cover geographic degrees
(EPSG:4326), spherical Mercator (EPSG:3857) and the UTM zones (EPSG:326zz, 327zz).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterweave.functions.scalars import let

RING = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
GEOJSON = "type STRING, coordinates ARRAY<ARRAY<ARRAY<DOUBLE>>>"

# WGS 84 ellipsoid, UTM scale and false origin, Mercator sphere.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_EASTING = 500000.0
UTM_SOUTH = 10000000.0
MERCATOR_R = 6378137.0

_N = WGS84_F / (2 - WGS84_F)
_E = math.sqrt(WGS84_F * (2 - WGS84_F))
RECTIFYING_RADIUS = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
# Transverse Mercator forward series in the third flattening (Krueger 1912),
# coefficient rows by order, terms by rising power of n starting at the row's own order.
KRUEGER_TERMS = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
KRUEGER = tuple(
    sum(term * _N ** (order + power) for power, term in enumerate(row))
    for order, row in enumerate(KRUEGER_TERMS, start=1)
)
# The inverse series of the same projection, written in the same way.
INVERSE_TERMS = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
    (4583 / 161280, -108847 / 3991680),
    (20648693 / 638668800,),
)
INVERSE = tuple(
    sum(term * _N ** (order + power) for power, term in enumerate(row))
    for order, row in enumerate(INVERSE_TERMS, start=1)
)
ECCENTRICITY = _E
#: angle from the central meridian up to which boxes are projected into a zone, as in PROJ, and its sine on the sphere;
#: up to it the series adds SERIES_MOST to an angle at most, SERIES_SHARE of the one that makes the easting (radians)
UTM_LIMIT = 2.623395162778
UTM_SINE = math.tanh(UTM_LIMIT)
# the ellipsoid's latitude is less than 0.0034 above that of the sphere
SERIES_MOST = sum(abs(term) * math.cosh(2 * j * UTM_LIMIT) for j, term in enumerate(KRUEGER, start=1)) + 0.0034
SERIES_SHARE = max(
    sum(abs(term) * math.sinh(2 * j * eta) for j, term in enumerate(KRUEGER, start=1)) / eta for eta in (UTM_LIMIT, 1e-3)
)

# ------------------------------------------------------------------ construction and text


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring_of(*points: tuple[Column, Column]) -> Column:
    """Closed ring from corner expressions; the first corner is repeated at the end."""
    corners = [point(F.lit(x), F.lit(y)) for x, y in points]
    return F.array(*corners, corners[0])


def parse_geojson(text: Column) -> Column:
    """Struct ``type, ring, holes`` of a GeoJSON geometry text."""
    geometry = F.from_json(text, GEOJSON)
    rings = F.transform(
        geometry["coordinates"],
        lambda ring: F.transform(
            ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
        ),
    )
    return F.struct(
        geometry["type"].alias("type"),
        F.get(rings, F.lit(0)).alias("ring"),
        F.coalesce(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), F.array().cast(f"ARRAY<{RING}>")).alias(
            "holes"
        ),
    )


def close_ring(ring: Column) -> Column:
    """Repeat the first point at the end where the text left it out."""
    first = F.get(ring, F.lit(0))
    return F.when(F.element_at(ring, -1) == first, ring).otherwise(F.concat(ring, F.array(first)))


def coordinates(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.array(p["x"], p["y"]))


def polygon_struct(ring: Column, holes: Column | None = None) -> Column:
    """GeoJSON geometry struct. Without ``holes`` only the exterior is written."""
    rings = F.array(coordinates(ring))
    if holes is not None:
        rings = F.concat(rings, F.transform(holes, coordinates))
    return F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"))


def to_geojson(ring: Column) -> Column:
    return F.to_json(polygon_struct(ring))


# ------------------------------------------------------------------ measures


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("minx"),
        F.array_min(ys).alias("miny"),
        F.array_max(xs).alias("maxx"),
        F.array_max(ys).alias("maxy"),
    )


def segments(ring: Column) -> Column:
    """Consecutive point pairs as ``x1, y1, x2, y2``."""
    n = F.size(ring) - 1
    return F.zip_with(
        F.slice(ring, 1, F.greatest(n, F.lit(0))),
        F.slice(ring, 2, F.greatest(n, F.lit(0))),
        lambda p, q: F.struct(
            p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")
        ),
    )


def _moments(ring: Column) -> Column:
    """Twice the signed area and the first moments, around the ring's first point."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def around(origin: Column) -> Column:
        def add(state: Column, s: Column) -> Column:
            x1, y1 = s["x1"] - origin["x"], s["y1"] - origin["y"]
            x2, y2 = s["x2"] - origin["x"], s["y2"] - origin["y"]
            return let(
                x1 * y2 - x2 * y1,
                lambda cross: F.struct(
                    (state["a"] + cross).alias("a"),
                    (state["mx"] + (x1 + x2) * cross).alias("mx"),
                    (state["my"] + (y1 + y2) * cross).alias("my"),
                ),
            )

        return F.aggregate(segments(ring), zero, add)

    return let(F.get(ring, F.lit(0)), around)


def signed_area(ring: Column) -> Column:
    """Shoelace sum around the ring's first point; positive for counter-clockwise rings."""

    def around(origin: Column) -> Column:
        return F.aggregate(
            segments(ring),
            F.lit(0.0),
            lambda a, s: a
            + (s["x1"] - origin["x"]) * (s["y2"] - origin["y"])
            - (s["x2"] - origin["x"]) * (s["y1"] - origin["y"]),
        )

    return let(F.get(ring, F.lit(0)), around) / 2.0


def area(ring: Column, holes: Column | None = None) -> Column:
    """Planar area with the holes taken out."""
    outer = F.abs(signed_area(ring))
    if holes is None:
        return outer
    return outer - F.aggregate(holes, F.lit(0.0), lambda s, h: s + F.abs(signed_area(h)))


def centroid(ring: Column, holes: Column | None = None) -> Column:
    """Area-weighted centre ``x, y``; NULL for a ring without area."""

    def part(r: Column) -> Column:
        """Unsigned area and moments of one ring in absolute coordinates."""

        def absolute(m: Column) -> Column:
            flip = F.when(m["a"] < 0, -0.5).otherwise(0.5)
            origin = F.get(r, F.lit(0))
            return F.struct(
                (flip * m["a"]).alias("a"),
                (flip * (m["mx"] / 3.0 + m["a"] * origin["x"])).alias("mx"),
                (flip * (m["my"] / 3.0 + m["a"] * origin["y"])).alias("my"),
            )

        return let(_moments(r), absolute)

    total = part(ring)
    if holes is not None:

        def minus(s: Column, h: Column) -> Column:
            return let(part(h), lambda p: F.struct(*[(s[k] - p[k]).alias(k) for k in ("a", "mx", "my")]))

        total = F.aggregate(holes, total, minus)
    return let(
        total,
        lambda t: F.struct(F.try_divide(t["mx"], t["a"]).alias("x"), F.try_divide(t["my"], t["a"]).alias("y")),
    )


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against a ring (half-open in y)."""

    def crosses(s: Column) -> Column:
        spans = (s["y1"] > y) != (s["y2"] > y)
        at = s["x1"] + F.try_divide((y - s["y1"]) * (s["x2"] - s["x1"]), s["y2"] - s["y1"])
        return F.coalesce(spans & (x < at), F.lit(False))

    hits = F.aggregate(segments(ring), F.lit(0), lambda n, s: n + F.when(crosses(s), 1).otherwise(0))
    return hits % 2 == 1


def polygon_contains(ring: Column, holes: Column, x: Column, y: Column) -> Column:
    return contains(ring, x, y) & ~F.exists(holes, lambda h: contains(h, x, y))


def orientation(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_meet(s: Column, t: Column) -> Column:
    """True when two closed segments share a point."""
    d1 = orientation(s["x1"], s["y1"], s["x2"], s["y2"], t["x1"], t["y1"])
    d2 = orientation(s["x1"], s["y1"], s["x2"], s["y2"], t["x2"], t["y2"])
    d3 = orientation(t["x1"], t["y1"], t["x2"], t["y2"], s["x1"], s["y1"])
    d4 = orientation(t["x1"], t["y1"], t["x2"], t["y2"], s["x2"], s["y2"])

    def within(a: Column, x: Column, y: Column) -> Column:
        return x.between(F.least(a["x1"], a["x2"]), F.greatest(a["x1"], a["x2"])) & y.between(
            F.least(a["y1"], a["y2"]), F.greatest(a["y1"], a["y2"])
        )

    return (
        ((d1 * d2 < 0) & (d3 * d4 < 0))
        | ((d1 == 0) & within(s, t["x1"], t["y1"]))
        | ((d2 == 0) & within(s, t["x2"], t["y2"]))
        | ((d3 == 0) & within(t, s["x1"], s["y1"]))
        | ((d4 == 0) & within(t, s["x2"], s["y2"]))
    )


def folds_back(s: Column, t: Column) -> Column:
    """True when ``t``, starting where ``s`` ends, runs back over it."""
    turn = orientation(s["x1"], s["y1"], s["x2"], s["y2"], t["x2"], t["y2"])
    forward = (s["x2"] - s["x1"]) * (t["x2"] - t["x1"]) + (s["y2"] - s["y1"]) * (t["y2"] - t["y1"])
    return (turn == 0) & (forward < 0)


def segments_cross(s: Column, t: Column) -> Column:
    """True when two segments cross in their interiors; a common end or a touching end does not count."""
    d1 = orientation(s["x1"], s["y1"], s["x2"], s["y2"], t["x1"], t["y1"])
    d2 = orientation(s["x1"], s["y1"], s["x2"], s["y2"], t["x2"], t["y2"])
    d3 = orientation(t["x1"], t["y1"], t["x2"], t["y2"], s["x1"], s["y1"])
    d4 = orientation(t["x1"], t["y1"], t["x2"], t["y2"], s["x2"], s["y2"])
    return (d1 * d2 < 0) & (d3 * d4 < 0)



# ------------------------------------------------------------------ coordinate systems


def normalise_crs(text: Column) -> Column:
    """Canonical ``EPSG:code`` of the supported systems, NULL for anything else."""
    bare = F.regexp_replace(F.upper(F.trim(text)), r"^URN:OGC:DEF:CRS:EPSG:[^:]*:|^EPSG::?|^WGS ?84$|^OGC:CRS84$", "")
    # Names of EPSG:4326 that carry no number
    named = F.upper(F.trim(text)).isin("WGS84", "WGS 84")
    code = F.when(named, "4326").otherwise(bare)
    supported = code.rlike(r"^(4326|3857|32[67](0[1-9]|[1-5][0-9]|60))$") & (
        F.upper(F.trim(text)).rlike("EPSG") | named
    )
    return F.when(supported, F.concat(F.lit("EPSG:"), code))


def utm_zone(lon: Column) -> Column:
    return F.least(F.floor((lon + 180.0) / 6.0) + 1, F.lit(60)).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG number of the UTM zone of a position; longitude 180 belongs to zone 60."""
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def utm_project(lon: Column, lat: Column, epsg: Column) -> Column:
    """Struct ``x, y`` in metres of a geographic position in the given UTM zone."""
    central = (epsg % 100) * 6.0 - 183.0
    south = F.when(F.floor(epsg / 100) == 327, UTM_SOUTH).otherwise(0.0)
    scale = UTM_SCALE * RECTIFYING_RADIUS
    lam = F.radians(lon - central)

    def conformal(sine: Column) -> Column:
        return F.sinh(F.atanh(sine) - ECCENTRICITY * F.atanh(ECCENTRICITY * sine))

    def spherical(t: Column) -> Column:
        return F.struct(
            F.atan2(t, F.cos(lam)).alias("xi"), F.atanh(F.sin(lam) / F.sqrt(1.0 + t * t)).alias("eta")
        )

    def series(p: Column) -> Column:
        x, y = p["eta"], p["xi"]
        for j, alpha in enumerate(KRUEGER, start=1):
            x = x + alpha * F.cos(2.0 * j * p["xi"]) * F.sinh(2.0 * j * p["eta"])
            y = y + alpha * F.sin(2.0 * j * p["xi"]) * F.cosh(2.0 * j * p["eta"])
        return F.struct((UTM_EASTING + scale * x).alias("x"), (south + scale * y).alias("y"))

    return let(let(let(F.sin(F.radians(lat)), conformal), spherical), series)


def to_mercator(lon: Column, lat: Column) -> Column:
    return F.struct(
        (MERCATOR_R * F.radians(lon)).alias("x"),
        (MERCATOR_R * F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2.0))).alias("y"),
    )


def from_mercator(x: Column, y: Column) -> Column:
    return F.struct(
        F.degrees(x / MERCATOR_R).alias("x"),
        F.degrees(2.0 * F.atan(F.exp(y / MERCATOR_R)) - math.pi / 2).alias("y"),
    )


def utm_unproject(x: Column, y: Column, epsg: Column) -> Column:
    """Struct ``x, y`` in degrees of metres in the given UTM zone: the inverse of :func:`utm_project`."""
    central = (epsg % 100) * 6.0 - 183.0
    south = F.when(F.floor(epsg / 100) == 327, UTM_SOUTH).otherwise(0.0)
    scale = UTM_SCALE * RECTIFYING_RADIUS
    start = F.struct(((y - south) / scale).alias("xi"), ((x - UTM_EASTING) / scale).alias("eta"))

    def series(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        for j, beta in enumerate(INVERSE, start=1):
            xi = xi - beta * F.sin(2.0 * j * p["xi"]) * F.cosh(2.0 * j * p["eta"])
            eta = eta - beta * F.cos(2.0 * j * p["xi"]) * F.sinh(2.0 * j * p["eta"])
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    def geographic(p: Column) -> Column:
        # every step gains about two digits and a half on the sine of the latitude
        steps = F.array(*[F.lit(0)] * 7)
        sine = let(
            F.atanh(F.sin(p["xi"]) / F.cosh(p["eta"])),
            lambda q: F.aggregate(steps, F.tanh(q), lambda s, _: F.tanh(q + ECCENTRICITY * F.atanh(ECCENTRICITY * s))),
        )
        lon = central + F.degrees(F.atan2(F.sinh(p["eta"]), F.cos(p["xi"])))
        return F.struct(lon.alias("x"), F.degrees(F.asin(sine)).alias("y"))

    return let(let(start, series), geographic)


def is_utm(crs: Column) -> Column:
    return crs.rlike("^EPSG:32[67](0[1-9]|[1-5][0-9]|60)$")


def epsg_code(crs: Column) -> Column:
    return F.substring(crs, 6, 5).cast("int")


def _unknown(crs: Column) -> Column:
    text = F.concat(F.lit("unknown coordinate system: "), F.coalesce(crs, F.lit("none")))
    return F.raise_error(text).cast("struct<x: double, y: double>")


def reproject_point(p: Column, source: Column, target: Column) -> Column:
    """A point in another of the supported systems, by way of degrees; an unknown system is an error."""
    degrees = (
        F.when(source == "EPSG:4326", point(p["x"], p["y"]))
        .when(source == "EPSG:3857", from_mercator(p["x"], p["y"]))
        .when(is_utm(source), utm_unproject(p["x"], p["y"], epsg_code(source)))
        .otherwise(_unknown(source))
    )

    def onwards(q: Column) -> Column:
        return (
            F.when(target == "EPSG:4326", q)
            .when(target == "EPSG:3857", to_mercator(q["x"], q["y"]))
            .when(is_utm(target), utm_project(q["x"], q["y"], epsg_code(target)))
            .otherwise(_unknown(target))
        )

    same = (source == target) & (source.isin("EPSG:4326", "EPSG:3857") | is_utm(source))
    return F.when(p.isNull(), F.lit(None)).when(same, point(p["x"], p["y"])).otherwise(let(degrees, onwards))


def reproject(ring: Column, source: Column, target: Column) -> Column:
    return F.transform(ring, lambda p: reproject_point(p, source, target))


def _series(terms: tuple[float, ...], z: np.ndarray) -> np.ndarray:
    """Sum of ``terms[j - 1] * sin(2 j z)`` for complex angles, by Clenshaw's rule."""
    double = 2.0 * np.cos(2.0 * z)
    ahead, further = np.zeros_like(z), np.zeros_like(z)
    for term in reversed(terms):
        ahead, further = term + double * ahead - further, ahead
    return ahead * np.sin(2.0 * z)


def _utm_of_degrees(x: np.ndarray, y: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`utm_project` for arrays; NaN beyond UTM_LIMIT, where the series does not converge."""
    lam, sine = np.radians(x - (epsg % 100 * 6.0 - 183.0)), np.sin(np.radians(y))
    t = np.sinh(np.arctanh(sine) - ECCENTRICITY * np.arctanh(ECCENTRICITY * sine))
    across = np.sin(lam) / np.sqrt(1.0 + t * t)
    across = np.where(np.abs(across) <= UTM_SINE, across, np.nan)
    z = np.arctan2(t, np.cos(lam)) + 1j * np.arctanh(across)
    z = UTM_SCALE * RECTIFYING_RADIUS * (z + _series(KRUEGER, z))
    return UTM_EASTING + z.imag, (UTM_SOUTH if epsg // 100 == 327 else 0.0) + z.real


def _degrees_of_utm(x: np.ndarray, y: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`utm_unproject` for arrays."""
    scale, south = UTM_SCALE * RECTIFYING_RADIUS, UTM_SOUTH if epsg // 100 == 327 else 0.0
    z = (y - south) / scale + 1j * ((x - UTM_EASTING) / scale)
    z = z - _series(INVERSE, z)
    q = np.arctanh(np.sin(z.real) / np.cosh(z.imag))
    sine = np.tanh(q)
    for _ in range(7):
        sine = np.tanh(q + ECCENTRICITY * np.arctanh(ECCENTRICITY * sine))
    return epsg % 100 * 6.0 - 183.0 + np.degrees(np.arctan2(np.sinh(z.imag), np.cos(z.real))), np.degrees(np.arcsin(sine))


def _moved(x: np.ndarray, y: np.ndarray, source: str, target: str) -> tuple[np.ndarray, np.ndarray]:
    """:func:`reproject_point` for arrays; one of the systems is a UTM zone."""
    if source == target:
        return x, y
    if source == "EPSG:3857":
        x, y = np.degrees(x / MERCATOR_R), np.degrees(2.0 * np.arctan(np.exp(y / MERCATOR_R)) - math.pi / 2)
    elif source != "EPSG:4326":
        x, y = _degrees_of_utm(x, y, int(source[5:]))
    if target == "EPSG:3857":
        return MERCATOR_R * np.radians(x), MERCATOR_R * np.log(np.tan(math.pi / 4 + np.radians(y) / 2.0))
    return (x, y) if target == "EPSG:4326" else _utm_of_degrees(x, y, int(target[5:]))


def densified_bounds(box: Column, source: Column, target: Column, extra: int = 21) -> Column:
    """Bounds of a box after projection, with ``extra`` points added along each edge.

    Between degrees and Mercator metres each axis is stretched by itself, so the corners alone make the bounds. The
    points of boxes that go to or come from a UTM zone are projected as arrays, a batch of boxes at a time. Points
    that a zone cannot show (some 80 degrees and more beside its central meridian) do not count. The equator beyond
    the poles is a seam of a zone; an outline that crosses it is put together on the side of the zone's own pole.
    """
    turn = 2.0 * math.pi * UTM_SCALE * RECTIFYING_RADIUS
    plain = lambda crs: F.coalesce(crs.isin("EPSG:4326", "EPSG:3857"), F.lit(False))
    known = lambda crs: plain(crs) | F.coalesce(is_utm(crs), F.lit(False))
    unknown = F.when(~known(source), source).otherwise(target)
    # the other corner is reached as the points of the edges are
    corners = (box["minx"], box["miny"]), (box["minx"] + (box["maxx"] - box["minx"]), box["miny"] + (box["maxy"] - box["miny"]))
    stretched = [
        F.when(source == target, point(x, y)).when(source == "EPSG:4326", to_mercator(x, y)).otherwise(from_mercator(x, y)) for x, y in corners
    ]

    @F.pandas_udf("minx double, miny double, maxx double, maxy double")
    def through_utm(rows: pd.DataFrame) -> pd.DataFrame:
        share = np.arange(extra + 2) / float(extra + 1)
        found = np.full((len(rows), 4), np.nan)
        for (first, second), at in rows.groupby(["source", "target"]).indices.items():
            minx, miny, maxx, maxy = (rows[c].to_numpy(dtype=float)[at, None] for c in ("minx", "miny", "maxx", "maxy"))
            across, up = minx + share * (maxx - minx), miny + share * (maxy - miny)
            x = np.concatenate([across, across, minx + 0 * share, maxx + 0 * share], axis=1)
            y = np.concatenate([miny + 0 * share, maxy + 0 * share, up, up], axis=1)
            with np.errstate(all="ignore"):
                x, y = _moved(x, y, first, second)
            if second[5:7] == "32":
                south = second[5:8] == "327"
                north = y - (UTM_SOUTH if south else 0.0)
                far = north < -turn / 4, north > turn / 4
                split = far[0].any(axis=1, keepdims=True) & far[1].any(axis=1, keepdims=True)
                y = np.where(split & far[south], y + (-turn if south else turn), y)
            found[at] = np.stack([np.fmin.reduce(x, axis=1), np.fmin.reduce(y, axis=1), np.fmax.reduce(x, axis=1), np.fmax.reduce(y, axis=1)], axis=1)
        return pd.DataFrame(found, columns=["minx", "miny", "maxx", "maxy"])

    separate = plain(source) & plain(target)
    parts = F.struct(*[box[c].alias(c) for c in ("minx", "miny", "maxx", "maxy")], source.alias("source"), target.alias("target"))
    curved = through_utm(F.when(~separate & known(source) & known(target), parts))
    error = F.raise_error(F.concat(F.lit("unknown coordinate system: "), F.coalesce(unknown, F.lit("none"))))
    failed = error.cast("struct<minx: double, miny: double, maxx: double, maxy: double>")
    return F.when(separate, bounds(F.array(*stretched))).when(known(source) & known(target), curved).otherwise(failed)


def project_ring_to_utm(ring: Column, epsg: Column) -> Column:
    return F.transform(ring, lambda p: utm_project(p["x"], p["y"], epsg))


def area_m2(ring: Column, holes: Column, crs: Column) -> Column:
    """Square metres: planar in EPSG:3857, through the local UTM zone in EPSG:4326, else NULL."""

    def through_utm(epsg: Column) -> Column:
        outer = let(project_ring_to_utm(ring, epsg), lambda r: F.abs(signed_area(r)))
        return outer - F.aggregate(
            holes,
            F.lit(0.0),
            lambda s, h: s + let(project_ring_to_utm(h, epsg), lambda r: F.abs(signed_area(r))),
        )

    geographic = let(let(centroid(ring, holes), lambda c: utm_epsg(c["x"], c["y"])), through_utm)
    return F.when(crs == "EPSG:3857", area(ring, holes)).when(crs == "EPSG:4326", geographic)
