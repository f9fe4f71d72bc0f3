"""Queries over areas of interest."""

from pyspark.sql import functions as F

from rasterweave.functions import affine
from rasterweave.functions import geometry as G
from rasterweave.operators import rasters as R
from rasterweave.operators import spatial as SP
from rasterweave.plans.krueger import utm_sql, within_sql
from rasterweave.plans.registry import query


def _triangle(df):
    """Right triangle at (x0, y0) with legs of length w."""
    x, y, w = F.col("x0"), F.col("y0"), F.col("w")
    return df.select(
        "*", G.ring_of((x, y), (x + w, y), (x, y + w)).alias("ring"), F.array().cast(f"ARRAY<{G.RING}>").alias("holes")
    )


@query("G-1 G-2", "areas", """
SELECT aoi_id, 'Polygon' AS type, 4 AS points, x0 + w AS x_of_second, concat('{"type":"Polygon","coordinates":[[[', x0, ',', y0, '],[', x0 + w, ',', y0, '],[', x0, ',', y0 + w, '],[', x0, ',', y0, ']]]}') AS geojson
FROM (SELECT aoi_id, x0 + 0.5 AS x0, y0 + 0.5 AS y0, w FROM areas) z""")
def geojson_round_trip(v):
    # coordinates stay below 10^7 so that both engines print them without an exponent
    rows = _triangle(v.areas.withColumns({"x0": F.col("x0") + 0.5, "y0": F.col("y0") + 0.5}))
    x, y, w = F.col("x0"), F.col("y0"), F.col("w")
    number = lambda c: c.cast("decimal(12,1)").cast("string")
    corner = lambda a, b: F.concat(F.lit("["), number(a), F.lit(","), number(b), F.lit("]"))
    text = F.concat(
        F.lit('{"type":"Polygon","coordinates":[['),
        F.concat_ws(",", corner(x, y), corner(x + w, y), corner(x, y + w), corner(x, y)), F.lit("]]}"),
    )
    parsed = rows.withColumn("_g", G.parse_geojson(text))
    back = G.parse_geojson(G.to_geojson(F.col("_g.ring")))
    ring = back["ring"]
    again = F.concat(
        F.lit('{"type":"Polygon","coordinates":[['),
        F.array_join(F.transform(ring, lambda p: corner(p["x"], p["y"])), ","), F.lit("]]}"),
    )
    return parsed.select(
        "aoi_id", F.col("_g.type").alias("type"), F.size(ring).alias("points"),
        F.get(ring, F.lit(1))["x"].alias("x_of_second"), again.alias("geojson"),
    )


@query("G-3", "areas", "SELECT aoi_id, x0 AS minx, y0 AS miny, x0 + w AS maxx, y0 + w AS maxy FROM areas")
def aoi_bounds(v):
    return _triangle(v.areas).select("aoi_id", G.bounds(F.col("ring")).alias("b")).select("aoi_id", "b.*")


@query("G-4", "geo_areas", """
SELECT aoi_id, round(x0 + w / 3, 6) AS x, round(y0 + w / 3, 6) AS y,
       CAST(CASE WHEN y0 + w / 3 >= 0 THEN 32600 ELSE 32700 END + least(floor((x0 + w / 3 + 180) / 6) + 1, 60) AS INT) AS epsg FROM geo_areas""")
def centroids_and_zones(v):
    rows = _triangle(v.geo_areas).withColumn("_c", G.centroid(F.col("ring"), F.col("holes")))
    return rows.select(
        "aoi_id", F.round("_c.x", 6).alias("x"), F.round("_c.y", 6).alias("y"),
        G.utm_epsg(F.col("_c.x"), F.col("_c.y")).cast("int").alias("epsg"),
    )


_ZONED = """
z AS (SELECT *, CAST(CASE WHEN y0 + w / 3 >= 0 THEN 32600 ELSE 32700 END + least(floor((x0 + w / 3 + 180) / 6) + 1, 60) AS BIGINT) AS epsg FROM geo_areas),
p1 AS (SELECT aoi_id, {a} FROM z), p2 AS (SELECT aoi_id, {b} FROM z), p3 AS (SELECT aoi_id, {c} FROM z),
ar AS (SELECT aoi_id, abs((p2.e - p1.e) * (p3.n - p1.n) - (p3.e - p1.e) * (p2.n - p1.n)) / 2 AS area
       FROM p1 JOIN p2 USING (aoi_id) JOIN p3 USING (aoi_id))""".format(
    a=utm_sql("x0", "y0", "epsg"), b=utm_sql("x0 + w", "y0", "epsg"), c=utm_sql("x0", "y0 + w", "epsg")
)


@query("G-5", "geo_areas", f"WITH {_ZONED} SELECT aoi_id, round(area, 1) AS area_m2 FROM ar")
def geographic_areas(v):
    rows = _triangle(v.geo_areas)
    area = G.area_m2(F.col("ring"), F.col("holes"), F.lit("EPSG:4326"))
    return rows.select("aoi_id", F.round(area, 1).alias("area_m2"))


@query("G-5", "areas", "SELECT aoi_id, w * w / 2 - w * w / 32 AS area_m2 FROM areas")
def areas_with_hole(v):
    x, y, w = F.col("x0"), F.col("y0"), F.col("w")
    a, s = w / 8, w / 4
    hole = G.ring_of((x + a, y + a), (x + a + s, y + a), (x + a, y + a + s))
    rows = _triangle(v.areas).withColumn("holes", F.array(hole))
    return rows.select("aoi_id", G.area_m2(F.col("ring"), F.col("holes"), F.lit("EPSG:3857")).alias("area_m2"))


@query("G-6", "geo_areas", """
SELECT aoi_id, round(6378137.0 * radians(x0 + w), 3) AS mx, round(6378137.0 * ln(tan(pi() / 4 + radians(y0) / 2)), 3) AS my,
       round(x0 + w, 6) AS back_x, round(y0, 6) AS back_y FROM geo_areas""")
def reprojection(v):
    ring = F.col("ring")
    there = G.reproject(ring, F.lit("EPSG:4326"), F.lit("EPSG:3857"))
    rows = _triangle(v.geo_areas).withColumn("_m", there)
    back = G.reproject(F.col("_m"), F.lit("EPSG:3857"), F.lit("EPSG:4326"))
    second, again = F.get("_m", F.lit(1)), F.get(back, F.lit(1))
    return rows.select(
        "aoi_id", F.round(second["x"], 3).alias("mx"), F.round(second["y"], 3).alias("my"),
        F.round(again["x"], 6).alias("back_x"), F.round(again["y"], 6).alias("back_y"),
    )


@query("G-7", "geo_areas", """
SELECT aoi_id, round(6378137.0 * radians(x0), 3) AS minx, round(6378137.0 * ln(tan(pi() / 4 + radians(y0) / 2)), 3) AS miny,
       round(6378137.0 * radians(x0 + w), 3) AS maxx, round(6378137.0 * ln(tan(pi() / 4 + radians(y0 + w) / 2)), 3) AS maxy FROM geo_areas""")
def densified_bounds(v):
    rows = _triangle(v.geo_areas).withColumn("crs", F.lit("EPSG:4326"))
    box = SP.aoi_bounds_in(rows, "EPSG:3857").select("aoi_id", "bounds.*")
    return box.select("aoi_id", *[F.round(c, 3).alias(c) for c in ("minx", "miny", "maxx", "maxy")])


@query("F-4", "customer", """
SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'EPSG:4326' WHEN 1 THEN 'EPSG:3857' WHEN 2 THEN concat('EPSG:', 32601 + c_custkey % 60)
  WHEN 3 THEN 'EPSG:4326' WHEN 4 THEN 'EPSG:4326' ELSE NULL END AS crs FROM customer""")
def crs_codes(v):
    k = F.col("c_custkey")
    zone = (32601 + k % 60).cast("string")
    text = (
        F.when(k % 8 == 0, "epsg:4326").when(k % 8 == 1, " EPSG:3857 ").when(k % 8 == 2, F.concat(F.lit("EPSG:"), zone))
        .when(k % 8 == 3, "WGS84").when(k % 8 == 4, "urn:ogc:def:crs:EPSG::4326").when(k % 8 == 5, "EPSG:32661")
        .when(k % 8 == 6, "").otherwise("nonsense")
    )
    return v.customer.select("c_custkey", G.normalise_crs(text).alias("crs"))


@query("F-3", "geo_areas", f"""
WITH {_ZONED}
SELECT z.aoi_id, concat_ws(',', CASE WHEN z.aoi_id % 9 = 1 THEN 'not_polygon' END, CASE WHEN z.aoi_id % 9 = 2 THEN 'self_intersection' END,
  CASE WHEN z.aoi_id % 9 = 3 THEN 'zero_area' END, CASE WHEN z.aoi_id % 9 = 4 THEN 'unsupported_crs' END,
  CASE WHEN z.aoi_id % 9 NOT IN (1, 2, 3, 4) AND area > 5000000 THEN 'too_large' END) AS errors
FROM z JOIN ar USING (aoi_id)""")
def aoi_problems(v):
    k = F.col("aoi_id") % 9
    x, y, w = F.col("x0"), F.col("y0"), F.col("w")
    # a bow tie smaller than the area limit, and a triangle flattened to a line
    bow = G.ring_of((x, y), (x + 0.001, y + 0.001), (x + 0.001, y), (x, y + 0.0012))
    line = F.array(*[G.point(x, y), G.point(x, y), G.point(x, y), G.point(x, y)])
    rows = _triangle(v.geo_areas).select(
        "aoi_id", F.when(k == 1, "Point").otherwise("Polygon").alias("type"),
        F.when(k == 4, "EPSG:32643").otherwise("EPSG:4326").alias("crs"),
        F.when(k == 2, bow).when(k == 3, line).otherwise(F.col("ring")).alias("ring"), "holes",
    )
    return SP.validate_aois(rows).select("aoi_id", F.concat_ws(",", "errors").alias("errors"))


_MERCATOR_TO_DEGREES = "degrees({x} / 6378137.0)", "degrees(2 * atan(exp({y} / 6378137.0)) - pi() / 2)"


@query("J-2 F-3", "areas rasters", f"""
WITH a AS (SELECT aoi_id, x0, y0, x0 + w AS x1, y0 + w AS y1, 'EPSG:3857' AS crs FROM areas UNION ALL
  SELECT aoi_id, {_MERCATOR_TO_DEGREES[0].format(x='x0')}, {_MERCATOR_TO_DEGREES[1].format(y='y0')},
    {_MERCATOR_TO_DEGREES[0].format(x='(x0 + w)')}, {_MERCATOR_TO_DEGREES[1].format(y='(y0 + w)')}, 'EPSG:4326' FROM areas)
SELECT aoi_id, scene_id FROM a JOIN (SELECT scene_id, crs, c AS rx, f + e * height AS ry, c + a * width AS sx, f AS sy FROM rasters) r USING (crs)
WHERE NOT (x1 <= rx OR x0 >= sx OR y1 <= ry OR y0 >= sy)""")
def extents_that_overlap(v):
    """Rasters of every system, AOIs in Mercator metres."""
    aois = _triangle(v.areas).withColumn("crs", F.lit("EPSG:3857"))
    t = affine.transform_of(F.col("a"), 0.0, F.col("c"), 0.0, F.col("e"), F.col("f"))
    rasters = v.rasters.select("scene_id", "crs", affine.bounds(t, F.col("width"), F.col("height")).alias("bounds"))
    return SP.coverage(aois, rasters)


#: corner points of the densified outline of an AOI's box, and their extent in a scene's UTM zone
_OUTLINE = """
edge AS (SELECT unnest(range(23)) / 22.0 AS t),
dense AS (SELECT aoi_id, x0 + t * w AS lon, y0 AS lat, x0, w FROM geo_areas, edge UNION ALL SELECT aoi_id, x0 + t * w, y0 + w, x0, w FROM geo_areas, edge
  UNION ALL SELECT aoi_id, x0, y0 + t * w, x0, w FROM geo_areas, edge UNION ALL SELECT aoi_id, x0 + w, y0 + t * w, x0, w FROM geo_areas, edge)"""


@query("J-2 G-6 G-7", "geo_areas zone_rasters", f"""
WITH {_OUTLINE},
sys AS (SELECT DISTINCT epsg FROM zone_rasters),
p AS (SELECT aoi_id, epsg, {utm_sql('lon', 'lat', 'epsg')} FROM dense, sys WHERE {within_sql('lon', 'lat', 'epsg')}),
b AS (SELECT aoi_id, epsg, min(e) AS x0, max(e) AS x1, min(n) AS y0, max(n) AS y1 FROM p GROUP BY aoi_id, epsg)
SELECT aoi_id, scene_id FROM b JOIN zone_rasters USING (epsg)
WHERE NOT (x1 <= c OR x0 >= c + size * 100 OR y1 <= f - size * 100 OR y0 >= f)""")
def extents_in_own_zones(v):
    """Rasters in UTM zones all over the world, from 100 metres to 1,600 kilometres wide; AOIs in degrees."""
    t = affine.transform_of(F.col("size"), 0.0, F.col("c"), 0.0, -F.col("size"), F.col("f"))
    rasters = v.zone_rasters.select(
        "scene_id", F.concat(F.lit("EPSG:"), "epsg").alias("crs"), affine.bounds(t, F.lit(100), F.lit(100)).alias("bounds")
    )
    return SP.coverage(_triangle(v.geo_areas).withColumn("crs", F.lit("EPSG:4326")), rasters)


@query("G-6", "geo_areas", """
SELECT aoi_id, round(x0 + w, 8) AS x, round(y0, 8) AS y FROM geo_areas""")
def zone_round_trip(v):
    """Degrees to the metres of a neighbouring UTM zone, to Mercator, and back to degrees."""
    zone = F.concat(
        F.when(F.col("y0") < 0, "EPSG:327").otherwise("EPSG:326"), F.lpad(G.utm_zone(F.col("x0") + 6 * F.signum(-F.col("x0"))), 2, "0")
    )
    there = G.reproject(F.col("ring"), F.lit("EPSG:4326"), zone)
    rows = _triangle(v.geo_areas).select("aoi_id", zone.alias("zone"), there.alias("there"))
    mercator = rows.select("aoi_id", G.reproject(F.col("there"), F.col("zone"), F.lit("EPSG:3857")).alias("m"))
    back = mercator.select("aoi_id", F.get(G.reproject(F.col("m"), F.lit("EPSG:3857"), F.lit("EPSG:4326")), F.lit(1)).alias("p"))
    return back.select("aoi_id", F.round("p.x", 8).alias("x"), F.round("p.y", 8).alias("y"))


@query("J-3", "aois grid", """
SELECT aoi_id, a.scene_id, CAST(row_idx - y0 AS BIGINT) AS row_idx, CAST(col_idx - x0 AS BIGINT) AS col_idx,
       (col_idx + 0.5 - x0) + (row_idx + 0.5 - y0) < w AS inside,
       CASE WHEN (col_idx + 0.5 - x0) + (row_idx + 0.5 - y0) < w THEN after_id ELSE 0 END AS after_id
FROM aois a JOIN grid g ON g.scene_id = a.scene_id AND row_idx >= y0 AND row_idx < y0 + w AND col_idx >= x0 AND col_idx < x0 + w""")
def clip_to_aoi(v):
    t = affine.transform_of(1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    rasters = v.grid.select("scene_id").distinct().select(
        "scene_id", F.lit(50).alias("width"), F.lit(50).alias("height"), t.alias("transform")
    )
    return SP.clip(v.grid, _triangle(v.aois), rasters, ["after_id"], cell=16)


def _clipped_pixels(blocks, value):
    rows = R.from_blocks(blocks.withColumn("scene_id", F.struct("aoi_id", "scene_id")), ["inside", value])
    return rows.select("scene_id.*", "row_idx", "col_idx", "inside", value)


@query("J-3 C-14", "aois grid", """
SELECT aoi_id, a.scene_id, CAST(row_idx - y0 AS BIGINT) AS row_idx, CAST(col_idx - x0 AS BIGINT) AS col_idx, inside,
       CASE WHEN inside THEN after_id ELSE 0 END AS after_id
FROM (SELECT *, col_idx + 0.5 - x0 + row_idx + 0.5 - y0 AS far, greatest(col_idx + 0.5 - x0 - 1, 0) AS hx, greatest(row_idx + 0.5 - y0 - 1, 0) AS hy,
        far < w AND NOT (col_idx + 0.5 - x0 >= 1 AND row_idx + 0.5 - y0 >= 1 AND hx + hy < w / 4) AS inside
      FROM aois a JOIN grid g ON g.scene_id = a.scene_id AND row_idx >= y0 AND row_idx < y0 + w AND col_idx >= x0 AND col_idx < x0 + w) a""")
def clip_blocks_to_aoi(v):
    """Triangles with a triangular hole, clipped from blocks."""
    x, y, h = F.col("x0") + 1.0, F.col("y0") + 1.0, F.col("w") / 4
    aois = _triangle(v.aois).withColumn("holes", F.array(G.ring_of((x, y), (x + h, y), (x, y + h)))).withColumn("crs", F.lit("EPSG:3857"))
    t = affine.transform_of(1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    rasters = v.grid.select("scene_id").distinct().select(
        "scene_id", F.lit("EPSG:3857").alias("crs"), F.lit(50).alias("width"), F.lit(50).alias("height"), t.alias("transform")
    )
    blocks = R.to_blocks(v.grid.select(*R.PIXEL_KEY, "after_id"), ["after_id"], 8)
    done = SP.clip_blocks(blocks, aois, rasters, ["after_id"], size=8)
    # scenes that end inside a block have cells without a pixel
    return _clipped_pixels(done, "after_id").where("NOT inside OR after_id IS NOT NULL").join(
        v.grid.select("scene_id", "row_idx", "col_idx").withColumnsRenamed({"row_idx": "_r", "col_idx": "_c"}).join(v.aois, "scene_id").select(
            "aoi_id", "scene_id", (F.col("_r") - F.col("y0")).cast("long").alias("row_idx"), (F.col("_c") - F.col("x0")).cast("long").alias("col_idx")),
        ["aoi_id", "scene_id", "row_idx", "col_idx"], "left_semi")


@query("J-3 G-6 G-8", "aois grid", """
SELECT aoi_id, a.scene_id, CAST(row_idx - y0 AS BIGINT) AS row_idx, CAST(col_idx - x0 AS BIGINT) AS col_idx, after_id
FROM aois a JOIN grid g ON g.scene_id = a.scene_id AND row_idx >= y0 AND row_idx <= y0 + w AND col_idx >= x0 AND col_idx <= x0 + w
WHERE (col_idx + 0.25 - x0) + (row_idx + 0.25 - y0) < w AND col_idx >= x0 AND row_idx >= y0""")
def clip_geographic_aois(v):
    """AOIs drawn in degrees over scenes in UTM metres or Mercator metres; pixels inside only."""
    utm = F.col("scene_id") % 2 == 0
    x, y, w = F.col("x0") + 0.25, F.col("y0") + 0.25, F.col("w")
    systems = v.grid.select("scene_id").distinct().select(
        "scene_id", F.when(utm, "EPSG:32643").otherwise("EPSG:3857").alias("crs"), F.lit(50).alias("width"), F.lit(50).alias("height"),
        affine.transform_of(10.0, 0.0, 500000.0, 0.0, -10.0, 3100000.0).alias("transform"),
    )
    world = lambda a, b: affine.to_world(F.col("transform"), a, b)
    ring = F.array(world(x, y), world(x + w, y), world(x, y + w), world(x, y))
    drawn = v.aois.join(systems, "scene_id").select(
        "aoi_id", "scene_id", F.lit("EPSG:4326").alias("crs"), G.reproject(ring, F.col("crs"), F.lit("EPSG:4326")).alias("ring"),
        F.array().cast(f"ARRAY<{G.RING}>").alias("holes"),
    )
    blocks = R.to_blocks(v.grid.select(*R.PIXEL_KEY, "after_id"), ["after_id"], 16)
    done = _clipped_pixels(SP.clip_blocks(blocks, drawn, systems, ["after_id"], size=16), "after_id")
    return done.where("inside AND after_id IS NOT NULL").select("aoi_id", "scene_id", "row_idx", "col_idx", "after_id")
