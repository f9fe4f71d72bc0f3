"""Queries over connected regions and their outlines."""

from pyspark.sql import functions as F

from rasterweave.functions import affine
from rasterweave.functions import geometry as G
from rasterweave.operators import change as CH
from rasterweave.operators import components as K
from rasterweave.operators import rasters as R
from rasterweave.plans.krueger import utm_sql
from rasterweave.plans.registry import query
from rasterweave.sources import sinks

SCENE, BLOCK = 50, 16

# flood fill from every pixel to smaller positions until nothing changes
_FILL = """
cells AS (SELECT scene_id, row_idx, col_idx, {value} AS class_id, row_idx * 50 + col_idx AS pos FROM grid WHERE {value} <> 0),
links AS (SELECT a.scene_id, a.pos, b.pos AS near FROM cells a JOIN cells b ON a.scene_id = b.scene_id AND a.class_id = b.class_id
          AND abs(a.row_idx - b.row_idx) + abs(a.col_idx - b.col_idx) = 1
          AND b.pos IN (a.pos - 50, a.pos - 1, a.pos + 1, a.pos + 50)),
reach(scene_id, pos, root) AS (
  SELECT scene_id, pos, pos FROM cells
  UNION SELECT r.scene_id, l.near, r.root FROM reach r JOIN links l ON l.scene_id = r.scene_id AND l.pos = r.pos AND l.near > r.root),
named AS (SELECT scene_id, pos, min(root) AS region FROM reach GROUP BY 1, 2),
regions AS (SELECT c.*, n.region FROM cells c JOIN named n ON c.scene_id = n.scene_id AND c.pos = n.pos)"""
_AFTER = _FILL.format(value="after_id")
_CHANGED = _FILL.format(value="(CASE WHEN before_id <> 0 AND after_id <> 0 AND before_id <> after_id THEN 1 ELSE 0 END)")


def _regions(v, keep=()):
    pixels = v.grid.select(*R.PIXEL_KEY, F.col("after_id").alias("class_id"), *keep)
    return K.regions_of_pixels(pixels, BLOCK, keep=keep)


def _scene_rasters(v):
    """A geographic raster per scene of the grid."""
    t = affine.transform_of(0.0001, 0.0, 77.0, 0.0, -0.0001, 28.0)
    return v.grid.select("scene_id").distinct().select(
        "scene_id", F.lit(SCENE).alias("width"), F.lit(SCENE).alias("height"),
        F.lit("EPSG:4326").alias("crs"), t.alias("transform"),
    )


@query("A-20 U-8", "grid", f"WITH RECURSIVE {_AFTER} SELECT scene_id, row_idx, col_idx, class_id, region FROM regions")
def connected_regions(v):
    rows = _regions(v)
    return rows.select(
        *R.PIXEL_KEY, "class_id", K.linear_id(F.col("region_id"), F.lit(SCENE)).alias("region")
    )


@query("A-20", "grid", f"WITH RECURSIVE {_CHANGED} SELECT scene_id, count(DISTINCT region) AS regions, count(*) AS pixels FROM regions GROUP BY 1")
def change_regions(v):
    regions = K.regions_of_pixels(CH.change_mask(v.grid), BLOCK)
    return K.region_measures(regions).groupBy("scene_id").agg(
        F.count("*").alias("regions"), F.sum("pixels").alias("pixels")
    )


@query("A-23 A-22 F-7", "grid", f"""
WITH RECURSIVE {_AFTER}
SELECT r.scene_id, region, r.class_id, count(*) AS pixels, round(avg(confidence), 6) AS mean_confidence, count(*) * 100.0::DOUBLE AS area_m2
FROM regions r JOIN grid g ON g.scene_id = r.scene_id AND g.row_idx = r.row_idx AND g.col_idx = r.col_idx
GROUP BY 1, 2, 3 HAVING count(*) * 100.0 >= 300""")
def region_measures(v):
    measures = K.region_measures(_regions(v, ("confidence",)), conf="confidence")
    t = affine.transform_of(10.0, 0.0, 5e5, 0.0, -10.0, 3.1e6)
    rasters = v.grid.select("scene_id").distinct().withColumn("transform", t)
    areas = K.filter_area(K.planar_areas(measures, rasters), 300.0)
    return areas.select(
        "scene_id", K.linear_id(F.col("region_id"), F.lit(SCENE)).alias("region"), "class_id", "pixels",
        F.round("mean_confidence", 6).alias("mean_confidence"), "area_m2",
    )


@query("A-24", "grid", f"""
WITH RECURSIVE {_AFTER}
SELECT scene_id, class_id, count(*) * 100.0::DOUBLE AS area_m2, count(DISTINCT region) AS feature_count FROM regions GROUP BY 1, 2""")
def class_areas(v):
    t = affine.transform_of(10.0, 0.0, 5e5, 0.0, -10.0, 3.1e6)
    rasters = v.grid.select("scene_id").distinct().withColumn("transform", t)
    return K.class_areas(K.planar_areas(K.region_measures(_regions(v)), rasters))


@query("A-34", "grid", f"""
WITH RECURSIVE {_AFTER},
f AS (SELECT scene_id, class_id, region, count(*) * 100.0::DOUBLE AS area FROM regions GROUP BY 1, 2, 3),
d AS (SELECT CASE WHEN scene_id % 2 = 0 THEN 'urban' ELSE 'rural' END AS domain, class_id, area FROM f)
SELECT domain, class_id, sum(area) AS area_m2, count(*) AS features FROM d GROUP BY ROLLUP (domain, class_id)""")
def area_rollup(v):
    t = affine.transform_of(10.0, 0.0, 5e5, 0.0, -10.0, 3.1e6)
    rasters = v.grid.select("scene_id").distinct().withColumn("transform", t)
    areas = K.class_areas(K.planar_areas(K.region_measures(_regions(v)), rasters))
    domain = F.when(F.col("scene_id") % 2 == 0, "urban").otherwise("rural")
    return areas.withColumn("domain", domain).rollup("domain", "class_id").agg(
        F.sum("area_m2").alias("area_m2"), F.sum("feature_count").alias("features")
    )


_PIXEL_AREA = f"""
corner AS (SELECT y, x, {utm_sql('77 + 0.0001 * x', '28 - 0.0001 * y', '32643')} FROM
           (SELECT range AS y FROM range(0, 51)) a, (SELECT range AS x FROM range(0, 51)) b),
line AS (SELECT p.y, p.x AS x1, q.x AS x2, p.e AS e1, p.n AS n1, q.e AS e2, q.n AS n2 FROM corner p JOIN corner q ON p.y = q.y AND p.x < q.x)"""


@query("A-22", "grid", f"""
WITH RECURSIVE {_AFTER}, {_PIXEL_AREA},
o AS (SELECT any_value(e) AS oe, any_value(n) AS "on" FROM corner WHERE x = 25 AND y = 25),
edge AS (
  SELECT r.scene_id, r.region, 0 AS dir, r.row_idx AS y, r.col_idx AS pos FROM regions r LEFT JOIN regions s ON s.scene_id = r.scene_id AND s.pos = r.pos - 50 AND s.region = r.region WHERE s.pos IS NULL
  UNION ALL
  SELECT r.scene_id, r.region, 2, r.row_idx + 1, r.col_idx FROM regions r LEFT JOIN regions s ON s.scene_id = r.scene_id AND s.pos = r.pos + 50 AND s.region = r.region WHERE s.pos IS NULL
  UNION ALL
  SELECT r.scene_id, r.region, 1, r.col_idx + 1, r.row_idx FROM regions r LEFT JOIN regions s ON s.scene_id = r.scene_id AND s.pos = r.pos + 1 AND s.row_idx = r.row_idx AND s.region = r.region WHERE s.pos IS NULL
  UNION ALL
  SELECT r.scene_id, r.region, 3, r.col_idx, r.row_idx FROM regions r LEFT JOIN regions s ON s.scene_id = r.scene_id AND s.pos = r.pos - 1 AND s.row_idx = r.row_idx AND s.region = r.region WHERE s.pos IS NULL),
isle AS (SELECT *, pos - row_number() OVER (PARTITION BY scene_id, region, dir, y ORDER BY pos) AS i FROM edge),
run AS (SELECT scene_id, region, dir, y AS line, min(pos) AS a, max(pos) + 1 AS b FROM isle GROUP BY scene_id, region, dir, y, i),
seg AS (SELECT scene_id, region,
  CASE dir WHEN 0 THEN a WHEN 2 THEN b ELSE line END AS x1, CASE dir WHEN 1 THEN a WHEN 3 THEN b ELSE line END AS y1,
  CASE dir WHEN 0 THEN b WHEN 2 THEN a ELSE line END AS x2, CASE dir WHEN 1 THEN b WHEN 3 THEN a ELSE line END AS y2 FROM run)
SELECT seg.scene_id, seg.region, round(abs(sum((p.e - oe) * (q.n - "on") - (q.e - oe) * (p.n - "on")) / 2), 2) AS area_m2
FROM seg JOIN corner p ON p.x = x1 AND p.y = y1 JOIN corner q ON q.x = x2 AND q.y = y2, o GROUP BY 1, 2""")
def region_areas_geographic(v):
    regions = _regions(v)
    runs = K.outline_runs(K.outline_edges(regions))
    areas = K.geographic_areas(K.region_measures(regions), runs, _scene_rasters(v))
    return areas.select(
        "scene_id", K.linear_id(F.col("region_id"), F.lit(SCENE)).alias("region"), F.round("area_m2", 2).alias("area_m2")
    )


@query("A-21", "grid", f"""
WITH RECURSIVE {_AFTER} SELECT scene_id, region, CAST(count(*) AS DOUBLE) AS area FROM regions GROUP BY 1, 2""")
def outline_areas(v):
    runs = K.outline_runs(K.outline_edges(_regions(v)))
    rings = K.ring_areas(K.outline_rings(runs))
    return rings.groupBy("scene_id", K.linear_id(F.col("region_id"), F.lit(SCENE)).alias("region")).agg(
        F.sum("area").alias("area")
    )


@query("S-8 A-21 G-2", "grid", f"""
WITH RECURSIVE {_AFTER}, f AS (
  SELECT r.scene_id, region, r.class_id, round(avg(confidence), 4) AS c FROM regions r
  JOIN grid g ON g.scene_id = r.scene_id AND g.row_idx = r.row_idx AND g.col_idx = r.col_idx GROUP BY 1, 2, 3)
SELECT scene_id, class_id, count(*) AS features, round(sum(c), 4) AS confidence, 'EPSG:4326' AS crs FROM f GROUP BY 1, 2""")
def feature_lines(v):
    """GeoJSON features of all regions, read back and counted per class."""
    regions = _regions(v, ("confidence",))
    rasters = _scene_rasters(v)
    runs = K.outline_runs(K.outline_edges(regions))
    areas = K.geographic_areas(K.region_measures(regions, conf="confidence"), runs, rasters)
    shapes = K.polygons(K.outline_rings(runs), rasters)
    features = shapes.join(areas, ["scene_id", "region_id"]).join(rasters.select("scene_id", "crs"), "scene_id")
    schema = "type STRING, properties STRUCT<class_id: INT, area_m2: DOUBLE, mean_confidence: DOUBLE, crs: STRING>"
    lines = sinks.feature_lines(features).select("scene_id", F.from_json("doc", schema).alias("d"))
    return lines.where("d.type = 'Feature' AND d.properties.area_m2 > 0").groupBy(
        "scene_id", F.col("d.properties.class_id").alias("class_id"), F.col("d.properties.crs").alias("crs")
    ).agg(
        F.count("*").alias("features"), F.round(F.sum(F.round("d.properties.mean_confidence", 4)), 4).alias("confidence")
    )


@query("S-8 A-21 G-2 G-3", "grid", f"""
WITH RECURSIVE {_AFTER}
SELECT scene_id, CAST(class_id AS INT) AS class_id, count(*) AS pixels, round(77 + 0.0001::DOUBLE * min(col_idx), 6) AS minx, round(77 + 0.0001::DOUBLE * (max(col_idx) + 1), 6) AS maxx,
  round(28 - 0.0001::DOUBLE * (max(row_idx) + 1), 6) AS miny, round(28 - 0.0001::DOUBLE * min(row_idx), 6) AS maxy FROM regions GROUP BY scene_id, region, class_id""")
def feature_outlines(v):
    """Every written feature read back: its area in pixels, holes taken out, and the extent of its shell."""
    regions, rasters = _regions(v, ("confidence",)), _scene_rasters(v)
    runs = K.outline_runs(K.outline_edges(regions))
    areas = K.geographic_areas(K.region_measures(regions, conf="confidence"), runs, rasters)
    shapes = K.polygons(K.outline_rings(runs), rasters)
    features = shapes.join(areas, ["scene_id", "region_id"]).join(rasters.select("scene_id", "crs"), "scene_id")
    schema = "properties STRUCT<class_id: INT>, geometry STRUCT<coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>"
    parsed = sinks.feature_lines(features).select("scene_id", F.from_json("doc", schema).alias("d"))
    rings = F.transform("d.geometry.coordinates", lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    rows = parsed.select("scene_id", F.col("d.properties.class_id").alias("class_id"), rings.alias("rings"))
    area = F.abs(F.aggregate("rings", F.lit(0.0), lambda s, r: s + G.signed_area(r)))
    rows = rows.select("scene_id", "class_id", F.round(area / 1e-8).cast("long").alias("pixels"), G.bounds(F.get("rings", F.lit(0))).alias("b"))
    return rows.select("scene_id", "class_id", "pixels", *[F.round(f"b.{c}", 6).alias(c) for c in ("minx", "maxx", "miny", "maxy")])


@query("S-9 A-21", "grid", f"""
WITH RECURSIVE {_CHANGED}
SELECT scene_id, count(DISTINCT region) AS features, true AS changed, true AS closed, round(count(*), 3) AS area FROM regions GROUP BY 1""")
def change_lines(v):
    regions = K.regions_of_pixels(CH.change_mask(v.grid), BLOCK)
    identity = v.grid.select("scene_id").distinct().withColumn(
        "transform", affine.transform_of(1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    )
    shapes = K.polygons(K.outline_rings(K.outline_runs(K.outline_edges(regions))), identity)
    lines = sinks.change_lines(shapes)
    schema = "properties STRUCT<changed: BOOLEAN>, geometry STRUCT<coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>"
    parsed = lines.select("scene_id", F.from_json("doc", schema).alias("d"))
    rings = F.transform(
        "d.geometry.coordinates",
        lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))),
    )
    area = F.aggregate(rings, F.lit(0.0), lambda s, r: s + G.signed_area(r))
    closed = F.forall("d.geometry.coordinates", lambda r: r[0] == F.element_at(r, -1))
    return parsed.groupBy("scene_id").agg(
        F.count("*").alias("features"), F.every("d.properties.changed").alias("changed"),
        F.every(closed).alias("closed"), F.round(F.sum(area), 3).alias("area"),
    )
