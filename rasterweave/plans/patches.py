"""Queries over blocks whose pixels meet those of neighbouring blocks."""

import numpy as np
from pyspark.sql import functions as F

from rasterweave.functions import affine
from rasterweave.functions import geometry as G
from rasterweave.operators import components as K
from rasterweave.operators import patches as P
from rasterweave.operators import rasters as R
from rasterweave.operators.analysis import analyse
from rasterweave.operators.extensions import score_blocks
from rasterweave.operators.images import HAAR
from rasterweave.plans.regions import _AFTER
from rasterweave.plans.registry import query

SCENE = 50
#: odd, so that 2 x 2 cells lie across block borders
BLOCK = 17


def _scenes(v):
    return v.grid.select("scene_id").distinct().select("scene_id", F.lit(SCENE).alias("height"), F.lit(SCENE).alias("width"))


def _blocks(v, *values):
    return R.to_blocks(v.grid.select(*R.PIXEL_KEY, *values), list(values), BLOCK, _scenes(v))


def _rows(blocks, *values):
    """Pixels of a result; the last scene may end early."""
    return R.from_blocks(blocks, list(values)).where(F.col(values[0]).isNotNull())


@query("F-24 U-2", "grid", """
SELECT scene_id, row_idx, col_idx, after_id FROM (
  SELECT scene_id, CASE scene_id % 4 WHEN 0 THEN row_idx WHEN 1 THEN 49 - c WHEN 2 THEN 49 - row_idx ELSE c END AS row_idx,
         CASE scene_id % 4 WHEN 0 THEN c WHEN 1 THEN row_idx WHEN 2 THEN 49 - c ELSE 49 - row_idx END AS col_idx, after_id
  FROM (SELECT scene_id, row_idx, CASE WHEN scene_id % 2 = 1 THEN 49 - col_idx ELSE col_idx END AS c, after_id FROM grid) a) b""")
def turned_blocks(v):
    k = F.col("scene_id")
    change = F.struct((k % 2 == 1).alias("hflip"), F.lit(False).alias("vflip"), (k % 4 * 90).cast("int").alias("angle"))
    return _rows(P.transform_blocks(_blocks(v, "after_id"), ["after_id"], _scenes(v), change, BLOCK), "after_id")


_SIZES = "z AS (SELECT DISTINCT scene_id, 20 + scene_id % 41 AS nh, 70 - scene_id % 41 AS nw FROM grid), s AS (SELECT DISTINCT unnest([nh, nw]) AS n FROM z)"


def _new_sizes():
    k = F.col("scene_id") % 41
    return 20 + k, 70 - k


@query("F-26", "grid", f"""
WITH {_SIZES}, o AS (SELECT n, i, CAST(floor((i + 0.5) * (50.0::DOUBLE / n)) AS BIGINT) AS j FROM s, range(0, 71) r(i) WHERE i < n)
SELECT scene_id, r.i AS row_idx, c.i AS col_idx, after_id FROM grid JOIN z USING (scene_id)
JOIN o r ON r.n = nh AND r.j = row_idx JOIN o c ON c.n = nw AND c.j = col_idx""")
def nearest_blocks(v):
    """A size per scene, smaller and larger ones."""
    blocks = P.resize_blocks_nearest(_blocks(v, "after_id"), ["after_id"], _scenes(v), *_new_sizes(), BLOCK)
    return _rows(blocks, "after_id")


@query("F-26", "grid", f"""
WITH {_SIZES}, o AS (SELECT n, i, (i + 0.5::DOUBLE) * (50.0::DOUBLE / n) AS ct, greatest(50.0::DOUBLE / n, 1) AS re FROM s, range(0, 71) r(i) WHERE i < n),
w AS (SELECT n, i, j, greatest(1 - abs((j + 0.5::DOUBLE - ct) / re), 0) AS u FROM o, range(0, 50) q(j)
      WHERE j >= greatest(floor(ct - re + 0.5), 0) AND j < least(floor(ct + re + 0.5), 50)),
k AS (SELECT n, i, j, u / sum(u) OVER (PARTITION BY n, i) AS u FROM w)
SELECT scene_id, r.i AS row_idx, c.i AS col_idx, round(sum(r.u * c.u * confidence), 6) AS confidence
FROM grid JOIN z USING (scene_id) JOIN k r ON r.n = nh AND r.j = row_idx JOIN k c ON c.n = nw AND c.j = col_idx
WHERE r.u > 0 AND c.u > 0 GROUP BY 1, 2, 3""")
def bilinear_blocks(v):
    """A size per scene, smaller and larger ones."""
    blocks = P.resize_blocks(_blocks(v, "confidence"), ["confidence"], _scenes(v), *_new_sizes(), BLOCK)
    return _rows(blocks, "confidence").withColumn("confidence", F.round("confidence", 6))


@query("F-27", "grid", """
SELECT scene_id, row_idx // 2 AS row_idx, col_idx // 2 AS col_idx,
  round(sum(confidence) * 0.5 * pow(2, -0.5), 6) AS ll,
  round(sum(CASE WHEN row_idx % 2 = 0 THEN -confidence ELSE confidence END) * 0.5 * pow(2, -0.5), 6) AS lh,
  round(sum(CASE WHEN col_idx % 2 = 0 THEN -confidence ELSE confidence END) * 0.5 * pow(2, -0.5), 6) AS hl,
  round(sum(CASE WHEN (row_idx + col_idx) % 2 = 0 THEN confidence ELSE -confidence END) * 0.5 * pow(2, -0.5), 6) AS hh
FROM grid GROUP BY 1, 2, 3 HAVING count(*) = 4""")
def haar_blocks(v):
    rows = _rows(P.haar_blocks(_blocks(v, "confidence"), "confidence", _scenes(v), BLOCK), *HAAR)
    return rows.withColumns({b: F.round(b, 6) for b in HAAR})


@query("U-1", "grid", """
SELECT a.scene_id, a.row_idx, a.col_idx, CAST(count(*) FILTER (b.after_id = a.after_id) AS INT) AS pred_id, round(avg(b.confidence), 6) AS conf
FROM grid a JOIN (SELECT y.i AS dy, x.i AS dx FROM range(-1, 2) y(i), range(-1, 2) x(i)) d ON true
JOIN grid b ON b.scene_id = a.scene_id AND b.row_idx = a.row_idx + dy AND b.col_idx = a.col_idx + dx GROUP BY 1, 2, 3""")
def neighbourhood_scores(v):
    """A scorer that looks at the eight pixels around each, across block borders."""

    def make_scorer():
        def score(bands):
            height, width = bands[0].shape
            wide = np.pad(bands.astype(np.float64), ((0, 0), (1, 1), (1, 1)), constant_values=np.nan)
            views = [wide[:, y : y + height, x : x + width] for y in range(3) for x in range(3)]
            same = sum((w[0] == bands[0]).astype(np.int64) for w in views)
            present = sum(~np.isnan(w[1]) for w in views)
            return same, sum(np.nan_to_num(w[1]) for w in views) / np.maximum(present, 1) + 0 * bands[1]

        return score

    values = ["a", "confidence"]
    pixels = v.grid.select(*R.PIXEL_KEY, F.col("after_id").cast("double").alias("a"), "confidence")
    wide = P.with_halo(R.to_blocks(pixels, values, BLOCK, _scenes(v)), values, _scenes(v), 1, BLOCK)
    scored = P.without_halo(score_blocks(wide, make_scorer, values), ["pred_id", "conf"], 1, BLOCK)
    rows = R.from_blocks(scored, ["pred_id", "conf"]).where("conf IS NOT NULL AND NOT isnan(conf)")
    return rows.withColumn("conf", F.round("conf", 6))


def falling_scorer():
    """Scores that depend on the place in the tile, so overlapping tiles disagree."""

    def score(bands):
        y, x = np.indices(bands[0].shape)
        return 1 + (np.nan_to_num(bands[0]).astype(np.int64) + y // 8) % 7, bands[1] * (1 - 0.01 * (y + x))

    return score


def _scored_tiles(v):
    values = ["a", "confidence"]
    pixels = v.grid.select(*R.PIXEL_KEY, F.col("after_id").cast("double").alias("a"), "confidence")
    tiles = P.tile_windows(R.to_blocks(pixels, values, BLOCK, _scenes(v)), values, _scenes(v), 16, 4)
    return score_blocks(tiles, falling_scorer, values)


_TILED = """
t AS (SELECT * FROM (VALUES (0, 0), (1, 12), (2, 24), (3, 34)) AS t(i, y0)),
p AS (SELECT g.scene_id, g.row_idx, g.col_idx, r.i * 4 + c.i AS ord, CAST(1 + (after_id + (row_idx - r.y0) // 8) % 7 AS INT) AS pred_id,
        confidence * (1 - 0.01::DOUBLE * ((row_idx - r.y0) + (col_idx - c.y0))) AS conf
      FROM grid g JOIN t r ON row_idx >= r.y0 AND row_idx < r.y0 + 16 JOIN t c ON col_idx >= c.y0 AND col_idx < c.y0 + 16),
w AS (SELECT *, row_number() OVER (PARTITION BY scene_id, row_idx, col_idx ORDER BY conf DESC, ord) AS n FROM p)"""


@query("U-1 J-7 A-9", "grid", f"WITH {_TILED} SELECT scene_id, row_idx, col_idx, pred_id, round(conf, 6) AS conf FROM w WHERE n = 1")
def tiled_scoring_blocks(v):
    """Tiles put together from blocks, scored and merged into blocks again."""
    rows = R.from_blocks(P.mosaic_blocks(_scored_tiles(v), _scenes(v), BLOCK), ["pred_id", "conf"])
    # cells of the last scene that have no pixel win nothing and stay class 0; a confidence may be 0
    return rows.where("pred_id > 0").withColumn("conf", F.round("conf", 6))


@query("A-21", "grid", f"WITH RECURSIVE {_AFTER} SELECT scene_id, region, CAST(count(*) AS DOUBLE) AS area FROM regions GROUP BY 1, 2")
def outline_areas_blocks(v):
    """Outlines from blocks whose inner sides never leave them."""
    labelled = K.label_regions(_blocks(v, "after_id").withColumnRenamed("after_id", "class_id"), BLOCK)
    rings = K.ring_areas(K.outline_rings(K.outline_runs(K.outline_edges_of_blocks(labelled))))
    region = K.linear_id(F.col("region_id"), F.lit(SCENE)).alias("region")
    return rings.groupBy("scene_id", region).agg(F.sum("area").alias("area"))


def nodata_scorer():
    """As :func:`falling_scorer`; cells without data stay class 0."""
    score = falling_scorer()

    def masked(bands):
        classes, confs = score(bands)
        return np.where(bands[0] > 0, classes, 0), confs

    return masked


# tiles of 4 with an overlap of 1 in each AOI's own window
_CROPS = """
crop AS (SELECT aoi_id, scene_id, x0, y0, w, least(w, 50 - y0) AS h, least(w, 50 - x0) AS b FROM aois WHERE scene_id IN (SELECT scene_id FROM grid)),
cell AS (SELECT aoi_id, CAST(row_idx - y0 AS BIGINT) AS r, CAST(col_idx - x0 AS BIGINT) AS c, after_id, confidence, h, b
         FROM crop JOIN grid USING (scene_id) WHERE row_idx >= y0 AND row_idx < y0 + h AND col_idx >= x0 AND col_idx < x0 + b
         AND (col_idx + 0.5 - x0) + (row_idx + 0.5 - y0) < w AND after_id > 0),
n AS (SELECT CAST(range AS BIGINT) AS i FROM range(0, 6)),
scored AS (SELECT aoi_id, r, c, y.i * 100 + x.i AS ord, 1 + (after_id + (r - least(y.i * 3, greatest(h - 4, 0))) // 8) % 7 AS class_id,
             confidence * (1 - 0.01::DOUBLE * (r - least(y.i * 3, greatest(h - 4, 0)) + c - least(x.i * 3, greatest(b - 4, 0)))) AS conf
           FROM cell JOIN n y ON y.i <= ceil(greatest(h - 4, 0) / 3) AND r >= least(y.i * 3, greatest(h - 4, 0)) AND r < least(y.i * 3, greatest(h - 4, 0)) + 4
           JOIN n x ON x.i <= ceil(greatest(b - 4, 0) / 3) AND c >= least(x.i * 3, greatest(b - 4, 0)) AND c < least(x.i * 3, greatest(b - 4, 0)) + 4),
best AS (SELECT aoi_id, r, c, CAST(class_id AS INT) AS class_id, conf, r * 50 + c AS pos FROM scored QUALIFY row_number() OVER (PARTITION BY aoi_id, r, c ORDER BY conf DESC, ord) = 1),
links AS (SELECT a.aoi_id, a.pos, z.pos AS near FROM best a JOIN best z ON a.aoi_id = z.aoi_id AND a.class_id = z.class_id
          AND z.pos IN (a.pos - 50, a.pos - 1, a.pos + 1, a.pos + 50) AND abs(a.r - z.r) + abs(a.c - z.c) = 1),
reach(aoi_id, pos, root) AS (SELECT aoi_id, pos, pos FROM best
  UNION SELECT f.aoi_id, l.near, f.root FROM reach f JOIN links l ON l.aoi_id = f.aoi_id AND l.pos = f.pos AND l.near > f.root),
named AS (SELECT aoi_id, pos, min(root) AS region FROM reach GROUP BY 1, 2)"""


@query("J-3 J-7 U-1 A-9 A-20 A-21 A-22 A-23", "aois grid", f"""
WITH RECURSIVE {_CROPS}
SELECT aoi_id, region, class_id, count(*) AS pixels, round(avg(conf), 6) AS mean_confidence, count(*) * 4.0::DOUBLE AS area_m2, count(*) * 4.0::DOUBLE AS ring_area
FROM best JOIN named USING (aoi_id, pos) GROUP BY 1, 2, 3""")
def analysed_areas(v):
    """From AOIs and scenes to measured and outlined regions without a row per pixel in between."""
    t = affine.transform_of(2.0, 0.0, 0.0, 0.0, 2.0, 0.0)
    rasters = _scenes(v).select("*", F.lit("EPSG:3857").alias("crs"), t.alias("transform"))
    x, y, w = F.col("x0") * 2, F.col("y0") * 2, F.col("w") * 2
    aois = v.aois.select(
        "aoi_id", "scene_id", F.lit("EPSG:3857").alias("crs"), G.ring_of((x, y), (x + w, y), (x, y + w)).alias("ring"),
        F.array().cast(f"ARRAY<{G.RING}>").alias("holes"),
    )
    pixels = v.grid.select(*R.PIXEL_KEY, F.col("after_id").cast("double").alias("a"), "confidence")
    blocks = R.to_blocks(pixels, ["a", "confidence"], BLOCK, _scenes(v))
    crops, labelled = analyse(blocks, aois, rasters, ["a", "confidence"], nodata_scorer, 4, 1, BLOCK)
    measures = K.planar_areas(K.region_measures_of_blocks(labelled, conf="conf"), crops)
    shapes = K.polygons(K.outline_rings(K.outline_runs(K.outline_edges_of_blocks(labelled))), crops)
    ring_area = F.abs(F.aggregate("rings", F.lit(0.0), lambda s, r: s + G.signed_area(r)))
    rows = measures.join(shapes, ["scene_id", "region_id"]).join(crops.select("scene_id", "aoi_id"), "scene_id")
    return rows.select(
        "aoi_id", K.linear_id(F.col("region_id"), F.lit(SCENE)).alias("region"), "class_id", "pixels",
        F.round("mean_confidence", 6).alias("mean_confidence"), "area_m2", F.round(ring_area, 6).alias("ring_area"),
    )
