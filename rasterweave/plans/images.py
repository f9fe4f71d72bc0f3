"""Queries for image arithmetic."""

from pyspark.sql import functions as F

from rasterweave.operators import images as I
from rasterweave.operators.rasters import PIXEL_KEY
from rasterweave.plans.registry import query


def _class_pixels(v):
    return v.grid.select(*PIXEL_KEY, F.col("after_id").alias("class_id"))


def _rgb(v):
    return v.grid.select(
        *PIXEL_KEY,
        (F.col("row_idx") * 5).cast("int").alias("r"),
        (F.col("col_idx") * 5).cast("int").alias("g"),
        (F.col("after_id") * 30).alias("b"),
    )


@query("F-19", "grid", """
SELECT scene_id, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS band, count(*) AS pixels
FROM grid GROUP BY 1, 2""")
def confidence_bands(v):
    band = I.confidence_band(F.col("confidence")).alias("band")
    return v.grid.groupBy("scene_id", band).agg(F.count("*").alias("pixels"))


@query("F-20", "grid", """
WITH n AS (SELECT scene_id, max(after_id) + 1 AS n FROM grid GROUP BY 1),
h AS (SELECT DISTINCT g.scene_id, after_id, after_id / n * 6 AS h FROM grid g JOIN n USING (scene_id)),
s AS (SELECT *, CAST(floor(h) AS INT) % 6 AS i, h - floor(h) AS f FROM h),
c AS (SELECT *, 0.95::DOUBLE AS v, 0.95::DOUBLE * (1 - 0.65::DOUBLE) AS p, 0.95::DOUBLE * (1 - 0.65::DOUBLE * f) AS q, 0.95::DOUBLE * (1 - 0.65::DOUBLE * (1 - f)) AS t FROM s),
k AS (SELECT scene_id, after_id, CASE i WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END AS r,
  CASE i WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q ELSE p END AS g,
  CASE i WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END AS b FROM c)
SELECT x.scene_id, row_idx, col_idx, x.after_id AS class_id, CAST(CASE WHEN x.after_id = 0 THEN 0 ELSE floor(r * 255) END AS INT) AS r,
  CAST(CASE WHEN x.after_id = 0 THEN 0 ELSE floor(g * 255) END AS INT) AS g, CAST(CASE WHEN x.after_id = 0 THEN 0 ELSE floor(b * 255) END AS INT) AS b
FROM grid x JOIN k ON k.scene_id = x.scene_id AND k.after_id = x.after_id""")
def colour_masks(v):
    return I.colour_mask(_class_pixels(v))


@query("F-21", "grid", """
SELECT scene_id, row_idx, col_idx, CAST(floor((confidence - lo) / (hi - lo + 1e-8) * 255.0::DOUBLE) AS INT) AS heat
FROM grid JOIN (SELECT scene_id, min(confidence) AS lo, max(confidence) AS hi FROM grid GROUP BY 1) z USING (scene_id)""")
def confidence_heat(v):
    return I.confidence_heat(v.grid.select(*PIXEL_KEY, "confidence")).drop("confidence")


@query("F-22 F-23", "grid", """
SELECT scene_id, row_idx, col_idx, round((row_idx * 5) * 0.5 + (col_idx * 5) * 0.5, 6)::DOUBLE AS blended,
       round((row_idx * 5 / 255 - 0.485) / 0.229, 6) AS r, round((col_idx * 5 / 255 - 0.456) / 0.224, 6) AS g,
       round((after_id * 30 / 255 - 0.406) / 0.225, 6) AS b FROM grid""")
def overlay_and_normalise(v):
    rows = _rgb(v).withColumn("blended", F.round(I.overlay(F.col("r"), F.col("g")), 6).cast("double"))
    return I.normalise(rows).withColumns({c: F.round(c, 6) for c in I.CHANNELS})


@query("F-24 U-2", "grid", """
SELECT scene_id, row_idx, col_idx, after_id FROM (
  SELECT scene_id, CASE scene_id % 4 WHEN 0 THEN row_idx WHEN 1 THEN 49 - c WHEN 2 THEN 49 - row_idx ELSE c END AS row_idx,
         CASE scene_id % 4 WHEN 0 THEN c WHEN 1 THEN row_idx WHEN 2 THEN 49 - c ELSE 49 - row_idx END AS col_idx, after_id
  FROM (SELECT scene_id, row_idx, CASE WHEN scene_id % 2 = 1 THEN 49 - col_idx ELSE col_idx END AS c, after_id FROM grid) a) b""")
def flips_and_turns(v):
    k = F.col("scene_id")
    change = F.struct(
        (k % 2 == 1).alias("hflip"), F.lit(False).alias("vflip"), (k % 4 * 90).cast("int").alias("angle")
    )
    rows = v.grid.select(*PIXEL_KEY, "after_id")
    return I.transform_pixels(rows, change, F.lit(50).cast("long"), F.lit(50).cast("long"))


@query("F-24 U-2", "grid", "SELECT scene_id, count(*) AS pixels, count(*) AS agree FROM grid GROUP BY 1")
def augmented_pairs(v):
    """Image and mask are augmented apart and still line up everywhere."""
    side = F.lit(50).cast("long")
    change = I.augmentation(F.col("scene_id"), seed=11, epoch=3)
    image = I.transform_pixels(v.grid.select(*PIXEL_KEY, "before_id"), change, side, side)
    mask = I.transform_pixels(v.grid.select(*PIXEL_KEY, "after_id"), change, side, side)
    origin = I.transform_pixels(
        v.grid.select(*PIXEL_KEY, F.col("before_id").alias("b"), F.col("after_id").alias("a")), change, side, side
    )
    joined = image.join(mask, list(PIXEL_KEY)).join(origin, list(PIXEL_KEY))
    return joined.groupBy("scene_id").agg(
        F.count("*").alias("pixels"), F.count_if(F.expr("before_id = b AND after_id = a")).alias("agree")
    )


@query("F-25")
def jittered_colours(v):
    return I.colour_jitter(_rgb(v), seed=5, epoch=1)


@query("F-26", "grid", """
WITH o AS (SELECT range AS i, CAST(floor((range + 0.5) * (50.0 / 32)) AS BIGINT) AS s FROM range(0, 32))
SELECT scene_id, r.i AS row_idx, c.i AS col_idx, after_id FROM grid JOIN o r ON r.s = row_idx JOIN o c ON c.s = col_idx""")
def nearest_resize(v):
    return I.resize_nearest(v.grid.select(*PIXEL_KEY, "after_id"), 50, 50, 32, 32)


@query("F-26", "grid", """
WITH o AS (SELECT i, (i + 0.5::DOUBLE) * (50.0::DOUBLE / 32) AS ct FROM (SELECT range AS i FROM range(0, 32))),
w AS (SELECT i, j, greatest(1 - abs((j + 0.5::DOUBLE - ct) / (50.0::DOUBLE / 32)), 0) AS u FROM o, (SELECT range AS j FROM range(0, 50))
      WHERE j >= greatest(floor(ct - 50.0::DOUBLE / 32 + 0.5), 0) AND j < least(floor(ct + 50.0::DOUBLE / 32 + 0.5), 50)),
n AS (SELECT i, j, u / sum(u) OVER (PARTITION BY i) AS u FROM w)
SELECT scene_id, r.i AS row_idx, c.i AS col_idx, round(sum(r.u * c.u * confidence), 6) AS confidence
FROM grid JOIN n r ON r.j = row_idx JOIN n c ON c.j = col_idx WHERE r.u > 0 AND c.u > 0 GROUP BY 1, 2, 3""")
def bilinear_resize(v):
    rows = I.resize_bilinear(v.grid.select(*PIXEL_KEY, "confidence"), ["confidence"], 50, 50, 32, 32)
    return rows.withColumn("confidence", F.round("confidence", 6))


@query("F-27", "grid", """
SELECT scene_id, row_idx // 2 AS row_idx, col_idx // 2 AS col_idx,
  round(sum(confidence) * 0.5 * pow(2, -0.5), 6) AS ll,
  round(sum(CASE WHEN row_idx % 2 = 0 THEN -confidence ELSE confidence END) * 0.5 * pow(2, -0.5), 6) AS lh,
  round(sum(CASE WHEN col_idx % 2 = 0 THEN -confidence ELSE confidence END) * 0.5 * pow(2, -0.5), 6) AS hl,
  round(sum(CASE WHEN (row_idx + col_idx) % 2 = 0 THEN confidence ELSE -confidence END) * 0.5 * pow(2, -0.5), 6) AS hh
FROM grid GROUP BY 1, 2, 3 HAVING count(*) = 4""")
def haar_bands(v):
    rows = I.haar(v.grid, "confidence")
    return rows.withColumns({b: F.round(b, 6) for b in I.HAAR})
