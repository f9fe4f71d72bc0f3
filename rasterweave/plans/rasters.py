"""Queries over rasters, tiles, mosaics and change."""

import uuid

from pyspark.sql import functions as F

from rasterweave.functions import affine
from rasterweave.functions.tiles import tile_starts
from rasterweave.operators import change as CH
from rasterweave.operators import rasters as R
from rasterweave.operators.extensions import observed, read_table, write_table
from rasterweave.plans.registry import query
from rasterweave.session import checkpoint_folder
from rasterweave.sources.sinks import write_rasters
from rasterweave.sources import sinks

SCENE = 50


def _rasters(v):
    t = affine.transform_of(F.col("a"), 0.0, F.col("c"), 0.0, F.col("e"), F.col("f"))
    return v.rasters.withColumn("transform", t)


def _rounded(df, names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


@query("S-2", "rasters", """
SELECT scene_id, width, height, crs, c AS minx, f + e * height AS miny, c + a * width AS maxx, f AS maxy,
       abs(a) AS pixel_width, abs(e) AS pixel_height FROM rasters""")
def raster_metadata(v):
    return R.raster_metadata(_rasters(v)).select("*", "bounds.*").drop("bounds")


@query("S-4", "grid", """
SELECT scene_id, row_idx - 5 AS row_idx, col_idx - 10 AS col_idx, after_id FROM grid
WHERE row_idx BETWEEN 5 AND 24 AND col_idx BETWEEN 10 AND 39""")
def window_read(v):
    R.check_window(5, 10, 20, 30, SCENE, SCENE)
    return R.read_window(v.grid.select(*R.PIXEL_KEY, "after_id"), 5, 10, 20, 30)


@query("C-14 S-10", "grid", "SELECT scene_id, row_idx, col_idx, after_id, confidence FROM grid")
def block_round_trip(v):
    blocks = R.to_blocks(v.grid, ["after_id", "confidence"], 16)
    rows = R.from_blocks(blocks, ["after_id", "confidence"])
    return rows.where("after_id IS NOT NULL")


@query("S-10", "grid", """
SELECT scene_id, row_idx, col_idx, CASE WHEN (row_idx + col_idx) % 7 = 0 THEN 0 ELSE after_id END AS after_id,
       CAST(CAST(CASE WHEN (row_idx + col_idx) % 7 = 0 THEN 0 ELSE confidence END AS FLOAT) AS DOUBLE) AS confidence FROM grid""")
def stored_rasters(v):
    """Raster products written to the shared folder and read again, missing values as no-data."""
    present = (F.col("row_idx") + F.col("col_idx")) % 7 != 0
    pixels = v.grid.select(*R.PIXEL_KEY, *[F.when(present, F.col(c)).alias(c) for c in ("after_id", "confidence")])
    sizes = v.grid.groupBy("scene_id").agg((F.max("row_idx") + 1).alias("height"), (F.max("col_idx") + 1).alias("width"))
    blocks = R.to_blocks(pixels, ["after_id", "confidence"], 16, sizes)
    path = f"{checkpoint_folder(v.spark)}/rasters-{uuid.uuid4()}"
    write_rasters(blocks, path, {"after_id": "mask", "confidence": "confidence"})
    rows = R.from_blocks(v.spark.read.parquet(path), ["after_id", "confidence"])
    inside = rows.join(v.grid.select(*R.PIXEL_KEY), list(R.PIXEL_KEY))
    return inside.withColumns({"after_id": F.col("after_id").cast("int"), "confidence": F.col("confidence").cast("double")})


@query("U-5 U-7", "samples", "SELECT sample_id, split, domain FROM samples")
def repository_round_trip(v):
    """Rows stored and loaded through the repository functions, observed on the way."""
    path = f"{checkpoint_folder(v.spark)}/samples-{uuid.uuid4()}"
    write_table(observed(v.samples, "samples"), path, by=["split"])
    return read_table(v.spark, path, v.samples.schema)


@query("S-4 C-14", "grid", """
SELECT scene_id, row_idx - 20 AS row_idx, col_idx - 3 AS col_idx, after_id FROM grid
WHERE row_idx BETWEEN 20 AND 29 AND col_idx BETWEEN 3 AND 42""")
def block_window_read(v):
    blocks = R.to_blocks(v.grid, ["after_id"], 16)
    return R.read_block_window(blocks, ["after_id"], 20, 3, 10, 40, 16).where("after_id IS NOT NULL")


@query("G-8", "rasters", """
SELECT scene_id, c + a * 7 AS window_x, f + e * 4 AS window_y, CAST(round_even((c + a * 7.25 - c) / a, 0) AS BIGINT) AS col_off,
       CAST(round_even((f + e * 4.75 - f) / e, 0) AS BIGINT) AS row_off, c + a * 2.5 AS centre_x, f + e * 3.5 AS centre_y FROM rasters""")
def affine_math(v):
    t = F.col("transform")
    moved = affine.window_transform(t, F.lit(4), F.lit(7))
    corner = affine.to_world(t, F.lit(7.25), F.lit(4.75))
    inner = t.withField("c", corner["x"]).withField("f", corner["y"])
    offset = affine.pixel_offset(inner, t)
    centre = affine.to_world(t, F.lit(2.5), F.lit(3.5))
    return _rasters(v).select(
        "scene_id", moved["c"].alias("window_x"), moved["f"].alias("window_y"),
        offset["col_off"].alias("col_off"), offset["row_off"].alias("row_off"),
        centre["x"].alias("centre_x"), centre["y"].alias("centre_y"),
    )


@query("G-9", "rasters", """
SELECT scene_id, width, i, least(i * 24, greatest(width - 32, 0)) AS start
FROM rasters, (SELECT range AS i FROM range(0, 100)) r WHERE i <= ceil(greatest(width - 32, 0) / 24)""")
def tile_start_offsets(v):
    starts = tile_starts(F.col("width"), 32, 8)
    return _rasters(v).select("scene_id", "width", F.posexplode(starts).alias("i", "start"))


@query("J-7 W-1 C-1", "rasters", """
WITH y AS (SELECT scene_id, i AS tr, least(i * 24, greatest(height - 32, 0)) AS ro FROM rasters, (SELECT range AS i FROM range(0, 100)) r
           WHERE i <= ceil(greatest(height - 32, 0) / 24)),
x AS (SELECT scene_id, i AS tc, least(i * 24, greatest(width - 32, 0)) AS co FROM rasters, (SELECT range AS i FROM range(0, 100)) r
      WHERE i <= ceil(greatest(width - 32, 0) / 24))
SELECT r.scene_id, printf('tile_r%04d_c%04d', tr, tc) AS tile_id,
       row_number() OVER (PARTITION BY r.scene_id ORDER BY tr, tc) - 1 AS tile_ord, ro AS row_off, co AS col_off,
       least(height, 32) AS tile_height, least(width, 32) AS tile_width, r.crs,
       round(c + a * co, 6) AS minx, round(f + e * ro, 6) AS maxy
FROM rasters r JOIN y ON y.scene_id = r.scene_id JOIN x ON x.scene_id = r.scene_id""")
def tile_layout(v):
    rows = R.tiles(_rasters(v), 32, 8)
    return rows.select(
        "scene_id", "tile_id", "tile_ord", "row_off", "col_off", "tile_height", "tile_width", "crs",
        F.round("bounds.minx", 6).alias("minx"), F.round("bounds.maxy", 6).alias("maxy"),
    )


@query("J-7", "tile_preds", "SELECT scene_id, row_idx, col_idx, tr AS tile_row, tc AS tile_col, tile_ord FROM tile_preds")
def pixels_in_tiles(v):
    side = F.lit(SCENE)
    return R.assign_tiles(v.grid.select(*R.PIXEL_KEY), 16, 4, side, side)


_MOSAIC = """
r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, row_idx, col_idx ORDER BY conf DESC, tile_ord) AS n
      FROM tile_preds WHERE NOT isnan(conf) AND conf > -1),
mosaic AS (SELECT g.scene_id, g.row_idx, g.col_idx, coalesce(r.pred_id, 0) AS pred_id, coalesce(r.conf, 0) AS conf
           FROM grid g LEFT JOIN r ON r.n = 1 AND r.scene_id = g.scene_id AND r.row_idx = g.row_idx AND r.col_idx = g.col_idx)"""


@query("A-9", "tile_preds grid", f"WITH {_MOSAIC} SELECT * FROM mosaic")
def mosaic_tiles(v):
    return R.mosaic(v.tile_preds)


def _layout():
    return (16, 4, F.lit(SCENE), F.lit(SCENE))


@query("A-9", "tile_preds grid", f"WITH {_MOSAIC} SELECT * FROM mosaic")
def mosaic_tiles_split(v):
    return R.mosaic(v.tile_preds, layout=_layout())


@query("A-5 L-2 C-9", "tile_preds grid", f"""
WITH {_MOSAIC}, c AS (SELECT scene_id, pred_id AS class_id, count(*) AS pixel_count, avg(conf) AS m FROM mosaic GROUP BY 1, 2)
SELECT scene_id, class_id, coalesce(['background', 'building', 'road', 'water', 'barren', 'forest', 'agriculture'][class_id], '0') AS class_name,
       pixel_count, round_even(pixel_count / sum(pixel_count) OVER (PARTITION BY scene_id), 4) AS pixel_fraction,
       round_even(m, 4) AS mean_confidence FROM c""")
def class_summary(v):
    return R.class_summary(R.mosaic(v.tile_preds, layout=_layout()))


@query("A-6 C-9", "tile_preds grid", f"""
WITH {_MOSAIC}
SELECT scene_id, round_even(avg(conf), 4) AS mean, round_even(min(conf), 4) AS min, round_even(max(conf), 4) AS max FROM mosaic GROUP BY 1""")
def confidence_summary(v):
    return R.confidence_summary(R.mosaic(v.tile_preds, layout=_layout()))


@query("A-7", "grid", "SELECT scene_id, after_id AS class_id, count(*) AS pixel_count FROM grid GROUP BY ALL")
def mask_histogram(v):
    return R.class_histogram(v.grid, "after_id", ["scene_id"])


@query("J-6 A-6", "grid", """
SELECT after_id AS class_id, count(*) AS pixels, round(avg(confidence), 6) AS mean_confidence FROM grid WHERE after_id <> 0 GROUP BY 1""")
def mask_confidence(v):
    mask = R.to_blocks(v.grid, ["after_id"], 25)
    conf = R.to_blocks(v.grid, ["confidence"], 25)
    rows = R.from_blocks(R.join_blocks(mask, conf), ["after_id", "confidence"])
    kept = R.without_ignored(rows.where("after_id IS NOT NULL"), "after_id")
    return kept.groupBy(F.col("after_id").alias("class_id")).agg(
        F.count("*").alias("pixels"), F.round(F.avg("confidence"), 6).alias("mean_confidence")
    )


@query("F-16", "rasters", """
SELECT scene_id, CASE WHEN scene_id % 5 = 1 THEN 'different shape' WHEN scene_id % 5 = 2 THEN 'different crs'
  ELSE 'different transform' END AS problem FROM rasters WHERE scene_id % 5 BETWEEN 1 AND 3""")
def alignment_problems(v):
    k = F.col("scene_id") % 5
    left = _rasters(v)
    right = left.select(
        "scene_id", F.when(k == 1, F.col("width") + 1).otherwise(F.col("width")).alias("width"), "height",
        F.when(k == 2, "EPSG:32643").otherwise(F.col("crs")).alias("crs"),
        F.col("transform").withField("c", F.when(k == 3, F.col("c") + 0.5).otherwise(F.col("c"))).alias("transform"),
    )
    return R.alignment_problems(left, right)


# ------------------------------------------------------------------ change


def _pairs(v):
    before = v.grid.select(*R.PIXEL_KEY, F.col("before_id").alias("class_id"))
    after = v.grid.select(*R.PIXEL_KEY, F.col("after_id").alias("class_id"))
    return CH.pair_dates(before, after)


@query("J-4 A-10 F-6", "grid", """
SELECT scene_id, count(*) FILTER (before_id <> 0 AND after_id <> 0 AND before_id <> after_id) AS changed_pixels,
       count(*) FILTER (before_id <> 0 AND after_id <> 0) AS total_valid_pixels,
       round(count(*) FILTER (before_id <> 0 AND after_id <> 0 AND before_id <> after_id)
             / count(*) FILTER (before_id <> 0 AND after_id <> 0), 6) AS changed_fraction FROM grid GROUP BY 1""")
def change_summary(v):
    return _rounded(CH.change_summary(_pairs(v)), ["changed_fraction"])


@query("A-11 C-1", "grid", """
SELECT scene_id, before_id, after_id, count(*) AS pixels, concat(before_id, '->', after_id) AS transition
FROM grid WHERE before_id <> 0 AND after_id <> 0 AND before_id <> after_id GROUP BY 1, 2, 3""")
def change_transitions(v):
    return CH.transitions(v.grid)


@query("A-11", "grid", """
SELECT scene_id, concat('{', string_agg(concat('"', t, '":', n), ',' ORDER BY t), '}') AS transitions FROM (
  SELECT scene_id, concat(before_id, '->', after_id) AS t, count(*) AS n FROM grid
  WHERE before_id <> 0 AND after_id <> 0 AND before_id <> after_id GROUP BY 1, 2) z GROUP BY 1""")
def change_transition_maps(v):
    rows = CH.transition_map(CH.transitions(v.grid))
    return rows.select("scene_id", F.to_json("transitions").alias("transitions"))


@query("X-3", "grid", "SELECT before_id AS class_id FROM grid UNION SELECT after_id FROM grid")
def classes_at_either_date(v):
    return CH.class_ids_seen(v.grid)


@query("J-4", "grid", """
SELECT scene_id, row_idx, col_idx, before_id, after_id FROM grid WHERE before_id <> after_id AND before_id <> 0 AND after_id <> 0""")
def changed_pixels(v):
    before = R.to_blocks(v.grid, ["before_id"], 16)
    after = R.to_blocks(v.grid, ["after_id"], 16)
    rows = R.from_blocks(R.join_blocks(before, after), ["before_id", "after_id"])
    return CH.flag_changes(rows).where("changed").drop("valid", "changed")


@query("W-9", "events", """
SELECT event_id AS image_id, user_id AS scene_id, ts AS acquired_at,
       lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_image_id,
       lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_acquired_at FROM events""")
def acquisition_pairs(v):
    images = v.events.select(
        F.col("event_id").alias("image_id"), F.col("user_id").alias("scene_id"), F.col("ts").alias("acquired_at")
    )
    return CH.pair_acquisitions(images)


@query("W-9", "events", """
SELECT user_id AS scene_id, event_id AS image_id, ts AS acquired_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) z WHERE n = 1""")
def latest_acquisitions(v):
    images = v.events.select(
        F.col("event_id").alias("image_id"), F.col("user_id").alias("scene_id"), F.col("ts").alias("acquired_at")
    )
    return CH.latest_acquisition(images)


@query("W-9 J-4", "events", """
WITH r AS (SELECT event_id AS request_id, user_id AS scene_id, ts + INTERVAL 1 HOUR * (event_id % 7 - 3) AS t FROM events),
i AS (SELECT user_id AS scene_id, ts, max(event_id) AS last_id, min(event_id) AS first_id FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2),
p AS (SELECT request_id, r.scene_id, t, b.last_id AS b_id, b.ts AS b_ts FROM r ASOF LEFT JOIN i b ON r.scene_id = b.scene_id AND r.t >= b.ts),
q AS (SELECT p.*, a.first_id AS a_id, a.ts AS a_ts FROM p ASOF LEFT JOIN i a ON p.scene_id = a.scene_id AND p.t <= a.ts),
k AS (SELECT request_id, scene_id, t, CASE WHEN t - b_ts <= INTERVAL 90 HOUR THEN b_id END AS b_id, CASE WHEN t - b_ts <= INTERVAL 90 HOUR THEN b_ts END AS b_ts,
  CASE WHEN a_ts - t <= INTERVAL 90 HOUR THEN a_id END AS a_id, CASE WHEN a_ts - t <= INTERVAL 90 HOUR THEN a_ts END AS a_ts FROM q)
SELECT request_id, scene_id, t AS requested_at, b_id AS before_image_id, b_ts AS before_acquired_at, a_id AS after_image_id, a_ts AS after_acquired_at,
  CASE WHEN b_id IS NOT NULL AND (a_id IS NULL OR t - b_ts <= a_ts - t) THEN b_id ELSE a_id END AS nearest_image_id,
  CASE WHEN b_id IS NOT NULL AND (a_id IS NULL OR t - b_ts <= a_ts - t) THEN b_ts ELSE a_ts END AS nearest_acquired_at FROM k""")
def acquisitions_as_of(v):
    """Every event as a date asked for, a few hours off, and every third event as an image."""
    requests = v.events.select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("scene_id"),
        F.expr("ts + make_interval(0, 0, 0, 0, cast(event_id % 7 - 3 as int))").alias("requested_at"),
    )
    images = v.events.where("event_id % 3 = 0").select(
        F.col("event_id").alias("image_id"), F.col("user_id").alias("scene_id"), F.col("ts").alias("acquired_at")
    )
    done = CH.nearest_acquisitions(requests, images, tolerance_seconds=90 * 3600)
    times = [c for c in done.columns if c.endswith("_at")]
    return done.withColumns({c: F.col(c).cast(v.events.schema["ts"].dataType) for c in times})


@query("S-11", "tile_preds grid", f"""
WITH {_MOSAIC}, c AS (SELECT scene_id, pred_id AS class_id, count(*) AS n FROM mosaic GROUP BY 1, 2)
SELECT scene_id, CAST(count(*) AS BIGINT) AS classes, first(class_id ORDER BY n DESC, class_id) AS first_class,
       first(n ORDER BY n DESC, class_id) AS first_count FROM c GROUP BY 1""")
def prediction_reports(v):
    merged = R.mosaic(v.tile_preds, layout=_layout())
    reports = sinks.prediction_reports(R.class_summary(merged), R.confidence_summary(merged))
    doc = F.from_json("doc", "classes ARRAY<STRUCT<class_id: INT, pixel_count: BIGINT>>, confidence STRUCT<mean: DOUBLE>")
    return reports.withColumn("_d", doc).select(
        "scene_id", F.size("_d.classes").cast("long").alias("classes"),
        F.col("_d.classes")[0]["class_id"].alias("first_class"), F.col("_d.classes")[0]["pixel_count"].alias("first_count"),
    )
