"""Queries that run a stream over stored tables, score blocks or read stored imagery."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from rasterweave.operators import jobs as J
from rasterweave.operators import rasters as R
from rasterweave.operators.evaluation import confusion
from rasterweave.operators.extensions import score_blocks
from rasterweave.plans.jobs import _RUN
from rasterweave.plans.rasters import _MOSAIC
from rasterweave.plans.registry import query
from rasterweave.plans.views import Views
from rasterweave.session import checkpoint_folder
from rasterweave.sources.grids import scan_grids, write_grids
from rasterweave.sources.imagery import BlockImagery
from rasterweave.streaming.imagery import read_mosaic, start_scoring
from rasterweave.streaming.latency import merged_sketch, sketched_report, start_latencies
from rasterweave.streaming.jobs import job_outcomes as streaming_outcomes
from rasterweave.streaming.jobs import ordered_job_outcomes
from rasterweave.streaming.tables import rocksdb_session, run_to_latest, run_to_table, stream_folder, stream_table


class _StreamViews(Views):
    """The same views over streaming tables."""

    def _load(self, name):
        from rasterweave.plans.views import TABLES

        if name in TABLES:
            return stream_table(self.spark, self.folder, name)
        return super()._load(name)


@query("ST-1", "label_pixels", """
SELECT target_id, pred_id, count(*) AS pixels FROM label_pixels WHERE target_id <> 0 GROUP BY ALL""")
def streaming_confusion(v):
    """Matrix of a stream; the complete result has one row per class pair."""
    return run_to_latest(confusion(_StreamViews(v.spark, v.folder).label_pixels), ["target_id", "pred_id"])


@query("ST-2", "job_events", f"""
WITH RECURSIVE {_RUN} SELECT job_id, seq, ts, from_state, to_state, rejected IS NULL AS accepted, rejected, revision FROM run""")
def streaming_job_outcomes(v):
    events = _StreamViews(rocksdb_session(v.spark), v.folder).job_events
    stream = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = run_to_table(streaming_outcomes(stream))
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("ST-2 W-6", "job_events", f"""
WITH RECURSIVE {_RUN} SELECT job_id, seq, ts, from_state, to_state, rejected IS NULL AS accepted, rejected, revision FROM run""")
def streaming_outcomes_any_order(v):
    """Attempts of a job are spread over triggers in an order that has nothing to do with theirs."""
    spark, folder = rocksdb_session(v.spark), stream_folder(v.spark)
    events = v.job_events.withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3, F.xxhash64("job_id", "seq")).write.parquet(f"{folder}/arrivals")
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arrivals")
    # no attempt is too late to count
    rows = run_to_table(ordered_job_outcomes(arriving, delay="36500 days"))
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("ST-6", "job_events", """
SELECT date_trunc('hour', ts) AS window_start, count(*) AS attempts, count(*) FILTER (to_state = 'completed') AS completed,
       count(*) FILTER (to_state = 'failed') AS failed FROM job_events
GROUP BY 1""")
def streaming_throughput(v):
    """All windows, those that may still grow included."""
    events = _StreamViews(v.spark, v.folder).job_events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = run_to_latest(J.windowed_throughput(events), ["window_start"])
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("ST-5", "tile_preds grid", f"WITH {_MOSAIC} SELECT * FROM mosaic")
def streaming_mosaic(v):
    """Arriving tile predictions merged into a stored mosaic, batch by batch."""
    base = stream_folder(v.spark)
    tiles = _StreamViews(v.spark, v.folder).tile_preds
    start_scoring(tiles, lambda batch: batch, f"{base}/winners", f"{base}/progress").awaitTermination()
    return read_mosaic(v.spark.range(0), f"{base}/winners")


@query("U-1", "grid", """
SELECT scene_id, row_idx, col_idx, CAST(1 + (after_id * 3) % 7 AS INT) AS pred_id, round(confidence * 0.5, 6) AS conf FROM grid""")
def scored_blocks(v):
    def make_scorer():
        def score(bands):
            return 1 + (bands[0].astype(np.int64) * 3) % 7, bands[1] * 0.5

        return score

    pixels = v.grid.select(*R.PIXEL_KEY, F.col("after_id").cast("double").alias("a"), "confidence")
    blocks = score_blocks(R.to_blocks(pixels, ["a", "confidence"], 25), make_scorer, ["a", "confidence"])
    rows = R.from_blocks(blocks, ["pred_id", "conf"])
    # the last scene may end inside a block
    return rows.where("conf IS NOT NULL AND NOT isnan(conf)").withColumn("conf", F.round("conf", 6))


@query("S-5 U-6", "grid", """
SELECT scene_id, row_idx - 2 AS row_idx, col_idx - 3 AS col_idx, after_id FROM grid
WHERE row_idx BETWEEN 2 AND 6 AND col_idx BETWEEN 3 AND 9
  AND scene_id IN (SELECT scene_id FROM grid GROUP BY scene_id HAVING max(row_idx) >= 6 AND max(col_idx) >= 9)""")
def imagery_windows(v):
    """The same window of every stored scene that holds it."""
    scenes = v.grid.groupBy("scene_id").agg(
        (F.max("row_idx") + 1).cast("int").alias("height"), (F.max("col_idx") + 1).cast("int").alias("width")
    )
    wide = scenes.where("height >= 7 AND width >= 10")
    imagery = BlockImagery(wide, R.to_blocks(v.grid.select(*R.PIXEL_KEY, "after_id"), ["after_id"], 25), ("after_id",), 25)
    return imagery.window(2, 3, 5, 7)


@query("S-5 U-6", "grid", """
WITH e AS (SELECT scene_id, max(row_idx) + 1 AS h, max(col_idx) + 1 AS w FROM grid GROUP BY scene_id)
SELECT 0 AS window_id, scene_id, row_idx, col_idx, after_id FROM grid UNION ALL
SELECT 1, scene_id, row_idx - greatest(h - 5, 0), col_idx - greatest(w - 7, 0), after_id FROM grid JOIN e USING (scene_id)
WHERE row_idx >= h - 5 AND col_idx >= w - 7""")
def imagery_scenes(v):
    """Every stored scene whole, and the window in its lower right corner, whatever its size."""
    scenes = v.grid.groupBy("scene_id").agg((F.max("row_idx") + 1).alias("height"), (F.max("col_idx") + 1).alias("width"))
    imagery = BlockImagery(scenes, R.to_blocks(v.grid.select(*R.PIXEL_KEY, "after_id"), ["after_id"], 16), ("after_id",), 16)
    corner = scenes.selectExpr(
        "1 AS window_id", "scene_id", "greatest(height - 5, 0) AS row_off", "greatest(width - 7, 0) AS col_off",
        "least(height, 5) AS height", "least(width, 7) AS width",
    )
    whole = scenes.selectExpr("0 AS window_id", "scene_id", "0L AS row_off", "0L AS col_off", "height", "width")
    # a scene that ends inside a block has cells without a pixel
    return imagery.windows(whole.unionByName(corner)).where("after_id IS NOT NULL")


@query("S-3 S-5 U-6", "grid", "SELECT scene_id, row_idx, col_idx, CAST(CAST(confidence AS FLOAT) AS DOUBLE) AS confidence FROM grid")
def stored_grids(v):
    """Confidence grids written as NumPy strips and read back in pieces of a few kilobytes."""
    folder = f"{checkpoint_folder(v.spark)}/grids-{uuid.uuid4().hex}"
    blocks = R.to_blocks(v.grid.select(*R.PIXEL_KEY, "confidence"), ["confidence"], 16)
    write_grids(blocks, folder, "confidence")
    rows = R.from_blocks(scan_grids(v.spark, folder, block=16, split=2_000), ["confidence"])
    return rows.where("NOT isnan(confidence)").withColumn("confidence", F.col("confidence").cast("double"))


@query("A-32", "latencies", """
WITH b AS (SELECT model_id, CASE WHEN latency_ms <= 0 THEN -2147483648 ELSE ceil(ln(latency_ms) / ln(1.01 / 0.99)) END AS k, latency_ms FROM latencies),
c AS (SELECT model_id, k, count(*) AS n FROM b GROUP BY 1, 2),
u AS (SELECT model_id, k, sum(n) OVER (PARTITION BY model_id ORDER BY k) AS upto, sum(n) OVER (PARTITION BY model_id) AS total FROM c),
m AS (SELECT model_id, min(k) FILTER (upto > floor(0.5 * (total - 1))) AS mid, min(k) FILTER (upto > floor(0.95 * (total - 1))) AS high FROM u GROUP BY 1)
SELECT model_id, count(*) AS batches, round(avg(latency_ms), 6) AS mean_ms, round(4 / (avg(latency_ms) / 1000), 4) AS images_per_second,
  round(2 * pow(1.01 / 0.99, any_value(mid)) / (1.01 / 0.99 + 1), 6) AS median_ms, round(2 * pow(1.01 / 0.99, any_value(high)) / (1.01 / 0.99 + 1), 6) AS p95_ms
FROM latencies JOIN m USING (model_id) GROUP BY model_id""")
def streaming_latencies(v):
    """Sketches stored batch by batch from a stream, merged when they are read."""
    base = stream_folder(v.spark)
    start_latencies(_StreamViews(v.spark, v.folder).latencies, f"{base}/sketches", f"{base}/progress").awaitTermination()
    rows = sketched_report(merged_sketch(v.spark.read.parquet(f"{base}/sketches/*")), batch_size=4)
    digits = {"mean_ms": 6, "median_ms": 6, "p95_ms": 6, "images_per_second": 4}
    return rows.withColumns({c: F.round(c, n) for c, n in digits.items()})
