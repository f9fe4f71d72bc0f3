"""Explicit schemas of stored tables and documents. Production reads never infer."""

from __future__ import annotations

from rasterweave.functions.affine import TRANSFORM
from rasterweave.functions.geometry import RING

PIXELS = "scene_id BIGINT, row_idx BIGINT, col_idx BIGINT"
BLOCKS = (
    "scene_id BIGINT, block_row INT, block_col INT, y_off INT, x_off INT, height INT, width INT"
)
RASTERS = f"scene_id BIGINT, width INT, height INT, crs STRING, nodata DOUBLE, transform {TRANSFORM}"
SAMPLES = "sample_id STRING, split STRING, domain STRING, image_path STRING, mask_path STRING"
AOIS = f"aoi_id BIGINT, type STRING, crs STRING, ring {RING}, holes ARRAY<{RING}>"
EPOCH_RESULTS = (
    "experiment_id STRING, epoch BIGINT, phase STRING, loss DOUBLE, metrics MAP<STRING, DOUBLE>, "
    "samples BIGINT, batches BIGINT, optimizer_steps BIGINT, global_step BIGINT, skipped_batches BIGINT"
)
TRANSITION = "STRUCT<from_state: STRING, reason: STRING, timestamp: STRING, to_state: STRING>"
# fields in alphabetical order: writing the struct as JSON gives the canonical key order
JOB = (
    "created_at STRING, job_id STRING, "
    "request STRUCT<aoi: STRING, imagery_source: STRING, metadata: STRING>, revision BIGINT, "
    f"state STRING, transitions ARRAY<{TRANSITION}>, updated_at STRING"
)
JOB_EVENTS = "job_id BIGINT, seq BIGINT, ts TIMESTAMP, to_state STRING"
PROTOCOL = (
    "benchmark_id STRING, model_ids ARRAY<STRING>, training STRING, data STRING, benchmark STRING"
)
