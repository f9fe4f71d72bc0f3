"""Time the headline queries; prints one JSON line.

Each query runs once to warm the session and then once timed; results go to the ``noop`` sink so
that nothing but the query is measured. ``BENCH_COMPARE=1`` also times the DuckDB checks.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rasterweave import get_spark  # noqa: E402
from rasterweave.plans import load  # noqa: E402

HEADLINE = (
    "domain_metrics",
    "confusion_matrix",
    "sample_statistics",
    "sampling_weights",
    "loss_terms",
    "mosaic_tiles",
    "mosaic_tiles_split",
    "change_summary",
    "change_transitions",
    "connected_regions",
    "region_measures",
    "outline_areas",
    "clip_to_aoi",
    "extents_that_overlap",
    "job_outcomes",
    "job_document_problems",
    "early_stopping",
    "latency_report",
    "draws_with_replacement",
    "bilinear_resize",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench", master=f"local[{cpus}]", spark_sql_shuffle_partitions=str(cpus), spark_driver_memory="12g",
        spark_checkpoint_dir=tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = load(), {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(folder).name.removeprefix("sf"),
    }
    if os.environ.get("BENCH_COMPARE"):
        line["duckdb"] = duckdb_times(queries, folder, int(cpus))
    print(json.dumps(line))
    spark.stop()


def duckdb_times(queries, folder: str, cpus: int) -> dict[str, float]:
    import duckdb

    from rasterweave.plans.views import TABLES

    con = duckdb.connect(config={"threads": cpus})
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    times = {}
    # the recursive flood fill behind region checks does not finish on larger tables
    for name in [n for n in HEADLINE if "reach(" not in queries[n].check]:
        start = time.perf_counter()
        con.execute(queries[name].check).fetchall()
        times[name] = round(time.perf_counter() - start, 3)
    return times


if __name__ == "__main__":
    main()
