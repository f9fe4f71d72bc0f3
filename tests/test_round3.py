"""Queries on inputs that the given tables lack, against their DuckDB checks."""

from pathlib import Path

import duckdb
from checking import compare, connect

from rasterweave.plans import load

FOLDER = "/root/testdata/sf0.001"


def tables(folder, **changed):
    """The smallest tables under ``folder``, some of them as a DuckDB query over their file makes them."""
    for path in Path(FOLDER).glob("*.parquet"):
        text = changed.get(path.stem, "SELECT * FROM t").replace("FROM t", f"FROM '{path}'")
        duckdb.sql(text).write_parquet(str(folder / path.name))
    return str(folder)


def test_pixels_without_confidence_are_scored(spark, tmp_path):
    folder = tables(tmp_path, events="SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END AS value) FROM t")
    with connect(folder) as con:
        assert compare(load()["tiled_scoring_blocks"], spark, folder, con) is None


def test_job_streams_call_python_per_bucket_and_not_per_job(spark, tmp_path):
    """Many jobs, in two triggers, with a job without an id, in at most as many groups as there are buckets."""
    from datetime import datetime

    from rasterweave.streaming import jobs as S
    from rasterweave.streaming.tables import run_to_table

    start = datetime(2024, 5, 1)
    rows = [(j, s, start, t) for j in [None, 2**53 + 1, *range(300)] for s, t in enumerate(["queued", "tiling", "preparing"])]
    schema = "job_id LONG, seq LONG, ts TIMESTAMP, to_state STRING"
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in run_to_table(S.ordered_job_outcomes(stream, "1 day", buckets=4)).collect()}
    assert got == {
        (j, s, start, b, t, r is None, r, v)
        for j in [None, 2**53 + 1, *range(300)]
        for s, b, t, r, v in [(0, None, "queued", None, 0), (1, "queued", "tiling", "illegal", 0), (2, "queued", "preparing", None, 1)]
    }
    plain = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert {tuple(r) for r in run_to_table(S.job_outcomes(plain, buckets=4)).collect()} == got


def test_boxes_are_projected_through_utm_as_arrays(spark):
    """The same bounds as by single points, without a lambda over the points of every box."""
    from pyspark.sql import functions as F

    from rasterweave.functions import geometry as G

    crs = ["EPSG:4326", "EPSG:3857", "EPSG:32631", "EPSG:32732"]
    box = F.struct(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")])
    degrees = spark.createDataFrame([(k, 3.0 + k, 10.0 - 3 * k, 3.5 + 2 * k, 10.2 - 2 * k) for k in range(8)], "k INT, minx DOUBLE, miny DOUBLE, maxx DOUBLE, maxy DOUBLE")
    for source in crs:
        for target in crs:
            here = degrees.select("k", G.densified_bounds(box, F.lit("EPSG:4326"), F.lit(source)).alias("b"))
            made = here.select("k", "b", G.densified_bounds(F.col("b"), F.lit(source), F.lit(target)).alias("c"))
            b, t = F.col("b"), F.transform(F.sequence(F.lit(0), F.lit(22)), lambda i: i / F.lit(22.0))
            x, y = (lambda s: b["minx"] + s * (b["maxx"] - b["minx"])), (lambda s: b["miny"] + s * (b["maxy"] - b["miny"]))
            edges = [lambda s: G.point(x(s), b["miny"]), lambda s: G.point(x(s), b["maxy"]), lambda s: G.point(b["minx"], y(s)), lambda s: G.point(b["maxx"], y(s))]
            ring = F.concat(*[F.transform(t, e) for e in edges])
            point = G.bounds(G.reproject(ring, F.lit(source), F.lit(target))).alias("p")
            for row in made.select("c", point).collect():
                assert all(abs(u - w) <= 1e-6 for u, w in zip(row["c"], row["p"])), (source, target, row)
    plan = degrees.select(G.densified_bounds(box, F.lit("EPSG:4326"), F.lit("EPSG:32631")))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan


def test_overlapping_extents_are_dealt_to_many_tasks(spark):
    """Dense boxes from one partition each: the pairs are made by as many tasks as a shuffle has."""
    from pyspark.sql import functions as F

    from rasterweave.operators import spatial as SP

    k = F.col("id")
    box = lambda x: F.struct(x.alias("minx"), x.alias("miny"), (x + 5.0).alias("maxx"), (x + 5.0).alias("maxy"))
    rows = spark.range(0, 400, 1, 1).select(k, F.lit("EPSG:3857").alias("crs"), box(k % 20 + 0.5).alias("bounds"))
    pairs = SP.extent_intersects(rows.withColumnRenamed("id", "aoi_id"), rows.withColumnRenamed("id", "scene_id"))
    assert pairs.count() == sum(abs(a % 20 - b % 20) < 5 for a in range(400) for b in range(400))
    used = pairs.groupBy(F.spark_partition_id()).count().count()
    assert used >= 4


def test_states_are_spread_by_the_length_of_their_job(spark):
    """Long jobs have several salts, short ones one; the outcomes are those of the fold."""
    from pyspark.sql import functions as F

    from rasterweave.operators import jobs as J

    k, n = F.col("id"), 3000
    seq = F.when(k < n, k).otherwise((k - n) % 8)
    job = F.when(k < n, 0).otherwise(1 + F.floor((k - n) / 8))
    states = F.array(*map(F.lit, J.STATES))
    events = spark.range(n + 800).select(
        job.cast("long").alias("job_id"), seq.cast("long").alias("seq"), F.timestamp_seconds(seq + k % 3).alias("ts"),
        F.get(states, F.when(seq < 1000, F.pmod(seq, F.lit(7))).otherwise(F.pmod(F.xxhash64("id"), F.lit(9))).cast("int")).alias("to_state"),
    )
    plan = J.apply_events(events, limit=0)
    assert {tuple(r) for r in plan.collect()} == {tuple(r) for r in J.apply_events(events, limit=10**6).collect()}
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, 31" not in text and "[0,1,2,3,4" not in text
