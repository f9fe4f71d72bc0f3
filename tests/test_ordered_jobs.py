"""Attempts out of order, gaps, stalled and finished jobs in a stream."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rasterweave.streaming.jobs import ordered_job_outcomes
from rasterweave.streaming.tables import rocksdb_session, run_to_table

START = datetime(2024, 5, 1)
MINUTE = 60


def run(spark, folder, triggers, **times):
    """Outcomes of attempts ``job, seq, minute, state``, a list per trigger."""
    spark = rocksdb_session(spark)
    schema = "job_id LONG, seq LONG, ts TIMESTAMP, to_state STRING"
    at = lambda m: None if m is None else START + timedelta(minutes=m)
    for rows in triggers:
        found = spark.createDataFrame([(j, s, at(m), t) for j, s, m, t in rows], schema)
        found.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    done = run_to_table(ordered_job_outcomes(stream, "0 seconds", **times))
    minute = ((F.unix_micros("ts") - int(START.timestamp() * 1e6)) / 60e6).alias("minute")
    rows = done.select("job_id", "seq", minute, "from_state", "to_state", "rejected", "revision").collect()
    return sorted(map(tuple, rows), key=lambda r: (r[0], r[1] is None, r[1], r[2] or 0, r[3] or "", r[5] or ""))


def test_order_gaps_and_reports(spark, tmp_path):
    triggers = [
        # seq 1 of job 1 comes before seq 0; job 2 never gets its seq 1
        [(1, 1, 1, "preparing"), (2, 0, 0, "queued"), (2, 2, 1, "fetching_imagery"), (2, 3, 1, "preparing")],
        [(1, 0, 2, "queued"), (1, 0, 2, "queued"), (1, None, 2, "tiling")],
        # time goes on elsewhere: the gap of job 2 is given up, later job 1 and 2 stand still
        [(3, 0, 20, "queued"), (3, 1, 20, "cancelled")],
        # the timers of a trigger go off after its rows
        [(4, 0, 300, "queued")],
        [(2, 1, 302, "preparing"), (4, 1, 301, "failed")],
    ]
    got = run(spark, str(tmp_path / "in"), triggers, patience=10 * MINUTE, stall=120 * MINUTE, retention=60 * MINUTE)
    assert got == [
        (1, 0, 2.0, None, "queued", None, 0),
        (1, 0, 2.0, "queued", "queued", "missed", 0),
        # judged in its turn, when its time is before that of seq 0
        (1, 1, 1.0, "queued", "preparing", "late", 0),
        # what has no number comes last in its trigger
        (1, None, 2.0, "queued", "tiling", "incomplete", 0),
        (1, None, 2.0, "queued", None, "stalled", 0),
        (2, 0, 0.0, None, "queued", None, 0),
        (2, 1, 302.0, "preparing", "preparing", "missed", 1),
        (2, 2, 1.0, "queued", "fetching_imagery", "illegal", 0),
        (2, 3, 1.0, "queued", "preparing", None, 1),
        (2, None, 1.0, "preparing", None, "stalled", 1),
        (3, 0, 20.0, None, "queued", None, 0),
        (3, 1, 20.0, "queued", "cancelled", None, 1),
        (4, 0, 300.0, None, "queued", None, 0),
        (4, 1, 301.0, "queued", "failed", None, 1),
    ]


def test_finished_jobs_leave_the_state(spark, tmp_path):
    """Before the retention is over a job still rejects; after it the same number starts anew."""
    triggers = [
        [(1, 0, 0, "queued"), (1, 1, 0, "cancelled")],
        [(1, 2, 30, "preparing"), (9, 0, 30, "queued")],
        [(9, 1, 100, "preparing")],
        [(9, 2, 101, "fetching_imagery")],
        [(1, 0, 102, "queued")],
    ]
    got = run(spark, str(tmp_path / "in"), triggers, patience=10 * MINUTE, stall=1000 * MINUTE, retention=60 * MINUTE)
    assert [r[1:] for r in got if r[0] == 1] == [
        (0, 0.0, None, "queued", None, 0),
        (0, 102.0, None, "queued", None, 0),
        (1, 0.0, "queued", "cancelled", None, 1),
        (2, 30.0, "cancelled", "preparing", "terminal", 1),
    ]
