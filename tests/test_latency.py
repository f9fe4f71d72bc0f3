"""Latency sketches against sorted values."""

import random

import pytest
from pyspark.sql import functions as F

from rasterweave.streaming import latency as L


@pytest.mark.parametrize("error", [0.01, 0.1])
def test_quantiles_within_the_error(spark, error):
    chance = random.Random(1)
    values = {
        "log": [chance.lognormvariate(2, 3) for _ in range(999)], "flat": [chance.uniform(5, 6) for _ in range(200)],
        "one": [7.25], "none": [0.0, -3.0, 0.0], "tiny": [1e-9, 1e9, 3.0],
    }
    rows = [(m, v) for m, vs in values.items() for v in vs] + [("log", None), ("flat", float("nan")), ("empty", None)]
    chance.shuffle(rows)
    table = spark.createDataFrame(rows, "model_id STRING, latency_ms DOUBLE").withColumn("part", F.monotonically_increasing_id() % 3)
    # merged in two steps from parts in another order
    parts = [L.latency_sketch(table.where(F.col("part") == k), error=error) for k in (2, 0, 1)]
    merged = L.merged_sketch(L.merged_sketch(parts[0].unionByName(parts[1])).unionByName(parts[2]))
    quantiles = {f"q{i}": p for i, p in enumerate((0.0, 0.25, 0.5, 0.95, 1.0))}
    got = {r.model_id: r for r in L.sketched_report(merged, batch_size=2, error=error, quantiles=quantiles).collect()}
    assert set(got) == set(values)
    for model, own in values.items():
        own, r = sorted(own), got[model]
        assert r.batches == len(own) and r.mean_ms == pytest.approx(sum(own) / len(own))
        for name, p in quantiles.items():
            exact = own[int(p * (len(own) - 1))]
            assert r[name] == pytest.approx(max(exact, 0.0), rel=error * (1 + 1e-9))
    whole = L.latency_sketch(table, error=error)
    same = lambda t: {(r.model_id, r.bucket): r.batches for r in t.collect()}
    assert same(whole) == same(merged)


def test_repeated_batches_and_compaction(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path)
    schema = "model_id STRING, latency_ms DOUBLE"
    for k in range(3):
        spark.createDataFrame([("a", float(10 * k + i)) for i in range(5)], schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        L.start_latencies(stream, f"{base}/sketches", f"{base}/progress").awaitTermination()
    report = L.sketched_report(L.merged_sketch(spark.read.parquet(f"{base}/sketches/*"))).first()
    assert report.batches == 15 and report.mean_ms == pytest.approx(12.0) and report.median_ms == pytest.approx(12, rel=0.01)
    L.compact(spark, f"{base}/sketches", f"{base}/whole")
    assert L.sketched_report(spark.read.parquet(f"{base}/whole")).first() == report
    with pytest.raises(ValueError):
        L.latency_sketch(spark.createDataFrame([], schema), error=1.0)
