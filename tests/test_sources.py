import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.functions import affine
from rasterweave.functions import scalars as S
from rasterweave.operators import evaluation as E
from rasterweave.operators import extensions as U
from rasterweave.operators import jobs as J
from rasterweave.operators import rasters as R
from rasterweave.sources import documents as D
from rasterweave.sources import imagery, sinks
from rasterweave.sources.arrays import read_grids
from rasterweave.streaming import evaluation as SE
from rasterweave.streaming import imagery as SI
from rasterweave.streaming.jobs import job_outcomes, publish_runs
from rasterweave.streaming.tables import run_to_table
from test_jobs import SCHEMA, at, random_events, simulate, valid_job
from test_rasters import grid, raster


def test_numpy_grids(spark, tmp_path):
    a = np.arange(15, dtype=np.float32).reshape(3, 5)
    np.save(tmp_path / "scene_12.npy", a)
    np.savez(tmp_path / "scene_13.npz", a * 2)
    (tmp_path / "scene_14.npy").write_bytes(b"junk")
    rows = read_grids(spark, str(tmp_path), block=2)
    assert rows.where("scene_id = 14").first().error
    good = R.from_blocks(rows.where("error IS NULL"), ["confidence"])
    got = {(r.scene_id, r.row_idx, r.col_idx): r.confidence for r in good.collect()}
    assert got == {(s, r, c): float(a[r, c] * k) for s, k in ((12, 1), (13, 2)) for r in range(3) for c in range(5)}


def test_raster_products_round_trip(spark, tmp_path):
    pixels = grid(spark, [[1, 2, None], [0, 5, 6], [7, 1, 1]]).withColumn("conf", F.col("class_id") / 10.0)
    blocks = R.to_blocks(pixels, ["class_id", "conf"], 2)
    path = str(tmp_path / "out")
    sinks.write_rasters(blocks, path, {"class_id": "mask", "conf": "confidence"})
    back = R.from_blocks(spark.read.parquet(path), ["class_id", "conf"])
    assert dict(back.dtypes)["class_id"] == "smallint" and dict(back.dtypes)["conf"] == "float"
    assert back.where("row_idx = 0 AND col_idx = 2").first().class_id == 0
    assert back.count() == 9


def test_job_files(spark, tmp_path):
    doc = valid_job()
    (tmp_path / f"{doc['job_id']}.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "other.json").write_text(json.dumps(doc))
    (tmp_path / "bad.json").write_text("{oops")
    rows = {r.file_name: r for r in D.read_jobs(spark, str(tmp_path)).collect()}
    assert rows[doc["job_id"]].problem is None
    assert rows["other"].problem == "id_mismatch" and rows["bad"].problem == "unreadable"
    jobs = D.read_jobs(spark, str(tmp_path)).where("problem IS NULL")
    want = dict(doc, request={k: v for k, v in doc["request"].items() if k != "metadata"})
    text = D.canonical_job(jobs).first().doc
    assert text == json.dumps(want, sort_keys=True, separators=(",", ":"))
    D.write_lines(D.canonical_job(jobs), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).first().value == text


def test_protocols(spark, tmp_path):
    (tmp_path / "full.json").write_text(json.dumps({"benchmark_id": "b1", "model_ids": ["m1", "m2"], "training": {"epochs": 5}}))
    rows = D.read_protocols(spark, str(tmp_path)).orderBy("model_id").collect()
    assert [(r.benchmark_id, r.model_id, json.loads(r.training)) for r in rows] == [("b1", "m1", {"epochs": 5}), ("b1", "m2", {"epochs": 5})]


def test_strict_json(spark):
    df = spark.range(1).select(
        F.lit(float("nan")).alias("b"), F.lit(float("inf")).alias("a"), F.lit(1.5).cast("double").alias("c"),
        F.create_map(F.lit(3), F.lit(1)).alias("d"), F.array(F.lit(float("-inf"))).alias("e"),
    )
    assert D.strict_json(df).first().doc == '{"a":null,"b":null,"c":1.5,"d":{"3":1},"e":[null]}'


def test_collections(spark):
    t = spark.createDataFrame([(1, 5, "{}"), (1, 2, "[]")], "scene_id LONG, region_id LONG, doc STRING")
    headers = sinks.collection_headers(t, raster(spark, 2, 2))
    doc = json.loads(sinks.collections(t, headers).first().doc)
    assert doc["features"] == [[], {}] and doc["properties"] == {"crs": "EPSG:4326", "feature_count": 2}


def test_analysis_report(spark):
    histogram = spark.createDataFrame([(1, 0, 5), (1, 2, 4)], "scene_id LONG, class_id INT, pixel_count LONG")
    conf = spark.createDataFrame([(1, 0.5)], "scene_id LONG, mean DOUBLE")
    areas = spark.createDataFrame([(1, 2, 40.0, 3)], "scene_id LONG, class_id INT, area_m2 DOUBLE, feature_count LONG")
    doc = json.loads(sinks.analysis_reports(histogram, conf, areas).first().doc)["statistics"]
    assert doc == {"class_area_m2": {"2": 40.0}, "class_pixel_counts": {"0": 5, "2": 4}, "mean_confidence": 0.5, "vector_feature_count": 3}


def test_provider(spark, tmp_path):
    t = (10.0, 0.0, 5e5, 0.0, -10.0, 3.1e6)
    table = raster(spark, 4, 3, "EPSG:3857", t).withColumns(
        {"path": F.lit("/x/imagery_20260917T143000.tif"), "modified": F.lit("2020-01-01").cast("timestamp")}
    )
    pixels = grid(spark, np.arange(12).reshape(3, 4).tolist())
    source = imagery.BlockImagery(table, R.to_blocks(pixels, ["class_id"], 2), ("class_id",), 2)
    assert str(source.timestamps().first().acquired_at) == "2026-09-17 14:30:00"
    assert sorted(r.class_id for r in source.window(1, 1, 2, 2).collect()) == [5, 6, 9, 10]
    assert source.tiles(2, 0).count() == 4 and source.metadata().count() == 1
    with pytest.raises(Exception, match="outside"):
        source.window(2, 2, 2, 2).collect()


def test_scoring_loads_the_model_once_per_task(spark):
    blocks = R.to_blocks(grid(spark, [[0, 3], [6, 7]], kind="INT"), ["class_id"], 2)

    def make():
        return lambda bands: (bands[0] + 1, bands[0] / 10.0)

    rows = R.from_blocks(U.score_blocks(blocks, make, ["class_id"]), ["pred_id", "conf"])
    assert sorted((r.pred_id, r.conf) for r in rows.collect()) == [(1, 0.0), (4, 0.3), (7, 0.6), (8, 0.7)]


def write_parts(spark, rows, schema, path, parts):
    """One file per slice, in order of arrival."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        df = spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1)
        df.write.mode("append").parquet(path)


def test_job_stream_equals_batch(spark, tmp_path):
    events = sorted(random_events(12, 30), key=lambda e: e[1])
    write_parts(spark, events, SCHEMA, str(tmp_path / "in"), 4)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(map(tuple, run_to_table(job_outcomes(stream)).collect()), key=lambda r: r[:2])
    assert got == simulate(events)


def test_metric_stream_equals_batch(spark, tmp_path):
    rows = [(i % 8, 1 + (i * 5) % 7) for i in range(400)]
    schema = "target_id INT, pred_id INT"
    write_parts(spark, rows, schema, str(tmp_path / "in"), 4)
    seen = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    SE.start_metrics(stream, lambda df, i: seen.append(df.first()), str(tmp_path / "progress")).awaitTermination()
    whole = E.metrics(E.confusion(spark.createDataFrame(rows, schema))).first()
    assert len(seen) == 4 and list(seen[-1]) == pytest.approx(list(whole))
    halves = [E.confusion(spark.createDataFrame(part, schema)) for part in (rows[:150], rows[150:])]
    assert list(E.metrics(SE.merge_matrices(*halves)).first()) == pytest.approx(list(whole))


def test_imagery_stream_merges_like_one_mosaic(spark, tmp_path):
    schema = "scene_id LONG, row_idx LONG, col_idx LONG, tile_ord INT, pred_id INT, conf DOUBLE"
    rows = [(1, r, c, t, 1 + (r + c + t) % 7, ((r * 7 + c * 3 + t * 5) % 11) / 11) for t in range(4) for r in range(4) for c in range(4)]
    for turn, order in enumerate((rows, rows[::-1])):
        write_parts(spark, order, schema, str(tmp_path / f"in{turn}"), 4)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in{turn}"))
        SI.start_scoring(stream, lambda df: df, str(tmp_path / f"w{turn}"), str(tmp_path / f"p{turn}")).awaitTermination()
    whole = R.mosaic(spark.createDataFrame(rows, schema))
    for turn in (0, 1):
        got = SI.read_mosaic(whole, str(tmp_path / f"w{turn}"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_streams_over_tables_of_several_files(spark, tmp_path):
    from rasterweave.plans import load
    from rasterweave.plans.views import TABLES

    source = "/root/testdata/sf0.001"
    for table in TABLES:
        df = spark.read.parquet(f"{source}/{table}.parquet")
        (df.repartition(3) if df.count() > 100 else df).write.parquet(str(tmp_path / f"{table}.parquet"))
    queries = load()
    for name in ("streaming_confusion", "streaming_job_outcomes", "streaming_throughput", "streaming_mosaic"):
        got, expected = (sorted(map(str, queries[name](spark, d).collect())) for d in (str(tmp_path), source))
        assert got == expected and got


def test_run_stream_publishes_events(spark, tmp_path):
    schema = "job_id LONG, ts TIMESTAMP, error STRING"
    write_parts(spark, [(1, at(0), None), (2, at(1), "boom")], schema, str(tmp_path / "in"), 1)
    seen = []
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(publish_runs(lambda df: seen.extend(df.collect()))).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 12 and {r.to_state for r in seen if r.step == 6} == {"completed", "failed"}


def test_throughput_batch(spark):
    df = spark.createDataFrame([(1, 0, at(0), "queued"), (1, 1, at(70), "failed")], SCHEMA)
    assert [r.failed for r in J.windowed_throughput(df).orderBy("window_start").collect()] == [0, 1]


def test_scalar_text_rules(spark):
    def value(column):
        return spark.range(1).select(column.alias("x")).first().x

    assert value(S.transition_key(F.lit(1), F.lit(2))) == "1->2"
    assert value(S.tile_key(F.lit(2), F.lit(13))) == "tile_r0002_c0013"
    assert value(S.file_stem(F.lit("/a/b.tar.gz"))) == "b.tar" and value(S.file_stem(F.lit("/a/.hidden"))) == ".hidden"
    assert value(S.parse_instant(F.lit("2026-01-01T12:00:00"))) is None
    assert value(S.parse_instant(F.lit("2026-01-01T12:00:00+02:00"))).hour in (10, 11, 12)
    assert value(S.is_json_integer(F.lit("true"))) is False and value(S.is_json_integer(F.lit("-3"), 0)) is False
    assert value(S.is_json_integer(F.lit("12"), 0)) is True
    assert value(S.finite_or_null(F.lit(float("inf")))) is None
    assert value(affine.to_pixel(affine.transform_of(10, 0, 5, 0, -10, 9), F.lit(25.0), F.lit(-11.0))["row"]) == 2.0


def test_observe_and_tables(spark, tmp_path):
    df = U.observed(spark.range(5), "rows")
    U.write_table(df, str(tmp_path / "t"))
    assert U.read_table(spark, str(tmp_path / "t"), "id LONG").count() == 5
    image, mask = U.apply_paired(spark.range(2), None, lambda d: d.where("id > 0"))
    assert image.count() == 1 and mask is None


def test_windows_of_their_own(spark):
    """A window per scene, one of them in two windows; a window that leaves its scene fails."""
    pixels = [(s, r, c, s * 1000 + r * 30 + c) for s, h, w in ((1, 20, 9), (2, 3, 1)) for r in range(h) for c in range(w)]
    table = spark.createDataFrame(pixels, "scene_id LONG, row_idx LONG, col_idx LONG, v INT")
    scenes = spark.createDataFrame([(1, 20, 9), (2, 3, 1)], "scene_id LONG, height INT, width INT")
    store = imagery.BlockImagery(scenes, R.to_blocks(table, ["v"], 4), ("v",), 4)
    asked = [(1, 1, 3, 2, 10, 5), (2, 1, 19, 8, 1, 1), (3, 2, 0, 0, 3, 1)]
    schema = "window_id LONG, scene_id LONG, row_off INT, col_off INT, height INT, width INT"
    got = sorted(map(tuple, store.windows(spark.createDataFrame(asked, schema)).collect()))
    assert got == sorted((i, s, r - y, c - x, v) for i, s, y, x, h, w in asked for t, r, c, v in pixels if t == s and y <= r < y + h and x <= c < x + w)
    for bad in ((9, 1, 11, 0, 10, 5), (9, 1, -1, 0, 1, 1), (9, 1, 0, 0, 0, 1), (9, 3, 0, 0, 1, 1)):
        with pytest.raises(Exception, match="outside"):
            store.windows(spark.createDataFrame([bad], schema)).count()
