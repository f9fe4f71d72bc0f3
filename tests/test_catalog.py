import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rasterweave.operators import catalog as C
from rasterweave.operators import sampling as SA
from rasterweave.operators import statistics as ST
from rasterweave.sources.tree import scan_tree

MASKS = "sample_id STRING, target_id INT"


def make_tree(root, files):
    for name in files:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")


@pytest.fixture
def tree(tmp_path):
    files = []
    for split, domain, n in (("Train", "Urban", 3), ("Train", "Rural", 2), ("Val", "Urban", 1)):
        for i in range(n):
            files += [f"{split}/{domain}/images_png/{i}.png", f"{split}/{domain}/masks_png/{i}.png"]
    files += [f"Test/Urban/images_png/{i}.png" for i in range(2)]
    make_tree(tmp_path, files)
    return tmp_path


def test_scan_tree_counts(spark, tree):
    samples = scan_tree(spark, str(tree))
    stats = {(r.level, r.name): (r.samples, r.missing_masks) for r in C.manifest_stats(samples).collect()}
    assert stats[("total", "all")] == (8, 2)
    assert {k[1]: v[0] for k, v in stats.items() if k[0] == "split"} == {"train": 5, "val": 1, "test": 2}
    assert {k[1]: v[0] for k, v in stats.items() if k[0] == "domain"} == {"urban": 6, "rural": 2}
    assert C.missing_labels(samples).count() == 0
    first = samples.orderBy(*C.manifest_order()).first()
    assert first.sample_id == "train-urban-0"


def test_scan_prefers_first_alias_exact_mask_and_outer_level(spark, tmp_path):
    make_tree(
        tmp_path,
        [
            "Train/Train/Urban/images/a.tif",
            "Train/Train/Urban/images/b.JPG",
            "Train/Train/Urban/images/notes.txt",
            "Train/Train/Urban/img/c.tif",
            "Train/Train/Urban/labels/a.png",
            "Train/Train/Urban/labels/a.tif",
            "Train/Train/Urban/labels/b.bmp",
            "Train/Train/Urban/labels/b.png",
            "Train/Train/Urban/gt/a.tif",
        ],
    )
    rows = {r.sample_id: r for r in scan_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"train-urban-a", "train-urban-b"}
    assert rows["train-urban-a"].mask_path.endswith("labels/a.tif")
    assert rows["train-urban-b"].mask_path.endswith("labels/b.bmp")


def test_scan_one_extra_level(spark, tree, tmp_path_factory):
    outer = tmp_path_factory.mktemp("outer")
    os.rename(tree, outer / "data")
    assert scan_tree(spark, str(outer)).count() == 8


def test_missing_train_mask(spark, tree):
    os.remove(tree / "Train/Urban/masks_png/1.png")
    samples = scan_tree(spark, str(tree))
    assert [r.sample_id for r in C.missing_labels(samples).collect()] == ["train-urban-1"]
    with pytest.raises(PySparkException, match="sample without mask"):
        C.require_labels(samples).collect()


def test_filter_rejects_unknown_names(spark, tree):
    samples = scan_tree(spark, str(tree))
    assert C.filter_manifest(samples, split="train", domain="rural").count() == 2
    with pytest.raises(ValueError):
        C.filter_manifest(samples, split="training")
    with pytest.raises(ValueError):
        C.filter_manifest(samples, domain="coast")


def test_validation_issues(spark):
    dims = spark.createDataFrame(
        [("a", 8, 8, 8, 8), ("b", 8, 8, 4, 4), ("c", 8, 8, 8, 8)],
        "sample_id STRING, image_width INT, image_height INT, mask_width INT, mask_height INT",
    )
    pixels = spark.createDataFrame([("a", 0), ("a", 1), ("c", 9), ("c", 9), ("c", 2)], MASKS)
    headers = spark.createDataFrame([("a", "mask", None), ("d", "image", "bad magic")], "sample_id STRING, kind STRING, error STRING")
    got = {(r.sample_id, r.problem) for r in C.validate(dims, dims, pixels, headers).collect()}
    assert got == {
        ("b", "image/mask size mismatch: (8, 8) vs (4, 4)"),
        ("c", "invalid mask pixel values: [9]"),
        ("d", "unreadable image: bad magic"),
    }
    assert C.validate(dims, dims).count() == 1
    assert {r.class_id for r in C.class_histogram(pixels).collect()} == {1, 2, 9}


URBAN = [1] * 4 + [2] * 2 + [3] * 3 + [4] * 2 + [6] * 1 + [7] * 3 + [0]
RURAL = [1] * 2 + [2] * 2 + [3] * 2 + [5] * 2 + [6] * 3 + [7] * 3 + [0] * 2


@pytest.fixture
def two_masks(spark):
    pixels = spark.createDataFrame([("u", c) for c in URBAN] + [("r", c) for c in RURAL], MASKS)
    samples = spark.createDataFrame(
        [("u", "train", "urban"), ("r", "train", "rural")], "sample_id STRING, split STRING, domain STRING"
    )
    return pixels, samples


def test_statistics_golden(two_masks):
    pixels, samples = two_masks
    stats = ST.sample_statistics(ST.sample_class_counts(pixels, strict=True))
    totals = ST.dataset_totals(samples, stats).first()
    assert (totals.total_pixels, totals.ignored_pixels, totals.valid_pixels) == (32, 3, 29)
    classes = {r.class_id: (r.pixels, r.samples) for r in ST.class_totals(stats).collect()}
    assert classes == {1: (6, 2), 2: (4, 2), 3: (5, 2), 4: (2, 1), 5: (2, 1), 6: (4, 2), 7: (6, 2)}


def test_strict_statistics_reject_unknown(spark):
    with pytest.raises(PySparkException, match="unknown mask value 9"):
        ST.sample_class_counts(spark.createDataFrame([("a", 9)], MASKS), strict=True).collect()


def test_class_balanced_weights_mean_one(spark, two_masks):
    pixels, samples = two_masks
    stats = ST.sample_statistics(ST.sample_class_counts(pixels))
    for strategy in SA.STRATEGIES:
        for variant in SA.VARIANTS:
            weights = SA.sampling_weights(stats, samples, strategy, variant=variant)
            assert weights.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)


def test_class_balanced_weights_golden(spark):
    # urban shows five classes once seen in both samples and one rare; rural one rare of seven
    urban = [1, 2, 3, 4, 6, 7]
    rural = [1, 2, 3, 6, 7]
    pixels = spark.createDataFrame([("u", c) for c in [*urban, 5]] + [("r", c) for c in rural], MASKS)
    samples = spark.createDataFrame(
        [("u", "train", "urban"), ("r", "train", "rural")], "sample_id STRING, split STRING, domain STRING"
    )
    weights = SA.sampling_weights(ST.sample_statistics(ST.sample_class_counts(pixels)), samples, "class_balanced")
    got = {r.sample_id: r.weight for r in weights.collect()}
    rare = (5 + 2 * 2**0.5) / 7
    assert got["u"] == pytest.approx(2 * rare / (rare + 1))
    assert got["r"] == pytest.approx(2 / (rare + 1))
    assert (got["u"], got["r"]) == (pytest.approx(1.0558674981), pytest.approx(0.9441325019))


def test_sampler_parameters(two_masks):
    pixels, samples = two_masks
    stats = ST.sample_statistics(ST.sample_class_counts(pixels))
    for bad in ({"strategy": "x"}, {"class_power": -1}, {"min_weight": 0}, {"min_weight": 2, "max_weight": 1}):
        with pytest.raises(ValueError):
            SA.sampling_weights(stats, samples, **bad)
    with pytest.raises(ValueError):
        SA.uniform_sample(samples, 1, strategy="class_balanced")


def test_weighted_sample_properties(spark):
    weights = spark.createDataFrame([(i, 1000.0 if i == 7 else 1.0) for i in range(500)], "sample_id LONG, weight DOUBLE")
    first = SA.weighted_sample(spark, weights, 3000, seed=3, buckets=64)
    again = SA.weighted_sample(spark, weights, 3000, seed=3, buckets=16)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    heavy = first.where("sample_id = 7").count() / 3000
    assert first.count() == 3000 and 0.6 < heavy < 0.74
    top = SA.weighted_top(weights, 50, seed=1)
    assert top.select("sample_id").distinct().count() == 50


def test_uniform_sample_and_batches(spark):
    samples = spark.range(103).withColumnRenamed("id", "sample_id")
    shuffled = SA.uniform_sample(samples, seed=9, n=40)
    assert sorted(r.position for r in shuffled.collect()) == list(range(40))
    assert shuffled.select("sample_id").distinct().count() == 40
    assert SA.batches(samples, 10, drop_last=True, chunk_size=8).count() == 100
    last = SA.batches(samples, 10, chunk_size=8).where("batch = 10")
    assert sorted(r.sample_id for r in last.collect()) == [100, 101, 102]


def test_large_first_rows_is_cut_by_position(spark):
    from rasterweave.functions.prefix import first_rows

    rows = first_rows(spark.range(1000), [F.col("id").desc()], 30, small=5)
    assert sorted(r.id for r in rows.collect()) == list(range(970, 1000))
