import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.errors import PySparkException

from rasterweave.operators import evaluation as E
from rasterweave.operators import experiments as X
from rasterweave.operators import extensions as U
from rasterweave.operators import losses as LO
from rasterweave.functions.percentiles import exact_percentiles

PAIRS = "target_id INT, pred_id INT"


def matrix(df, n):
    out = np.zeros((n, n), dtype=int)
    for r in df.collect():
        out[r.target_id, r.pred_id] = r.pixels
    return out.tolist()


def test_confusion_golden(spark):
    pixels = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 0)], PAIRS)
    cm = E.confusion(pixels, class_ids=(0, 1), ignore_ids=(255,))
    assert matrix(cm, 2) == [[1, 1], [1, 1]]
    m = E.metrics(cm, class_ids=(0, 1)).first()
    assert (m.pixel_accuracy, m.mean_iou) == (0.5, pytest.approx(1 / 3))


def test_ignore_and_all_ignored(spark):
    pixels = spark.createDataFrame([(0, 0), (1, 0), (255, 1), (255, 0)], PAIRS)
    cm = E.confusion(pixels, class_ids=(0, 1), ignore_ids=(255,))
    assert matrix(cm, 2) == [[1, 0], [1, 0]]
    nothing = E.confusion(spark.createDataFrame([(255, 1)], PAIRS), class_ids=(0, 1), ignore_ids=(255,))
    m = E.metrics(nothing, class_ids=(0, 1)).first()
    assert m.valid_pixels == 0 and m.pixel_accuracy is None and m.mean_iou is None


def test_absent_class_is_left_out(spark):
    cm = E.confusion(spark.createDataFrame([(1, 1), (2, 2)], PAIRS))
    per_class = {r.class_id: r for r in E.class_metrics(cm).collect()}
    assert len(per_class) == 7 and per_class[3].iou is None and per_class[1].iou == 1.0
    assert E.metrics(cm).first().mean_iou == 1.0


def test_class_without_hits_leaves_macro_f1(spark):
    cm = E.confusion(spark.createDataFrame([(1, 1), (2, 3), (3, 2)], PAIRS))
    per_class = E.class_metrics(cm)
    assert E.summary_metrics(per_class).first().macro_f1 == 1.0
    assert E.summary_metrics(per_class, f1_zero=True).first().macro_f1 == pytest.approx(1 / 3)
    assert E.summary_metrics(per_class).first().mean_iou == pytest.approx(1 / 3)


def test_strict_confusion(spark):
    for row in ((0, 0), (9, 1), (1, 8)):
        with pytest.raises(PySparkException, match="illegal label"):
            E.confusion(spark.createDataFrame([row], PAIRS), strict=True).collect()
    with pytest.raises(ValueError):
        E.confusion(spark.createDataFrame([(1, 1)], PAIRS), class_ids=(0, 1), ignore_ids=(0,))


def test_unknown_domain_fails(spark):
    per_sample = E.confusion_by_sample(spark.createDataFrame([(1, 1, 1)], "sample_id LONG, " + PAIRS))
    samples = spark.createDataFrame([(1, " Coast ")], "sample_id LONG, domain STRING")
    with pytest.raises(PySparkException, match="unsupported domain: coast"):
        E.domain_confusion(per_sample, samples).collect()


def reference_losses(z, t, weights=None, gamma=2.0, smooth=1.0, a=0.5, b=0.5):
    z = np.asarray(z, dtype=float)
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    keep = np.array(t) > 0
    p, i = p[keep], np.array(t)[keep] - 1
    w = np.ones(7) if weights is None else np.asarray(weights)
    nll = -np.log(p[np.arange(len(i)), i])
    one = np.eye(7)[i]
    tp, ps, ts = (p * one).sum(0), p.sum(0), one.sum(0)
    here = ts > 0
    share = w[here] / w[here].sum()
    dice = (1 - (2 * tp + smooth) / (ps + ts + smooth))[here]
    tv = (1 - (tp + smooth) / (tp + a * (ps - tp) + b * (ts - tp) + smooth))[here]
    return {
        "cross_entropy": (w[i] * nll).sum() / w[i].sum(),
        "dice": (dice * share).sum(),
        "focal": (w[i] * (1 - np.exp(-nll)) ** gamma * nll).mean(),
        "tversky": (tv * share).sum(),
    }


def test_losses_against_numpy(spark):
    rng = np.random.default_rng(4)
    z, t = rng.normal(size=(60, 7)) * 3, rng.integers(0, 6, 60)
    rows = spark.createDataFrame([(list(map(float, r)), int(k)) for r, k in zip(z, t)], "logits ARRAY<DOUBLE>, target_id INT")
    got = LO.loss_terms(rows).first()
    for name, value in reference_losses(z, t).items():
        assert got[name] == pytest.approx(value), name
    counts = spark.createDataFrame([(c, 10 * c) for c in range(1, 8)], "class_id INT, pixels LONG")
    table = LO.class_weights(counts, "inverse_frequency")
    w = [r.weight for r in table.orderBy("class_id").collect()]
    got = LO.loss_terms(rows, weights=LO.weight_array(table)).first()
    for name, value in reference_losses(z, t, w).items():
        assert got[name] == pytest.approx(value), name


def test_losses_without_valid_pixels(spark):
    rows = spark.createDataFrame([([1.0] * 7, 0)], "logits ARRAY<DOUBLE>, target_id INT")
    got = LO.loss_terms(rows).first()
    assert [got[n] for n in ("cross_entropy", "dice", "focal", "tversky")] == [0, 0, 0, 0]


def test_class_weights_golden(spark):
    counts = {1: 1000, 2: 500, 3: 100, 4: 250, 5: 50, 6: 700, 7: 900}
    df = spark.createDataFrame(list(counts.items()), "class_id INT, pixels LONG")
    got = {r.class_id: r.weight for r in LO.class_weights(df, "inverse_frequency").collect()}
    want = {1: 0.177037, 2: 0.354075, 3: 1.770373, 4: 0.708149, 5: 3.540747, 6: 0.252910, 7: 0.196708}
    assert got == pytest.approx(want, abs=1e-6)
    zero = spark.createDataFrame([(c, 0 if c == 4 else 5) for c in range(1, 8)], "class_id INT, pixels LONG")
    with pytest.raises(PySparkException, match="must be positive"):
        LO.class_weights(zero, "median_frequency").collect()


def test_loss_parameters():
    bad = (
        {"name": "x"}, {"class_ids": ()}, {"class_ids": (1, 1)}, {"class_ids": (0, 1)}, {"gamma": -1.0},
        {"smooth": math.inf}, {"tversky_alpha": 2.0}, {"tversky_alpha": 0.0, "tversky_beta": 0.0},
        {"name": "ce_dice", "ce_weight": 0.0, "dice_weight": 0.0}, {"delta": 1.0}, {"ignore_id": 0.5},
    )
    for options in bad:
        with pytest.raises(ValueError):
            LO.loss_spec(**options)


def test_weighted_loss_needs_weights(spark):
    rows = spark.createDataFrame([([1.0] * 7, 1)], "logits ARRAY<DOUBLE>, target_id INT")
    with pytest.raises(ValueError):
        LO.loss(rows, LO.loss_spec("weighted_cross_entropy"))
    assert LO.loss(rows, LO.loss_spec("ce_dice")).first().loss > 0
    U.register_loss("double_dice", lambda spec: 2 * F.col("dice"))
    doubled = LO.loss_terms(rows).select(U.build_loss("double_dice").alias("l"), "dice").first()
    assert doubled.l == 2 * doubled.dice
    with pytest.raises(ValueError):
        U.register_loss("dice", lambda c: None)


EPOCHS = "experiment_id LONG, epoch LONG, metric DOUBLE"


@pytest.mark.parametrize("limit", [20000, 2])
@pytest.mark.parametrize("patience, epochs", [(0, 2), (2, 4)])
def test_early_stop_on_a_plateau(spark, patience, epochs, limit):
    rows = spark.createDataFrame([(1, e, 1.0) for e in range(9)], EPOCHS)
    got = X.track_best(rows, mode="min", patience=patience, limit=limit).first()
    assert (got.epochs_run, got.best_epoch, got.stopped_epoch) == (epochs, 0, epochs - 1)


def test_min_delta(spark):
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.95), (2, 0, 1.0), (2, 1, 0.89)], EPOCHS)
    got = {r.experiment_id: r.best_epoch for r in X.track_best(rows, "min", min_delta=0.1).collect()}
    assert got == {1: 0, 2: 1}


def test_sliced_fold_equals_whole_fold(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame(
        [(x, e, float(rng.random())) for x in range(5) for e in range(40 + 13 * x)], EPOCHS
    )
    for patience in (None, 9):
        whole = X.track_best(rows, min_delta=0.02, patience=patience)
        sliced = X.track_best(rows, min_delta=0.02, patience=patience, limit=7)
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, sliced.collect()))


def test_monitor_needs_a_finite_value(spark):
    schema = "experiment_id LONG, epoch LONG, phase STRING, loss DOUBLE, metrics MAP<STRING, DOUBLE>"
    rows = spark.createDataFrame([(1, 0, "train", 0.5, {"iou": 0.1}), (1, 0, "val", 0.4, {"iou": 0.2})], schema)
    assert X.monitor_values(rows).first().metric == 0.4
    assert X.monitor_values(rows, "iou").first().metric == 0.2
    with pytest.raises(PySparkException):
        X.monitor_values(rows, "f1").collect()


@pytest.mark.parametrize("accuracy", [10000, 20])
def test_exact_percentiles(spark, accuracy):
    rng = np.random.default_rng(2)
    groups = {1: rng.exponential(size=999), 2: np.array([5.0]), 3: np.repeat([1.0, 2.0, 9.0], [1, 500, 3]), 4: rng.integers(0, 9, 200).astype(float)}
    rows = spark.createDataFrame([(k, float(x)) for k, values in groups.items() for x in values], "k INT, x DOUBLE")
    got = exact_percentiles(rows, ["k"], "x", {"a": 0.1, "m": 0.5, "p": 0.95, "z": 1.0}, accuracy)
    for r in got.collect():
        want = np.percentile(groups[r.k], [10, 50, 95, 100])
        assert [r.a, r.m, r.p, r.z] == pytest.approx(list(want))
