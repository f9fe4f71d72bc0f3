"""Queries for prediction evaluation, losses and experiment histories."""

from pyspark.sql import functions as F

from rasterweave.operators import evaluation as E
from rasterweave.operators import experiments as X
from rasterweave.operators import losses as LO
from rasterweave.operators import statistics as ST
from rasterweave.operators.extensions import build_loss, grouped_metrics
from rasterweave.plans.registry import query
from rasterweave.sources.documents import strict_json
from rasterweave.taxonomy import internal_index

_SCALARS = (*E.SCALARS, "macro_dice")


def _rounded(df, names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


@query("A-16", "label_pixels", """
SELECT target_id, pred_id, count(*) AS pixels FROM label_pixels WHERE target_id <> 0 GROUP BY ALL""")
def confusion_matrix(v):
    return E.confusion(v.label_pixels, strict=True)


@query("A-16", "label_pixels", """
SELECT target_id, """ + ", ".join(f"count(*) FILTER (pred_id = {c}) AS pred_{c}" for c in range(1, 8)) + """
FROM label_pixels WHERE target_id <> 0 GROUP BY target_id""")
def confusion_pivot(v):
    return E.pivot_matrix(E.confusion(v.label_pixels))


_PER_CLASS = """
m AS (SELECT target_id, pred_id, count(*) AS n FROM label_pixels WHERE target_id <> 0 GROUP BY ALL),
k AS (SELECT CAST(range AS INT) AS class_id FROM range(1, 8)),
q AS (SELECT class_id, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM m WHERE target_id = class_id AND pred_id = class_id), 0) AS tp,
             coalesce((SELECT CAST(sum(n) AS BIGINT) FROM m WHERE target_id = class_id), 0) AS actual,
             coalesce((SELECT CAST(sum(n) AS BIGINT) FROM m WHERE pred_id = class_id), 0) AS predicted FROM k),
c AS (SELECT *, tp / nullif(actual + predicted - tp, 0) AS iou, tp / nullif(predicted, 0) AS precision,
             tp / nullif(actual, 0) AS recall FROM q),
p AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM c)"""


@query("A-17 A-19", "label_pixels", f"""
WITH {_PER_CLASS}
SELECT class_id, ['background', 'building', 'road', 'water', 'barren', 'forest', 'agriculture'][class_id] AS class_name,
       tp, actual, predicted, round(iou, 6) AS iou, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM p""")
def class_metrics(v):
    return _rounded(E.class_metrics(E.confusion(v.label_pixels)), ["iou", "precision", "recall", "f1"])


_SUMMARY = """
SELECT {by} round(sum(tp) / sum(actual), 6) AS pixel_accuracy, round(avg(recall), 6) AS mean_class_accuracy,
       round(avg(iou), 6) AS mean_iou, round(sum(actual * coalesce(iou, 0)) / sum(actual), 6) AS frequency_weighted_iou,
       round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
       CAST(sum(actual) AS BIGINT) AS valid_pixels, round(avg(f1), 6) AS macro_dice"""


@query("A-17", "label_pixels", f"WITH {_PER_CLASS} {_SUMMARY.format(by='')} FROM p")
def segmentation_metrics(v):
    return _rounded(E.metrics(E.confusion(v.label_pixels)), _SCALARS)


_BY_DOMAIN = """
x AS (SELECT target_id, pred_id, domain, count(*) AS n FROM label_pixels JOIN samples USING (sample_id)
      WHERE target_id <> 0 GROUP BY ALL),
m AS (SELECT domain, target_id, pred_id, n FROM x UNION ALL SELECT 'all', target_id, pred_id, n FROM x),
k AS (SELECT domain, CAST(range AS INT) AS class_id FROM range(1, 8), (SELECT DISTINCT domain FROM m)),
q AS (SELECT domain, class_id,
       coalesce((SELECT CAST(sum(n) AS BIGINT) FROM m WHERE m.domain = k.domain AND target_id = class_id AND pred_id = class_id), 0) AS tp,
       coalesce((SELECT CAST(sum(n) AS BIGINT) FROM m WHERE m.domain = k.domain AND target_id = class_id), 0) AS actual,
       coalesce((SELECT CAST(sum(n) AS BIGINT) FROM m WHERE m.domain = k.domain AND pred_id = class_id), 0) AS predicted FROM k),
c AS (SELECT *, tp / nullif(actual + predicted - tp, 0) AS iou, tp / nullif(predicted, 0) AS precision,
             tp / nullif(actual, 0) AS recall FROM q),
p AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM c)"""


@query("A-18 C-3 J-5", "label_pixels samples", f"WITH {_BY_DOMAIN} {_SUMMARY.format(by='domain,')} FROM p GROUP BY domain")
def domain_metrics(v):
    matrix = E.domain_confusion(E.confusion_by_sample(v.label_pixels), v.samples)
    return _rounded(E.metrics(matrix, ["domain"]), _SCALARS)


@query("A-19", "label_pixels samples", f"""
WITH {_BY_DOMAIN}, w AS ({_SUMMARY.format(by='domain,')} FROM p GROUP BY domain)
SELECT domain, metric, value FROM (SELECT domain, pixel_accuracy, mean_class_accuracy, mean_iou, frequency_weighted_iou,
  macro_precision, macro_recall, macro_f1, CAST(valid_pixels AS DOUBLE) AS valid_pixels, macro_dice FROM w)
UNPIVOT (value FOR metric IN (pixel_accuracy, mean_class_accuracy, mean_iou, frequency_weighted_iou, macro_precision,
  macro_recall, macro_f1, valid_pixels, macro_dice))""")
def flat_metrics(v):
    matrix = E.domain_confusion(E.confusion_by_sample(v.label_pixels), v.samples)
    return _rounded(E.flatten_metrics(E.metrics(matrix, ["domain"]), ["domain"]), ["value"])


@query("F-9 F-28", "label_pixels samples", """
SELECT s.sample_id, coalesce(p.target_id, 0) AS target_id,
       CASE WHEN p.target_id > 0 THEN p.target_id - 1 END AS internal_id, count(*) AS pixels
FROM samples s LEFT JOIN label_pixels p ON p.sample_id = s.sample_id AND s.split <> 'test' GROUP BY ALL""")
def internal_targets(v):
    labelled = v.samples.where("split <> 'test'").select("sample_id")
    counts = v.label_pixels.groupBy("sample_id", "target_id").agg(F.count("*").alias("pixels"))
    rows = v.samples.select("sample_id").join(counts.join(labelled, "sample_id", "left_semi"), "sample_id", "left")
    return rows.select(
        "sample_id", F.coalesce("target_id", F.lit(0)).alias("target_id"),
        internal_index(F.col("target_id")).alias("internal_id"), F.coalesce("pixels", F.lit(1)).alias("pixels"),
    )


@query("F-10 F-8", "dirty_pixels", """
SELECT 'target' AS side, target_id AS value, count(*) AS pixels FROM dirty_pixels WHERE target_id NOT BETWEEN 0 AND 7 GROUP BY 2
UNION ALL SELECT 'prediction', pred_id, count(*) FROM dirty_pixels WHERE pred_id NOT BETWEEN 1 AND 7 GROUP BY 2""")
def illegal_labels(v):
    return E.illegal_labels(v.dirty_pixels)


@query("L-4", "dirty_pixels", """
WITH o AS (SELECT DISTINCT 'target' AS side, target_id AS value FROM dirty_pixels WHERE target_id NOT BETWEEN 0 AND 7
           UNION SELECT DISTINCT 'prediction', pred_id FROM dirty_pixels WHERE pred_id NOT BETWEEN 1 AND 7),
r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY value) AS n FROM o)
SELECT side, string_agg(CAST(value AS VARCHAR), ', ' ORDER BY value) AS examples FROM r WHERE n <= 10 GROUP BY side""")
def offending_examples(v):
    return E.offending_examples(E.illegal_labels(v.dirty_pixels))


@query("U-3", "label_pixels", """
SELECT sample_id, count(*) AS pixels, avg(CASE WHEN target_id = pred_id THEN 1.0 ELSE 0.0 END)::DOUBLE >= 0.5 AS mostly_right
FROM label_pixels GROUP BY sample_id""")
def custom_metrics(v):
    hit = F.avg((F.col("target_id") == F.col("pred_id")).cast("double"))
    return grouped_metrics(v.label_pixels, {"pixels": F.count("*"), "mostly_right": hit >= 0.5}, ["sample_id"])


# ------------------------------------------------------------------ scores and losses

_PROBS = """
z AS (SELECT pixel_id, logits, target_id, list_max(logits) AS mx FROM logits),
e AS (SELECT *, list_transform(logits, lambda x: exp(x - mx)) AS ex FROM z),
p AS (SELECT pixel_id, target_id, logits, mx + ln(list_sum(ex)) AS lse, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM e),
t AS (SELECT *, lse - logits[target_id] AS nll FROM p WHERE target_id > 0)"""


@query("A-25 C-10", "logits", f"""
WITH {_PROBS}
SELECT pixel_id, target_id, list_position(p, list_max(p)) AS pred_id, round(list_max(p), 6) AS confidence FROM p""")
def argmax_predictions(v):
    rows = LO.predictions(v.logits)
    return _rounded(rows, ["confidence"]).drop("logits")


_WEIGHTS = """
n AS (SELECT target_id AS class_id, CAST(count(*) AS DOUBLE) AS n FROM label_pixels WHERE target_id > 0 GROUP BY 1),
w AS (SELECT class_id, 1.0::DOUBLE AS none, 1 / n AS inverse_frequency,
             (SELECT n FROM n ORDER BY n LIMIT 1 OFFSET 3) / n AS median_frequency,
             (1 - 0.9999::DOUBLE) / (1 - pow(0.9999::DOUBLE, n)) AS effective_number FROM n)"""


@query("A-14", "label_pixels", f"""
WITH {_WEIGHTS}
SELECT strategy, class_id, round(weight / avg(weight) OVER (PARTITION BY strategy), 6) AS weight
FROM w UNPIVOT (weight FOR strategy IN (none, inverse_frequency, median_frequency, effective_number))""")
def class_weights(v):
    counts = ST.class_totals(ST.sample_statistics(ST.sample_class_counts(v.label_pixels)))
    rows = None
    for strategy in LO.WEIGHTINGS:
        part = LO.class_weights(counts, strategy).select(F.lit(strategy).alias("strategy"), "class_id", "weight")
        rows = part if rows is None else rows.unionByName(part)
    return _rounded(rows, ["weight"])


_LOSS_TERMS = """
s AS (SELECT k, sum(p[k]) AS ps, sum(CASE WHEN target_id = k THEN p[k] ELSE 0 END) AS tp,
             count(*) FILTER (target_id = k) AS ts FROM t, (SELECT range AS k FROM range(1, 8)) GROUP BY k),
g AS (SELECT count(*) AS valid_pixels, avg(nll) AS cross_entropy, avg(pow(1 - exp(-nll), 2.0) * nll) AS focal FROM t),
h AS (SELECT avg(1 - (2 * tp + 1) / (ps + ts + 1)) AS dice,
             avg(1 - (tp + 1) / (tp + 0.5 * (ps - tp) + 0.5 * (ts - tp) + 1)) AS tversky FROM s WHERE ts > 0)"""


@query("A-26 A-27 A-28 A-29 C-10 C-11", "logits", f"""
WITH {_PROBS}, {_LOSS_TERMS}
SELECT valid_pixels, round(cross_entropy, 6) AS cross_entropy, round(dice, 6) AS dice, round(focal, 6) AS focal,
       round(tversky, 6) AS tversky FROM g, h""")
def loss_terms(v):
    return _rounded(LO.loss_terms(v.logits), ["cross_entropy", "dice", "focal", "tversky"])


@query("A-26 A-27 A-28 A-29 A-30 U-4", "logits label_pixels", f"""
WITH {_PROBS}, {_WEIGHTS}, cw AS (SELECT class_id, inverse_frequency / avg(inverse_frequency) OVER () AS w FROM w),
tw AS (SELECT t.*, w FROM t JOIN cw ON target_id = class_id),
s AS (SELECT k, any_value(w) AS w, sum(p[k]) AS ps, sum(CASE WHEN target_id = k THEN p[k] ELSE 0 END) AS tp,
             count(*) FILTER (target_id = k) AS ts FROM t, (SELECT class_id AS k, w FROM cw) GROUP BY k),
g AS (SELECT count(*) AS valid_pixels, sum(w * nll) / sum(w) AS ce, avg(w * pow(1 - exp(-nll), 2.0) * nll) AS fo FROM tw),
h AS (SELECT sum(w * (1 - (2 * tp + 1) / (ps + ts + 1))) / sum(w) AS di,
             sum(w * (1 - (tp + 1) / (tp + 0.5 * (ps - tp) + 0.5 * (ts - tp) + 1))) / sum(w) AS tv FROM s WHERE ts > 0)
SELECT name, valid_pixels, round(CASE name WHEN 'weighted_cross_entropy' THEN ce WHEN 'dice' THEN di WHEN 'ce_dice' THEN ce + di
  WHEN 'focal' THEN fo WHEN 'focal_dice' THEN fo + di WHEN 'tversky' THEN tv WHEN 'tversky_focal' THEN tv + fo ELSE ce END, 6) AS loss
FROM g, h, (SELECT unnest(['cross_entropy', 'weighted_cross_entropy', 'dice', 'ce_dice', 'focal', 'focal_dice', 'tversky', 'tversky_focal']) AS name)""")
def weighted_losses(v):
    counts = v.label_pixels.where("target_id > 0").groupBy(F.col("target_id").alias("class_id")).agg(
        F.count("*").alias("pixels")
    )
    weights = LO.weight_array(LO.class_weights(counts, "inverse_frequency"))
    # one scan feeds every loss: the terms are computed once and combined per name
    terms = LO.loss_terms(v.logits, weights=weights)
    named = F.array(
        *[F.struct(F.lit(n).alias("name"), build_loss(n).alias("loss")) for n in LO.LOSSES]
    )
    return _rounded(terms.select("valid_pixels", F.inline(named)).select("name", "valid_pixels", "loss"), ["loss"])


# ------------------------------------------------------------------ experiments


@query("W-4", "epoch_results", """
SELECT experiment_id, epoch, coalesce(max(loss) FILTER (phase = 'val'), max(loss) FILTER (phase = 'train')) AS metric
FROM epoch_results WHERE phase <> 'test' GROUP BY 1, 2""")
def monitor_values(v):
    results = v.epoch_results.where("phase <> 'test'").withColumn(
        "metrics", F.create_map().cast("map<string,double>")
    )
    return X.monitor_values(results)


@query("W-2", "epochs", """
SELECT *, coalesce(metric > previous_best, true) AS improved FROM (
  SELECT experiment_id, epoch, metric, samples,
         max(metric) OVER (PARTITION BY experiment_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_best
  FROM epochs) z""")
def epoch_improvements(v):
    return X.improvements(v.epochs, chunk=16)


_FOLD = """
o AS (SELECT experiment_id, epoch, metric FROM epochs),
f(experiment_id, epoch, best, best_epoch, streak, stopped) AS (
  SELECT experiment_id, epoch, metric, epoch, 0::BIGINT, NULL::BIGINT FROM o WHERE epoch = 0
  UNION ALL
  SELECT f.experiment_id, o.epoch, CASE WHEN o.metric > f.best + 0.05 THEN o.metric ELSE f.best END,
         CASE WHEN o.metric > f.best + 0.05 THEN o.epoch ELSE f.best_epoch END,
         CASE WHEN o.metric > f.best + 0.05 THEN 0 ELSE f.streak + 1 END,
         CASE WHEN NOT o.metric > f.best + 0.05 AND f.streak + 1 > 10 THEN o.epoch END
  FROM f JOIN o ON o.experiment_id = f.experiment_id AND o.epoch = f.epoch + 1 WHERE f.stopped IS NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY epoch DESC) AS n FROM f)"""


@query("W-2 W-3", "epochs", f"""
WITH RECURSIVE {_FOLD}
SELECT experiment_id, best_epoch, best AS best_metric, stopped AS stopped_epoch, epoch + 1 AS epochs_run FROM l WHERE n = 1""")
def early_stopping(v):
    return X.track_best(v.epochs, min_delta=0.05, patience=10)


@query("A-31", "epoch_results", """
SELECT experiment_id, epoch, phase, round(coalesce(sum(loss * samples) / nullif(sum(samples), 0), 0), 6) AS loss,
       CAST(sum(samples) AS BIGINT) AS samples FROM epoch_results GROUP BY 1, 2, 3""")
def epoch_losses(v):
    return _rounded(X.epoch_losses(v.epoch_results), ["loss"])


@query("A-32", "latencies", """
SELECT model_id, count(*) AS batches, round(avg(latency_ms), 6) AS mean_ms, round(4 / (avg(latency_ms) / 1000), 4) AS images_per_second,
       round(quantile_cont(latency_ms, 0.5), 6) AS median_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms
FROM latencies GROUP BY model_id""")
def latency_report(v):
    rows = X.latency_report(v.latencies, batch_size=4)
    return _rounded(_rounded(rows, ["mean_ms", "median_ms", "p95_ms"]), ["images_per_second"], 4)


@query("A-33", "epochs", """
WITH b AS (SELECT experiment_id AS model_id, metric AS best_metric, epoch AS best_epoch,
                  row_number() OVER (PARTITION BY experiment_id ORDER BY metric DESC, epoch) AS n FROM epochs)
SELECT model_id, best_metric, best_epoch, dense_rank() OVER (ORDER BY best_metric DESC) AS rank FROM b WHERE n = 1""")
def model_ranking(v):
    results = v.epochs.select(F.col("experiment_id").alias("model_id"), "epoch", "metric")
    return X.rank_models(X.best_results(results))


@query("F-17", "epoch_results", """
SELECT experiment_id, epoch, 'phase' AS problem FROM epoch_results WHERE phase NOT IN ('train', 'val')
UNION ALL SELECT experiment_id, epoch, 'samples' FROM epoch_results WHERE samples < 0""")
def epoch_problems(v):
    zero = F.lit(0)
    return X.epoch_problems(
        v.epoch_results.withColumns({c: zero for c in ("batches", "optimizer_steps", "global_step", "skipped_batches")})
    )


@query("F-18", "orders", """
SELECT o_orderkey AS checkpoint_id, concat_ws(',',
  CASE WHEN o_orderkey % 13 = 5 THEN 'missing_keys' END, CASE WHEN o_orderkey % 11 = 3 THEN 'schema_version' END,
  CASE WHEN o_custkey % 50 - 2 < 0 THEN 'epoch' END, CASE WHEN o_orderkey % 17 = 4 THEN 'best_metric' END,
  CASE WHEN o_orderstatus = 'P' THEN 'metric_name' END) AS errors FROM orders""")
def checkpoint_problems(v):
    key = F.col("o_orderkey")
    keys = F.array(*[F.lit(k) for k in X.CHECKPOINT_KEYS])
    metadata = v.orders.select(
        key.alias("checkpoint_id"),
        F.when(key % 13 == 5, F.slice(keys, 1, 10)).otherwise(keys).alias("keys"),
        F.when(key % 11 == 3, 2).otherwise(1).alias("schema_version"),
        (F.col("o_custkey") % 50 - 2).alias("epoch"),
        F.lit(0).alias("global_step"),
        F.when(key % 17 == 4, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("best_metric"),
        F.when(F.col("o_orderstatus") == "P", " ").otherwise("mean_iou").alias("metric_name"),
    )
    return X.checkpoint_problems(metadata).select("checkpoint_id", F.concat_ws(",", "errors").alias("errors"))


@query("S-12 C-13", "epochs", """
SELECT concat('{"epoch":', epoch, ',"experiment_id":', experiment_id, ',"score":',
  CASE WHEN samples = 3 THEN 'null' WHEN samples = 4 THEN 'null' ELSE concat(samples, '.5') END, '}') AS doc FROM epochs""")
def strict_history(v):
    n = F.col("samples")
    score = F.when(n == 3, F.lit(float("nan"))).when(n == 4, F.lit(float("-inf"))).otherwise(n + 0.5)
    return strict_json(v.epochs.select("experiment_id", "epoch", score.cast("double").alias("score")))
