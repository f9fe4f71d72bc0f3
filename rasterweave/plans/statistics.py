"""Queries for pixel statistics and sampling."""

from pyspark.sql import functions as F

from rasterweave.operators import sampling as SA
from rasterweave.operators import statistics as ST
from rasterweave.plans.registry import query
from rasterweave.sources.documents import strict_json

_COUNTS = ", ".join(f"count(*) FILTER (target_id = {c}) AS class_{c}" for c in range(1, 8))
_STATS = f"""
s AS (SELECT sample_id, count(*) AS total_pixels, count(*) FILTER (target_id = 0) AS ignored_pixels, {_COUNTS}
      FROM label_pixels GROUP BY sample_id)"""
_LONG = " UNION ALL ".join(
    f"SELECT {c} AS class_id, CAST(sum(class_{c}) AS BIGINT) AS pixels, count(*) FILTER (class_{c} > 0) AS samples FROM s"
    for c in range(1, 8)
)


def _stats(v):
    return ST.sample_statistics(ST.sample_class_counts(v.label_pixels))


@query("A-2 C-7", "label_pixels", f"""
WITH {_STATS}
SELECT *, total_pixels - ignored_pixels AS valid_pixels,
       round((total_pixels - ignored_pixels) / total_pixels, 6) AS valid_fraction,
       {" + ".join(f"CASE WHEN class_{c} > 0 THEN 1 ELSE 0 END" for c in range(1, 8))} AS classes_present FROM s""")
def sample_statistics(v):
    stats = _stats(v)
    return stats.withColumn("valid_fraction", F.round("valid_fraction", 6)).withColumn(
        "classes_present", F.size("present_classes")
    ).drop("present_classes")


@query("A-3", "label_pixels samples", f"""
WITH {_STATS}
SELECT (SELECT count(*) FROM samples) AS total_samples, count(*) AS labelled_samples,
       CAST(sum(total_pixels) AS BIGINT) AS total_pixels,
       CAST(sum(total_pixels - ignored_pixels) AS BIGINT) AS valid_pixels,
       CAST(sum(ignored_pixels) AS BIGINT) AS ignored_pixels
FROM s JOIN samples USING (sample_id) WHERE split <> 'test'""")
def dataset_totals(v):
    labelled = ST.with_samples(_stats(v), v.samples.where("split <> 'test'"))
    return ST.dataset_totals(v.samples, labelled)


@query("A-4 A-12", "label_pixels", f"""
WITH {_STATS}, l AS ({_LONG})
SELECT class_id, pixels, samples,
       round(pixels / (SELECT sum(total_pixels - ignored_pixels) FROM s), 6) AS pixel_frequency,
       round(samples / (SELECT count(*) FROM s), 6) AS sample_frequency FROM l""")
def class_frequencies(v):
    rows = ST.class_frequencies(_stats(v))
    return rows.withColumns({c: F.round(c, 6) for c in ("pixel_frequency", "sample_frequency")})


@query("A-13", "label_pixels samples", f"""
WITH {_STATS}
SELECT m.sample_id, split, domain, coalesce(total_pixels, 0) AS total_pixels, coalesce(ignored_pixels, 0) AS ignored_pixels,
       coalesce(class_1, 0) AS class_1, coalesce(class_7, 0) AS class_7,
       coalesce(total_pixels - ignored_pixels, 0) AS valid_pixels
FROM samples m LEFT JOIN s ON s.sample_id = m.sample_id AND m.split <> 'test'""")
def statistics_with_unlabelled(v):
    labelled = _stats(v).join(v.samples.where("split <> 'test'").select("sample_id"), "sample_id")
    rows = ST.with_samples(labelled, v.samples, include_unlabelled=True)
    return rows.select(
        "sample_id", "split", "domain", "total_pixels", "ignored_pixels", "class_1", "class_7", "valid_pixels"
    )


@query("J-10", "label_pixels samples", """
WITH c AS (SELECT sample_id, target_id AS class_id, count(*) AS pixels FROM label_pixels GROUP BY ALL)
SELECT s.sample_id, t.class_id, coalesce(c.pixels, 0) AS pixels
FROM samples s CROSS JOIN (SELECT CAST(range AS INT) AS class_id FROM range(1, 8)) t
LEFT JOIN c ON c.sample_id = s.sample_id AND c.class_id = t.class_id""")
def class_counts_zero_filled(v):
    return ST.zero_filled(ST.sample_class_counts(v.label_pixels), v.samples)


@query("S-13", "label_pixels samples", f"""
WITH {_STATS}, l AS ({_LONG}), t AS (
  SELECT (SELECT count(*) FROM samples) AS total_samples, count(*) AS labelled_samples,
         CAST(sum(total_pixels) AS BIGINT) AS total_pixels, CAST(sum(total_pixels - ignored_pixels) AS BIGINT) AS valid_pixels,
         CAST(sum(ignored_pixels) AS BIGINT) AS ignored_pixels FROM s)
SELECT concat('{{"class_pixel_counts":{{', (SELECT string_agg(concat('"', class_id, '":', pixels), ',' ORDER BY class_id) FROM l),
  '}},"class_sample_counts":{{', (SELECT string_agg(concat('"', class_id, '":', samples), ',' ORDER BY class_id) FROM l),
  '}},"ignored_pixels":', ignored_pixels, ',"labelled_samples":', labelled_samples, ',"total_pixels":', total_pixels,
  ',"total_samples":', total_samples, ',"valid_pixels":', valid_pixels, '}}') AS doc FROM t""")
def statistics_report(v):
    report = ST.statistics_report(v.samples, _stats(v))
    return strict_json(report.drop("class_pixel_frequencies", "class_sample_frequencies"))


@query("S-13 A-4", "label_pixels samples", f"""
WITH {_STATS}, l AS ({_LONG}), n AS (SELECT sum(total_pixels - ignored_pixels) AS valid, count(*) AS labelled FROM s)
SELECT class_id, CAST(pixels AS BIGINT) AS class_pixel_counts, CAST(samples AS BIGINT) AS class_sample_counts,
  round(pixels / valid, 9) AS class_pixel_frequencies, round(samples / labelled, 9) AS class_sample_frequencies FROM l, n""")
def statistics_report_maps(v):
    """The four maps of the written report, read back from its JSON text."""
    names = ["class_pixel_counts", "class_sample_counts", "class_pixel_frequencies", "class_sample_frequencies"]
    kinds = ["bigint", "bigint", "double", "double"]
    text = strict_json(ST.statistics_report(v.samples, _stats(v)))
    maps = text.select(F.from_json("doc", ", ".join(f"{n} map<string, {k}>" for n, k in zip(names, kinds))).alias("d"))
    rows = maps.select("d", F.explode(F.map_keys(F.col(f"d.{names[0]}"))).alias("k"))
    value = lambda n: F.element_at(F.col(f"d.{n}"), F.col("k"))
    return rows.select(
        F.col("k").cast("int").alias("class_id"), *[value(n).alias(n) for n in names[:2]], *[F.round(value(n), 9).alias(n) for n in names[2:]]
    )


# ------------------------------------------------------------------ weights

_RARITY = f"""{_STATS}, l AS ({_LONG}), r AS (
  SELECT class_id, CASE WHEN samples > 0 THEN pow((SELECT max(samples) FROM l) / samples, 0.5) ELSE 1.0 END AS w FROM l),
raw AS (SELECT sample_id, coalesce(({" + ".join(f"CASE WHEN class_{c} > 0 THEN (SELECT w FROM r WHERE class_id = {c}) ELSE 0 END" for c in range(1, 8))})
   / nullif({" + ".join(f"CASE WHEN class_{c} > 0 THEN 1 ELSE 0 END" for c in range(1, 8))}, 0), 1.0) AS cw FROM s),
d AS (SELECT domain, pow(max(count(*)) OVER () / count(*), 1.0) AS dw FROM samples GROUP BY domain)"""


@query("A-15 J-9 C-8", "label_pixels samples", f"""
WITH {_RARITY}, w AS (SELECT sample_id, least(greatest(cw * dw, 0.25), 4.0) AS w
  FROM raw JOIN samples USING (sample_id) JOIN d USING (domain))
SELECT sample_id, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w""")
def sampling_weights(v):
    rows = SA.sampling_weights(_stats(v), v.samples, "class_domain_balanced")
    return rows.withColumn("weight", F.round("weight", 6))


@query("A-15b", "label_pixels samples", f"""
WITH {_STATS}, l AS ({_LONG}), n AS (SELECT sum(total_pixels - ignored_pixels) AS n FROM s), r AS (
  SELECT class_id, CASE WHEN pixels > 0 THEN pow((SELECT n FROM n) / pixels, 0.5) END AS w FROM l),
raw AS (SELECT sample_id, coalesce(({" + ".join(f"CASE WHEN class_{c} > 0 THEN (SELECT w FROM r WHERE class_id = {c}) ELSE 0 END" for c in range(1, 8))})
   / nullif({" + ".join(f"CASE WHEN class_{c} > 0 THEN 1 ELSE 0 END" for c in range(1, 8))}, 0), 1.0) AS cw FROM s),
d AS (SELECT domain, (SELECT count(*) FROM samples) / count(*) AS dw FROM samples GROUP BY domain),
a AS (SELECT sample_id, least(greatest(cw * dw, 0.25), 4.0) AS w FROM raw JOIN samples USING (sample_id) JOIN d USING (domain)),
b AS (SELECT sample_id, least(greatest(w / (SELECT avg(w) FROM a), 0.25), 4.0) AS w FROM a)
SELECT sample_id, round(w / (SELECT avg(w) FROM b), 6) AS weight FROM b""")
def sampling_weights_by_pixels(v):
    rows = SA.sampling_weights(_stats(v), v.samples, "class_domain_balanced", variant="pixel_frequency")
    return rows.withColumn("weight", F.round("weight", 6))


@query("J-8", "label_pixels samples", """
SELECT sample_id FROM samples WHERE sample_id NOT IN (SELECT sample_id FROM label_pixels WHERE target_id > 5)""")
def samples_without_statistics(v):
    stats = _stats(v).where("class_6 + class_7 > 0")
    return SA.unmatched_samples(v.samples, stats)


def _simple_weights(v):
    return v.part.select(F.col("p_partkey").alias("sample_id"), (0.25 + F.col("p_size") / 16.0).alias("weight"))


_INTERVALS = """
w AS (SELECT p_partkey AS sample_id, CAST(round((0.25 + p_size / 16.0) * 1000000) AS BIGINT) AS u FROM part),
i AS (SELECT sample_id, CAST(sum(u) OVER (ORDER BY sample_id) - u AS BIGINT) AS lo,
             CAST(sum(u) OVER (ORDER BY sample_id) AS BIGINT) AS hi FROM w)"""


@query("L-5", "", f"WITH {_INTERVALS} SELECT sample_id, lo, hi FROM i")
def weight_intervals(v):
    return SA.weight_intervals(_simple_weights(v), chunk_size=256)


@query("L-5", "", f"""
WITH {_INTERVALS}, d AS (SELECT o_orderkey AS draw_id, (o_orderkey * 7919 * 104729) % (SELECT max(hi) FROM i) AS position FROM orders)
SELECT draw_id, position, sample_id FROM d JOIN i ON position >= lo AND position < hi""")
def draws_with_replacement(v):
    intervals = SA.weight_intervals(_simple_weights(v), chunk_size=256)
    total = intervals.agg(F.max("hi")).scalar()
    draws = v.orders.select(
        F.col("o_orderkey").alias("draw_id"), ((F.col("o_orderkey") * 7919 * 104729) % total).alias("position")
    )
    return SA.draw_with_replacement(intervals, draws, buckets=256)


@query("L-5", "", f"""
WITH {_INTERVALS}, d AS (SELECT range AS draw_id, (range * 7919 * 104729) % (SELECT max(hi) FROM i) AS position FROM range(1000))
SELECT draw_id, sample_id FROM d JOIN i ON position >= lo AND position < hi""")
def weighted_sample(v):
    """Draws at arithmetic positions, which both engines can name."""
    return SA.weighted_sample(v.spark, _simple_weights(v), 1000, seed=7, draw=F.col("draw_id") * 7919 * 104729)


@query("L-6", "samples", """
SELECT *, row_number() OVER (ORDER BY (sample_id * 7919 + 4242) % 10007, sample_id) - 1 AS position FROM samples""")
def uniform_permutation(v):
    """The order of an arithmetic draw, with gapless positions."""
    return SA.uniform_sample(v.samples, seed=7, draw=(F.col("sample_id") * 7919 + 4242) % 10007)


@query("L-7", "", """
SELECT p_partkey AS sample_id, 0.25 + p_size / 16.0 AS weight FROM part
ORDER BY -ln(((p_partkey * 7919) % 10007 + 0.5) / 10007) / (0.25 + p_size / 16.0), p_partkey LIMIT 100""")
def weighted_top(v):
    """The hundred of a weighted draw from arithmetic numbers between 0 and 1."""
    return SA.weighted_top(_simple_weights(v), 100, seed=7, draw=((F.col("sample_id") * 7919) % 10007 + 0.5) / 10007)


@query("L-8", "samples", """
SELECT * FROM (SELECT sample_id, split, domain, row_number() OVER (ORDER BY sample_id) - 1 AS "index",
       (row_number() OVER (ORDER BY sample_id) - 1) // 12 AS batch FROM samples) z
WHERE batch < (SELECT count(*) // 12 FROM samples)""")
def batches(v):
    return SA.batches(v.samples, 12, drop_last=True, chunk_size=128)
