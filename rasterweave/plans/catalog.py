"""Queries over the dataset catalogue and its validation."""

from pyspark.sql import functions as F

from rasterweave.operators import catalog as C
from rasterweave.operators import statistics as ST
from rasterweave.plans.registry import query
from rasterweave.taxonomy import class_colour, class_id_of, class_name, is_legal_mask_value, taxonomy

_TAXONOMY_SQL = """(VALUES (1, 'background', 255, 255, 255), (2, 'building', 255, 0, 0),
 (3, 'road', 255, 255, 0), (4, 'water', 0, 0, 255), (5, 'barren', 159, 129, 183),
 (6, 'forest', 0, 255, 0), (7, 'agriculture', 255, 195, 128)) AS t(class_id, name, r, g, b)"""


@query("S-1 C-1 C-2 J-1", "tree_files", """
WITH f AS (SELECT path, string_split(path, '/') AS p FROM tree_files),
g AS (SELECT path, lower(replace(p[3], 'Valid', 'val')) AS split, lower(p[4]) AS domain, p[5] AS kind, p[6] AS file,
             regexp_extract(p[6], '^(.*)\\.[^.]*$', 1) AS stem FROM f),
best AS (SELECT split, domain, min(CASE kind WHEN 'images_png' THEN 0 WHEN 'images' THEN 1 END) AS k
         FROM g WHERE kind IN ('images_png', 'images') GROUP BY 1, 2),
i AS (SELECT g.* FROM g JOIN best b ON g.split = b.split AND g.domain = b.domain
      WHERE kind = CASE b.k WHEN 0 THEN 'images_png' ELSE 'images' END),
m AS (SELECT * FROM g WHERE kind = 'masks_png')
SELECT concat_ws('-', i.split, i.domain, i.stem) AS sample_id, i.split, i.domain, i.path AS image_path,
       (SELECT m.path FROM m WHERE m.split = i.split AND m.domain = i.domain AND m.stem = i.stem
        ORDER BY CASE WHEN m.file = i.file THEN 0 ELSE 1 END, m.path LIMIT 1) AS mask_path
FROM i""")
def manifest_scan(v):
    return C.scan_paths(v.tree_files, "/data")


@query("F-1", "manifest", "SELECT * FROM manifest WHERE split = 'train' AND domain = 'urban'")
def manifest_filter(v):
    return C.filter_manifest(v.manifest, split="train", domain="urban")


@query("F-2", "manifest", """
SELECT sample_id, split, domain, image_path FROM manifest WHERE mask_path IS NULL AND split <> 'test'""")
def manifest_missing_labels(v):
    return C.missing_labels(v.manifest).drop("mask_path")


@query("A-1", "manifest", """
SELECT 'total' AS level, 'all' AS name, count(*) AS samples, count(*) - count(mask_path) AS missing_masks FROM manifest
UNION ALL SELECT 'split', split, count(*), count(*) - count(mask_path) FROM manifest GROUP BY split
UNION ALL SELECT 'domain', domain, count(*), count(*) - count(mask_path) FROM manifest GROUP BY domain""")
def manifest_stats(v):
    return C.manifest_stats(v.manifest)


@query("L-1 L-3 F-29", "manifest", """
SELECT sample_id, split, domain, image_path FROM manifest
ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END,
         CASE domain WHEN 'urban' THEN 0 ELSE 1 END, image_path LIMIT 20""")
def manifest_first_samples(v):
    from rasterweave.operators.sampling import first_samples

    return first_samples(v.manifest, 20, C.manifest_order()).drop("mask_path")


@query("X-2", "tree_files", """
SELECT split, domain, stem, count(*) AS "rows" FROM (
  SELECT lower(replace(string_split(path, '/')[3], 'Valid', 'val')) AS split,
         lower(string_split(path, '/')[4]) AS domain,
         regexp_extract(path, '([^/]*)\\.[^.]*$', 1) AS stem FROM tree_files) z
GROUP BY ALL HAVING count(*) > 1""")
def manifest_duplicate_stems(v):
    return C.duplicate_keys(C.parse_paths(v.tree_files, "/data"), ["split", "domain", "stem"])


@query("F-12 X-3", "dimensions dirty_pixels", """
SELECT sample_id, printf('image/mask size mismatch: (%d, %d) vs (%d, %d)', image_width, image_height, mask_width, mask_height) AS problem
FROM dimensions WHERE image_width <> mask_width OR image_height <> mask_height
UNION ALL
SELECT sample_id, concat('invalid mask pixel values: [', string_agg(CAST(value AS VARCHAR), ', ' ORDER BY value), ']')
FROM (SELECT DISTINCT sample_id, target_id AS value FROM dirty_pixels WHERE target_id NOT BETWEEN 0 AND 7) d
GROUP BY sample_id""")
def manifest_issues(v):
    return C.validate(v.manifest, v.dimensions, v.dirty_pixels)


@query("A-8", "dirty_pixels", """
SELECT target_id AS class_id, count(*) AS pixels,
       round(100.0 * count(*) / (SELECT count(*) FROM dirty_pixels WHERE target_id <> 0), 6) AS percent
FROM dirty_pixels WHERE target_id <> 0 GROUP BY target_id""")
def validation_histogram(v):
    return C.class_histogram(v.dirty_pixels).withColumn("percent", F.round(F.col("percent"), 6))


@query("F-5 C-15", "dirty_pixels", """
SELECT target_id, target_id BETWEEN 0 AND 7 AS legal, count(*) AS pixels FROM dirty_pixels GROUP BY ALL""")
def legal_mask_values(v):
    rows = v.dirty_pixels.select("target_id", is_legal_mask_value(F.col("target_id")).alias("legal"))
    return rows.groupBy("target_id", "legal").agg(F.count("*").alias("pixels"))


@query("F-8", "dirty_pixels", """
SELECT target_id AS value, count(*) AS pixels FROM dirty_pixels WHERE target_id NOT BETWEEN 0 AND 7 GROUP BY 1""")
def unknown_labels(v):
    return ST.unknown_labels(v.dirty_pixels)


@query("F-11", "label_pixels", f"""
SELECT t.class_id, t.name, t.r, t.g, t.b, count(*) AS pixels
FROM label_pixels l JOIN {_TAXONOMY_SQL} ON l.target_id = t.class_id GROUP BY ALL""")
def taxonomy_pixels(v):
    counts = v.label_pixels.groupBy(F.col("target_id").alias("class_id")).agg(F.count("*").alias("pixels"))
    return counts.join(F.broadcast(taxonomy(v.spark)), "class_id").select(
        "class_id", "name", "r", "g", "b", "pixels"
    )


@query("F-11 C-12", "label_pixels", f"""
SELECT l.target_id, coalesce(t.name, CAST(l.target_id AS VARCHAR)) AS name, t.r AS red, t.class_id AS back, count(*) AS pixels
FROM label_pixels l LEFT JOIN {_TAXONOMY_SQL} ON l.target_id = t.class_id GROUP BY ALL""")
def taxonomy_lookup(v):
    label = F.col("target_id")
    rows = v.label_pixels.select(
        label, class_name(label).alias("name"), class_colour(label)["r"].alias("red"),
        class_id_of(class_name(label)).alias("back"),
    )
    return rows.groupBy("target_id", "name", "red", "back").agg(F.count("*").alias("pixels"))
