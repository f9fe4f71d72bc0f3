"""Relational views that give the supplied tables a raster, label and job-log reading.

Each view is one SELECT written once. ``{div}``, ``{k}`` and ``{logits}`` stand for the three
places where Spark and DuckDB spell the same thing differently. On Spark the views are lazy
DataFrames; for DuckDB they become the WITH clause of a check query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_TOKENS = {
    "spark": {
        "{div}": "DIV",
        "{k}": "CAST(get_json_object(props, '$.k') AS INT)",
        "{logits}": "transform(slice(embedding, 1, 7), x -> CAST(x AS DOUBLE))",
        "{str}": "STRING",
    },
    "duckdb": {
        "{div}": "//",
        "{k}": "CAST(json_extract(props, '$.k') AS INT)",
        "{logits}": "CAST(embedding[1:7] AS DOUBLE[])",
        "{str}": "VARCHAR",
    },
}

_BASE = "1 + ((row_idx {div} 5) * 3 + col_idx {div} 7) % 7"

# name -> (inputs, text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    # dense 50 x 50 scenes at two dates, about five percent without data
    "grid": (
        ("events",),
        f"""
SELECT scene_id, row_idx, col_idx,
       CAST(CASE WHEN k < 5 THEN 0 ELSE {_BASE} END AS INT) AS before_id,
       CAST(CASE WHEN k < 5 THEN 0 WHEN k < 20 THEN 1 + k % 7 ELSE {_BASE} END AS INT) AS after_id,
       value / (1.0 + value) AS confidence, ts
FROM (SELECT event_id {{div}} 2500 AS scene_id, (event_id % 2500) {{div}} 50 AS row_idx,
             event_id % 50 AS col_idx, {{k}} AS k, value, ts
      FROM events) e""",
    ),
    "samples": (
        ("part",),
        """
SELECT p_partkey AS sample_id,
       CASE WHEN p_size % 5 < 3 THEN 'train' WHEN p_size % 5 = 3 THEN 'val' ELSE 'test' END AS split,
       CASE WHEN p_partkey % 3 = 0 THEN 'rural' ELSE 'urban' END AS domain
FROM part""",
    ),
    # one labelled and predicted pixel per row, not unique per position
    "label_pixels": (
        ("lineitem",),
        """
SELECT l_partkey AS sample_id,
       CAST(CASE WHEN l_quantity <= 2 THEN 0 ELSE l_linenumber END AS INT) AS target_id,
       CAST(CASE WHEN l_tax < 0.03 THEN 1 + (l_linenumber + CAST(l_quantity AS INT)) % 7
            ELSE l_linenumber END AS INT) AS pred_id
FROM lineitem""",
    ),
    # the same pixels with some labels outside the taxonomy
    "dirty_pixels": (
        ("lineitem",),
        """
SELECT l_partkey AS sample_id,
       CAST((CASE WHEN l_quantity <= 2 THEN 0 ELSE l_linenumber END)
            + CASE WHEN l_orderkey % 500 = 0 THEN 92 ELSE 0 END AS INT) AS target_id,
       CAST(CASE WHEN l_tax < 0.03 THEN (l_linenumber + CAST(l_quantity AS INT)) % 8
            ELSE l_linenumber END AS INT) AS pred_id
FROM lineitem""",
    ),
    "logits": (
        ("embeddings",),
        """
SELECT vec_id AS pixel_id, {logits} AS logits, CAST(label % 8 AS INT) AS target_id
FROM embeddings""",
    ),
    "paths": (
        ("samples",),
        """
SELECT sample_id, concat('/data/',
         CASE split WHEN 'train' THEN 'Train' WHEN 'val' THEN 'Valid' ELSE 'test' END, '/',
         CASE domain WHEN 'urban' THEN 'Urban' ELSE 'rural' END, '/',
         CASE WHEN sample_id % 2 = 0 THEN 'images_png' ELSE 'images' END, '/',
         CAST(sample_id AS {str}), CASE WHEN sample_id % 4 = 0 THEN '.tif' ELSE '.PNG' END) AS path
FROM samples""",
    ),
    # 16-pixel tiles with overlap 4 (starts 0, 12, 24, 34 on 50): up to four rows per pixel
    "tile_preds": (
        ("grid",),
        """
SELECT g.scene_id, g.row_idx, g.col_idx, t.tr, u.tc, t.tr * 4 + u.tc AS tile_ord,
       CAST(1 + (g.after_id + t.tr + u.tc) % 7 AS INT) AS pred_id,
       CASE WHEN g.row_idx = 7 AND t.tr = 0 THEN CAST('NaN' AS DOUBLE)
            ELSE g.confidence * (1.0 - 0.05 * ((t.tr + u.tc) % 3)) END AS conf
FROM grid g
JOIN (VALUES (0, 0), (1, 12), (2, 24), (3, 34)) AS t(tr, y0)
  ON g.row_idx >= t.y0 AND g.row_idx < t.y0 + 16
JOIN (VALUES (0, 0), (1, 12), (2, 24), (3, 34)) AS u(tc, x0)
  ON g.col_idx >= u.x0 AND g.col_idx < u.x0 + 16""",
    ),
    # right triangles (x0, y0) (x0 + w, y0) (x0, y0 + w) in pixel units of one scene
    "aois": (
        ("supplier",),
        """
SELECT s_suppkey AS aoi_id, s_suppkey % 4 AS scene_id, CAST((s_suppkey * 7) % 40 AS DOUBLE) AS x0,
       CAST((s_suppkey * 11) % 40 AS DOUBLE) AS y0, CAST(5 + s_nationkey % 10 AS DOUBLE) AS w
FROM supplier""",
    ),
    # eight attempted transitions per job, some illegal, some after a terminal state
    "job_events": (
        ("events",),
        """
SELECT job_id, seq, ts,
       CASE WHEN k < 4 THEN 'failed' WHEN k < 7 THEN 'cancelled'
            WHEN seq = 0 THEN 'queued' WHEN seq IN (1, 7) THEN 'preparing'
            WHEN seq = 2 THEN 'fetching_imagery' WHEN seq = 3 THEN 'tiling'
            WHEN seq = 4 THEN 'inference' WHEN seq = 5 THEN 'postprocessing'
            ELSE 'completed' END AS to_state
FROM (SELECT event_id {div} 8 AS job_id, event_id % 8 AS seq, {k} AS k,
             CASE WHEN event_id % 29 = 0 THEN ts - INTERVAL 2 HOUR ELSE ts END AS ts
      FROM events) e""",
    ),
    "job_updates": (
        ("events",),
        """
SELECT event_id AS arrival, user_id AS job_id, {k} % 5 AS expected_revision,
       user_id % 5 AS stored_revision
FROM events""",
    ),
    # fifty epochs per experiment
    "epochs": (
        ("orders",),
        """
SELECT o_orderkey {div} 50 AS experiment_id, o_orderkey % 50 AS epoch,
       o_totalprice / 1000000.0 AS metric, 1 + o_custkey % 7 AS samples
FROM orders""",
    ),
    # image files plus masks: some exact, some with another suffix, some missing
    "tree_files": (
        ("paths", "samples"),
        """
SELECT path FROM paths
UNION ALL
SELECT concat('/data/',
         CASE split WHEN 'train' THEN 'Train' WHEN 'val' THEN 'Valid' ELSE 'test' END, '/',
         CASE domain WHEN 'urban' THEN 'Urban' ELSE 'rural' END, '/masks_png/',
         CAST(sample_id AS {str}), CASE WHEN sample_id % 7 = 3 THEN '_draft' ELSE '' END,
         CASE WHEN sample_id % 4 = 0 THEN '.tif' ELSE '.jpg' END) AS path
FROM samples
UNION ALL
SELECT concat('/data/',
         CASE split WHEN 'train' THEN 'Train' WHEN 'val' THEN 'Valid' ELSE 'test' END, '/',
         CASE domain WHEN 'urban' THEN 'Urban' ELSE 'rural' END, '/masks_png/',
         CAST(sample_id AS {str}), CASE WHEN sample_id % 3 = 1 THEN '' ELSE '_old' END, '.bmp') AS path
FROM samples""",
    ),
    "manifest": (
        ("samples", "paths"),
        """
SELECT s.sample_id, s.split, s.domain, p.path AS image_path,
       CASE WHEN s.split = 'test' OR s.sample_id % 50 = 7 THEN NULL
            ELSE replace(p.path, 'images', 'masks') END AS mask_path
FROM samples s JOIN paths p ON s.sample_id = p.sample_id""",
    ),
    "dimensions": (
        ("part",),
        """
SELECT p_partkey AS sample_id, p_size AS image_width, p_size AS image_height,
       CAST(p_size - CASE WHEN p_partkey % 50 = 0 THEN 1 ELSE 0 END AS INT) AS mask_width,
       p_size AS mask_height
FROM part""",
    ),
    # projected rasters on a loose grid; every tenth is geographic
    "rasters": (
        ("supplier",),
        """
SELECT s_suppkey AS scene_id, CAST(40 + s_nationkey * 3 AS INT) AS width,
       CAST(30 + s_nationkey * 2 AS INT) AS height,
       CASE WHEN s_suppkey % 10 = 9 THEN 'EPSG:4326' ELSE 'EPSG:3857' END AS crs,
       CAST(CASE WHEN s_suppkey % 10 = 9 THEN 0.0001 ELSE 10 END AS DOUBLE) AS a,
       CAST(CASE WHEN s_suppkey % 10 = 9 THEN 77 + s_suppkey % 7 ELSE 500000 + (s_suppkey % 20) * 500 END AS DOUBLE) AS c,
       CAST(CASE WHEN s_suppkey % 10 = 9 THEN -0.0001 ELSE -10 END AS DOUBLE) AS e,
       CAST(CASE WHEN s_suppkey % 10 = 9 THEN 28 + s_suppkey % 5 ELSE 3100000 - (s_suppkey % 17) * 400 END AS DOUBLE) AS f
FROM supplier""",
    ),
    # rasters of 100 x 100 pixels in the UTM zones around the central meridians, pixels of 1 m to 16 km
    "zone_rasters": (
        ("supplier",),
        """
SELECT s_suppkey AS scene_id, CASE WHEN s_suppkey % 3 = 0 THEN 32700 ELSE 32600 END + 1 + (s_suppkey * 7) % 60 AS epsg,
       CAST(1 << CAST(s_suppkey % 15 AS INT) AS DOUBLE) AS size,
       CAST(500000 - (1 << CAST(s_suppkey % 15 AS INT)) * (20 + s_suppkey % 60) AS DOUBLE) AS c,
       CAST(CASE WHEN s_suppkey % 3 = 0 THEN 10000000 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE 1 END * (s_suppkey * 331) % 7000 * 1000 AS DOUBLE) AS f
FROM supplier""",
    ),
    # triangles in spherical Mercator metres
    "areas": (
        ("customer",),
        """
SELECT c_custkey AS aoi_id,
       CAST(500000 + (c_custkey * 137) % 12000 AS DOUBLE) AS x0,
       CAST(3092000 + (c_custkey * 211) % 9000 AS DOUBLE) AS y0,
       CAST(50 + c_nationkey * 40 AS DOUBLE) AS w
FROM customer""",
    ),
    # small triangles in degrees all over the inhabited latitudes
    "geo_areas": (
        ("customer",),
        """
SELECT c_custkey AS aoi_id,
       CAST(-179 + (c_custkey * 37) % 358 AS DOUBLE) AS x0,
       CAST(-70 + (c_custkey * 17) % 140 AS DOUBLE) AS y0,
       CAST(1 + c_nationkey AS DOUBLE) / 1000 AS w
FROM customer""",
    ),
    # stored jobs, one per event, most of them with one defect
    "job_docs": (
        ("events",),
        """
SELECT event_id AS doc_id,
       CASE WHEN d = 13 THEN '[1]' ELSE concat('{"job_id":"', CASE WHEN d = 2 THEN 'not-a-uuid' ELSE
         concat('00000000-0000-4000-8000-', lpad(CAST(event_id AS {str}), 12, '0')) END,
         '","state":"', CASE WHEN d = 3 THEN 'paused' WHEN d = 9 THEN 'failed' ELSE state END,
         '","created_at":"2026-01-01T12:', mm, CASE WHEN d = 4 THEN ':00' ELSE ':00+00:00' END,
         '","updated_at":"2026-01-01T13:', mm, ':00Z","request":', CASE d
           WHEN 11 THEN '{"imagery_source":{}}' WHEN 14 THEN '{"aoi":{},"imagery_source":{},"metadata":"x"}'
           ELSE '{"aoi":{"type":"Polygon"},"imagery_source":{"path":"/x"},"metadata":null}' END,
         CASE d WHEN 1 THEN '' WHEN 5 THEN ',"revision":true' WHEN 6 THEN ',"revision":-1'
           WHEN 10 THEN ',"revision":77' WHEN 16 THEN ',"revision":1.5'
           ELSE concat(',"revision":', CAST(m AS {str})) END,
         ',"transitions":[', CASE WHEN d = 7 THEN '' ELSE concat(
           '{"from_state":', CASE WHEN d = 8 THEN '"queued"' ELSE 'null' END, ',"to_state":"queued",',
           '"timestamp":"2026-01-01T12:00:00', CASE WHEN d = 12 THEN '' ELSE '+00:00' END, '","reason":"job_created"}',
           CASE WHEN m >= 1 THEN concat(',{"from_state":"queued","to_state":"',
             CASE WHEN d = 15 THEN 'resting' ELSE 'preparing' END,
             '","timestamp":"2026-01-01T12:01:00+00:00","reason":null}') ELSE '' END,
           CASE WHEN m >= 2 THEN ',{"from_state":"preparing","to_state":"fetching_imagery","timestamp":"2026-01-01T12:02:00+00:00","reason":null}' ELSE '' END)
         END, ']}') END AS doc
FROM (SELECT event_id, {k} % 3 AS m, event_id % 19 AS d, lpad(CAST(event_id % 60 AS {str}), 2, '0') AS mm,
             CASE {k} % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'preparing' ELSE 'fetching_imagery' END AS state
      FROM events) e""",
    ),
    "payloads": (
        ("events",),
        """
SELECT event_id AS doc_id, CASE event_id % 8
    WHEN 0 THEN '{"aoi":{"type":"Polygon"},"imagery_source":{"path":"/x"}}'
    WHEN 1 THEN '{"aoi":[],"imagery_source":{}}'
    WHEN 2 THEN '{"aoi":{},"imagery_source":"x"}'
    WHEN 3 THEN '{"aoi":{}}'
    WHEN 4 THEN '"text"'
    WHEN 5 THEN '{"aoi":{},"imagery_source":{},"metadata":5}'
    WHEN 6 THEN '{"aoi":{},"imagery_source":{},"metadata":{"k":1}}'
    ELSE concat('{"imagery_source":{},"extra":', CAST({k} AS {str}), '}') END AS payload
FROM events""",
    ),
    # two phases per epoch, val missing in some; some results break a rule
    "epoch_results": (
        ("orders",),
        """
SELECT o_orderkey {div} 100 AS experiment_id, (o_orderkey % 100) {div} 2 AS epoch,
       CASE WHEN o_orderkey % 97 = 0 THEN 'test' WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'val' END AS phase,
       o_totalprice / 10000.0 AS loss, o_custkey % 7 - CASE WHEN o_orderkey % 89 = 0 THEN 9 ELSE 0 END AS samples
FROM orders""",
    ),
    "latencies": (("events",), "SELECT event_type AS model_id, value AS latency_ms FROM events"),
}


def _closure(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for dependency in VIEWS[name][0]:
                visit(dependency)
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def _text(name: str, dialect: str) -> str:
    text = VIEWS[name][1].strip()
    for token, value in _TOKENS[dialect].items():
        text = text.replace(token, value)
    return text


def check_sql(body: str, views: tuple[str, ...]) -> str:
    """The DuckDB text of a check: view definitions followed by ``body``."""
    parts = [f"{name} AS (\n{_text(name, 'duckdb')}\n)" for name in _closure(views)]
    body = body.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return "WITH RECURSIVE " + ",\n".join([*parts, body[len(head):]])
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


class Views:
    """Tables of one folder and the views over them, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self._load(name)
        return self._cache[name]

    def _load(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        inputs, _ = VIEWS[name]
        # keep literal braces away from the placeholder syntax
        text = _text(name, "spark").replace("{", "{{").replace("}", "}}")
        for source in inputs:
            for word in ("FROM", "JOIN"):
                text = text.replace(f"{word} {source}", f"{word} {{{source}}}")
        return self.spark.sql(text, **{source: getattr(self, source) for source in inputs})
