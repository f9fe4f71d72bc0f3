"""Connected regions of equal class (4-neighbourhood), their measures and their outlines.

A region may span any number of blocks, so it is never gathered. Labelling runs inside blocks,
then neighbouring blocks are merged two by two along each axis until one block covers the scene.
Each merge step looks only at the pixels on block borders, so the work of a task grows with the
side of a scene, not with its area. Measures are plain aggregates over labelled pixels.

A region's id is the position ``row * STRIDE + col`` of its first pixel in row-major order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.functions import affine
from rasterweave.functions import geometry as G
from rasterweave.operators.rasters import BLOCK_KEY, to_blocks
from rasterweave.session import checkpoint

STRIDE = 1 << 31
NO_LABEL = -1
_GEOMETRY = "scene_id BIGINT, block_row INT, block_col INT, y_off INT, x_off INT, height INT, width INT"


def _smallest_in_group(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node it is connected to by the edges ``u - v``."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        open_edges = label[u] != label[v]
        u, v = u[open_edges], v[open_edges]
    return label


def _label_block(classes: np.ndarray, ignore_ids: Sequence[int]) -> np.ndarray:
    """Index of the first cell of each cell's region, -1 for ignored cells."""
    height, width = classes.shape
    cell = np.arange(height * width).reshape(height, width)
    live = ~np.isin(classes, list(ignore_ids))
    across = (classes[:, 1:] == classes[:, :-1]) & live[:, 1:]
    down = (classes[1:] == classes[:-1]) & live[1:]
    u = np.concatenate([cell[:, :-1][across], cell[:-1][down]])
    v = np.concatenate([cell[:, 1:][across], cell[1:][down]])
    label = _smallest_in_group(height * width, u, v)
    return np.where(live.ravel(), label, NO_LABEL)


def label_blocks(blocks: DataFrame, value: str = "class_id", ignore_ids: Sequence[int] = (0,), keep: Sequence[str] = ()) -> DataFrame:
    """Add ``labels`` (region ids valid within the block) to block rows. No shuffle."""
    ignore = tuple(ignore_ids)
    fields = "".join(f", {c} {blocks.schema[c].dataType.simpleString()}" for c in keep)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            labels = []
            for y, x, h, w, cells in zip(part.y_off, part.x_off, part.height, part.width, part[value]):
                classes = np.array([ignore[0] if c is None else c for c in cells]) if any(
                    c is None for c in cells
                ) else np.asarray(cells)
                classes = np.where(pd.isna(classes), ignore[0] if ignore else NO_LABEL, classes).astype(np.int64)
                local = _label_block(classes.reshape(h, w), ignore)
                code = (y + local // w) * STRIDE + x + local % w
                labels.append(np.where(local < 0, NO_LABEL, code))
            yield part.assign(labels=labels)

    columns = [*BLOCK_KEY, "y_off", "x_off", "height", "width", value, *keep]
    kind = blocks.schema[value].dataType.simpleString()
    schema = f"{_GEOMETRY}, {value} {kind}{fields}, labels ARRAY<BIGINT>"
    return blocks.select(*columns).mapInPandas(run, schema)


def _border_pixels(labelled: DataFrame, value: str) -> DataFrame:
    """Labelled pixels on the rim of each block, with their class."""
    h, w = F.col("height"), F.col("width")
    every_col, every_row = F.sequence(F.lit(0), w - 1), F.sequence(F.lit(0), h - 1)
    rim = F.array_distinct(
        F.concat(
            every_col,
            F.transform(every_col, lambda i: (h - 1) * w + i),
            F.transform(every_row, lambda i: i * w),
            F.transform(every_row, lambda i: i * w + w - 1),
        )
    )
    cells = F.transform(
        rim,
        lambda i: F.struct(
            (F.col("y_off") + F.floor(i / w)).cast("long").alias("row_idx"),
            (F.col("x_off") + i % w).cast("long").alias("col_idx"),
            F.get(F.col(value), i).cast("int").alias("class_id"),
            F.get(F.col("labels"), i).alias("label"),
        ),
    )
    return labelled.select("scene_id", F.inline(F.filter(cells, lambda c: c["label"] >= 0)))


_MERGE_SCHEMA = (
    "scene_id BIGINT, row_idx BIGINT, col_idx BIGINT, class_id INT, label BIGINT, merged BIGINT"
)


def _merge_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Connect the rim pixels of neighbouring blocks and rename their regions."""
    place = (pdf.row_idx * STRIDE + pdf.col_idx).to_numpy()
    order = np.argsort(place)
    pdf, place = pdf.iloc[order], place[order]
    names, node = np.unique(pdf.label.to_numpy(), return_inverse=True)
    kind = pdf.class_id.to_numpy()
    u, v = [], []
    for step in (1, STRIDE):
        near = np.minimum(np.searchsorted(place, place + step), len(place) - 1)
        touch = (place[near] == place + step) & (kind[near] == kind)
        u.append(node[touch])
        v.append(node[near[touch]])
    # names are sorted, so the smallest node carries the smallest region id
    joined = _smallest_in_group(len(names), np.concatenate(u), np.concatenate(v))
    return pdf.assign(merged=names[joined[node]])[
        ["scene_id", "row_idx", "col_idx", "class_id", "label", "merged"]
    ]


def merge_levels(side: int, block: int) -> int:
    """Merge steps until one super-block covers ``side`` pixels."""
    return max(0, math.ceil(math.log2(max(side, 1) / block)))


def longest_side(blocks: DataFrame) -> int:
    """Rows or columns up to the end of the farthest block of any scene."""
    ends = F.greatest(F.col("y_off") + F.col("height"), F.col("x_off") + F.col("width"))
    return blocks.agg(F.max(ends)).first()[0] or 0


def region_names(labelled: DataFrame, value: str, block: int) -> DataFrame:
    """``scene_id, label, region``: final ids of the block-local regions that change their id.

    Steps go on until one super-block covers the longest scene side in the data. Step ``k`` groups by super-blocks of ``block * 2**k``
    pixels and keeps only their rim; every step is checkpointed because its result is read twice.
    """
    rim = _border_pixels(labelled, value)
    side, steps = longest_side(labelled), []
    for level in range(1, merge_levels(side, block) + 1):
        span = block << level
        keyed = rim.withColumns(
            {"_sr": F.floor(F.col("row_idx") / span), "_sc": F.floor(F.col("col_idx") / span)}
        )
        merged = checkpoint(
            keyed.groupBy("scene_id", "_sr", "_sc").applyInPandas(
                lambda pdf: _merge_group(pdf), _MERGE_SCHEMA
            )
        )
        steps.append(merged.where("label <> merged").select("scene_id", "label", "merged").distinct())
        on_rim = (
            (F.col("row_idx") % span).isin(0, span - 1) | (F.col("col_idx") % span).isin(0, span - 1)
        )
        rim = merged.where(on_rim).select(
            "scene_id", "row_idx", "col_idx", "class_id", F.col("merged").alias("label")
        )
    if not steps:
        return labelled.sparkSession.createDataFrame([], "scene_id BIGINT, label BIGINT, region BIGINT")
    names = steps[-1].withColumnRenamed("merged", "region")
    for step in reversed(steps[:-1]):
        later = names.select("scene_id", F.col("label").alias("merged"), F.col("region").alias("_final"))
        renamed = step.join(later, ["scene_id", "merged"], "left").select(
            "scene_id", "label", F.coalesce("_final", "merged").alias("region")
        )
        names = renamed.unionByName(names)
    return names


def label_regions(
    blocks: DataFrame,
    block: int,
    value: str = "class_id",
    ignore_ids: Sequence[int] = (0,),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Block rows with scene-wide region ids in ``labels`` (-1 for ignored pixels).

    ``keep`` names further block arrays to carry along, such as confidence.
    """
    # read by the merge below and by every later measure, so labelling runs once
    labelled = checkpoint(label_blocks(blocks, value, ignore_ids, keep))
    names = region_names(labelled, value, block)
    # a local id names a pixel of its own block, so renames are grouped per block: a handful each
    per_block = names.groupBy(
        "scene_id",
        F.floor(F.floor(F.col("label") / STRIDE) / block).cast("int").alias("block_row"),
        F.floor((F.col("label") % STRIDE) / block).cast("int").alias("block_col"),
    ).agg(F.map_from_entries(F.collect_list(F.struct("label", "region"))).alias("_names"))
    renamed = F.transform("labels", lambda l: F.coalesce(F.try_element_at("_names", l), l))
    joined = labelled.join(per_block, list(BLOCK_KEY), "left")
    return joined.select(
        *[
            F.when(F.col("_names").isNull(), F.col("labels")).otherwise(renamed).alias(c) if c == "labels" else c
            for c in labelled.columns
        ]
    )


def regions_of_pixels(
    pixels: DataFrame,
    block: int = 256,
    value: str = "class_id",
    ignore_ids: Sequence[int] = (0,),
    keep: Sequence[str] = (),
) -> DataFrame:
    """As :func:`label_regions` for a pixel table: adds ``region_id``, drops ignored pixels."""
    blocks = to_blocks(pixels, [value, *keep], block)
    return region_pixels(label_regions(blocks, block, value, ignore_ids, keep), value, keep)


def region_pixels(labelled: DataFrame, value: str = "class_id", keep: Sequence[str] = ()) -> DataFrame:
    """One row per labelled pixel."""
    zipped = F.arrays_zip(F.col("labels"), F.col(value), *[F.col(k) for k in keep])
    rows = labelled.select("scene_id", "y_off", "x_off", "width", F.posexplode(zipped).alias("_at", "_v"))
    return rows.where(F.col("_v.labels") >= 0).select(
        "scene_id",
        (F.col("y_off") + F.floor(F.col("_at") / F.col("width"))).cast("long").alias("row_idx"),
        (F.col("x_off") + F.col("_at") % F.col("width")).cast("long").alias("col_idx"),
        F.col("_v.labels").alias("region_id"),
        F.col(f"_v.{value}").alias(value),
        *[F.col(f"_v.{k}").alias(k) for k in keep],
    )


def linear_id(region: Column, width: Column) -> Column:
    """Region id as ``row * width + col`` of its first pixel."""
    return (F.floor(region / STRIDE) * width + region % STRIDE).cast("long")


# ------------------------------------------------------------------ measures


def region_measures(regions: DataFrame, value: str = "class_id", conf: str | None = None) -> DataFrame:
    """Pixels (and mean confidence) per region; one aggregate whatever the number of regions."""
    measures = [F.count("*").alias("pixels")]
    if conf:
        measures.append(F.avg(conf).alias("mean_confidence"))
    return regions.groupBy("scene_id", "region_id", F.col(value).alias("class_id")).agg(*measures)


def region_measures_of_blocks(labelled: DataFrame, value: str = "class_id", conf: str | None = None) -> DataFrame:
    """As :func:`region_measures`, from the block rows of :func:`label_regions`.

    A block sends one row per region that it holds. Missing confidences leave the mean.
    """
    schema = f"scene_id {labelled.schema['scene_id'].dataType.simpleString()}, region_id BIGINT, class_id BIGINT, n BIGINT, s DOUBLE, k BIGINT"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for row in part.to_dict("records"):
                labels = np.asarray(row["labels"], dtype=np.int64)
                regions, first, which, n = np.unique(labels, return_index=True, return_inverse=True, return_counts=True)
                numbers = np.asarray(row[conf], dtype=np.float64) if conf else np.full(len(labels), np.nan)
                known = ~np.isnan(numbers)
                sums = np.bincount(which[known], numbers[known], minlength=len(regions))
                counts = np.bincount(which[known], minlength=len(regions))
                for i in np.flatnonzero(regions >= 0):
                    found.append((row["scene_id"], regions[i], int(row[value][first[i]]), n[i], sums[i], counts[i]))
            yield pd.DataFrame(found, columns=["scene_id", "region_id", "class_id", "n", "s", "k"])

    rows = labelled.select("scene_id", "labels", value, *([conf] if conf else [])).mapInPandas(run, schema)
    measures = [F.sum("n").alias("pixels")]
    if conf:
        measures.append(F.try_divide(F.sum("s"), F.sum("k")).alias("mean_confidence"))
    kind = labelled.schema[value].dataType.elementType
    return rows.groupBy("scene_id", "region_id", F.col("class_id").cast(kind).alias("class_id")).agg(*measures)


def planar_areas(measures: DataFrame, rasters: DataFrame) -> DataFrame:
    """Add ``area_m2`` for rasters in a projected system: pixels times the pixel area."""
    scale = rasters.select("scene_id", affine.pixel_area(F.col("transform")).alias("_px"))
    return measures.join(scale, "scene_id").withColumn("area_m2", F.col("pixels") * F.col("_px")).drop("_px")


def geographic_areas(measures: DataFrame, edges: DataFrame, rasters: DataFrame) -> DataFrame:
    """Add ``area_m2`` for rasters in degrees.

    Corner points are projected to the UTM zone of the raster centre and the signed cross products
    of the outline runs are summed per region, so no outline has to be put in order first.
    """
    t = F.col("transform")
    middle = affine.to_world(t, F.col("width") / 2.0, F.col("height") / 2.0)
    frame = rasters.select("scene_id", t.alias("_t"), middle.alias("_m")).select(
        "scene_id",
        "_t",
        G.utm_epsg(F.col("_m.x"), F.col("_m.y")).alias("_epsg"),
        "_m",
    )
    runs = edges.join(frame, "scene_id")

    def metric(x: str, y: str) -> Column:
        world = affine.to_world(F.col("_t"), F.col(x), F.col(y))
        return G.utm_project(world["x"], world["y"], F.col("_epsg"))

    origin = G.utm_project(F.col("_m.x"), F.col("_m.y"), F.col("_epsg"))
    runs = runs.select(
        "scene_id", "region_id", metric("x1", "y1").alias("p"), metric("x2", "y2").alias("q"), origin.alias("o")
    )
    px, py = F.col("p.x") - F.col("o.x"), F.col("p.y") - F.col("o.y")
    qx, qy = F.col("q.x") - F.col("o.x"), F.col("q.y") - F.col("o.y")
    areas = runs.groupBy("scene_id", "region_id").agg(
        F.abs(F.sum(px * qy - qx * py) / 2.0).alias("area_m2")
    )
    return measures.join(areas, ["scene_id", "region_id"])


def filter_area(features: DataFrame, min_area_m2: float = 0.0) -> DataFrame:
    """Keep regions of at least the given area."""
    if min_area_m2 < 0:
        raise ValueError("min_area_m2 must not be negative")
    return features.where(F.col("area_m2") >= min_area_m2)


def class_areas(features: DataFrame, by: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Area and number of regions per class."""
    return features.groupBy(*by, "class_id").agg(
        F.sum("area_m2").alias("area_m2"), F.count("*").alias("feature_count")
    )


# ------------------------------------------------------------------ outlines


def outline_edges(regions: DataFrame) -> DataFrame:
    """Directed unit edges between a region and its surroundings, region to the right.

    Directions 0..3 run along +x, +y, -x, -y. Every pixel offers its four sides; a side offered by
    two pixels of one region is interior and cancels in the aggregate.
    """
    r, c = F.col("row_idx"), F.col("col_idx")
    sides = F.array(
        *[
            F.struct(
                F.lit(direction).alias("dir"),
                F.lit(vertical).alias("vertical"),
                line.alias("line"),
                pos.alias("pos"),
            )
            for direction, vertical, line, pos in (
                (0, False, r, c),
                (1, True, c + 1, r),
                (2, False, r + 1, c),
                (3, True, c, r),
            )
        ]
    )
    return _cancelled(regions.select("scene_id", "region_id", F.inline(sides)))


def _cancelled(offered: DataFrame) -> DataFrame:
    """Sides that are not shared by two pixels of one region."""
    # the two pixels at a side face it in opposite directions
    both = offered.groupBy("scene_id", "vertical", "line", "pos").agg(
        F.min(F.when(F.col("dir") < 2, F.col("region_id"))).alias("_low"),
        F.min(F.when(F.col("dir") >= 2, F.col("region_id"))).alias("_high"),
    )
    low_dir = F.when(F.col("vertical"), 1).otherwise(0)
    owners = F.array(
        F.struct(F.col("_low").alias("region_id"), low_dir.alias("dir")),
        F.struct(F.col("_high").alias("region_id"), (low_dir + 2).alias("dir")),
    )
    kept = both.where(~F.col("_low").eqNullSafe(F.col("_high")))
    return kept.select("scene_id", "line", "pos", F.inline(owners)).where("region_id IS NOT NULL")


def outline_edges_of_blocks(labelled: DataFrame) -> DataFrame:
    """As :func:`outline_edges`, from the block rows of :func:`label_regions`.

    Sides inside a block cancel in the block; only outlines and the rims of blocks are shuffled, where the
    sides of neighbouring blocks cancel.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for at, (y, x, h, w, cells) in enumerate(zip(part.y_off, part.x_off, part.height, part.width, part.labels)):
                labels = np.asarray(cells, dtype=np.int64).reshape(h, w)
                around = np.pad(labels, 1, constant_values=NO_LABEL)
                beside = around[:-2, 1:-1], around[1:-1, 2:], around[2:, 1:-1], around[1:-1, :-2]
                for direction, other in enumerate(beside):
                    row, col = np.nonzero((labels >= 0) & (labels != other))
                    line, pos = ((y + row, x + col), (x + col + 1, y + row), (y + row + 1, x + col), (x + col, y + row))[direction]
                    found.append((np.full(len(row), at), labels[row, col], direction, line, pos))
            sizes = [len(f[0]) for f in found]
            at, region, line, pos = (np.concatenate([f[k] for f in found] or [[]]).astype(np.int64) for k in (0, 1, 3, 4))
            direction = np.repeat([f[2] for f in found], sizes).astype(np.int32)
            yield pd.DataFrame({
                "scene_id": part.scene_id.to_numpy()[at], "region_id": region, "dir": direction,
                "vertical": direction % 2 == 1, "line": line, "pos": pos,
            })

    kind = labelled.schema["scene_id"].dataType.simpleString()
    schema = f"scene_id {kind}, region_id BIGINT, dir INT, vertical BOOLEAN, line BIGINT, pos BIGINT"
    rows = labelled.select("scene_id", "y_off", "x_off", "height", "width", "labels")
    return _cancelled(rows.mapInPandas(run, schema))


def outline_runs(edges: DataFrame) -> DataFrame:
    """Straight runs of unit edges: ``scene_id, region_id, dir, x1, y1, x2, y2``.

    Consecutive edges of a region on one grid line form an island of equal ``pos - row number``.
    A window covers one line of one region, which is bounded by the raster side.
    """
    line = Window.partitionBy("scene_id", "region_id", "dir", "line").orderBy("pos")
    islands = edges.withColumn("_island", F.col("pos") - F.row_number().over(line))
    runs = islands.groupBy("scene_id", "region_id", "dir", "line", "_island").agg(
        F.min("pos").alias("_from"), (F.max("pos") + 1).alias("_to")
    )
    ahead = F.col("dir") < 2
    start = F.when(ahead, F.col("_from")).otherwise(F.col("_to"))
    end = F.when(ahead, F.col("_to")).otherwise(F.col("_from"))
    level = F.col("dir").isin(0, 2)
    return runs.select(
        "scene_id",
        "region_id",
        "dir",
        F.when(level, start).otherwise(F.col("line")).alias("x1"),
        F.when(level, F.col("line")).otherwise(start).alias("y1"),
        F.when(level, end).otherwise(F.col("line")).alias("x2"),
        F.when(level, F.col("line")).otherwise(end).alias("y2"),
    )


_CORNER = 1 << 30
_TINY = 64
_RING_SCHEMA = (
    "scene_id BIGINT, region_id BIGINT, region_vertices BIGINT, ring BIGINT, vertex BIGINT, "
    "x BIGINT, y BIGINT, to_x BIGINT, to_y BIGINT"
)


def _linked_runs(runs: DataFrame) -> DataFrame:
    """Add ``node`` and ``next`` codes: which run continues at the end of which.

    Where a region touches itself at a corner two runs start there; the outline then stays with
    its own pixel, which is the clockwise turn.
    """

    def code(y: Column, x: Column, direction: Column) -> Column:
        return ((y * _CORNER + x) * 4 + direction).cast("long")

    d = F.col("dir")
    starts = runs.groupBy(
        "scene_id", "region_id", F.col("x1").alias("x2"), F.col("y1").alias("y2")
    ).agg(F.bit_or(F.pow(F.lit(2), d).cast("int")).alias("_starts"))
    joined = runs.join(starts, ["scene_id", "region_id", "x2", "y2"])
    right, left = (d + 1) % 4, (d + 3) % 4
    turns_right = F.col("_starts").bitwiseAND(F.pow(F.lit(2), right).cast("int")) != 0
    return joined.select(
        "scene_id",
        "region_id",
        "x1",
        "y1",
        "x2",
        "y2",
        code(F.col("y1"), F.col("x1"), d).alias("node"),
        code(F.col("y2"), F.col("x2"), F.when(turns_right, right).otherwise(left)).alias("next"),
    )


def _order_in_memory(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ring and position of every vertex of a bounded set of regions."""
    pdf = pdf.sort_values(["region_id", "node"], ignore_index=True)
    names, region = np.unique(pdf.region_id.to_numpy(), return_inverse=True)
    first = np.searchsorted(region, np.arange(len(names)))
    last = np.append(first[1:], len(pdf))
    node, wanted = pdf.node.to_numpy(), pdf.next.to_numpy()
    nxt = np.empty(len(pdf), dtype=np.int64)
    for a, b in zip(first, last):
        nxt[a:b] = a + np.searchsorted(node[a:b], wanted[a:b])
    leader, jump = np.arange(len(pdf)), nxt.copy()
    while True:
        lower = np.minimum(leader, leader[jump])
        if np.array_equal(lower, leader):
            break
        leader, jump = lower, jump[jump]
    here = np.arange(len(pdf))
    jump = np.where(here == leader, here, nxt)
    steps = (here != leader).astype(np.int64)
    while not np.array_equal(jump, leader):
        steps, jump = steps + steps[jump], jump[jump]
    size = np.zeros(len(pdf), dtype=np.int64)
    np.maximum.at(size, leader, steps + 1)
    return pd.DataFrame(
        {
            "scene_id": pdf.scene_id,
            "region_id": pdf.region_id,
            "region_vertices": pdf.region_vertices,
            "ring": node[leader],
            "vertex": (size[leader] - steps) % size[leader],
            "x": pdf.x1,
            "y": pdf.y1,
            "to_x": pdf.x2,
            "to_y": pdf.y2,
        }
    )


def _order_by_doubling(linked: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Ring and position of every vertex by repeated doubling of the successor link.

    For regions whose outline is too long for one task. Rounds grow with the logarithm of the
    longest ring and each is checkpointed. A vertex that has reached its ring's leader leaves the
    join, so no join key is shared by more than one open vertex.
    """
    key = ["scene_id", "region_id"]
    carried = ["region_vertices", "x1", "y1", "x2", "y2"]

    def follow(state: DataFrame, links: DataFrame, update: dict[str, Column]) -> DataFrame:
        ahead = links.select(*[F.col(c).alias(f"_{c}") for c in links.columns])
        met = (
            (F.col("scene_id") == F.col("_scene_id"))
            & (F.col("region_id") == F.col("_region_id"))
            & (F.col("jump") == F.col("_node"))
        )
        return state.join(ahead, met).select(*[update.get(c, F.col(c)).alias(c) for c in state.columns])

    state = checkpoint(
        linked.select(*key, *carried, "node", "next", F.col("next").alias("jump"), F.col("node").alias("low"))
    )
    for _ in range(max_rounds):
        links = state.select(*key, "node", "jump", "low")
        lower = F.least("low", "_low")
        moved = checkpoint(
            follow(
                state.withColumn("moved", F.lit(False)),
                links,
                {"jump": F.col("_jump"), "low": lower, "moved": lower < F.col("low")},
            )
        )
        state = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("outline leaders did not settle")
    at_leader = F.col("node") == F.col("low")
    state = state.select(
        *key, *carried, "node", "low",
        F.when(at_leader, F.col("node")).otherwise(F.col("next")).alias("jump"),
        F.when(at_leader, 0).otherwise(1).cast("long").alias("steps"),
    )
    for _ in range(max_rounds):
        state = checkpoint(state)
        is_open = F.col("jump") != F.col("low")
        if state.where(is_open).isEmpty():
            break
        links = state.select(*key, "node", "jump", "steps")
        moved = follow(
            state.where(is_open), links, {"jump": F.col("_jump"), "steps": F.col("steps") + F.col("_steps")}
        )
        state = moved.unionByName(state.where(~is_open))
    else:
        raise RuntimeError("outline positions did not settle")
    sizes = state.groupBy(*key, "low").agg((F.max("steps") + 1).alias("_size"))
    return state.join(sizes, [*key, "low"]).select(
        *key,
        "region_vertices",
        F.col("low").alias("ring"),
        ((F.col("_size") - F.col("steps")) % F.col("_size")).alias("vertex"),
        F.col("x1").alias("x"),
        F.col("y1").alias("y"),
        F.col("x2").alias("to_x"),
        F.col("y2").alias("to_y"),
    )


def outline_rings(runs: DataFrame, limit: int = 100_000, block: int = 256) -> DataFrame:
    """Ordered ring vertices in pixel coordinates: ``scene_id, region_id, region_vertices, ring,
    vertex, x, y, to_x, to_y``, the last two being the next vertex of the ring.

    ``ring`` numbers the rings of a region arbitrarily but reproducibly. Regions of up to
    ``limit`` runs are ordered in bounded groups: the tiny ones together per block, others alone.
    Longer outlines go through :func:`_order_by_doubling`.
    """
    sizes = runs.groupBy("scene_id", "region_id").agg(F.count("*").alias("region_vertices"))
    # read by the test for long outlines and by both ways of ordering
    linked = checkpoint(_linked_runs(runs).join(sizes, ["scene_id", "region_id"]))
    size = F.col("region_vertices")
    home = F.floor(F.floor(F.col("region_id") / STRIDE) / block) * STRIDE + F.floor(
        (F.col("region_id") % STRIDE) / block
    )
    group = F.when(size <= _TINY, -1 - home).otherwise(F.col("region_id"))
    bounded = (
        linked.where(size <= limit)
        .withColumn("_group", group)
        .groupBy("scene_id", "_group")
        .applyInPandas(lambda pdf: _order_in_memory(pdf), _RING_SCHEMA)
    )
    large = linked.where(size > limit)
    return bounded if large.isEmpty() else bounded.unionByName(_order_by_doubling(large))


def ring_areas(rings: DataFrame) -> DataFrame:
    """Signed pixel area of each ring: positive for an outer ring, negative for a hole."""
    cross = F.col("x") * F.col("to_y") - F.col("to_x") * F.col("y")
    return rings.groupBy("scene_id", "region_id", "ring").agg(
        (F.sum(cross) / 2.0).alias("area"), F.count("*").alias("vertices")
    )


def ring_parts(rings: DataFrame, rasters: DataFrame, size: int = 10_000) -> DataFrame:
    """``scene_id, region_id, ring, part, points``: rings in world coordinates, cut into bounded parts.

    The parts of a ring in order hold all its vertices once; the first vertex is not repeated at the
    end. This is the form for regions of any size.
    """
    world = rings.join(rasters.select("scene_id", "transform"), "scene_id")
    place = F.struct("vertex", affine.to_world(F.col("transform"), F.col("x"), F.col("y")).alias("p"))
    key = ["scene_id", "region_id", "ring", F.floor(F.col("vertex") / size).alias("part")]
    parts = world.groupBy(*key).agg(F.array_sort(F.collect_list(place)).alias("_v"))
    return parts.select("scene_id", "region_id", "ring", "part", F.col("_v.p").alias("points"))


def polygons(rings: DataFrame, rasters: DataFrame) -> DataFrame:
    """``scene_id, region_id, rings`` in world coordinates, the outer ring first, rings closed.

    Every region is one value with all its vertices, as a GeoJSON feature has to be; where regions
    may not fit a row, :func:`ring_parts` holds the same outlines.
    """
    key = ["scene_id", "region_id"]
    parts = ring_parts(rings, rasters).groupBy(*key, "ring").agg(
        F.flatten(F.array_sort(F.collect_list(F.struct("part", "points")))["points"]).alias("_points")
    )
    holes = ring_areas(rings).select(*key, "ring", (F.col("area") < 0).alias("_hole"))
    closed = parts.join(holes, [*key, "ring"]).select(*key, "ring", "_hole", G.close_ring(F.col("_points")).alias("_ring"))
    return closed.groupBy(*key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_hole", "ring", "_ring"))), lambda r: r["_ring"]
        ).alias("rings")
    )
