"""Block operators against plain arrays and against the pixel operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.functions import affine
from rasterweave.functions import geometry as G
from rasterweave.operators import components as K
from rasterweave.operators import images as I
from rasterweave.operators import patches as P
from rasterweave.operators import rasters as R
from rasterweave.operators import spatial as SP
from rasterweave.operators.analysis import analyse

SIZES = {1: (7, 11), 2: (1, 5), 3: (13, 2)}


def scenes(spark, sizes=SIZES):
    return spark.createDataFrame([(k, h, w) for k, (h, w) in sizes.items()], "scene_id LONG, height INT, width INT")


def images(holes=False):
    chance = np.random.default_rng(8)
    found = {k: chance.random((h, w)) for k, (h, w) in SIZES.items()}
    if holes:
        found[1][3, 4] = found[1][6, 10] = math.nan
    return found


def pixel_table(spark, pictures, name="x"):
    rows = [(k, r, c, float(a[r, c])) for k, a in pictures.items() for r in range(a.shape[0]) for c in range(a.shape[1]) if not math.isnan(a[r, c])]
    return spark.createDataFrame(rows, f"scene_id LONG, row_idx LONG, col_idx LONG, {name} DOUBLE")


def block_table(spark, pictures, size):
    return R.to_blocks(pixel_table(spark, pictures), ["x"], size, scenes(spark))


def pixels_of(df, *values):
    rows = R.from_blocks(df, list(values)).where(F.col(values[0]).isNotNull())
    return {(r.scene_id, r.row_idx, r.col_idx): tuple(r[v] for v in values) for r in rows.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == pytest.approx(values, abs=1e-9), key


@pytest.mark.parametrize("size,halo", [(4, 0), (4, 1), (3, 5), (16, 2)])
def test_halo_holds_the_rims_and_can_be_taken_off(spark, size, halo):
    pictures = images(holes=True)
    blocks = block_table(spark, pictures, size)
    wide = P.with_halo(blocks, ["x"], scenes(spark), halo, size)
    rows = wide.collect()
    assert len(rows) == blocks.count()
    for r in rows:
        a = pictures[r.scene_id]
        y0, x0 = max(r.block_row * size - halo, 0), max(r.block_col * size - halo, 0)
        want = a[y0 : (r.block_row + 1) * size + halo, x0 : (r.block_col + 1) * size + halo]
        assert (r.y_off, r.x_off, r.height, r.width) == (y0, x0, *want.shape)
        got = np.array([math.nan if x is None else x for x in r.x]).reshape(want.shape)
        np.testing.assert_array_equal(got, want)
    back = P.without_halo(wide, ["x"], halo, size)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, blocks.select(back.columns).collect()), key=str)


@pytest.mark.parametrize("size,overlap", [(4, 1), (5, 0), (6, 5), (40, 3)])
def test_tiles_are_those_of_the_layout(spark, size, overlap):
    pictures = images()
    rasters = scenes(spark).withColumns({"crs": F.lit("EPSG:3857"), "transform": F.expr("named_struct('a', 1D, 'b', 0D, 'c', 0D, 'd', 0D, 'e', -1D, 'f', 0D)")})
    want = {(t.scene_id, t.tile_ord): (t.row_off, t.col_off, t.tile_height, t.tile_width) for t in R.tiles(rasters, size, overlap).collect()}
    got = P.tile_windows(block_table(spark, pictures, 3), ["x"], scenes(spark), size, overlap).collect()
    assert {(t.scene_id, t.tile_ord): (t.y_off, t.x_off, t.height, t.width) for t in got} == want
    for t in got:
        cut = pictures[t.scene_id][t.y_off : t.y_off + t.height, t.x_off : t.x_off + t.width]
        np.testing.assert_array_equal(np.array(t.x).reshape(t.height, t.width), cut)


@pytest.mark.parametrize("hflip,vflip", [(False, False), (True, False), (False, True), (True, True)])
@pytest.mark.parametrize("angle", [0, 90, 180, 270])
def test_turns_equal_those_by_pixel(spark, hflip, vflip, angle):
    change = F.struct(F.lit(hflip).alias("hflip"), F.lit(vflip).alias("vflip"), F.lit(angle).alias("angle"))
    pictures = images(holes=True)
    got = pixels_of(P.transform_blocks(block_table(spark, pictures, 4), ["x"], scenes(spark), change, 4), "x")
    table = pixel_table(spark, pictures).join(scenes(spark), "scene_id")
    moved = I.transform_pixels(table, change, F.col("height"), F.col("width"))
    assert got == {(r.scene_id, r.row_idx, r.col_idx): (r.x,) for r in moved.collect()}


@pytest.mark.parametrize("nh,nw", [(3, 40), (7, 11), (20, 1), (2, 3)])
def test_resizes_equal_those_by_pixel(spark, nh, nw):
    pictures = {k: a for k, a in images(holes=True).items() if k == 1}
    blocks, (h, w) = block_table(spark, pictures, 4), SIZES[1]
    sizes = F.lit(nh), F.lit(nw)
    near = I.resize_nearest(pixel_table(spark, pictures), h, w, nh, nw).collect()
    got = pixels_of(P.resize_blocks_nearest(blocks, ["x"], scenes(spark), *sizes, 4), "x")
    assert got == {(r.scene_id, r.row_idx, r.col_idx): (r.x,) for r in near}
    smooth = I.resize_bilinear(pixel_table(spark, pictures), ["x"], h, w, nh, nw).collect()
    got = pixels_of(P.resize_blocks(blocks, ["x"], scenes(spark), *sizes, 4), "x")
    same(got, {(r.scene_id, r.row_idx, r.col_idx): (r.x,) for r in smooth})


@pytest.mark.parametrize("size", [1, 3, 4])
def test_wavelet_equals_that_by_pixel(spark, size):
    pictures = images(holes=True)
    got = pixels_of(P.haar_blocks(block_table(spark, pictures, size), "x", scenes(spark), size), *I.HAAR)
    want = I.haar(pixel_table(spark, pictures), "x").collect()
    same(got, {(r.scene_id, r.row_idx, r.col_idx): tuple(r[b] for b in I.HAAR) for r in want})


def test_numbers_that_are_not_finite_spoil_only_what_they_feed(spark):
    pictures = {2: np.array([[1.0, math.inf, 3.0, 4.0, 5.0]])}
    out = P.resize_blocks(block_table(spark, pictures, 2), ["x"], scenes(spark), F.lit(1), F.lit(5), 2)
    got = pixels_of(out, "x")
    assert [math.isnan(got[2, 0, c][0]) for c in range(5)] == [False, True, False, False, False]


def test_mosaic_prefers_the_surest_then_the_earliest_tile(spark):
    nan = math.nan
    tiles = spark.createDataFrame(
        [
            (2, 1, 0, 2, 1, 3, [5, 6, 7], [0.5, 0.9, None]),
            (2, 0, 0, 0, 1, 4, [1, 2, 3, 4], [nan, 0.2, 0.5, 0.1]),
        ],
        "scene_id LONG, tile_ord INT, y_off INT, x_off INT, height INT, width INT, pred_id ARRAY<INT>, conf ARRAY<DOUBLE>",
    )
    got = pixels_of(P.mosaic_blocks(tiles, scenes(spark), 2), "pred_id", "conf")
    assert [got[2, 0, c] for c in range(5)] == [(0, 0.0), (2, 0.2), (3, 0.5), (6, 0.9), (0, 0.0)]


def test_empty_tables_and_errors(spark):
    none = block_table(spark, images(), 4).limit(0)
    where = scenes(spark)
    assert P.with_halo(none, ["x"], where, 1, 4).count() == 0
    assert P.haar_blocks(none, "x", where, 4).count() == 0
    with pytest.raises(ValueError):
        P.with_halo(none, ["x"], where, -1, 4)
    blocks = block_table(spark, images(), 4)
    with pytest.raises(Exception, match="a block belongs to no raster"):
        P.with_halo(blocks, ["x"], where.where("scene_id = 1"), 1, 4).collect()
    with pytest.raises(Exception, match="two pixels at one position"):
        P.with_halo(blocks.unionByName(blocks), ["x"], where, 1, 4).collect()


def test_one_shuffle_of_patches_and_no_pixel_rows(spark):
    """Blocks that are read from storage meet in one exchange by window; few rows leave the cut."""
    blocks = block_table(spark, images(), 4)
    cut = P._cut(P._with_scenes(blocks, scenes(spark), ["x"]), ["x"], P._stay, P.Rimmed(4, 1))
    assert cut.count() <= 9 * blocks.count()


@pytest.mark.parametrize("size", [2, 5, 16])
def test_outlines_and_measures_of_blocks_equal_those_of_pixels(spark, size):
    chance = np.random.default_rng(size)
    rows = [(k, r, c, int(chance.integers(0, 3)), None if (r + c) % 5 == 0 else float(r * c)) for k, (h, w) in SIZES.items() for r in range(h) for c in range(w)]
    pixels = spark.createDataFrame(rows, "scene_id LONG, row_idx LONG, col_idx LONG, class_id INT, conf DOUBLE")
    labelled = K.label_regions(R.to_blocks(pixels, ["class_id", "conf"], size), size, keep=("conf",))
    regions = K.region_pixels(labelled, keep=("conf",))
    by_key = lambda df: sorted(map(tuple, df.collect()), key=str)
    edges = K.outline_edges(regions)
    assert by_key(K.outline_edges_of_blocks(labelled).select(edges.columns)) == by_key(edges)
    measures = K.region_measures(regions, conf="conf")
    assert by_key(K.region_measures_of_blocks(labelled, conf="conf").select(measures.columns)) == by_key(measures)
    assert K.outline_edges_of_blocks(labelled.limit(0)).count() == K.region_measures_of_blocks(labelled.limit(0)).count() == 0


def test_chain_over_blocks_equals_the_single_operators(spark):
    """An AOI with a hole, one larger than its scene and one beside it."""

    def look(bands):
        y, x = np.indices(bands[0].shape)
        return np.where(bands[0] > 0, 1 + (np.nan_to_num(bands[0]) * 3).astype(int), 0), bands[0] * (1 - 0.01 * (y + x))

    t = affine.transform_of(1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    rasters = scenes(spark).select("*", F.lit("EPSG:3857").alias("crs"), t.alias("transform"))
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in (*p, p[0])]
    aois = spark.createDataFrame(
        [
            (7, 1, ring((1, 0), (10, 0), (10, 7), (1, 7)), [ring((4, 2), (7, 2), (7, 5), (4, 5))]),
            (8, 1, ring((-5, -5), (30, -5), (30, 30), (-5, 30)), []),
            (9, 2, ring((40, 40), (42, 40), (42, 42)), []),
            (10, 3, ring((0, 3), (2, 3), (2, 12), (0, 12)), []),
        ],
        f"aoi_id LONG, scene_id LONG, ring {G.RING}, holes ARRAY<{G.RING}>",
    ).withColumn("crs", F.lit("EPSG:3857"))
    pictures = images()
    crops, labelled = analyse(block_table(spark, pictures, 3), aois, rasters, ["x"], lambda: look, tile=4, overlap=2, size=3)
    found = crops.collect()
    assert sorted((c.aoi_id, c.height, c.width) for c in found) == [(7, 7, 9), (8, 7, 11), (10, 9, 2)]
    owner = {c.scene_id: c.aoi_id for c in found}
    got = {}
    for b in labelled.collect():
        for k, (c, s) in enumerate(zip(b.class_id, b.conf)):
            got[owner[b.scene_id], b.y_off + k // b.width, b.x_off + k % b.width] = (c, s)
    clipped = SP.clip(pixel_table(spark, pictures), aois, rasters, ["x"], nodata=0.0, cell=4).collect()
    want = {}
    for c in found:
        a = np.zeros((c.height, c.width))
        for p in clipped:
            if p.aoi_id == c.aoi_id:
                a[p.row_idx, p.col_idx] = p.x
        starts = lambda n: sorted({min(i * 2, max(n - 4, 0)) for i in range(n)})
        best = np.full(a.shape, -1.0)
        kind = np.zeros(a.shape, int)
        for y in starts(c.height):
            for x in starts(c.width):
                classes, conf = look(a[None, y : y + 4, x : x + 4])
                better = conf > best[y : y + 4, x : x + 4]
                best[y : y + 4, x : x + 4][better] = conf[better]
                kind[y : y + 4, x : x + 4][better] = classes[better]
        want |= {(c.aoi_id, *at): (int(kind[at]), float(best[at])) for at in np.ndindex(a.shape)}
    same(got, want)
    regions = K.regions_of_pixels(K.region_pixels(labelled).drop("region_id"), 4)
    again = {(owner[r.scene_id], r.row_idx, r.col_idx): r.region_id for r in regions.collect()}
    assert again == {(owner[r.scene_id], r.row_idx, r.col_idx): r.region_id for r in K.region_pixels(labelled).collect()}
