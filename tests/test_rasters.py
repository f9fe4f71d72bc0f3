import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rasterweave.functions import affine
from rasterweave.functions.tiles import covering_tiles, tile_starts
from rasterweave.operators import change as CH
from rasterweave.operators import components as K
from rasterweave.operators import images as I
from rasterweave.operators import rasters as R
from rasterweave.operators import spatial as SP
from rasterweave.functions import geometry as G


def grid(spark, rows, name="class_id", scene=1, kind="INT"):
    data = [(scene, r, c, v) for r, line in enumerate(rows) for c, v in enumerate(line)]
    return spark.createDataFrame(data, f"scene_id LONG, row_idx LONG, col_idx LONG, {name} {kind}")


def raster(spark, width, height, crs="EPSG:4326", t=(0.001, 0.0, 77.0, 0.0, -0.001, 28.0), scene=1):
    return spark.range(1).select(
        F.lit(scene).cast("long").alias("scene_id"), F.lit(width).alias("width"), F.lit(height).alias("height"),
        F.lit(crs).alias("crs"), affine.transform_of(*t).alias("transform"),
    )


BEFORE = [[1, 1, 0], [1, 2, 2], [0, 2, 2]]
AFTER = [[1, 2, 0], [1, 2, 1], [0, 2, 2]]


def test_tile_starts_golden(spark):
    def starts(d, t, o):
        return spark.range(1).select(tile_starts(F.lit(d), t, o).alias("s")).first().s

    assert starts(1000, 256, 32) == [0, 224, 448, 672, 744]
    assert starts(700, 256, 32) == [0, 224, 444]
    assert starts(200, 256, 32) == [0]
    tiles = R.tiles(raster(spark, 1000, 700), 256, 32).orderBy("tile_ord").collect()
    assert len(tiles) == 15
    assert (tiles[0].tile_id, tiles[-1].tile_id) == ("tile_r0000_c0000", "tile_r0002_c0004")
    assert all(t.row_off + t.tile_height <= 700 and t.col_off + t.tile_width <= 1000 for t in tiles)
    for size, overlap in ((0, 0), (8, 8), (8, -1)):
        with pytest.raises(ValueError):
            tile_starts(F.lit(9), size, overlap)


def test_covering_tiles_match_starts(spark):
    cases = [(d, t, o) for d in (1, 5, 17, 40) for t in (3, 8) for o in (0, 1, 2)]
    for d, t, o in cases:
        df = spark.range(d).select("id", covering_tiles(F.col("id"), F.lit(d), t, o).alias("c"), tile_starts(F.lit(d), t, o).alias("s"))
        for r in df.collect():
            assert sorted(r.c) == [i for i, s in enumerate(r.s) if s <= r.id < s + t], (d, t, o, r.id)


def test_window_checks():
    for bad in ((-1, 0, 2, 2), (0, 0, 0, 2), (0, 9, 2, 2)):
        with pytest.raises(ValueError):
            R.check_window(*bad, 10, 10)


def test_blocks_keep_holes_and_reject_duplicates(spark):
    pixels = grid(spark, np.arange(35).reshape(5, 7).tolist()).where("class_id <> 11")
    back = R.from_blocks(R.to_blocks(pixels, ["class_id"], 4), ["class_id"])
    assert back.count() == 35 and back.where("class_id IS NULL").count() == 1
    same = back.where("class_id IS NOT NULL").join(pixels, ["scene_id", "row_idx", "col_idx", "class_id"])
    assert same.count() == 34
    with pytest.raises(PySparkException, match="two pixels"):
        R.to_blocks(pixels.unionByName(pixels), ["class_id"], 4).collect()


def test_raster_without_crs(spark):
    with pytest.raises(PySparkException, match="no CRS"):
        R.raster_metadata(raster(spark, 2, 2, crs=None)).collect()


def test_mosaic_rules(spark):
    nan = float("nan")
    rows = [
        (1, 0, 0, 0, 3, 0.5), (1, 0, 0, 1, 4, 0.5),  # tie: the earlier tile
        (1, 0, 1, 0, 3, 0.4), (1, 0, 1, 1, 4, 0.6),
        (1, 0, 2, 0, 3, nan), (1, 0, 2, 1, 4, 0.1),
        (1, 0, 3, 0, 3, nan),
        (1, 0, 4, 0, 5, -0.5), (1, 0, 5, 0, 5, -1.0),
    ]
    preds = spark.createDataFrame(rows, "scene_id LONG, row_idx LONG, col_idx LONG, tile_ord INT, pred_id INT, conf DOUBLE")
    got = {r.col_idx: (r.pred_id, r.conf) for r in R.mosaic(preds, rasters=raster(spark, 7, 1)).collect()}
    assert got == {0: (3, 0.5), 1: (4, 0.6), 2: (4, 0.1), 3: (0, 0.0), 4: (5, 0.0), 5: (0, 0.0), 6: (0, 0.0)}


def test_change_golden(spark):
    pairs = CH.pair_dates(grid(spark, BEFORE), grid(spark, AFTER))
    s = CH.change_summary(pairs).first()
    assert (s.changed_pixels, s.total_valid_pixels, s.changed_fraction) == (2, 7, pytest.approx(2 / 7))
    assert CH.transition_map(CH.transitions(pairs)).first().transitions == {"1->2": 1, "2->1": 1}
    regions = K.regions_of_pixels(CH.change_mask(pairs))
    assert K.region_measures(regions).count() == 2
    same = CH.change_summary(CH.pair_dates(grid(spark, [[0]]), grid(spark, [[0]]))).first()
    assert same.changed_fraction == 0.0


def test_vectors_golden(spark):
    measures = K.region_measures(K.regions_of_pixels(grid(spark, BEFORE))).collect()
    assert sorted((r.class_id, r.pixels) for r in measures) == [(1, 3), (2, 4)]


def flood(rows):
    h, w = len(rows), len(rows[0])
    seen, out = {}, {}
    for start in ((r, c) for r in range(h) for c in range(w)):
        if start in seen or rows[start[0]][start[1]] == 0:
            continue
        todo, seen[start] = [start], start
        while todo:
            r, c = todo.pop()
            out[(r, c)] = start
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= n[0] < h and 0 <= n[1] < w and n not in seen and rows[n[0]][n[1]] == rows[r][c]:
                    seen[n] = start
                    todo.append(n)
    return out


def snake(n):
    rows = np.zeros((n, n), dtype=int)
    rows[::2] = 1
    for i in range(1, n, 2):
        rows[i, -1 if (i // 2) % 2 == 0 else 0] = 1
    return rows.tolist()


@pytest.mark.parametrize("block", [3, 4, 64])
@pytest.mark.parametrize("kind", ["random", "snake", "full"])
def test_regions_against_flood_fill(spark, kind, block):
    n = 21
    rows = {
        "random": np.random.default_rng(3).integers(0, 3, (n, n)).tolist(),
        "snake": snake(n),
        "full": [[1] * n] * n,
    }[kind]
    got = K.regions_of_pixels(grid(spark, rows), block=block).collect()
    assert {(r.row_idx, r.col_idx): divmod(r.region_id, K.STRIDE) for r in got} == flood(rows)


@pytest.mark.parametrize("limit", [100000, 0])
def test_rings_close_and_measure(spark, limit):
    rows = [
        [1, 1, 1, 1, 0],
        [1, 0, 1, 1, 1],
        [1, 1, 0, 1, 2],
        [1, 1, 1, 1, 2],
        [0, 2, 2, 2, 0],
    ]
    regions = K.regions_of_pixels(grid(spark, rows), block=2)
    runs = K.outline_runs(K.outline_edges(regions))
    rings = K.outline_rings(runs, limit=limit)
    measures = {(r.region_id): r.pixels for r in K.region_measures(regions).collect()}
    areas = {}
    for r in K.ring_areas(rings).collect():
        areas.setdefault(r.region_id, []).append(r.area)
    assert {k: sum(v) for k, v in areas.items()} == measures
    # the two diagonal holes of the large region form one ring
    assert sorted(areas[0]) == [-2.0, 17.0]
    shapes = {r.region_id: r.rings for r in K.polygons(rings, raster(spark, 5, 5, t=(1.0, 0, 0, 0, 1.0, 0))).collect()}
    assert all(ring[0] == ring[-1] for s in shapes.values() for ring in s)


def test_region_area_through_utm(spark):
    """One square of 0.001 degrees near (77, 28): its size follows from the ellipsoid."""
    regions = K.regions_of_pixels(grid(spark, [[1]]))
    runs = K.outline_runs(K.outline_edges(regions))
    got = K.geographic_areas(K.region_measures(regions), runs, raster(spark, 1, 1)).first()
    lat = np.radians(27.9995)
    e2 = G.ECCENTRICITY**2
    v = 1 - e2 * np.sin(lat) ** 2
    meridian, normal = G.WGS84_A * (1 - e2) / v**1.5, G.WGS84_A / v**0.5
    d = np.radians(0.001)
    lon = np.radians(77.0005 - 75)
    eta2 = e2 / (1 - e2) * np.cos(lat) ** 2
    k = G.UTM_SCALE * (1 + (1 + eta2) * (lon * np.cos(lat)) ** 2 / 2)
    assert got.area_m2 == pytest.approx(meridian * d * normal * np.cos(lat) * d * k * k, rel=2e-6)


def test_meridian_arc(spark):
    p = spark.range(1).select(G.utm_project(F.lit(9.0), F.lit(45.0), F.lit(32632)).alias("p")).first().p
    # quarter-meridian tables give 4984944.378 m from the equator to 45 degrees on this ellipsoid
    assert p.x == pytest.approx(500000.0)
    assert p.y == pytest.approx(0.9996 * 4984944.378, abs=1e-3)


def aoi(spark, x0, y0, x1, y1, crs="EPSG:3857"):
    return spark.range(1).select(
        F.lit(1).cast("long").alias("aoi_id"), F.lit(1).cast("long").alias("scene_id"), F.lit(crs).alias("crs"), F.lit("Polygon").alias("type"),
        G.ring_of((F.lit(x0), F.lit(y0)), (F.lit(x1), F.lit(y0)), (F.lit(x1), F.lit(y1)), (F.lit(x0), F.lit(y1))).alias("ring"),
        F.array().cast(f"ARRAY<{G.RING}>").alias("holes"),
    )


CLIP = (10.0, 0.0, 500000.0, 0.0, -10.0, 3100000.0)


def test_clip_window_golden(spark):
    r = raster(spark, 1000, 1000, "EPSG:3857", CLIP)
    w = SP.clip_windows(aoi(spark, 500500.0, 3097500.0, 502500.0, 3099500.0), r).first()
    assert (w.row_from, w.row_to, w.col_from, w.col_to) == (50, 250, 50, 250)


def test_extent_touching_is_no_overlap(spark):
    boxes = R.raster_metadata(raster(spark, 1000, 1000, "EPSG:3857", CLIP)).select("scene_id", "crs", "bounds")

    def hits(*corners):
        a = aoi(spark, *corners)
        return SP.extent_intersects(SP.aoi_bounds_in(a, "EPSG:3857"), boxes).count()

    assert hits(500500.0, 3097500.0, 502500.0, 3099500.0) == 1
    assert hits(600000.0, 3000000.0, 601000.0, 3001000.0) == 0
    assert hits(510000.0, 3090000.0, 511000.0, 3091000.0) == 0
    assert hits(509999.0, 3090000.0, 511000.0, 3091000.0) == 1


def test_long_ring_self_intersection(spark):
    n = 400
    angle = np.linspace(0, 2 * np.pi, n, endpoint=False)
    circle = [(float(np.cos(a)), float(np.sin(a))) for a in angle]
    crossed = circle.copy()
    crossed[100], crossed[103] = crossed[103], crossed[100]
    rows = [(i, "Polygon", "EPSG:3857", [*r, r[0]], []) for i, r in enumerate((circle, crossed))]
    df = spark.createDataFrame(rows, f"aoi_id LONG, type STRING, crs STRING, ring {G.RING}, holes ARRAY<{G.RING}>")
    got = {r.aoi_id: r.errors for r in SP.validate_aois(df).collect()}
    assert got == {0: [], 1: ["self_intersection"]}


def test_holes_of_short_and_long_shells(spark):
    def circle(n, r, x=0.0):
        p = [(x + r * float(np.cos(a)), r * float(np.sin(a))) for a in np.linspace(0, 2 * np.pi, n, endpoint=False)]
        return [*p, p[0]]

    bow = [(-1.0, -1.0), (1.0, 1.0), (1.0, -1.0), (-1.0, 1.0), (-1.0, -1.0)]
    cases = [[circle(9, 2.0)], [bow], [circle(9, 2.0, 9.0)], [circle(9, 1.0, 30.0)], [circle(9, 1.0), circle(9, 1.0, 1.5)], [circle(9, 1.0, -3.0), circle(9, 1.0, 3.0)], []]
    bad = [False, True, True, True, True, False, False]
    rows = [(n * 10 + i, "Polygon", "EPSG:3857", circle(n, 10.0), holes) for n in (100, 200) for i, holes in enumerate(cases)]
    df = spark.createDataFrame(rows, f"aoi_id LONG, type STRING, crs STRING, ring {G.RING}, holes ARRAY<{G.RING}>")
    got = {r.aoi_id: r.errors for r in SP.validate_aois(df).collect()}
    assert got == {n * 10 + i: ["self_intersection"] if b else [] for n in (100, 200) for i, b in enumerate(bad)}


def test_layers_that_are_not_aligned(spark):
    left, right = grid(spark, [[1, 2], [3, 4]]), grid(spark, [[5, 6]]).withColumnRenamed("class_id", "other")
    with pytest.raises(Exception, match="not aligned"):
        R.join_pixels(left, right).collect()
    with pytest.raises(Exception, match="not aligned"):
        R.join_blocks(R.to_blocks(left, ["class_id"], 4), R.to_blocks(right, ["other"], 4)).collect()
    sizes = spark.createDataFrame([(1, 2, 2)], "scene_id LONG, height INT, width INT")
    scene = left.first().scene_id
    sizes = sizes.withColumn("scene_id", F.lit(scene).cast("long"))
    both = R.join_blocks(R.to_blocks(left, ["class_id"], 4, sizes), R.to_blocks(right, ["other"], 4, sizes)).first()
    assert both.class_id == [1, 2, 3, 4] and both.other == [5, 6, None, None]


def test_rotated_transform(spark):
    t = affine.transform_of(0.0, -10.0, 100.0, 10.0, 0.0, 200.0)
    row = spark.range(1).select(affine.pixel_area(t).alias("area"), affine.bounds(t, F.lit(3), F.lit(2)).alias("b")).first()
    assert row.area == 100 and tuple(row.b) == (80.0, 200.0, 100.0, 230.0)


def test_parse_aois_closes_rings(spark):
    text = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4]],[[1,1],[2,1],[2,2],[1,2],[1,1]]]}'
    df = spark.createDataFrame([(1, text, "epsg:3857")], "aoi_id LONG, geojson STRING, crs STRING")
    row = SP.validate_aois(SP.parse_aois(df)).first()
    assert (row.area_m2, row.errors, len(row.ring)) == (15.0, [], 5)


def test_rotation_matches_numpy(spark):
    rows = np.arange(12).reshape(3, 4)
    for hflip in (False, True):
        for vflip in (False, True):
            for angle in (0, 90, 180, 270):
                base = np.arange(16).reshape(4, 4)
                change = F.struct(F.lit(hflip).alias("hflip"), F.lit(vflip).alias("vflip"), F.lit(angle).alias("angle"))
                got = I.transform_pixels(grid(spark, base.tolist()), change, F.lit(4), F.lit(4)).collect()
                want = base[:, ::-1] if hflip else base
                want = np.rot90(want[::-1] if vflip else want, angle // 90)
                out = np.zeros((4, 4), dtype=int)
                for r in got:
                    out[r.row_idx, r.col_idx] = r.class_id
                assert (out == want).all(), (hflip, vflip, angle)
    turned = I.transform_pixels(
        grid(spark, rows.tolist()), F.struct(F.lit(False).alias("hflip"), F.lit(False).alias("vflip"), F.lit(180).alias("angle")), F.lit(3), F.lit(4)
    )
    assert turned.count() == 12


def test_jitter_stays_in_range(spark):
    rgb = grid(spark, [[0, 120, 255]]).select("scene_id", "row_idx", "col_idx", *[F.col("class_id").alias(c) for c in "rgb"])
    for r in I.colour_jitter(rgb, 1, 1).collect():
        assert all(0 <= r[c] <= 255 for c in "rgb")


def test_resize_same_size_is_identity(spark):
    pixels = grid(spark, [[0.1, 0.9], [0.3, 0.5]], "conf", kind="DOUBLE")
    got = I.resize_bilinear(pixels, ["conf"], 2, 2, 2, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pixels.collect()))
    big = I.resize_nearest(pixels, 2, 2, 4, 4)
    assert big.count() == 16 and big.where("row_idx < 2 AND col_idx < 2 AND conf = 0.1").count() == 4


def test_haar_drops_odd_edge(spark):
    got = I.haar(grid(spark, [[1.0, 2.0, 9.0], [3.0, 4.0, 9.0], [9.0, 9.0, 9.0]], "x", kind="DOUBLE"), "x").collect()
    s = 0.5 * 2**-0.5
    assert len(got) == 1
    assert [got[0][b] for b in ("ll", "lh", "hl", "hh")] == pytest.approx([10 * s, 4 * s, 2 * s, 0.0])


@pytest.mark.parametrize("tolerance", [None, 0, 40])
def test_acquisitions_as_of(spark, tolerance):
    """Ties, gaps, dates without images and scenes without either, in chunks of ten seconds."""
    import random
    from datetime import datetime, timedelta

    chance, day = random.Random(4), datetime(2024, 5, 1)
    images = [(i, chance.choice([1, 1, 1, 2, 3]), day + timedelta(seconds=chance.randint(0, 150))) for i in range(60)] + [(99, 1, None)]
    asked = [(i, chance.choice([1, 1, 2, 4]), day + timedelta(seconds=chance.randint(-60, 260))) for i in range(80)] + [(90, 1, None)]
    got = CH.nearest_acquisitions(
        spark.createDataFrame(asked, "request_id LONG, scene_id LONG, requested_at TIMESTAMP"),
        spark.createDataFrame(images, "image_id LONG, scene_id LONG, acquired_at TIMESTAMP"), tolerance, chunk_seconds=10,
    ).collect()
    assert len(got) == len(asked)
    for r in got:
        own = [(t, i) for i, s, t in images if s == r.scene_id and t is not None and r.requested_at is not None]
        near = lambda t: tolerance is None or abs((t - r.requested_at).total_seconds()) <= tolerance
        before = max((x for x in own if x[0] <= r.requested_at), default=None)
        after = min((x for x in own if x[0] >= r.requested_at), default=None)
        before, after = (x if x and near(x[0]) else None for x in (before, after))
        gap = lambda x: abs((x[0] - r.requested_at).total_seconds())
        nearest = before if before and (not after or gap(before) <= gap(after)) else after
        for name, want in (("before", before), ("after", after), ("nearest", nearest)):
            assert (r[f"{name}_acquired_at"], r[f"{name}_image_id"]) == (want or (None, None))
