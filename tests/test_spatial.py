"""Extents and clips across coordinate systems, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.functions import geometry as G
from rasterweave.operators import rasters as R
from rasterweave.operators import spatial as SP

BOX = "struct<minx: double, miny: double, maxx: double, maxy: double>"
AOI = f"aoi_id LONG, scene_id LONG, crs STRING, ring {G.RING}, holes ARRAY<{G.RING}>"


def test_boxes_of_all_sizes(spark):
    chance = random.Random(3)

    def box():
        side = 10.0 ** chance.uniform(0, 6.7)
        x, y = chance.choice([(0, 0), (500_000, 3_100_000), (-2_000_000, 1)])
        x, y = x + chance.uniform(-1, 1) * side * 2, y + chance.uniform(-1, 1) * side * 2
        return (x, y, x + side, y + side * chance.choice([1, 0.001, 0]))

    a = [(i, chance.choice("ab"), box()) for i in range(150)] + [(900, "a", (0.0, 0.0, float("inf"), 1.0)), (901, "a", None)]
    r = [(i, chance.choice("ab"), box()) for i in range(150)] + [(902, "a", (float("nan"), 0.0, 1.0, 1.0))]
    # boxes that touch, at powers of two
    a += [(200, "a", (0.0, 0.0, 64.0, 64.0))]
    r += [(200, "a", (64.0, 0.0, 128.0, 64.0)), (201, "a", (63.9, 63.9, 64.0, 64.0)), (202, "a", (-64.0, -64.0, 0.0, 0.0))]
    got = SP.extent_intersects(
        spark.createDataFrame(a, f"aoi_id LONG, crs STRING, bounds {BOX}"), spark.createDataFrame(r, f"scene_id LONG, crs STRING, bounds {BOX}")
    ).collect()
    want = {
        (i, j) for i, c, p in a[:150] + a[152:] for j, d, q in r if c == d and not (p[2] <= q[0] or p[0] >= q[2] or p[3] <= q[1] or p[1] >= q[3])
        and j != 902
    }
    assert len(got) == len(set(got)) and {tuple(g) for g in got} == want
    nodes = spark.createDataFrame(a[:150], f"aoi_id LONG, crs STRING, bounds {BOX}")
    nodes = SP._nodes(nodes, "bounds", F.array(SP._level(F.col("bounds")))).groupBy("aoi_id").count()
    assert nodes.agg(F.max("count")).first()[0] <= (SP.PARTS + 1) ** 2


def test_dense_boxes_are_paired_by_many_tasks(spark):
    """Pairs are many times the boxes: each is made once, and the shortness of the tables joins no tasks."""
    rows = spark.range(300).select("id", F.lit("a").alias("crs"), F.expr("struct(double(id % 20) as minx, double(id % 15) as miny, id % 20 + 20.5D as maxx, id % 15 + 20.5D as maxy)").alias("bounds"))
    got = SP.extent_intersects(rows.withColumnRenamed("id", "aoi_id"), rows.withColumnRenamed("id", "scene_id"))
    assert got.count() == got.distinct().count() == 300 * 300
    assert got.rdd.getNumPartitions() >= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_empty_tables_overlap_nothing(spark):
    none = spark.createDataFrame([], f"aoi_id LONG, scene_id LONG, crs STRING, ring {G.RING}, bounds {BOX}")
    assert SP.extent_intersects(none, none).count() == 0 and SP.coverage(none, none).count() == 0


@pytest.mark.parametrize("zone", [32601, 32643, 32660, 32701, 32756])
def test_zone_inverse(spark, zone):
    central, south = zone % 100 * 6 - 183, zone // 100 == 327
    points = [(central + d, (-1 if south else 1) * lat) for d in (-12.0, -3.0, -1e-9, 0.0, 2.5, 9.0) for lat in (0.0, 1e-7, 10.0, 45.0, 70.0, 83.9)]
    rows = spark.createDataFrame(points, "x double, y double")
    there = rows.select("x", "y", G.utm_project(F.col("x"), F.col("y"), F.lit(zone)).alias("p"))
    for r in there.select("x", "y", G.utm_unproject(F.col("p.x"), F.col("p.y"), F.lit(zone)).alias("b")).collect():
        assert r.b.x == pytest.approx(r.x, abs=1e-9) and r.b.y == pytest.approx(r.y, abs=1e-9)


def test_unknown_systems_are_errors(spark):
    p = spark.range(1).select(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")).alias("p"))
    for source, target in (("EPSG:2154", "EPSG:4326"), ("EPSG:4326", "EPSG:32661"), ("EPSG:2154", "EPSG:2154"), (None, "EPSG:4326")):
        with pytest.raises(Exception, match="unknown coordinate system"):
            p.select(G.reproject_point(F.col("p"), F.lit(source).cast("string"), F.lit(target)).alias("q")).collect()
    square = [(10.0, 50.0), (11.0, 50.0), (11.0, 51.0), (10.0, 50.0)]
    aoi = spark.createDataFrame([(1, 1, "EPSG:4326", square, [])], AOI)
    scene = spark.createDataFrame([(1, "EPSG:2154", (0.0, 0.0, 1.0, 1.0))], f"scene_id LONG, crs STRING, bounds {BOX}")
    with pytest.raises(Exception, match="unknown coordinate system"):
        SP.coverage(aoi, scene).collect()


def test_coverage_across_systems(spark):
    """An AOI in degrees, another in Mercator metres and one in zone metres, over scenes of all systems."""
    deg = [(9.0, 45.0), (9.01, 45.0), (9.01, 45.01), (9.0, 45.0)]
    rows = spark.createDataFrame([(1, 1, "EPSG:4326", deg, [])], AOI)
    metres = rows.select(G.reproject(F.col("ring"), F.lit("EPSG:4326"), F.lit("EPSG:3857")).alias("m"), G.reproject(F.col("ring"), F.lit("EPSG:4326"), F.lit("EPSG:32631")).alias("z")).first()
    far = [(x + 100, y) for x, y in deg]
    aois = spark.createDataFrame([(1, 1, "EPSG:4326", deg, []), (2, 1, "EPSG:3857", metres.m, []), (3, 1, "EPSG:32631", metres.z, []), (4, 1, "EPSG:4326", far, [])], AOI)
    scenes = [
        (1, "EPSG:32632", (499_900.0, 4_982_000.0, 500_900.0, 4_984_000.0)), (2, "EPSG:32632", (510_000.0, 4_982_000.0, 520_000.0, 4_984_000.0)),
        (3, "epsg:4326", (9.0, 45.005, 9.1, 45.1)), (4, "EPSG:4326", (9.02, 45.0, 9.1, 45.1)),
        (5, "EPSG:3857", (metres.m[0].x + 1, metres.m[0].y + 1, metres.m[0].x + 9, metres.m[0].y + 9)), (6, "EPSG:32732", (499_900.0, 14_982_000.0, 500_900.0, 14_984_000.0)),
        (7, "EPSG:32649", (300_000.0, 4_900_000.0, 900_000.0, 5_100_000.0)),
    ]
    got = SP.coverage(aois, spark.createDataFrame(scenes, f"scene_id LONG, crs STRING, bounds {BOX}")).collect()
    assert {tuple(g) for g in got} == {(a, s) for a in (1, 2, 3) for s in (1, 3, 5, 6)} | {(4, 7)}


def test_rasters_reach_far_zones(spark):
    """Wide rasters meet AOIs many zones away, across the pole and the date line, and no others."""
    square = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y)]
    chance = random.Random(5)
    places = [(chance.uniform(-180, 179), chance.uniform(-88, 87), chance.choice([0.02, 1.0])) for _ in range(200)]
    # three and more zones from 32 at 70 degrees, over the pole, on the equator 90 degrees away and beyond the poles
    places += [(33.0, 70.0, 0.02), (48.0, 80.0, 0.02), (-171.0, 89.0, 0.02), (99.0, 0.0, 0.02), (98.99, -0.01, 0.02), (-171.01, -0.01, 0.02), (-171.0, 0.0, 0.02)]
    aois = spark.createDataFrame([(i, 1, "EPSG:4326", square(*p), []) for i, p in enumerate(places)], AOI)
    scenes = []
    for i in range(240):
        south, wide = i % 2, 10.0 ** chance.uniform(3, 6.3)
        x, y = 500_000 + chance.uniform(-1, 1) * wide, (10_000_000 if south else 0) + chance.choice([-1, 1, 1 - 2 * south, 1 - 2 * south]) * chance.uniform(0, 1.05e7)
        scenes.append((i, f"EPSG:32{6 + south}{1 + i % 60:02d}", (x - wide, y - wide, x + wide, y + wide)))
    scenes += [(900, "EPSG:32632", (0.0, 7_000_000.0, 1_800_000.0, 9_300_000.0)), (901, "EPSG:32632", (0.0, 9_900_000.0, 1_000_000.0, 11_000_000.0))]
    scenes += [(902, "EPSG:32701", (0.0, 1_000_000.0, 400_000.0, 1_400_000.0)), (903, "EPSG:32632", (0.0, 19_900_000.0, 1_000_000.0, 20_100_000.0))]
    scenes = spark.createDataFrame(scenes, f"scene_id LONG, crs STRING, bounds {BOX}")
    got = {tuple(r) for r in SP.coverage(aois, scenes).collect()}
    box = G.densified_bounds(F.struct(*[F.col("_b")[c].alias(c) for c in ("minx", "miny", "maxx", "maxy")]), F.lit("EPSG:4326"), F.col("crs"))
    every = aois.select("aoi_id", G.bounds(F.col("ring")).alias("_b")).crossJoin(scenes.select("scene_id", "crs", "bounds"))
    want = {(r[0], r[1]) for r in every.withColumn("b", box).where("NOT (b.maxx <= bounds.minx OR b.minx >= bounds.maxx OR b.maxy <= bounds.miny OR b.miny >= bounds.maxy)").select("aoi_id", "scene_id").collect()}
    assert got == want
    assert {(200, 900), (201, 900), (202, 901), (205, 903), (206, 903)} <= got and not {(203, 900), (204, 900), (205, 900), (206, 900)} & got


@pytest.mark.parametrize("t", [(2.0, 0.0, 100.0, 0.0, -2.0, 500.0), (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (1.5, 0.4, 3.0, -0.3, -1.25, 90.0)])
def test_blocks_and_pixels_clip_alike(spark, t):
    """Random stars with holes, of which some leave the raster, over blocks of 8."""
    chance, size, side = random.Random(int(t[0] * 10)), 40, 8

    def star(x, y, n, low, high):
        a = np.linspace(0, 2 * np.pi, n, endpoint=False)
        r = [chance.uniform(low, high) for _ in a]
        p = [(x + k * float(np.cos(v)), y + k * float(np.sin(v))) for k, v in zip(r, a)]
        return [(t[0] * c + t[1] * w + t[2], t[3] * c + t[4] * w + t[5]) for c, w in [*p, p[0]]]

    aois = []
    for i in range(12):
        x, y = chance.uniform(0, size), chance.uniform(0, size)
        holes = [star(x, y, 9, 1, 3)] if i % 2 else []
        aois.append((i, 1 + i % 2, "EPSG:3857", star(x, y, 15, 4, 25), holes))
    aois.append((50, 1, "EPSG:3857", [(t[0] * c + t[1] * w + t[2], t[3] * c + t[4] * w + t[5]) for c, w in ((0, 0), (40, 0), (40, 40), (0, 40), (0, 0))], []))
    aois = spark.createDataFrame(aois, AOI)
    rasters = spark.createDataFrame([(s, "EPSG:3857", size, size, t) for s in (1, 2)], "scene_id LONG, crs STRING, width INT, height INT, transform STRUCT<a: DOUBLE, b: DOUBLE, c: DOUBLE, d: DOUBLE, e: DOUBLE, f: DOUBLE>")
    pixels = spark.range(2 * size * size).select(
        (F.floor(F.col("id") / (size * size)) + 1).alias("scene_id"), F.expr(f"(id div {size}) % {size}").alias("row_idx"), F.expr(f"id % {size}").alias("col_idx"),
        F.expr("cast(1 + id % 7 as int)").alias("v"), F.expr("id * 0.5").alias("u"),
    )
    want = SP.clip(pixels, aois, rasters, ["v", "u"], cell=16)
    done = SP.clip_blocks(R.to_blocks(pixels, ["v", "u"], side), aois, rasters, ["v", "u"], size=side).cache()
    assert {r[0] for r in done.select("covered").distinct().collect()} == {"all", "part", "none"}
    got = R.from_blocks(done.withColumn("scene_id", F.struct("aoi_id", "scene_id")), ["inside", "v", "u"]).select("scene_id.*", "row_idx", "col_idx", "inside", "v", "u")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
