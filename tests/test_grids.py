"""The grid source: splits, filters and damaged files, against NumPy."""

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from rasterweave.operators import rasters as R
from rasterweave.sources import grids


def folder(tmp_path):
    chance = np.random.default_rng(2)
    arrays = {12: chance.random((103, 57)).astype("<f4"), 13: chance.integers(0, 9, (64, 40)).astype(">i2"), 14: np.asfortranarray(chance.random((50, 90)))}
    for scene, a in arrays.items():
        np.save(tmp_path / f"scene_{scene}.npy", a)
    np.savez(tmp_path / "scene_15.npz", arrays[12][:9, :8])
    return arrays | {15: arrays[12][:9, :8]}


def assembled(rows, shape):
    out = np.full(shape, np.nan, np.float32)
    for r in rows:
        out[r.y_off : r.y_off + r.height, r.x_off : r.x_off + r.width] = np.array(r.confidence, np.float32).reshape(r.height, r.width)
    return out


@pytest.mark.parametrize("split", [700, 4000, 10**9])
def test_pieces_make_the_whole(spark, tmp_path, split):
    arrays = folder(tmp_path)
    table = grids.scan_grids(spark, f"file://{tmp_path}", block=8, split=split)
    rows = table.collect()
    assert len({(r.scene_id, r.block_row, r.block_col) for r in rows}) == len(rows) and not any(r.error for r in rows)
    for scene, a in arrays.items():
        assert (assembled([r for r in rows if r.scene_id == scene], a.shape) == a.astype(np.float32)).all()
    if split < 4000:
        assert table.rdd.getNumPartitions() > 20


def reader(path, filters, **options):
    own = grids.GridReader({"path": str(path), "block": "8", "split": "700", **options})
    assert list(own.pushFilters(filters)) == filters  # Spark applies all of them again
    return own


def blocks_read(own):
    return sum(b.num_rows for p in own.partitions() for b in own.read(p))


def test_a_window_reads_its_own_blocks(tmp_path):
    folder(tmp_path)
    place = lambda c: (c,)
    window = [EqualTo(place("scene_id"), 12), GreaterThan(place("block_row"), 3), LessThanOrEqual(place("block_row"), 5), EqualTo(place("block_col"), 2)]
    own = reader(tmp_path, window)
    assert len(own.partitions()) == 2 and blocks_read(own) == 2
    turned = reader(tmp_path, [EqualTo(place("scene_id"), 14), EqualTo(place("block_col"), 3)])
    assert len(turned.partitions()) == 1 and blocks_read(turned) == 7
    assert blocks_read(reader(tmp_path, [In(place("scene_id"), (13, 15, 99))])) == 8 * 5 + 2
    assert not reader(tmp_path, [EqualTo(place("scene_id"), 1)]).partitions()
    whole = reader(tmp_path, [])
    assert blocks_read(whole) == 13 * 8 + 8 * 5 + 7 * 12 + 2


def test_filters_reach_the_reader(spark, tmp_path):
    arrays = folder(tmp_path)
    table = grids.scan_grids(spark, str(tmp_path), block=8, split=700)
    rows = table.where("scene_id = 12 AND block_row BETWEEN 4 AND 5 AND block_col = 2")
    # one task for each row of blocks asked for
    assert rows.rdd.getNumPartitions() == 2
    got = {(r.block_row, r.block_col): list(r.confidence) for r in rows.collect()}
    assert got == {(k, 2): arrays[12][8 * k : 8 * k + 8, 16:24].ravel().tolist() for k in (4, 5)}


def test_damaged_files_are_rows(spark, tmp_path):
    np.save(tmp_path / "a1.npy", np.arange(6.0))
    np.save(tmp_path / "a2.npy", np.array([[None, 1]], object), allow_pickle=True)
    (tmp_path / "a3.npy").write_bytes(b"junk")
    np.save(tmp_path / "a4.npy", np.zeros((40, 40)))
    (tmp_path / "a4.npy").write_bytes((tmp_path / "a4.npy").read_bytes()[:-1])
    (tmp_path / "a5.npz").write_bytes(b"PK junk")
    np.save(tmp_path / "a6.npy", np.zeros((0, 5)))
    np.save(tmp_path / "none.npy", np.ones((1, 1)))
    np.save(tmp_path / "a7-rows-4.npy", np.ones((1, 1)))
    rows = grids.scan_grids(spark, str(tmp_path), block=8, split=500).collect()
    assert {r.scene_id for r in rows if r.error} == {1, 2, 3, 4, 5, 7}
    assert [(r.scene_id, list(r.confidence)) for r in rows if not r.error] == [(None, [1.0])]


def test_strips_round_trip(spark, tmp_path):
    cells = [(s, r, c, None if (r, c) == (3, 3) else float(s * 1000 + r * 50 + c)) for s, h, w in ((1, 21, 13), (2, 1, 1), (3, 9, 30)) for r in range(h) for c in range(w)]
    pixels = spark.createDataFrame(cells, "scene_id LONG, row_idx LONG, col_idx LONG, v DOUBLE")
    blocks = R.to_blocks(pixels, ["v"], 8)
    for _ in range(2):  # a second run replaces the files
        grids.write_grids(blocks, str(tmp_path / "out"), "v")
    names = sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file())
    assert names == sorted(["strip-1-rows-0.npy", "strip-1-rows-8.npy", "strip-1-rows-16.npy", "strip-2-rows-0.npy", "strip-3-rows-0.npy", "strip-3-rows-8.npy"])
    rows = R.from_blocks(grids.scan_grids(spark, str(tmp_path / "out"), block=8), ["confidence"]).collect()
    got = {(r.scene_id, r.row_idx, r.col_idx): None if np.isnan(r.confidence) else r.confidence for r in rows}
    assert got == {c[:3]: c[3] for c in cells}
    own = reader(tmp_path / "out", [EqualTo(("scene_id",), 1), EqualTo(("block_row",), 1)])
    assert blocks_read(own) == 2
