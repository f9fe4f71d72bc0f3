import numpy as np
import pytest

from rasterweave.llm import neighbours, queries

FOLDER = "/root/testdata/sf0.01"


def brute(points, asked, k):
    ids, v = np.array(list(points)), np.array(list(points.values()), dtype=float)
    out = []
    for name in asked:
        distance = np.sqrt(((v - np.array(points[name], dtype=float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, distance)) if ids[i] != name][:k]
        out += [(name, rank, int(ids[i]), distance[i]) for rank, i in enumerate(order, 1)]
    return out


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    rows = {r["vec_id"]: list(r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect() if r["embedding"]}
    expected = {r[:3] for r in brute(rows, [i for i in rows if i % 100 == 0], 10)}
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in queries.op2_one_bit_neighbours(spark, FOLDER).collect()}
    assert len(got) == len(expected) and len(got & expected) / len(expected) >= 0.97


def test_bounds_hold():
    rng = np.random.default_rng(0)
    v, q = rng.standard_normal((3000, 64)), rng.standard_normal((20, 64))
    rotation = neighbours._rotation(64, 1)
    low, high = neighbours.limits(q, *neighbours.encode(v, v.mean(axis=0), rotation), v.mean(axis=0), rotation, 2.5)
    true = ((q[:, None] - v[None]) ** 2).sum(axis=2)
    assert ((low <= true) & (true <= high)).mean() > 0.97 and (high - low).mean() < true.mean() * 1.5


def test_rows(spark):
    rng = np.random.default_rng(1)
    points = {i: rng.standard_normal(8).tolist() for i in range(60)}
    points[61] = points[60] = points[3]
    odd = [(70, None), (71, []), (72, [0.0] * 8), (73, [1.0] * 7 + [float("nan")]), (74, [1.0] * 7 + [None]), (75, [1.0] * 7 + [float("inf")]), (None, [1.0] * 8), (76, [1.0, 2.0]), (77, [2.0, 2.0])]
    rows = [(i, v, 1, "z") for i, v in [*points.items(), *odd, (5, points[5])]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, d int, block string")
    got = sorted(map(tuple, neighbours.nearest(table, table.where("vec_id % 3 = 0 or vec_id >= 70"), k=5, bound=4.0).collect()))
    expected = sorted(brute(points, [i for i in points if i % 3 == 0], 5))
    pair = [r for r in got if r[0] >= 70]
    assert pair == [(76, 1, 77, 1.0), (77, 1, 76, 1.0)]
    got = [r for r in got if r[0] < 70]
    assert [r[:3] for r in got] == [r[:3] for r in expected] and [r[3] for r in got] == pytest.approx([r[3] for r in expected])
    few = table.where("vec_id in (1, 2)")
    assert neighbours.nearest(few, few).count() == 2
    assert neighbours.nearest(table.limit(0), table.limit(0)).count() == 0
