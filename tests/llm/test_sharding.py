import zlib
from collections import Counter

import numpy as np
import pytest

from rasterweave.llm import queries, sharding

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("good, bad, draws", [(5, 7, 4), (30, 10, 25), (1, 1000, 3), (0, 4, 2), (4, 0, 2), (3, 3, 6)])
def test_hypergeometric(good, bad, draws):
    rng, n = np.random.default_rng(1), 20_000
    own = np.array([sharding.hypergeometric(rng, good, bad, draws) for _ in range(n)])
    other = np.random.default_rng(2).hypergeometric(good, bad, draws, n)
    for k in range(draws + 1):
        assert abs((own == k).mean() - (other == k).mean()) < 0.02


def test_large_populations():
    rng = np.random.default_rng(3)
    drawn = [sharding.hypergeometric(rng, 10**11, 15 * 10**11, 10**8) for _ in range(200)]
    assert abs(np.mean(drawn) / (10**8 / 16) - 1) < 1e-3 and 1500 < np.std(drawn) < 3500


def test_matrix():
    sizes = np.array([5, 0, 17, 30, 1, 8])
    capacities = [16, 15, 15, 15]
    rows = [sharding.matrix_row(sizes, capacities, i, 7) for i in range(6)]
    assert [sum(r) for r in rows] == sizes.tolist() and [sum(c) for c in zip(*rows)] == capacities


def test_orders_are_equally_likely(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(4)], "doc_id long, text string").repartition(3).cache()
    seen = Counter()
    for seed in range(240):
        rows = sharding.shuffle_into_shards(docs, 2, seed).collect() if seed < 6 else None
        if rows:
            assert sorted((r["shard"], r["slot"]) for r in rows) == [(0, 0), (0, 1), (1, 0), (1, 1)]
            seen[tuple(r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])))] += 1
    assert len(seen) > 2
    # the same draws without Spark, often enough to compare frequencies
    first = Counter()
    for seed in range(3000):
        row = sharding.matrix_row(np.array([2, 1, 1]), [2, 2], 0, seed)
        first[row[0]] += 1
    assert abs(first[1] / 3000 - 4 / 6) < 0.03 and abs(first[0] - first[2]) < 150


def test_rows(spark):
    docs = spark.createDataFrame([(None, None, 1, "s")] * 3 + [(1, "", 2, "s")] * 4 + [(2, "y" * 50_000, 3, "s")] * 15, "doc_id long, text string, shard int, _part string")
    got = sharding.shuffle_into_shards(docs, 5, block_bytes=1000).collect()
    by = Counter(r["shard"] for r in got)
    assert [by[j] for j in range(5)] == [5, 5, 4, 4, 4]
    assert sorted(r["slot"] for r in got if r["shard"] == 0) == list(range(5))
    assert Counter((r["doc_id"], r["text"], r["_part"]) for r in got) == Counter((r["doc_id"], r["text"], r["_part"]) for r in docs.collect())
    assert sharding.shuffle_into_shards(docs.limit(0)).count() == 0


def test_query(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op1_hypergeometric_shards(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (len(docs[r["doc_id"]]) + 1, zlib.crc32(docs[r["doc_id"]]))
    slots = {j: sorted(r["slot"] for r in rows if r["shard"] == j) for j in range(16)}
    assert all(s == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = queries.op1_hypergeometric_shards(spark, FOLDER).collect()
    assert sorted(again) == sorted(rows)
