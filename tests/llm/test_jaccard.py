import random
import time

import pytest

from rasterweave.llm import common, jaccard, queries

FOLDER = "/root/testdata/sf0.001"


def brute(docs):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocabulary, k=40)
    base = [rng.choices(vocabulary, k=rng.choice((5, 12, 60, 120))) for _ in range(12)]
    docs = []
    for i in range(220):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 1, 1, 2, 4))):
            at = rng.randrange(len(words))
            words[at : at + rng.choice((0, 1, 4))] = rng.choices(vocabulary, k=rng.choice((0, 1, 3)))
        if i % 3 == 0:
            words = rng.choices(vocabulary, k=rng.choice((6, 9, 14))) + passage
        docs.append((i, " ".join(words)))
    return docs + [(300, None), (301, ""), (302, " \n"), (303, "Two words"), (304, "two\tWORDS"), (305, docs[7][1]), (7, docs[7][1]), (None, docs[9][1]),
                   (None, "quite alone here"), (306, "x " * 9000), (307, "x " * 8000)]


@pytest.mark.parametrize("crowd, sample", [(16, 32), (3, 1), (2, 2)])
def test_against_all_pairs(spark, crowd, sample, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    docs = corpus()
    table = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, sid int, doc string").repartition(5)
    got = jaccard.linked_components(table, crowd=crowd)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "text_hash", "group_id"]
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == brute(docs)


def test_nothing(spark):
    assert jaccard.linked_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted((tuple(r)[:3] for r in queries.op6_jaccard_components(spark, FOLDER).collect()), key=str) == brute(docs)


@pytest.mark.parametrize("signed", [True, False])
def test_pairs_just_below_the_threshold_are_not_compared(spark, monkeypatch, signed):
    # each text has one word of its own, so none is linked, though they share most of their shingles
    words = [f"w{i}" for i in range(64)]
    docs = [(i, " ".join(words[:k] + [f"own{i}"] + words[k + 1 :])) for i, k in enumerate(range(2, 64, 5))]
    compared, verified = [], jaccard._verified

    def counting(*args):
        compared.append(verified(*args))
        return compared[-1]

    monkeypatch.setattr(jaccard, "_verified", counting)
    if not signed:  # as it was
        monkeypatch.setattr(jaccard, "_alike", lambda *_: "true")
    got = jaccard.linked_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()} == set(brute(docs))
    assert (sum(x.count() for x in compared) < 40) == signed


def test_stored_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before, setting = shuffled(), spark.conf.get(common.SHUFFLES_GO, "false")
    rows = common.stored(spark.range(10_000).repartition(7, "id").groupBy("id").count(), "rows")
    for _ in range(50):  # files go in the background
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and rows.count() == 10_000
    assert spark.conf.get(common.SHUFFLES_GO, "false") == setting
