import itertools
import random

import pytest

import corpus_pipeline
from rasterweave.llm import lines


def edits(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return 0 if a == b else 2
    front = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    back = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return 1 if front + back >= max(len(a), len(b)) - 1 else 2


def corpus():
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdé ", k=n)) for n in (8, 9, 12, 12, 15)]
    out = []
    for _ in range(120):
        line = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            i = rng.randrange(len(line))
            line[i : i + rng.choice((0, 1))] = rng.choice(("", "x", "é"))
        out.append("".join(line))
    docs = [(i, "\n".join(out[i * 4 : i * 4 + 4])) for i in range(30)]
    return docs + [(30, None), (31, ""), (32, "\n\n"), (3, docs[3][1]), (None, out[0] + "\nshort"), (33, "short\nshort")]


@pytest.mark.parametrize("crowd", [0, 2, 32])
def test_against_all_pairs(spark, crowd):
    docs = corpus()
    order = {r[0]: r[1] for r in spark.createDataFrame([(t,) for _, t in docs], "t string").selectExpr("t", "xxhash64(t)").collect()}
    rank = lambda d, t, i: (d is not None, d or 0, order[t], i)
    every = [(rank(d, t, i), line) for d, t in set(docs) if t for i, line in enumerate(t.split("\n")) if len(line) >= 8]
    gone = {y[0] for x, y in itertools.permutations(every, 2) if x[0] < y[0] and edits(x[1], y[1]) <= 1}
    expected = [(d, t and "\n".join(x for i, x in enumerate(t.split("\n")) if rank(d, t, i) not in gone)) for d, t in docs]
    table = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, doc int, gone string")
    got = lines.without_repeated_lines(table, min_chars=8, crowd=crowd)
    assert got.columns == table.columns
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=key) == sorted(expected, key=key)
    assert len(gone) > 50


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("crowd, every, piece", [(0, 8, 4096), (2, 4, 16), (32, 6, 4096)])
def test_edits_by_length_against_all_pairs(spark, monkeypatch, crowd, every, piece):
    monkeypatch.setattr(lines, "PIECE", piece)
    rng = random.Random(every)
    base = ["".join(rng.choices("abcdé 𝄞", k=n)) for n in (8, 15, 16, 17, 31, 40, 64, 65)]
    docs = []
    for d in range(40):
        out = []
        for _ in range(4):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(len(line) // every + 3)):
                i = rng.randrange(len(line))
                line[i : i + rng.choice((0, 1))] = rng.choice(("", "x", "é"))
            out.append("".join(line))
        docs.append((d, "\n".join(out)))
    at = [((d, i), x) for d, t in docs for i, x in enumerate(t.split("\n")) if len(x) >= 8]
    near = lambda x, y: distance(x, y) <= max(1, max(len(x), len(y)) // every)
    gone = {q for (p, x), (q, y) in itertools.combinations(at, 2) if near(x, y)}
    one = {q for (p, x), (q, y) in itertools.combinations(at, 2) if edits(x, y) <= 1}
    expected = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = lines.without_repeated_lines(table, min_chars=8, crowd=crowd, every=every)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == expected
    assert len(one) + 5 < len(gone) < len(at) - 5


def test_keys_and_pairs_go_in_rounds(spark, monkeypatch):
    """Small rounds drop the same lines; no round holds all pairs, and no more texts than half the lines are met at once."""
    rng, docs = random.Random(8), []
    base = ["".join(rng.choices("abcdef ", k=80)) for _ in range(12)]
    for d in range(10):
        out = []
        for line in base:
            i = rng.randrange(80)
            out.append(line[:i] + rng.choice("xyz") + line[i + 1 :])
        docs.append((d, "\n".join(out)))
    table, kept, counts = spark.createDataFrame(docs, "doc_id long, text string"), lines.stored, []

    def counted(df, name):
        out = kept(df, name)
        counts.append((name, out.count()))
        return out

    once = lines.without_repeated_lines(table, every=32, crowd=1000).collect()
    monkeypatch.setattr(lines, "ROUND", 200)
    monkeypatch.setattr(lines, "stored", counted)
    assert sorted(lines.without_repeated_lines(table, every=32, crowd=1000).collect()) == sorted(once)
    assert {r["text"].count("\n") for r in once} > {11}
    pairs, met = ([n for name, n in counts if name == x] for x in ("pairs", "met"))
    # the last is the union of the rounds before it, each pair once
    assert len(pairs) > 6 and max(pairs[:-1]) < pairs[-1] and sum(met) == pairs[-1]
    assert max(met) < dict(counts)["texts"]


def test_texts_are_shuffled_once(spark, monkeypatch):
    plans, kept = {}, lines.stored
    monkeypatch.setattr(lines, "stored", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
    monkeypatch.setattr(lines, "BROADCAST_ROWS", -1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = spark.createDataFrame([(1, "a line of forty characters and a few more")] * 2, "doc_id long, text string")
        assert [r["text"] for r in lines.without_repeated_lines(table, every=32).collect()] == ["a line of forty characters and a few more"] * 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans["texts"].count("Exchange hashpartitioning") == 2  # of the lines and of their first places


def test_pipeline_drops_lines_with_a_replaced_word(spark):
    line = " ".join(f"word{i}" for i in range(40))
    rows = [(1, line), (2, line.replace("word20", "other")), (3, line.replace("word2", "other"))]
    got = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: line, 2: "", 3: rows[2][1]}


def test_short_lines_that_repeat(spark):
    rows = [(1, "Read more\n\nlines\nlinex"), (2, "Read more\n\nown\nline"), (3, "own")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {1: rows[0][1], 2: "\nown\nline", 3: ""}
    for got in (corpus_pipeline.line_dedup(spark, table, ""), lines.without_repeated_lines(table, exact_chars=1)):
        assert {r["doc_id"]: r["text"] for r in got.collect()} == expected


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.without_repeated_lines(empty).count() == 0
    assert lines.without_repeated_lines(empty, every=32).count() == 0


def test_near_lines_share_few_keys():
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghij é𝄞", k=n)) for n in (40, 41, 63, 64, 200, 333, 9000) for _ in range(4)]
    changed = []
    for text in texts:
        line = list(text)
        for _ in range(max(1, len(line) // 32)):
            i = rng.randrange(len(line))
            line[i : i + 1] = rng.choice(("", "x", "yz"))[:2] if len(line) < 64 else rng.choice("xyz")
        changed.append("".join(line)[: len(text)])
    at, keys, first, last = lines._prefix_keys(texts + changed, 14, 32)
    assert (first <= last).all()
    own = [set(keys[at == i].tolist()) for i in range(len(texts) * 2)]
    near = [i for i, (a, b) in enumerate(zip(texts, changed)) if distance(a[:400], b[:400]) <= max(1, max(len(a), len(b)) // 32) or len(a) > 400]
    assert len(near) > 20 and all(own[i] & own[i + len(texts)] for i in near)
    long = [len(own[i]) / len(texts[i]) for i in range(16, len(texts))]
    assert max(long) < 0.16  # with the least gram of each window there were 0.22 keys a character
