import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from rasterweave.llm import queries, suffix_tree

FOLDER = "/root/testdata/sf0.001"


def words(t):
    return (t or "").encode().lower().split() + [b""]


def brute(train, docs, depth, context, symbol, entry, gain, least=2):
    """The definition with plain dictionaries."""
    count = Counter(w for t in train for w in words(t))
    n, v = sum(count.values()), len(count)
    root = lambda w: (count[w] + 1) / (n + v + 1)
    alphabet = {w for w, c in count.items() if c >= symbol * n}
    usable = {w for w, c in count.items() if c >= context * n and w}
    other = 1 - sum(root(w) for w in alphabet)
    sym = lambda w: w if w in alphabet else None
    nxt = defaultdict(Counter)
    for t in train:
        x = words(t)
        for i in range(len(x)):
            for d in range(1, depth + 1):
                if i >= d and all(w in usable for w in x[i - d : i]):
                    nxt[tuple(x[i - d : i])][sym(x[i])] += 1
    candidates = {}
    for d in range(1, depth + 1):
        for s in [s for s in nxt if len(s) == d]:
            if d == 1 or (s[:-1] in candidates and nxt[s[:-1]][s[-1]] >= max(2.0, context * n)):
                candidates[s] = nxt[s]
    stored = {s: {w: c for w, c in cs.items() if c >= max(2.0, entry * n)} for s, cs in candidates.items()}

    def p(s, w, states):
        while s and s not in states:
            s = s[1:]
        if not s:
            return root(w) if w is not None else other
        total, kinds = sum(candidates[s].values()), len(candidates[s])
        rest = total - sum(stored[s].values())
        return (stored[s].get(w, 0) + (rest + kinds) * p(s[1:], w, states)) / (total + kinds)

    kept = set()
    for s in candidates:
        total = sum(candidates[s].values())
        if sum(c * math.log(c / total / p(s[1:], w, candidates)) for w, c in stored[s].items()) >= gain:
            kept |= {s[i:] for i in range(len(s))}
    after = defaultdict(Counter)
    for t in train:
        x = words(t)
        for a, b in zip(x, x[1:]):
            if a not in usable:
                after[a][b] += 1
    tail = {}
    for a, cs in after.items():
        held = {b: c for b, c in cs.items() if c >= least}
        if held and sum(c * math.log(c / count[a] / root(b)) for b, c in held.items()) >= gain:
            tail[a] = held

    def after_tail(a, w):
        kinds, rest = len(tail[a]), count[a] - sum(tail[a].values())
        return (tail[a].get(w, 0) + (kinds + 2 * rest) * root(w)) / (count[a] + kinds + rest)

    out = []
    for d, t in docs:
        x, full = words(t), 0.0
        for i, w in enumerate(x):
            if i and x[i - 1] in tail:
                full += math.log10(after_tail(x[i - 1], w))
                continue
            full += math.log10(p(tuple(x[max(0, i - depth) : i]), sym(w), kept))
            full += 0 if w in alphabet else math.log10(root(w)) - math.log10(other)
        out.append((d, len(x), sum(count[w] > 0 for w in x), sum(math.log10(root(w)) for w in x), full))
    return out, (kept, tail)


def corpus():
    rng = random.Random(2)
    docs, phrase = [], "one two three four five six".split()
    for i in range(70):
        x = []
        while len(x) < rng.randrange(60):
            x += phrase if rng.random() < 0.3 else [rng.choice(["a", "B", "cc", "dd", f"r{rng.randrange(200)}"])]
        docs.append((i, " ".join(x)))
    docs += [(70 + i, " ".join(f"q{i % 5}{c}" for c in "abcdefgéh")) for i in range(10)]
    return docs + [(90, None), (91, ""), (92, "never seen words"), (None, "a b"), (3, "a b")]


@pytest.mark.parametrize("depth, word", [(3, 1e-6), (3, 0.004), (2, 0.01), (1, 0.004)])
def test_against_the_definition(spark, depth, word):
    docs = corpus()
    shares = dict(depth=depth, context=0.01, symbol=0.002 if word < 0.002 else max(word, 0.004), entry=0.001, gain=3.0)
    table = spark.createDataFrame([(*d, 1, b"z") for d in docs], "doc_id long, text string, row int, word binary").repartition(3)
    model = suffix_tree.fit(table.where("doc_id < 80"), word=word, **shares)
    expected, kept = brute([t for d, t in docs if d is not None and d < 80], docs, **shares)
    key = lambda r: (str(r[0]), r[1])
    got = sorted(map(tuple, suffix_tree.score(table, model).collect()), key=key)
    assert len(kept[0]) > 5 and len(kept[1]) > 5 and len(got) == len(expected)
    for a, b in zip(got, sorted(expected, key=key)):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9)


def test_order_of_shares(spark):
    with pytest.raises(ValueError):
        suffix_tree.fit(spark.createDataFrame(corpus(), "doc_id long, text string"), word=0.1, symbol=0.01)


def test_the_tail_grows_with_the_texts(spark):
    """A text that occurs twice is learnt however large the rest is; the head alone would forget it."""
    rng, found = random.Random(4), []
    twice = " ".join(f"only{i}" for i in range(40))
    for size in (100, 800):
        rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(50))) for i in range(size)] + [(-1, twice), (-2, twice), (-3, " ".join(reversed(twice.split())))]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        model = suffix_tree.fit(docs, context=0.02, gain=10.0)
        found.append(model.pairs.count())
        got = {r["doc_id"]: r["score"] - r["base_score"] for r in suffix_tree.score(docs, model).where("doc_id < 0").collect()}
        assert got[-1] == got[-2] > 40 and got[-1] > got[-3] + 40
    assert min(found) >= 39


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    rows = suffix_tree.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), suffix_tree.fit(none)).collect()
    assert [tuple(r) for r in rows] == [(1, 3, 0, 0.0, 0.0)]
    assert suffix_tree.score(none, suffix_tree.fit(none)).count() == 0


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    count = Counter(w for d, t in docs.items() if not held[d] for w in words(t))
    n, v = sum(count.values()), len(count)
    rows = queries.op10_suffix_tree_scores(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        x = words(docs[r["doc_id"]])
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(x), sum(count[w] > 0 for w in x), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_words_that_are_not_known_come_with_the_ids():
    known = {b"a": 0, b"": 1}
    ids, first, _, lost = suffix_tree._ids(["a B b a", None, "c"], known)
    assert ids.tolist() == [0, -1, -1, 0, 1, 1, -1, 1] and lost == [[b"b", b"b"], [], [b"c"]]
    assert first.tolist() == [True, False, False, False, False, True, True, False]
    assert suffix_tree._ids(["a"], {b"a": 0})[3] == [[b""]]
