import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rasterweave.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = queries.op12_weak_toxicity(spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = Counter((labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels)
    assert held[1, 1] / (held[1, 0] + held[1, 1]) > 0.85 and held[0, 1] / (held[0, 0] + held[0, 1]) < 0.02


def plain_score(text, model):
    """The classifier without its reader: terms searched one by one, windows cut out."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    x = [0.0] * (toxicity.DENSE + len(model.terms))
    if words:
        hit = [[t for t in model.terms if (w + "$").startswith(t) and (len(t) < len(w + "$") or t.endswith("$"))] for w in words]
        hit = [h[:1] for h in hit]
        n = sum(map(len, hit))
        windows = [sum(map(len, hit[i : i + 100])) for i in range(0, len(words), 100)]
        x[:8] = [
            math.log(1 + 100 * n / len(words)), math.log(1 + n), math.log(1 + len({h[0] for h in hit if h})),
            math.log(1 + len({w for w, h in zip(words, hit) if h})), math.log(1 + max(windows)),
            sum(v > 0 for v in windows) / len(windows), sum(v > 1 for v in windows) / len(windows), math.log(1 + len(words)) / 10,
        ]
        own = re.findall(r"[^\W\d_]+", text)
        fits = [sum(p(w, w.lower()) for w in own) for p in toxicity.WORD_PATTERNS]
        fits += [len(re.findall("[!?]{2,}", text)), len(re.findall(r"(?<=[^\W\d_])[*@#$%]+(?=[^\W\d_])", text))]
        for i, n in enumerate(fits):
            x[8 + i] = math.log(1 + 100 * n / len(words))
        for i, t in enumerate(model.terms):
            x[toxicity.DENSE + i] = math.log(1 + 100 * sum(h == [t] for h in hit) / len(words))
    odds = model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], x))
    return 1 / (1 + math.exp(-odds))


def test_rows_against_plain_scores(spark):
    import random

    chance, rude = random.Random(5), "you scumbag IDIOT!! slurpish slurpen f**k "
    calm = "".join(chance.choice(["the ", "Quick ", "brown ", "fox, ", "leaps ", "over ", "lazy\n", "dogs "]) for _ in range(60))

    def text(i):
        words = [w + " " for w in calm.split(" ")]
        chance.shuffle(words)
        return "".join(words) * (1 + i % 5) + (rude * (1 + i % 4) if i % 3 == 0 else "")

    texts = [(i, text(i)) for i in range(150)]
    texts += [(150, None), (151, ""), (3, rude), (None, rude * 3), (152, "$$ 12 \n"), (153, calm * 20_000 + rude), (154, "Ärger idiot slurpaß")] * 2
    docs = spark.createDataFrame([(*t, "x", 1.5) for t in texts], "doc_id long, text string, votes string, `sc.ore` double")
    marks = [(i, int(i % 3 == 0), 9) for i in range(150)] + [(3, 0, 9), (None, 1, 9), (5, 7, 9), (6, None, 9)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, text int")
    model = toxicity.fit(docs, labels)
    assert {t[:4] for t in model.terms} >= {"idio", "scum", "slur"}
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(texts) and rows[0].asDict().keys() == {"doc_id", "text", "votes", "sc.ore", "score"}
    for r in rows:
        assert r["score"] == pytest.approx(plain_score(r["text"], model), rel=1e-6)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[150] == by[151] and min(by[i] for i in range(0, 150, 3) if i != 3) > 0.7 > max(by[i] for i in range(1, 150, 3))
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}
    clean = toxicity.fit(docs, labels.where("toxic = 0 and doc_id > 5"))
    assert max(r["score"] for r in toxicity.score(docs, clean).collect()) < 0.05
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_label_model_recovers_accuracies(spark):
    """Voters of known accuracy, two of them copies of a third: accuracies, tree and posteriors."""
    chance = np.random.default_rng(7)
    y = (chance.random(6000) < 0.3).astype(int)
    accuracy = [0.9, 0.8, 0.75, 0.7]
    votes = [np.where(chance.random(6000) < a, y, 1 - y) + 1 for a in accuracy]
    votes = np.stack([*votes, votes[3], votes[3]], 1)
    votes[chance.random(6000) < 0.2, 1] = 0
    known = np.where(chance.random(6000) < 0.03, y, -1)
    rows = Counter(("".join(map(str, v)), int(k)) for v, k in zip(votes, known))
    patterns = spark.createDataFrame([(*k, n) for k, n in rows.items()], "votes string, y int, n long")
    model = toxicity.fit_label_model(patterns)
    tied = {frozenset((i, p)) for i, p in enumerate(model.parent)}
    assert len(tied & {frozenset(x) for x in ((3, 4), (3, 5), (4, 5))}) == 2
    assert model.prior[1] == pytest.approx(0.3, abs=0.03)
    assert math.exp(model.tables[0][1, 0, 2]) == pytest.approx(0.9, abs=0.04)
    p = model.posterior(votes)
    assert ((p >= 0.5) == y).mean() > 0.9
    # the copies count once: a text on which only they say toxic stays clean
    alone = model.posterior(np.array([[1, 1, 1, 2, 2, 2]]))[0]
    assert alone < 0.25


def test_tree_against_brute_force():
    """The likelihood of the tree model is that of its tables, summed to one over all votes."""
    chance = np.random.default_rng(1)
    votes = chance.integers(0, 3, (400, 4))
    votes[:, 2] = votes[:, 1]
    p = chance.random(400)
    counts = toxicity.pair_counts(votes, np.stack([1 - p, p], 1))
    parent = toxicity.correlation_tree(counts)
    assert parent[0] == -1 and (parent[2] == 1 or parent[1] == 2)
    model = toxicity.label_model(counts, parent)
    every = np.array([[a, b, c, d] for a in range(3) for b in range(3) for c in range(3) for d in range(3)])
    assert np.exp(model.log_joint(every)).sum() == pytest.approx(1)
    for y, w in ((0, 1 - p), (1, p)):
        for j in range(4):
            for k in range(4):
                for a in range(3):
                    for b in range(3):
                        assert counts[y, j, k, a, b] == pytest.approx(w[(votes[:, j] == a) & (votes[:, k] == b)].sum())
