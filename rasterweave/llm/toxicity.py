"""Toxicity by weak supervision: many voters, a generative model of them, and a linear classifier.

1. A lexicon of words and word beginnings is mined from labelled texts.
2. Voters (lexicons, densities, patterns) call a text toxic or clean, or abstain. All documents vote.
3. A generative label model, P(y) * product of P(vote | vote of its parent, y), explains the votes of
   all documents. Parents make a tree of the strongest correlations given y, so voters that copy
   each other do not count twice. It is fitted by expectation maximisation, in which documents with
   a label keep it; every round is one Spark job over the distinct vote patterns.
4. A logistic regression over densities is trained on the model's posterior labels of a sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.common import drop_states, quoted, stored, worker_state

WORD = re.compile(r"[^\W\d_]+")
#: words of a window, within which hits count together
WINDOW = 100
#: code points of the word beginnings that may become terms
SHORTEST = 4
BEGINNINGS = range(SHORTEST, 9)
LEXICONS = 6
#: patterns of a word: shouting, drawn-out letters, address; and of the text between words: runs of
#: marks, masked letters
WORD_PATTERNS = [
    lambda word, low: len(word) > 2 and word.isupper(),
    lambda word, low: DRAWN.search(low) is not None,
    lambda word, low: low in ADDRESS,
]
DRAWN = re.compile(r"(.)\1{3}")
#: fixed values: forms of address in four languages
ADDRESS = {"you", "your", "du", "dich", "dein", "tu", "tus", "te", "toi", "ton"}
MARKS, MASKS = re.compile(r"[!?]{2,}"), re.compile(r"[*@#$%]+(?=[^\W\d_])")
PATTERNS = len(WORD_PATTERNS) + 2
#: dense features before the terms' own
DENSE = 8 + PATTERNS
#: votes: abstain, clean, toxic
VOTES = 3


def words_in(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams(word: str) -> list[str]:
    """The word itself, marked by an end sign, and its beginnings."""
    return [word + "$", *(word[:k] for k in BEGINNINGS if k <= len(word))]


class Reader:
    """Turns texts into features and votes; belongs to one worker."""

    def __init__(self, terms: list[str]):
        self.terms = {t: i for i, t in enumerate(terms)}
        self.heads = {t.rstrip("$")[:SHORTEST] for t in terms}
        self.cache: dict[str, int] = {}

    def code(self, word: str) -> int:
        """Number of the word's term (0: none), and above it a bit for each pattern that it fits.

        Terms never begin with one another, so a word has at most one.
        """
        low = word.lower()
        at = next((self.terms[g] + 1 for g in grams(low) if g in self.terms), 0) if low[:SHORTEST] in self.heads else 0
        for i, fits in enumerate(WORD_PATTERNS):
            if fits(word, low):
                at |= 1 << (20 + i)
        return at

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Dense features, and the places and values of those of terms; zeros without words."""
        words = WORD.findall(text) if text else []
        dense = np.zeros(DENSE)
        if not words:
            return dense, np.zeros(0, np.int64), np.zeros(0)
        try:
            codes = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(self.cache) > 400_000:
                self.cache.clear()
            self.cache.update((w, self.code(w)) for w in set(words).difference(self.cache))
            codes = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))
        if codes.any():
            self._hits(dense, codes, words)
        dense[7] = math.log1p(len(words)) / 10
        marks = sum(1 for _ in MARKS.finditer(text)) if "!" in text or "?" in text else 0
        masks = sum(1 for m in MASKS.finditer(text) if m.start() and WORD.match(text[m.start() - 1])) if any(c in text for c in "*@#$%") else 0
        dense[8 + len(WORD_PATTERNS) :] = np.log1p(100 * np.array([marks, masks]) / len(words))
        places, counts = np.unique(codes & 0xFFFFF, return_counts=True)
        if not places[0]:
            places, counts = places[1:], counts[1:]
        return dense, places - 1, np.log1p(100 * counts / len(words))

    @staticmethod
    def _hits(dense: np.ndarray, codes: np.ndarray, words: list[str]) -> None:
        found = codes & 0xFFFFF
        at = np.flatnonzero(found)
        per = np.bincount(at // WINDOW, minlength=-(-len(words) // WINDOW))
        dense[:7] = [
            math.log1p(100 * len(at) / len(words)), math.log1p(len(at)), math.log1p(len(np.unique(found[at]))),
            math.log1p(len({words[i].lower() for i in at.tolist()})), math.log1p(per.max()), (per > 0).mean(), (per > 1).mean(),
        ]
        for i in range(len(WORD_PATTERNS)):
            dense[8 + i] = math.log1p(100 * np.count_nonzero(codes >> (20 + i) & 1) / len(words))

    @staticmethod
    def votes(dense: np.ndarray, places: np.ndarray) -> str:
        """A digit for each voter: 0 abstains, 1 clean, 2 toxic."""
        if not dense[7]:
            return "0" * (LEXICONS + 6 + PATTERNS)
        held = {int(p) % LEXICONS for p in places}
        out = ["2" if g in held else "1" for g in range(LEXICONS)]
        density, hits, kinds, forms, most, share = np.expm1(dense[0]), *np.expm1(dense[1:5]), dense[5]
        for value, low, high in (
            (density, 0.25, 1.0), (density, 0.1, 2.0), (hits, 0.5, 2.5), (kinds, 0.5, 1.5), (forms, 0.5, 2.5), (most + share, 0.5, 1.9),
        ):
            out.append("2" if value >= high else "1" if value < low else "0")
        out += ["2" if x > 0 else "0" for x in dense[8:]]
        return "".join(out)


# the label model


def _digits(votes: list[str]) -> np.ndarray:
    return np.frombuffer("".join(votes).encode(), np.uint8).reshape(len(votes), -1) - ord("0")


def pair_counts(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """[y, voter, voter, vote, vote] sums of the (rows x 2) weights."""
    hot = np.eye(VOTES)[votes].reshape(len(votes), -1)
    k = votes.shape[1]
    out = [(hot * weight[:, y : y + 1]).T @ hot for y in (0, 1)]
    return np.stack(out).reshape(2, k, VOTES, k, VOTES).transpose(0, 1, 3, 2, 4)


@dataclass(frozen=True)
class LabelModel:
    """``prior`` of y, each voter's ``parent`` (-1: none), log tables [voter, y, parent's vote, vote]."""

    prior: np.ndarray
    parent: list[int]
    tables: np.ndarray

    def log_joint(self, votes: np.ndarray) -> np.ndarray:
        """Rows x 2: log P(votes, y)."""
        out = np.repeat(np.log(self.prior)[None, :], len(votes), 0)
        for j, p in enumerate(self.parent):
            out += self.tables[j][:, votes[:, p] if p >= 0 else np.zeros(len(votes), np.int64), votes[:, j]].T
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(y = 1 | votes)."""
        a = self.log_joint(votes)
        return 1 / (1 + np.exp(np.clip(a[:, 0] - a[:, 1], -60, 60)))


def correlation_tree(counts: np.ndarray) -> list[int]:
    """Parents that make the tree of the largest mutual information given y, rooted at voter 0."""
    total = counts.sum(axis=(3, 4), keepdims=True).clip(1e-9)
    joint = (counts + 1e-6) / (total + 9e-6)
    rows, columns = joint.sum(4, keepdims=True), joint.sum(3, keepdims=True)
    given = (joint * np.log(joint / (rows * columns))).sum((3, 4))
    share = total[:, 0, 0, 0, 0] / total[:, 0, 0, 0, 0].sum()
    strength = (given * share[:, None, None]).sum(0)
    k = len(strength)
    parent, best, link = [-1] * k, strength[0].copy(), np.zeros(k, int)
    left = set(range(1, k))
    while left:
        j = max(left, key=lambda i: (best[i], -i))
        parent[j] = int(link[j])
        left.remove(j)
        closer = strength[j] > best
        best, link = np.where(closer, strength[j], best), np.where(closer, j, link)
    return parent


def label_model(counts: np.ndarray, parent: list[int]) -> LabelModel:
    """Maximum likelihood with a few counts of smoothing towards the voter's own rates."""
    k = counts.shape[1]
    own = np.stack([counts[:, j, j].diagonal(axis1=1, axis2=2) for j in range(k)])  # voter, y, vote
    prior = own[0].sum(1) + 1
    tables = np.zeros((k, 2, VOTES, VOTES))
    for j, p in enumerate(parent):
        base = (own[j] + 0.5) / (own[j] + 0.5).sum(1, keepdims=True)
        seen = counts[:, p, j] if p >= 0 else np.repeat(own[j][:, None, :], VOTES, 1)
        tables[j] = seen + 2 * base[:, None, :]
    return LabelModel(prior / prior.sum(), parent, np.log(tables / tables.sum(-1, keepdims=True)))


def _expected(patterns: DataFrame, model: LabelModel | None) -> tuple[np.ndarray, float]:
    """Pair counts expected under the model (None: of labelled rows alone) and the log likelihood."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, fit = 0.0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            v, y, n = _digits(batch["votes"].to_pylist()), np.array(batch["y"]), np.array(batch["n"], dtype=float)
            if model is None:
                p = (y == 1).astype(float)
            else:
                a = model.log_joint(v)
                p = np.where(y >= 0, y, model.posterior(v))
                known = a[np.arange(len(y)), y.clip(0)]
                fit += float((n * np.where(y >= 0, known, np.logaddexp(a[:, 0], a[:, 1]))).sum())
            sums = sums + pair_counts(v, np.stack([n * (1 - p), n * p], 1))
        if not isinstance(sums, float):
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()]), pa.array([fit])], ["sums", "fit"])

    rows = patterns if model is not None else patterns.where("y >= 0")
    parts = rows.coalesce(32).mapInArrow(count, "sums binary, fit double").collect()  # a few kB a task
    k = parts and round(math.sqrt(len(parts[0]["sums"]) / 8 / 2 / VOTES**2))
    arrays = [np.frombuffer(p["sums"]).reshape(2, k, k, VOTES, VOTES) for p in parts]
    return (sum(arrays) if arrays else None), sum(p["fit"] for p in parts)


def fit_label_model(patterns: DataFrame, tolerance: float = 1e-5) -> LabelModel:
    """Expectation maximisation over (votes, y, n), y being -1 where no label is known.

    It begins with the labelled rows, which also give the tree, and ends when the log likelihood a
    row grows by less than ``tolerance``; it never falls, so that happens.
    """
    counts, _ = _expected(patterns, None)
    parent = correlation_tree(counts)
    model, before = label_model(counts, parent), -math.inf
    while True:
        counts, fit = _expected(patterns, model)
        rows = counts[:, 0, 0].sum()
        if fit - before < tolerance * rows:
            return model
        model, before = label_model(counts, parent), fit


# mining and training


def _mined(texts: DataFrame, terms: int, least_docs: int) -> list[str]:
    """The strongest terms of (text, y): by the likelihood ratio of windows that hold them."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_in(t) for t in batch["text"].to_pylist()]
            least = [min((xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))), default=0) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array([x - 2**63 for x in least]), batch["y"], batch["text"]], ["like", "y", "text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def flush():
            names = ["gram", "toxic", "clean", "docs"]
            columns = [pa.array(list(seen), pa.string()), *[pa.array([s[i] for s in seen.values()], pa.int64()) for i in range(3)]]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist()):
                words, mine = words_in(text), Counter()
                for i in range(0, len(words), WINDOW):
                    mine.update({g for w in set(words[i : i + WINDOW]) for g in grams(w)})
                mine[""] = -(-len(words) // WINDOW)
                for g, n in mine.items():
                    sums = seen.setdefault(g, [0, 0, 0])
                    sums[0 if y else 1] += n
                    sums[2] += 1 if y else 0
                if len(seen) > 300_000:
                    yield flush()
        yield flush()

    # near copies would make all of their words look telling: of texts that look alike, one counts
    rows = texts.mapInArrow(sketch, "like long, y int, text string").groupBy("like", "y").agg(F.min("text").alias("text"))
    sums = rows.mapInArrow(count, "gram string, toxic long, clean long, docs long").groupBy("gram")
    sums = stored(sums.agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "docs")]), "grams")
    every = sums.where("gram = ''").select("toxic", "clean").first()
    if not every or not every[0] or not every[1]:
        return []
    t, c = every

    def part(k, n, q):
        k, n = F.col(k), F.lit(float(n))
        return F.when(k > 0, k * F.log(q)).otherwise(0.0) + F.when(n > k, (n - k) * F.log1p(-q)).otherwise(0.0)

    mean = (F.col("toxic") + F.col("clean")) / F.lit(float(t + c))
    ratio = part("toxic", t, F.col("toxic") / t) + part("clean", c, F.col("clean") / c) - part("toxic", t, mean) - part("clean", c, mean)
    telling = sums.where((F.col("gram") != "") & (F.col("docs") >= least_docs) & (F.col("toxic") / t > 5 * (F.col("clean") + 0.5) / c))
    best = telling.select("gram", ratio.alias("ratio")).where("ratio > 8").orderBy(F.desc("ratio"), F.desc(F.length("gram")), "gram")
    chosen: list[str] = []
    for row in best.limit(20 * terms).collect():
        g = row["gram"]
        if len(chosen) < terms and not any(g.startswith(x) or x.startswith(g.rstrip("$")) for x in chosen):
            chosen.append(g)
    return chosen


def _regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on soft labels; the first column is not held back."""
    held = np.full(x.shape[1], ridge)
    held[0] = 1e-6
    beta = np.zeros(x.shape[1])

    def loss(b):
        z = x @ b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (held * b * b).sum() / 2)

    now = loss(beta)
    while True:
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -60, 60)))
        grad = x.T @ (weight * (p - y)) + held * beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(held), grad)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > now:
            size /= 2
        beta, before, now = beta - size * step, now, min(now, loss(beta - size * step))
        if before - now < 1e-7 * max(1.0, abs(now)):
            return beta


@dataclass(frozen=True)
class ToxicityModel:
    """Terms and the weights of the linear classifier, the first being the constant."""

    terms: list[str]
    weights: np.ndarray
    labels: LabelModel | None = None


def _read(docs: DataFrame, terms: list[str], text_col: str, id_col: str) -> DataFrame:
    """(id, votes, dense, places, amounts) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # bounded by the parameter ``terms``

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = f"toxic-{hash(tuple(shared.value))}"
        drop_states("toxic-", key)
        own = worker_state(key, lambda: Reader(shared.value))
        for batch in batches:
            rows = [own.features(t.as_py()) for t in batch["text"]]
            columns = [
                batch["id"],
                pa.array([own.votes(d, p) for d, p, _ in rows], pa.string()),
                pa.array([d.astype("float32") for d, _, _ in rows], pa.list_(pa.float32())),
                pa.array([p for _, p, _ in rows], pa.list_(pa.int32())),
                pa.array([a.astype("float32") for _, _, a in rows], pa.list_(pa.float32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "votes", "dense", "places", "amounts"])

    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(read, f"id {kind}, votes string, dense array<float>, places array<int>, amounts array<float>")


def _matrix(dense, places, amounts, terms: int) -> np.ndarray:
    x = np.zeros((len(dense), 1 + DENSE + terms))
    x[:, 0] = 1
    for i, (d, p, a) in enumerate(zip(dense, places, amounts)):
        x[i, 1 : 1 + DENSE] = d
        x[i, 1 + DENSE + np.asarray(p, int)] = a
    return x


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = 4000, terms: int = 200, train: int = 3000,
) -> ToxicityModel:
    """Learn from labelled and unlabelled documents.

    ``sample`` bounds the labelled ids of each class (smallest hash) whose whole texts the lexicon is
    mined from, ``terms`` its size, ``train`` the documents of each side of the posterior that the
    linear classifier learns from, weighted by what they stand for. All documents vote. Rows without
    an id or text and labels other than 0 and 1 are not learnt from; an id labelled both ways counts
    as toxic. Without labels of both classes every score is (toxic + 1) / (labelled + 2).
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(quoted(id_col)).isNotNull())
    known = stored(known.groupBy(F.col(quoted(id_col)).alias("id")).agg(F.max(label_col).cast("int").alias("y")), "labels")
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    toxic, every = counts.get(1, 0), sum(counts.values())
    flat = np.zeros(1 + DENSE)
    flat[0] = math.log((toxic + 1) / (every - toxic + 1))
    ids = docs.where(F.length(quoted(text_col)) > 0).select(F.col(quoted(id_col)).alias("id")).distinct().join(known, "id")
    firsts = [ids.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    chosen = stored(firsts[0].unionByName(firsts[1]), "sample")
    texts = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).where("length(text) > 0")
    texts = stored(texts.join(F.broadcast(chosen), "id").select("text", "y"), "texts")  # two samples of ids
    lexicon = _mined(texts, terms, least_docs=3)
    if not lexicon:
        return ToxicityModel([], flat)
    read = _read(docs, lexicon, text_col, id_col).join(known, "id", "left")
    read = stored(read.withColumn("y", F.coalesce("y", F.lit(-1))), "votes")
    patterns = stored(read.groupBy("votes", "y").agg(F.count("*").alias("n")), "patterns")
    model = fit_label_model(patterns)

    @F.pandas_udf("double")
    def posterior(votes: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(np.where(y >= 0, y, model.posterior(_digits(list(votes)))), dtype="float64")

    judged = patterns.withColumn("p", posterior("votes", "y")).select("votes", "y", "p")
    judged = stored(read.join(judged, ["votes", "y"]), "posteriors")
    sides = [judged.where("p >= 0.5"), judged.where("p < 0.5")]
    x, y, weight = [], [], []
    for side in sides:
        stands_for = side.count()
        rows = side.orderBy(F.xxhash64("id"), "id", "votes").limit(train).collect()
        if rows:
            x.append(_matrix(*zip(*[(r["dense"], r["places"], r["amounts"]) for r in rows]), len(lexicon)))
            y += [r["p"] for r in rows]
            weight += [stands_for / len(rows)] * len(rows)
    weight = np.array(weight) * (len(weight) / sum(weight))
    return ToxicityModel(lexicon, _regression(np.concatenate(x), np.array(y), weight), model)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic, from its whole length.

    Null texts count as empty ones, which have the probability of a text without any feature. Other
    columns pass unchanged; a column named ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.weights))

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms, weights = shared.value
        key = f"toxic-{hash(tuple(terms))}"
        drop_states("toxic-", key)
        own = worker_state(key, lambda: Reader(terms))
        for texts in batches:
            odds = []
            for t in texts:
                dense, places, amounts = own.features(t)
                odds.append(weights[0] + dense @ weights[1 : 1 + DENSE] + amounts @ weights[1 + DENSE + places])
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(odds, dtype=float), -60, 60))), dtype="float64")

    return docs.withColumn(out, probability(F.col(quoted(text_col))))
