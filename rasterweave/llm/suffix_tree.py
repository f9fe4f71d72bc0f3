"""Language-model scores from a probabilistic suffix tree over words.

Words are lower-cased (A-Z) and separated by ASCII white space; every text ends with one end token.
The root gives a word seen c times the probability (c + 1) / (N + V + 1), N being all training tokens
and V the distinct ones; words never seen share the same formula with c = 0.

States are contexts of one to ``depth`` words. A context is a candidate if it makes up at least
``context`` of all tokens, which bounds their number; it is kept if its next-symbol distribution
diverges from that of its suffix (by its likelihood gain in nats), or if a longer kept state ends in
it. Distributions are smoothed towards the suffix's by Witten and Bell's rule. Symbols are the words
that make up at least ``symbol`` of the tokens, the end, and one symbol for all other words, which
share its probability as the root has it. A token is scored in the longest kept state that ends
before it.

The contexts above are the tree's head, bounded by their shares and held by the tasks. Its tail grows
with the corpus and stays in tables: every other word that occurs at least ``least`` times is a state
too if its next words diverge from the root. A tail state w stores the next words v seen at least
``least`` times; ``rest`` is what is left of its c(w) occurrences, ``kinds`` the number of stored ones:

    p(v | w) = (c(w, v) + (kinds + 2 rest) root(v)) / (c(w) + kinds + rest)

So a token after w costs the root's share of it, a factor that depends on w alone and, if (w, v) is
stored, one that depends on the pair; texts meet these factors by joins on words and on pairs.

All counts cover all training texts. Pairs and rare words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.common import drop_states, mixed, quoted, stored, words_of, worker_state

#: the end token; no word is empty
END = b""
#: bits of the filter before the join on pairs
SKETCH = 1 << 26


@dataclass(frozen=True)
class SuffixTree:
    """``vocabulary`` (word, c, state) of all words, state being the log10 factor of a tail state, and
    ``pairs`` (pair, more) of all tail states grow with the corpus; ``parts`` is bounded and goes to the tasks."""

    vocabulary: DataFrame
    pairs: DataFrame
    tokens: int
    distinct: int
    parts: dict


def _ids(texts, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """Word ids (-1: not in ``known``) of texts, an end after each, where a text starts, codes (the id
    of a known word and the 64-bit hash of any other), and each text's words that are not known."""
    rows, others, lost = [], [], []
    for t in texts:
        words = words_of(t)
        words.append(END)
        rows.append(np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words)))
        lost.append([words[i] for i in np.flatnonzero(rows[-1] < 0).tolist()])
        others.append(np.array([xxhash.xxh64_intdigest(w) for w in lost[-1]], np.uint64))
    ids = np.concatenate(rows)
    first = np.zeros(len(ids), bool)
    first[np.cumsum([0, *map(len, rows)])[:-1]] = True
    codes = ids.view(np.uint64).copy()
    codes[ids < 0] = np.concatenate(others)
    return ids, first, codes, lost


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(mixed(a) + np.uint64(0x9E3779B97F4A7C15) * b)


def _in_tail(ids: np.ndarray, first: np.ndarray, contexts: int) -> np.ndarray:
    """Tokens after a word that is no context of the head."""
    before = np.concatenate([[0], ids[:-1]])
    return ~first & ((before < 0) | (before >= contexts))


def _symbols(ids: np.ndarray, symbols: int) -> np.ndarray:
    return np.where((ids >= 0) & (ids < symbols), ids, symbols)


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted value in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted).clip(max=len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _states(ids: np.ndarray, first: np.ndarray, parts: dict) -> list[np.ndarray]:
    """The candidate context of each length that ends before each token, or -1."""
    sym = _symbols(ids, parts["symbols"])
    before = np.concatenate([[-1], ids[:-1]])
    usable = ~first & (before >= 0) & (before < parts["contexts"])
    out = [np.where(usable, before, -1)]
    for keys in parts["keys"]:
        older = np.concatenate([[-1], out[-1][:-1]])  # the shorter context one token earlier
        code = older * (parts["symbols"] + 1) + np.concatenate([[0], sym[:-1]])
        out.append(np.where(usable & (older >= 0), _found(keys, code), -1))
    return out


def _counted(docs: DataFrame, parts: dict) -> DataFrame:
    """(code, c) of the longest candidate contexts and their next symbols, over all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known = {w: i for i, w in enumerate(own["words"])}
        codes, sums, fresh, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged():
            every = np.concatenate([codes, *fresh])
            weights = np.concatenate([sums, np.ones(len(every) - len(codes), np.int64)])
            keys, at = np.unique(every, return_inverse=True)
            return keys, np.bincount(at, weights, len(keys)).astype(np.int64)

        for batch in batches:
            texts = batch["text"].to_pylist()
            for start in range(0, len(texts), 500):
                ids, first, _, _ = _ids(texts[start : start + 500], known)
                state = _states(ids, first, own)[-1]
                held = state >= 0
                fresh.append(state[held] * (own["symbols"] + 1) + _symbols(ids, own["symbols"])[held])
                size += len(fresh[-1])
                if size > 1_000_000:
                    codes, sums = merged()
                    fresh, size = [], 0
                    if len(codes) > 2_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], ["code", "c"])
                        codes, sums = codes[:0], sums[:0]
        codes, sums = merged()
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], ["code", "c"])

    rows = docs.select("text").mapInArrow(count, "code long, c long")
    return stored(rows.groupBy("code").agg(F.sum("c").alias("c")), "contexts")


def _tail_counts(docs: DataFrame, parts: dict, least: int) -> DataFrame:
    """(a, b, pair, c) of the words after tail words, seen at least ``least`` times."""
    shared = docs.sparkSession.sparkContext.broadcast((parts["words"], parts["contexts"]))  # at most 1 / word of them

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, contexts = shared.value
        known = {w: i for i, w in enumerate(words)}
        held, size = [], 0

        def flush():
            a, b, n = (np.concatenate(x) for x in zip(*held))
            _, at, to = np.unique(_pair(a, b), return_index=True, return_inverse=True)
            return a[at], b[at], np.bincount(to, n, len(at)).astype(np.int64)

        def batch_of(a, b, n):
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n)], ["a", "b", "c"])

        for batch in batches:
            texts = batch["text"].to_pylist()
            for start in range(0, len(texts), 500):
                ids, first, codes, _ = _ids(texts[start : start + 500], known)
                tail = np.flatnonzero(_in_tail(ids, first, contexts))
                held.append((codes[tail - 1], codes[tail], np.ones(len(tail), np.int64)))
                size += len(tail)
                if size > 3_000_000:
                    held = [flush()]
                    size = len(held[0][0])
                    if size > 2_000_000:
                        yield batch_of(*held[0])
                        held, size = [], 0
        if held:
            yield batch_of(*flush())

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch[c].to_numpy(zero_copy_only=False).view(np.uint64) for c in "ab")
            yield batch.append_column("pair", pa.array(_pair(a, b).view(np.int64)))

    rows = docs.select("text").mapInArrow(count, "a long, b long, c long")
    rows = rows.groupBy("a", "b").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    return stored(rows.mapInArrow(keyed, "a long, b long, c long, pair long"), "tail")


def _coded(vocabulary: DataFrame, parts: dict) -> DataFrame:
    """(code, n) of all words."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(parts["words"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: i for i, w in enumerate(shared.value)}
        for batch in batches:
            words = batch["word"].to_pylist()
            codes = np.array([known[w] if w in known else xxhash.xxh64_intdigest(w) for w in words], np.uint64)
            yield batch.append_column("code", pa.array(codes.view(np.int64)))

    return stored(vocabulary.select("word", "c").mapInArrow(code, "word binary, c long, code long"), "coded")


def _sketch(pairs: DataFrame) -> np.ndarray:
    """Bits of a filter of fixed size (2^26 bits, 8 MB) that every pair passes; others mostly do not.

    It spares shuffles and decides nothing: what passes is joined with the pairs themselves, and a
    corpus that fills it up costs more but gives the same scores."""
    at = F.col("pair").bitwiseAND(SKETCH - 1)
    bits = pairs.groupBy((F.shiftright(at, 6)).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pair & 63 as int))")).alias("bits"))
    rows = bits.toArrow()  # at most SKETCH / 64 rows of 16 bytes
    out = np.zeros(SKETCH // 64, np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _passes(sketch: np.ndarray, pair: np.ndarray) -> np.ndarray:
    at = pair & np.uint64(SKETCH - 1)
    return (sketch[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _tail(docs: DataFrame, vocabulary: DataFrame, parts: dict, least: int, gain: float) -> tuple[DataFrame, DataFrame]:
    """The vocabulary with every tail state's factor, and (pair, more) of the pairs of tail states."""
    vocabulary = _coded(vocabulary, parts)
    coded = vocabulary.select("code", F.col("c").alias("n"))
    pairs = _tail_counts(docs, parts, least).join(coded, F.col("b") == F.col("code")).select(
        "a", "pair", "c", ((F.col("n") + 1) / F.lit(float(parts["norm"]))).alias("root")
    )
    sums = pairs.groupBy("a").agg(F.sum("c").alias("held"), F.count("*").alias("kinds"), F.sum(F.col("c") * F.ln(F.col("c") / F.col("root"))).alias("fit"))
    states = coded.join(sums, F.col("a") == F.col("code")).where(F.col("fit") - F.col("held") * F.ln("n") >= gain)
    down = F.col("kinds") + 2 * (F.col("n") - F.col("held"))
    total = F.col("n") + F.col("kinds") + F.col("n") - F.col("held")
    states = stored(states.select("code", down.cast("double").alias("down"), F.log10(down / total).alias("state")), "tail-states")
    more = pairs.join(states, F.col("a") == F.col("code")).select("pair", F.log10(1 + F.col("c") / (F.col("down") * F.col("root"))).alias("more"))
    full = vocabulary.join(states, "code", "left").select("word", "c", F.coalesce("state", F.lit(0.0)).alias("state"))
    return stored(full, "words"), stored(more, "pairs")


def _vocabulary(docs: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for t in batch["text"]:
                seen.update(words_of(t.as_py()))
                seen[END] += 1
                if len(seen) > 400_000:
                    yield flush()
                    seen.clear()
        yield flush()

    rows = docs.select("text").mapInArrow(count, "word binary, c long")
    return stored(rows.groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")


def fit(
    docs: DataFrame,
    text_col: str = "text",
    depth: int = 3,
    context: float = 1e-4,
    symbol: float = 1e-5,
    word: float = 1e-6,
    entry: float = 5e-7,
    gain: float = 20.0,
    least: int = 2,
) -> SuffixTree:
    """Learn the tree from every row of ``docs``; null and empty texts are an end token each.

    Shares of all tokens: ``context`` for a state, ``symbol`` for a next symbol, ``word`` for a word
    whose count the tasks know, ``entry`` for a pair of state and symbol that is stored with it.
    Their inverses bound what is held in memory. ``gain`` is the least likelihood gain of a kept
    state, ``least`` the count that a pair of the tail needs; neither is a share, so the tail grows with
    the texts. Repeated rows count each time; without rows every token has probability 1.
    """
    if not 0 < word <= symbol <= context:
        raise ValueError("shares must not fall from words to symbols to contexts")
    if least < 2:
        raise ValueError("a pair seen once says nothing about its state")
    texts = docs.select(F.col(quoted(text_col)).alias("text"))
    vocabulary = _vocabulary(texts)
    row = vocabulary.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    distinct, tokens = int(row[0]), int(row[1])
    known = vocabulary.where(F.col("c") >= word * tokens).collect()  # at most 1 / word rows
    known.sort(key=lambda r: (-r["c"], bytes(r["word"])))
    counts = np.array([r["c"] for r in known], np.int64)
    parts = {
        "words": [bytes(r["word"]) for r in known],
        "counts": counts,
        "symbols": int((counts >= symbol * tokens).sum()),
        "contexts": int((counts >= context * tokens).sum()),
        "keys": [],
        "states": [],
        "norm": tokens + distinct + 1,
    }
    base = parts["symbols"] + 1
    root = np.append((counts[: base - 1] + 1) / parts["norm"], 0.0)
    parts["other"] = root[-1] = max(1 - root.sum(), 1 / parts["norm"]) if tokens else 1.0
    levels = []
    parents = np.zeros(0, np.int64)
    for length in range(1, depth + 1):
        nodes = parts["contexts"] if length == 1 else len(parts["keys"][-1])
        if not nodes:
            break
        table = _counted(texts, parts)
        totals = table.groupBy(F.expr(f"code div {base}").alias("node")).agg(F.sum("c").alias("c"), F.count("*").alias("kinds")).collect()
        entries = table.where(F.col("c") >= max(2.0, entry * tokens)).toPandas().sort_values("code")
        level = {"code": entries["code"].to_numpy(np.int64), "c": entries["c"].to_numpy(np.int64), "total": np.zeros(nodes), "kinds": np.zeros(nodes)}
        for r in totals:
            level["total"][r["node"]], level["kinds"][r["node"]] = r["c"], r["kinds"]
        level["rest"] = level["total"] - np.bincount(level["code"] // base, level["c"], nodes)
        level["parent"] = parents
        levels.append(level)
        # contexts one word longer are the frequent pairs of a context and a word after it
        sym = level["code"] % base
        longer = level["code"][(level["c"] >= max(2.0, context * tokens)) & (sym < parts["contexts"])]
        longer = longer[longer % base != (parts["words"].index(END) if END in parts["words"] else -1)]
        if length == 1:
            parents = longer % base
        else:
            parents = _found(parts["keys"][-1], level["parent"][longer // base] * base + longer % base)
        longer, parents = longer[parents >= 0], parents[parents >= 0]
        if length < depth:
            parts["keys"].append(longer)
    _keep(levels, root, base, gain)
    parts["keys"] = parts["keys"][: max(0, len(levels) - 1)]
    parts["states"] = levels
    full, pairs = _tail(texts, vocabulary, parts, least, gain)
    factors = full.where((F.col("c") >= word * tokens) & (F.col("state") != 0)).select("word", "state").collect()  # known words again
    at = {w: i for i, w in enumerate(parts["words"])}
    parts["tail"] = np.zeros(len(at) + 1)
    for r in factors:
        parts["tail"][at[bytes(r["word"])]] = r["state"]
    parts["sketch"] = _sketch(pairs)
    return SuffixTree(full, pairs, tokens, distinct, parts)


def _probability(levels: list[dict], level: int, node: np.ndarray, sym: np.ndarray, root: np.ndarray, base: int) -> np.ndarray:
    """Smoothed probability of symbols in candidate states of one length, kept or not."""
    if level < 0:
        return root[sym]
    own = levels[level]
    up = own["parent"][node] if level else node
    below = _probability(levels, level - 1, up, sym, root, base)
    return _smoothed(own, node, node * base + sym, below)


def _smoothed(own: dict, node: np.ndarray, code: np.ndarray, below: np.ndarray) -> np.ndarray:
    at = _found(own["code"], code)
    c = np.where(at >= 0, own["c"][at] if len(own["c"]) else 0, 0)
    total, kinds = own["total"][node], own["kinds"][node]
    return (c + (own["rest"][node] + kinds) * below) / np.maximum(total + kinds, 1)


def _keep(levels: list[dict], root: np.ndarray, base: int, gain: float) -> None:
    """Mark the states that diverge from their suffix, and the suffixes of such states."""
    for k, own in enumerate(levels):
        node, sym = own["code"] // base, own["code"] % base
        up = own["parent"][node] if k else node
        below = _probability(levels, k - 1, up, sym, root, base)
        ratio = np.log(own["c"] / np.maximum(own["total"][node], 1) / below)
        own["kept"] = np.bincount(node, own["c"] * ratio, len(own["total"])) >= gain
    for k in range(len(levels) - 1, 0, -1):
        suffix = levels[k]["parent"][levels[k]["kept"]]
        levels[k - 1]["kept"][suffix] = True


def score(docs: DataFrame, model: SuffixTree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score), a row for each row of ``docs``.

    ``score`` is the tree's log10 probability of the whole text with its end, ``base_score`` the
    root's. Null and empty texts are the end alone. Null and repeated ids stay as they are; other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.parts)  # bounded by the shares given to fit()
    fields = "doc {}, n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,n:long>>, pairs array<long>"
    rows = docs.select(F.col(quoted(id_col)).alias("doc"), F.col(quoted(text_col)).alias("text"))
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        key = f"tree-{id(own)}"
        drop_states("tree-", key)
        known = worker_state(key, lambda: {w: i for i, w in enumerate(own["words"])})
        logs = np.log10((np.append(own["counts"], 0) + 1) / own["norm"])  # the last is for id -1
        base = own["symbols"] + 1
        root = np.append(10 ** logs[: base - 1], own["other"])
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = part["text"].to_pylist()
                ids, first, codes, lost = _ids(texts, known)
                begins = np.flatnonzero(first)
                sym = _symbols(ids, own["symbols"])
                p = root[sym]
                for state, level in zip(_states(ids, first, own), own["states"]):
                    held = state >= 0
                    held[held] = level["kept"][state[held]]
                    p[held] = _smoothed(level, state[held], state[held] * base + sym[held], p[held])
                unseen = ids < 0
                plain = np.where(unseen, 0.0, logs[ids])
                # a word outside the symbols has its share, by the root, of their common probability
                full = np.log10(p) + np.where(sym == own["symbols"], plain - np.log10(own["other"]), 0.0)
                full += np.where(unseen, 0.0, own["tail"][ids])  # its state is left by the next token
                met = np.flatnonzero(_in_tail(ids, first, own["contexts"]))
                pair = _pair(codes[met - 1], codes[met])
                passed = _passes(own["sketch"], pair)
                ends = np.searchsorted(met[passed], np.append(begins, len(ids)))
                met = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pair[passed].view(np.int64)))
                add = lambda x: np.add.reduceat(x, begins)
                rare = [[{"word": w, "n": n} for w, n in Counter(words).items()] for words in lost]
                sizes = np.diff(np.append(begins, len(ids)))
                yield pa.RecordBatch.from_arrays(
                    [part["doc"], pa.array(sizes), pa.array(add((~unseen).astype(np.int64))), pa.array(add(plain)), pa.array(add(full)), pa.array(rare, rare_type), met],
                    ["doc", "n_tokens", "n_known", "base", "score", "rare", "pairs"],
                )

    made = rows.mapInArrow(judge, fields.format(rows.schema["doc"].dataType.simpleString()))
    made = stored(made.withColumn("row", F.monotonically_increasing_id()), "judged")
    lost = made.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    log = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(model.parts["norm"])))
    by_word = lost.join(model.vocabulary, "word", "left").select(
        "row", (F.col("n") * log).alias("base"), (F.col("n") * (log + F.coalesce("state", F.lit(0.0)))).alias("more"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("seen")
    )
    met = made.select("row", F.explode("pairs").alias("pair")).join(model.pairs, "pair")
    by_pair = met.select("row", F.lit(0.0).alias("base"), "more", F.lit(0).cast("long").alias("seen"))
    sums = by_word.unionByName(by_pair).groupBy("row").agg(F.sum("base").alias("lost"), F.sum("more").alias("more"), F.sum("seen").alias("seen"))
    zero = F.lit(0.0)
    return made.drop("rare", "pairs").join(sums, "row", "left").select(
        F.col("doc").alias("doc_id"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("lost", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("more", zero)).alias("score"),
    )
