"""Spelling variants: words of a corpus that are one edit apart, found by composing automata.

The vocabulary's acceptor A is composed with a one-edit transducer T and with A again; the pairs that
A o T o A accepts are the near words. The composition is never built whole. Two words one edit apart
share the first or the last half of the shorter one (m code points), so every word is dealt to the
states that A, and the acceptor of the reversed words, reach by such halves; each state is the initial
state of a partition, with minimised acceptors of the words of m and of m + 1 code points that go on
from there. A partition with more words than ``LIMIT`` moves on to its states one code point further;
pairs that are edited just there leave the same remainder and meet by it.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.common import LOWER_BYTES, quoted, stored

#: maximal runs of letters are words
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: distinct words that a task counts before it hands them on
HELD = 400_000
#: words of a partition; there are at most 91 continuations of a state, so it can always be split
LIMIT = 20_000


def typos(runs: Counter, doc_id: int | None) -> Counter:
    """Counts of a document's lower-cased runs after the rule that drops code points.

    Of a run whose unsigned crc32 h of ``<doc_id>:<run>`` in UTF-8 is divisible by 97, the code point
    h % length goes; a null id is the empty text.
    """
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    moved = []
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), head)
        if h % 97 == 0:
            moved.append((run, h % len(run), n))
    for run, _, _ in moved:
        del runs[run]
    for run, at, n in moved:
        runs[run[:at] + run[at + 1 :]] += n
    return runs


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least: int = 3
) -> DataFrame:
    """(word, n) of all words of at least ``least_chars`` code points and ``least`` occurrences.

    Words are the runs of :data:`RUN` with A-Z lower-cased, changed as :func:`typos` says. Null and
    empty texts have none; rows that repeat count each time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            rows = [(w, n) for w, n in seen.items() if len(w) >= least_chars]
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for doc_id, text in zip(batch[0].to_pylist(), batch[1]):
                text = text.as_py()
                if text:
                    lowered = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES)
                    runs = Counter(RUN.findall(lowered.decode("utf-8", "surrogatepass")))
                    seen.update(typos(runs, doc_id))
                    if len(seen) > HELD:
                        yield flush()
        yield flush()

    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    counts = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least)


class Acceptors:
    """Minimised acceptors of sorted lists of distinct words, each of one length, over shared states.

    ``out`` has the (code point, state, skipped) arcs of a state in code-point order; ``skipped``
    counts the words by earlier arcs, so the sum along a path is the word's place in its list. State 0
    accepts and ends every word. States with one right language are one, also between lists.
    """

    def __init__(self) -> None:
        self.register: dict[tuple, int] = {(): 0}
        self.out: list[tuple] = [()]
        self.size = [1]
        self.common: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _state(self, arcs: list) -> int:
        key = tuple(arcs)
        state = self.register.get(key)
        if state is None:
            state = self.register[key] = len(self.out)
            total, out = 0, []
            for c, to in key:
                out.append((c, to, total))
                total += self.size[to]
            self.out.append(tuple(out))
            self.size.append(total)
        return state

    def _close(self, path: list[list], word: str, depth: int) -> None:
        """Register the states of ``word`` below ``depth`` and tie them to those above."""
        for at in range(len(word), depth, -1):
            arcs = path.pop()
            path[at - 1].append((word[at - 1], self._state(arcs)))

    def add(self, words: list[str]) -> int:
        """Initial state of a list with words."""
        path: list[list] = [[]]  # arcs of the states along the last word, not yet registered
        last = ""
        for word in words:
            same = 0
            while same < len(last) and last[same] == word[same]:
                same += 1
            self._close(path, last, same)
            path.extend([] for _ in range(len(word) - same))
            last = word
        self._close(path, last, 0)
        return self._state(path[0])

    def both(self, a: int, b: int) -> list[tuple[int, int]]:
        """Places, from each state, of what both accept: the composition after the edit."""
        if a == b:
            return [(k, k) for k in range(self.size[a])]
        known = self.common.get((a, b))
        if known is None:
            others = {c: (to, skipped) for c, to, skipped in self.out[b]}
            known = []
            for c, to, skipped in self.out[a]:
                if c in others:
                    other, more = others[c]
                    known += [(skipped + i, more + j) for i, j in self.both(to, other)]
            self.common[a, b] = known
        return known


def accepted(short: list[str], long: list[str], first: int = 0) -> Iterator[tuple[int, int, bool]]:
    """(i, j, inserted): places of words one edit apart, in ``short`` and in ``short`` or ``long``.

    Both lists are sorted, without repeats, and of one length each, the second one code point
    longer. Edits are looked for at place ``first`` or later (where it is not 0: inserting, behind
    it). A pair comes once, since an inserted code point counts as the last of a run of its equals.
    """
    if not short:
        return
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 2 * len(short[0]) + 1000))
    own = Acceptors()
    # the two copies of A are in step before the edit: one prefix, a state of each list
    stack = [(0, own.add(short), 0, own.add(long) if long else -1, 0)]
    while stack:
        depth, p, i, q, j = stack.pop()
        arcs, longer = own.out[p], own.out[q] if q >= 0 else ()
        if depth >= first:
            for (_, x, more), (_, y, further) in combinations(arcs, 2):
                for k, n in own.both(x, y):
                    yield i + more + k, i + further + n, False
        if depth > first or not first:
            for d, y, further in longer:
                if not p:
                    yield i, j + further, True
                others = {c: (to, skipped) for c, to, skipped in own.out[y]} if p else {}
                for c, x, more in arcs:
                    if c != d and c in others:
                        to, skipped = others[c]
                        for k, n in own.both(x, to):
                            yield i + more + k, j + further + skipped + n, True
        ways = {d: (y, further) for d, y, further in longer}
        for c, x, more in arcs:
            y, further = ways.get(c, (-1, 0))
            stack.append((depth + 1, x, i + more, y, j + further))


def _near_in(kind: str, m: int, cut: int, words: dict[str, int]) -> Iterator[tuple[str, str]]:
    """Pairs of one partition; ``words`` share their first ``cut`` code points (``x``: all but one)."""
    short, long = (sorted(w for w in words if len(w) == k) for k in (m, m + 1))
    if kind == "f" or kind == "b":
        # of the pairs in which both halves are shared, the forward partition has the pair
        first = 0 if kind == "f" else max(0, m - m // 2 - cut)
        for i, j, inserted in accepted([w[cut:] for w in short], [w[cut:] for w in long], first):
            x, y = short[i], (long if inserted else short)[j]
            if kind == "f" or x[::-1][: m // 2] != y[::-1][: m // 2]:
                yield x, y
        return
    for x, y in combinations(short, 2) if kind[1] == "r" else ((x, y) for x in short for y in long):
        if kind[1] == "r" or x[cut : cut + 1] != y[cut]:
            if kind[0] == "f" or x[::-1][: m // 2] != y[::-1][: m // 2]:
                yield x, y


def _partitions(words: DataFrame, limit: int) -> DataFrame:
    """(kind, m, cut, head, rest, t, n): every word in the partitions of its pairs.

    ``t`` is the word, reversed for kinds that begin with ``b``; ``head`` its first ``cut`` code points.
    """
    at = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")
    sides = F.explode(F.array(
        F.struct(F.lit("f").alias("kind"), F.col("word").alias("t")), F.struct(F.lit("b").alias("kind"), F.reverse("word").alias("t"))
    )).alias("side")
    rows = words.select("word", "n", at).where("m > 0").select("m", "n", sides).select("m", "n", "side.kind", "side.t")
    rows = rows.select("kind", "m", F.expr("m div 2").cast("int").alias("cut"), "t", "n", F.lit("").alias("rest"))
    key, done = ["kind", "m", "cut", "head"], None
    while True:
        rows = stored(rows.withColumn("head", F.expr("substring(t, 1, cut)")), "partitions")
        large = stored(rows.groupBy(*key).count().where(F.col("count") > limit).select(*key), "large")
        none = large.isEmpty()
        small = rows if none else rows.join(large, key, "left_anti")
        done = small if done is None else done.unionByName(small)
        if none:
            return done
        split = rows.join(large, key, "left_semi")
        behind = "substring(t, cut + 2, length(t))"
        here = "substring(t, cut + 1, length(t))"
        met = F.explode(F.expr(
            f"if(length(t) = m, array(struct(concat(kind, 'r') as kind, {behind} as rest), struct(concat(kind, 'i') as kind, {here} as rest)),"
            f" array(struct(concat(kind, 'i') as kind, {behind} as rest)))"
        )).alias("met")
        met = split.select("m", "cut", "t", "n", "head", met).select("m", "cut", "t", "n", "head", "met.*")
        done = done.unionByName(met)
        rows = split.withColumn("cut", F.col("cut") + 1).drop("head")


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n_near, best_n, best) of the words of (word, n) that have near words.

    ``best`` is the near word with the largest n, of several the first in code-point order.
    """
    key = ["kind", "m", "cut", "head", "rest"]

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}

        def flush():
            rows = [(w, *x) for w, x in found.items()]
            found.clear()
            types = (pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "best_n", "best"])

        def noted(x, y, n):
            have = found.get(x)
            if have is None:
                found[x] = [1, n, y]
            else:
                have[0] += 1
                if n > have[1] or n == have[1] and y < have[2]:
                    have[1], have[2] = n, y

        every = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in [*key, "t", "n"])))
        for (kind, m, cut, _, _), rows in groupby(every, lambda r: r[:5]):
            own = {r[5]: r[6] for r in rows}
            if len(own) > 1:
                back = kind[0] == "b"
                for x, y in _near_in(kind, m, cut, own):
                    a, b = (x[::-1], y[::-1]) if back else (x, y)
                    noted(a, b, own[y])
                    noted(b, a, own[x])
                if len(found) > 100_000:
                    yield flush()
        yield flush()

    parts = _partitions(words, limit).repartition(*key).sortWithinPartitions(*key)
    rows = parts.select(*key, "t", "n").mapInArrow(compose, "word string, n_near long, best_n long, best string")
    order = F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("first")
    rows = rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), order)
    return rows.select("word", "n_near", (-F.col("first.n")).alias("best_n"), F.col("first.best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for the (word, form) links of a forest: where following the forms ends.

    Every round doubles the steps that a pointer takes, so chains of k forms need about log2(k).
    """
    open_, ended = stored(links.select("word", F.col("form").alias("root")), "pointers"), None
    while True:
        on = open_ if ended is None else open_.unionByName(ended)
        on = on.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = open_.join(on, "root", "left")
        moved = stored(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "pointers")
        still = moved.where("on").select("word", "root")
        now = moved.where("NOT on").select("word", "root")
        ended = now if ended is None else ended.unionByName(now)
        if still.isEmpty():
            return ended
        open_ = still


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least: int = 3,
    ratio: int = 2, limit: int = LIMIT,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of a corpus grouped by spelling.

    Words and their counts are those of :func:`word_counts`. Near words differ by exactly one
    inserted, deleted or replaced code point; a word's form is its near word of largest n (ties: first
    in code-point order) if that n is at least ``ratio`` times its own, the root is where following
    the forms ends. Tables without rows or words give no rows. Other columns are not read.
    """
    words = stored(word_counts(docs, id_col, text_col, least_chars, least), "words")
    near = near_words(words, limit)
    named = F.col("best_n") >= F.col("n") * ratio
    rows = words.join(near, "word", "left").select(
        "word", "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(named, F.col("best")).alias("form"),
        F.when(named, F.col("best_n")).alias("form_n"),
    )
    rows = stored(rows, "forms")
    ends = roots(rows.where("form IS NOT NULL").select("word", "form"))
    rows = rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return rows.select("word", "form", "root", "n", "n_near", "form_n")
