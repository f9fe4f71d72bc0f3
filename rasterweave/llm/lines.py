"""Line deduplication over a corpus: equal lines and lines few edits apart.

A line is dropped if an earlier line is equal to it or one edit (a character inserted, deleted or
replaced) away; with ``every``, as many edits as the longer line has times ``every`` characters. Lines are ordered by document id, hash of the text and line number. Shorter lines
than ``min_chars`` are never compared by edits, and shorter ones than ``exact_chars`` (``min_chars``
unless given) never count.

Equal lines are grouped by a 128-bit hash first. For the rest, a line is cut into threshold-plus-one,
that is two, segments: of two lines one edit apart, one segment is the same in both, at the start or
at the end. The shorter line of a pair (or either, at equal length) is indexed by (length, segment,
text of the segment); the other probes with the substrings that a line of its own or the next
smaller length can share. Pairs that meet are verified by Spark's banded ``levenshtein``.

Where many lines share a segment, their pairs are never listed: the other segment is keyed once more
by what is left of it without one character. Lines that share such a key at the same place are one
edit apart by construction, so the first of them decides for all.

With ``every``, a line is keyed by the least hashes of its grams, up to a bound below which it has k + 1
disjoint grams, k being the most edits that a line near it can have. An edit touches one of disjoint
grams, so a near line has one of them too, and of two near lines the one with the smaller bound finds
it among the other's keys, at a place few characters off. A line without so many grams has all of them as keys; k edits leave a run
of known least length as it is, and grams are no longer than that. No pair is missed. Lines meet by key and class
of length, where crowded after the pairs with the first line, and all pairs left are verified. Keys are dealt
to rounds, and the pairs of one round are stored before the next is shuffled, so that not all keys are on disk at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.common import mixed, quoted, stored

#: largest group whose pairs are verified one by one; rows of a table that is broadcast at most
CROWD, BROADCAST_ROWS = 32, 200_000
#: grams are counted in pieces of so many characters; lines are keyed so many characters at a time
PIECE, CHARS = 4096, 1 << 20
#: bounds of hashes
LEVELS = [np.uint64(int(2**64 * 0.03 * 1.2**i)) for i in range(20)] + [np.uint64(2**64 - 1)]
#: keys a round, and rounds at most
ROUND, ROUNDS = 4_000_000, 16


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, line, ord) of every line that counts."""
    text = F.col(quoted(text_col))
    each = docs.select(
        F.col(quoted(id_col)).alias("doc"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("no", "line")
    )
    return each.where(F.length("line") >= min_chars).select(
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "line", F.struct("doc", "th", "no").alias("ord")
    )


def _segments() -> list[tuple[bool, int, Column, Column]]:
    """Index and probe segments of a line: whether indexed, the side, its key and its size."""
    n = F.length("line")
    out = []
    for gap in (0, 1):  # how much longer the line is than the lines it looks for
        size = n - gap
        head, tail = F.floor(size / 2).cast("int"), (size - F.floor(size / 2)).cast("int")
        parts = ((0, F.substring(F.col("line"), F.lit(1), head), head), (1, F.substring(F.col("line"), n - tail + 1, tail), tail))
        out += [(gap == 0, side, F.xxhash64(F.lit(side), size, part), length) for side, part, length in parts]
    return out


def _without_one(part: Column) -> Column:
    """(place, rest): a segment without each of its characters in turn, and whole (place 0)."""
    each = F.transform(
        F.sequence(F.lit(1), F.length(part)),
        lambda i: F.struct(i.alias("place"), F.concat(F.substring(part, F.lit(1), i - 1), F.substring(part, i + 1, F.length(part))).alias("rest")),
    )
    whole = F.array(F.struct(F.lit(0).alias("place"), part.alias("rest")))
    return F.concat(whole, F.when(F.length(part) > 0, each).otherwise(F.array_remove(whole, whole[0])))


def _near_by_one(lines: DataFrame, min_chars: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """The distinct lines, and (id) of those one edit away from an earlier one."""
    # lines travel as hashes and keys; their text only where a segment is shared
    segments = _segments()
    keys = [key.alias(f"k{i}") for i, (_, _, key, _) in enumerate(segments)]
    names = [f"k{i}" for i in range(len(keys))]
    firsts = lines.select("h1", "h2", "ord", F.length("line").alias("size"), *keys)
    least = F.min(F.struct("ord", "size", *names)).alias("m")  # equal lines have equal keys
    distinct = firsts.groupBy("h1", "h2").agg(least, F.count("*").alias("n")).select("h1", "h2", "n", "m.*")
    distinct = stored(distinct.withColumn("id", F.monotonically_increasing_id()), "lines")
    each = F.array(*[F.struct(F.col(f"k{i}").alias("key"), F.lit(i).alias("k")) for i in range(len(keys))])
    keyed = distinct.where(F.col("size") >= min_chars).select("id", F.explode(each).alias("e")).select("id", "e.*")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("k").alias("first")).where("m > 1 and first < 2")
    shared = stored(keyed.join(sizes.select("key", "m"), "key"), "shared")
    wanted = distinct.join(shared.select("id").distinct(), "id").select("h1", "h2", "id", F.col("ord").alias("first"))
    wanted = stored(wanted, "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = lines.join(wanted, ["h1", "h2"]).where("ord = first").select("id", "ord", "line")
    texts = stored(texts.dropDuplicates(["id"]), "texts")  # repeated rows have equal places
    indexed, half = F.col("k") < 2, F.floor((F.length("line") - F.when(F.col("k") < 2, 0).otherwise(1)) / 2)

    # few lines: verify the pairs of an indexed and any other line
    few = shared.where(F.col("m") <= crowd)
    pairs = (
        few.where(indexed).select("key", F.col("id").alias("a"))
        .join(few.select("key", F.col("id").alias("b")), "key")
        .where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    first = texts.select(F.col("id").alias("a"), F.col("ord").alias("oa"), F.col("line").alias("la"))
    second = texts.select(F.col("id").alias("b"), F.col("ord").alias("ob"), F.col("line").alias("lb"))
    near = pairs.join(first, "a").join(second, "b").where(F.levenshtein("la", "lb", 1) >= 0)
    by_pairs = near.select(F.when(F.col("oa") < F.col("ob"), F.col("b")).otherwise(F.col("a")).alias("id"))

    # many lines: the other segment without one character
    many = shared.where(F.col("m") > crowd).join(texts, "id")
    other = F.when(F.col("k") % 2 == 0, F.expr("substring(line, cast(half as int) + 1, length(line))")).otherwise(
        F.expr("substring(line, 1, cast(half as int) + if(k < 2, 0, 1))")
    )
    many = many.withColumn("half", half).withColumn("indexed", indexed)
    # lines as long as those indexed show every place and the whole; longer ones only what is left of them
    parts = many.select("key", "indexed", "id", "ord", F.explode(_without_one(other)).alias("p"))
    parts = parts.where("indexed or p.place > 0")
    rest = F.xxhash64("p.place", "p.rest")
    replaced = parts.where("indexed and p.place > 0").select("key", rest.alias("rest"), "id", "ord")
    least = replaced.groupBy("key", "rest").agg(F.min("ord").alias("least"), F.count("*").alias("c")).where("c > 1")
    by_place = replaced.join(least, ["key", "rest"]).where("ord > least").select("id")
    shorter = parts.where("indexed and p.place = 0").select("key", "p.rest", F.col("id").alias("short"), F.col("ord").alias("so"))
    longer = parts.where("not indexed").select("key", "p.rest", F.col("id").alias("long"), F.col("ord").alias("lo")).distinct()
    grown = longer.join(shorter, ["key", "rest"]).select(
        F.when(F.col("so") < F.col("lo"), F.col("long")).otherwise(F.col("short")).alias("id")
    )
    return distinct, by_pairs.unionByName(by_place).unionByName(grown).distinct()


def _run(min_chars: int, every: int) -> int:
    """Least length of the longest run that lines within max(1, length // every) edits share."""
    least = lambda n: -(((k := max(1, n // every)) - n) // (k + 1))
    return min(least(n) for n in (min_chars, every * max(2, -(-min_chars // every))))


def _grams(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` characters at each place."""
    h, done = mixed(codes.astype(np.uint64) + np.uint64(1)), 1
    while done < width and len(h):
        step = min(done, width - done)
        h = mixed(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
        done += step
    return h


def _prefix_keys(lines: list[str], width: int, every: int) -> tuple[np.ndarray, ...]:
    """(index of the line, key, first and last place): of each line the hashes of its grams up to a bound of
    its own, each once.

    The bound is the least of LEVELS up to which the line has one disjoint gram more than it may have
    edits against any other line, or none if it has never so many.
    """
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    longest = sizes + np.maximum(1, sizes // (every - 1))  # of the lines that it can be near
    need = np.maximum(1, longest // every) + 1
    h = _grams(np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4"), width)
    ends = np.cumsum(sizes)
    at = np.arange(len(h))
    owner = np.repeat(np.arange(len(lines)), sizes)[: len(h)]
    held = at + width <= ends[owner]
    h, at, owner = h[held], at[held], owner[held]
    place = at - (ends - sizes)[owner]
    inside = place % PIECE + width <= PIECE  # grams are counted piece by piece, so that steps are bounded
    bound = np.full(len(lines), LEVELS[-1])
    open_ = np.ones(len(lines), bool)
    for level in LEVELS[:-1]:
        few = np.flatnonzero((h <= level) & inside)
        few = few[open_[owner[few]]]
        if len(few):
            spot, piece = at[few], place[few] // PIECE
            first = np.flatnonzero(np.append(True, (np.diff(owner[few]) != 0) | (np.diff(piece) != 0)))
            last, count = np.append(first[1:], len(few)), np.zeros(len(lines), np.int64)
            while len(first):  # the next gram that does not overlap
                count += np.bincount(owner[few[first]], minlength=len(lines))
                first = np.searchsorted(spot, spot[first] + width)
                first, last = first[first < last], last[first < last]
            done = open_ & (count >= need)
            bound[done] = level
            open_ &= ~done
        if not open_.any():
            break
    kept = h <= bound[owner]
    h, owner, place = h[kept], owner[kept], place[kept]
    order = np.lexsort((place, h, owner))
    h, owner, place = h[order], owner[order], place[order]
    once = np.append(True, (np.diff(owner) != 0) | (h[1:] != h[:-1]))[: len(h)]
    return owner[once], h[once], place[once], place[np.append(once[1:], True)[: len(h)]]


def _keyed(texts: DataFrame, width: int, every: int) -> DataFrame:
    """(id, size, key, place, span) of the lines in ``texts`` (id, size, line)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [x.decode("utf-8", "replace") for x in batch["line"].to_pylist()]
            start = 0
            while start < len(lines):
                end, size = start, 0
                while end < len(lines) and size < CHARS:
                    size, end = size + len(lines[end]), end + 1
                at, keys, first, last = _prefix_keys(lines[start:end], width, every)
                at = pa.array(at + start)
                cells = keys.view(np.int64), first.astype(np.int32), (last - first).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["id"].take(at), batch["size"].take(at), *map(pa.array, cells)], ["id", "size", "key", "place", "span"])
                start = end

    return texts.select("id", "size", F.col("line").cast("binary").alias("line")).mapInArrow(make, "id long, size int, key long, place int, span int")


def _near_by_share(lines: DataFrame, distinct: DataFrame, min_chars: int, every: int, crowd: int) -> DataFrame:
    """(id) of the distinct lines within ``size // every`` edits, at least one, of one with a smaller id."""
    run = _run(min_chars, every)
    firsts = distinct.where(F.col("size") >= min_chars).select("h1", "h2", "id", "size", F.col("ord").alias("first"))
    # repeated rows have equal places; no line is before the first, and without an equality here texts are shuffled once
    texts = lines.join(firsts, ["h1", "h2"]).where("ord <= first").dropDuplicates(["h1", "h2"]).select("id", "size", "line")
    texts = stored(texts, "texts")
    keys = _keyed(texts, run - run // 3, every)
    # sizes of a pair are in the same or the next class
    width = -math.log(1 - max(1 / every, 1 / min_chars)) * 1.0001
    common = stored(keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "common")
    common = F.broadcast(common) if common.count() <= BROADCAST_ROWS else common
    shared = keys.join(common, "key").withColumn("class", F.floor(F.log("size") / width).cast("int"))
    shared = stored(shared, "shared")
    allowed = f"greatest(1, greatest(sa, sb) div {every})"
    a, b = (texts.select(F.col("id").alias(x), F.col("line").alias(f"l{x}")) for x in "ab")
    count = texts.count()

    def near(pairs: DataFrame) -> DataFrame:
        # pairs may be many times the lines: no more of them than half the lines have their texts on disk at once
        pairs = stored(pairs.distinct(), "pairs")
        found, parts = [], max(1, -(-2 * pairs.count() // max(1, count)))
        for i in range(parts):
            part = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == i)
            # one text after the other, so that only one side's shuffle of the texts is on disk
            met = stored(part.join(a, "a"), "met").join(b, "b")
            met = met.where(F.expr(f"levenshtein(la, lb, cast({allowed} as int)) >= 0"))
            found.append(stored(met.select(F.col("b").alias("id")).distinct(), "near"))
        return reduce(DataFrame.unionByName, found)

    rounds = max(1, min(ROUNDS, -(-shared.count() // ROUND)))

    def in_rounds(make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        parts = [shared.where(F.pmod("key", F.lit(rounds)) == i) for i in range(rounds)]
        return reduce(DataFrame.unionByName, [stored(make(part).distinct(), "pairs") for part in parts])

    def ends(part: DataFrame) -> Iterator[DataFrame]:
        names = ("id", ""), ("size", "s"), ("place", "p"), ("span", "w")
        return (part.select("key", "class", *[F.col(c).alias(f"{n}{x}") for c, n in names]) for x in "ab")

    # edits move what they leave by as many places at most
    close = f"a < b and abs(sa - sb) <= {allowed} and pa <= pb + wb + {allowed} and pb <= pa + wa + {allowed}"

    # crowded keys: the first line decides for those near it, which then need no more pairs
    def with_first(part: DataFrame) -> DataFrame:
        pivots = part.groupBy("key", "class").agg(F.min("id").alias("a"), *[F.min_by(c, "id").alias(f"{n}a") for c, n in (("size", "s"), ("place", "p"), ("span", "w"))], F.count("*").alias("m"))
        pivots = pivots.where(F.col("m") > crowd).drop("m")
        _, second = ends(part)
        return pivots.join(second, ["key", "class"]).where(close).select("a", "sa", "b", "sb")

    def with_all(part: DataFrame) -> DataFrame:
        first, second = ends(part)
        open_ = second.join(decided.select(F.col("id").alias("b")), "b", "left_anti")
        probes = open_.withColumn("class", F.explode(F.array(*[F.col("class") + i for i in (-1, 0, 1)])))
        return first.join(probes, ["key", "class"]).where(close).select("a", "sa", "b", "sb")

    decided = stored(near(in_rounds(with_first)).distinct(), "decided")
    return decided.unionByName(near(in_rounds(with_all))).distinct()


def dropped_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, crowd: int = CROWD, every: int | None = None, exact_chars: int | None = None
) -> DataFrame:
    """(doc, th, no) of every dropped line; ``th`` is the text's hash, ``no`` counts from 0.

    Null and empty texts have no lines that count. Null ids come first. Repeated rows (same id and
    text) are one document: what is dropped of one is dropped of all. Other columns are not read; an
    empty table has no rows. ``every`` characters of the longer line allow one edit each, and any
    line one edit; without it one edit is allowed whatever the length. Equal lines of ``exact_chars``
    to ``min_chars`` characters are dropped as well; empty lines never are.
    """
    if every is not None and every < 2:
        raise ValueError("every must be 2 or more")
    least_chars = min_chars if exact_chars is None else max(1, min(exact_chars, min_chars))
    lines = _lines(docs, id_col, text_col, least_chars)
    if every is None:
        distinct, near_ids = _near_by_one(lines, min_chars, crowd)
    else:
        firsts = lines.select("h1", "h2", "ord", F.length("line").alias("size"))
        least = F.min(F.struct("ord", "size")).alias("m")
        distinct = firsts.groupBy("h1", "h2").agg(least, F.count("*").alias("n")).select("h1", "h2", "n", "m.*")
        # ids in the order of the lines
        distinct = stored(distinct.orderBy("ord").withColumn("id", F.monotonically_increasing_id()), "lines")
        near_ids = _near_by_share(lines, distinct, min_chars, every, crowd)

    marked = distinct.join(near_ids.withColumn("near", F.lit(True)), "id", "left").where("n > 1 or near")
    marked = stored(marked.select("h1", "h2", F.col("ord").alias("first"), F.coalesce("near", F.lit(False)).alias("near")), "marked")
    if marked.count() <= BROADCAST_ROWS:
        marked = F.broadcast(marked)
    return lines.drop("line").join(marked, ["h1", "h2"]).where("near or ord > first").select("ord.*").distinct()


def without_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, crowd: int = CROWD, every: int | None = None, exact_chars: int | None = None
) -> DataFrame:
    """``docs`` with ``text_col`` less its dropped lines, see :func:`dropped_lines`.

    Every row stays, with its other columns; a text that loses all lines becomes empty, a null text
    stays null.
    """
    drops = dropped_lines(docs, id_col, text_col, min_chars, crowd, every, exact_chars).groupBy("doc", "th").agg(F.collect_set("no").alias("gone"))
    drops = stored(drops, "drops")
    if drops.count() <= BROADCAST_ROWS:
        drops = F.broadcast(drops)
    # the whole row in one column, so that its names cannot clash
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))
    text = F.col(f"row.{quoted(text_col)}")
    at = (F.col(f"row.{quoted(id_col)}").eqNullSafe(F.col("doc"))) & (F.xxhash64(text) == F.col("th"))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("gone", i)), "\n")
    new = F.when(F.col("gone").isNull(), text).otherwise(kept)
    cells = [new.alias(c) if c == text_col else F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns]
    return rows.join(drops, at, "left").select(*cells)
