"""Exact Jaccard join of documents on word shingles, as a join in the Jaccard metric space.

Words are lower-cased (A-Z) and separated by ASCII white space. A document's set is its distinct
five-word shingles; two documents are linked when 100 |A n B| >= 75 |A u B|, that is at a Jaccard
distance of at most r = 0.25.

Texts without a common shingle are all at distance 1, so pivots drawn from all documents would leave
nearly every document at distance 1 from each of them. Regions are therefore cut by single shingles
first: of a set in a global order, the smallest |A| - ceil(0.75 |A|) + 1 shingles name its regions, and
linked sets share at least one. Within each region a document is the pivot. The distances of the
region's members to it are computed exactly; members within r are linked to it. Pairs of other members
are compared only if they are not connected yet, if sizes and positions allow a link, and if their
distances to the pivot differ by at most r, as the triangle inequality demands. Crowded regions choose
further pivots before such pairs are listed, and pairs are listed only if the sets' signatures, which
show in how many shingles two sets differ at least, leave room for a link. Components of the links come
out exact.

The order of shingles is by their count in a sample of documents, then by hash, so passages shared by
many documents come last and name few regions. It affects speed only; any order gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.common import components, mixed, quoted, stored, words_of

WIDTH, PERCENT = 5, 75
#: one of so many documents is counted for the order of shingles, of which so many are kept
SAMPLE, COMMON = 32, 500_000
#: regions with more members choose further pivots, so many times; rows that are broadcast at most
CROWD, PIVOTS, BROADCAST_ROWS = 16, 3, 300_000
#: 64-bit words of a signature
SIGNS = [f"g{i}" for i in range(16)]


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; with fewer words, of the whole sequence."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, len(words) if len(words) < WIDTH else WIDTH, np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit id of a set; equal sets have equal ids."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def signature(s: np.ndarray) -> np.ndarray:
    """For each of 1,024 remainders of a hash, whether an odd number of shingles has it.

    Signatures of two sets differ in no more bits than the sets do in shingles.
    """
    size = 64 * len(SIGNS)  # a power of two
    bits = np.bincount((s & np.uint64(size - 1)).view(np.int64), minlength=size)
    return np.packbits(bits.astype(np.uint8) & 1).view(np.int64)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc, th, n, sid, signature) of every row of (doc, text, th)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sid = np.empty((2, batch.num_rows), np.int64)
            signs = np.empty((len(SIGNS), batch.num_rows), np.int64)
            for i, t in enumerate(batch["text"]):
                s = shingle_set(t.as_py(), width)
                n[i], sid[i] = len(s), set_id(s)
                signs[:, i] = signature(s)
            arrays = [batch["doc"], batch["th"], pa.array(n), pa.array(sid), *map(pa.array, signs)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "th", "n", "sid", *SIGNS])

    fields = ", ".join(f"{g} long" for g in SIGNS)
    return docs.mapInArrow(make, f"doc {docs.schema['doc'].dataType.simpleString()}, th long, n long, sid long, {fields}")


def _common(docs: DataFrame, width: int) -> tuple[bytes, bytes]:
    """Hashes (sorted) and counts of the shingles most frequent in the sample, at most COMMON."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch["text"]:
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), width).view(np.int64))], ["h"])

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    rows = (
        sample.mapInArrow(explode, "h long").groupBy("h").count().where("count > 1")
        .orderBy(F.desc("count"), "h").limit(COMMON).toPandas()
    )
    rows = rows.assign(h=rows["h"].to_numpy(np.int64).view(np.uint64)).sort_values("h")
    return rows["h"].to_numpy(np.uint64).tobytes(), rows["count"].to_numpy(np.int64).tobytes()


def _regions(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(h, sid, n, i): the regions a set belongs to, i being the shingle's place in its order.

    Regions of one member are left out. Regions of common shingles are spread over several tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, width))  # 16 bytes a shingle, COMMON of them

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = (np.frombuffer(x, t) for x, t in zip(shared.value, (np.uint64, np.int64)))
        seen: set[int] = set()
        cells: list[list[np.ndarray]] = []
        held = 0

        def flush():
            arrays = [np.concatenate(c) for c in zip(*cells)]
            return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["h", "sid", "place"])

        for batch in batches:
            for t in batch["text"]:
                s = shingle_set(t.as_py(), width)
                if not len(s):
                    continue
                sid = set_id(s)
                if sid in seen:  # copies within a task name their regions once
                    continue
                if len(seen) < 500_000:
                    seen.add(sid)
                c = np.zeros(len(s), np.int64)
                if len(common):
                    at = np.searchsorted(common, s).clip(max=len(common) - 1)
                    c = np.where(common[at] == s, counts[at], 0)
                    order = np.argsort(c, kind="stable")
                    s, c = s[order], c[order]
                m = len(s) - (percent * len(s) + 99) // 100 + 1
                spread = 1 + c[:m] * SAMPLE // 10_000
                # a common shingle's rows are kept whether or not they meet another in their task
                salt = np.where(c[:m] > 0, 1 + (sid & 0xFFFFFFFF) % spread, 0).clip(max=127)
                place = salt << 56 | np.int64(len(s)) << 28 | np.arange(m)  # fewer bytes to shuffle than three columns
                cells.append([s[:m].view(np.int64), np.full(m, sid), place])
                held += m
                if held > 100_000:
                    yield flush()
                    cells, held = [], 0
        if cells:
            yield flush()

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by h, those whose h has another row; the last row waits for the next batch."""
        last, joined = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            h = batch["h"].to_numpy()
            same = h[1:] == h[:-1]
            keep = np.concatenate([[joined], same]) | np.concatenate([same, [False]]) | (batch["place"].to_numpy() >> 56 > 0)
            joined = bool(same[-1]) if len(same) else joined
            last = batch.slice(len(h) - 1)
            keep[-1] = False
            yield batch.filter(pa.array(keep))
        if last is not None and (joined or last["place"][0].as_py() >> 56 > 0):
            yield last

    names = "h long, sid long, place long"
    rows = docs.select("text").mapInArrow(sign, names).repartition("h", F.shiftright("place", 56)).sortWithinPartitions("h")
    low = F.lit((1 << 28) - 1)
    unpacked = rows.mapInArrow(several, names).select(
        "h", "sid", F.shiftright("place", 28).bitwiseAND(low).cast("int").alias("n"), F.col("place").bitwiseAND(low).cast("int").alias("i")
    )
    return stored(unpacked, "regions")


def _possible(percent: int, a: str, b: str) -> str:
    """Whether sizes and the places of a shared shingle leave room for a link."""
    need = f"(({percent} * ({a}.n + {b}.n) + {percent + 99}) div {100 + percent})"
    return (
        f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) "
        f"and {a}.n - {a}.i >= {need} and {b}.n - {b}.i >= {need}"
    )


def _alike(percent: int, a: str, b: str) -> str:
    """Whether signatures leave room for a link."""
    need = f"(({percent} * ({a}.n + {b}.n) + {percent + 99}) div {100 + percent})"
    return " + ".join(f"bit_count({a}.{g} ^ {b}.{g})" for g in SIGNS) + f" <= {a}.n + {b}.n - 2 * {need}"


def _whole_sets(texts: DataFrame, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(sid, data): hashes of the wanted sets, made anew from their documents."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                sets = [shingle_set(t.as_py(), width) for t in batch["text"].slice(start, 500)]
                sid = pa.array([set_id(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([sid, pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "data"])

    ids = stored(wanted.join(classes, "sid").select("low").distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return texts.join(ids, F.expr("doc <=> low"), "left_semi").select("text").mapInArrow(make, "sid long, data binary")


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, linked, distance) of pairs of set ids, from the whole sets of their documents."""

    @F.pandas_udf("int")
    def overlap(x: pd.Series, y: pd.Series) -> pd.Series:
        pair = ((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(x, y))
        return pd.Series([len(np.intersect1d(a, b, assume_unique=True)) for a, b in pair], dtype="int32")

    pairs = stored(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    sets = _whole_sets(texts, classes, ends, width)
    both = pairs.join(sets.withColumnsRenamed({"sid": "a", "data": "da"}), "a").join(sets.withColumnsRenamed({"sid": "b", "data": "db"}), "b")
    size = F.expr("octet_length(da) div 8 + octet_length(db) div 8")
    both = both.select("a", "b", size.alias("size"), overlap("da", "db").alias("o")).distinct()  # rows may share an id
    linked = f"100 * o >= {percent} * (size - o)"
    return stored(both.selectExpr("a", "b", f"{linked} as linked", "1 - o / (size - o) as distance"), "verified")


def linked_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, crowd: int = CROWD
) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, group_id) of every row of ``docs``.

    ``component_id`` is the smallest id among the documents reachable by links, the row's own
    included. Null, empty and blank texts have no shingles and no links. Repeated rows and rows with
    equal sets are linked with each other; a null id never is the smallest while there is another.
    ``text_hash`` (Spark's ``xxhash64`` of the text) tells rows apart that share an id,
    ``group_id`` tells components apart whose smallest ids are equal (NULL without shingles).
    Other columns are not read; an empty table gives no rows.
    """
    texts = docs.select(F.col(quoted(id_col)).alias("doc"), F.col(quoted(text_col)).alias("text"))
    rows = stored(_sets(texts.withColumn("th", F.xxhash64("text")), width), "sets")
    signs = [F.first(g).alias(g) for g in SIGNS]  # equal sets have equal signatures
    signed = stored(rows.where("n > 0").groupBy("sid").agg(F.min("doc").alias("low"), *signs), "classes")
    rows, classes = rows.drop(*SIGNS), signed.select("sid", "low")
    regions = _regions(texts, width, percent)

    # pivot of each region: the member with the least hash
    def pivots(of: DataFrame, turn: int) -> DataFrame:
        least = F.min(F.struct(F.xxhash64("sid", F.lit(turn)).alias("rank"), "sid", "n", "i"))
        return of.groupBy("h").agg(least.alias("p")).select("h", "p.sid", "p.n", "p.i")

    first = stored(pivots(regions, 0), "pivots")
    met = regions.alias("x").join(first.alias("p"), "h").where(f"x.sid <> p.sid and {_possible(percent, 'x', 'p')}")
    star = met.select(F.col("x.sid").alias("a"), F.col("p.sid").alias("b")).distinct()

    verify = lambda pairs: _verified(pairs, texts, classes, width, percent)
    known = verify(star)
    links = known.where("linked").select("a", "b")

    # members that their pivots did not connect
    sizes = stored(regions.groupBy("h").agg(F.count("*").alias("m")).where("m > 2"), "sizes")
    crowded = regions.join(sizes, "h")
    for turn in range(1, PIVOTS):
        parts = components(links)
        open_ = _unconnected(crowded.where(F.col("m") > crowd), parts)
        next_ = pivots(open_, turn)
        more = open_.alias("x").join(next_.alias("p"), "h").where(f"x.sid <> p.sid and {_possible(percent, 'x', 'p')}")
        more = more.select(F.col("x.sid").alias("a"), F.col("p.sid").alias("b")).distinct()
        more = _apart(more, parts).join(known, ["a", "b"], "left_anti")
        more = verify(more)
        if more.isEmpty():
            break
        known = known.unionByName(more)
        links = known.where("linked").select("a", "b")

    parts = components(links)
    open_ = _unconnected(crowded, parts)
    distances = first.select("h", F.col("sid").alias("b")).join(known.select(F.col("a").alias("sid"), "b", "distance"), "b")
    open_ = open_.join(distances.select("h", "sid", "distance"), ["h", "sid"], "left")
    open_ = open_.join(signed.drop("low"), "sid")
    radius = 1 - percent / 100 + 1e-9
    rest = (
        open_.alias("x").join(open_.alias("y"), "h")
        .where(f"x.sid < y.sid and x.part <> y.part and {_possible(percent, 'x', 'y')}")
        .where(f"coalesce(abs(x.distance - y.distance), 0) <= {radius} and {_alike(percent, 'x', 'y')}")
        .select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))
        .distinct()
    )
    seen = known.select("a", "b").unionByName(known.selectExpr("b as a", "a as b"))
    links = links.unionByName(verify(rest.join(seen, ["a", "b"], "left_anti")).where("linked").select("a", "b"))

    parts = components(links)
    lows = parts.join(classes, parts["id"] == classes["sid"]).select("sid", "component", "low")
    least = lows.groupBy("component").agg(F.min("low").alias("component_id"))
    ends = lows.join(least, "component").select("sid", "component_id", "component")
    alone = F.col("component").isNull()
    ends = classes.join(ends, "sid", "left").select(
        "sid", F.when(alone, F.col("low")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("component", "sid").alias("group")
    )
    ends = stored(ends, "ends")
    linked = rows.where("n > 0").join(ends, "sid").select("doc", "n", "component_id", "th", "group")
    empty = rows.where("n = 0").select("doc", "n", F.col("doc").alias("component_id"), "th", F.lit(None).cast("long").alias("group"))
    every = linked.unionByName(empty)
    named = [F.col(a).alias(b) for a, b in (("doc", "doc_id"), ("n", "n_shingles"), ("component_id",) * 2, ("th", "text_hash"), ("group", "group_id"))]
    return every.select(*named)


def _unconnected(regions: DataFrame, parts: DataFrame) -> DataFrame:
    """Regions with members of different components, with each member's component ``part``."""
    placed = regions.join(parts.select(F.col("id").alias("sid"), F.col("component").alias("part")), "sid", "left")
    placed = placed.withColumn("part", F.coalesce("part", "sid"))
    mixed_ = placed.groupBy("h").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    return stored(placed.join(mixed_.select("h"), "h"), "open")


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    a = parts.select(F.col("id").alias("a"), F.col("component").alias("pa"))
    b = parts.select(F.col("id").alias("b"), F.col("component").alias("pb"))
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.where("coalesce(pa, a) <> coalesce(pb, b)").select("a", "b")
