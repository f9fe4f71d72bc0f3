"""Benchmark items inside long documents: MinHash containment search with exact verification.

Words are lower-cased (A-Z) and separated by ASCII white space; shingles are five words. An item is
contained in a document that has at least three quarters of its distinct shingles.

All shingles are ordered by one hash. An item's signature is its bottom-k MinHash: the k smallest
hashes of its shingles, with k just large enough that a document with enough of the item's shingles
must have one of the k. The documents' side is not cut down, as a few hashes of a long document say
nothing about a short item. Documents are partitioned by size (powers of two), and a partition meets
the items that its largest document can hold. Candidates are verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.common import native_words, quoted, stored

WIDTH, PERCENT = 5, 75
#: rows of a table that is broadcast at most (a few tens of MB); larger ones are shuffled
BROADCAST_ROWS = 300_000


def _positions(words: Column, width: int) -> Column:
    """Number of shingles of a text, repeated ones included; a shorter text is one shingle."""
    return F.when(F.size(words) >= width, F.size(words) - (width - 1)).otherwise(F.least(F.size(words), F.lit(1)))


def _each(words: Column, width: int, shingle, whole) -> Column:
    """An array with ``shingle(i)`` for each start of a shingle, or ``whole`` of a shorter text."""
    many = F.transform(F.sequence(F.lit(0), F.size(words) - width), shingle)
    return F.when(F.size(words) >= width, many).when(F.size(words) > 0, F.array(whole))


def shingle_hashes(words: Column, width: int = WIDTH) -> Column:
    """Hashes of all shingles of a word array, in order of the text; NULL without words."""
    return _each(
        words,
        width,
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]),
        F.xxhash64(*[F.get(words, F.lit(k)) for k in range(width)]),
    )


def shingle_texts(words: Column, width: int = WIDTH) -> Column:
    """Distinct shingles of a word array as texts; NULL without words."""
    return F.array_distinct(
        _each(words, width, lambda i: F.array_join(F.slice(words, i + 1, width), " "), F.array_join(words, " "))
    )


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it was counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every item contained in a document.

    Null, empty and blank texts have no shingles: such items are in no document, and such documents
    hold nothing. Texts below ``width`` words are one shingle, their whole word sequence. Rows that
    share an id count as one document if one of their texts holds the item (the best one is shown);
    a null id is an id like others. Empty tables give no rows, other columns are not read. Any
    number of items is searched: signatures beyond BROADCAST_ROWS are joined by a shuffle.
    """
    known = items.select(F.col(quoted(item_col)).alias("item"), native_words(F.col(quoted(item_text))).alias("w"))
    known = known.select("item", shingle_texts(F.col("w"), width).alias("texts"), shingle_hashes(F.col("w"), width).alias("h"))
    known = known.where(F.size("texts") > 0).withColumn("q", F.size("texts"))
    known = stored(known.withColumn("need", F.expr(f"(q * {percent} + 99) div 100")).dropDuplicates(["item", "texts"]), "items")
    bottom = F.expr("slice(array_sort(array_distinct(h)), 1, cast(q - need + 1 as int))")
    signatures = known.select(F.explode(bottom).alias("h"), F.floor(F.log2("need")).alias("least"), "item")
    signatures = stored(signatures.groupBy("h", "item").agg(F.min("least").alias("least")), "signatures")

    texts = docs.select(F.col(quoted(id_col)).alias("doc"), F.col(quoted(text_col)).alias("t"))
    words = texts.select("doc", native_words(F.col("t")).alias("w"))
    sizes = F.floor(F.log2(_positions(F.col("w"), width))).alias("size")  # the size partition
    hashes = words.select("doc", sizes, F.explode(shingle_hashes(F.col("w"), width)).alias("h"))
    hits = hashes.join(_small(signatures), "h").where("size >= least")
    candidates = stored(hits.groupBy("doc").agg(F.collect_set("item").alias("items"), F.max(F.col("item").isNull()).alias("nulls")), "candidates")

    found = texts.alias("t").join(_small(candidates).alias("c"), F.expr("t.doc <=> c.doc"))
    found = found.select(
        F.col("t.doc").alias("doc"), native_words(F.col("t.t")).alias("w"), F.expr("if(c.nulls, array_append(c.items, null), c.items)").alias("items")
    )
    # words are a column of their own, so that no shingle splits the text again
    own = found.select("doc", shingle_texts(F.col("w"), width).alias("own"), "items")
    pairs = own.select("doc", "own", F.explode("items").alias("item")).alias("p")
    verified = pairs.join(_small(known).alias("k"), F.expr("p.item <=> k.item")).select(
        F.col("p.doc").alias("doc_id"),
        F.col("p.item").alias("item_id"),
        F.col("q").cast("long").alias("n_item"),
        F.size(F.array_intersect("texts", "own")).cast("long").alias("n_shared"),
    )
    return (
        verified.where(f"100 * n_shared >= {percent} * n_item")
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("c"), "n_item", "n_shared")).alias("m"))
        .select("doc_id", "item_id", "m.n_item", "m.n_shared", F.col("m.c").alias("containment"))
    )
