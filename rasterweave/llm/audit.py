"""Audit of filters that are applied one after another, for every order of them.

Each filter has a stored relation of the rows that fail it. What a filter removes after a set of
earlier filters (a prefix) is its relation left-anti joined with theirs, what is redundant is the
left-semi join; both are grown one filter at a time, so a relation for a prefix comes from the one
for the prefix without its last filter. Rows that fail nothing never move. The order within a prefix
does not matter, so n filters need n * 2^(n-1) relations for all n! orders.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.llm.common import UPPER, fresh_folder, quoted, stored

#: a digest that more than one row in so many has is hot; there are fewer such digests than this
HOT = 1000
_COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text (null: empty), true where it fails.

    A: under 200 words; B: less than half of the words distinct; C: over 2 % of the code points are
    A-Z; D: holds one of ``#$%&*|``. Words are ``[^\\x20\\x09-\\x0D]+``, case-sensitive.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": upper.cast("long") * 100 > F.length(text).cast("long") * 2,
        "D": F.length(F.translate(text, "#$%&*|", "")) < F.length(text),
    }


def later_copies(rows: DataFrame) -> DataFrame:
    """Rows of (key, id, digest, ...) whose digest a row with a smaller id has, wherever that is.

    A null id is neither smaller nor larger than another, and equal ids are no copies of each other.
    Ids of hot digests are compared by a broadcast of at most ``HOT`` rows, all others by a join in
    which no key has more than a thousandth of the rows.
    """
    known = rows.where("id IS NOT NULL")
    firsts = known.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    firsts = stored(firsts.where("first < last"), "copies")
    hot = firsts.where(F.col("n") * HOT > known.count())
    rest = firsts.join(F.broadcast(hot), "digest", "left_anti")
    met = known.join(F.broadcast(hot), "digest").unionByName(
        known.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest, "digest")
    )
    return met.where("id > first").select(*rows.columns)


def failing_rows(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> tuple[DataFrame, DataFrame]:
    """(parts, failures): row counts per part, and (filter, key, part, good, toxic) stored by filter.

    The filters are A to D of :func:`text_failures` and E, whether a smaller id has the same text
    (by SHA-256, null: empty). ``key`` numbers the rows, so rows with equal or null ids are counted
    one by one; rows without an id fail E never and have no label. A null part is the empty string.
    ``good`` and ``toxic`` say that a label row of the id has ``quality`` or ``toxic`` 1.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    judged = docs.select(
        F.monotonically_increasing_id().alias("key"),
        F.col(quoted(id_col)).alias("id"),
        F.coalesce(F.col(quoted(part_col)), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in text_failures(text).items()])).alias("fails"),
    )
    judged = stored(judged, "judged")  # row numbers must not change when a task is repeated
    marks = labels.where(F.col(quoted(id_col)).isNotNull()).groupBy(F.col(quoted(id_col)).alias("id")).agg(
        *[F.max((F.col(c) == 1).cast("long")).alias(name) for name, c in (("good", "quality"), ("toxic", "toxic"))]
    )
    alone = judged.where("size(fails) > 0").select("key", "id", "part", F.explode("fails").alias("filter"))
    copies = later_copies(judged.select("key", "id", "part", "digest")).select("key", "id", "part", F.lit("E").alias("filter"))
    every = alone.unionByName(copies).join(marks, "id", "left").select(
        "key", "part", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")], "filter"
    )
    folder = fresh_folder(docs.sparkSession, "failures")
    every.write.partitionBy("filter").parquet(folder)  # one table of ids for each filter
    failures = docs.sparkSession.read.schema(every.schema).parquet(folder)
    return judged.groupBy("part").agg(F.count("*").alias("total")), failures


def prefix_counts(failures: DataFrame, filters: str) -> DataFrame:
    """(part, prefix, filter, n, good, toxic, redundant) of every filter after every set of others.

    ``prefix`` has a bit for each earlier filter, ``filter`` is the index of the one that follows.
    ``n``, ``good`` and ``toxic`` count the rows that it removes, ``redundant`` those that fail it but
    were removed before. Combinations with neither have no row.
    """
    index = F.expr(f"instr('{filters}', filter) - 1").cast("int")
    ids = failures.select(index.alias("next"), "key")
    level = failures.select(F.lit(0).alias("prefix"), index.alias("filter"), "key", "part", "good", "toxic")
    removed, repeated = [], []
    for size in range(len(filters)):
        sums = [F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
        removed.append(level.groupBy("part", "prefix", "filter").agg(*sums))
        if size == len(filters) - 1:
            break
        # every set is reached once, by adding its filters in ascending order
        added = F.explode(F.array(*map(F.lit, range(len(filters)))))
        grown = level.select("*", added.alias("next")).where("prefix < shiftleft(1, next) and next <> filter")
        after = F.expr("prefix | shiftleft(1, next)")
        again = grown.join(ids, ["next", "key"], "left_semi").groupBy("part", after.alias("prefix"), "filter")
        repeated.append(again.agg(F.count("*").alias("fresh")))
        level = grown.join(ids, ["next", "key"], "left_anti").withColumn("prefix", after).drop("next")
        level = stored(level, "removed")
    removed, repeated = (reduce(DataFrame.unionByName, x) for x in (removed, repeated))
    # rows repeated by a set: those that its filters, in ascending order, repeated one after another
    chains = [
        (p, f, p & ((2 << i) - 1))
        for p in range(1 << len(filters)) for f in range(len(filters)) if not p >> f & 1
        for i in range(len(filters)) if p >> i & 1
    ]
    chains = removed.sparkSession.createDataFrame(chains, "prefix int, filter int, step int")
    redundant = repeated.withColumnRenamed("prefix", "step").join(F.broadcast(chains), ["step", "filter"])
    redundant = redundant.groupBy("part", "prefix", "filter").agg(F.sum("fresh").alias("redundant"))
    return removed.join(redundant, ["part", "prefix", "filter"], "full").fillna(0, [*_COUNTS, "redundant"])


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """One row per part, order of the filters A to E and step, with all that the step does.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley), zeros included; see :func:`failing_rows` for nulls, ties and repeated rows. ``shapley``
    sums what the step's filter removes over all orders. Tables without rows give none. Other columns
    are not read, so their names cannot clash.
    """
    filters = "ABCDE"
    parts, failures = failing_rows(docs, labels, id_col, text_col, part_col)
    counts = stored(prefix_counts(failures, filters), "prefixes")
    others = (1 << len(filters)) - 1
    orders = F.expr(" + ".join(
        f"if(bit_count(prefix) = {k}, {factorial(k) * factorial(len(filters) - 1 - k)}, 0)" for k in range(len(filters))
    ))
    over = counts.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("prefix") == F.lit(others) - F.expr("shiftleft(1, filter)"), F.col("n"))).alias("unique_fails"),
        F.sum(F.col("n") * orders).alias("shapley"),
    )
    # 600 rows for every part: the orders, and the letters of each
    rows = parts.select("*", F.explode(F.array(*[F.lit("".join(o)) for o in permutations(filters)])).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    earlier = [f"if(instr(substring(filter_order, 1, step - 1), '{f}') > 0, {1 << i}, 0)" for i, f in enumerate(filters)]
    rows = rows.select(
        "*",
        F.expr(f"instr('{filters}', substring(filter_order, step, 1)) - 1").cast("int").alias("filter"),
        F.expr(" + ".join(earlier)).cast("int").alias("prefix"),
    )
    rows = rows.join(counts, ["part", "filter", "prefix"], "left").join(over, ["part", "filter"], "left")
    rows = rows.fillna(0, [*_COUNTS, "redundant", "unique_fails", "shapley"])
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    return rows.select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("n").over(so_far)).alias("kept"),
        F.col("n").alias("removed"), "redundant", "unique_fails",
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )
