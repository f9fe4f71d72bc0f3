"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows go from every input partition to every shard is drawn first: a multivariate
hypergeometric matrix whose rows sum to the partitions' sizes and whose columns sum to the shards'
sizes. It is never stored. A tree over the partitions halves the remaining capacities at every node,
each node with a generator of its own, so any task can draw its own row from the partitions' sizes
in a logarithmic number of steps. Rows are permuted within their partition, sent to where the matrix
row says, and permuted again there. A shard is dealt in blocks, so no task holds a shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.llm.common import boxed, quoted, stored


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good items among ``draws`` without replacement from ``good + bad``; populations of any size.

    Inverts the distribution on 12 standard deviations around the mode, from ratios of neighbouring
    probabilities.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    spread = math.sqrt(draws * (good / total) * (bad / total) * max(total - draws, 1) / max(total - 1, 1))
    reach = int(12 * spread) + 40
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    up = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(up)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(weights, rng.random() * weights[-1], side="right").clip(0, last - first))


def split(rng: np.random.Generator, capacities: list[int], draws: int) -> list[int]:
    """How many of ``draws`` items fall to each of the capacities, all items being alike."""
    out, rest = [], sum(capacities)
    for c in capacities:
        rest -= c
        out.append(hypergeometric(rng, c, rest, draws))
        draws -= out[-1]
    return out


def matrix_row(sizes: np.ndarray, capacities: list[int], part: int, seed: int) -> list[int]:
    """The row of partition ``part`` in the matrix that ``seed`` draws; equal in every process."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    low, high = 0, len(sizes)
    while high - low > 1:
        mid = (low + high) // 2
        left = split(np.random.default_rng([seed, 1, low, high]), capacities, int(before[mid] - before[low]))
        if part < mid:
            high, capacities = mid, left
        else:
            low, capacities = mid, [c - x for c, x in zip(capacities, left)]
    return capacities


def shuffle_into_shards(
    docs: DataFrame, shards: int = 16, seed: int = 0, text_col: str = "text", block_bytes: int = 32 << 20
) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... in each shard).

    Every order of all rows is equally likely; shard sizes differ by at most one, the first shards
    being the larger ones. The same input partitions and ``seed`` give the same result. Nulls, empty
    texts and repeated rows are rows like others; ``text_col`` only sizes the blocks. Columns named
    ``shard`` or ``slot`` are replaced. An empty table stays empty.

    Rows are written once with their partition and position, so that repeated tasks repeat their
    draws. The driver and every task hold one number per input partition.
    """
    placed = boxed(docs, "shard", "slot").withColumn("_id", F.monotonically_increasing_id())
    rows = stored(
        placed.withColumn("_part", F.shiftright("_id", 33).cast("int"))
        .withColumn("_pos", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_id"),
        "placed",
    )
    size = F.coalesce(F.octet_length(f"row.{quoted(text_col)}"), F.lit(0)) + 64
    spark = docs.sparkSession
    counts = {
        r["_part"]: (r["n"], r["size"])
        for r in rows.groupBy("_part")
        .agg(F.count("*").alias("n"), F.sum(size).alias("size"))
        .collect()
    }
    sizes = np.zeros(max(counts, default=-1) + 1, dtype=np.int64)
    for part, (n, _) in counts.items():
        sizes[part] = n
    total, volume = int(sizes.sum()), sum(size for _, size in counts.values())
    capacities = [total // shards + (j < total % shards) for j in range(shards)]
    wanted = max(volume / block_bytes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(1, math.ceil(wanted / shards))
    shared = spark.sparkContext.broadcast(sizes.tobytes())  # 8 bytes per input partition

    def plan(part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard, block and order within the block, by position in a partition."""
        own = np.frombuffer(shared.value, dtype=np.int64)
        n = int(own[part])
        rng = np.random.default_rng([seed, 2, part])
        seats = rng.permutation(n)
        ends = np.cumsum(matrix_row(own, capacities, part, seed))
        shard = np.searchsorted(ends, seats, side="right").astype(np.int32)
        return shard, rng.integers(0, blocks, n, dtype=np.int32), rng.integers(0, 1 << 62, n)

    @F.pandas_udf("shard int, block int, key long")
    def destination(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        at, drawn = -1, None
        for parts, positions in batches:
            parts, positions = parts.to_numpy(), positions.to_numpy()
            out = np.empty((3, len(parts)), dtype=np.int64)
            for part in np.unique(parts):
                if part != at:
                    at, drawn = part, plan(int(part))
                here = parts == part
                for row, values in zip(out, drawn):
                    row[here] = values[positions[here]]
            yield pd.DataFrame({"shard": out[0].astype(np.int32), "block": out[1].astype(np.int32), "key": out[2]})

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in batch["id"]:
                shard, block, _ = plan(int(part))
                cells, n = np.unique(shard.astype(np.int64) * blocks + block, return_counts=True)
                yield pd.DataFrame({"shard": (cells // blocks).astype(np.int32), "_block": (cells % blocks).astype(np.int32), "n": n})

    # block sizes follow from the draws alone, without reading a row
    sums = (
        spark.range(len(sizes))
        .mapInPandas(tally, "shard int, _block int, n long")
        .groupBy("shard", "_block")
        .agg(F.sum("n").alias("_n"))
    )
    order = Window.partitionBy("shard").orderBy("_block")
    offsets = sums.select("shard", "_block", (F.sum("_n").over(order) - F.col("_n")).alias("_before"))
    dealt = rows.withColumn("_to", destination("_part", "_pos")).select(
        "row", F.col("_to.shard").alias("shard"), F.col("_to.block").alias("_block"), F.col("_to.key").alias("_key"), "_part", "_pos"
    )
    seat = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_key", "_part", "_pos")) - 1
    return (
        dealt.withColumn("_seat", seat)
        .join(offsets, ["shard", "_block"])
        .select("row.*", "shard", (F.col("_before") + F.col("_seat")).alias("slot"))
    )
