"""Running values and neighbours over long ordered keys without one task per key.

Every function works in two levels. Rows are split into chunks of bounded size by an expression
that grows with the order (for an integer ordinal: ``ordinal DIV size``); each chunk is processed
on its own, and a summary with one row per chunk carries values across chunk borders. A key that
holds a third of all rows is therefore spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.session import checkpoint

_CHUNK = "_chunk"

_COMBINE = {
    "sum": lambda carry, local: F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0)),
    "max": lambda carry, local: F.greatest(carry, local),
    "min": lambda carry, local: F.least(carry, local),
}
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def by_ordinal(order: str | Column, size: int = 65536) -> Column:
    """Chunk number of an integer ordinal: at most ``size`` distinct ordinals per chunk."""
    column = F.col(order) if isinstance(order, str) else order
    return F.floor(column / F.lit(size)).cast("long")


def _join_chunks(rows: DataFrame, carries: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(carries, [*keys, _CHUNK], "left")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    chunk: Column,
    values: Mapping[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Add running ``sum`` / ``min`` / ``max`` columns: ``{name: (kind, value)}``.

    ``inclusive=False`` leaves the current row out; the first row of a key then has NULL
    (0 for ``sum``).
    """
    last = 0 if inclusive else -1
    rows = df.withColumn(_CHUNK, chunk)
    local = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    local = local.rowsBetween(Window.unboundedPreceding, last)
    across = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, _CHUNK).agg(
        *[_AGG[kind](value).alias(f"_t_{name}") for name, (kind, value) in values.items()]
    )
    carries = totals.select(
        *keys,
        _CHUNK,
        *[_AGG[kind](f"_t_{name}").over(across).alias(f"_c_{name}") for name, (kind, _) in values.items()],
    )
    rows = rows.select(
        "*", *[_AGG[kind](value).over(local).alias(f"_l_{name}") for name, (kind, value) in values.items()]
    )
    joined = _join_chunks(rows, carries, keys)
    return joined.select(
        *df.columns,
        *[
            _COMBINE[kind](F.col(f"_c_{name}"), F.col(f"_l_{name}")).alias(name)
            for name, (kind, _) in values.items()
        ],
    )


def shifted(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    values: Mapping[str, Column],
    offset: int = -1,
) -> DataFrame:
    """Add the values of the previous (``offset=-1``) or next (``offset=1``) row of the key."""
    if offset not in (-1, 1):
        raise ValueError("offset must be -1 or 1")
    packed = F.struct(*[value.alias(name) for name, value in values.items()])
    place = F.struct(*order)
    rows = df.withColumn(_CHUNK, chunk).withColumn("_packed", packed)
    edge = F.max_by if offset == -1 else F.min_by
    edges = rows.groupBy(*keys, _CHUNK).agg(edge("_packed", place).alias("_edge"))
    across = Window.partitionBy(*keys).orderBy(_CHUNK)
    move = F.lag if offset == -1 else F.lead
    carries = edges.select(*keys, _CHUNK, move("_edge").over(across).alias("_carry"))
    local = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    rows = rows.withColumn("_near", move("_packed").over(local)).drop("_packed")
    joined = _join_chunks(rows, carries, keys)
    both = F.coalesce("_near", "_carry")
    return joined.select(*df.columns, *[both[name].alias(name) for name in values])


def global_index(df: DataFrame, order: Sequence[str | Column], name: str = "index") -> DataFrame:
    """0-based position of every row in a total order over ``order``.

    Rows are range-partitioned and sorted; the position inside a partition comes from the row id,
    the partition offset from one counted row per partition. The sorted rows are written to the
    checkpoint folder once, so that a lost executor cannot move a row to another partition between
    the counting and the numbering.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    row_id = F.monotonically_increasing_id()
    rows = checkpoint(
        ranged.withColumn("_part", F.shiftright(row_id, 33)).withColumn(
            "_pos", row_id.bitwiseAND(F.lit((1 << 33) - 1))
        )
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_part").agg(F.count("*").alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    # one row per partition, so the broadcast is bounded by the partition count
    return rows.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_offset") + F.col("_pos")).alias(name)
    )


def first_rows(df: DataFrame, order: Sequence[str | Column], n: int, small: int = 10000) -> DataFrame:
    """The first ``n`` rows of a total order.

    A small ``n`` is a top-k. A large one is cut by position, because a large LIMIT would pass all
    its rows through one task.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    if n <= small:
        return df.orderBy(*order).limit(n)
    return global_index(df, order, "_position").where(F.col("_position") < n).drop("_position")
