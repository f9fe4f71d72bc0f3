"""Closed forms for overlapping tile layouts.

Tiles advance by ``size - overlap``; the last one is shifted back so that it ends at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_layout(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("tile size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("overlap must lie in [0, size)")


def last_tile(dimension: Column, size: int, overlap: int) -> Column:
    """Index of the last tile along one axis."""
    rest = F.greatest(dimension - size, F.lit(0))
    return F.ceil(rest / F.lit(size - overlap)).cast("int")


def tile_start(index: Column, dimension: Column, size: int, overlap: int) -> Column:
    rest = F.greatest(dimension - size, F.lit(0))
    return F.least(index * (size - overlap), rest).cast("long")


def tile_starts(dimension: Column, size: int, overlap: int) -> Column:
    """All start offsets along one axis as an array."""
    check_layout(size, overlap)
    last = last_tile(dimension, size, overlap)
    return F.transform(F.sequence(F.lit(0), last), lambda i: tile_start(i, dimension, size, overlap))


def covering_tiles(position: Column, dimension: Column, size: int, overlap: int) -> Column:
    """Indices of the tiles that contain a pixel position, as an array."""
    check_layout(size, overlap)
    stride = size - overlap
    last = last_tile(dimension, size, overlap)
    low = F.greatest(F.floor((position - size) / F.lit(stride)) + 1, F.lit(0)).cast("int")
    high = F.least(F.floor(position / F.lit(stride)).cast("int"), last - 1)
    empty = F.array().cast("array<int>")
    regular = F.when(low <= high, F.sequence(low, high)).otherwise(empty)
    at_end = F.when(position >= tile_start(last, dimension, size, overlap), F.array(last)).otherwise(empty)
    return F.concat(regular, at_end)
