"""Operators that move or filter whole blocks: halos, tile windows, turns, resizing, wavelets, mosaics.

Every source block is cut into *patches*, one for each output window that it feeds, and the patches of
a window are put together in one group. A window is an output block, a block with a rim or a tile, so
one shuffle of patches serves all of them and no pixel ever becomes a row. A group holds one window,
whatever the size of the scene; where many source blocks shrink into one, only their partial sums move.

Rasters come as blocks (see :mod:`rasterweave.operators.rasters`) next to a table
``scene_id, height, width``. NULL elements are missing pixels. Missing blocks leave NULL elements, a
window without any source is absent, and a block of an unknown scene is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterweave.functions.tiles import check_layout
from rasterweave.operators.images import HAAR_SCALE
from rasterweave.operators.rasters import BLOCK, BLOCK_KEY

#: cells of the patches that one Arrow batch may hold
BATCH_CELLS = 1 << 20

_PLACE = ("block_row", "block_col", "y_off", "x_off", "height", "width", "top", "left", "rows", "cols")
_WINDOW = _PLACE[:6]


# ------------------------------------------------------------------ windows along one axis


@dataclass(frozen=True)
class Blocks:
    """Square blocks of ``size``."""

    size: int = BLOCK

    def touching(self, low: int, high: int, length: int) -> Iterator[tuple[int, int, int]]:
        """Index, start and stop of the windows that hold some of the positions ``low`` to ``high - 1``."""
        for i in range(low // self.size, (high - 1) // self.size + 1):
            yield i, i * self.size, min((i + 1) * self.size, length)


@dataclass(frozen=True)
class Rimmed:
    """Blocks of ``size`` that reach ``halo`` pixels into their neighbours and end at the scene."""

    size: int
    halo: int

    def touching(self, low: int, high: int, length: int) -> Iterator[tuple[int, int, int]]:
        last = (length - 1) // self.size
        for i in range(max((low - self.halo) // self.size, 0), min((high - 1 + self.halo) // self.size, last) + 1):
            yield i, max(i * self.size - self.halo, 0), min((i + 1) * self.size + self.halo, length)


@dataclass(frozen=True)
class Tiles:
    """Tiles that overlap; the last one is shifted back to the edge."""

    size: int
    overlap: int

    def touching(self, low: int, high: int, length: int) -> Iterator[tuple[int, int, int]]:
        stride, rest = self.size - self.overlap, max(length - self.size, 0)
        last = -(-rest // stride)
        for i in range(max((low - self.size) // stride + 1, 0), min((high - 1) // stride, last - 1) + 1):
            yield i, i * stride, i * stride + self.size
        if high > rest:
            yield last, rest, min(rest + self.size, length)


# ------------------------------------------------------------------ moves along one axis


@dataclass(frozen=True)
class Straight:
    """Output position ``sign * source + offset``."""

    sign: int = 1
    offset: int = 0

    def sources(self, low: int, high: int, length: int) -> tuple[int, np.ndarray]:
        """First output position fed by the sources ``low`` to ``high - 1``, and the source of each."""
        ends = self.sign * low + self.offset, self.sign * (high - 1) + self.offset
        first, stop = max(min(ends), 0), min(max(ends) + 1, length)
        return first, (np.arange(first, stop) - self.offset) * self.sign


@dataclass(frozen=True)
class Nearest:
    """Output positions copy the source under their centre."""

    old: int
    new: int

    def sources(self, low: int, high: int, length: int) -> tuple[int, np.ndarray]:
        first = max(low * self.new // self.old - 1, 0)
        stop = min(-(-high * self.new // self.old) + 1, length)
        source = np.floor((np.arange(first, stop) + 0.5) * (self.old / self.new)).astype(np.int64)
        kept = (source >= low) & (source < high)
        return first + int(kept.argmax()) if kept.any() else first, source[kept]


@dataclass(frozen=True)
class Move:
    """Where a block goes: a move per output axis, whether the axes change places, and the new size."""

    rows: Straight | Nearest
    cols: Straight | Nearest
    height: int
    width: int
    swapped: bool = False


def _turn(row: dict) -> Move:
    height, width, change = row["_h"], row["_w"], row["_t"]
    shift = (width - height) // 2
    # after the flips, a position is sign * source + offset
    rs, ro = (-1, height - 1) if change["vflip"] else (1, 0)
    cs, co = (-1, width - 1) if change["hflip"] else (1, 0)
    if change["angle"] == 90:
        return Move(Straight(-cs, width - 1 - co - shift), Straight(rs, ro + shift), height, width, True)
    if change["angle"] == 180:
        return Move(Straight(-rs, height - 1 - ro), Straight(-cs, width - 1 - co), height, width)
    if change["angle"] == 270:
        return Move(Straight(cs, co - shift), Straight(-rs, height - 1 - ro + shift), height, width, True)
    if change["angle"] != 0:
        raise ValueError("images turn by 0, 90, 180 or 270 degrees")
    return Move(Straight(rs, ro), Straight(cs, co), height, width)


def _stay(row: dict) -> Move:
    return Move(Straight(), Straight(), row["_h"], row["_w"])


def _nearest(row: dict) -> Move:
    return Move(Nearest(row["_h"], row["_nh"]), Nearest(row["_w"], row["_nw"]), row["_nh"], row["_nw"])


def _pieces(row: dict, move: Move, grid) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Place of each patch of a block and the positions of its cells in the block."""
    y, x, h, w = (int(row[c]) for c in ("y_off", "x_off", "height", "width"))
    down, across = ((x, w, 1), (y, h, w)) if move.swapped else ((y, h, w), (x, w, 1))
    top, rows = move.rows.sources(down[0], down[0] + down[1], move.height)
    left, cols = move.cols.sources(across[0], across[0] + across[1], move.width)
    if not len(rows) or not len(cols):
        return
    rows, cols = (rows - down[0]) * down[2], (cols - across[0]) * across[2]
    for i, y0, y1 in grid.touching(top, top + len(rows), move.height):
        r0, r1 = max(y0, top), min(y1, top + len(rows))
        for j, x0, x1 in grid.touching(left, left + len(cols), move.width):
            c0, c1 = max(x0, left), min(x1, left + len(cols))
            index = rows[r0 - top : r1 - top, None] + cols[None, c0 - left : c1 - left]
            yield (i, j, y0, x0, y1 - y0, x1 - x0, r0 - y0, c0 - x0, r1 - r0, c1 - c0), index.ravel()


# ------------------------------------------------------------------ cutting and assembling


class _Batch:
    """Patches collected for one Arrow batch."""

    def __init__(self, batch: pa.RecordBatch, carry: Sequence[str], arrays: Mapping[str, pa.DataType]) -> None:
        self._batch, self._carry, self._kinds = batch, carry, arrays
        self._clear()

    def _clear(self) -> None:
        self._at, self._places, self.cells = [], [], 0
        self._parts = {name: [] for name in self._kinds}

    def add(self, at: int, place: tuple[int, ...], parts: Mapping[str, pa.Array]) -> None:
        self._at.append(at)
        self._places.append(place)
        self.cells += place[8] * place[9]
        for name, part in parts.items():
            self._parts[name].append(part)

    def flush(self) -> pa.RecordBatch:
        places = np.array(self._places, dtype=np.int32).reshape(-1, len(_PLACE))
        ends = np.concatenate([[0], np.cumsum(places[:, 8] * places[:, 9])]).astype(np.int32)
        columns = {c: self._batch.column(c).take(pa.array(self._at)) for c in self._carry}
        columns |= {name: pa.array(places[:, k]) for k, name in enumerate(_PLACE)}
        for name, kind in self._kinds.items():
            columns[name] = pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(self._parts[name])).cast(kind)
        self._clear()
        return pa.RecordBatch.from_pydict(columns)


def _patch_schema(blocks: DataFrame, carry: Sequence[str], arrays: Sequence[T.StructField]) -> T.StructType:
    places = [T.StructField(c, T.IntegerType()) for c in _PLACE]
    return T.StructType([*[blocks.schema[c] for c in carry], *places, *arrays])


def _cut(blocks: DataFrame, values: Sequence[str], plan: Callable[[dict], Move], grid, carry: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Patches of moved blocks for the windows of ``grid``. No shuffle."""
    values, carry = tuple(values), tuple(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _Batch(batch, carry, {v: batch.schema.field(v).type for v in values})
            plain = [c for c in batch.schema.names if c not in values]
            for at, row in enumerate(batch.select(plain).to_pylist()):
                cells = {}
                for v in values:
                    held = batch.column(v)[at]
                    cells[v] = held.values if held.is_valid else pa.nulls(row["height"] * row["width"], held.type.value_type)
                for place, index in _pieces(row, plan(row), grid):
                    found.add(at, place, {v: flat.take(pa.array(index)) for v, flat in cells.items()})
                    if found.cells >= BATCH_CELLS:
                        yield found.flush()
            if found.cells:
                yield found.flush()

    return blocks.mapInArrow(run, _patch_schema(blocks, carry, [blocks.schema[v] for v in values]))


def _cells(place: dict) -> np.ndarray:
    """Positions of a patch in its window."""
    rows = place["top"] + np.arange(place["rows"])
    return (rows[:, None] * place["width"] + place["left"] + np.arange(place["cols"])[None, :]).ravel()


def _flat(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays([chunk.flatten() for chunk in table.column(name).chunks])


def _window_columns(table: pa.Table, carry: Sequence[str]) -> dict[str, pa.ChunkedArray]:
    return {c: table.column(c).slice(0, 1) for c in (*carry, *_WINDOW)}


def _one_list(values: pa.Array, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(kind)


def _grouped(patches: DataFrame, make: Callable[[pa.Table], pa.Table], arrays: Sequence[T.StructField]) -> DataFrame:
    window = [patches.schema[c] for c in ("scene_id", *_WINDOW)]
    return patches.groupBy(*BLOCK_KEY).applyInArrow(make, T.StructType([*window, *arrays]))


def _placed(patches: DataFrame, values: Sequence[str]) -> DataFrame:
    """Windows put together from patches that do not overlap."""
    values = tuple(values)

    def make(table: pa.Table) -> pa.Table:
        places = table.select(_PLACE).to_pylist()
        at = np.concatenate([_cells(p) for p in places])
        order = np.full(places[0]["height"] * places[0]["width"], -1, dtype=np.int64)
        order[at] = np.arange(len(at))
        if np.count_nonzero(order >= 0) != len(at):
            raise ValueError("two pixels at one position of a raster")
        index = pa.array(order, mask=order < 0)
        columns = _window_columns(table, ["scene_id"])
        for v in values:
            columns[v] = _one_list(_flat(table, v).take(index), table.schema.field(v).type)
        return pa.table(columns)

    return _grouped(patches, make, [patches.schema[v] for v in values])


def _with_scenes(blocks: DataFrame, rasters: DataFrame, values: Sequence[str], **extra: Column) -> DataFrame:
    """Block columns that are needed, with the size of the scene as ``_h`` and ``_w``."""
    scenes = rasters.select(
        "scene_id", F.col("height").cast("int").alias("_h"), F.col("width").cast("int").alias("_w"),
        *[column.alias(name) for name, column in extra.items()],
    )
    unknown = F.raise_error(F.lit("a block belongs to no raster")).cast("int")
    rows = blocks.select("scene_id", "y_off", "x_off", "height", "width", *values).join(scenes, "scene_id", "left")
    return rows.withColumn("_h", F.coalesce("_h", unknown))


# ------------------------------------------------------------------ halos and tiles


def with_halo(blocks: DataFrame, values: Sequence[str], rasters: DataFrame, halo: int, size: int = BLOCK) -> DataFrame:
    """Blocks that also hold the rims of their neighbours, ``halo`` pixels deep, up to the scene's edge.

    Offsets and sizes are those of the wider window; :func:`without_halo` cuts it down again. The rim
    may be deeper than a block.
    """
    if halo < 0 or size <= 0:
        raise ValueError("a halo must not be negative, a block must have a size")
    return _placed(_cut(_with_scenes(blocks, rasters, values), values, _stay, Rimmed(size, halo)), values)


def without_halo(windows: DataFrame, values: Sequence[str], halo: int, size: int = BLOCK) -> DataFrame:
    """The blocks inside the windows of :func:`with_halo`. No shuffle.

    At the lower and right edge of a scene a window ends with its block, so only what is wider than the
    block on that side is cut.
    """
    top, left = (F.least(F.col(b) * size, F.lit(halo)) for b in ("block_row", "block_col"))
    # names of their own: inside a lambda a new column would hide the old one of its name
    rows = windows.withColumns({"_top": top, "_left": left, "_wide": F.col("width")})
    height = F.least(F.col("height") - F.col("_top"), F.lit(size))
    width = F.least(F.col("width") - F.col("_left"), F.lit(size))
    rows = rows.withColumns({"_rows": height, "_cols": width})

    def core(v: str) -> Column:
        lines = F.sequence(F.col("_top"), F.col("_top") + F.col("_rows") - 1)
        return F.flatten(
            F.transform(lines, lambda r: F.slice(F.col(v), r * F.col("_wide") + F.col("_left") + 1, F.col("_cols")))
        )

    return rows.select(
        *BLOCK_KEY, (F.col("y_off") + F.col("_top")).alias("y_off"), (F.col("x_off") + F.col("_left")).alias("x_off"),
        F.col("_rows").alias("height"), F.col("_cols").alias("width"), *[core(v).alias(v) for v in values],
    )


def tile_windows(blocks: DataFrame, values: Sequence[str], rasters: DataFrame, size: int, overlap: int) -> DataFrame:
    """Overlapping tiles put together from blocks, in block layout, with ``tile_row, tile_col, tile_ord``."""
    check_layout(size, overlap)
    tiles = _placed(_cut(_with_scenes(blocks, rasters, values), values, _stay, Tiles(size, overlap)), values)
    scenes = rasters.select("scene_id", F.col("width").cast("int").alias("_w"))
    per_row = F.ceil(F.greatest(F.col("_w") - size, F.lit(0)) / F.lit(size - overlap)).cast("int") + 1
    return tiles.join(scenes, "scene_id").select(
        "scene_id", F.col("block_row").alias("tile_row"), F.col("block_col").alias("tile_col"),
        (F.col("block_row") * per_row + F.col("block_col")).alias("tile_ord"), "y_off", "x_off", "height", "width", *values,
    )


def mosaic_blocks(tiles: DataFrame, rasters: DataFrame, size: int = BLOCK) -> DataFrame:
    """Merge scored tiles (``pred_id``, ``conf`` arrays) into blocks, as :func:`rasters.mosaic` does by pixel.

    The most confident prediction wins and the earliest tile wins ties; NULL, NaN and values not above -1
    never win. Cells without a winner get class 0 and confidence 0.
    """
    carry = ("scene_id", "tile_ord")
    rows = tiles.select("tile_ord", "scene_id", "y_off", "x_off", "height", "width", "pred_id", "conf")
    rows = rows.join(
        rasters.select("scene_id", F.col("height").cast("int").alias("_h"), F.col("width").cast("int").alias("_w")), "scene_id"
    )
    rows = rows.withColumns({"pred_id": F.col("pred_id").cast("array<int>"), "conf": F.col("conf").cast("array<double>")})

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("tile_ord")
        places = table.select(_PLACE).to_pylist()
        best = np.full(places[0]["height"] * places[0]["width"], -1.0)
        winner = np.zeros(len(best), dtype=np.int32)
        conf = _flat(table, "conf").to_numpy(zero_copy_only=False)
        pred = _flat(table, "pred_id").fill_null(0).to_numpy(zero_copy_only=False)
        start = 0
        for place in places:
            at = _cells(place)
            stop = start + len(at)
            better = conf[start:stop] > best[at]
            best[at[better]], winner[at[better]] = conf[start:stop][better], pred[start:stop][better]
            start = stop
        columns = _window_columns(table, ["scene_id"])
        columns["pred_id"] = _one_list(pa.array(winner), table.schema.field("pred_id").type)
        columns["conf"] = _one_list(pa.array(np.maximum(best, 0.0)), table.schema.field("conf").type)
        return pa.table(columns)

    patches = _cut(rows, ["pred_id", "conf"], _stay, Blocks(size), carry)
    return _grouped(patches, make, [patches.schema[v] for v in ("pred_id", "conf")])


# ------------------------------------------------------------------ moves


def transform_blocks(blocks: DataFrame, values: Sequence[str], rasters: DataFrame, change: Column, size: int = BLOCK) -> DataFrame:
    """Flip and turn scenes as :func:`images.transform_pixels` does by pixel.

    ``change`` is a column of ``rasters`` (see :func:`images.augmentation`). The canvas keeps its size: pixels
    that leave it are lost, and cells that nothing comes to are NULL or, if whole blocks, absent.
    """
    return _placed(_cut(_with_scenes(blocks, rasters, values, _t=change), values, _turn, Blocks(size)), values)


def resize_blocks_nearest(blocks: DataFrame, values: Sequence[str], rasters: DataFrame, new_height: Column, new_width: Column, size: int = BLOCK) -> DataFrame:
    """Each output pixel copies the input pixel under its centre; new sizes are columns of ``rasters``."""
    rows = _with_scenes(blocks, rasters, values, _nh=new_height.cast("int"), _nw=new_width.cast("int"))
    return _placed(_cut(rows, values, _nearest, Blocks(size)), values)


# ------------------------------------------------------------------ separable filters


@dataclass(frozen=True)
class Triangle:
    """Linear interpolation whose triangle widens with the scale when the image shrinks."""

    def outputs(self, low: int, high: int, old: int, new: int) -> tuple[int, int]:
        """Range of outputs that the sources ``low`` to ``high - 1`` may feed."""
        scale = old / new
        reach = max(scale, 1.0)
        first = int(np.floor((low + 0.5 - reach) / scale - 0.5)) - 1
        return max(first, 0), min(int(np.ceil((high - 0.5 + reach) / scale - 0.5)) + 2, new)

    def weights(self, first: int, stop: int, low: int, high: int, old: int, new: int) -> np.ndarray:
        """A row per output, a column per source."""
        scale = old / new
        reach = max(scale, 1.0)
        centre = (np.arange(first, stop) + 0.5) * scale
        begin = np.maximum(np.floor(centre - reach + 0.5), 0).astype(np.int64)
        end = np.minimum(np.floor(centre + reach + 0.5), old).astype(np.int64)

        def height(j: np.ndarray) -> np.ndarray:
            inside = (j >= begin[:, None]) & (j < end[:, None])
            return np.where(inside, np.maximum(1.0 - np.abs((j + 0.5 - centre[:, None]) / reach), 0.0), 0.0)

        support = begin[:, None] + np.arange(int((end - begin).max(initial=0)))[None, :]
        return height(np.arange(low, high)[None, :]) / height(support).sum(axis=1)[:, None]


@dataclass(frozen=True)
class Pair:
    """Signed sum of two neighbours, at every second position; an odd last one is dropped."""

    first_sign: int

    def outputs(self, low: int, high: int, old: int, new: int) -> tuple[int, int]:
        return low // 2, min((high - 1) // 2 + 1, new)

    def weights(self, first: int, stop: int, low: int, high: int, old: int, new: int) -> np.ndarray:
        source = np.arange(low, high)
        sign = np.where(source % 2 == 0, self.first_sign, 1)
        return np.where(source[None, :] // 2 == np.arange(first, stop)[:, None], sign[None, :], 0).astype(np.float64)


def filter_blocks(
    blocks: DataFrame,
    bands: Mapping[str, tuple[str, Triangle | Pair, Triangle | Pair]],
    rasters: DataFrame,
    new_height: Column,
    new_width: Column,
    size: int = BLOCK,
    scale: float = 1.0,
    least: int = 1,
) -> DataFrame:
    """Separable filters: each band is a value with one filter down and one across.

    A block sends, for each output block, its share of the weighted sums; shares meet at the rims alone
    and are added in order of their sources, so reruns agree. Missing pixels add nothing; an output fed by
    fewer than ``least`` pixels is NULL. An input that is not finite makes what it feeds NaN.
    """
    bands = dict(bands)
    values = tuple(dict.fromkeys(value for value, _, _ in bands.values()))
    rows = _with_scenes(blocks, rasters, values, _nh=new_height.cast("int"), _nw=new_width.cast("int"))
    rows = rows.withColumns({v: F.col(v).cast("array<double>") for v in values})
    doubles, counts = pa.list_(pa.field("element", pa.float64())), pa.list_(pa.field("element", pa.int32()))
    kinds = {**{name: doubles for name in bands}, **{f"_n_{name}": counts for name in bands}}

    def shares(row: dict, cells: dict[str, tuple[np.ndarray, ...]], grid: Blocks):
        y, x, h, w, nh, nw = (int(row[c]) for c in ("y_off", "x_off", "height", "width", "_nh", "_nw"))
        down, across = {b[1] for b in bands.values()}, {b[2] for b in bands.values()}
        spans = [f.outputs(y, y + h, row["_h"], nh) for f in down], [f.outputs(x, x + w, row["_w"], nw) for f in across]
        (top, bottom), (left, right) = ((min(s[0] for s in axis), max(s[1] for s in axis)) for axis in spans)
        if top >= bottom or left >= right:
            return
        for i, y0, y1 in grid.touching(top, bottom, nh):
            r0, r1 = max(y0, top), min(y1, bottom)
            by_row = {f: f.weights(r0, r1, y, y + h, row["_h"], nh) for f in down}
            for j, x0, x1 in grid.touching(left, right, nw):
                c0, c1 = max(x0, left), min(x1, right)
                by_col = {f: f.weights(c0, c1, x, x + w, row["_w"], nw).T for f in across}
                parts = {}
                for name, (value, f, g) in bands.items():
                    numbers, present, odd = cells[value]
                    a, b = by_row[f], by_col[g]
                    # counts are whole numbers, exact in double precision
                    hit = lambda mask: (a != 0).astype(np.float64) @ mask @ (b != 0)  # noqa: B023, E731
                    total = (a @ numbers @ b) * scale
                    if odd is not None:
                        total = np.where(hit(odd) > 0, np.nan, total)
                    parts[name] = pa.array(total.ravel())
                    parts[f"_n_{name}"] = pa.array(hit(present).astype(np.int32).ravel())
                yield (i, j, y0, x0, y1 - y0, x1 - x0, r0 - y0, c0 - x0, r1 - r0, c1 - c0), parts

    def read(held: pa.ListScalar, h: int, w: int) -> tuple[np.ndarray, ...]:
        flat = held.values if held.is_valid else pa.nulls(h * w, pa.float64())
        present = flat.is_valid().to_numpy(zero_copy_only=False).reshape(h, w)
        numbers = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(h, w)
        finite = np.isfinite(numbers)
        odd = None if finite.all() else (~finite).astype(np.float64)
        return np.where(finite, numbers, 0.0), present.astype(np.float64), odd

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = Blocks(size)
        for batch in batches:
            found = _Batch(batch, ["scene_id", "_from"], kinds)
            plain = [c for c in batch.schema.names if c not in values]
            for at, row in enumerate(batch.select(plain).to_pylist()):
                cells = {v: read(batch.column(v)[at], row["height"], row["width"]) for v in values}
                for place, parts in shares(row, cells, grid):
                    found.add(at, place, parts)
                    if found.cells >= BATCH_CELLS:
                        yield found.flush()
            if found.cells:
                yield found.flush()

    def make(table: pa.Table) -> pa.Table:
        # blocks of one scene, so their offsets name them
        table = table.sort_by("_from")
        places = table.select(_PLACE).to_pylist()
        n = places[0]["height"] * places[0]["width"]
        columns = _window_columns(table, ["scene_id"])
        for name in bands:
            total, count, start = np.zeros(n), np.zeros(n, dtype=np.int64), 0
            sums = _flat(table, name).to_numpy(zero_copy_only=False)
            hits = _flat(table, f"_n_{name}").to_numpy(zero_copy_only=False)
            for place in places:
                at = _cells(place)
                total[at] += sums[start : start + len(at)]
                count[at] += hits[start : start + len(at)]
                start += len(at)
            columns[name] = _one_list(pa.array(total, mask=count < least), doubles)
        return pa.table(columns)

    # sources are ordered by row and column
    rows = rows.withColumn("_from", F.col("y_off").cast("long") * (1 << 32) + F.col("x_off"))
    fields = [T.StructField(name, T.ArrayType(T.DoubleType())) for name in bands]
    extra = [T.StructField(f"_n_{name}", T.ArrayType(T.IntegerType())) for name in bands]
    patches = rows.mapInArrow(run, _patch_schema(rows, ["scene_id", "_from"], [*fields, *extra]))
    return _grouped(patches, make, fields)


def resize_blocks(blocks: DataFrame, values: Sequence[str], rasters: DataFrame, new_height: Column, new_width: Column, size: int = BLOCK) -> DataFrame:
    """Bilinear resize with a size per scene, as :func:`images.resize_bilinear` does for one size by pixel."""
    bands = {v: (v, Triangle(), Triangle()) for v in values}
    return filter_blocks(blocks, bands, rasters, new_height, new_width, size)


def haar_blocks(blocks: DataFrame, value: str, rasters: DataFrame, size: int = BLOCK) -> DataFrame:
    """Four sub-bands of each 2 x 2 cell, wherever block borders fall.

    An odd last row or column is dropped; a cell with a missing pixel is NULL.
    """
    low, high = Pair(1), Pair(-1)
    bands = {"ll": (value, low, low), "lh": (value, high, low), "hl": (value, low, high), "hh": (value, high, high)}
    halves = [F.floor(F.col(c) / 2) for c in ("height", "width")]
    return filter_blocks(blocks, bands, rasters, *halves, size, HAAR_SCALE, least=4)
