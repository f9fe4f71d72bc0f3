"""Grids stored as NumPy files, as a data source that splits large files and skips what a filter excludes.

``npy_grids`` reads ``.npy`` files of any size: the header of a large file is parsed once, its rows are
planned as byte ranges of whole block rows, and each task reads its own range. Small files share
tasks. Filters on ``scene_id``, ``block_row`` and ``block_col`` leave out files, ranges and columns before
anything is read. ``.npz`` archives are compressed as a whole and cannot be split; one task decodes one.

A scene may be stored whole or in strips of rows: ``<name>12.npy`` is scene 12, ``<name>12-rows-512.npy``
is the part of it that begins at row 512. :func:`write_grids` stores blocks in such strips.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from rasterweave.schemas import BLOCKS

FORMAT = "npy_grids"
SCHEMA = f"path STRING, {BLOCKS}, confidence ARRAY<FLOAT>, error STRING"
_NAME = re.compile(r"([0-9]+)(?:-rows-([0-9]+))?[^0-9/]*$")
#: bytes that hold the header of any file written by NumPy for a plain type
HEADER = 65_536
PLACE = ("scene_id", "block_row", "block_col")
#: values that exclude nothing
ALL = (None, None)


def file_system(path: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if "://" in path:
        return pfs.FileSystem.from_uri(path)
    return pfs.LocalFileSystem(), re.sub("^file:", "", path)


@dataclass(frozen=True)
class Header:
    """Layout of a file: values begin at ``start``, row by row, or column by column if ``turned``."""

    start: int
    height: int
    width: int
    dtype: str
    turned: bool


def read_header(data: bytes, size: int) -> Header:
    """Header of a two-dimensional ``.npy`` file of ``size`` bytes, from its beginning."""
    stream = io.BytesIO(data)
    version = np.lib.format.read_magic(stream)
    readers = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
    if version not in readers:
        raise ValueError(f"unknown format version {version}")
    shape, turned, dtype = readers[version](stream)
    if dtype.hasobject:
        raise ValueError("the file holds Python objects")
    if len(shape) != 2:
        raise ValueError(f"expected a two-dimensional grid, found {len(shape)} dimensions")
    if stream.tell() + shape[0] * shape[1] * dtype.itemsize > size:
        raise ValueError("the file is shorter than its header says")
    return Header(stream.tell(), *shape, dtype.str, turned and shape[0] > 1 and shape[1] > 1)


@dataclass(frozen=True)
class Piece(InputPartition):
    """Files, each with its size and the range of lines of blocks (rows; columns if turned) to read."""

    files: tuple[tuple[str, int, int | None, int | None], ...]


class GridReader(DataSourceReader):
    """Plans and reads pieces of files; ``ranges`` are the inclusive bounds that filters leave."""

    def __init__(self, options: dict[str, str]):
        self.path, self.block = options["path"], int(options.get("block", 256))
        self.split = int(options.get("split", 64 * 2**20))
        if self.block <= 0 or self.split <= 0:
            raise ValueError("block and split must be positive")
        self.ranges: dict[str, tuple[int | None, int | None]] = dict.fromkeys(PLACE, ALL)
        self.scenes: frozenset[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Take bounds of the place columns; every filter is still applied to the rows by Spark."""
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if name in PLACE:
                low, high = self.ranges[name]
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    least = f.value + isinstance(f, GreaterThan)
                    low = least if low is None else max(low, least)
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    most = f.value - isinstance(f, LessThan)
                    high = most if high is None else min(high, most)
                if isinstance(f, In) and name == "scene_id":
                    mine = frozenset(f.value)
                    self.scenes = mine if self.scenes is None else self.scenes & mine
                self.ranges[name] = (low, high)
            yield f

    def _within(self, name: str, value: int | None) -> bool:
        low, high = self.ranges[name]
        if value is None:  # a file without a number is no scene that a filter could ask for
            return low is None and high is None and self.scenes is None
        return (low is None or value >= low) and (high is None or value <= high) and (
            name != "scene_id" or self.scenes is None or value in self.scenes
        )

    def partitions(self) -> list[Piece]:
        system, root = file_system(self.path)
        found = system.get_file_info(root)
        listed = [found] if found.is_file else system.get_file_info(pfs.FileSelector(root, recursive=True))
        pieces, small, held = [], [], 0
        for info in sorted((i for i in listed if i.is_file and re.search(r"\.np[yz]$", i.path)), key=lambda i: i.path):
            scene, offset = place_of(info.path)
            if not self._within("scene_id", scene):
                continue
            if info.size > self.split and info.path.endswith(".npy"):
                pieces += [Piece(((info.path, info.size, a, b),)) for a, b in self._cuts(system, info, offset)]
                continue
            if small and held + info.size > self.split:
                pieces.append(Piece(tuple(small)))
                small, held = [], 0
            small.append((info.path, info.size, None, None))
            held += info.size
        return pieces + ([Piece(tuple(small))] if small else [])

    def _cuts(self, system: pfs.FileSystem, info: pfs.FileInfo, offset: int) -> list[tuple[int | None, int | None]]:
        """Ranges of block lines of a large file; one range without bounds where it cannot be read."""
        try:
            head = _header(system, info.path, info.size)
        except Exception:  # the task that reads the file reports the problem
            return [(None, None)]
        lines, across = (head.width, head.height) if head.turned else (head.height, head.width)
        line = max(1, across * np.dtype(head.dtype).itemsize * self.block)
        step = max(1, self.split // line)
        name, first = ("block_col", 0) if head.turned else ("block_row", offset // self.block)
        low, high = self.ranges[name]
        count = -(-lines // self.block)
        a = max(0, (low or 0) - first) if low is not None else 0
        b = min(count, high - first + 1) if high is not None else count
        return [(i, min(i + step, b)) for i in range(a, b, step)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        for path, size, first, last in partition.files:
            scene, offset = place_of(path)
            try:
                for row in self._blocks(system, path, size, first, last, offset):
                    yield _batch([(path, scene, *row, None)])
            except Exception as problem:  # any decode problem becomes a row
                yield _batch([(path, scene, *[None] * 7, str(problem))])

    def _blocks(self, system, path, size, first, last, offset) -> Iterator[tuple]:
        if offset % self.block:
            raise ValueError(f"a strip that begins at row {offset} does not fit blocks of {self.block}")
        if path.endswith(".npz"):
            with system.open_input_file(path) as file, np.load(io.BytesIO(file.read()), allow_pickle=False) as archive:
                grid = archive["arr_0"]
            if grid.ndim != 2:
                raise ValueError(f"expected a two-dimensional grid, found {grid.ndim} dimensions")
            yield from self._cut(grid, 0, 0, offset)
            return
        head = _header(system, path, size)
        lines, across = (head.width, head.height) if head.turned else (head.height, head.width)
        dtype = np.dtype(head.dtype)
        count = -(-lines // self.block)
        name, base = ("block_col", 0) if head.turned else ("block_row", offset // self.block)
        with system.open_input_file(path) as file:
            for k in range(first or 0, count if last is None else last):
                if self._within(name, base + k):
                    a, b = k * self.block, min((k + 1) * self.block, lines)
                    data = file.read_at((b - a) * across * dtype.itemsize, head.start + a * across * dtype.itemsize)
                    part = np.frombuffer(data, dtype).reshape(b - a, across)
                    yield from self._cut(part.T, 0, a, offset) if head.turned else self._cut(part, a, 0, offset)

    def _cut(self, part: np.ndarray, top: int, left: int, offset: int) -> Iterator[tuple]:
        for y in range(0, part.shape[0], self.block):
            for x in range(0, part.shape[1], self.block):
                row, col = (offset + top + y) // self.block, (left + x) // self.block
                if self._within("block_row", row) and self._within("block_col", col):
                    cells = part[y : y + self.block, x : x + self.block]
                    yield row, col, offset + top + y, left + x, *cells.shape, cells.astype(np.float32).ravel()


class GridSource(DataSource):
    """``path`` (a file or folder), ``block`` (side of the blocks), ``split`` (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GridReader:
        return GridReader(self.options)


def place_of(path: str) -> tuple[int | None, int]:
    """Scene id (None without a number) and first row of a file, from its name."""
    match = _NAME.search(path.rsplit("/", 1)[-1])
    return (int(match[1]), int(match[2] or 0)) if match else (None, 0)


def _header(system: pfs.FileSystem, path: str, size: int) -> Header:
    with system.open_input_file(path) as file:
        return read_header(file.read_at(min(HEADER, size), 0), size)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ints = pa.int32()
    types = [pa.string(), pa.int64(), *[ints] * 6, pa.list_(pa.float32()), pa.string()]
    names = ["path", "scene_id", "block_row", "block_col", "y_off", "x_off", "height", "width", "confidence", "error"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def scan_grids(spark: SparkSession, path: str, block: int = 256, split: int = 64 * 2**20) -> DataFrame:
    """Blocks of all grids at ``path``, read as far as the query's filters on the place columns need.

    A file that cannot be decoded gives one row with ``error`` instead of failing the job; a query for
    places leaves such rows out. Storage that pyarrow has no file system for is read by
    :func:`rasterweave.sources.arrays.read_grids`.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridSource)
    return spark.read.format(FORMAT).option("block", block).option("split", split).load(path)


def write_grids(blocks: DataFrame, path: str, value: str, dtype: str = "<f4") -> None:
    """Store blocks as ``.npy`` strips, one file for each row of blocks of a scene.

    A task holds one strip. The file is written under a name of its own and moved in place when it is
    complete, so a repeated task leaves one file, and readers see whole ones. Missing blocks and null
    cells become NaN, or 0 where ``dtype`` has none.
    """

    def store(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        scene = key[0]
        top, height = int(parts["y_off"].iloc[0]), int(parts["height"].max())
        kind = np.dtype(dtype)
        strip = np.full((height, int((parts["x_off"] + parts["width"]).max())), np.nan if kind.kind == "f" else 0, kind)
        for row in parts.itertuples():
            cells = pd.array(getattr(row, value), dtype="Float64").to_numpy(dtype=float, na_value=np.nan)
            cells = cells if kind.kind == "f" else np.nan_to_num(cells)
            strip[: row.height, row.x_off : row.x_off + row.width] = cells.reshape(row.height, row.width)
        system, root = file_system(path)
        folder, name = f"{root}/scene-{scene}", f"strip-{scene}-rows-{top}.npy"
        system.create_dir(folder, recursive=True)
        own = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(own) as file:
            np.lib.format.write_array(file, strip, version=(1, 0), allow_pickle=False)
        system.move(own, f"{folder}/{name}")
        return pd.DataFrame({"rows": [height]})

    columns = ["scene_id", "block_row", "y_off", "x_off", "height", "width", value]
    blocks.select(*columns).groupBy("scene_id", "block_row").applyInPandas(store, "rows int").agg(F.sum("rows")).collect()
