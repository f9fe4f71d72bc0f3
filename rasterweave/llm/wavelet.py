"""Token shards as wavelet matrices: one compressed file per shard that answers queries in place.

A shard holds the ids of consecutive documents as bit planes, from the highest bit to the lowest;
each plane orders the ids by the bits above it. Planes are stored in frames, each compressed on its
own with the number of ones before it, so that reading a token, counting an id in a range or finding
its occurrences opens a few frames per plane and never the whole file. Numbers in the file are
little-endian: a JSON header (its length first), then the frames.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.llm.bpe import byte_of
from rasterweave.llm.common import drop_states, fresh_folder, stored, worker_state

MAGIC = b"WMTX0001"
#: bits in a frame; ids in a shard, unless one document alone has more; cached words of a worker
FRAME, SHARD, CACHED = 1 << 17, 2_000_000, 500_000


#: Latin letters, which are single characters in either case, then other characters but ' and <
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=>-@\[-`{-~]*)")


class Words(dict):
    """A tokenizer that drops white space, as a map from words it has met to their ids.

    No token reaches over ASCII white space there, so a text's ids are those of its words. Nor does
    one reach from letters to other characters, so the letters of a plain word go straight to the
    merges.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        self.byte = {b: c for c, b in byte_of().items()}

    def _part(self, part: str) -> bytes:
        if part not in self.parts:
            mapped = "".join(map(self.byte.__getitem__, part.encode()))
            self.parts[part] = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        return self.parts[part]

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        plain = _PLAIN.fullmatch(text)
        if plain:
            letters, rest = plain.groups()
            ids = self._part(letters.lower()) + (self._part(rest) if rest else b"")
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(self) > CACHED:
            self.clear()
            self.parts.clear()
        return b"".join(map(self.__getitem__, text.encode("utf-8", "surrogatepass").split()))


def words(definition: str) -> Words:
    key = f"words-{hash(definition)}"
    drop_states("words-", key)
    return worker_state(key, lambda: Words(definition))


def pack(ids: np.ndarray, lengths: list[int], keys: list) -> bytes:
    """The file of one shard: ``ids`` of documents with these ``lengths`` and ``keys``."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    row = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    compressor, planes, body, at = zstandard.ZstdCompressor(level=1), [], [], 0
    for bit in range(bits - 1, -1, -1):
        ones = (row >> bit & 1).astype(bool)
        frames, before = [], 0
        for start in range(0, len(row), FRAME):
            part = ones[start : start + FRAME]
            data = compressor.compress(np.packbits(part, bitorder="little").tobytes())
            frames.append([at, len(data), before])
            before += int(np.count_nonzero(part))
            at += len(data)
            body.append(data)
        row = np.concatenate([row[~ones], row[ones]])
        planes.append({"ones": before, "frames": frames})
    head = json.dumps({"n": len(ids), "bits": bits, "keys": keys, "lengths": lengths, "planes": planes}).encode()
    head = zstandard.ZstdCompressor().compress(head)
    return b"".join([MAGIC, struct.pack("<Q", len(head)), head, *body])


class Shard:
    """Reads a shard's file; ``file`` needs ``seek`` and ``read``."""

    def __init__(self, file, kept: int = 64):
        self.file, self.kept, self.cache = file, kept, {}
        if file.read(8) != MAGIC:
            raise ValueError("not a token shard")
        (size,) = struct.unpack("<Q", file.read(8))
        head = json.loads(zstandard.ZstdDecompressor().decompress(file.read(size)))
        self.body = 16 + size
        self.n, self.bits, self.keys, self.planes = head["n"], head["bits"], head["keys"], head["planes"]
        self.starts = np.concatenate([[0], np.cumsum(head["lengths"])]).astype(np.int64)

    def __len__(self) -> int:
        return self.n

    def _frame(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self.cache:
            while len(self.cache) >= self.kept:
                self.cache.pop(next(iter(self.cache)))
            at, size, _ = self.planes[level]["frames"][k]
            self.file.seek(self.body + at)
            data = zstandard.ZstdDecompressor().decompress(self.file.read(size), max_output_size=FRAME // 8)
            length = min(FRAME, self.n - k * FRAME)
            self.cache[level, k] = np.unpackbits(np.frombuffer(data, np.uint8), count=length, bitorder="little")
        return self.cache[level, k]

    def _bit(self, level: int, i: int) -> int:
        return int(self._frame(level, i // FRAME)[i % FRAME])

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position ``i``."""
        k, rest = divmod(i, FRAME)
        if not rest:
            frames = self.planes[level]["frames"]
            return frames[k][2] if k < len(frames) else self.planes[level]["ones"]
        return self.planes[level]["frames"][k][2] + int(self._frame(level, k)[:rest].sum())

    def _step(self, level: int, bit: int, i: int) -> int:
        """Where position ``i`` of a plane lies in the next one if its bit is ``bit``."""
        ones = self._ones(level, i)
        return self.n - self.planes[level]["ones"] + ones if bit else i - ones

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of a plane."""
        frames = self.planes[level]["frames"]
        low, high = 0, len(frames) - 1
        while low < high:
            mid = (low + high + 1) // 2
            before = frames[mid][2] if bit else mid * FRAME - frames[mid][2]
            low, high = (mid, high) if before <= k else (low, mid - 1)
        before = frames[low][2] if bit else low * FRAME - frames[low][2]
        return low * FRAME + int(np.flatnonzero(self._frame(level, low) == bit)[k - before])

    def token(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = self._bit(level, i)
            value, i = value << 1 | bit, self._step(level, bit, i)
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        if token < 0 or token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            bit = token >> (self.bits - 1 - level) & 1
            low, high = self._step(level, bit, low), self._step(level, bit, high)
        return low, high

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of an id in positions ``start`` to ``stop``."""
        low, high = self._range(token, start, self.n if stop is None else stop)
        return high - low

    def locate(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        low, high = self._range(token, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - (self.n - self.planes[level]["ones"]) if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order, by merging the planes from the lowest upwards."""
        row = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            frames = [self._frame(level, k) for k in range(len(self.planes[level]["frames"]))]
            ones = np.concatenate(frames).astype(bool) if frames else np.zeros(0, bool)
            zeros = self.n - self.planes[level]["ones"]
            upper = np.empty_like(row)
            upper[~ones] = row[:zeros]
            upper[ones] = row[zeros:] | row.dtype.type(1 << (self.bits - 1 - level))
            row = upper
        return row.astype("<u4")


def open_shard(path: str) -> Shard:
    """A shard below any path that Spark's shared folder can have (file, hdfs, s3, ...)."""
    system, inside = fs.FileSystem.from_uri(path)
    return Shard(system.open_input_file(inside))


def _save(path: str, data: bytes) -> None:
    """Write whole or not at all; a repeated task writes the same bytes."""
    system, inside = fs.FileSystem.from_uri(path)
    draft = f"{inside}.{uuid.uuid4().hex}"
    system.create_dir(inside.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, inside)


def write_shards(
    docs: DataFrame,
    definition: str,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    shard: int = SHARD,
) -> DataFrame:
    """Write all texts as token shards in ascending order of the id; returns one row per shard.

    The rows are (part, file, path, n_docs, n_tokens, start), ``start`` counting the ids of all
    shards before. Each text's ids are followed by ``end_id``, so null and empty texts have one id.
    Null ids come first; rows with equal ids are ordered by their text; repeated rows are all
    written. Rows are dealt by ranges of (id, hash of the text), so one id may span many tasks, and
    a task holds one shard at a time. Other columns are ignored. An empty table has no shards.
    """
    spark = docs.sparkSession
    folder = folder or fresh_folder(spark, "shards")
    if "://" not in folder:  # a path on the default file system of a single machine
        folder = folder.replace("file:", "") if folder.startswith("file:") else folder
        folder = f"file://{folder}"
    shared = spark.sparkContext.broadcast(definition)  # a vocabulary file of about 2 MB

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, part = words(shared.value), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        parts, lengths, keys, size, file = [], [], [], 0, 0

        def flush() -> pd.DataFrame:
            path = f"{folder}/{part:06d}-{file:06d}.wm"
            _save(path, pack(np.frombuffer(b"".join(parts), "<u4"), lengths, keys))
            return pd.DataFrame({"part": [part], "file": [file], "path": [path], "n_docs": [len(keys)], "n_tokens": [size]})

        for batch in batches:
            for key, text in zip(batch["_k"], batch["_t"]):
                ids = own.encode(text) + end
                n = len(ids) // 4
                if keys and size + n > shard:
                    yield flush()
                    parts, lengths, keys, size, file = [], [], [], 0, file + 1
                parts.append(ids)
                lengths.append(n)
                keys.append(None if pd.isna(key) else int(key))
                size += n
        if keys:
            yield flush()

    rows = (
        docs.select(F.col(id_col).cast("string").alias("_k"), F.col(text_col).alias("_t"), F.col(id_col).alias("_o"))
        .withColumn("_h", F.xxhash64("_t"))
        .repartitionByRange("_o", "_h")
        .sortWithinPartitions("_o", "_h", "_t")
        .select("_k", "_t")
    )
    files = stored(rows.mapInPandas(write, "part int, file int, path string, n_docs long, n_tokens long"), "files")
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    # one row per task of the writing job
    before = totals.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("file")) - F.col("n_tokens")
    return files.join(before, "part").withColumn("start", F.col("_before") + inside).drop("_before")


def read_documents(shards: DataFrame, id_type: str = "long") -> DataFrame:
    """(key, start, ids) of every document in the shards; ``ids`` as little-endian 32-bit integers."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, start, ids in _documents(batches):
            yield pd.DataFrame({"key": pd.array([key], "Int64"), "start": [start], "ids": [ids.tobytes()]})

    return _spread(shards).mapInPandas(read, f"key {id_type}, start long, ids binary")


def _spread(shards: DataFrame) -> DataFrame:
    """A few shards to a task, as a list of files is too small for Spark to spread by itself."""
    return shards.select("path", "start").repartition(max(1, shards.count() // 4))


def digests(shards: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, read back from the shards."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"]):
                rows = [(k, s, len(x), zlib.crc32(x.tobytes())) for k, s, x in _documents([pd.DataFrame({"path": [path], "start": [start]})])]
                keys, starts, sizes, sums = zip(*rows)
                yield pd.DataFrame({"key": pd.array(keys, "Int64"), "start": starts, "n_tokens": sizes, "ids_crc32": sums})

    return _spread(shards).mapInPandas(read, "key long, start long, n_tokens long, ids_crc32 long")


def _documents(batches) -> Iterator[tuple]:
    for batch in batches:
        for path, start in zip(batch["path"], batch["start"]):
            one = open_shard(path)
            ids = one.ids()
            for i, key in enumerate(one.keys):
                low, high = one.starts[i], one.starts[i + 1]
                yield key, int(start + low), ids[low:high]
