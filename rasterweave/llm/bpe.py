"""Byte-level BPE encoding and decoding of whole texts of any length.

Ordinary texts are encoded where they are read. A text longer than one piece is cut into pieces at
fixed positions, wherever that falls; the pieces are encoded as separate rows, and neighbours are
joined level by level as in a binary tree. At each join a window of tokens around the seam is
decoded and widened until it holds, on each side, a place where every encoding of the two characters
there has a boundary, whatever comes before or behind them. Between these two places the text is
encoded anew; beyond them both sides agree with an encoding of the whole and stand as they are.

Token ids travel as one binary per text, little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.common import boxed, drop_states, quoted, stored, worker_state

IDS = np.dtype("<u4")
#: characters of a piece; cached words of a worker
PIECE, CACHED = 32_768, 200_000
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
_SPACE_RUN = re.compile(r"\s ")
#: sure boundaries: before ASCII white space behind another character, and before a mark of
#: punctuation behind a letter or digit; pre-tokens hold neither, and special tokens neither
_SURE = re.compile(
    r"(?<=\S)(?=[ \t\n\v\f\r])|(?<=[A-Za-z0-9\u00C0-\u00D6\u0410-\u044F\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3])(?=[,.;:!?\uFF0C\u3002\u3001\uFF01\uFF1F])"
)


def tokenizer_text(path: str) -> str:
    """The tokenizer's definition as text; workers build it from this, without the file."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """A tokenizer with the words it has met; belongs to one worker.

    No token reaches over a space that follows another character, so texts are looked up in parts
    that begin there.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.first: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        byte, vocab = byte_of(), self.tokenizer.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.pieces[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.starts = np.array([not p or p[0] & 0xC0 != 0x80 for p in self.pieces])

    def _learn(self, cache: dict[str, bytes], words: set[str], lead: str) -> None:
        new = list(words)
        for word, e in zip(new, self.tokenizer.encode_batch_fast([lead + w for w in new], add_special_tokens=False)):
            cache[word] = np.array(e.ids, IDS).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text."""
        if not text:
            return b""
        if _SPACE_RUN.search(text):
            parts = _BEFORE_SPACE.split(text)
            head, words = parts[0], [p[1:] for p in parts[1:]]
        else:
            head, *words = text.split(" ")
        if not head:  # the text begins with its only leading space
            head, words = " " + words[0], words[1:]
        if len(self.spaced) > CACHED or len(self.first) > CACHED:
            self.spaced.clear()
            self.first.clear()
        if head not in self.first:
            self._learn(self.first, {head}, "")
        new = set(words).difference(self.spaced)
        if new:
            self._learn(self.spaced, new, " ")
        return self.first[head] + b"".join(map(self.spaced.__getitem__, words))

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))

    def decode(self, ids: bytes) -> str:
        """Text of ids; special tokens give their own text."""
        return self.bytes_of(np.frombuffer(ids, IDS)).decode("utf-8", "replace")

    def _cut(self, ids: np.ndarray, width: int, last: bool) -> int:
        """Place in ``ids`` of a sure boundary of their text, near its end or its start.

        The window grows until it holds one; a text without any is taken whole.
        """
        while True:
            size = min(width, len(ids))
            while size < len(ids) and not self.starts[ids[-size if last else size]]:
                size += 1  # windows begin and end between characters
            part = ids[len(ids) - size :] if last else ids[:size]
            text = self.bytes_of(part).decode("utf-8", "surrogatepass")
            found = [m.start() for m in _SURE.finditer(text)]
            if found:
                offset = len(text[: found[-1 if last else 0]].encode("utf-8", "surrogatepass"))
                ends = np.cumsum([len(self.pieces[i]) for i in part.tolist()])
                at = int(np.searchsorted(ends, offset)) + 1
                return len(ids) - size + at if last else at
            if size == len(ids):
                return 0 if last else size
            width *= 4

    def join(self, left: bytes, right: bytes, width: int = 8) -> bytes:
        """Ids of the text of ``left`` followed by that of ``right``."""
        a, b = np.frombuffer(left, IDS), np.frombuffer(right, IDS)
        if not len(a) or not len(b):
            return left + right
        low, high = self._cut(a, width, last=True), self._cut(b, width, last=False)
        between = self.bytes_of(a[low:]) + self.bytes_of(b[:high])
        return a[:low].tobytes() + self.encode(between.decode("utf-8", "surrogatepass")) + b[high:].tobytes()


def codec(definition: str) -> Codec:
    key = f"bpe-{hash(definition)}"
    drop_states("bpe-", key)
    return worker_state(key, lambda: Codec(definition))


def _check(definition: str) -> None:
    kind = json.loads(definition)
    if kind["normalizer"] or kind["pre_tokenizer"].get("type") != "ByteLevel":
        raise ValueError("only byte-level tokenizers without normalizer can be joined exactly")


def encode(
    docs: DataFrame, definition: str, text_col: str = "text", out: str = "ids", piece: int = PIECE
) -> DataFrame:
    """``docs`` with the ids of every whole text, as the tokenizer gives them without special tokens.

    Null and empty texts have no ids, but an empty binary. Repeated rows stay repeated, other
    columns pass unchanged, and a column named ``out`` is replaced. Every text, however long, is
    encoded completely; only the ids of one text need to fit into a worker.
    """
    _check(definition)
    docs = docs.drop(out) if out in docs.columns else docs
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # a vocabulary file of about 2 MB

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(shared.value)
        for texts in batches:
            yield pd.Series([own.encode(t) if t else b"" for t in texts], dtype=object)

    @F.pandas_udf("binary")
    def joined(lefts: pd.Series, rights: pd.Series) -> pd.Series:
        own = codec(shared.value)
        return pd.Series([a if b is None else own.join(a, b) for a, b in zip(lefts, rights)], dtype=object)

    def cut(batches):
        for batch in batches:
            for row, text in zip(batch["_row"], batch["_text"]):
                for i, start in enumerate(range(0, len(text), piece)):
                    yield pd.DataFrame({"_row": [row], "_i": [i], "_piece": [text[start : start + piece]]})

    text = F.col(quoted(text_col))
    long = F.coalesce(F.length(text) > piece, F.lit(False))
    short = docs.where(~long).withColumn(out, encoded(text))
    # row numbers must not change when a task is repeated, so the long rows are written first
    whole = stored(boxed(docs.where(long)).withColumn("_row", F.monotonically_increasing_id()), "long")
    inside = F.col(f"row.{quoted(text_col)}")
    most = whole.agg(F.max(F.length(inside))).first()[0] or 0
    if not most:
        return short
    level = (
        whole.select("_row", inside.alias("_text"))
        .mapInPandas(cut, "_row long, _i long, _piece string")
        .repartition("_row", "_i")
        .select("_row", "_i", encoded("_piece").alias("_ids"))
    )
    left, count = "_i % 2 = 0", -(-most // piece)
    while count > 1:
        level = (
            level.groupBy("_row", F.expr("_i div 2").alias("_at"))
            .agg(F.max(F.when(F.expr(left), F.col("_ids"))).alias("_a"), F.max(F.when(~F.expr(left), F.col("_ids"))).alias("_b"))
            .select("_row", F.col("_at").alias("_i"), joined("_a", "_b").alias("_ids"))
        )
        count = -(-count // 2)
    ends = level.select("_row", F.col("_ids").alias(out))
    return short.unionByName(whole.join(ends, "_row").select("row.*", out))


def decode(rows: DataFrame, definition: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids, special tokens included; null ids give an empty text.

    Bytes that are no UTF-8 become replacement characters. A column named ``out`` is replaced.
    """
    shared = rows.sparkSession.sparkContext.broadcast(definition)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(shared.value)
        for ids in batches:
            yield pd.Series([own.decode(x) if x else "" for x in ids], dtype=object)

    return rows.withColumn(out, decoded(F.col(ids_col)))
