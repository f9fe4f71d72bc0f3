import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rasterweave.llm import bpe, queries, wavelet

PATH = public_tokenizers.path("word_bpe_49k.json")
DEFINITION = bpe.tokenizer_text(PATH)
LIBRARY = Tokenizer.from_file(PATH)
OWN = wavelet.Words(DEFINITION)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["The", "é", "É", "'s", " ", "\n", " ", "\x1f", "\x85", "H̱", "́", " ́", "Σ", "ΟΣ", "1234", "!!", "<|endoftext|>",
                                 "<|ENDOFTEXT|>", "日本", "don't", "\t", "İ", "ǅ", "ﬁ"]), max_size=20).map("".join))
def test_words(text):
    assert np.frombuffer(OWN.encode(text), "<u4").tolist() == ids(text)


@pytest.mark.parametrize("n, high", [(0, 5), (1, 1), (700, 3), (3000, 49407), (wavelet.FRAME + 100, 70000)])
def test_queries_on_one_file(n, high):
    row = np.random.default_rng(n).integers(0, high, n).astype("<u4")
    one = wavelet.Shard(io.BytesIO(wavelet.pack(row, [n], [7])))
    assert (one.ids() == row).all() and len(one) == n
    for i in range(0, n, max(1, n // 50)):
        token = int(row[i])
        assert one.token(i) == token
        assert one.count(token, 0, i) == (row[:i] == token).sum()
        assert one.count(token) == (row == token).sum()
        assert one.locate(token, one.count(token, 0, i)) == i
    assert one.count(high + 1) == 0


def test_rows(spark, tmp_path):
    texts = [(5, "b a"), (None, "x"), (5, "b a"), (2, None), (3, ""), (5, "a b " * 50), (-1, "<|endoftext|>")]
    rows = spark.createDataFrame([(*t, "p") for t in texts], "doc_id long, text string, path string")
    shards = wavelet.write_shards(rows, DEFINITION, folder=f"file://{tmp_path}/s", shard=5)
    assert shards.count() > 3
    read = sorted(wavelet.read_documents(shards).collect(), key=lambda r: r["start"])
    at = 0
    assert [r["key"] for r in read] == [None, -1, 2, 3, 5, 5, 5]
    for r in read:
        own = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == at and own[-1] == 1
        at += len(own)
    expected = sorted((-9 if k is None else k, [*ids(t), 1]) for k, t in texts)
    assert sorted((-9 if r["key"] is None else r["key"], np.frombuffer(r["ids"], "<u4").tolist()) for r in read) == expected
    assert wavelet.digests(wavelet.write_shards(rows.limit(0), DEFINITION)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    rows = sorted(queries.op8_wavelet_shards(spark, folder).collect())
    at = 0
    for (key, text), r in zip(docs, rows, strict=True):
        own = np.array([*ids(text), 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (key, at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aZéÀÿß×.,#_-|@`~^>&9'<", max_size=12))
def test_plain_words(word):
    assert np.frombuffer(OWN.encode(word), "<u4").tolist() == ids(word)
