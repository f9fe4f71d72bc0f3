import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rasterweave.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
DEFINITION = bpe.tokenizer_text(PATH)
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.Codec(DEFINITION)

awkward = st.lists(
    st.sampled_from(
        ["'s", "'", "''", "t", "s", "the", " ", "  ", "\n", "\n ", " \n", "\t", "!", "!!!", "a" * 40, "0", "123456", "é", "日本",
         "\U0001f600", "<|endoftext|>", "<|", "ll", "re", " ", "　", "́", "x's", "don't", "\x1f", "\r\n", "..", " 'tis"]
    ),
    max_size=30,
).map("".join)


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(awkward)
def test_words_from_the_cache(text):
    assert np.frombuffer(OWN.encode(text), bpe.IDS).tolist() == ids(text)
    assert OWN.decode(OWN.encode(text)) == LIBRARY.decode(ids(text), skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(awkward, st.integers(1, 40))
def test_joined_pieces(text, piece):
    parts = [OWN.encode(text[i : i + piece]) for i in range(0, len(text), piece)] or [b""]
    while len(parts) > 1:
        parts = [OWN.join(*parts[i : i + 2], width=1) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    assert np.frombuffer(parts[0], bpe.IDS).tolist() == ids(text)


def test_rows(spark):
    long = "".join(np.random.default_rng(1).choice(list("ab'!0 é\n"), 5000).tolist())
    texts = [None, "", " ", "a", "a", long, long, "x" * 3000, "é" * 777, " \n" * 500]
    rows = spark.createDataFrame([(i, t, "old", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, _row int")
    got = bpe.decode(bpe.encode(rows, DEFINITION, piece=100), DEFINITION).collect()
    assert len(got) == len(texts) and {r["_row"] for r in got} == {1}
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], bpe.IDS).tolist() == ids(text)
        assert r["decoded"] == text
    assert bpe.encode(rows.limit(0), DEFINITION).count() == 0


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError):
        bpe.encode(spark.range(1).selectExpr("'a' text"), bpe.tokenizer_text(public_tokenizers.path("word_bpe_49k.json")))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op5_tree_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = ids(texts[r["doc_id"]])
        assert r["n_tokens"] == len(expected)
        assert r["ids_sha256"] == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        decoded = LIBRARY.decode(expected, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_seams_of_all_kinds():
    """Pieces of any size, white space of all kinds, special tokens across the seam: the library's ids."""
    library, own, chance = LIBRARY, OWN, random.Random(11)
    parts = [" ", "  ", " ", " ", "\n", "\t ", "\x1c", "　", "'s", "'", "'re", "la", "mot", "12", "9", "!", "...", "你好", "，", "é", "\U0001f642", "á", "<|endoftext|>", "<|", "नमस्", "\x85", "word", "​", "ǅ", "²", ","]
    wrong = 0
    for k in range(6000):
        text = "".join(chance.choice(parts[: chance.choice((4, 12, 31))] + parts[11:13]) for _ in range(chance.randint(1, 40)))
        size = chance.choice((1, 2, 3, 5, 8, 13, 64))
        level = [own.encode(text[i : i + size]) for i in range(0, len(text), size)]
        while len(level) > 1:
            level = [own.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        wrong += level[0] != np.array(library.encode(text, add_special_tokens=False).ids, bpe.IDS).tobytes()
    assert wrong == 0
    # a run of Unicode white space behind the default piece
    for n in range(80, 92):
        text = ("word " * 7000)[: bpe.PIECE] + ("la " * 60)[:n] + "  " + "mot suivant et la suite " * 10
        joined = own.join(own.encode(text[: bpe.PIECE]), own.encode(text[bpe.PIECE :]))
        assert joined == np.array(library.encode(text, add_special_tokens=False).ids, bpe.IDS).tobytes()
