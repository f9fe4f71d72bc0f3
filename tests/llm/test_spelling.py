import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterweave.llm import queries, spelling

FOLDER = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def counts(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def expected(n):
    masks = {}
    for w in n:  # words one edit apart share a text with one code point masked or put in
        for i in range(len(w) + 1):
            masks.setdefault(w[:i] + "*" + w[i:], set()).add(w)
            if i < len(w):
                masks.setdefault(w[:i] + "*" + w[i + 1 :], set()).add(w)
    near = {w: set() for w in n}
    for group in masks.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, c in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * c else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def found(df):
    rows = df.collect()
    out = {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in rows}
    assert len(out) == len(rows)
    return out


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=7)))
def test_partitions_give_each_pair_once(words):
    pairs = Counter()
    for kind in "fb":
        for m in range(1, 8):
            groups = {}
            for w in words:
                if len(w) in (m, m + 1):
                    t = w if kind == "f" else w[::-1]
                    groups.setdefault(t[: m // 2], {})[t] = 1
            for group in groups.values():
                for x, y in spelling._near_in(kind, m, m // 2, group):
                    pairs[frozenset((x, y) if kind == "f" else (x[::-1], y[::-1]))] += 1
    assert set(pairs.values()) <= {1}
    assert set(pairs) == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


@pytest.mark.parametrize("limit", [20_000, 100])
def test_near_words(spark, limit):
    import random

    chance = random.Random(limit)
    words = {"".join(chance.choice("abcdeé") for _ in range(chance.choice((1, 2, 5, 6, 7)))) for _ in range(3000)}
    words |= {"langes" + "".join(chance.choice("xyz") for _ in range(6)) for _ in range(600)}
    words |= {"x" * k for k in (4999, 5000, 5001)}
    n = {w: chance.choice((3, 3, 4, 6, 12, 30)) for w in words}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    near = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in spelling.near_words(table, limit).collect()}
    want = {}
    for a in words:
        own = [b for b in words if abs(len(a) - len(b)) < 2 and one_edit(a, b)]
        if own:
            best = min(own, key=lambda x: (-n[x], x))
            want[a] = (len(own), n[best], best)
    assert near == want


def test_nulls_ties_and_names(spark):
    rows = [(i % 50 if i % 7 else None, "Hällo Welten, WELTEN welten2welten ÷×ÿÀ " * (i % 3), 1) for i in range(120)]
    rows += [(7, None, 1), (8, "", 1), (9, "abcde abcdf abcdg " * 3 + "abcdef " * 6, 2), (9, "abcdefg " * 12, 2), (9, "abcdefgh " * 24, 1)]
    rows += [(10, "z" * 30_000 + " ", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, `word` int")
    got = found(spelling.variants(docs))
    assert got == expected(counts([r[:2] for r in rows]))
    assert got["abcdg"][0] is None and got["abcde"][:2] == ("abcdef", "abcdefgh") and got["abcde"][3] == 3
    assert spelling.variants(docs.limit(0)).count() == 0
    assert spelling.variants(docs.where("text = ''")).count() == 0


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op13_spelling_variants(spark, FOLDER)) == expected(counts(rows))
