import re
from itertools import permutations

from rasterweave.llm import audit

FILTERS = "ABCDE"


def fails(rows):
    """Failing filters of each row, from plain Python."""
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        bad = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        out.append({f for f in FILTERS if bad[f]})
    return out


def expected(rows, labels):
    bad, result = fails(rows), {}
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    parts = {p or "" for _, _, p in rows}
    for part in parts:
        own = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        shapley = dict.fromkeys(FILTERS, 0)
        for order in permutations(FILTERS):
            left = set(own)
            for step, f in enumerate(order, 1):
                gone = {k for k in left if f in bad[k]}
                failing = {k for k in own if f in bad[k]}
                left -= gone
                shapley[f] += len(gone)
                result[part, "".join(order), step] = [
                    len(left), len(gone), len(failing - gone), sum(bad[k] == {f} for k in own),
                    sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone), f,
                ]
        for key, row in result.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return result


def found(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in df.collect()}


def test_every_order(spark):
    long = " ".join(f"w{i}" for i in range(250))
    texts = [
        (1, long, "a"), (2, long, "b"), (2, long, "a"), (3, None, "a"), (4, "", None), (5, "", ""), (None, long, "a"),
        (None, None, None), (6, "word " * 300, "a"), (7, "WORD " * 300, "b"), (8, long + " $", "a"), (9, "A# b", "b"),
        (10, "Ä  x\x85y " * 150, "a"), (11, "x y " * 40_000, "a"), (11, "x y " * 40_000, "a"), (12, long + "\nX | Y", "b"),
    ]
    docs = spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id long, text string, source string, `key` int, `fa.ils` int")
    marks = [(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, 0, 1), (6, 1, None), (None, 1, 1), (9, None, 1), (8, 1, 1)]
    labels = spark.createDataFrame([(*m, "z") for m in marks], "doc_id long, quality int, toxic int, text string")
    assert found(audit.audit(docs, labels)) == expected(texts, marks)
    unlabelled = found(audit.audit(docs, labels.limit(0)))
    assert unlabelled == expected(texts, [])
    assert audit.audit(docs.limit(0), labels).count() == 0


def test_copies_of_hot_and_rare_texts(spark, monkeypatch):
    rows = [(i, "same", "a") for i in range(40)] + [(100 + i // 2, f"pair {i // 4}", "a") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for hot in (2, 1000):  # by the shuffle alone, and by both ways
        monkeypatch.setattr(audit, "HOT", hot)
        got = found(audit.audit(docs, labels))
        assert got["a", "EABCD", 1][1] == sum("E" in f for f in fails(rows))
