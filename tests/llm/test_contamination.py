from rasterweave.llm import contamination


def shingles(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_against_all_pairs(spark):
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words)
    docs = [(0, item), (1, "x y " + " ".join(words[:34]) + " z"), (2, " ".join(words[:30])), (3, None), (4, ""), (5, " \n\t"),
            (6, "Short One"), (7, ("long text " * 3000) + item.upper() + " end" * 500), (7, "other"), (None, item), (8, item), (8, item),
            (9, " ".join(words[:20] + ["cut"] + words[20:])), (10, "a b c d e f g")]
    items = [(0, item), (1, item + " tail"), (2, "short\tone"), (3, None), (4, " "), (5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e f"), (6, " ".join(words[10:30]))]
    d = spark.createDataFrame([(*x, 1, "c") for x in docs], "doc_id long, text string, h int, item string")
    k = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, q string")
    expected = set()
    for doc, text in docs:
        for i, t in items:
            q, shared = shingles(t), shingles(t) & shingles(text)
            if q and 100 * len(shared) >= 75 * len(q):
                expected.add((doc, i, len(q), len(shared)))
    got = contamination.contained_items(d, k).collect()
    assert {tuple(r)[:4] for r in got} == expected and len(got) == len(expected) and len(expected) > 15
    old, contamination.BROADCAST_ROWS = contamination.BROADCAST_ROWS, 0
    try:
        assert {tuple(r)[:4] for r in contamination.contained_items(d, k).collect()} == expected
    finally:
        contamination.BROADCAST_ROWS = old
    assert contamination.contained_items(d.limit(0), k).count() == contamination.contained_items(d, k.limit(0)).count() == 0
