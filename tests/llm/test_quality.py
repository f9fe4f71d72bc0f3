import zlib

from rasterweave.llm import quality, queries

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = queries.op7_compression_quality(spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good = [p for y, p in held if y == 1]
    assert sum(good) / len(good) > 0.95
    assert sum(y == p for y, p in held) / len(held) > 0.9


def test_rows(spark):
    good, bad = "the quick brown fox and the dog ", "$$ ## %% win casino "
    texts = [(i, (good if i % 2 else bad) * (5 + i)) for i in range(60)] + [(60, None), (61, ""), (3, good), (None, good * 3)]
    docs = spark.createDataFrame([(*t, "x", 1.5) for t in texts], "doc_id long, text string, _id string, score double")
    labels = spark.createDataFrame([(i, i % 2, 9) for i in range(60)] + [(3, 0, 9), (None, 1, 9), (5, 7, 9), (6, None, 9)],
                                   "doc_id long, quality int, text int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(texts) and rows[0].asDict().keys() == {"doc_id", "text", "_id", "score"}
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[60] == by[61] and min(by[i] for i in range(41, 60, 2)) > 0.5 > max(by[i] for i in range(40, 60, 2))
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    one = quality.fit(docs, labels.where("quality = 1 and doc_id > 5"))
    assert min(r["score"] for r in quality.score(docs, one).collect()) > 0.5
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_scores_against_plain_compression(spark):
    """Whole texts, long and of several bytes a character, compressed in chunks by plain zstandard calls."""
    import math

    import pytest
    import zstandard

    words = {1: "der die und ist für straße größe ", 0: "你好 $$ ## 赢 casino "}
    texts = [(i, words[i % 2] * (3 + i * 7 % 90)) for i in range(80)] + [(90, words[1] * 300 + words[0] * 9_000), (91, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int"))
    pair = [zstandard.ZstdCompressionDict(d) for d in (model.bad, model.good)]

    def size(piece, known):
        made = zstandard.ZstdCompressor(level=model.level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(made.compress(piece))

    for r in quality.score(docs, model).collect():
        data = (r["text"] or "").encode()
        bad, good = (sum(size(data[i : i + 1024], known) for i in range(0, len(data), 1024)) for known in pair)
        odds = model.offset + model.slope * (bad - good) / (len(data) + 40) if data else model.offset
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-9)


def test_dictionary_is_trained_on_whole_texts(monkeypatch):
    """Every byte of a text is given to the training, also with several bytes a character."""
    given = []

    def train(size, pieces):
        given.extend(pieces)
        raise quality.zstandard.ZstdError("too few")

    monkeypatch.setattr(quality.zstandard, "train_dictionary", train)
    text = "日本語" * 700 + "終わり"
    known = quality._dictionary([text, "", "ab"], 262_144)
    assert b"".join(given) == (text + "ab").encode() == known and max(map(len, given)) == quality.CHUNK
