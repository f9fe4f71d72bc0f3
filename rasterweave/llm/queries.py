"""Registered queries of the operators of this package, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.llm import audit, bpe, contamination, hosts, jaccard, lines, neighbours, quality, sharding, spelling, suffix_tree, toxicity, wavelet
from rasterweave.llm.common import LOWER, UPPER


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op6_jaccard_components(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under links of three quarters Jaccard similarity."""
    return jaccard.linked_components(_table(spark, folder, "documents"))


def op7_compression_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document from good and bad compression dictionaries."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    held = F.coalesce(_remainder(3) == 1, F.lit(False))
    model = quality.fit(docs.where(~held), _table(spark, folder, "labels").where(~held))
    return quality.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op1_hypergeometric_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards whose row counts differ by at most one."""
    dealt = sharding.shuffle_into_shards(_table(spark, folder, "documents").select("doc_id", "text"), shards=16)
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return dealt.select(
        "doc_id",
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_one_bit_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    data = _table(spark, folder, "embeddings")
    return neighbours.nearest(data, data.where("vec_id % 100 = 0"))


def op3_contained_benchmark_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item of which a document has three quarters of the shingles."""
    return contamination.contained_items(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


#: fixed values: the url rules of the query
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def op4_link_graph_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every url, by rule or by trust and distrust of its host."""
    return hosts.judge(_table(spark, folder, "pages"), RULES).drop("url", "html")


def op5_tree_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded text of every document, long ones joined from pieces, as digests."""
    definition = bpe.tokenizer_text(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = bpe.encode(_table(spark, folder, "documents").select("doc_id", "text"), definition)
    return bpe.decode(encoded.select("doc_id", "ids"), definition).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_wavelet_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, read back from wavelet matrix shards."""
    definition = bpe.tokenizer_text(public_tokenizers.path("word_bpe_49k.json"))
    shards = wavelet.write_shards(_table(spark, folder, "documents").select("doc_id", "text"), definition)
    return wavelet.digests(shards).withColumnRenamed("key", "doc_id")


def op9_repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that an earlier line of the corpus repeats."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    kept = lines.without_repeated_lines(docs.withColumn("n_lines", F.size(F.split("text", "\n")).cast("long")))
    return kept.select(
        "doc_id",
        "n_lines",
        F.length("text").cast("long").alias("n_chars"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


def op10_suffix_tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document under a suffix tree learnt from six sevenths of them."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    held = F.coalesce(_remainder(7) == 2, F.lit(False))
    model = suffix_tree.fit(docs.where(~held))
    return suffix_tree.score(docs, model).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What each of five filters does at every place of every order, by source."""
    return audit.audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op12_weak_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document from a classifier trained on the voters' posterior labels."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    held = F.coalesce(_remainder(3) == 1, F.lit(False))
    model = toxicity.fit(docs, _table(spark, folder, "labels").where(~held))
    return toxicity.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents with their near words, more frequent form and root."""
    return spelling.variants(_table(spark, folder, "documents"))


QUERIES = {q.__name__: q for q in (op1_hypergeometric_shards, op2_one_bit_neighbours, op3_contained_benchmark_items, op4_link_graph_filter, op5_tree_bpe, op6_jaccard_components, op7_compression_quality, op8_wavelet_shards, op9_repeated_lines, op10_suffix_tree_scores, op11_filter_audit, op12_weak_toxicity, op13_spelling_variants)}
#: macros of DuckDB texts: the words of a text, and its distinct five-word shingles
_WORDS = "list_filter(regexp_split_to_array(translate({}, '" + UPPER + "', '" + LOWER + "'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_SHINGLES = """list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)"""

CHECKS: dict[str, str] = {
    "op3_contained_benchmark_items": f"""
WITH d AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)),
i AS (SELECT item_id, {_SHINGLES} AS l FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark)),
k AS (SELECT item_id, len(l) AS q, unnest(l) AS s FROM i)
SELECT doc_id, item_id, q AS n_item, count(*) AS n_shared, count(*) / q AS containment
FROM d JOIN k USING (s) GROUP BY doc_id, item_id, q HAVING 100 * count(*) >= 75 * q""",
    "op9_repeated_lines": """
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents),
o AS (SELECT line, min((doc_id, no)) AS ord FROM l WHERE length(line) >= 40 GROUP BY line),
h AS (SELECT *, length(line) AS n, line[1:length(line) // 2] AS a, line[length(line) // 2 + 1:] AS b FROM o),
pairs AS (
  SELECT x.line AS lx, y.line AS ly, x.ord AS ox, y.ord AS oy FROM h x JOIN h y ON x.n = y.n AND x.a = y.a AND x.line <> y.line
  UNION ALL SELECT x.line, y.line, x.ord, y.ord FROM h x JOIN h y ON x.n = y.n AND x.b = y.b AND x.line <> y.line
  UNION ALL SELECT x.line, y.line, x.ord, y.ord FROM h x JOIN h y ON x.n = y.n + 1 AND x.line[1:y.n // 2] = y.a
  UNION ALL SELECT x.line, y.line, x.ord, y.ord FROM h x JOIN h y ON x.n = y.n + 1 AND right(x.line, y.n - y.n // 2) = y.b),
same AS (SELECT *, greatest(length(lx), length(ly)) AS m,
  coalesce(list_min(list_filter(range(1, length(ly) + 1), lambda i: lx[i] <> ly[i])) - 1, length(ly)) AS front,
  coalesce(list_min(list_filter(range(1, length(ly) + 1), lambda i: lx[-i] <> ly[-i])) - 1, length(ly)) AS back FROM pairs),
near AS (SELECT DISTINCT CASE WHEN ox < oy THEN ly ELSE lx END AS line FROM same WHERE front + back >= m - 1),
k AS (SELECT l.doc_id, l.text, l.line, l.no, coalesce(length(l.line) >= 40 AND ((l.doc_id, l.no) > o.ord OR near.line IS NOT NULL), false) AS gone
  FROM l LEFT JOIN o USING (line) LEFT JOIN near USING (line)),
t AS (SELECT doc_id, count(*) AS n_lines, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text FROM k GROUP BY doc_id)
SELECT doc_id, n_lines, length(text) AS n_chars, md5(text) AS text_md5 FROM t""",
    "op11_filter_audit": """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
  + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > first, false)::INT AS fails,
  coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d JOIN firsts USING (text) LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest(range(5)) AS i),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step, 1::BIGINT << (ascii(filter_order[step]) - 65) AS bit,
  list_sum(list_transform(range(1, step), lambda j: 1::BIGINT << (ascii(filter_order[j]) - 65))) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit,
  sum(n) FILTER (fails & (coalesce(before, 0) | bit)::BIGINT = 0) AS kept,
  sum(n) FILTER (fails & bit > 0 AND fails & coalesce(before, 0)::BIGINT = 0) AS removed,
  sum(n) FILTER (fails & bit > 0 AND fails & coalesce(before, 0)::BIGINT > 0) AS redundant,
  sum(n) FILTER (fails = bit) AS unique_fails,
  sum(good) FILTER (fails & bit > 0 AND fails & coalesce(before, 0)::BIGINT = 0) AS good_lost,
  sum(toxic) FILTER (fails & bit > 0 AND fails & coalesce(before, 0)::BIGINT = 0) AS toxic_lost
  FROM c, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r""",
}
