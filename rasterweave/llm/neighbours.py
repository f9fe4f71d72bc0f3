"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

Vectors are centred on the mean of a bounded sample, scaled to length 1 and rotated by a random
orthogonal matrix. A code is the sign of each coordinate, packed in bits; with it go the length and
the inner product of the unit vector with its code. From a query's rotated unit vector q and a code x
the inner product with the coded vector o is estimated as <q, x> / <o, x>, and the estimate errs by
more than ``bound`` * sqrt((1 - <o, x>^2) / <o, x>^2 / (d - 1)) only with a small probability that
does not depend on the data. The estimates turn into lower and upper limits of the distance. Only
vectors whose lower limit is below the k-th smallest upper limit are measured on their original
components.

Codes are kept in blocks of bounded size together with their vectors. Every block meets the queries
in blocks; each meeting is one row of work, and only its k nearest leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.llm.common import quoted, stored

#: vectors in a code block and queries in a query block
BLOCK, QUERIES = 8192, 512


def usable(vector: str):
    """Whether a vector takes part: not null, empty or zero, all components finite."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _rotation(dimensions: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, lengths and inner products of unit vectors with their codes."""
    residual = vectors - centre
    lengths = np.linalg.norm(residual, axis=1)
    turned = residual / np.where(lengths > 0, lengths, 1)[:, None] @ rotation.T
    signs = turned > 0
    ips = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(signs, axis=1), lengths, ips


def limits(
    queries: np.ndarray, codes: np.ndarray, lengths: np.ndarray, ips: np.ndarray, centre: np.ndarray, rotation: np.ndarray, bound: float
) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper limits of squared distances, queries by coded vectors."""
    d = queries.shape[1]
    residual = queries - centre
    far = np.linalg.norm(residual, axis=1)[:, None]
    turned = residual / np.where(far > 0, far, 1) @ rotation.T
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    products = turned.astype(np.float32) @ signs.T / np.sqrt(d)
    safe = np.where(ips > 0, ips, 1)
    estimate = products / safe
    error = bound * np.sqrt(np.maximum(1 - safe**2, 0) / safe**2 / max(d - 1, 1)) + 1e-5
    scale, rest = 2 * far * lengths, far**2 + lengths**2
    return rest - scale * (estimate + error), rest - scale * (estimate - error)


def nearest(
    data: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    bound: float = 2.5,
    sample: int = 10_000,
    seed: int = 0,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` vectors of ``data`` nearest to each query.

    ``score`` is the Euclidean distance on the original vectors in double precision; ties go to the
    smaller id. A query's own id is no candidate of it. Vectors that are null, empty, zero or hold a
    null or non-finite component take no part, nor do those whose number of components differs from
    the query's, nor null ids. Rows that repeat an id count once, as their smallest vector. The mean
    comes from the ``sample`` vectors with the smallest hashes; all vectors are coded and searched.
    ``bound`` of 2.5 leaves about one limit in a hundred wrong; a wrong limit matters only near the
    k-th place.
    """
    spark = data.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        rows = df.where(usable(quoted(vector_col)) & F.col(quoted(id_col)).isNotNull())
        rows = rows.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("v"))
        return rows.groupBy("id").agg(F.min("v").alias("v"))

    points = stored(clean(data).withColumn("d", F.size("v")), "points")
    asked = stored(clean(queries).withColumn("d", F.size("v")), "queries")
    centres = {}
    for d in [r[0] for r in points.select("d").distinct().collect()]:
        first = points.where(F.col("d") == d).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
        centres[d] = np.mean([r[0] for r in first], axis=0)
    shared = spark.sparkContext.broadcast(centres)  # a vector for each number of components

    def grouped(df: DataFrame, size: int, name: str) -> DataFrame:
        """Rows (d, block, ids, vectors) of about ``size`` vectors, dealt by a hash of the id."""
        counts = {r["d"]: r["n"] for r in df.groupBy("d").agg(F.count("*").alias("n")).collect()}
        blocks = F.coalesce(*[F.when(F.col("d") == d, F.lit(max(1, round(n / size)))) for d, n in counts.items()], F.lit(1))
        each = df.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int"))
        lists = F.sort_array(F.collect_list(F.struct("id", "v")))
        return each.groupBy("d", "block").agg(lists.alias("rows")).select("d", F.col("block").alias(name), "rows")

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, block, rows in zip(batch["d"], batch["block"], batch["rows"]):
                v = np.array([r["v"] for r in rows], np.float64)
                codes, lengths, ips = encode(v, shared.value[d], _rotation(d, seed))
                ids = np.array([r["id"] for r in rows], np.int64)
                cells = [x.tobytes() for x in (ids, v, codes, lengths, ips)]
                yield pd.DataFrame([[d, block, *cells]], columns=["d", "block", "ids", "v", "codes", "lengths", "ips"])

    index = stored(
        grouped(points, BLOCK, "block").mapInPandas(coded, "d int, block int, ids binary, v binary, codes binary, lengths binary, ips binary"), "codes"
    )
    wanted = stored(grouped(asked, QUERIES, "qblock"), "asked")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                d = row.d
                ids = np.frombuffer(row.ids, np.int64)
                v = np.frombuffer(row.v, np.float64).reshape(-1, d)
                codes = np.frombuffer(row.codes, np.uint8).reshape(len(ids), -1)
                lengths, ips = np.frombuffer(row.lengths, np.float64), np.frombuffer(row.ips, np.float64)
                q = np.array([r["v"] for r in row.rows], np.float64)
                names = np.array([r["id"] for r in row.rows], np.int64)
                out = []
                for start in range(0, len(q), 128):
                    part = slice(start, start + 128)
                    low, high = limits(q[part], codes, lengths, ips, shared.value[d], _rotation(d, seed), bound)
                    own = names[part][:, None] == ids[None, :]
                    high[own] = low[own] = np.inf
                    cut = np.partition(high, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(high), np.inf)
                    for i, (name, vector) in enumerate(zip(names[part], q[part])):
                        chosen = np.flatnonzero((low[i] <= cut[i]) & ~own[i])
                        distance = np.sqrt(((v[chosen] - vector) ** 2).sum(axis=1))
                        first = np.lexsort((ids[chosen], distance))[:k]
                        out.append(pd.DataFrame({"query_id": name, "vec_id": ids[chosen][first], "score": distance[first]}))
                yield pd.concat(out, ignore_index=True)

    met = index.join(wanted, "d").repartition("block", "qblock").mapInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
