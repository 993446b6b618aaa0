"""Vector search and ranking over the embeddings table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.operators import neighbours
from sparkloom.sources.tables import table

TOP_K = 50
#: Every vector whose id this divides is a query, so their side grows with the table.
QUERY_EVERY = 20
#: Vectors and queries of a block, where all queries meet all vectors; vectors and queries whose scores are handed on at a time.
VECTOR_BLOCK, QUERY_BLOCK = 16_384, 8_192
VECTOR_STEP, QUERY_STEP = 4_096, 16


def query_side(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def knn(vectors: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """query_id, rank, vec_id, d2, score = 1 / (1 + d2): exact, ties to the smaller vec_id."""
    return neighbours.knn(vectors, queries, k)


def cosines(vectors: DataFrame, queries: DataFrame, least: float, most: float, places: int) -> DataFrame:
    """query_id, vec_id, score: the cosine of every query with every vector, kept within least and most and rounded. A block of queries meets a block of vectors in
    one task, which holds the queries, reads the vectors as they come and hands on the scores of QUERY_STEP by VECTOR_STEP of them at a time; a row without a vector
    has no score."""
    vectors, queries = vectors.where("embedding is not null"), queries.where("q is not null")
    many = lambda df, n: max(1, -(-df.count() // n))
    xs, qs = many(vectors, VECTOR_BLOCK), many(queries, QUERY_BLOCK)
    deal = lambda id_, n: F.pmod(F.xxhash64(id_), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    side = lambda df, id_, v, late: df.select("xb", "qb", F.lit(late).alias("late"), F.col(id_).alias("id"), F.col(v).alias("v"))
    left = side(vectors.withColumn("xb", deal("vec_id", xs)).withColumn("qb", every(qs)), "vec_id", "embedding", True)
    right = side(queries.withColumn("qb", deal("query_id", qs)).withColumn("xb", every(xs)), "query_id", "q", False)

    def matrix(rows: pa.RecordBatch) -> np.ndarray:
        return rows["v"].flatten().to_numpy().reshape(len(rows), -1).astype(float)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, q, qq = [], [], None, None
        for batch in batches:
            asks = batch.num_rows - batch["late"].true_count  # queries come before vectors
            if asks:
                ids.append(batch["id"].slice(0, asks))
                held.append(matrix(batch.slice(0, asks)))
            if not held:  # a block without queries
                continue
            if asks < batch.num_rows and q is None:
                ids, q, held = pa.concat_arrays(ids), np.concatenate(held), [True]
                qq = (q * q).sum(1)
            for at in range(asks, batch.num_rows, VECTOR_STEP):
                some = batch.slice(at, VECTOR_STEP)
                x = matrix(some)
                xx = (x * x).sum(1)
                for k in range(0, len(q), QUERY_STEP):
                    score = np.clip(q[k : k + QUERY_STEP] @ x.T / np.sqrt(qq[k : k + QUERY_STEP, None] * xx), least, most)
                    score = np.floor(score * 10**places + 0.5) / 10**places
                    n = np.arange(score.size)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(k + n // len(x))), some["id"].take(pa.array(n % len(x))), pa.array(score.ravel())], ["query_id", "vec_id", "score"])

    pairs = left.unionByName(right).repartitionById(xs * qs, F.col("xb") * qs + F.col("qb")).sortWithinPartitions("late")
    return pairs.select("late", "id", "v").mapInArrow(blocks, "query_id long, vec_id long, score double")


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = knn(vectors, query_side(vectors))
    return found.select("query_id", "rank", "vec_id", F.round("d2", 6).alias("d2"), F.round("score", 6).alias("score"))


QUERIES = {"knn_topk": knn_topk}

D2 = "list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"

ORACLES = {
    "knn_topk": f"""
WITH scored AS (SELECT q.vec_id AS query_id, e.vec_id, {D2} AS d2 FROM embeddings e, embeddings q WHERE q.vec_id % {QUERY_EVERY} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(d2, 6) AS d2, round(1 / (1 + d2), 6) AS score FROM ranked WHERE rank <= {TOP_K}
""",
}
