"""Approximate nearest neighbours by adaptive dimension scans over inverted lists.

Vectors are turned by a random rotation, which spreads what tells them apart evenly over the dimensions, and every one is put into
a list: that of its nearest centroid, divided further by the nearest of FINE offsets from it, as many as it takes for about
sqrt(rows) lists. A query probes its nearest lists, the nearest one first: the k-th distance found there bounds the others.
Inside a list the rotated dimensions are read in column blocks: after each block, the partial distance scaled to all dimensions
is an estimate, and a candidate is abandoned as soon as a one-sided test says that its distance exceeds the query's bound
(partial > bound * d / D * (1 + EPSILON / sqrt(d)) ** 2). What survives all blocks is ranked by the exact distance of the original
vectors in double precision.

Centroids, offsets, the number of lists to probe and each query's first bound come from a sample of SAMPLE vectors at most (those
with the least hashes of their ids), which is broadcast; every vector is indexed. The number of probes is the least that finds
TARGET of the sample's own neighbours. Lists are cut into parts of about PART vectors and the queries that probe one into blocks of about BLOCK, so
a list that holds a third of all rows is many tasks, each of bounded size. Of equal vectors the k + 1 with the smallest ids stand in the lists, since no other one can
be among anyone's k nearest, and equal vectors that ask are one query, whose result all of them get, each without itself.

Defined results: vectors that are null, zero, of a length other than the most common one, or with null or non-finite
components take no part, nor do rows without a vec_id, which no result could name; any long is a vec_id; each row whose id asks is a query of its own, and every other row, those of the same id among them, is a
candidate; ties at the last rank go to the smaller ids; fewer than k candidates give fewer rows; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import partitions, scratch, small_batches, tidied

SAMPLE, CENTROIDS, FINE, PART, BLOCK, COLUMNS = 16_384, 256, 256, 4_096, 1_024, 16
EPSILON, TARGET, PROBED = 2.1, 0.97, 512


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles): the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def rotation(d: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances of rows of a to rows of b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i : i + 4096], centroids).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    centroids = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, centroids)
        sums, counts = np.zeros_like(centroids), np.bincount(at, minlength=len(centroids))
        np.add.at(sums, at, x)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


class Lists:
    """Centroids and offsets from them; list = centroid * offsets + offset."""

    def __init__(self, x: np.ndarray, rows: int):
        wanted = max(1, round(rows**0.5))
        self.centroids = kmeans(x, min(CENTROIDS, wanted, max(1, round(len(x) ** 0.5))))
        residuals = x - self.centroids[nearest(x, self.centroids)]
        fine = min(FINE, -(-wanted // len(self.centroids)))
        self.offsets = kmeans(residuals, fine) if fine > 1 else np.zeros((1, x.shape[1]))

    def of(self, x: np.ndarray) -> np.ndarray:
        near = nearest(x, self.centroids)
        return near * len(self.offsets) + nearest(x - self.centroids[near], self.offsets)

    def centres(self) -> np.ndarray:
        return (self.centroids[:, None] + self.offsets[None]).reshape(-1, self.centroids.shape[1])


def probes(x: np.ndarray, lists: Lists, k: int) -> int:
    """Lists to probe so that TARGET of the sample's k nearest lie in them."""
    asked = x[:PROBED]
    d = squared(asked, x)
    d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(d, 1)[:, : min(k, len(x) - 1)]
    centres = lists.centres()
    order = np.argsort(np.argsort(squared(asked, centres), 1), 1)
    places = np.sort(order[np.arange(len(asked))[:, None], lists.of(x)[near]].ravel())
    return int(places[min(len(places) - 1, int(np.ceil(TARGET * len(places))))]) + 1 if len(places) else len(centres)


def scan(rotated: np.ndarray, original: np.ndarray, ids: np.ndarray, q_rotated: np.ndarray, q: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest of a part for one query; bound: squared distance beyond which nothing counts."""
    d = rotated.shape[1]
    alive, partial = np.arange(len(rotated)), np.zeros(len(rotated))
    for start in range(0, d, COLUMNS):
        end = min(start + COLUMNS, d)
        block = rotated[alive, start:end] - q_rotated[start:end]
        partial += np.einsum("ij,ij->i", block, block)
        if end < d:
            stay = partial <= bound * (end / d) * (1 + EPSILON / np.sqrt(end)) ** 2
            alive, partial = alive[stay], partial[stay]
    distance = np.sqrt(((original[alive] - q) ** 2).sum(1))
    best = np.lexsort((ids[alive], distance))[:k]
    return ids[alive][best], distance[best]


def search(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: k nearest of every row whose vec_id is divisible by `every`."""
    spark, some = vectors.sparkSession, k + 1  # a query is among its own nearest
    small_batches(spark)
    rows = usable(vectors)
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not taken:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    s = np.array([r["v"] for r in taken])
    turn = rotation(s.shape[1])
    index = Lists(s @ turn, rows.count())
    n_probes = probes(s @ turn, index, k)
    shared = spark.sparkContext.broadcast((turn, index, index.centres(), s))  # SAMPLE vectors and CENTROIDS * FINE centres at most

    @tidied
    def put(frames):
        turn, index, *_ = shared.value
        for frame in frames:
            yield frame.assign(list=(index.of(np.array(frame.v.tolist()) @ turn) if len(frame) else np.zeros(0)).astype("int32"))

    @tidied
    def ask(frames):
        turn, _, centres, sample = shared.value
        for frame in frames:
            out = []
            for query, v in zip(frame["query"], frame.v, strict=True):
                v = np.array(v)
                d = ((sample - v) ** 2).sum(1)
                # rotated components are rounded: without the slack, copies of the query would be a hair beyond a bound of 0
                bound = float(np.partition(d, some - 1)[some - 1]) * (1 + 1e-9) + 1e-9 * float(v @ v) if len(d) >= some else float("inf")
                order = np.argsort(squared((v @ turn)[None], centres)[0], kind="stable")[:n_probes]
                out.append((query, v, bound, order.astype("int32").tolist()))
            yield pd.DataFrame(out, columns=["query", "q", "bound", "probes"])

    def probe(part: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        turn, out = shared.value[0], []
        if len(part) and len(queries):
            original, ids = np.array(part.v.tolist()), part.vec_id.to_numpy()
            rotated = original @ turn
            for query, q, bound in zip(queries["query"], queries.q, queries.bound, strict=True):
                q = np.asarray(q)
                found, distance = scan(rotated, original, ids, q @ turn, q, bound, some)
                out += zip([query] * len(found), found.tolist(), distance.tolist(), strict=True)
        return pd.DataFrame(out, columns=["query", "vec_id", "score"]).astype({"query": "int64", "vec_id": "int64", "score": "float64"})

    def scanned(asked: DataFrame) -> DataFrame:
        """The nearest that the lists of the queries hold, one list a row of asked: parts of lists against blocks of queries."""
        blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        met = F.broadcast(scratch(many.join(blocks, "list"), "blocks", 16))  # a row a list
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        left = indexed.join(met, "list").select("list", deal("row", "parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "v")
        right = asked.join(met, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), deal("query", "blocks").alias("block"), "query", "q", "bound")
        hits = left.groupBy("list", "part", "block").cogroup(right.groupBy("list", "part", "block")).applyInPandas(probe, "query long, vec_id long, score double")
        return best(hits)

    def best(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("rank") <= some)

    # of equal vectors, only those with the smallest ids can be among anyone's nearest; those that ask, ask once
    copies = rows.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("copy") <= some).drop("copy")
    indexed = scratch(copies.mapInPandas(put, "vec_id long, v array<double>, list int").withColumn("row", F.monotonically_increasing_id()), "lists")
    many = scratch(indexed.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "parts", 16)  # a row a list
    asking = rows.where(F.col("vec_id") % every == 0)
    different = scratch(asking.select("v").distinct().withColumn("query", F.monotonically_increasing_id()), "different")  # from here on, query stands for a vector that asks
    queries = scratch(different.repartition(partitions(spark), "query").mapInPandas(ask, "query long, q array<double>, bound double, probes array<int>"), "queries")
    first = scratch(scanned(queries.select("query", "q", "bound", F.get("probes", F.lit(0)).alias("list"))), "first", 8)
    worst = first.groupBy("query").agg(F.max(F.when(F.col("rank") == some, F.col("score"))).alias("worst"))
    # the last distance of the nearest list bounds the others; the same slack as above
    tighter = F.least("bound", F.coalesce(F.col("worst") * F.col("worst") * (1 + 1e-9) + 1e-9 * F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x), F.col("bound")))
    rest = scratch(queries.join(worst, "query", "left").select("query", "q", tighter.alias("bound"), F.explode(F.slice("probes", 2, n_probes)).alias("list")), "rest", 2)
    found = best(first.drop("rank").unionByName(scanned(rest).drop("rank")))
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))  # k + 1 at most
    # every row that asks gets its vector's list without itself: one row of its id at distance 0
    out = asking.join(different, "v").join(lists, "query").select(F.col("vec_id").alias("query_id"), "near")
    own = F.array_position(F.transform("near", lambda x: (x["vec_id"] == F.col("query_id")) & (x["score"] == 0)), True)
    others = F.slice(F.filter("near", lambda x, i: i + 1 != own), 1, k)
    return out.select("query_id", F.posexplode(others).alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
