"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents count as labelled; every other text is unlabelled, not clean. A logistic model over the presence of
words, their beginnings and short runs of characters is trained with numpy on the risk

    prior * R_positive(+1) + max(0, R_unlabelled(-1) - prior * R_positive(-1)),

where the bracket corrects the unlabelled risk for the toxic texts hidden in it, and is kept from going negative (if it would be, the
step goes back along it). The class prior is the share of toxic documents among the labelled ones of the training folds.

The training sample is bounded: POSITIVES toxic and UNLABELLED other documents at most, those with the least hashes of doc_id, and as
many rows at most where rows share ids.
Words are hashed into SPACE places. How many texts of either kind have a place is counted on the executors, and the FEATURES most
telling places are chosen there; the driver gets their numbers, and for each text of the sample one bit a feature, 1.5 MB at most.

Defined results: null and empty texts have no words and get the model's base score; without a toxic example all scores are 0;
where no feature tells toxic texts apart, all scores are the base score; rows that share a doc_id, or are equal, are scored each; rows
without a doc_id are scored, never trained on, and their held_out is null; any long is a doc_id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import named, numbered, scratch, small_batches, text_of, tidied

POSITIVES, UNLABELLED, FEATURES, SPACE = 4_096, 8_192, 1_024, 1 << 20
FOLDS = 5
EDGES = ".,;:!?|#*$%&<>()[]{}\"'`~_-=+/\\"
REMEMBERED = 100_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def words_of(text: str) -> set[str]:
    return {w.strip(EDGES) for w in text.lower().split()} - {""}


def place(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) % SPACE


def parts_of(word: str) -> set[str]:
    """A word's features: itself, its beginnings of four to eight characters, and all runs of five characters in it."""
    return {"=" + word} | {"^" + word[:k] for k in range(4, 9) if k < len(word)} | {word[i : i + 5] for i in range(len(word) - 4)}


class _Places(dict):
    def __missing__(self, word: str) -> list[int]:
        got = self[word] = [place(x) for x in parts_of(word)]
        return got


def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = _Places()
    for frame in frames:
        yield pd.DataFrame({"positive": frame.positive, "places": [np.array(sorted(set().union(*map(known.__getitem__, words_of(t)))), "<i4").tobytes() for t in frame.text]})
        if len(known) > REMEMBERED:
            known.clear()


def select(counts: DataFrame, positives: int, unlabelled: int) -> list[int]:
    """Places whose share of positive texts stands out most, in standard errors, either way; rare ones don't count.
    counts: place, p, u (positive and unlabelled texts that have it)."""
    p, u, n = F.col("p") / max(1, positives), F.col("u") / max(1, unlabelled), positives + unlabelled
    both = (F.col("p") + F.col("u")) / n
    error = F.sqrt(both * (1 - both) * (1 / max(1, positives) + 1 / max(1, unlabelled))) + 1e-3
    z = F.abs(p - u) / error
    best = counts.select("place", z.alias("z"), F.greatest(p, u).alias("share")).where("z > 4 and share > 0.03").orderBy(F.desc("z"), "place").limit(FEATURES)
    return sorted(r["place"] for r in best.collect())


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """place, p, u of a task's texts."""
    p, u = np.zeros(SPACE, np.int32), np.zeros(SPACE, np.int32)
    for frame in frames:
        for positive, places in zip(frame.positive, frame.places, strict=True):
            (p if positive else u)[np.frombuffer(places, "<i4")] += 1
    at = np.flatnonzero(p + u)
    for k in range(0, len(at), 100_000):
        part = at[k : k + 100_000]
        yield pd.DataFrame({"place": part, "p": p[part], "u": u[part]})


def train(xp: np.ndarray, xu: np.ndarray, chosen: list[int], prior: float, steps: int = 3000, rate: float = 0.05, decay: float = 1e-4, seed: int = 11) -> tuple[dict[int, float], float]:
    """(weight of each place, base) from rows of 0 and 1, a column for each chosen place."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(len(chosen) + 1), float(np.log(prior / (1 - prior)))
    w[-1] = b
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    batches = max(1, len(xu) // 1024)
    for _ in range(-(-steps // batches)):
        ip, iu = np.array_split(rng.permutation(len(xp)), batches), np.array_split(rng.permutation(len(xu)), batches)
        for a, c in zip(ip, iu, strict=True):
            if not len(a) or not len(c):
                continue
            p, u = np.c_[xp[a], np.ones(len(a))], np.c_[xu[c], np.ones(len(c))]
            sp, su = (1 / (1 + np.exp(-np.clip(x @ w, -50, 50))) for x in (p, u))
            # logistic losses: -log s for +1, -log(1 - s) for -1
            rest = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
            down = (u * su[:, None]).mean(0) - prior * (p * sp[:, None]).mean(0)
            grad = -down if rest < 0 else prior * (p * (sp - 1)[:, None]).mean(0) + down
            grad[:-1] += decay * w[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return dict(zip(chosen, w[:-1].tolist(), strict=True)), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[int, float], float] | None:
    """The model, from the training folds alone; None without a toxic example."""
    rows = text_of(docs).where(~held_out(F.col("doc_id")))
    seen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    n, toxic = seen.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    if not toxic:
        return None
    order = F.xxhash64("doc_id", F.lit(5)), F.col("doc_id")
    yes = seen.where("toxic = 1").select("doc_id").distinct().orderBy(*order).limit(POSITIVES).withColumn("positive", F.lit(True))
    # the unlabelled texts stand for all texts, toxic ones with a label among them: the prior is about that mixture
    no = rows.select("doc_id").distinct().orderBy(*order).limit(UNLABELLED).withColumn("positive", F.lit(False))
    picked = F.broadcast(yes.union(no))  # POSITIVES + UNLABELLED ids at most
    small_batches(docs.sparkSession)
    sample = scratch(rows.join(picked, "doc_id").select("text", "positive").mapInPandas(tidied(_features), "positive boolean, places binary"), "sample")
    of = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    if not of.get(True):
        return None
    counts = sample.mapInPandas(tidied(_counted), "place int, p int, u int").groupBy("place").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    chosen = select(counts, of[True], of.get(False, 0))
    prior = min(0.9, max(1e-4, toxic / n))
    if not chosen:  # nothing tells the two apart: every text has the base score
        return {}, float(np.log(prior / (1 - prior)))

    def bits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"positive": frame.positive, "bits": [np.packbits(np.isin(np.array(chosen, "<i4"), np.frombuffer(x, "<i4"))).tobytes() for x in frame.places]})

    # rows that share a doc_id all follow it into the sample; what comes to the driver is bounded in rows
    packed = sample.mapInPandas(bits, "positive boolean, bits binary").orderBy(F.xxhash64("bits"), "bits", "positive").limit(POSITIVES + UNLABELLED)
    got = sorted((r["positive"], bytes(r["bits"])) for r in packed.collect())
    split = [np.array([np.unpackbits(np.frombuffer(b, np.uint8), count=len(chosen)) for p, b in got if p is x], np.float32).reshape(-1, len(chosen)) for x in (True, False)]
    return train(*split, chosen, prior=prior)


def score(docs: DataFrame, model: tuple[dict[int, float], float] | None) -> DataFrame:
    """doc_id, score of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, base = model or ({}, -np.inf)

        nothing: frozenset = frozenset()

        class Weights(dict):
            def __missing__(self, word: str) -> frozenset:
                got = self[word] = frozenset(p for p in map(place, parts_of(word)) if p in weights) or nothing
                return got

        known = Weights()
        for frame in frames:
            logits = np.array([base + sum(map(weights.__getitem__, sorted(frozenset().union(*map(known.__getitem__, words_of(t)))))) for t in frame.text], float)
            yield pd.DataFrame({"doc_id": frame.doc_id, "score": 1 / (1 + np.exp(-np.clip(logits, -700, 700))) if model else np.zeros(len(frame))})
            if len(known) > REMEMBERED:
                known.clear()

    small_batches(docs.sparkSession)
    return numbered(named(text_of(docs)).mapInPandas(tidied(run), "doc_id string, score double"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
