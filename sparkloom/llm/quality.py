"""Quality rules by weak supervision.

Each rule votes good, votes bad or abstains. The rules' accuracies are not set by hand: expectation-maximisation over the
counts of vote patterns estimates, for both classes, how often each rule gives each vote, and a document is kept if its
posterior probability of being good is at least one half. The patterns number 3 ** rules at most, whatever the corpus holds,
so the counts are a table of bounded size and the model is fitted on the driver from all documents, not from a sample.

Defined results: a null or empty text has no words, all its measures are 0 and it fails the base rule; repeated rows are
measured alike, each on its own; no decision looks at doc_id, so a null one, and any long, passes through as it is; an empty table
gives an empty result; further columns are passed on or ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .common import WHITE, scratch, small_batches, unused

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Common function words of the corpus languages.
FUNCTION_WORDS = frozenset(
    b"the of and to in is that for with it as by was this be are on from at an"
    b" der die und das von zu mit den nicht ein eine auf im dem sich als ist des"
    b" le la les de et des que un une du pour en qui dans par sur pas au avec"
    b" el los las y que del una por con no su al se lo como es".split()
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = T.StructType([T.StructField(x, T.LongType()) for x in MEASURES] + [T.StructField("votes", T.StringType())])
RULES = ("length", "word_length", "symbols", "dup_lines", "repeats", "capitals", "function_words", "sentences", "bars", "shouting")
#: Rules that may also vote good; the others vote bad or abstain.
TWO_SIDED = (0, 6, 7)
#: Shares of the votes -, 0, + that the pseudo-counts stand for.
BAD_BOTH, BAD_ONE, GOOD_BOTH, GOOD_ONE = (0.3, 0.3, 0.4), (0.3, 0.69, 0.01), (0.02, 0.18, 0.8), (0.01, 0.98, 0.01)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more. Ranks of 1, 2, 4, 8 words in turn, so equal ranks are equal windows."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    width = 1
    while width < window:
        step = min(width, window - width)
        left, right = rank[: len(rank) - step], rank[step:]
        _, rank = np.unique(left * (n + 1) + right, return_inverse=True)
        width += step
    starts = np.flatnonzero(np.bincount(rank)[rank] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _vote(good: bool, bad: bool) -> str:
    return "-" if bad else "+" if good else "0"


def measure(text: str | None) -> tuple:
    """The measures of one text, and its votes."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    repeats = repeated_words(words)
    at = np.frombuffer(raw, np.uint8)
    upper = int(((at >= 65) & (at <= 90)).sum())
    lower = int(((at >= 97) & (at <= 122)).sum())
    common = len(FUNCTION_WORDS.intersection(w.lower().strip(b".,;:!?") for w in words))
    ends = sum(w[-1:] in (b".", b"?", b"!") for w in words)
    per = max(n, 1)
    shouts, bars = text.count("!"), text.count("|")
    votes = (
        _vote(n >= 50, n < 20),
        _vote(False, not 2 <= chars / per <= 14),
        _vote(False, symbols > 0.15 * per),
        _vote(False, dups > 0.5 * max(lines, 1)),
        _vote(False, repeats > 0.3 * per),
        _vote(False, upper > 0.5 * (upper + lower)),
        _vote(common >= 3, common == 0 and n >= 20),
        _vote(ends * 40 >= n > 0, n >= 60 and ends * 120 < n),
        _vote(False, bars > 0.15 * per),
        _vote(False, shouts > 0.2 * per),
    )
    return n, chars, symbols, dups, repeats, "".join(votes)


@F.pandas_udf(SCHEMA)
def measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=[*MEASURES, "votes"])


def fit(patterns: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """Posterior probability of good for every vote pattern, by expectation-maximisation.

    Pseudo-counts worth a twentieth of the corpus for each class tell which class is which: a rule is taken to be right more
    often than wrong until the votes say otherwise."""
    if not patterns:
        return {}
    keys = sorted(patterns)
    weight = np.array([patterns[k] for k in keys], float)
    votes = np.array([["-0+".index(c) for c in k] for k in keys])
    one_hot = np.eye(3)[votes]  # pattern, rule, vote
    both_ways = np.isin(np.arange(one_hot.shape[1]), TWO_SIDED)[:, None]
    prior = np.stack([np.where(both_ways, BAD_BOTH, BAD_ONE), np.where(both_ways, GOOD_BOTH, GOOD_ONE)])  # class, rule, vote
    strength = max(1.0, 0.05 * weight.sum())
    good = np.where((votes == 0).any(1), 0.1, 0.9)
    for _ in range(rounds):
        both = np.stack([1 - good, good], 1) * weight[:, None]
        share = (both.sum(0) + strength * np.array([0.2, 0.8])) / (weight.sum() + strength)
        seen = np.einsum("pc,prv->crv", both, one_hot) + strength * prior
        odds = np.log(seen / seen.sum(2, keepdims=True))
        logs = np.log(share)[None] + np.einsum("prv,crv->pc", one_hot, odds)
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(keys, good.tolist(), strict=True))


def posteriors(votes: DataFrame) -> DataFrame:
    """votes, posterior: a row for each pattern that occurs, 3 ** len(RULES) at most; small enough to broadcast by that bound."""
    spark = votes.sparkSession
    found = {r["votes"]: r["n"] for r in votes.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    rows = sorted(fit(found).items())
    return spark.createDataFrame(rows or [("", 0.0)], "votes string, posterior double")


def _failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, kept, posterior and votes of every document."""
    small_batches(docs.sparkSession)
    seen = scratch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), measured(F.col("text")).alias("m")).select("doc_id", "m.*"), "quality")
    return (
        seen.join(F.broadcast(posteriors(seen)), "votes", "left")
        .withColumn("base_failed", _failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
        .select("doc_id", *MEASURES, "base_failed", "kept", "posterior", "votes")
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns. The texts are measured twice instead of being moved."""
    small_batches(docs.sparkSession)
    m, votes, posterior = unused(docs, "__m", "__votes", "__posterior")
    seen = docs.select(measured(F.col("text")).alias("m")).select("m.votes")
    fitted = F.broadcast(posteriors(seen).withColumnRenamed("votes", votes).withColumnRenamed("posterior", posterior))
    measures = docs.withColumn(m, measured(F.col("text"))).withColumn(votes, F.col(f"{m}.votes"))
    base = (F.col(f"{m}.n_words") < 20) | (100 * F.col(f"{m}.n_repeat_words") > 30 * F.col(f"{m}.n_words"))
    return measures.join(fitted, votes).where(~base & (F.col(posterior) >= 0.5)).select(*[docs[c] for c in docs.columns])
