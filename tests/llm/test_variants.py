"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def by_hand(rows):
    total = Counter()
    for doc_id, text, *_ in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    words = {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}
    form, many = {}, {}
    for w, n in words.items():
        close = sorted((v for v in words if one_apart(v, w)), key=lambda v: (-words[v], v))
        many[w] = len(close)
        form[w] = close[0] if close and words[close[0]] >= 10 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n, many[w], form[w], words.get(form[w]), root(w)) for w, n in words.items())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    stems = ["question", "wonderful", "straßeßen", "aaaaaaaa", "abababab", "Àéîõüñýþ", "longest" * 9, "mississippi", "balloons"]
    letters = "abstéÀ"

    def typo(w):
        k, c = rng.randrange(len(w)), rng.choice(letters)
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])

    texts = []
    for _ in range(260):
        words = []
        for _ in range(60):
            w = rng.choice(stems[: 1 + rng.randrange(len(stems))])
            for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
                w = typo(w)
            words.append(w.upper() if rng.random() < 0.05 else w)
        texts.append(rng.choice([" ", "-", "\n", "1"]).join(words))
    found = [(rng.choice([k, k, -k, 2**62 + k, None]), t, "en", "w") for k, t in enumerate(texts)]
    return found + [(1, None, "en", None), (2, "", "en", None), (None, None, None, None), found[0], found[0]]


def test_against_all_pairs(spark, rows):
    want = by_hand(rows)
    got = variants.group(spark.createDataFrame(rows, "doc_id long, text string, word string, n string")).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == sorted(want, key=str)
    assert sum(r[3] is not None for r in want) > 20 and any(r[3] is not None and r[5] != r[3] for r in want)


def test_equal_keys_are_not_enough(spark, rows, monkeypatch):
    """Words meet by keys, but only their strings decide."""
    few = rows[:40]
    keys = variants.deletion_keys
    monkeypatch.setattr(variants, "deletion_keys", lambda *a: (lambda w, f, e, k: (w, f, e, k % np.uint64(7)))(*keys(*a)))
    got = variants.group(spark.createDataFrame(few, "doc_id long, text string, word string, n string")).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == sorted(by_hand(few), key=str)


def test_keys_are_those_of_the_deletions():
    words = ["aab", "ab", "bab", "", "x", "àéa", "a" * 1000 + "b"]
    word, first, last, key = variants.deletion_keys(*variants.points_of(words))
    of = {}
    for w, f, e, k in zip(word.tolist(), first.tolist(), last.tolist(), key.tolist(), strict=True):
        text = words[w]
        for at in range(f, e + 1):
            left = text if at < 0 else text[:at] + text[at + 1 :]
            assert of.setdefault(left, k) == k
    assert len(set(of.values())) == len(of) and len(word) == len(words) + 2 + 2 + 3 + 0 + 1 + 3 + 2


def test_very_long_words(spark):
    """Keys carry no text, so a word of many characters costs its length, not its square."""
    long = "".join(chr(97 + k * k % 23) for k in range(200_000))
    rows = [(1, f"{long} {long} {long}"), (2, f"{long} {long[:999]}{long[1000:]} " + long[:77_777] + "é" + long[77_778:]), (3, f"{long[:999]}{long[1000:]} " + "z" * 300_000), (4, "z" * 300_000 + " " + long[:77_777] + "é" + long[77_778:])]
    rows = [(d + 1000, t) for d, t in rows]
    got = variants.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((len(r["word"]), r["n"], r["n_near"]) for r in got) == sorted((len(w), n, m) for w, n, m, *_ in by_hand(rows))


def test_long_chains_of_forms(spark):
    from pyspark.sql import functions as F

    forms = spark.range(18).select(F.concat(F.lit("w"), "id").alias("word"), F.concat(F.lit("w"), F.col("id") + 1).alias("form"))
    assert {r["root"] for r in variants.roots(forms).collect()} == {"w18"}


def test_nothing(spark):
    assert variants.group(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert variants.group(spark.createDataFrame([(1, "short words only"), (2, None)], "doc_id long, text string")).collect() == []
