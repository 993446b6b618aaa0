"""Packers, bands, keywords and doubles: long inputs, and the rules step by step."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import cases, matching
from tests.test_whole import overlapping, unlike


def banded(scores, width):
    out, leader, band = [], None, -1
    for s in scores:
        if leader is None or round(leader * 1e6) - round(s * 1e6) > round(width * 1e6):
            leader, band = s, band + 1
        out.append(band)
    return out


def test_bands(spark):
    rng = random.Random(1)
    lists = [[], [1.0], [0.5] * 9, [0.95, 0.9, 0.9, 0.85, 0.849999]] + [sorted((round(rng.random(), rng.choice([1, 2, 6])) for _ in range(rng.randrange(200))), reverse=True) for _ in range(40)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, xs array<double>")
    for width in (0.05, 0.0, 0.3):
        got = {r["k"]: r["b"] for r in rows.select("k", matching.bands(F.col("xs"), width).alias("b")).collect()}
        assert [got[k] for k in range(len(lists))] == [banded(x, width) for x in lists]


def test_a_million_scores(spark):
    many = spark.range(1).select(F.transform(F.sequence(F.lit(1_000_000), F.lit(1), F.lit(-1)), lambda i: i / 1e6 * 40).alias("xs"))
    began = time.time()
    got = many.select(matching.bands(F.col("xs"), 0.0005).alias("b")).select(F.size("b"), F.element_at("b", -1), F.sha2(F.array_join(F.slice("b", 500_000, 2000), ","), 256)).first()
    want = banded([i / 1e6 * 40 for i in range(1_000_000, 0, -1)], 0.0005)
    import hashlib

    assert (got[0], got[1], got[2]) == (len(want), want[-1], hashlib.sha256(",".join(map(str, want[499_999:501_999])).encode()).hexdigest())
    assert time.time() - began < 180


def packing(paragraphs, most, compat, cue):
    done, buf = [], ""
    for p in paragraphs:
        if len(buf) + len(p) + 1 <= most and not (cue and buf and re.match(cue, p)):
            buf = f"{buf} {p}".strip()
        else:
            done, buf = [*done, buf], p
    done = [*done, buf] if buf else done
    return done if compat else [c for c in done if c]


def test_packing(spark):
    rng = random.Random(3)
    piece = lambda: rng.choice(["", " ", "   "]) + "".join(rng.choice("Dabé ") for _ in range(rng.choice([0, 1, 3, 8, 20, 60]))) + rng.choice(["", "", " ", "  \t"])
    lists = [[], [""], ["x" * 70], ["x" * 70, "a"], ["a", "x" * 29, "b"]] + [[piece() for _ in range(rng.randrange(60))] for _ in range(150)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, ps array<string>")
    for most, compat, cue in ((30, False, None), (30, True, None), (41, True, "D")):
        got = {r["k"]: r["c"] for r in rows.select("k", T.packed(F.col("ps"), most, compat, cue).alias("c")).collect()}
        assert [got[k] for k in range(len(lists))] == [packing(x, most, compat, cue) for x in lists]


@pytest.mark.parametrize(("room", "overlap"), [(40, 10), (25, 24), (60, 3)])
def test_overlapping(spark, room, overlap):
    rng = random.Random(4)
    lists = [[], ["x" * 90], ["x" * 90, "y"]] + [["".join(rng.choice("abé ") + "." for _ in range(rng.choice([1, 2, 4, 9, 30]))) for _ in range(rng.randrange(50))] for _ in range(150)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, ps array<string>")
    got = {r["k"]: r["c"] for r in rows.select("k", T.packed_overlapping(F.col("ps"), F.lit(room), overlap).alias("c")).collect()}
    assert [got[k] for k in range(len(lists))] == [overlapping(x, room, overlap) for x in lists]


def test_a_million_paragraphs(spark):
    ps = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: F.concat(F.lit("paragraph "), i.cast("string"))).alias("ps"))
    began = time.time()
    plain = ps.select(T.packed(F.col("ps"), 900).alias("c")).select(F.size("c"), F.sum(F.aggregate("c", F.lit(0).cast("long"), lambda s, c: s + F.length(c))).over(__import__("pyspark").sql.Window.partitionBy(F.lit(0)))).first()
    want = packing([f"paragraph {i}" for i in range(1, 20_001)], 900, False, None)
    few = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.concat(F.lit("paragraph "), i.cast("string"))).alias("ps")).select(T.packed(F.col("ps"), 900).alias("c")).first()["c"]
    assert few == want and plain[0] > 10_000
    assert plain[1] == sum(len(f"paragraph {i}") for i in range(1, 1_000_001)) + 1_000_000 - plain[0]
    assert ps.select(F.size(T.packed_overlapping(F.col("ps"), F.lit(2000)))).first()[0] > 9_000
    assert time.time() - began < 240


def test_doubles_of_many_lines():
    rng = random.Random(5)
    lines = ["".join(rng.choice("abcdefghij klmnop") for _ in range(rng.randrange(1, 120))) for _ in range(10_000)]
    lines += [f"Item number {k}: the same words but for a number and what it says about lot {k * 7}" for k in range(5_000)]
    lines += ["the very same head of the line " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(5_000)]
    rng.shuffle(lines)
    began = time.time()
    kept = cases.first_of_alike(lines)
    assert time.time() - began < 60 and 5_000 < len(kept) < 20_000
    small = rng.sample(lines, 400) + [lines[0][: len(lines[0]) // 2], lines[1] + " more", "", " "]
    assert cases.first_of_alike(small) == unlike(small)


@pytest.mark.parametrize("least", [0.5, 0.7, 0.85, 0.99])
def test_doubles_at_other_shares(least):
    rng = random.Random(6)
    base = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 24))) for _ in range(60)]
    made = base + ["".join(c if rng.random() > 0.2 else "z" for c in b) for b in base]
    rng.shuffle(made)
    want = []
    for t in made:
        if not any(s in t or t in s or sum(a == b for a, b in zip(s, t, strict=False)) / min(len(s), len(t)) > least for s in want):
            want.append(t)
    assert cases.first_of_alike(made, least) == want
