"""Joins of names against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import matching, names


def score(a, b):
    one, two = ({w for w in x.split(" ") if w} for x in (a, b))
    if a == b:
        return 1.0
    if not one or not two:
        return 0.0
    w = lambda ws: sum(len(x) for x in ws if len(x) > 2)
    if not w(one) or not w(two):
        return len(one & two) / len(one | two)
    return (w(one & two) / w(one) + w(one & two) / w(two)) / 2


@pytest.fixture(scope="module")
def some():
    rng = random.Random(8)
    words = ["stores", "the", "of", "a", "ab", "x", "union", "india", "traders", "steel", "ring", "widget"] + [f"name{k}" for k in range(60)]
    made = lambda: " ".join(rng.choice(words[: rng.choice([6, 12, 72])]) for _ in range(rng.randrange(1, 6)))
    return sorted({made() for _ in range(260)} | {"", "stores", "a", "a ab"}), sorted({made() for _ in range(260)} | {"", "stores", "ab a", "x"})


@pytest.mark.parametrize("least", [0.55, 0.6, 0.75, 1.0])
def test_similar_names(spark, some, least):
    one, two = (spark.createDataFrame([(n,) for n in x], "name string") for x in some)
    got = sorted((r["x"], r["y"], round(r["s"], 9)) for r in names.similar(one, two, least).collect())
    assert got == sorted((a, b, round(score(a, b), 9)) for a in some[0] for b in some[1] if score(a, b) >= least)


def test_a_common_token_is_not_met_in_full(spark):
    """Every name has 'traders'; only pairs that are alike meet."""
    rows = [(f"firm{k} traders",) for k in range(400)]
    one = spark.createDataFrame(rows, "name string")
    df = one.select(F.explode(F.split("name", " ")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    places = names._places(one, df)
    met = names._as_smaller(places, 0.75).where("token = 'traders'").count(), names._as_larger(places, 0.75).where("token = 'traders'").count()
    assert met[0] == 0 and names.similar(one, one, 0.75).count() == 400
    with pytest.raises(ValueError):
        names.similar(one, one, 0.5)


def by_hand(queries, judgments, high=0.75, low=0.6, top=5):
    out = []
    for q, a, b in queries:
        found = []
        for e, p, r in judgments:
            ap, ar, bp, br = score(a, p), score(a, r), score(b, p), score(b, r)
            if (ap > ar) != (bp > br):
                found.append((min(max(ap, ar), max(bp, br)), e))
        best = max((s for s, _ in found), default=0)
        found = sorted(((s, e) for s, e in found if s >= (high if best >= high else low)), key=lambda x: (-x[0], x[1]))[:top]
        out += [(q, e, round(s, 9), k + 1) for k, (s, e) in enumerate(found)]
    return sorted(out)


def test_pairs_of_parties(spark, some):
    rng = random.Random(9)
    pick = lambda k: [(i, rng.choice(some[k]), rng.choice(some[k])) for i in range(300)]
    judgments = pick(1) + [(1000 + i, "union of india", rng.choice(some[1])) for i in range(80)]
    queries = pick(0) + [(1000 + i, *rng.choice([j[1:], j[:0:-1]])) for i, j in enumerate(judgments[::4])]
    got = names.paired(spark.createDataFrame(queries, "query_id long, a string, b string"), spark.createDataFrame(judgments, "external_id long, p string, r string"), 0.75, 0.6, 5)
    assert sorted((r["query_id"], r["external_id"], round(r["score"], 9), r["rank"]) for r in got.collect()) == by_hand(queries, judgments)


def test_containing(spark):
    rng = random.Random(2)
    made = lambda n: "".join(rng.choice("ab é") for _ in range(rng.randrange(0, n)))
    queries = [(k, made(8), made(14)) for k in range(150)] + [(900, None, "abc"), (901, "", None)]
    judgments = [(k, made(16), made(16)) for k in range(150)] + [(900, None, None), (901, "abc ltd", "abc")]
    schema = "one string, two string"
    q, j = spark.createDataFrame(queries, f"query_id int, {schema}"), spark.createDataFrame(judgments, "external_id int, petitioner string, respondent string")
    clean = {x: c for x, c in ((r[0], r[1]) for r in spark.createDataFrame(sorted({(n or "",) for row in queries + judgments for n in row[1:]}), "n string").select("n", T.normalize_party(F.col("n"))).collect())}
    want = []
    for k, *asked in queries:
        for e, p, r in judgments:
            for side, n in (("petitioner", clean[p or ""]), ("respondent", clean[r or ""])):
                if len(n) >= 3 and any(len(clean[a or ""]) >= 3 and (clean[a or ""] in n or n in clean[a or ""]) for a in asked):
                    want.append((k, e, side))
                    break
    found = matching.match_substring(q, j)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and len(want) > 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_numbers_meet_only_where_they_are_held(spark):
    """Of names that are alike in all runs of three, only those meet that hold one another; nothing is broadcast."""
    short = spark.range(500).selectExpr("lpad(cast(id * 37 as string), 6, '0') name")
    long = spark.range(4_000).selectExpr("concat('customer ', lpad(cast(id * 11 as string), 9, '0'), ' building') name")
    found = names.containing(short, long)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    x, y = ([r["name"] for r in df.collect()] for df in (short, long))
    assert sorted(tuple(r) for r in found.collect()) == sorted((a, b) for a in x for b in y if a in b)
    sizes = spark.range(3, 200).select("id", names.run_size(F.col("id")).alias("n")).collect()
    assert all(r["n"] == r["id"] for r in sizes if r["id"] <= 8) and all(0.8 * r["id"] <= r["n"] <= r["id"] for r in sizes)
    meets = short.select("name", F.explode(names.grams(F.col("name"), F.lit(6))).alias("g")).join(long.select(F.explode(names.grams(F.col("name"), F.lit(6))).alias("g")), "g").count()
    assert meets == found.count()
