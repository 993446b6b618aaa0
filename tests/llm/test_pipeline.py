"""run() against a brute-force version of all five stages, on a table with nulls, long texts, ties, repeated rows and a clashing column."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, common, mixing, quality
from tests.llm.test_operators import linked, lines_kept

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, target string, __doc int"


def documents():
    rng = random.Random(21)
    words = "the of and to in water stone house ring over under river mountain walks sings blue green quickly letter answer".split()
    sentence = lambda: " ".join(rng.choice(words) for _ in range(12)).capitalize() + "."
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "short text"), (4, "| # " * 80), (5, "BUY NOW! " * 60)]
    shared = ["A line that many documents share.", "  Another LINE that some share."]
    for i in range(6, 90):
        lines = [" ".join(sentence() for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 9))] + rng.sample(shared, rng.randint(0, 2))
        rng.shuffle(lines)
        out.append((i, "\n".join(lines)))
    for i in range(90, 110):  # near copies: a word of each line changed
        lines = rng.choice(out[6:90])[1].split("\n")
        out.append((i, "\n".join(x + f" n{rng.randrange(99)}" if rng.random() < 0.3 else x for x in lines)))
    out += [out[20], out[20], (21, "the same id " + out[40][1]), (200, (sentence() + "\n") * 2 + " ".join(sentence() for _ in range(3000)))]
    return [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", len(t or ""), "clash", 1) for i, t in out]


def posterior(votes):
    """Expectation-maximisation over rows, one rule and vote at a time."""
    rows = Counter(votes)
    total = sum(rows.values())
    strength = max(1.0, 0.05 * total)
    prior = lambda c, r: (quality.GOOD_BOTH if c else quality.BAD_BOTH) if r in quality.TWO_SIDED else (quality.GOOD_ONE if c else quality.BAD_ONE)
    good = {k: 0.1 if "-" in k else 0.9 for k in rows}
    for _ in range(100):
        mass = [sum(n * (1 - good[k]) for k, n in rows.items()), sum(n * good[k] for k, n in rows.items())]
        share = [(mass[c] + strength * (0.2, 0.8)[c]) / (total + strength) for c in (0, 1)]
        table = {(c, r, v): sum(n * (good[k] if c else 1 - good[k]) for k, n in rows.items() if k[r] == v) + strength * prior(c, r)["-0+".index(v)] for c in (0, 1) for r in range(len(quality.RULES)) for v in "-0+"}
        logs = {k: [math.log(share[c]) + sum(math.log(table[c, r, v] / sum(table[c, r, u] for u in "-0+")) for r, v in enumerate(k)) for c in (0, 1)] for k in rows}
        good = {k: 1 / (1 + math.exp(min(500, max(-500, x[0] - x[1])))) for k, x in logs.items()}
    return good


def brute(rows, copies_of):
    """The rows of run(), as (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    measured = [quality.measure(r[1]) for r in rows]
    good = posterior([m[-1] for m in measured])
    rows = [r for r, m in zip(rows, measured, strict=True) if m[0] >= 20 and 100 * m[4] <= 30 * m[0] and good[m[-1]] >= 0.5]
    kept = defaultdict(list)
    for r, (i, _, text) in zip(rows, lines_kept(rows), strict=True):
        assert i == r[0]
        kept[i].append((r, text))
    rows = [(i, text, *r[2:4], len(text), *r[5:]) for i, both in kept.items() for r, text in both]
    component = {i: c for i, _, c in linked(rows, 5, 80, 100)}
    rows = [r for r in rows if component[r[0]] == r[0]]
    stand = copies_of(rows)
    rows = [r for r in rows for _ in range(stand[r[0], r[1]])]
    import public_tokenizers

    code, out = bpe.coder(public_tokenizers.path("byte_bpe_50k.tiktoken")).bpe, []
    for i, text, *_ in rows:
        ids = code.encode_ordinary(text)
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def replayed(spark):
    """How often the mixture holds a row, by replaying the plan's blocks over the sources' words one by one."""

    def copies(rows):
        df = spark.createDataFrame(rows, SCHEMA)
        keys = df.select("doc_id", "text", F.xxhash64("text").alias("tie"), mixing.source_key(F.col("source")).alias("src"), mixing.n_words(F.col("text")).alias("size"), (F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(0), F.lit("copy")), F.lit(1 << 20)) / float(1 << 20)).alias("luck")).collect()
        words = defaultdict(list)
        for k, r in enumerate(sorted(keys, key=lambda r: (r["src"], r["doc_id"], r["tie"]))):
            words[r["src"]] += [(k, r["doc_id"], r["text"])] * len(r["text"].split())
        taken = Counter()
        for s in mixing.plan(df).collect():
            taken.update(words[s["src"]][s["block"] * mixing.BLOCK : (s["block"] + 1) * mixing.BLOCK])
        times, luck = defaultdict(float), {(r["doc_id"], r["text"]): (r["luck"], r["size"]) for r in keys}
        for (_, i, text), n in taken.items():
            times[i, text] = max(times[i, text], n / luck[i, text][1])
        return Counter({k: math.floor(t + luck[k][0]) for k, t in times.items()})

    return copies


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_run_against_brute_force(spark, folder):
    import corpus_pipeline as P

    got = sorted(tuple(r) for r in P.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert len(got) > 40
    assert got == brute(documents(), replayed(spark))


def test_run_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_and_leave_no_scratch(spark, folder):
    import os

    import corpus_pipeline as P

    shared = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    P.run(spark, folder)
    new = [x for x in set(os.listdir(shared)) - before if x.startswith("pipeline-")]
    assert len(new) == 1 and os.listdir(f"{shared}/{new[0]}") == ["4-bpe"]


def test_posteriors_against_rows():
    rng = np.random.default_rng(5)
    votes = ["".join("-0+"[k] for k in rng.choice(3, len(quality.RULES), p=[0.1, 0.5, 0.4])) for _ in range(300)]
    want, got = posterior(votes), quality.fit(dict(Counter(votes)))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
