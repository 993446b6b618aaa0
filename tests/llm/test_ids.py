"""Null, repeated and extreme ids through all corpus operators and the pipeline: no crash, no changed id, no row lost unseen."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from sparkloom.llm import ann, bpe, linededup, mixing, neardup, pii, quality, secrets, substrings, toxicity

BIG = 9007199254740993  # one more than a float can tell
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __doc string"
PROSE = [" ".join(f"w{(k * 37 + i * i) % 911}" for i in range(60)) + ".\n" + f"another line number {k} with some words of its own" for k in range(8)]
IDS = [BIG, None, 2**63 - 1, -(2**63), 0, None, 7, 7]


@pytest.fixture(scope="module")
def rows():
    shared = "\nthe very same closing line stands in all of these documents"
    found = [(d, t + shared, "en", "a" if k % 2 else None, 1, "x") for k, (d, t) in enumerate(zip(IDS, PROSE, strict=True))]
    return found + [(None, None, None, None, None, None), (BIG, "", "en", "a", 0, "x"), (None, PROSE[0] + shared, "en", "b", 1, "x")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def ids(rows):
    return sorted((str(r[0]) for r in rows))


def test_ids_pass_as_they_are(docs, rows):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    labels = docs.sparkSession.createDataFrame([(BIG, 1, 1), (None, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    coded = bpe.encode(docs, ranks)
    for got in (
        secrets.scan(docs).select("doc_id").distinct(), substrings.plan(docs), coded, bpe.decode(coded, ranks), pii.summary(docs), toxicity.classify(docs, labels),
        neardup.groups(docs, 3, 85, 100), linededup.rebuild(docs), quality.assess(docs), mixing.assign(docs),
    ):
        found = [r["doc_id"] for r in got.collect()]
        assert set(found) <= {d for d, *_ in rows}
        if len(found) == len(rows):
            continue
        assert got.columns == ["doc_id"]  # findings have rows of their own


def test_rows_of_every_operator(docs, rows):
    want, ranks = ids(rows), public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert ids(substrings.plan(docs).collect()) == ids(bpe.encode(docs, ranks).collect()) == ids(mixing.assign(docs).select("doc_id").collect()) == want
    assert ids(neardup.groups(docs, 3, 85, 100).collect()) == ids(linededup.rebuild(docs).collect()) == ids(pii.summary(docs).collect()) == want


def test_rows_without_an_id_stay_whole(docs, rows):
    got = sorted(r["kept_sha256"] for r in substrings.plan(docs).where("doc_id is null").collect())
    assert got == sorted(hashlib.sha256((t or "").encode()).hexdigest() for d, t, *_ in rows if d is None)
    whole = sorted((r["text"] or "") for r in linededup.rebuild(docs).where("doc_id is null").collect())
    assert whole == sorted(t or "" for d, t, *_ in rows if d is None)
    closing = "the very same closing line"
    assert [r["doc_id"] for r in linededup.rebuild(docs).where(F.col("text").contains(closing) & F.col("doc_id").isNotNull()).collect()] == [-(2**63)]
    assert {r["component_id"] for r in neardup.groups(docs, 3, 85, 100).where("doc_id is null").collect()} == {None}
    assert neardup.keep_one(docs, 3, 85, 100).where("doc_id is null").count() == 4
    assert {r["doc_id"] for r in neardup.keep_one(docs, 3, 85, 100).collect()} == set(IDS)


def test_rows_without_an_id_are_mixed(spark):
    same = spark.createDataFrame([(None if k % 3 else BIG + k, f"text {k} " + "some words " * 200, None if k % 2 else "a") for k in range(60)], "doc_id long, text string, source string")
    per = mixing.assign(same).groupBy("src").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum(F.when(F.col("doc_id").isNull(), F.col("taken"))).alias("nameless")).collect()
    for r in per:
        assert abs(r["taken"] - r["target"]) < 0.1 * r["target"] and r["nameless"] > 0.4 * r["taken"]
    assert mixing.mixture(same).where("doc_id is null").count() > 30


def test_vectors_without_an_id(spark):
    rows = [(None, [1.0, 0.0]), (0, [1.0, 0.1]), (BIG, [0.9, 0.0]), (100, [0.5, 0.4]), (2**63 - 1, [0.0, 1.0])]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=100, k=2).collect()]
    assert sorted(got) == [(0, 1, BIG), (0, 2, 100), (100, 1, BIG), (100, 2, 0)]


def test_too_few_toxic_documents_for_a_feature(spark):
    rows = [(k, f"plain words number {k}") for k in range(7)] + [(None, "plain words")]
    got = toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k == 1)) for k in range(7)], "doc_id long, toxic int")).collect()
    assert len(got) == 8 and len({r["score"] for r in got}) == 1 and 0 < got[0]["score"] < 0.5


def test_the_sample_is_bounded_in_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "POSITIVES", 4)
    monkeypatch.setattr(toxicity, "UNLABELLED", 6)
    seen = {}
    monkeypatch.setattr(toxicity, "train", lambda xp, xu, chosen, prior: seen.update(rows=len(xp) + len(xu)) or ({}, 0.0))
    monkeypatch.setattr(toxicity, "select", lambda *a: [1, 2])
    docs = spark.createDataFrame([(k % 8, f"words of row {k}") for k in range(400)], "doc_id long, text string")
    toxicity.fit(docs, spark.createDataFrame([(k, int(k < 4)) for k in range(8)], "doc_id long, toxic int"))
    assert seen["rows"] <= 10


def test_numbered_shingles_are_the_sets():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5):
        texts = [rng.integers(0, 3, rng.integers(0, 12)) for _ in range(60)]
        sets = [set(zip(*[t.tolist()[i:] for i in range(n)], strict=False)) if len(t) >= n else {tuple(t.tolist())} if len(t) else set() for t in texts]
        got = [set(x.tolist()) for x in neardup.shingle_numbers([np.asarray(t, np.int64) for t in texts], n)]
        for i in range(60):
            assert len(got[i]) == len(sets[i])
            for j in range(i):
                assert len(got[i] & got[j]) == len(sets[i] & sets[j])


def test_the_pipeline_loses_no_row_unseen(spark, docs, tmp_path):
    docs.union(docs.sparkSession.createDataFrame([(k, PROSE[k % 8] + f" tail {k}", "en", "a", 5, "x") for k in range(20, 26)], SCHEMA)).write.parquet(str(tmp_path / "documents.parquet"))
    at, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / f"{k}"))
        at = spark.read.parquet(str(tmp_path / f"{k}"))
        counts.append({r["doc_id"] for r in at.select("doc_id").collect()})
    assert counts[0] >= {BIG, None, 2**63 - 1, -(2**63), 7} and counts[2] >= {BIG, None, 2**63 - 1, -(2**63)}


def test_a_stage_without_n_chars(spark):
    got = corpus_pipeline.line_dedup(spark, spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string"), "")
    assert got.columns == ["doc_id", "text"] and got.count() == 2
