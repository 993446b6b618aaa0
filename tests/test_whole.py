"""Queries over the whole job, where the catalogue's SQL takes less of it."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from sparkloom.operators import cases, neighbours
from sparkloom.plans import catalog, ledger, retrieval, texts
from tests.test_oracles import DATA, TABLES, plain


def same(spark, name, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, DATA)
    columns, found = sorted(df.columns), con.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    got = sorted((plain(tuple(r[c] for c in columns)) for r in df.collect()), key=repr)
    assert got and got == sorted((plain(tuple(r[i] for i in at)) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["knn_topk", "cosine_clamp", "score_fusion_topk", "hierarchy_banding", "issue_rank_15_10", "primary_supporting_split"])
def test_neighbours_in_small_parts(spark, monkeypatch, name):
    """Cells of several parts, and queries in several blocks."""
    monkeypatch.setattr(neighbours, "PART", 13)
    monkeypatch.setattr(neighbours, "BLOCK", 3)
    same(spark, name, catalog.ORACLES[name])


@pytest.mark.parametrize("name", ["primary_supporting_split", "score_fusion_topk", "issue_rank_15_10", "answer_assembly"])
def test_a_vector_that_a_third_holds(spark, monkeypatch, tmp_path, name):
    """The same rows as of SQL, from no more copies of the vector than neighbours are wanted."""
    con = duckdb.connect()
    con.sql(f"CREATE TABLE embeddings AS SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN (SELECT embedding FROM '{DATA}/embeddings.parquet' WHERE vec_id = 3) ELSE embedding END AS embedding, label FROM '{DATA}/embeddings.parquet'")
    con.sql(f"COPY embeddings TO '{tmp_path}/embeddings.parquet'")
    searched, indexed = [], neighbours.indexed
    monkeypatch.setattr(neighbours, "indexed", lambda *a: searched.append(indexed(*a)) or searched[-1])
    df, found = catalog.QUERIES[name](spark, str(tmp_path)), con.sql(catalog.ORACLES[name])
    at = [found.columns.index(c) for c in sorted(df.columns)]
    got = sorted((plain(tuple(r[c] for c in sorted(df.columns))) for r in df.collect()), key=repr)
    assert got and got == sorted((plain(tuple(r[i] for i in at)) for r in found.fetchall()), key=repr)
    different = con.sql("SELECT count(DISTINCT embedding) FROM embeddings").fetchall()[0][0]
    assert [cells.count.sum() for _, cells in searched] == [different + retrieval.TOP_K - 1]


@pytest.mark.parametrize("name", ["score_fusion_topk", "issue_rank_15_10", "answer_assembly"])
def test_vectors_pass_by_queries(spark, monkeypatch, name):
    """The same rows as of SQL where a task takes several parts, and no part is handed on whole."""
    for what, n in (("PART", 61), ("BLOCK", 9), ("TASKS", 5)):
        monkeypatch.setattr(neighbours, what, n)
    made, scanned = [], neighbours._scanned
    monkeypatch.setattr(neighbours, "_scanned", lambda *a: made.append(scanned(*a)) or made[-1])
    same(spark, name, catalog.ORACLES[name])
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in made]
    assert len(plans) == 2 and all("MapInArrow" in p and "CoGroup" not in p for p in plans)


def test_cosines_of_all_pairs(spark, monkeypatch):
    """Every query meets every vector, in several blocks of both."""
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 50)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert catalog.QUERIES["cosine_clamp"](spark, DATA).count() == n * -(-n // retrieval.QUERY_EVERY)
    same(spark, "cosine_clamp", catalog.ORACLES["cosine_clamp"])


def test_cosines_take_vectors_as_they_come(spark, monkeypatch):
    """No row holds a block, so what a task holds doesn't grow with batches; queries and vectors of a block may come in many batches."""
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 90)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 20)
    monkeypatch.setattr(retrieval, "VECTOR_STEP", 5)
    monkeypatch.setattr(retrieval, "QUERY_STEP", 3)
    vectors = np.random.default_rng(2).normal(size=(200, 6))
    vectors[17] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(200, None)], "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = retrieval.cosines(rows, rows.where("vec_id % 4 = 0").selectExpr("vec_id as query_id", "embedding as q"), -0.5, 0.9, 6)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        got = {(r["query_id"], r["vec_id"]): r["score"] for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "collect_list" not in plan and "Join" not in plan
    assert sorted(got) == [(i, j) for i in range(0, 200, 4) for j in range(200)]
    for (i, j), score in got.items():
        lengths = np.sqrt((vectors[i] ** 2).sum() * (vectors[j] ** 2).sum())
        assert np.isnan(score) if j == 17 else score == pytest.approx(min(0.9, max(-0.5, vectors[i] @ vectors[j] / lengths)), abs=6e-7) and score == round(score, 6)


def overlapping(parts, room, overlap):
    """Chunks by their places: buffers are stretches of the joined sentences, from the carried characters on."""
    ends, at = [], 0
    for p in parts:
        ends.append(at + len(p))
        at += len(p) + 1
    joined, chunks, a = " ".join(parts), [], None
    for k, p in enumerate(parts):
        begin = ends[k] - len(p)
        length = ends[k] - a if a is not None else len(p)
        if length <= room:
            a = begin if a is None else a
        elif a is None:
            chunks.append(p)
        else:
            last = ends[k - 1]
            chunks.append(joined[a:last])
            a = max(a, last - overlap)
    if a is not None and parts:
        chunks.append(joined[a : ends[-1]])
    return [c.strip() for c in chunks]


def chunks(question, answer):
    """A text that fits beside its question is one chunk; else its sentences are packed."""
    fits = len(question) + len(answer) + len("Q: \n\nA: ") <= 2000
    return [answer] if fits else overlapping([s for s in re.split(r"(?<=[.!?])\s+", answer.strip()) if s], 1990 - len(question), 200)


def test_short_documents_are_chunks(spark, tmp_path):
    """pack_overlap_2000 against brute force, over the table and at the lengths where a text just fits."""
    made = [(1, "", "s"), (2, " a short one. ", None), *((i, "x" * 600 + ". " + "y" * (i - 602), "four") for i in range(1985, 2003))]
    spark.createDataFrame(made, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for d in (DATA, str(tmp_path)):
        rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "text").where("text is not null").collect()
        got = sorted(tuple(r) for r in catalog.QUERIES["pack_overlap_2000"](spark, d).select("doc_id", "chunk_no", "chunk").collect())
        assert got == sorted((r["doc_id"], i, c) for r in rows for i, c in enumerate(chunks(r["source"] or "", r["text"])))
        assert {g[0] for g in got} == {r["doc_id"] for r in rows}


def unlike(issues):
    """The rule, pair by pair and place by place."""
    seen, unique = [], []
    for issue in issues:
        x = re.sub(r"\s+", " ", issue.lower().strip())
        if not any(min(len(x), len(s)) and (x in s or s in x or sum(a == b for a, b in zip(x, s)) / min(len(x), len(s)) > 0.85) for s in seen):
            seen.append(x)
            unique.append(issue)
    return unique


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()


def test_issue_dedupe_compares_all_lines(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("ab ") for _ in range(rng.choice((5, 20, 64, 65, 200)))) for _ in range(40)]
    made = [*base, *("".join(c if rng.random() > share else "z" for c in b) for b in base for share in (0.1, 0.15, 0.2)), "  ", " ", "É x", "é  X", "\U0001f600 smile and some", "\U0001f600 smile and same"]
    rng.shuffle(made)
    assert cases.first_of_alike(made) == unlike(made) and 12 < len(unlike(made)) < len(made)
    rows = documents(spark)
    want = {r["doc_id"]: len(unlike([x for x in r["text"].split("\n") if x])) for r in rows}
    assert {r["doc_id"]: r["kept"] for r in catalog.QUERIES["issue_dedupe"](spark, DATA).collect()} == want and max(want.values()) > 12


def test_keywords_and_slices_of_documents(spark):
    words, slices = [], []
    for r in documents(spark):
        w = [x for x in re.findall(r"\b\w\w+\b", r["text"].lower()) if x not in texts.STOP]
        terms = Counter([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])
        words += [(r["doc_id"], t, n, i + 1) for i, (t, n) in enumerate(sorted(terms.items(), key=lambda x: (-x[1], x[0].encode()))[:6])]
        slices += [(r["doc_id"], i // 200, r["text"][i : i + 200]) for i in range(0, len(r["text"]), 200)]
    assert sorted(tuple(r) for r in catalog.QUERIES["keywords_topn"](spark, DATA).select("doc_id", "term", "times", "rank").collect()) == sorted(words)
    assert sorted(tuple(r) for r in catalog.QUERIES["fixed_slices"](spark, DATA).select("doc_id", "slice_no", "slice").collect()) == sorted(slices)


def test_usage_ledger_fold_adds_full_amounts(spark):
    """Against the SQL without its cap of 2; floor and alerts by a small fixture."""
    same(spark, "usage_ledger_fold", catalog.ORACLES["usage_ledger_fold"].replace("least(amount, 2) AS amount", "amount"))
    amounts = {1: [-1] * 5, 2: [-1, -1, -1, 10, -1], 3: [7]}
    rows = spark.createDataFrame([(u, i, i, x) for u, xs in amounts.items() for i, x in enumerate(xs)], "user_id int, at int, id int, amount int")
    assert sorted(tuple(r) for r in ledger.fold_balance(rows).collect()) == [(1, 0, 5, 2, 1), (2, 9, 4, 0, 1), (3, 10, 0, 0, 0)]
