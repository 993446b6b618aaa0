"""Rules that cut and write records, on texts that the tables lack; judgments by all their keys."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import records as R, text as T
from sparkloom.operators import answering as A, matching as M


@pytest.mark.parametrize(("made", "expected"), [
    (lambda: R.segments(F.lit("x Head 1 a\nb Head 2 c"), r"Head \d"), ["Head 1 a\nb ", "Head 2 c"]), (lambda: R.segments(F.lit("none"), "Head"), []),
    (lambda: R.problem_solution(F.lit("p SOLUTION: s solution : t"))["solution"], "s"), (lambda: R.numbered_title(F.lit("no title"), "rule")["title"], "Untitled"),
    (lambda: R.meeting(F.lit("the 53rd GST Council Meeting, 22 June 2024"))["meeting_no"], "53"), (lambda: R.meeting(F.lit("none"))["held_on"], "UNKNOWN"),
    (lambda: R.definitions(F.lit("“Agent ” means a; “x” is")), ["agent"]), (lambda: R.undated(F.lit("2019 (3) X 4 dated 1.1.2019")), "2019 (3) X 4"),
    (lambda: R.salvaged_json(F.lit("```{\"a\": 1}```"), "a int")["a"], 1), (lambda: R.capped_keywords(F.lit(["A", "a", "b"]), 2), ["A", "b"]),
    (lambda: R.analysis_text({"A": F.lit(" "), "B": F.lit("x")}, F.lit([]).cast("array<string>")), "B: x"), (lambda: R.plain_signs(F.lit("a – b…")), "a - b..."),
])
def test_rules(spark, made, expected):
    assert spark.range(1).select(made().alias("x")).first()["x"] == expected


def test_judgments_by_the_first_reason(spark):
    """Citation, then case number, both parties, one; a part of a name only where no party was hit."""
    judgments = spark.createDataFrame([(1, "2019 (3) X 4", "W.P. No. 1 of 2017", "Blue Ring", "Red Widget"), (2, None, "W.P. No. 2 of 2017", "Red Widget", "Other"), (3, "", None, "The Blue Ring Works", None)], "external_id int, citation string, case_number string, petitioner string, respondent string")
    asked = spark.createDataFrame([(1, "2019 (3) x 4", "W.P. No. 2 of 2017", "red widget", None), (2, None, None, "Red Widget", "Blue Ring"), (3, None, "", "ring", "nobody")], "query_id int, citation string, case_number string, one string, two string")
    got = sorted((r["query_id"], r["external_id"], r["reason"]) for r in M.find_judgments(asked, judgments).collect())
    assert got == [(1, 1, "citation"), (1, 2, "case_number"), (2, 1, "both"), (2, 2, "petitioner"), (3, 1, "substring"), (3, 3, "substring")]


def test_kinds_and_headings(spark):
    rows = spark.createDataFrame([("faq", "Rule", None, None), ("", "Case Study", None, None), (None, None, "10", "9"), (None, "", None, "9"), (None, None, None, None)], "c string, d string, h string, s string")
    kinds = rows.select(M.kind_of(F.col("c"), F.col("d"), F.col("h"), F.col("s")).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["faq", "case_study", "hsn", "sac", None]
    parts = F.array(*[F.lit(x) for x in ("Facts of it", "more", "HELD that", "x" * 30, "end")])
    assert spark.range(1).select(T.packed(parts, 30, cue=T.HEADINGS).alias("c")).first()["c"] == ["Facts of it more", "HELD that", "x" * 30, "end"]


def test_retrieval_cuts_nothing_that_counts(spark):
    """Judgments stand once, without their chunks; a band's kinds by priority; cut lists equal the front of whole ones."""
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id long, q array<float>")
    matches = spark.createDataFrame([(1, 7, "both"), (2, 8, "substring")], "query_id long, external_id long, reason string")
    whole = spark.createDataFrame([(7, -7, [0.6, 0.8]), (8, -8, [1.0, 0.0])], "external_id long, chunk_id long, vector array<float>")
    kinds = ["faq", "rule", "judgment", None]
    chunks = spark.createDataFrame([(i, 7 if i == 5 else None, kinds[i % 4]) for i in range(60)], "chunk_id long, external_id long, chunk_type string")
    statutory = spark.createDataFrame([(1, i) for i in range(0, 60, 2)], "query_id long, chunk_id long")
    near = spark.createDataFrame([(q, i, 1 - i / 100) for q in (1, 2) for i in range(50)], "query_id long, chunk_id long, score double")
    got = lambda k: [(r["query_id"], r["rank"], r["chunk_id"], r["score"], r["stage"]) for r in A.retrieve(queries, matches, whole, statutory, near, chunks, k).orderBy("query_id", "rank").collect()]
    every = got(1000)
    assert got(9) == [r for r in every if r[1] <= 9]
    assert every[0] == (1, 1, -7, 1.6, 0) and (1, 5) not in {(r[0], r[2]) for r in every}
    assert {r[3] for r in every if r[2] == -8} == {0.95}
    assert len(every) == len({(r[0], r[2]) for r in every})


def test_topics_meet_their_first_chunks_alone(spark):
    """The same lists as from all statutory hits of a topic, from no more than k of them a query."""
    queries = spark.createDataFrame([(q, [1.0, 0.0]) for q in range(6)], "query_id long, q array<float>")
    matches = spark.createDataFrame([(1, 7, "both")], "query_id long, external_id long, reason string")
    whole = spark.createDataFrame([(7, -7, [0.6, 0.8])], "external_id long, chunk_id long, vector array<float>")
    kinds = ["faq", "rule", "judgment", None]
    chunks = spark.createDataFrame([(i, 7 if i % 9 == 5 else None, kinds[i % 4], i // 2 % 3 if i % 7 else None) for i in range(120)], "chunk_id long, external_id long, chunk_type string, topic int")
    topics = spark.createDataFrame([(q, q % 3 if q < 4 else None) for q in range(6)], "query_id long, topic int")
    near = spark.createDataFrame([(q, i, 1 - i / 200) for q in range(6) for i in range(0, 120, 1 + q)], "query_id long, chunk_id long, score double")
    free = chunks.where("external_id is null").drop("external_id")
    every = topics.join(free, "topic").select("query_id", "chunk_id")
    for k in (3, 9):
        statutory, marked = A.of_topics(topics, free, near, k)
        assert statutory.count() <= 4 * k < every.count() and marked.count() == near.count()
        rows = lambda *hits: sorted(A.retrieve(queries, matches, whole, *hits, chunks, k).collect())  # noqa: E731,B023
        assert rows(statutory, marked) == rows(every, near)


def test_siblings_meet_in_an_issues_row(spark):
    """The best of all siblings under an issue's keys, each key's list and each issue's cut: no more than twice as many rows an issue as are wanted, whatever its keys."""
    held = spark.createDataFrame([(i, mode, key, float(i * 7 % 5)) for i in range(300) for mode in ("a", "b") for key in (f"x{i % 6}", f"y{i % 4}")], "chunk_id long, mode string, key string, score double")
    keys = lambda q: [f"x{i}" for i in range(q % 7)] + [f"y{i}" for i in range(q % 5)]
    asked = spark.createDataFrame([(q, "ab"[q % 2], k) for q in range(30) for k in keys(q)], "query_id long, mode string, key string")
    got = [(r["query_id"], -r["score"], r["chunk_id"]) for r in A.best_siblings(asked, held, 9).collect()]
    for q in range(30):
        want = sorted({(-float(i * 7 % 5), i) for i in range(300) if f"x{i % 6}" in keys(q) or f"y{i % 4}" in keys(q)})[:9]
        own = [r[1:] for r in got if r[0] == q]
        assert len(own) <= 18 and sorted(set(own))[: len(want)] == want


def test_an_issues_passes_are_made_once(spark):
    """Both passes are read for what they found and the second for its siblings, too; neither is computed again for that."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = lambda shift: spark.createDataFrame([(q, r, 2 * r + q + shift, "rule") for q in range(4) for r in range(1, 6)], schema)
    schema = "query_id long, rank int, chunk_id long, chunk_type string"
    chunks = spark.createDataFrame([(i, "judgment" if i % 3 else "rule", "In favour of revenue", i % 2, i % 5) for i in range(80)], "chunk_id long, chunk_type string, decision string, section int, source int")
    modes = spark.createDataFrame([(q, "defensive" if q % 2 else "in_favour") for q in range(4)], "query_id long, mode string")
    found = A.for_issue(rows(1).mapInArrow(counted, schema), rows(0).mapInArrow(counted, schema), chunks, modes).collect()
    assert len(found) == 4 * 25 and made.value == 2 * 20
