"""The stored index, histories in prompts, and answers with what they cite."""

import random

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import answering, matching


def test_the_stored_index_stays_where_it_is(spark, tmp_path):
    index = spark.range(500).selectExpr("'section' index_name", "cast(id % 40 as string) key", "'' sub", "id chunk_id", "id pos")
    stored = matching.store_index(index, "index_test", str(tmp_path / "index"), 4)
    asked = spark.createDataFrame([(k, f"section {k}") for k in range(60)], "query_id int, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = matching.look_up(asked, stored)
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the questions'
    assert found.count() == 500 and matching.look_up(asked, index).count() == 500


def kept(sizes, fixed, budget, pairs, floor):
    """Message by message, oldest first."""
    left = sizes[-2 * pairs :]
    while left and fixed + sum(left) > budget:
        left = [] if len(left) <= floor else left[2:]
    return len(left)


def test_histories(spark):
    rng = random.Random(1)
    lists = [[rng.randrange(1, 60) for _ in range(rng.randrange(0, 26))] for _ in range(200)]
    fixed = [rng.choice([0, 100, 300, 600]) for _ in lists]
    history = spark.createDataFrame([(k, i, "user", "x" * n) for k, x in enumerate(lists) for i, n in enumerate(x)], "query_id int, place long, role string, content string")
    sizes = spark.createDataFrame(list(enumerate(fixed)), "query_id int, size int")
    got = {r["query_id"]: (r["n"], r["first"]) for r in answering.trimmed(history, sizes, 500, 10, 4).groupBy("query_id").agg(F.count("*").alias("n"), F.min("place").alias("first")).collect()}
    want = {k: (n, len(x) - n) for k, x in enumerate(lists) if (n := kept(x, fixed[k], 500, 10, 4))}
    assert got == want


def test_answers_with_what_they_cite(spark):
    judgments = spark.createDataFrame([(1, "Small Ring Pvt Ltd", "State Stores", "2019 SCC 1", "W.P. 5 dated 1.1.2019"), (2, "small ring", "state stores", None, None), (3, "Other", "Else", "c3", "n3")], "external_id int, petitioner string, respondent string, citation string, case_number string")
    answers = spark.createDataFrame([(1, "Small Ring v. State Stores (2019)"), (2, "Nobody here"), (3, "Unknown One vs Unknown Two case"), (4, None)], "query_id int, answer string")
    found = answering.attributed(answers, judgments)
    assert [(r["pair_no"], r["rank"], r["external_id"]) for r in found.orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    got = {r["query_id"]: r["answer"] for r in answering.with_citations(answers, found).collect()}
    assert got[2] == "Nobody here" and got[3] == "Unknown One vs Unknown Two case" and got[4] is None
    assert got[1].startswith("Small Ring v. State Stores (2019)\n\n---\n") and got[1].endswith("**Small Ring vs State Stores:**\n- 2019 SCC 1 (W.P. 5) [Score: 1.00]\n-  [Score: 1.00]")


def test_citations(spark):
    rows = [("x 2020 Lex 5 y", "2020 Lex.online 5"), ("2019 ( 3 ) TMI 7, 2020 Lex 5", "2019 ( 3 ) TMI 7"), ("2018tmi9", "2018tmi9"), ("2017 (2)SCC 4", "2017 (2)SCC 4"), ("2017 (2) SCC4", None), ("2020 LEX.ONLINE 8", "2020 LEX.ONLINE 8"), (None, None)]
    got = spark.createDataFrame(rows, "x string, want string").select(T.first_citation(F.col("x"), ("Lex", "Lex.online")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_shared_lists_are_put_in_words_once(spark):
    """The same prompts as from a list for each question; words stand once a list and intent, not once a question."""
    said = ["what does the court say", "how to register", "", "meaning of it", "anything"]
    questions = spark.createDataFrame([(q, said[q % 5], q % 4) for q in range(60)], "query_id long, question string, list long")
    lists = spark.createDataFrame([(n, r, ["rule", "judgment", "act"][(n + r) % 3], r == 4 and n == 1, 100 * n + r) for n in range(3) for r in range(1, 9)], "list long, rank int, chunk_type string, complete boolean, chunk_id long")
    texts = lists.select("chunk_id", F.concat(F.lit("block "), F.col("chunk_id").cast("string")).alias("block"))
    history = spark.range(60).selectExpr("id query_id", "explode(sequence(0L, id % 7)) place").selectExpr("query_id", "place", "'user' role", "repeat('x', 20) content")
    own = questions.select("query_id", "list").join(lists, "list").drop("list")
    write = lambda prompt: F.sha2(prompt, 256)
    for told in (None, history):
        each = answering.assemble(questions, own, texts, write, history=told, budget=200)
        once = answering.assemble(questions, lists, texts, write, history=told, budget=200, shared="list")
        assert sorted(once.collect()) == sorted(each.collect())
        assert once.count() == 60
