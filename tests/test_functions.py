"""Text rules, scores and case edits on literals; expected values are written by hand."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import cases, matching as M


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def value(spark, f, x):
    return one(spark, f(F.lit(x).cast("string")))


@pytest.mark.parametrize(("f", "given", "expected"), [
    (T.normalize_party, "Copper Kettle Pvt. Ltd.", "copper kettle"), (T.normalize_party, "Mr. Quill & Ors.", "quill"), (T.normalize_party, "Lantern Works Private Limited", "lantern works"), (T.normalize_party, None, ""),
    (T.normalize_party_ends, "M/s. Blue Co. of Mr. X Ltd.", "blue co of mr x"), (T.normalize_party_ends, "State of Kerala and 3 others", "state of kerala"),
    (T.normalize_citation, "2023 (5) No. 42 of Größe", "2023542größe"), (T.core_case_number, "W.P.No. 5 of 2017 & Ors. dated 1.2.2017 x", "wp52017"),
    (T.clean_page, "\n\n a\t b    c  \n\n\n\nd \n", " a  b c\n\nd"), (T.clean_answer, " a ,b( c )d ", "a, b (c) d"), (T.first_sentence, "One. Two.", "One."), (T.without_number, "Q. 12: Why ?", "Why?"),
    (T.plain_html, "<p>a&amp;b</p><script>x</script> c", "a&b c"), (T.clean_minutes, "a Page 3  b", "a  b"),
])
def test_text_rules(spark, f, given, expected):
    assert value(spark, f, given) == expected


def test_case_numbers_are_written_out(spark):
    assert value(spark, T.case_numbers, "W.P.M.P.Nos.104 & 105 of 2011") == ["W.P.M.P.No. 104 of 2011", "W.P.M.P.No. 105 of 2011"]


def test_publisher(spark):
    f = lambda x: T.long_publisher(x, "Rep", "Reports")
    assert value(spark, f, "see 2023 rep 42 there") == "2023 Reports 42"
    assert value(spark, f, "none") == "none"


def test_party_pairs(spark):
    got = value(spark, T.party_pairs, "Blue Ring v. Red Widget (2019) and Red Widget vs Blue Ring judgment")
    assert [(p["a"], p["b"]) for p in got][:1] == [("Blue Ring", "Red Widget")]


def test_packing(spark):
    long, short = "x" * 1000, "y" * 10
    parts = F.array(F.lit(long), F.lit(short))
    assert one(spark, T.packed(parts, 900)) == [long, short]
    assert one(spark, T.packed(parts, 900, compat=True)) == ["", long, short]
    assert one(spark, T.packed(F.array(F.lit("a"), F.lit("b")), 900)) == ["a b"]


def test_overlapping(spark):
    got = one(spark, T.packed_overlapping(F.array(*[F.lit(c * 30) for c in "abc"]), F.lit(70), 10))
    assert got == ["a" * 30 + " " + "b" * 30, "b" * 10 + " " + "c" * 30]


def test_fuzzy(spark):
    f = lambda a, b: one(spark, T.fuzzy(F.lit(a), F.lit(b)))
    assert (f("same name", "same name"), f("", "x"), f("ab cd", "ab ef")) == (1.0, 0.0, pytest.approx(1 / 3))
    assert f("blue ring stores", "blue widget") == pytest.approx((4 / 14 + 4 / 10) / 2)


def test_bands_follow_the_leader(spark):
    assert one(spark, M.bands(F.array(*[F.lit(x) for x in (1.00, 0.97, 0.96, 0.94, 0.93, 0.90)]))) == [0, 0, 0, 1, 1, 1]


def test_probe_compat(spark):
    got = value(spark, lambda q: M.probe(q, strict=False), "section 16")
    assert (got["key"], got["sub"]) == ("1", "6")


def test_chunk_score(spark):
    assert one(spark, M.chunk_score(F.lit("judgment"), F.lit("In favour of assessee"), F.lit("defensive"), F.lit(None).cast("double"))) == 80


def test_routing(spark):
    r = lambda *a: one(spark, cases.routing(*[F.lit(x).cast("boolean") for x in a]))
    assert (r(False, False, None), r(True, True, True), r(True, False, None), r(True, False, False)) == ("add", "ask_user", "ask_user", "new_case")


def test_issue_edits(spark):
    issues = F.from_json(F.lit('[{"id":1,"text":"a","reply":"r","status":"s"},{"id":2,"text":"b"},{"id":3,"text":"c"}]'), f"array<{cases.ISSUE}>")
    edit = lambda action: [(x["id"], x["text"]) for x in one(spark, cases.edit(issues, F.lit(action), F.array(F.lit(1), F.lit(3)), F.lit("new")))]
    assert edit("merge") == [(1, "b"), (2, "new")]
    assert edit("add")[-1] == (4, "new")
    assert edit("correct") == [(1, "new"), (2, "b"), (3, "new")]
    assert edit("remove") == [(1, "b")]
    assert len(one(spark, cases.pending(issues))) == 2
    assert one(spark, cases.set_reply(issues, F.lit(2), F.lit("x")))[1]["status"] == "user_edited"


def test_doubles(spark):
    texts = F.array(F.lit("the notice is late"), F.lit("The notice is late!"), F.lit("other"))
    assert one(spark, cases.without_doubles(texts)) == ["the notice is late", "other"]


def test_halves(spark):
    got = one(spark, T.halves(F.lit("a" * 49 + "\n" + "b" * 50), limit=80, overlap=5, near=10))
    assert got[0].startswith("a" * 49) and got[1].endswith("b" * 50) and len(got[0]) + len(got[1]) == 110
