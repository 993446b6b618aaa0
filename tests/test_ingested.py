"""Parts of circulars and items of minutes, line by line."""

import re

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import ingested, statutes

LONG = "and so on and on, with all that it takes to be long enough for a part of its own, which is a hundred and twenty characters and some"
CIRCULAR = f"""No. 1/2020
1. Is this a question? It is clarified that nothing of it stays {LONG}
nobody reads this
In view of the above, it  is said   {LONG}
(a) a point
3. Is there more?
lost
It is hereby clarified that short
it is hereby clarified that {LONG}
inter –state  trade
Yours faithfully, it is clarified that {LONG}
It is clarified that {LONG}"""


def test_parts_of_a_circular(spark):
    docs = spark.createDataFrame([(1, CIRCULAR), (2, None), (3, ""), (4, "it is clarified that")], "doc_id long, text string")
    for block in (2, 4096):
        found = ingested.operative_parts(statutes.lines_of(docs, "doc_id", "text"), "doc_id", ingested.CIRCULAR, replaced=(("inter –state", "inter-state"),), block=block)
        assert [(r["doc_id"], r["first_pos"], r["lines"], r["text"]) for r in found.orderBy("first_pos").collect()] == [
            (1, 3, 2, f"In view of the above, it is said {LONG} (a) a point"), (1, 8, 2, f"it is hereby clarified that {LONG} inter-state trade")
        ]


def test_items_of_minutes(spark):
    pages = [(1, 1, "before Agenda Item 1: taxes. It was decided so. Section 16(2) and Rule 5A"), (1, 2, "still of it, Notification No. 12/2017. Agenda Item  2 nothing. at all"), (1, 3, None), (2, 1, "no item")]
    found = ingested.agenda_items(spark.createDataFrame(pages, "doc_id long, page int, text string"), "doc_id", lambda x: F.split(F.lower(x), r"\W+"))
    one, two = found.orderBy("item_no").collect()
    assert (one["agenda_item"], one["pages"], one["decisions"], one["summary"]) == ("1", [2], ["It was decided so."], "It was decided so.")
    assert one["text"] == ": taxes. It was decided so. Section 16(2) and Rule 5A\n\nstill of it, Notification No. 12/2017."
    assert (one["sections"], one["rules"], one["notifications"]) == (["16("], ["5A"], ["12/2017"])
    assert (two["agenda_item"], two["pages"], two["decisions"], two["summary"]) == ("2", [3], [], "Agenda Item 2 discussion.")


def test_terms_are_counted_in_the_row(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "c", "a", "é"]), (2, []), (3, ["x"])], "id int, t array<string>")
    got = {r["id"]: [tuple(x) for x in r["k"]] for r in rows.select("id", T.most_frequent(F.col("t"), 2).alias("k")).collect()}
    assert got == {1: [("a", 2, 1), ("b", 2, 2)], 2: [], 3: [("x", 1, 1)]}
    assert re.fullmatch(ingested.AGENDA, "Agenda Item 3")
