"""Fill-in-the-middle against a row at a time in plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [
    None, "", " ", " \t\n", "one", " one", "one ", "one two", "a  b c d", "naïve Ωmega 日本語 text 😀 end", "has <P> in it", "has <S>", "<M>", "< P> <P <Q> fine", "<", "<P", "<S", "a<P", ">b",
    "x" * 70_000, "word " * 30_000, " wide spaces", "line\none\r\n\x0b\x0ctwo", "\x1c\x1d not white \x85", "S> <", "P>", "M>x <", "tie a", "tie a",
]


def by_hand(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    assert "".join(units) == text
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def rows():
    return [(d, t, "en", "x") for k, t in enumerate(TEXTS) for d in (k, k + 100, 2**63 - 1 - k, -k)] + [(None, "no id at all here", "en", "x"), (None, None, None, None), (5, "again 5", "en", "x"), (5, "again 5", "en", "x")]


def key(r):
    return str(r)


def test_all_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, h1 string")
    got = middle.transform(docs)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((by_hand(d, t) for d, t, *_ in rows), key=key)
    back = got.select(middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for _, t, *_ in rows)
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}


def test_one_row_a_batch_and_rates(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, h1 string")
    assert sorted(map(tuple, middle.transform(docs).collect()), key=key) == sorted((by_hand(d, t) for d, t, *_ in rows), key=key)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["form"] for r in middle.transform(docs, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in middle.transform(docs, rate=100, spm=0).collect()} == {"plain", "psm"}


def test_a_batch_in_the_middle_of_a_buffer():
    import pyarrow as pa

    raw, offsets = middle.bytes_of(pa.array(["first", "é b", "", "last"]).slice(1, 2))
    assert raw.tobytes().decode() == "é b" and offsets.tolist() == [0, 4, 4]
    assert middle.bytes_of(pa.array([], pa.string()))[1].tolist() == [0]


def test_empty_table_and_plan(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert middle.transform(docs).collect() == []
    assert "Exchange" not in middle.transform(docs)._jdf.queryExecution().executedPlan().toString()
