"""Readers on small files, and streams against their batch twins."""

import zipfile

import pytest

from sparkloom.operators import cases
from sparkloom.sources import files
from sparkloom.streaming import sessions

DATA = "/root/testdata/sf0.001"


def test_sheet(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿\n\nID,Title,Description\n1,One,"two\nlines"\n2,Short\n3,Blank,\n'.encode())
    rows = files.read_articles(spark, str(tmp_path / "a.csv")).collect()
    assert [(r["external_id"], r["title"], r["text"]) for r in rows] == [("1", "One", "two\nlines")]
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    with pytest.raises(Exception, match="no header"):
        files.read_articles(spark, str(tmp_path / "b.csv")).collect()


def test_codes(spark, tmp_path):
    (tmp_path / "h.csv").write_text("list of codes\nID,HSN Code,Description,CGST,SGST,IGST,CESS\n1,10,Grain,5,5,10,0\n2,10,Again,1,1,2,0\n3,,None,1,1,2,0\n")
    rows = files.read_codes(spark, str(tmp_path / "h.csv"), "HSN", "HSN Code").collect()
    assert [(r["id"], r["text"]) for r in rows] == [("HSN-10", "HSN 10: Grain (CGST 5, SGST 5, IGST 10, CESS 0)")]


def test_word(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('No')}</w:tc><w:tc>{p('Name')}</w:tc></w:tr><w:tr><w:tc>{p('1')}</w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{files.WORD_XML[1:-1]}"><w:body>{p("First")}{p(" ")}{p("Second")}{table}</w:body></w:document>')
    rows = files.read_word(spark, str(tmp_path)).orderBy("kind", "pos").collect()
    assert [(r["kind"], r["text"]) for r in rows] == [("header", "No"), ("header", "Name"), ("paragraph", "First"), ("paragraph", "Second")]


def test_union_and_append(spark, tmp_path):
    a = spark.createDataFrame([("1", "x", "k")], "id string, text string, extra string")
    b = spark.createDataFrame([("1", "y"), ("2", "z"), (None, "n")], "id string, text string")
    got = files.union_sources([a, b]).orderBy("id").collect()
    assert [(r["id"], r["text"], r["extra"]) for r in got] == [("1", "x", "k"), ("2", "z", None)]
    for _ in range(2):
        files.append_new(b.where("id is not null"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def run(query, mode, name):
    q = query.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_daily_report_stream(spark):
    run(sessions.daily_report(sessions.stream(spark, DATA, "events")), "complete", "daily")
    batch = spark.read.parquet(f"{DATA}/events.parquet")
    assert spark.sql("select sum(n) s from daily").first()["s"] == batch.count()


def test_capped_slots_stream(spark):
    run(sessions.capped_slots(sessions.stream(spark, DATA, "events"), 3), "update", "slots")
    got = {r["user_id"]: list(r["slots"]) for r in spark.table("slots").collect()}
    want = {}
    for r in sorted(spark.read.parquet(f"{DATA}/events.parquet").where("event_type = 'signup'").collect(), key=lambda r: (r["ts"], r["event_id"])):
        want.setdefault(r["user_id"], []).append(r["event_id"])
    assert got == {k: v[-3:] for k, v in want.items()}


def test_judgments_and_questions(spark, tmp_path):
    heads = ["ID", *files.JUDGMENT_FIELDS.values(), "Judgement Description"]
    (tmp_path / "j.csv").write_text("\n" + ",".join(heads) + "\n" + ",".join([" 7 ", *[f"v{i}" for i in range(len(heads) - 2)], "the text"]) + "\n" + ",".join(["8"] * (len(heads) - 1)) + "\n")
    rows = files.read_judgments(spark, str(tmp_path / "j.csv")).collect()
    assert [(r["external_id"], r["citation"], r["case_note"], r["text"]) for r in rows] == [("7", "v1", "v17", "the text")]
    (tmp_path / "q.csv").write_bytes('ID,Query\n1,"Q. 1 What is due? Ans: caf\xe9"\n2,\n3,Hm?\n'.encode("latin-1"))
    kept, seen = files.counted(files.read_questions(spark, str(tmp_path / "q.csv")), files.F.col("skipped"))
    assert [(r["row_id"], r["question"], r["answer"]) for r in kept.collect()] == [("1", "What is due?", "caf\xe9")]
    assert seen.get == {"loaded": 1, "skipped": 2}


def test_services_header_anywhere(spark, tmp_path):
    (tmp_path / "s.csv").write_text("x,y\n" * 20 + "SAC Code,Description,CGST,SGST,IGST,CESS\n99, Care ,9,9,18,0\n98,,1,1,2,0\n")
    assert [(r["id"], r["text"]) for r in files.read_codes(spark, str(tmp_path / "s.csv"), "SAC", "SAC Code").collect()] == [("SAC-99", "SAC 99: Care (CGST 9, SGST 9, IGST 18, CESS 0)")]


def test_first_row_of_a_file_stays(spark, tmp_path):
    rows = spark.createDataFrame([("1", "b", 1), ("1", "a", 2), ("2", "c", 0)], "id string, text string, row_no int")
    assert sorted(r["text"] for r in files.union_sources([rows]).collect()) == ["b", "c"]
    files.append_new(rows, str(tmp_path / "t"))
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["b", "c"]


def test_corpus_and_vectors_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", "x"), (None, "y"), ("3", None)], "id string, text string")
    for _ in range(2):
        files.write_corpus(rows, str(tmp_path / "c"), "json")
    assert [(r["id"], r["text"]) for r in files.read_json_corpus(spark, str(tmp_path / "c"), "id string, text string").collect()] == [("1", "x")]
    vectors = spark.range(50).selectExpr("id pos", "array(id / 2, 1.5) vector")
    files.write_vectors(vectors, str(tmp_path / "v"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "v")).orderBy("pos").collect()] == [(i, [i / 2, 1.5]) for i in range(50)]


def test_case_stream(spark):
    made = lambda rows: rows.selectExpr("conv_id session", "turn place", "element_at(array('new', 'decide', 'mode', 'done', 'analyse', 'switch'), int((turn + conv_id) % 6 + 1)) action", "1 target")
    run(sessions.case_stream(made(sessions.stream(spark, DATA, "conversations"))), "update", "cases")
    got = {(r["session"], i + 1): ("active" if i + 1 == r["active"] else "archived", s) for r in spark.table("cases").collect() for i, s in enumerate(r["states"])}
    batch = cases.case_states(made(spark.read.parquet(f"{DATA}/conversations.parquet"))).collect()
    assert got and got == {(r["session"], r["case_id"]): (r["status"], r["state"]) for r in batch}


def test_tables_of_pages(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"1|x  y\n2|\f\fNo|Name")
    reader = lambda data: [[[[c or None for c in row.split("|")] for row in page.split("\n")]] if page else [[]] for page in data.decode().split("\f")]
    rows = files.read_tables(spark, str(tmp_path), reader).orderBy("page", "row_no").collect()
    assert [(r["page"], r["table_no"], r["row_no"], r["cells"]) for r in rows] == [(1, 0, 0, ["1", "x y"]), (1, 0, 1, ["2", None]), (3, 0, 0, ["No", "Name"])]
