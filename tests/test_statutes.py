"""Chunks of a statute against a pass line by line, and paths across blocks."""

import random
import re

from pyspark.sql import functions as F

from sparkloom.operators import statutes

TEXT = """An Act
CHAPTER I
Notified date of Section: 1 July 2017
Section 1. Short title – and so on
(1) This Act may be called so.
[1] Inserted by another Act.
Section 2. Definitions – in this Act,
unless the context says otherwise,
(1) “Aggregate Turnover” means all of it;
(a) of one kind,
(b) and another;
(2) “agent” means a person,
who acts
(3A) the words above
CHAPTER II now
this still belongs to section 2
Notified date of Section: 2 July 2017
12A. Levy – and collection
Provided that nothing
Section 2. Again – left out
(1) nobody reads this
Section 3. Officers - of this Act
(1) first
(2) second
Explanation"""


def by_hand(key, text, rules=statutes.ACT):
    """Line by line with what has been seen so far."""
    out, chapter, date, seen, section, open_ = [], rules.first_chapter, None, set(), None, None

    def close(kind):
        if open_ and open_["lines"]:
            out.append((key, *section, open_["sub"], kind, open_["term"], sum(bool(re.search(rules.clause, x)) for x in open_["lines"]), open_["pos"], "\n".join(open_["lines"]).strip()))

    def end():
        if section:
            close("definition" if section[0] == rules.terms else "operative")

    for pos, raw in enumerate((text or "").split("\n")):
        line = raw.strip()
        if not line:
            continue
        header = next((m for p in rules.section if (m := re.search(p, line))), None)
        if re.search(rules.chapter, line):
            chapter = line
        elif m := re.search(rules.notified, line):
            date = m.group(1).strip()
        elif header:
            end()
            section, open_ = None, None
            if header.group(1) not in seen:
                seen.add(header.group(1))
                section, open_, date = (header.group(1), header.group(2).strip(), chapter, date), {"lines": [], "sub": None, "term": None, "pos": None}, None
        elif not re.search(rules.dropped, line) and section:
            d = re.search(rules.definition, line) if section[0] == rules.terms else None
            if sub := re.search(rules.subsection, line):
                close("definition" if d else "operative")
                open_ = {"lines": [], "sub": sub.group(1), "term": d.group(2).lower() if d else None, "pos": None}
            if open_["pos"] is None:
                open_["pos"] = pos
            open_["lines"].append(line)
    end()
    return out


COLUMNS = ("doc_id", "section_number", "section_title", "chapter", "notified_date", "subsection", "chunk_type", "definition_term", "clauses", "first_pos", "text")


def got(spark, rows, block):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = statutes.chunks(statutes.lines_of(docs, "doc_id", "text"), "doc_id", block=block).collect()
    return sorted((tuple(r[c] for c in COLUMNS) for r in found), key=repr)


def test_an_act(spark):
    want = by_hand(1, TEXT)
    assert got(spark, [(1, TEXT), (2, None), (3, "")], 4) == sorted(want, key=repr)
    assert [(r[1], r[5], r[6]) for r in want] == [("1", "1", "operative"), ("2", None, "definition"), ("2", "1", "definition"), ("2", "2", "operative"), ("2", "3A", "definition"), ("12A", None, "operative"), ("3", "1", "operative"), ("3", "2", "operative")]
    assert want[1][4] is None and want[5][4] == "2 July 2017" and want[5][3] == "CHAPTER II now"


def test_shuffled_lines(spark):
    rng = random.Random(7)
    lines = TEXT.split("\n") + ["", "  ", "plain words", "(1) “term” means it", "Section 9. Nine – x", "Section 2. Two – x"]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(120)))) for k in range(60)]
    for block in (3, 10_000):
        assert got(spark, rows, block) == sorted((c for k, t in rows for c in by_hand(k, t)), key=repr)


def test_paths(spark):
    rng = random.Random(2)
    rows = [(k, pos, rng.choice([None, None, 0, 1, 2, 3]), f"{pos}") for k in range(3) for pos in range(400)]
    lines = spark.createDataFrame(rows, "doc string, pos long, level int, label string")
    want = {}
    for k, pos, level, label in rows:
        stack = want.get((str(k), pos - 1), [None] * 4)
        want[str(k), pos] = stack if level is None else [*stack[:level], label, *[None] * (3 - level)]
    for block in (7, 4096):
        found = statutes.hierarchy(lines, "doc", 4, block).select("doc", "pos", F.transform("path", lambda x: x["label"]).alias("p")).collect()
        assert {(r["doc"], r["pos"]): list(r["p"]) for r in found} == want


def test_lines_are_read_and_stripped_once(spark):
    """White space of every kind goes at both ends; texts are read for their lines, for what blocks tell and no more; nothing is stripped again in a condition."""
    white = [chr(n) for n in range(1, 0x10000) if not 0xD800 <= n < 0xE000 and chr(n) != "\n"]
    rows = [(n, f"{w}{w}a{w}b {w}\n {w}") for n, w in enumerate(white)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    raw = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw")).select("doc_id", "pos", statutes.strip(F.col("raw")).alias("line")).where("line <> ''")
    lines = statutes.lines_of(docs, "doc_id", "text")
    assert lines.exceptAll(raw).count() == raw.exceptAll(lines).count() == 0
    found = statutes.chunks(statutes.lines_of(spark.read.schema("doc_id long, text string").parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id", "text"), "doc_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "regexp_replace(raw" not in plan
