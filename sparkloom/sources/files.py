"""Readers for source files and sinks for results. Files are reached through Spark, so any store that Spark reads will do."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from sparkloom.functions.text import plain_html, question_answer, strip, without_number

WORD_XML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Encodings in the order in which they are tried.
ENCODINGS = ("utf-8-sig", "latin-1", "cp1252")


def read_sheet(spark: SparkSession, path: str, required: list[str], search: int | None = None) -> DataFrame:
    """Rows of CSV files as map<string, string>, with file and row_no. The header is the first row that holds all required names, among the
    first `search` rows if given; files without one fail. A byte-order mark, blank rows and rows shorter than the header are dropped. Whole
    files are parsed, since a quoted cell may hold line ends; files are spread over tasks."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(2**31 - 1)
        for frame in frames:
            for path_, content in zip(frame.path, frame.content, strict=True):
                for encoding in ENCODINGS:
                    try:
                        text = bytes(content).decode(encoding)
                        break
                    except UnicodeDecodeError:
                        continue
                rows = [r for r in csv.reader(io.StringIO(text, newline="")) if any(c.strip() for c in r)]
                names = {n.lower() for n in required}
                at = next((i for i, r in enumerate(rows[:search]) if names <= {c.strip().lower() for c in r}), None)
                if at is None:
                    raise ValueError(f"{path_}: no header with {', '.join(required)}")
                header = [c.strip() for c in rows[at]]
                good = [dict(zip(header, r, strict=False)) for r in rows[at + 1 :] if len(r) >= len(header)]
                yield pd.DataFrame({"file": path_, "row_no": range(len(good)), "cells": good})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "file string, row_no int, cells map<string,string>")


def cell(name: str, stripped: bool = True) -> Column:
    found = F.coalesce(F.try_element_at("cells", F.lit(name)), F.lit(""))
    return strip(found) if stripped else found


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    rows = read_sheet(spark, path, ["ID", "Title", "Description"])
    return rows.select(cell("ID").alias("external_id"), cell("Title").alias("title"), cell("Author Name").alias("author"), cell("Description").alias("text")).where("text <> ''")


#: What the columns of a sheet of judgments are called here.
JUDGMENT_FIELDS = {
    "title": "Title", "citation": "Citation", "case_number": "Case Number", "court": "Court", "state": "State", "year": "Year of Judgement", "judge": "Judge Name", "petitioner": "Petitioner/Appellant Title",
    "respondent": "Respondent Title", "decision": "Decision", "current_status": "Current Status", "law": "Law", "act_name": "Act Name", "section_number": "Section Number", "rule_name": "Rule Name", "rule_number": "Rule Number",
    "notification_number": "Notification / Circular Number", "case_note": "Case Note",
}


def read_judgments(spark: SparkSession, path: str, fields: dict[str, str] = JUDGMENT_FIELDS) -> DataFrame:
    """fields: column name -> header of the file; all others are left out, and a file that lacks one fails. The first row that isn't blank is the header."""
    rows = read_sheet(spark, path, ["ID", "Judgement Description", *fields.values()], 1)
    return rows.select(cell("ID").alias("external_id"), *[cell(h).alias(c) for c, h in fields.items()], cell("Judgement Description").alias("text")).where("text <> ''")


def read_codes(spark: SparkSession, path: str, kind: str, column: str, search: int | None = None) -> DataFrame:
    """Code lists with rates; the header of an HSN list is among the first ten rows, that of others anywhere, unless `search` says so. id '{kind}-{code}', text by template, rates as they stand; rows without a code go, and of equal codes the first stays."""
    rows = read_sheet(spark, path, [column], search or (10 if kind == "HSN" else None)).select("file", "row_no", cell(column).alias("code"), cell("Description", kind == "SAC").alias("description"), *[cell(t, kind == "SAC").alias(t.lower()) for t in ("CGST", "SGST", "IGST", "CESS")]).where("code <> ''")
    if kind == "SAC":
        rows = rows.where("description <> ''")
    made = rows.withColumn("id", F.concat(F.lit(kind + "-"), "code")).withColumn("text", F.format_string(f"{kind} %s: %s (CGST %s, SGST %s, IGST %s, CESS %s)", "code", "description", "cgst", "sgst", "igst", "cess"))
    return made.groupBy("id").agg(F.min(F.struct("file", "row_no", "code", "description", "text")).alias("m")).select("id", "m.code", "m.description", "m.text")


def read_questions(spark: SparkSession, path: str, least: int = 5) -> DataFrame:
    """file, row_no, row_id, question, answer, skipped: Q&A sheets with columns ID and Query. Rows without a question of `least` characters stay,
    marked as skipped, so that they can be counted (see counted)."""
    rows = read_sheet(spark, path, ["ID", "Query"]).select("file", "row_no", cell("ID").alias("row_id"), question_answer(cell("Query")).alias("qa"))
    question = without_number(F.col("qa.question"))
    return rows.select("file", "row_no", "row_id", question.alias("question"), F.col("qa.answer").alias("answer"), (F.length(strip(question)) < least).alias("skipped"))


def counted(rows: DataFrame, skipped: Column) -> tuple[DataFrame, Observation]:
    """The rows that aren't skipped, and an observation of how many were loaded and skipped: it is filled by the first action on them."""
    seen = Observation()
    return rows.observe(seen, F.count_if(~skipped).alias("loaded"), F.count_if(skipped).alias("skipped")).where(~skipped), seen


def read_word(spark: SparkSession, path: str) -> DataFrame:
    """file, kind ('paragraph' or 'header'), pos, text: non-blank paragraphs in order, and the cells of each table's first row."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text_of = lambda node: "".join(t.text or "" for t in node.iter(f"{WORD_XML}t")).strip()
        for frame in frames:
            out = []
            for path_, content in zip(frame.path, frame.content, strict=True):
                body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(bytes(content))).read("word/document.xml")).find(f"{WORD_XML}body")
                out += [(path_, "paragraph", i, t) for i, t in enumerate(t for t in map(text_of, body.findall(f"{WORD_XML}p")) if t)]
                for k, row in enumerate(t.find(f"{WORD_XML}tr") for t in body.iter(f"{WORD_XML}tbl")):
                    out += [(path_, "header", 1000 * k + i, text_of(c)) for i, c in enumerate(row.findall(f"{WORD_XML}tc")) if text_of(c)]
            yield pd.DataFrame(out, columns=["file", "kind", "pos", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(parse, "file string, kind string, pos int, text string")


def read_pages(spark: SparkSession, path: str, reader) -> DataFrame:
    """file, category, page, text of binary documents. reader(bytes) -> list of page texts is the place for a PDF or OCR library; the category is the
    name of the folder two levels up, as in root/category/year/file."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(p, re.split("/", p)[-3] if p.count("/") > 2 else "", k, t) for p, c in zip(frame.path, frame.content, strict=True) for k, t in enumerate(reader(bytes(c)))], columns=["file", "category", "page", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(parse, "file string, category string, page int, text string")


def read_tables(spark: SparkSession, path: str, reader) -> DataFrame:
    """file, page, table_no, row_no, cells: rows of the tables on the pages of binary documents. reader(bytes) -> for each page a list of tables, each a list of rows of cells, is the
    place for a PDF library; a cell that it leaves out is null, tables without rows don't count, and white space in cells is squeezed."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path_, content in zip(frame.path, frame.content, strict=True):
                out = []
                for page, tables in enumerate(reader(bytes(content)), 1):
                    for number, table in enumerate(t for t in tables if t):
                        out += [(path_, page, number, k, [None if c is None else " ".join(str(c).split()) for c in row]) for k, row in enumerate(table)]
                yield pd.DataFrame(out, columns=["file", "page", "table_no", "row_no", "cells"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(parse, "file string, page int, table_no int, row_no int, cells array<string>")


def read_json_corpus(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A JSON array of chunks; rows need an id and a text. Write it as Parquet once and read that."""
    reader = spark.read.option("multiLine", True)
    rows = (reader.schema(schema) if schema else reader).json(path)
    return rows.where(F.col("id").isNotNull() & F.col("text").isNotNull())


def read_html(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", plain_html(F.col("html")))


#: Columns that say where in its file a row stands.
PLACE = ("file", "row_no", "pos")


def _placed(rows: DataFrame) -> list[Column]:
    """Order of rows: by their place in their file where they have one, then by all that they hold."""
    return [F.col(c) for c in PLACE if c in rows.columns] + [F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in sorted(rows.columns)])]


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All sources in order, columns that one lacks as nulls; of equal ids the first row stays, by source and place in its file."""
    rows = [f.withColumn("__source", F.lit(k)) for k, f in enumerate(frames)]
    out = rows[0]
    for f in rows[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    order = Window.partitionBy("id").orderBy("__source", *_placed(out.drop("__source")))
    return out.where(F.col("id").isNotNull() & F.col("text").isNotNull()).withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k", "__source")


def append_new(rows: DataFrame, path: str) -> None:
    """Appends the rows whose id the table doesn't have yet, so running twice changes nothing; of equal ids the first by place in its file."""
    spark = rows.sparkSession
    first = F.row_number().over(Window.partitionBy("id").orderBy(*_placed(rows)))
    rows = rows.withColumn("__k", first).where("__k = 1").drop("__k")
    try:
        have = spark.read.parquet(path).select("id")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows.write.parquet(path)
        return
    rows.join(have, "id", "left_anti").write.mode("append").parquet(path)


def write_corpus(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Replaces what is there: Parquet to read again, or JSON lines to pass on. Rows need an id and a text."""
    rows.where(F.col("id").isNotNull() & F.col("text").isNotNull()).write.mode("overwrite").format(form).save(path)


def write_vectors(rows: DataFrame, path: str) -> None:
    """rows: pos, vector. An index as Parquet in ranges of positions, so that a reader of some positions skips the other files."""
    rows.select("pos", F.col("vector").cast("array<float>").alias("vector")).repartitionByRange("pos").sortWithinPartitions("pos").write.mode("overwrite").parquet(path)


def changed(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A table after inserts, updates and deletes. changes: the table's columns, op ('upsert' or 'delete') and place, their order; the last change of a
    key counts. One shuffle of both by key; written to a new folder, the result takes the old one's place."""
    columns = [c for c in rows.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct("op", *columns), "place").alias("m"))
    both = rows.join(last, key, "full_outer").where("m is null or m.op <> 'delete'")
    return both.select(key, *[F.when(F.col("m").isNull(), rows[c]).otherwise(F.col(f"m.{c}")).alias(c) for c in columns]).select(*rows.columns)
