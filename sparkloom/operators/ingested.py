"""Records of documents with their structure: operative parts of circulars and notifications, agenda items of minutes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.functions import text as T
from sparkloom.operators.statutes import BLOCK, hierarchy

#: Lines that begin an operative part, that end one, and the signature after which nothing counts; characters of a part.
CIRCULAR = (r"(?i)(it\s+is\s+hereby\s+clarified\s+that|it\s+is\s+clarified\s+that|in\s+view\s+of\s+the\s+above)", r"(?i)^\s*\d+\.\s*Is\s+", r"(?i)(yours\s+faithfully|sd/|-sd-)")
NOTIFICATION = (r"(?i)(hereby\s+notifies|hereby\s+exempts|hereby\s+specifies|hereby\s+amends)", None, r"(?i)(yours\s+faithfully|by\s+order|sd/|-sd-)")
LEAST = 120


def operative_parts(lines: DataFrame, key: str, rules: tuple[str, str | None, str], least: int = LEAST, replaced: tuple[tuple[str, str], ...] = (), block: int = BLOCK) -> DataFrame:
    """key, first_pos, lines, text: each part from a line that begins one up to the next such line, a line that ends it or the signature, its lines joined by blanks, literal
    replacements made in order and white space squeezed; parts under `least` characters go. lines: key, pos, line (statutes.lines_of).

    What a line belongs to is found by the scan over blocks of lines that finds headers, so a long document is many tasks."""
    begin, end, signature = rules
    line = F.col("line")
    over = lines.where(line.rlike(signature)).groupBy(key).agg(F.min("pos").alias("__over"))
    ends = F.lit(False) if end is None else line.rlike(end)
    marked = lines.withColumn("label", F.when(ends, "off").when(line.rlike(begin), "on")).withColumn("level", F.when(F.col("label").isNotNull(), 0))
    rows = hierarchy(marked, key, 1, block).withColumn("part", F.get("path", F.lit(0)))
    rows = rows.where("part.label = 'on'").join(over, key, "left").where(F.col("__over").isNull() | (F.col("pos") < F.col("__over")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ")
    for a, b in replaced:
        joined = F.replace(joined, F.lit(a), F.lit(b))
    parts = rows.groupBy(key, F.col("part.pos").alias("first_pos")).agg(F.count("*").alias("lines"), T.squeeze(joined).alias("text"))
    return parts.where(F.length("text") >= least)


#: How minutes head their items, and how they refer.
AGENDA = r"Agenda Item\s+(\d+)"
REFERENCES = {"sections": r"Section\s+(\d+[A-Za-z\(\)]*)", "rules": r"Rule\s+(\d+[A-Za-z\(\)]*)", "notifications": r"Notification\s+No\.?\s*([\d\/-]+)"}


def agenda_items(pages: DataFrame, key: str, terms: Callable[[Column], Column], heading: str = AGENDA, decides: tuple[str, ...] = T.DECIDES, top: int = 10) -> DataFrame:
    """key, item_no, agenda_item, text, pages, decisions, summary, keywords and references: what follows each heading up to the next one, across pages. pages: key, page, text;
    heading: a pattern with the item's number as its group. The pages of an item are those that begin in it."""
    told = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: F.concat(F.lit("\n[PAGE_"), p["page"].cast("string"), F.lit("]\n"), F.coalesce(p["text"], F.lit(""))))
    whole = pages.groupBy(key).agg(F.array_join(told, "").alias("x"))
    found, bodies = F.regexp_extract_all("x", F.lit(heading), F.lit(1)), F.split("x", heading, -1)
    items = whole.select(key, F.posexplode(F.zip_with(found, F.slice(bodies, 2, F.size(found)), lambda n, b: F.struct(n.alias("n"), b.alias("b")))).alias("item_no", "s"))
    mark = r"\[PAGE_(\d+)\]"
    rows = items.select(key, "item_no", F.col("s.n").alias("agenda_item"), T.strip(F.regexp_replace("s.b", mark, "")).alias("text"), F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("s.b", F.lit(mark), F.lit(1)), lambda p: p.cast("int")))).alias("pages"))
    text = F.col("text")
    rows = rows.withColumn("decisions", F.transform(T.decision_sentences(text, decides), T.strip))
    references = [F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(1)))).alias(name) for name, p in REFERENCES.items()]
    summary = F.coalesce(F.get("decisions", F.lit(0)), F.concat(F.lit("Agenda Item "), "agenda_item", F.lit(" discussion.")))
    return rows.select("*", summary.alias("summary"), F.transform(T.most_frequent(terms(text), top), lambda k: k["term"]).alias("keywords"), *references)
