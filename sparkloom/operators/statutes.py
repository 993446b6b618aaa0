"""Texts with levels: chapters, sections, subsections and clauses over lines, and the chunks of a statute with their paths.

What a line stands under is the last header of each level before it that no header of a higher level has cut off. 'The last before' is a
running maximum of (place, label), which can be put together from parts: lines are dealt in blocks, each block tells its own last headers, these are
run over the blocks, and every block goes on from what it is told. So a long text spans many tasks, and no list is carried from line to line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.functions.text import strip

#: Lines of a block.
BLOCK = 4_096
#: White space as text.strip takes it; trimming by a set of characters looks at a line's ends alone.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line: the lines of a text that aren't blank, without white space at their ends. Lines are stripped before they are dealt out, so that each is once: as
    an expression of a row it would be made again in every condition that is pushed down to it."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)))
    return docs.select(key, F.posexplode(lines).alias("pos", "line")).where("line <> ''")


def running(lines: DataFrame, key: str, marks: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """lines (key, pos) with, under each name of marks (structs that begin with pos, null where a line has none), the last one so far.

    All are run in one pass over the lines. What blocks tell goes only to blocks of a document that come after the first mark's."""
    rows = lines.withColumns({f"__{m}": c for m, c in marks.items()}).withColumn("__block", F.expr(f"pos div {block}L"))
    told = rows.groupBy(key, "__block").agg(*[F.max(f"__{m}").alias(f"__{m}") for m in marks])
    before = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    told = told.select(key, "__block", *[F.max(f"__{m}").over(before).alias(f"__in_{m}") for m in marks]).where(F.coalesce(*[F.col(f"__in_{m}.pos") for m in marks]).isNotNull())
    inside = Window.partitionBy(key, "__block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(told, [key, "__block"], "left").withColumns({f"__{m}": F.max(f"__{m}").over(inside) for m in marks})
    return rows.select(*lines.columns, *[F.coalesce(f"__{m}", f"__in_{m}").alias(m) for m in marks])


def hierarchy(lines: DataFrame, key: str, levels: int, block: int = BLOCK) -> DataFrame:
    """lines (key, pos, level: 0 to levels - 1 or null, label) with path: for each level the struct<pos, label> of the header that the line stands under or is,
    null where there is none."""
    of = lambda k: F.when(F.col("level") == k, F.struct(F.col("pos").alias("pos"), F.col("label").alias("label")))
    last = [F.col(f"__last{k}") for k in range(levels)]
    path = [F.when(last[k]["pos"] > F.greatest(F.lit(-1), F.lit(-1), *[last[j]["pos"] for j in range(k)]), last[k]) for k in range(levels)]
    return running(lines, key, {f"__last{k}": of(k) for k in range(levels)}, block).withColumn("path", F.array(*path)).select(*lines.columns, "path")


@dataclass(frozen=True)
class Rules:
    """Patterns of a statute's lines. section: patterns whose groups are number and title; subsection: its label; definition: label and term, in section
    `terms` alone; notified: a date that the next section has; dropped: footnotes that are no text."""

    chapter: str
    section: tuple[str, ...]
    subsection: str
    clause: str
    definition: str
    notified: str
    dropped: str
    terms: str = "2"
    first_chapter: str = "PRELIMINARY"


#: How an act's lines look.
ACT = Rules(
    chapter=r"(?i)^CHAPTER\s+[IVXLC]+", section=(r"^Section\s+(\d{1,3}[A-Z]?)\.\s+(.+?)[–-]", r"^(\d{1,3}[A-Z])\.\s+(.+?)[–-]"), subsection=r"^\((\d+[A-Z]?)\)", clause=r"^\(([a-z]+)\)",
    definition=r"(?i)^\((\d+)\)\s*“([^”]+)”\s*means", notified=r"(?i)Notified date of Section:\s*(.*)", dropped=r"(?i)^\[\d+\]|\bInserted by\b|\bSubstituted by\b|\bOmitted by\b",
)


def chunks(lines: DataFrame, key: str, rules: Rules = ACT, block: int = BLOCK) -> DataFrame:
    """key, section_number, section_title, chapter, notified_date, subsection, chunk_type, definition_term, clauses, first_pos, text: a section's text up to its first
    subsection, and each subsection (in the section of terms, each definition).

    A line is the first of these that fits: chapter, notified date, section, footnote, text. Of sections with one number the first
    counts; the lines of the others are left out. A chunk that a definition ends is a definition, one that a subsection ends is operative, and a
    section's last one is what the section is."""
    line = F.col("line")
    header = F.coalesce(*[F.when(line.rlike(p), F.struct(F.regexp_extract(line, p, 1).alias("number"), strip(F.regexp_extract(line, p, 2)).alias("title"))) for p in rules.section])
    kind = F.when(line.rlike(rules.chapter), "chapter").when(line.rlike(rules.notified), "notified").when(header.isNotNull(), "section").when(line.rlike(rules.dropped), "dropped").otherwise("text")
    rows = lines.where(F.col(key).isNotNull()).withColumn("kind", kind).where("kind <> 'dropped'")
    text, section = F.col("kind") == "text", F.col("kind") == "section"
    mark = lambda where, label: F.when(where, F.struct(F.col("pos").alias("pos"), label.alias("label")))
    marks = {
        "chapter": mark(F.col("kind") == "chapter", line), "date": mark(F.col("kind") == "notified", strip(F.regexp_extract(line, rules.notified, 1))), "head": mark(section, header),
        "sub": mark(text & line.rlike(rules.subsection), F.regexp_extract(line, rules.subsection, 1)),
    }
    # each is the last one of its kind, whatever stands above it; a subsection ends with its section
    under = running(rows, key, marks, block).where((text | section) & F.col("head").isNotNull())
    start = F.when(F.col("sub.pos") > F.col("head.pos"), F.col("sub.pos")).otherwise(-1)
    under = under.select(key, "pos", "line", F.col("head.pos").alias("at"), start.alias("start"), text.alias("is_text"), F.col("sub.label").alias("label"), F.when(section, F.struct("head.label.number", "head.label.title", "chapter", "date")).alias("h"))
    # a section's own line stands with its text up to the first subsection and tells what the section is
    place = F.when(F.col("is_text"), F.col("pos"))
    body = under.groupBy(key, "at", "start").agg(
        F.max("h").alias("h"), F.max(F.when(F.col("start") >= 0, F.col("label"))).alias("subsection"), F.min(place).alias("first_pos"), F.min_by("line", place).alias("first"),
        F.count_if(F.col("is_text") & F.col("line").rlike(rules.clause)).alias("clauses"),
        strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_text"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")).alias("text"),
    )
    body = body.repartition(key)  # once for all windows below
    inside = Window.partitionBy(key, "at").orderBy("start")
    rows = body.withColumn("h", F.first("h").over(inside)).withColumn("number", F.col("h.number"))
    defines = (F.col("number") == rules.terms) & (F.col("start") >= 0) & F.col("first").rlike(rules.definition)
    rows = rows.withColumn("defines", defines).withColumn("following", F.lead("defines").over(inside))
    rows = rows.withColumn("first_at", F.min("at").over(Window.partitionBy(key, "number"))).where("at = first_at")
    before = F.max("at").over(Window.partitionBy(key).orderBy("at").rangeBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before).where("first_pos is not null").select(
        "*", F.col("h.title").alias("title"), F.coalesce("h.chapter.label", F.lit(rules.first_chapter)).alias("chapter"), F.when(F.col("h.date.pos") > F.coalesce("before", F.lit(-1)), F.col("h.date.label")).alias("notified")
    )
    said = F.when(F.coalesce("following", F.col("number") == rules.terms), "definition").otherwise("operative")
    term = F.when(F.col("defines"), F.lower(F.regexp_extract("first", rules.definition, 2)))
    return rows.select(
        key, F.col("number").alias("section_number"), F.col("title").alias("section_title"), "chapter", F.col("notified").alias("notified_date"), "subsection", said.alias("chunk_type"),
        term.alias("definition_term"), "clauses", "first_pos", "text",
    )

