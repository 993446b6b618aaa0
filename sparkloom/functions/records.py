"""Rules that cut documents into records and put records into words, as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparkloom.functions.text import squeeze, strip

#: Typographic signs and what stands for them, in order.
SIGNS = [("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), (" ", " "), ("…", "...")]


def plain_signs(x: Column, table: list[tuple[str, str]] = SIGNS) -> Column:
    """Signs replaced one after the other, then white space squeezed."""
    for sign, by in table:
        x = F.replace(x, F.lit(sign), F.lit(by))
    return squeeze(x)


def segments(x: Column, header: str) -> Column:
    """The parts of a text that begin with a header, each up to the next one; what stands before the first is no part."""
    return F.regexp_extract_all(x, F.lit(rf"(?s)(?:{header}).*?(?=(?:{header})|\z)"), F.lit(0))


def delimited(x: Column, delimiter: str) -> Column:
    """array<struct<delimiter, body>>: each delimiter with what follows it up to the next."""
    found, parts = F.regexp_extract_all(x, F.lit(delimiter), F.lit(0)), F.split(x, delimiter, -1)
    return F.zip_with(found, F.slice(parts, 2, F.size(found)), lambda d, b: F.struct(strip(d).alias("delimiter"), strip(b).alias("body")))


def problem_solution(x: Column) -> dict[str, Column]:
    """What stands before the first 'Solution:', and what stands between it and the next one."""
    parts = F.split(x, r"(?i)solution\s*:", -1)
    return {"problem": strip(F.get(parts, F.lit(0))), "solution": strip(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))}


def numbered_title(x: Column, word: str, number: str | None = None) -> dict[str, Column]:
    """'Rule 12 - Name of it': the number (else `number`) and the title behind the dash (else 'Untitled'), blanks squeezed."""
    pattern = rf"(?i){word}\s+(\d+[A-Za-z]*)\s*[-–:.]\s*([^\n]+)"
    return {"number": F.coalesce(F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")), F.lit(number).cast("string")), "title": F.coalesce(F.nullif(squeeze(F.regexp_extract(x, pattern, 2)), F.lit("")), F.lit("Untitled"))}


def meeting(x: Column) -> dict[str, Column]:
    """The first ordinal before 'Meeting' and the first date of day, month's name and year; else UNKNOWN."""
    of = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")), F.lit("UNKNOWN"))
    return {"meeting_no": of(r"(?i)(\d+)(?:st|nd|rd|th)\s+(?:[a-z]+\s+)*?meeting"), "held_on": of(r"(\d{1,2}\s+[A-Za-z]+,?\s+\d{4})")}


def definitions(x: Column) -> Column:
    """Terms in curly quotes that 'means' follows, in lower case."""
    return F.transform(F.regexp_extract_all(x, F.lit("“([^”]+)”\\s+means"), F.lit(1)), lambda t: F.lower(strip(t)))


def statute_header(x: Column, word: str = "Section") -> dict[str, Column]:
    """'Section 16A. Title.' at the start of a text: number and title."""
    pattern = rf"^\s*{word}\s+(\d+[A-Z]*)\.\s*([^.\n]+)"
    return {"number": F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")), "title": F.nullif(squeeze(F.regexp_extract(x, pattern, 2)), F.lit(""))}


def document_header(x: Column) -> dict[str, Column]:
    """Number, date and subject that a document's head names, wherever they stand."""
    of = lambda pattern: F.nullif(strip(F.regexp_extract(x, pattern, 1)), F.lit(""))
    return {"number": of(r"(?i)\bno\.?\s*([0-9]+/[0-9]+(?:/[0-9]{4})?)"), "dated": of(r"(?i)\bdated?\s*:?\s*(\d{1,2}[./-]\d{1,2}[./-]\d{4})"), "subject": of(r"(?i)\bsubject\s*:\s*([^\n]+)")}


def salvaged_json(x: Column, schema: str) -> Column:
    """What stands from the first brace to the last one, code fences or not, parsed; null where that is no JSON."""
    return F.from_json(F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit("")), schema)


def undated(citation: Column) -> Column:
    """A citation without 'dated ...' and what follows."""
    return strip(F.regexp_replace(citation, r"(?is)\s*\bdated\b.*$", ""))


def citation_line(citation: Column, case_number: Column, score: Column) -> Column:
    """A found judgment as a line below an answer: citation, case number without its date, score with two places."""
    case = F.regexp_replace(F.coalesce(case_number, F.lit("")), r"\s+dated.*$", "")
    return F.concat(F.lit("- "), F.coalesce(citation, F.lit("")), F.when(case != "", F.concat(F.lit(" ("), case, F.lit(")"))).otherwise(""), F.lit(" [Score: "), F.format_string("%.2f", score), F.lit("]"))


def pages_text(pages: Column) -> Column:
    """Pages with their numbers in front, a blank line between."""
    return F.array_join(F.transform(pages, lambda p, i: F.concat(F.lit("[PAGE "), (i + 1).cast("string"), F.lit("]\n"), p)), "\n\n")


def analysis_text(fields: dict[str, Column], issues: Column) -> Column:
    """The fields that are not blank, as 'Name: value', and the issues by number, a blank line between."""
    said = [F.when(F.length(strip(c)) > 0, F.concat(F.lit(f"{name}: "), strip(c))) for name, c in fields.items()]
    listed = F.array_join(F.transform(issues, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return F.concat_ws("\n\n", *said, F.when(F.size(issues) > 0, F.concat(F.lit("Issues:\n"), listed)))


def capped_keywords(words: Column, most: int = 10) -> Column:
    """The first `most` words that differ but for case, as first written."""
    start = F.array().cast("array<string>")
    kept = F.aggregate(words, start, lambda acc, w: F.when(F.exists(acc, lambda k: F.lower(k) == F.lower(w)) | (F.size(acc) >= most), acc).otherwise(F.concat(acc, F.array(w))))
    return kept


def length_ratio_fits(a: Column, b: Column, low: float = 0.7, high: float = 1.3) -> Column:
    return (F.length(b) > 0) & (F.length(a) / F.length(b)).between(low, high)


#: Labels of chunks in prompts by kind of document; what stands for a missing number or title.
UNKNOWN, UNTITLED, CONTENT = "UNKNOWN", "Untitled", "Content"


#: What stands where a record has no problem or no solution.
NO_PROBLEM, NO_SOLUTION = "No problem description provided.", "No solution provided."


def source_block(c: dict[str, Column]) -> Column:
    """A chunk in words, a label in front by kind of document. c: complete, doc_type, chunk_type, source, section_number, illustration_number, section_title,
    question_number, section_type, table_index, meeting_number, hsn_code, sac_code, problem, solution, text."""
    or_ = lambda name, other: F.coalesce(c[name].cast("string"), F.lit(other))
    label = lambda *parts: F.concat(F.lit("["), F.concat_ws(" | ", *parts), F.lit("]"))
    said = lambda word, name, other: F.concat(F.lit(word + " "), or_(name, other))
    kind, source, text = c["doc_type"], or_("source", "source"), or_("text", "")
    below, beside = lambda head: F.concat(head, F.lit("\n"), text), lambda head: F.concat(head, F.lit(" "), text)
    solved = F.concat(F.lit("\nPROBLEM: "), or_("problem", NO_PROBLEM), F.lit("\nSOLUTION: "), or_("solution", NO_SOLUTION))
    table_head = label(said("CASE STUDY TABLE", "table_index", ""), source)
    return (
        F.when(F.coalesce(c["complete"], F.lit(False)), text)
        .when(kind == "Case Scenario", F.concat(label(F.lit("CASE SCENARIO"), source, said("Sec", "section_number", UNKNOWN), said("Illus", "illustration_number", UNKNOWN)), solved))
        .when(kind == "Analytical Review", below(label(F.lit("ANALYTICAL REVIEW"), source, said("Sec", "section_number", UNKNOWN), or_("section_title", UNTITLED))))
        .when(kind == "FAQ", below(label(F.lit("FAQ"), source, said("Q", "question_number", UNKNOWN))))
        .when(kind == "Draft Reply", below(label(F.lit("DRAFT REPLY"), source, or_("section_type", CONTENT))))
        .when(kind.isin("Case Study", "Case Study Table") & (F.coalesce(c["table_index"], F.lit(0)) > 0), below(table_head))
        .when(kind.isin("Case Study", "Case Study Table"), below(label(F.lit("CASE STUDY"), source, or_("section_type", CONTENT))))
        .when(c["hsn_code"].isNotNull(), beside(label(said("HSN CODE", "hsn_code", ""), source)))
        .when(c["sac_code"].isNotNull(), beside(label(said("SAC CODE", "sac_code", ""), source)))
        .when((kind == "Council Minutes") | (c["chunk_type"] == "council_decision"), below(label(F.concat(said("GST COUNCIL", "meeting_number", UNKNOWN), F.lit("th MEETING")), source)))
        .otherwise(beside(label(F.upper(or_("chunk_type", "source")), source)))
    )


#: Fixed value: what stands in a prompt where nothing came before.
NO_HISTORY = "No previous context."


def spoken(messages: Column) -> Column:
    """Messages (structs with role and content), a line each."""
    lines = F.transform(messages, lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"]))
    return F.when(F.size(messages) > 0, F.array_join(lines, "\n")).otherwise(NO_HISTORY)


def prompt(question: Column, primary: Column, supporting: Column, document: Column | None = None, history: Column | None = None) -> Column:
    """The question with what was found, the best first; what was said before and a document of the user's in front of it."""
    parts = [] if history is None else [F.concat(F.lit("HISTORY:\n"), spoken(history))]
    parts.append(F.concat(F.lit("QUESTION:\n"), question))
    if document is not None:
        parts.append(F.when(F.length(strip(document)) > 0, F.concat(F.lit("DOCUMENT:\n"), document)))
    return F.concat_ws("\n\n", *parts, F.concat(F.lit("PRIMARY:\n"), F.array_join(primary, "\n\n")), F.concat(F.lit("SUPPORTING:\n"), F.array_join(supporting, "\n\n")))


#: How forms and registers, their titles and the rules that they belong to are written.
FORM, REGISTER, FORM_TITLE, FORM_RULE = r"(?i)GSTAT\s*FORM[-\s]*(\d+)", r"(?i)GSTAT[-\s]*CDR[-\s]*(\d+)", r"–\s*(.*?)\n", r"(?i)\[See\s*rule\s*([\d\(\)a-zA-Z]+)\]"


def form_kind(x: Column) -> dict[str, Column]:
    """Form or register by the first number that a text names, its title behind a dash and the rule in brackets; else Other, UNKNOWN and Untitled."""
    of = lambda pattern: F.nullif(strip(F.regexp_extract(x, pattern, 1)), F.lit(""))
    form, register = of(FORM), of(REGISTER)
    return {
        "doc_type": F.when(form.isNotNull(), "Form").when(register.isNotNull(), "Register").otherwise("Other"), "number": F.coalesce(form, register, F.lit(UNKNOWN)),
        "title": F.coalesce(of(FORM_TITLE), F.lit(UNTITLED)), "related_rule": of(FORM_RULE),
    }
