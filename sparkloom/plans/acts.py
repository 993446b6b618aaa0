"""Statutes from documents' own lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.functions import text as T
from sparkloom.operators import ingested, statutes
from sparkloom.plans.texts import STOP, _terms
from sparkloom.sources.tables import table

#: How lines of the test data stand for those of an act: by their first words.
LINES = statutes.Rules(chapter="^[DR]", section=(r"^(T\w+) ([^ ]+)", r"^(S\w+) ([^ ]+)"), subsection=r"^([AE]\w+)", clause="^[IO]", definition=r"^(E\w*) (\w+)", notified=r"^L\w+ (.*)", dropped="^[HN]", terms="The", first_chapter="none")


def statute_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = statutes.lines_of(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    found = statutes.chunks(lines, "doc_id", LINES)
    return found.withColumn("text", F.sha2("text", 256))


#: Lines of the test data that begin and end a part, and those that stand for a signature; words that stand for decisions, and headings of items.
PARTS, REPLACED, VERBS, HEADING = ("^[TI]", "^[OL]", "^Q"), ((" the ", " THE "), ("ion ", "ion-")), ("that the", "idiot"), r"\bOf ([a-z]+)"
PAGE = 700


def operative_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = statutes.lines_of(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    found = ingested.operative_parts(lines, "doc_id", PARTS, replaced=REPLACED)
    return found.select("doc_id", "first_pos", "lines", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


def agenda_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as minutes, in pages of some hundred characters."""
    pages = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.slices(F.col("text"), PAGE)).alias("page", "text"))
    found = ingested.agenda_items(pages, "doc_id", _terms, HEADING, VERBS)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
    return found.select("doc_id", "item_no", "agenda_item", F.sha2("text", 256).alias("text_sha256"), joined("pages").alias("pages"), F.size("decisions").alias("decisions"), F.sha2("summary", 256).alias("summary_sha256"), joined("keywords").alias("keywords"))


QUERIES = {"statute_chunks": statute_chunks, "operative_parts": operative_parts, "agenda_items": agenda_items}

_SO_FAR = "OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"
ORACLES = {
    "operative_parts": rf"""WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
l AS (SELECT doc_id, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM r),
k AS (SELECT *, CASE WHEN regexp_matches(line, '^[OL]') THEN 0 WHEN regexp_matches(line, '^[TI]') THEN 1 END AS begins, min(CASE WHEN line LIKE 'Q%' THEN pos END) OVER (PARTITION BY doc_id) AS done FROM l WHERE line <> ''),
m AS (SELECT *, max(CASE WHEN begins IS NOT NULL THEN pos * 2 + begins END) {_SO_FAR} AS hd FROM k),
j AS (SELECT doc_id, hd // 2 AS first_pos, count(*) AS lines, string_agg(line, ' ' ORDER BY pos) AS x FROM m WHERE hd % 2 = 1 AND (done IS NULL OR pos < done) GROUP BY 1, 2),
t AS (SELECT doc_id, first_pos, lines, regexp_replace(regexp_replace(replace(replace(x, ' the ', ' THE '), 'ion ', 'ion-'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM j)
SELECT doc_id, CAST(first_pos AS INTEGER) AS first_pos, lines, CAST(length(text) AS INTEGER) AS chars, sha256(text) AS text_sha256 FROM t WHERE length(text) >= 120""",
    "agenda_items": rf"""WITH g AS (SELECT doc_id, text, unnest(range((length(text) + {PAGE - 1}) // {PAGE})) AS i FROM documents),
x AS (SELECT doc_id, string_agg(chr(10) || '[PAGE_' || i || ']' || chr(10) || substr(text, CAST(i * {PAGE} + 1 AS INTEGER), {PAGE}), '' ORDER BY i) AS x FROM g GROUP BY 1),
d AS (SELECT doc_id, regexp_extract_all(x, '\bOf ([a-z]+)', 1) AS ns, string_split(regexp_replace(x, '\bOf [a-z]+', chr(1), 'g'), chr(1)) AS bs FROM x),
s AS (SELECT doc_id, unnest(ns) AS n, unnest(bs[2:]) AS b, unnest(range(len(ns))) AS item_no FROM d),
t AS (SELECT doc_id, item_no, n, regexp_replace(regexp_replace(b, '\[PAGE_\d+\]', '', 'g'), '^\s+|\s+$', '', 'g') AS text, list_sort(list_distinct(list_transform(regexp_extract_all(b, '\[PAGE_(\d+)\]', 1), lambda p: CAST(p AS INTEGER)))) AS pages FROM s),
e AS (SELECT *, list_filter(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''), lambda s: contains(lower(s), 'that the') OR contains(lower(s), 'idiot')) AS kept,
 list_filter(regexp_extract_all(lower(text), '[\w\x{{c0}}-\x{{24f}}]{{2,}}'), lambda w: w NOT IN ({", ".join(f"'{w}'" for w in STOP)})) AS w FROM t),
u AS (SELECT doc_id, item_no, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM e),
c AS (SELECT doc_id, item_no, term, count(*) AS times FROM u GROUP BY 1, 2, 3),
k AS (SELECT doc_id, item_no, string_agg(term, '|' ORDER BY times DESC, term) AS keywords FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, item_no ORDER BY times DESC, term) <= 10) GROUP BY 1, 2)
SELECT doc_id, CAST(item_no AS INTEGER) AS item_no, n AS agenda_item, sha256(text) AS text_sha256, array_to_string(pages, '|') AS pages, CAST(len(kept) AS INTEGER) AS decisions,
 sha256(coalesce(kept[1], 'Agenda Item ' || n || ' discussion.')) AS summary_sha256, coalesce(keywords, '') AS keywords FROM e LEFT JOIN k USING (doc_id, item_no)""",
    "statute_chunks": rf"""WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
l AS (SELECT doc_id, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM r),
k AS (SELECT *, CASE WHEN line ~ '^[DR].*' THEN 'chapter' WHEN regexp_matches(line, '^L\w+ ') THEN 'notified' WHEN regexp_matches(line, '^[TS]\w+ [^ ]+') THEN 'section' WHEN regexp_matches(line, '^[HN]') THEN 'dropped' ELSE 'text' END AS kind FROM l WHERE line <> ''),
c AS (SELECT *, last_value(CASE WHEN kind = 'chapter' THEN line END IGNORE NULLS) {_SO_FAR} AS chapter, max(CASE WHEN kind = 'notified' THEN pos END) {_SO_FAR} AS dated, max(CASE WHEN kind = 'section' THEN pos END) {_SO_FAR} AS head FROM k),
f AS (SELECT doc_id, pos AS head, regexp_extract(line, '^([TS]\w+) ([^ ]+)', 1) AS number, regexp_extract(line, '^([TS]\w+) ([^ ]+)', 2) AS title, coalesce(chapter, 'none') AS chapter, dated FROM c WHERE kind = 'section'
 QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY pos) = 1),
h AS (SELECT f.*, CASE WHEN dated > coalesce(lag(head) OVER (PARTITION BY f.doc_id ORDER BY head), -1) THEN regexp_replace(substr(n.line, strpos(n.line, ' ') + 1), '^\s+|\s+$', '', 'g') END AS notified FROM f LEFT JOIN l n ON n.doc_id = f.doc_id AND n.pos = f.dated),
t AS (SELECT c.doc_id, c.pos, c.line, c.head, CASE WHEN regexp_matches(c.line, '^[AE]\w+') THEN c.pos END AS sub FROM c WHERE kind = 'text' AND head IS NOT NULL),
s AS (SELECT *, coalesce(max(sub) OVER (PARTITION BY doc_id, head ORDER BY pos ROWS UNBOUNDED PRECEDING), -1) AS start FROM t),
b AS (SELECT doc_id, head, start, min(pos) AS first_pos, arg_min(line, pos) AS first, count(*) FILTER (WHERE regexp_matches(line, '^[IO]')) AS clauses, string_agg(line, chr(10) ORDER BY pos) AS text FROM s GROUP BY 1, 2, 3),
j AS (SELECT b.*, number, title, chapter, notified, number = 'The' AND start >= 0 AND regexp_matches(first, '^E\w* \w+') AS defines FROM b JOIN h USING (doc_id, head))
SELECT doc_id, number AS section_number, title AS section_title, chapter, notified AS notified_date, CASE WHEN start >= 0 THEN regexp_extract(first, '^([AE]\w+)', 1) END AS subsection,
 CASE WHEN coalesce(lead(defines) OVER (PARTITION BY doc_id, head ORDER BY start), number = 'The') THEN 'definition' ELSE 'operative' END AS chunk_type,
 CASE WHEN defines THEN lower(regexp_extract(first, '^(E\w*) (\w+)', 2)) END AS definition_term, clauses, CAST(first_pos AS INTEGER) AS first_pos, sha256(text) AS text FROM j""",
}
