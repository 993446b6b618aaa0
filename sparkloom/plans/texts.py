"""Chunking, cleaning and extraction over documents, pages and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparkloom.functions import records as R, text as T
from sparkloom.sources.tables import table

#: Words too common to be keywords.
STOP = "a an and are as at be by for from has have he her his in is it its of on or that the this to was were will with not but they you we all can had one our out so than them then there these which who would".split()
TOP_WORDS = 6


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), T.strip), lambda p: p != "")


def merge_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of three sources in order; rows without text go; of equal ids (digests of the text) the first stays."""
    docs = table(spark, sf_dir, "documents").select(F.lit(0).alias("source_no"), F.col("doc_id").alias("pos"), "text")
    marks = table(spark, sf_dir, "benchmark").select(F.lit(1).alias("source_no"), F.col("item_id").alias("pos"), "text")
    pages = table(spark, sf_dir, "pages").select(F.lit(2).alias("source_no"), F.col("page_id").alias("pos"), F.col("html").alias("text"))
    rows = docs.unionByName(marks).unionByName(pages).where(F.col("text").isNotNull()).withColumn("id", F.sha2("text", 256))
    # an aggregate over (order, position) keeps the first without sorting whole groups, and only ids move
    return rows.groupBy("id").agg(F.min(F.struct("source_no", "pos")).alias("m"), F.count("*").alias("copies")).select("id", "m.source_no", "m.pos", "copies")


def pack_paragraphs_900(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.packed(paragraphs(F.col("text")), 900).alias("chunks"))
    return rows.select("doc_id", F.posexplode("chunks").alias("chunk_no", "chunk"))


def pack_sections_1100(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.packed(paragraphs(F.col("text")), 1100, compat=True).alias("chunks"))
    return rows.select("doc_id", F.posexplode("chunks").alias("chunk_no", "c")).select("doc_id", "chunk_no", F.length("c").alias("chars"), F.sha2("c", 256).alias("chunk_sha256"))


#: Lines of the test data that stand for the headings of a judgment.
CUE = "[DT]"


def pack_judgments_1100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed like sections, but headings begin a chunk."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.packed(paragraphs(F.col("text")), 1100, compat=True, cue=CUE).alias("chunks"))
    return rows.select("doc_id", F.posexplode("chunks").alias("chunk_no", "c")).select("doc_id", "chunk_no", F.length("c").alias("chars"), F.sha2("c", 256).alias("chunk_sha256"))


def pack_overlap_2000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources stand for questions. A text that fits beside its question and the signs between them is one chunk, as it is."""
    rows = table(spark, sf_dir, "documents")
    question = F.length(F.coalesce("source", F.lit("")))
    chunks = T.packed_overlapping(T.sentences(F.col("text")), F.lit(2000) - question - 10)
    chunks = F.when(question + F.length("text") + F.length(F.lit("Q: \n\nA: ")) <= 2000, F.array("text")).otherwise(chunks)
    return rows.select("doc_id", F.posexplode(chunks).alias("chunk_no", "chunk"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines are headers: each begins a segment that runs to the next."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(spark, sf_dir).withColumn("segment", F.sum(F.when(F.length("line") < 40, 1).otherwise(0)).over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ")
    return rows.groupBy("doc_id", "segment").agg(F.count("*").alias("lines"), joined.alias("text"))


def region_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from the first long one on, up to the first short one after it."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(spark, sf_dir).withColumn("begun", F.max(F.when(F.length("line") > 200, 1).otherwise(0)).over(order))
    rows = rows.withColumn("over", F.max(F.when((F.col("begun") == 1) & (F.length("line") < 20), 1).otherwise(0)).over(order))
    return rows.where("begun = 1 and over = 0").groupBy("doc_id").agg(F.count("*").alias("lines"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with the header above it."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    header = F.last(F.when(F.length("line") < 40, F.col("line")), ignorenulls=True).over(order)
    return lines(spark, sf_dir).select("doc_id", "pos", header.alias("header"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.clean_page(F.col("text")), 256).alias("cleaned_sha256"))


def clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_answer(F.col("text")).alias("cleaned"))


def normalize_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("No. "), "s_name", F.lit(" (Number) of "), F.col("s_nationkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.normalize_citation(made).alias("key"))


def core_case_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("W.P.No. "), F.col("s_suppkey").cast("string"), F.lit(" of 2017 & Ors. dated 12.03.2017 at noon"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.core_case_number(made).alias("key"))


def _company(name: str) -> Column:
    return F.concat(F.lit("M/s. "), name, F.lit(" Trading Co. Pvt. Ltd. & Ors."))


def normalize_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.normalize_party(_company("s_name")).alias("anywhere"), T.normalize_party_ends(_company("s_name")).alias("ends"))


def case_number_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    made = F.concat(F.lit("in W.P.M.P.Nos."), k, F.lit(" & "), (F.col("s_suppkey") + 1).cast("string"), F.lit(" of 2017 and Civil Appeal No. "), k, F.lit(" of 2016"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(T.case_numbers(made), "; ").alias("numbers"))


#: Stated forms of citations, filled with each supplier's number, and a publisher with a short and a long name.
CITED, HOUSE = ["see 2019 (3) SCC {}", "as in 2021 (5) tmi {} and 2019 SCC 1", "2018 TMI{}", "2020 Lex.online {} (HC)", "held in 2020  lex {}, 2017 SCC 4", "2016 SCC {}.", "2015 ( 2 )SCC{} and 2014 SCC 9", "none {}"], ("Lex", "Lex.online")


def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.element_at(F.array(*[F.lit(c) for c in CITED]), (F.col("s_suppkey") % len(CITED) + 1).cast("int"))
    made = F.replace(form, F.lit("{}"), F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.first_citation(made, HOUSE).alias("citation"))


def cross_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("Section "), F.col("p_size").cast("string"), F.lit("(2) and u/s 16, Rule 89A; notification no. 12/2017, HSN Code 9983, sec. 7, Section "), F.col("p_size").cast("string"), F.lit("(2), Form 05"))
    refs = T.references(made)
    return table(spark, sf_dir, "part").select("p_partkey", *[F.array_join(refs[c], ",").alias(c) for c in ("sections", "rules", "notifications", "forms", "hsn_codes", "sac_codes")])


def _terms(text: Column, generic: tuple[str, ...] = ()) -> Column:
    """Words and pairs of words of a text, stop words out before pairing. Generic words alone are no terms, but stay in pairs."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda w: ~w.isin(*STOP))

    def both(w: Column) -> Column:
        less = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, 1, less), F.slice(w, 2, less), lambda a, b: F.concat(a, F.lit(" "), b)))

    terms = T.once(words, both)
    return F.filter(terms, lambda t: ~t.isin(*generic)) if generic else terms


def keywords_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent words and pairs of words, stop words out before pairing; ties by term. Counted inside the row: nothing moves."""
    best = T.most_frequent(_terms(F.col("text")), TOP_WORDS)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(best).alias("k")).select("doc_id", "k.term", "k.times", "k.rank")


#: Terms of the field that come before all other keywords, and words that are too general for one: the test data's.
TERMS, GENERIC = ("Region", "income", "Court", "die", "water level"), ("more", "people", "und")


def document_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field's terms that a text holds, then its most frequent ones; of terms equal but for case the first stays; ten at most. A text of fewer
    than ten characters has none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.length("text") >= 10, F.col("text")).otherwise("").alias("text"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.lower("text"), F.lit(t.lower())), t) for t in TERMS]))
    rows = docs.select("doc_id", held.alias("held"), T.most_frequent(_terms(F.col("text"), GENERIC), TOP_WORDS).alias("ranked"))
    words = R.capped_keywords(F.concat("held", F.transform("ranked", lambda x: x["term"])))
    return rows.select("doc_id", F.array_join(words, "|").alias("keywords"))


def authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circulars and decisions that texts name, behind whole documents."""
    n = F.col("doc_id")
    made = F.concat(F.coalesce("text", F.lit("")), F.lit("\nCircular No. "), (n % 7).cast("string"), F.lit("/2019, Circular no 3, Vs. Union  of "), F.coalesce("source", F.lit("")), F.lit("; Circular No 12-4"))
    found = T.authorities(made)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found["circulars"], "|").alias("circulars"), F.array_join(found["case_laws"], "|").alias("case_laws"))


def rule_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rules: what their first sentence says, else their number and title."""
    n = F.col("doc_id").cast("string")
    x = F.concat(F.lit("Rule "), n, F.lit(". Name –"), F.when(F.col("doc_id") % 4 == 0, F.lit(" Short one. ")).otherwise(""), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", T.rule_summary(n, F.col("lang"), x).alias("summary"))


def first_sentence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("summary"))


def decision_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = T.decision_sentences(F.col("text"), ("that the", "idiot"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(kept).alias("sentences"), F.array_join(kept, "|").alias("kept"))


def qa_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = T.question_answer(F.concat("text", F.lit(" Ans: "), "role", F.lit(" ("), F.col("turn").cast("string"), F.lit(")")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", qa["question"].alias("question"), qa["answer"].alias("answer"))


def qa_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th question of a conversation with its i-th answer."""
    rows = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    nth = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    rows = rows.select("conv_id", "role", "text", nth.alias("i"))
    return rows.groupBy("conv_id", "i").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("question"), F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("answer")).where("question is not null and answer is not null")


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.plain_html(F.col("html")).alias("text"))


def fixed_slices(spark: SparkSession, sf_dir: str, n: int = 200) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.slices(F.col("text"), n)).alias("slice_no", "slice"))


def two_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.halves(F.col("text"), limit=3000, overlap=200, near=150)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("half", "part")).select("doc_id", "half", F.length("part").alias("chars"), F.sha2("part", 256).alias("part_sha256"))


QUERIES = {f.__name__: f for f in (
    merge_keep_first, pack_paragraphs_900, pack_sections_1100, pack_overlap_2000, line_segments, region_collect, carry_forward, clean_text, clean_answers,
    normalize_citation, core_case_number, normalize_party, case_number_expand, citation_extract, cross_refs, keywords_topn, first_sentence_summary,
    decision_sentences, qa_split, qa_pairing, html_to_text, fixed_slices, two_halves,
    pack_judgments_1100, document_keywords, authorities, rule_summaries,
)}


def _pack(most: int, cue: str = "") -> str:
    fits = f"length(f.buf) + length(p.ps[f.i + 1]) + 1 <= {most}" + (f" AND NOT (f.buf <> '' AND regexp_matches(p.ps[f.i + 1], '^(?:{cue})'))" if cue else "")
    return f"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents),
f AS (SELECT doc_id, 0 AS i, '' AS buf, CAST(NULL AS VARCHAR) AS chunk, 0 AS k FROM p
 UNION ALL SELECT f.doc_id, f.i + 1, CASE WHEN f.i >= len(p.ps) THEN '' WHEN {fits} THEN trim(f.buf || ' ' || p.ps[f.i + 1]) ELSE p.ps[f.i + 1] END,
 CASE WHEN f.i >= len(p.ps) THEN nullif(f.buf, '') WHEN {fits} THEN NULL ELSE f.buf END, f.k + 1
 FROM f JOIN p ON p.doc_id = f.doc_id WHERE f.i <= len(p.ps)),
c AS (SELECT doc_id, i, chunk FROM f WHERE chunk IS NOT NULL)"""


_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"
_SUM = "OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({x}, '\s+', ' ', 'g')), '\s+([.,!?;:])', '\1', 'g'), '([.,!?;:])([^\s\d])', '\1 \2', 'g'), '\s*\(\s*', ' (', 'g'), '\s*\)\s*', ') ', 'g'))"
_SENT = r"list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
_WORDS = "list_filter(regexp_extract_all(lower(text), '[\\w\\x{c0}-\\x{24f}]{2,}'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in STOP) + "))"

ORACLES = {
    "merge_keep_first": """WITH u AS (SELECT 0 AS source_no, doc_id AS pos, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark UNION ALL SELECT 2, page_id, html FROM pages),
r AS (SELECT sha256(text) AS id, source_no, pos, row_number() OVER (PARTITION BY sha256(text) ORDER BY source_no, pos) AS k, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM u WHERE text IS NOT NULL)
SELECT id, source_no, pos, copies FROM r WHERE k = 1""",
    "pack_paragraphs_900": _pack(900) + " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_no, chunk FROM c WHERE chunk <> ''",
    "pack_sections_1100": _pack(1100) + " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_no, CAST(length(chunk) AS INTEGER) AS chars, sha256(chunk) AS chunk_sha256 FROM c",
    "pack_overlap_2000": rf"""WITH RECURSIVE p AS (SELECT doc_id, {_SENT} AS ps, 1990 - length(coalesce(source, '')) AS room FROM documents WHERE length(coalesce(source, '')) + length(text) + 8 > 2000),
f AS (SELECT doc_id, 0 AS i, '' AS buf, CAST(NULL AS VARCHAR) AS chunk FROM p
 UNION ALL SELECT doc_id, i + 1, CASE WHEN s IS NULL THEN '' WHEN length(test) <= room THEN test WHEN buf <> '' THEN right(buf, 200) || ' ' || s ELSE '' END,
 regexp_replace(CASE WHEN s IS NULL THEN nullif(buf, '') WHEN length(test) <= room THEN NULL WHEN buf <> '' THEN buf ELSE s END, '^\s+|\s+$', '', 'g')
 FROM (SELECT f.*, p.room, p.ps[f.i + 1] AS s, CASE WHEN f.buf <> '' THEN f.buf || ' ' || p.ps[f.i + 1] ELSE p.ps[f.i + 1] END AS test FROM f JOIN p ON p.doc_id = f.doc_id WHERE f.i <= len(p.ps)))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_no, chunk FROM f WHERE chunk IS NOT NULL
UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(coalesce(source, '')) + length(text) + 8 <= 2000""",
    "pack_judgments_1100": _pack(1100, CUE) + " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_no, CAST(length(chunk) AS INTEGER) AS chars, sha256(chunk) AS chunk_sha256 FROM c",
    "document_keywords": f"""WITH d AS (SELECT doc_id, CASE WHEN length(text) >= 10 THEN text ELSE '' END AS text FROM documents), w AS (SELECT doc_id, {_WORDS} AS w FROM d),
t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
c AS (SELECT doc_id, term, count(*) AS times FROM t WHERE term NOT IN ({", ".join(f"'{g}'" for g in GENERIC)}) GROUP BY 1, 2), r AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, term) AS rank FROM c),
u AS (SELECT doc_id, term, {len(TERMS)} + rank AS rank FROM r WHERE rank <= {TOP_WORDS} UNION ALL SELECT doc_id, term, i FROM d, (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(TERMS))}) v(i, term) WHERE contains(lower(text), lower(term))),
k AS (SELECT doc_id, lower(term) AS l, arg_min(term, rank) AS term, min(rank) AS rank FROM u GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(rank)) <= 10)
SELECT d.doc_id, coalesce(string_agg(term, '|' ORDER BY rank), '') AS keywords FROM d LEFT JOIN k USING (doc_id) GROUP BY 1""",
    "authorities": r"""WITH t AS (SELECT doc_id, coalesce(text, '') || chr(10) || 'Circular No. ' || doc_id % 7 || '/2019, Circular no 3, Vs. Union  of ' || coalesce(source, '') || '; Circular No 12-4' AS x FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(x, 'Circular\s+No\.?\s*([\d/.-]+)', 1))), '|') AS circulars,
 array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(x, 'Vs\.\s*([A-Za-z\s\.]+)', 1), lambda v: trim(regexp_replace(v, '\s+', ' ', 'g'))))), '|') AS case_laws FROM t""",
    "rule_summaries": r"""WITH t AS (SELECT doc_id, lang, regexp_replace(CASE WHEN doc_id % 4 = 0 THEN ' Short one. ' ELSE '' END || coalesce(text, ''), '^\s+|\s+$', '', 'g') AS body FROM documents),
f AS (SELECT *, string_split(regexp_replace(body, '([.!?]) +', '\1' || chr(1), 'g'), chr(1))[1] AS first FROM t)
SELECT doc_id, CASE WHEN length(first) > 30 THEN substr(first, 1, 300) ELSE 'Rule ' || doc_id || ' deals with ' || lang || '.' END AS summary FROM f""",
    "line_segments": f"""SELECT doc_id, segment, count(*) AS lines, string_agg(line, ' ' ORDER BY pos) AS text FROM
 (SELECT *, CAST(sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) {_SUM} AS BIGINT) AS segment FROM {_LINES}) GROUP BY 1, 2""",
    "region_collect": f"""WITH b AS (SELECT *, max(CASE WHEN length(line) > 200 THEN 1 ELSE 0 END) {_SUM} AS begun FROM {_LINES}),
o AS (SELECT *, max(CASE WHEN begun = 1 AND length(line) < 20 THEN 1 ELSE 0 END) {_SUM} AS done FROM b)
SELECT doc_id, count(*) AS lines, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last FROM o WHERE begun = 1 AND done = 0 GROUP BY 1""",
    "carry_forward": f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, last_value(CASE WHEN length(line) < 40 THEN line END IGNORE NULLS) {_SUM} AS header FROM {_LINES}",
    "clean_text": r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(9), ' '), ' {3,}', ' ', 'g'),
 '[ \t\r\f\v]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS cleaned_sha256 FROM documents""",
    "clean_answers": f"SELECT conv_id, turn, {_CLEAN.format(x='text')} AS cleaned FROM conversations",
    "normalize_citation": r"""SELECT s_suppkey, regexp_replace(regexp_replace(lower('No. ' || s_name || ' (Number) of ' || s_nationkey), '\b(no|number|of)\b', '', 'g'), '[^\w]', '', 'g') AS key FROM supplier""",
    "core_case_number": "SELECT s_suppkey, 'wp' || s_suppkey || '2017' AS key FROM supplier",
    "normalize_party": r"""SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name), '[^\w]', ' ', 'g'), '\s+', ' ', 'g')) || ' trading' AS anywhere, lower(s_name) || ' trading' AS ends FROM supplier""",
    "case_number_expand": """SELECT s_suppkey, array_to_string(list_sort(['Civil Appeal No. ' || s_suppkey || ' of 2016', 'W.P.M.P.No. ' || s_suppkey || ' of 2017', 'W.P.M.P.No. ' || (s_suppkey + 1) || ' of 2017']), '; ') AS numbers FROM supplier""",
    "citation_extract": f"""WITH t AS (SELECT s_suppkey, replace([{", ".join(f"'{c}'" for c in CITED)}][s_suppkey % {len(CITED)} + 1], '{{}}', CAST(s_suppkey AS VARCHAR)) AS x FROM supplier),
f AS (SELECT s_suppkey, coalesce({", ".join(f"nullif(regexp_extract(x, '(?i){p}'), '')" for p in (*T.REPORTS, "[0-9]{4}[ ]+Lex[.]online[ ]+[0-9]+", "[0-9]{4}[ ]+Lex[ ]+[0-9]+", *T.COURT_REPORTS))}) AS c FROM t)
SELECT s_suppkey, CASE WHEN regexp_matches(c, '(?i)lex ') THEN regexp_replace(c, '(?i) +lex +', ' Lex.online ') ELSE c END AS citation FROM f""",
    "cross_refs": """SELECT p_partkey, array_to_string(list_sort(list_distinct([p_size || '(2)', '16', '7'])), ',') AS sections, '89A' AS rules, '12/2017' AS notifications, '05' AS forms, '9983' AS hsn_codes, '' AS sac_codes FROM part""",
    "keywords_topn": f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
c AS (SELECT doc_id, term, count(*) AS times FROM t GROUP BY 1, 2)
SELECT doc_id, term, times, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, term) AS rank FROM c) WHERE rank <= {TOP_WORDS}""",
    "first_sentence_summary": f"SELECT doc_id, coalesce({_SENT}[1], substr(text, 1, 200)) AS summary FROM documents",
    "decision_sentences": f"""WITH s AS (SELECT doc_id, list_filter({_SENT}, lambda s: contains(lower(s), 'that the') OR contains(lower(s), 'idiot')) AS kept FROM documents)
SELECT doc_id, CAST(len(kept) AS INTEGER) AS sentences, array_to_string(kept, '|') AS kept FROM s""",
    "qa_split": rf"""WITH t AS (SELECT conv_id, turn, text || ' Ans: ' || role || ' (' || turn || ')' AS t FROM conversations),
p AS (SELECT *, regexp_extract(t, '(?is)^(.*?)\bAns\.?\s*:?\s*(.*)$', 1) AS q, regexp_extract(t, '(?is)^(.*?)\bAns\.?\s*:?\s*(.*)$', 2) AS a FROM t),
c AS (SELECT conv_id, turn, {_CLEAN.format(x="q")} AS q, {_CLEAN.format(x="a")} AS a, {_CLEAN.format(x="t")} AS t FROM p)
SELECT conv_id, turn, CASE WHEN q <> '' AND a <> '' THEN q ELSE t END AS question, CASE WHEN q <> '' AND a <> '' THEN a ELSE '' END AS answer FROM c""",
    "qa_pairing": """WITH r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i FROM conversations)
SELECT q.conv_id, CAST(q.i AS INTEGER) AS i, q.text AS question, a.text AS answer FROM r q JOIN r a ON q.conv_id = a.conv_id AND q.i = a.i AND q.role = 'user' AND a.role = 'assistant'""",
    "html_to_text": r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""",
    "fixed_slices": "SELECT doc_id, CAST(i AS INTEGER) AS slice_no, substr(text, CAST(i AS INTEGER) * 200 + 1, 200) AS slice FROM (SELECT doc_id, text, unnest(range((length(text) + 199) // 200)) AS i FROM documents)",
    "two_halves": """WITH m AS (SELECT doc_id, text, length(text) // 2 AS mid, substr(text, length(text) // 2 - 149, 300) AS w FROM documents),
c AS (SELECT *, CASE WHEN contains(w, chr(10)) THEN mid - 150 + length(w) - strpos(reverse(w), chr(10)) ELSE mid END AS cut FROM m),
h AS (SELECT doc_id, 0 AS half, CASE WHEN length(text) > 3000 THEN substr(text, 1, CAST(cut + 200 AS INTEGER)) ELSE text END AS part FROM c
 UNION ALL SELECT doc_id, 1, substr(text, CAST(greatest(cut - 200, 0) + 1 AS INTEGER)) FROM c WHERE length(text) > 3000)
SELECT doc_id, half, CAST(length(part) AS INTEGER) AS chars, sha256(part) AS part_sha256 FROM h""",
}
