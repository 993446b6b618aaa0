"""Records cut from documents, merges of candidate lists, the gate before an answer, payments and uploads, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparkloom.functions import records as R
from sparkloom.operators import matching as M
from sparkloom.plans.ledger import DRAFT_TOKENS, GLOBAL_TOKENS, MARKER, SIMPLE_TOKENS, messages
from sparkloom.sources.tables import table

#: Stated questions about judgments: citation, case number, parties.
ASKED = [(1, "2019 (3) SCC 7", None, "M/s. Small Ring", "Economy Stores Ltd."), (2, None, "W.P. No. 12 of 2017", None, None), (3, None, None, "ring", "widget"), (4, "2019 (3) SCC 9", "W.P. No. 9 of 2017", "promo stores", None)]
#: The test data's sessions are short: a session limit that some reach, by type.
DEMO_LIMITS = {"draft": 400, "simple": 600}


def _judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(n.alias("external_id"), F.concat(F.lit("2019 (3) SCC "), n.cast("string")).alias("citation"), F.concat(F.lit("W.P. No. "), (n % 500).cast("string"), F.lit(" of 2017")).alias("case_number"), F.concat("p_name", F.lit(" pvt ltd")).alias("petitioner"), F.concat(F.lower("p_type"), F.lit(" stores")).alias("respondent"))


def judgment_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(ASKED, "query_id int, citation string, case_number string, one string, two string")
    return M.find_judgments(asked, _judgments(spark, sf_dir))


def judgment_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation fields of the judgments that were found, blanks for what is missing, and the citation as it is said."""
    found = judgment_precedence(spark, sf_dir).select("external_id").distinct()
    rows = _judgments(spark, sf_dir).join(found, "external_id", "left_semi")
    said = R.undated(F.concat("citation", F.lit(" dated 1.2.2019")))
    return rows.select("external_id", said.alias("citation"), "case_number", "petitioner", "respondent", F.lit("").alias("court"), R.length_ratio_fits(F.col("petitioner"), F.col("respondent")).alias("alike"))


def header_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut where a line begins with a capital T or D."""
    parts = R.segments(F.concat(F.lit("\n"), F.col("text")), r"\n[TD]")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("segment", "part")).select("doc_id", "segment", F.length("part").alias("chars"), F.sha2("part", 256).alias("part_sha256"))


def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: what each capitalised first word of a line introduces, with id, kind and structure."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(R.delimited(F.concat(F.lit("\n"), "text"), r"\n[A-Z][a-z]+ ")).alias("no", "d"))
    kind = F.when(F.length("d.body") < 80, "note").otherwise("body")
    return rows.select(F.concat_ws("-", F.lit("doc"), "doc_id", "no").alias("id"), "doc_id", "no", kind.alias("chunk_type"), F.col("d.delimiter").alias("title"), F.sha2("d.body", 256).alias("text_sha256"), F.to_json(F.struct("lang", F.col("d.delimiter").alias("title"))).alias("metadata"))


def parsed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and titles of rules, sections and forms, and a summary by template."""
    n, name = F.col("p_partkey").cast("string"), F.initcap("p_name")
    rule = R.numbered_title(F.when(F.col("p_partkey") % 3 == 0, name).otherwise(F.concat(F.lit("Rule "), n, F.lit("A -  "), name, F.lit("  of  it"))), "rule")
    section = R.statute_header(F.concat(F.lit("Section "), n, F.lit(". "), name, F.lit(". Whoever")))
    summary = F.format_string("%s %s relates to %s.", F.lit("Rule"), F.coalesce(rule["number"], F.lit("?")), rule["title"])
    return table(spark, sf_dir, "part").select("p_partkey", rule["number"].alias("number"), rule["title"].alias("title"), section["number"].alias("section"), section["title"].alias("heading"), summary.alias("summary"))


def parsed_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meetings, circulars and definitions named in made-up heads of the orders."""
    key, day = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "d MMMM yyyy")
    meeting = R.meeting(F.concat(key, F.lit("th Council Meeting held on "), F.when(F.col("o_orderkey") % 4 > 0, day).otherwise("a day")))
    head = R.document_header(F.concat(F.lit("Circular No. "), key, F.lit("/5/2019 dated "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit("\nSubject: "), F.col("o_orderpriority"), F.lit(" \nText")))
    terms = R.definitions(F.concat(F.lit("(1) “Order "), key, F.lit("” means this; “ Clerk”  means that; “no” mean")))
    return table(spark, sf_dir, "orders").select("o_orderkey", *[meeting[c].alias(c) for c in meeting], *[head[c].alias(c) for c in head], F.array_join(terms, "|").alias("terms"))


def problem_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = R.problem_solution(F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" SOLUTION : "), "role", F.lit(" solution: none"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", x["problem"].alias("problem"), x["solution"].alias("solution"))


def salvaged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("turn") % 3 == 0, "no braces").otherwise(F.concat(F.lit('Sure:\n```json\n{"role": "'), "role", F.lit('", "n": '), F.col("turn").cast("string"), F.lit("}\n```")))
    got = R.salvaged_json(said, "role string, n int")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", got["role"].alias("said"), got["n"].alias("n"))


def analysis_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as analyses: fields that are not blank, issues by number; and as pages."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col(c).alias("x")))), lambda s: s["x"])
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(ordered("text").alias("texts"), F.min_by("role", "turn").alias("first"))
    text = R.analysis_text({"First": F.col("first"), "Empty": F.lit("  "), "Parity": F.when(F.col("conv_id") % 2 == 0, "even")}, F.col("texts"))
    return rows.select("conv_id", F.sha2(text, 256).alias("analysis_sha256"), F.sha2(R.pages_text(F.col("texts")), 256).alias("pages_sha256"))


def plain_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", R.plain_signs(F.concat(F.lit("“"), "s_name", F.lit("” –  it’s "), F.col("s_nationkey").cast("string"), F.lit("… "))).alias("plain"))


def capped_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten words of a document that differ but for case."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(R.capped_keywords(words), " ").alias("keywords"))


def _keep_first(rows: DataFrame, key: Column) -> DataFrame:
    """By key, the row of the least (list, place)."""
    return rows.groupBy(key.alias("key")).agg(F.min(F.struct("list", "place", "id")).alias("m")).select("key", "m.list", "m.place", "m.id")


def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lists of candidates; of equal ids, or without an id of equal first 120 characters, the first stays."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    one = lambda n, where, id_: docs.where(where).select(F.lit(n).alias("list"), F.col("doc_id").alias("place"), id_.cast("string").alias("id"), "text")
    rows = one(0, "doc_id % 3 = 0", F.col("doc_id")).unionByName(one(1, "doc_id % 2 = 0", F.col("doc_id"))).unionByName(one(2, "true", F.lit("")))
    return _keep_first(rows, F.coalesce(F.nullif("id", F.lit("")), F.left("text", F.lit(120)))).select(F.sha2("key", 256).alias("key_sha256"), "list", "place")


def merged_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that grow by what they don't hold yet: the roles and first letters of a conversation, in order of appearance."""
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.left("text", F.lit(1)).alias("letter")))).alias("xs"))
    union = F.array_union(F.transform("xs", lambda x: x["role"]), F.transform("xs", lambda x: x["letter"]))
    return lists.select("conv_id", F.array_join(union, "|").alias("merged"))


def load_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a load takes and skips, by source: without text, or with a text that came before."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.when(F.length("text") > 0, F.sha2("text", 256)).alias("id"))
    first = F.when(F.col("id").isNotNull(), F.col("doc_id") == F.min("doc_id").over(Window.partitionBy("id")))
    return rows.withColumn("first", first).groupBy("source").agg(F.count_if(F.coalesce("first", F.lit(False))).alias("loaded"), F.count_if(F.col("first") == F.lit(False)).alias("repeated"), F.count_if(F.col("id").isNull()).alias("empty"))


#: A session's tokens, by type.
LIMITS = {"draft": DRAFT_TOKENS, "simple": SIMPLE_TOKENS}


def quota_checks(spark: SparkSession, sf_dir: str, limits: dict[str, int] = DEMO_LIMITS, extra: int = 10) -> DataFrame:
    """Checks before an answer, in order, the first failure counts: balance of the request's type, all tokens, the session's tokens. The type
    is the mode asked for, else draft where files are present, else the session's own, else simple. Tokens of the request count. LIMITS
    holds what a session may use; the test data's sessions are shorter."""
    asks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max((F.col("role") == "user") & F.contains("text", F.lit(MARKER))).alias("marked"))
    sums = messages(spark, sf_dir).groupBy("conv_id").agg(F.sum("tokens").alias("tokens"))
    n = F.col("conv_id")
    mode, files = F.when(n % 7 == 0, "draft").when(n % 7 == 1, "simple"), n % 5 == 0
    kind = F.coalesce(mode, F.when(files, "draft"), F.when(F.col("marked"), "draft"), F.lit("simple"))
    rows = asks.join(sums, "conv_id").select("conv_id", kind.alias("kind"), (F.col("tokens") + extra).alias("tokens"), (n % 4).alias("draft_balance"), (n % 3).alias("simple_balance"), (n * 3000).alias("all_tokens"))
    limit = F.when(F.col("kind") == "draft", limits["draft"]).otherwise(limits["simple"])
    verdict = (
        F.when((F.col("kind") == "draft") & (F.col("draft_balance") <= 0), "no draft credits").when((F.col("kind") == "simple") & (F.col("simple_balance") <= 0), "no simple credits")
        .when(F.col("all_tokens") + extra > GLOBAL_TOKENS, "token limit").when(F.col("tokens") > limit, "session limit").otherwise("ok")
    )
    return rows.select("conv_id", "kind", "tokens", verdict.alias("verdict"))


def deduction_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message takes a credit if it is the first of its session or brings files."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    first = F.col("turn") == F.min("turn").over(Window.partitionBy("conv_id"))
    return rows.select("conv_id", "turn", (first | F.contains("text", F.lit(MARKER)) | (F.col("turn") % 5 == 4)).alias("deducts"))


def coupon_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a coupon holds on an order's day: open where a bound is missing, without limit where max_uses is 0 or missing."""
    n, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(n, day.alias("day"), F.when(n % 3 > 0, F.date_add(day, (n % 5 - 2).cast("int"))).alias("valid_from"), F.when(n % 4 > 0, F.date_add(day, (n % 7 - 2).cast("int"))).alias("valid_until"), F.when(n % 2 == 0, n % 3).alias("max_uses"), (n % 4).alias("uses"))
    used_up = (F.coalesce("max_uses", F.lit(0)) > 0) & (F.col("uses") >= F.col("max_uses"))
    why = F.when(F.col("valid_from") > F.col("day"), "not yet").when(F.col("valid_until") < F.col("day"), "expired").when(used_up, "used up").otherwise("ok")
    return rows.select("o_orderkey", why.alias("verdict"))


def payment_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmations of payments, unknown and repeated ones among them: for each user the credits, ledger rows and coupon uses that
    follow. Payments whose price is 0 are complete at once; each payment counts once."""
    n = F.col("o_orderkey")
    paid = table(spark, sf_dir, "orders").select(n, "o_custkey", (n % 9 + 1).alias("credits"), (n % 6 == 0).alias("free"), (n % 2 == 0).alias("coupon"), (F.col("o_orderstatus") == "F").alias("before"))
    confirmed = table(spark, sf_dir, "events").select(F.col("event_id").alias("o_orderkey")).unionByName(table(spark, sf_dir, "events").select(F.col("user_id").alias("o_orderkey"))).distinct().withColumn("told", F.lit(True))
    rows = paid.join(confirmed, "o_orderkey", "left").where("not before and (free or told)")
    return rows.groupBy("o_custkey").agg(F.sum("credits").alias("credits"), F.count("*").alias("ledger_rows"), F.count_if("coupon").alias("coupon_uses"))


def feedback_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feedback a message: the earliest stays, later ones are refused."""
    rows = table(spark, sf_dir, "events").where("event_type in ('click', 'signup', 'error')").withColumn("message_id", F.col("user_id") * 10 + F.col("event_id") % 3)
    return rows.groupBy("message_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), (F.count("*") - 1).alias("refused"))


def session_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions (orders) that a user asks for and owns; nothing of others."""
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("asker"))
    owned = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return asked.join(owned, "o_orderkey").where("asker = o_custkey").select("o_orderkey", "asker", "o_orderstatus")


def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation and all their orders, in order; an empty list for those without."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")).alias("orders"))
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", "n_name", F.array_join(F.coalesce("orders", F.array().cast("array<string>")), ",").alias("orders"))


def upload_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With files in a request, questions go to the document, drafts wait for a summary, all else is summarised."""
    names = ["query_document", "draft_all", "analyse", "query_general", "confirm_mode", "summarize", "query_mixed", "draft_specific"]
    asked = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("turn") % 8 + 1).cast("int"))
    after = F.when(F.col("conv_id") % 2 == 1, asked).when(asked.isin("query_document", "query_mixed", "query_general"), "query_with_doc").when(asked.isin("draft_all", "draft_specific", "confirm_mode"), "summarize_then_draft").otherwise("summarize")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", after.alias("intent"))


def upload_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an order (its lines) by routing and part played; ambiguous ones join the order's case unless all are ambiguous."""
    lines = table(spark, sf_dir, "lineitem")
    routing = F.when(F.col("l_returnflag") == "R", "new_case").when(F.col("l_returnflag") == "A", "add").otherwise("ambiguous")
    clear = F.max(F.col("l_returnflag") != "N").over(Window.partitionBy("l_orderkey"))
    rows = lines.select("l_orderkey", F.when((routing == "ambiguous") & clear, "add").when(routing == "ambiguous", "ask_user").otherwise(routing).alias("routing"), (F.col("l_linestatus") == "F").alias("is_primary"))
    return rows.groupBy("l_orderkey", "routing", "is_primary").agg(F.count("*").alias("files"))


def ordered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages worked on in any order, given back in order of their index."""
    done = table(spark, sf_dir, "pages").repartition(8).select("page_id", F.length("html").alias("chars"))
    return done.withColumn("place", F.row_number().over(Window.partitionBy(F.floor(F.col("page_id") / 10)).orderBy("page_id")))


QUERIES = {f.__name__: f for f in (
    judgment_precedence, judgment_projection, header_segments, chunk_records, parsed_titles, parsed_heads, problem_solution, salvaged_answers, analysis_texts, plain_signs,
    capped_keywords, merged_candidates, merged_preferences, load_counters, quota_checks, deduction_trigger, coupon_windows, payment_effects, feedback_once, session_owners,
    nested_orders, upload_intents, upload_groups, ordered_results,
)}

_J = "(SELECT p_partkey AS external_id, '20193scc' || p_partkey AS c, 'wp' || (p_partkey % 500) || '2017' AS n, p_name AS p, lower(p_type) || ' stores' AS r FROM part)"
_FOUND = f"""(SELECT query_id, external_id, min(rank) AS rank FROM (
 SELECT 1 AS query_id, external_id, CASE WHEN c = '20193scc7' THEN 0 WHEN p = 'small ring' AND r = 'economy stores' THEN 2 WHEN p = 'small ring' THEN 3 ELSE 4 END AS rank FROM {_J} WHERE c = '20193scc7' OR p = 'small ring' OR r = 'economy stores'
 UNION ALL SELECT 2, external_id, 1 FROM {_J} WHERE n = 'wp122017'
 UNION ALL SELECT 3, external_id, 5 FROM {_J} WHERE contains(p, 'ring') OR contains(r, 'ring') OR contains(p, 'widget') OR contains(r, 'widget')
 UNION ALL SELECT 4, external_id, CASE WHEN c = '20193scc9' THEN 0 WHEN n = 'wp92017' THEN 1 ELSE 4 END FROM {_J} WHERE c = '20193scc9' OR n = 'wp92017' OR r = 'promo stores') GROUP BY 1, 2)"""
_LISTS = "(SELECT conv_id, list(text ORDER BY turn) AS texts, arg_min(role, turn) AS first FROM conversations GROUP BY 1)"

ORACLES = {
    "judgment_precedence": f"SELECT query_id, external_id, ['citation', 'case_number', 'both', 'petitioner', 'respondent', 'substring'][rank + 1] AS reason FROM {_FOUND}",
    "judgment_projection": f"""SELECT p_partkey AS external_id, '2019 (3) SCC ' || p_partkey AS citation, 'W.P. No. ' || (p_partkey % 500) || ' of 2017' AS case_number, p_name || ' pvt ltd' AS petitioner, lower(p_type) || ' stores' AS respondent, '' AS court,
 length(p_name || ' pvt ltd')::DOUBLE / length(lower(p_type) || ' stores') BETWEEN 0.7 AND 1.3 AS alike FROM part WHERE p_partkey IN (SELECT external_id FROM {_FOUND})""",
    "header_segments": r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(chr(10) || text, '(\n[TD])', chr(1) || '\1', 'g'), chr(1)) AS parts FROM documents),
e AS (SELECT doc_id, unnest(parts[2:]) AS part, unnest(range(len(parts) - 1)) AS segment FROM s)
SELECT doc_id, CAST(segment AS INTEGER) AS segment, CAST(length(part) AS INTEGER) AS chars, sha256(part) AS part_sha256 FROM e""",
    "chunk_records": r"""WITH s AS (SELECT doc_id, lang, regexp_extract_all(chr(10) || text, '\n[A-Z][a-z]+ ') AS heads, string_split(regexp_replace(chr(10) || text, '\n[A-Z][a-z]+ ', chr(1), 'g'), chr(1)) AS parts FROM documents),
e AS (SELECT doc_id, lang, unnest(heads) AS head, unnest(parts[2:]) AS body, unnest(range(len(heads))) AS no FROM s),
t AS (SELECT doc_id, lang, CAST(no AS INTEGER) AS no, regexp_replace(head, '^\s+|\s+$', '', 'g') AS title, regexp_replace(body, '^\s+|\s+$', '', 'g') AS body FROM e)
SELECT 'doc-' || doc_id || '-' || no AS id, doc_id, no, CASE WHEN length(body) < 80 THEN 'note' ELSE 'body' END AS chunk_type, title, sha256(body) AS text_sha256, '{"lang":"' || lang || '","title":"' || title || '"}' AS metadata FROM t""",
    "parsed_titles": """WITH t AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM part),
r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey || 'A' END AS number, CASE WHEN p_partkey % 3 <> 0 THEN name || ' of it' ELSE 'Untitled' END AS title, CAST(p_partkey AS VARCHAR) AS section, name AS heading FROM t)
SELECT *, 'Rule ' || coalesce(number, '?') || ' relates to ' || title || '.' AS summary FROM r""",
    "parsed_heads": """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS meeting_no, CASE WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate, '%-d %B %Y') ELSE 'UNKNOWN' END AS held_on, o_orderkey || '/5/2019' AS number,
 strftime(o_orderdate, '%d.%m.%Y') AS dated, o_orderpriority AS subject, 'order ' || o_orderkey || '|clerk' AS terms FROM orders""",
    "problem_solution": r"""SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS problem, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS solution FROM conversations""",
    "salvaged_answers": "SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN role END AS said, CASE WHEN turn % 3 <> 0 THEN CAST(turn AS INTEGER) END AS n FROM conversations",
    "analysis_texts": f"""SELECT conv_id, sha256('First: ' || first || CASE WHEN conv_id % 2 = 0 THEN chr(10) || chr(10) || 'Parity: even' ELSE '' END || chr(10) || chr(10) || 'Issues:' || chr(10)
 || array_to_string(list_transform(range(1, len(texts) + 1), lambda i: i || '. ' || texts[i]), chr(10))) AS analysis_sha256,
 sha256(array_to_string(list_transform(range(1, len(texts) + 1), lambda i: '[PAGE ' || i || ']' || chr(10) || texts[i]), chr(10) || chr(10))) AS pages_sha256 FROM {_LISTS}""",
    "plain_signs": "SELECT s_suppkey, '\"' || s_name || '\" - it''s ' || s_nationkey || '...' AS plain FROM supplier",
    "capped_keywords": """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w, unnest(range(len(regexp_extract_all(text, '[A-Za-z]+')))) AS i FROM documents),
f AS (SELECT doc_id, lower(w) AS k, arg_min(w, i) AS w, min(i) AS i FROM w GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) <= 10),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS keywords FROM f GROUP BY 1) SELECT doc_id, coalesce(keywords, '') AS keywords FROM documents LEFT JOIN k USING (doc_id)""",
    "merged_candidates": """WITH u AS (SELECT 0 AS list, doc_id AS place, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL UNION ALL SELECT 1, doc_id, CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL
 UNION ALL SELECT 2, doc_id, substr(text, 1, 120) FROM documents WHERE text IS NOT NULL)
SELECT sha256(key) AS key_sha256, list, place FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY list, place) = 1""",
    "merged_preferences": """WITH u AS (SELECT conv_id, role AS x, 0 AS part, turn FROM conversations UNION ALL SELECT conv_id, substr(text, 1, 1), 1, turn FROM conversations),
f AS (SELECT conv_id, x, min(part * 1000000 + turn) AS pos FROM u GROUP BY 1, 2) SELECT conv_id, string_agg(x, '|' ORDER BY pos) AS merged FROM f GROUP BY 1""",
    "load_counters": """WITH r AS (SELECT source, doc_id, CASE WHEN length(text) > 0 THEN doc_id = min(doc_id) OVER (PARTITION BY text) END AS first FROM documents)
SELECT source, count(*) FILTER (WHERE first) AS loaded, count(*) FILTER (WHERE NOT first) AS repeated, count(*) FILTER (WHERE first IS NULL) AS empty FROM r GROUP BY 1""",
    "quota_checks": f"""WITH s AS (SELECT conv_id, bool_or(role = 'user' AND contains(text, '{MARKER}')) AS marked, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS BIGINT) + 10 AS tokens FROM conversations GROUP BY 1),
k AS (SELECT *, CASE WHEN conv_id % 7 = 0 THEN 'draft' WHEN conv_id % 7 = 1 THEN 'simple' WHEN conv_id % 5 = 0 OR marked THEN 'draft' ELSE 'simple' END AS kind FROM s)
SELECT conv_id, kind, tokens, CASE WHEN kind = 'draft' AND conv_id % 4 <= 0 THEN 'no draft credits' WHEN kind = 'simple' AND conv_id % 3 <= 0 THEN 'no simple credits' WHEN conv_id * 3000 + 10 > {GLOBAL_TOKENS} THEN 'token limit'
 WHEN tokens > CASE kind WHEN 'draft' THEN {DEMO_LIMITS["draft"]} ELSE {DEMO_LIMITS["simple"]} END THEN 'session limit' ELSE 'ok' END AS verdict FROM k""",
    "deduction_trigger": f"SELECT conv_id, turn, turn = min(turn) OVER (PARTITION BY conv_id) OR contains(text, '{MARKER}') OR turn % 5 = 4 AS deducts FROM conversations WHERE role = 'user'",
    "coupon_windows": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 5 - 2 > 0 THEN 'not yet' WHEN o_orderkey % 4 > 0 AND o_orderkey % 7 - 2 < 0 THEN 'expired'
 WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 > 0 AND o_orderkey % 4 >= o_orderkey % 3 THEN 'used up' ELSE 'ok' END AS verdict FROM orders""",
    "payment_effects": """WITH c AS (SELECT event_id AS k FROM events UNION SELECT user_id FROM events)
SELECT o_custkey, CAST(sum(o_orderkey % 9 + 1) AS BIGINT) AS credits, count(*) AS ledger_rows, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS coupon_uses FROM orders WHERE o_orderstatus <> 'F' AND (o_orderkey % 6 = 0 OR o_orderkey IN (SELECT k FROM c)) GROUP BY 1""",
    "feedback_once": """SELECT message_id, event_id, n - 1 AS refused FROM (SELECT user_id * 10 + event_id % 3 AS message_id, event_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id * 10 + event_id % 3) AS n FROM events
 WHERE event_type IN ('click', 'signup', 'error') WINDOW w AS (PARTITION BY user_id * 10 + event_id % 3 ORDER BY ts, event_id)) WHERE k = 1""",
    "session_owners": "SELECT o_orderkey, o_custkey AS asker, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0",
    "nested_orders": """SELECT c_custkey, n_name, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey), '') AS orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""",
    "upload_intents": """WITH t AS (SELECT *, ['query_document', 'draft_all', 'analyse', 'query_general', 'confirm_mode', 'summarize', 'query_mixed', 'draft_specific'][turn % 8 + 1] AS a FROM conversations)
SELECT conv_id, turn, CASE WHEN conv_id % 2 = 1 THEN a WHEN a LIKE 'query%' THEN 'query_with_doc' WHEN a LIKE 'draft%' OR a = 'confirm_mode' THEN 'summarize_then_draft' ELSE 'summarize' END AS intent FROM t""",
    "upload_groups": """WITH r AS (SELECT l_orderkey, l_returnflag AS f, l_linestatus = 'F' AS is_primary, bool_or(l_returnflag <> 'N') OVER (PARTITION BY l_orderkey) AS clear FROM lineitem)
SELECT l_orderkey, CASE WHEN f = 'R' THEN 'new_case' WHEN f = 'A' OR clear THEN 'add' ELSE 'ask_user' END AS routing, is_primary, count(*) AS files FROM r GROUP BY 1, 2, 3""",
    "ordered_results": "SELECT page_id, CAST(length(html) AS INTEGER) AS chars, CAST(row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) AS INTEGER) AS place FROM pages",
}
