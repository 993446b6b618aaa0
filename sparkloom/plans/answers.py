"""Answers from start to end over the driver's tables: vectors stand for chunks, stretches of them, every third one, for judgments, queries' neighbours in
the table for questions put in other words."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparkloom.functions import records as R, text as T
from sparkloom.operators import answering as A, cases, matching as M
from sparkloom.plans import matchings_sql
from sparkloom.plans.ledger import messages
from sparkloom.plans.matchings import KINDS, judgments
from sparkloom.plans.retrieval import D2, QUERY_EVERY, TOP_K, knn
from sparkloom.sources import files
from sparkloom.sources.cut import cut, new_folder
from sparkloom.sources.tables import table

#: Buckets of a stored index.
BUCKETS = 16
#: Vectors among which one judgment's chunks are, every third one; the number of judgments grows with the table.
SPAN = 27


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("vec_id")
    kind = F.when(n % 3 == 0, "judgment").otherwise(F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("label") % len(KINDS) + 1).cast("int")))
    decision = F.when(n % 6 == 0, "In favour of assessee").when(n % 6 == 3, "In favour of revenue")
    section, source = F.when(n % 4 == 0, F.col("label")), F.when(n % 5 > 0, n % 11)
    return table(spark, sf_dir, "embeddings").select(n.alias("chunk_id"), F.when(n % 3 == 0, F.floor(n / SPAN)).alias("external_id"), kind.alias("chunk_type"), decision.alias("decision"), section.alias("section"), source.alias("source"), "label", "embedding")


def _questions(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    """Every 20th vector, or the one that comes `shift` after it."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - shift).alias("query_id"), F.col("embedding").alias("q"), "label")
    return rows.where(F.col("query_id") % QUERY_EVERY == 0)


def _neighbours(spark: SparkSession, sf_dir: str, shifts: tuple[int, ...] = (0,)) -> list[DataFrame]:
    """query_id, chunk_id, score for each shift of the questions; all of them are asked in one search, by the vectors' own ids."""
    vectors, n = table(spark, sf_dir, "embeddings"), F.col("query_id")
    asked = None
    for shift in shifts:
        rows = _questions(spark, sf_dir, shift).select((n + shift).alias("query_id"), "q")
        asked = rows if asked is None else asked.unionByName(rows)
    found = knn(vectors, asked)
    found = found if len(shifts) == 1 else cut(found)
    return [found.where((n - shift) % QUERY_EVERY == 0).select((n - shift).alias("query_id"), F.col("vec_id").alias("chunk_id"), "score") for shift in shifts]


def _retrieved(spark: SparkSession, sf_dir: str, near: DataFrame, shift: int = 0, k: int = A.RESULTS) -> DataFrame:
    chunks, asked = _chunks(spark, sf_dir), _questions(spark, sf_dir, shift)
    nth = F.floor(F.col("query_id") / QUERY_EVERY)
    of = lambda where, external_id, reason: asked.where(where).select("query_id", external_id.alias("external_id"), F.lit(reason).alias("reason"))
    own = F.floor(F.col("query_id") / SPAN)
    matches = of(nth % 3 == 0, own, "citation").unionByName(of(nth % 4 == 0, own + 1, "substring"))
    whole = chunks.where("external_id is not null").groupBy("external_id").agg(F.min_by("embedding", "chunk_id").alias("vector")).withColumn("chunk_id", -1 - F.col("external_id"))
    topics = asked.select("query_id", F.when(nth % 2 == 0, F.col("label")).alias("topic"))
    statutory, near = A.of_topics(topics, chunks.where("external_id is null").select("chunk_id", "chunk_type", F.col("label").alias("topic")), near, k)
    return A.retrieve(asked.select("query_id", "q"), matches, whole, statutory, near, chunks, k)


def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete judgments, statutory hits and neighbours of each query, the best 25."""
    return _retrieved(spark, sf_dir, *_neighbours(spark, sf_dir))


def issue_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes and siblings: 15 primary, 10 supporting chunks an issue."""
    modes = _questions(spark, sf_dir, 0).select("query_id", F.when(F.col("query_id") % (2 * QUERY_EVERY) == 0, "defensive").otherwise("in_favour").alias("mode"))
    first, second = _neighbours(spark, sf_dir, (1, 0))
    return A.for_issue(_retrieved(spark, sf_dir, first, 1, A.PASS), _retrieved(spark, sf_dir, second, 0, A.PASS), _chunks(spark, sf_dir).drop("label", "embedding"), modes)


def answer_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts and sources of all questions; what a model would write is a digest of its prompt."""
    words = F.element_at(F.array(*[F.lit(x) for x in ("court says", "meaning of it", "how to", "council", "else")]), (F.floor(F.col("query_id") / QUERY_EVERY) % 5 + 1).cast("int"))
    asked = _questions(spark, sf_dir, 0).select("query_id", words.alias("question"), F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("doc "), F.col("query_id").cast("string"))).alias("document"))
    blocks = lambda rows: rows.select("chunk_id", F.concat(F.lit("#"), F.col("chunk_id").cast("string")).alias("block"))
    found = _retrieved(spark, sf_dir, *_neighbours(spark, sf_dir))
    chunks = _chunks(spark, sf_dir)
    whole = chunks.where("external_id is not null").select((-1 - F.col("external_id")).alias("chunk_id")).distinct()
    made = A.assemble(asked, found, blocks(chunks).unionByName(blocks(whole)), lambda p: F.sha2(p, 256), "document")
    return made.select("query_id", "answer", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


def source_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks in words, by kind of document."""
    n = F.col("p_partkey")
    kinds = ["Case Scenario", "Analytical Review", "FAQ", "Draft Reply", "Case Study", "Case Study Table", "Council Minutes", "Other", "Other", "Other"]
    some = lambda c, every: F.when(n % every > 0, c)
    c = {
        "complete": n % 20 == 19, "doc_type": F.element_at(F.array(*[F.lit(x) for x in kinds]), (n % 10 + 1).cast("int")), "chunk_type": F.when(n % 10 == 7, "rule"), "source": some(F.col("p_brand"), 7),
        "section_number": some(F.col("p_size"), 3), "illustration_number": n, "section_title": some(F.col("p_type"), 4), "question_number": n, "section_type": some(F.col("p_type"), 8), "table_index": F.when(n % 4 == 1, n % 3),
        "meeting_number": F.col("p_size"), "hsn_code": F.when(n % 10 == 8, n), "sac_code": F.when(n % 10 == 9, n), "problem": some(F.col("p_name"), 3), "solution": F.col("p_brand"), "text": F.col("p_name"),
    }
    return table(spark, sf_dir, "part").select("p_partkey", R.source_block(c).alias("block"))


def form_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What forms and registers there are, by the heads of texts."""
    n = F.col("p_partkey").cast("string")
    head = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("GSTAT FORM - "), n)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Gstat-cdr "), n)).otherwise(F.lit("Note"))
    made = R.form_kind(F.concat(head, F.when(F.col("p_partkey") % 4 > 0, F.concat(F.lit(" – "), "p_name", F.lit(" "))).otherwise(""), F.lit("\n[See rule "), F.col("p_size").cast("string"), F.lit("(c)]")))
    return table(spark, sf_dir, "part").select("p_partkey", *[made[c].alias(c) for c in made])


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as chunks of every kind that the index knows."""
    n = F.col("p_partkey")
    text = lambda c: c.cast("string")
    when = lambda rest, c: F.when(n % 10 == rest, c)
    return table(spark, sf_dir, "part").select(
        n.alias("chunk_id"), n.alias("pos"), when(0, text(F.col("p_size"))).alias("section_number"), when(0, F.when(n % 3 == 0, " None ").when(n % 3 == 1, text(n % 4))).alias("subsection"), when(1, F.concat(F.lit(" "), text(F.col("p_size")))).alias("rule_number"),
        when(2, text(n % 100)).alias("hsn_code"), when(3, text(n % 100)).alias("sac_code"), when(4, F.lit("judgment")).alias("chunk_type"), when(4, text(n % 50)).alias("external_id"), when(4, F.concat(F.lit("2019 (3) SCC "), text(n % 50))).alias("citation"),
        when(4, F.concat(F.lit("W.P. No. "), text(n % 50), F.lit(" of 2017"))).alias("case_number"), when(5, F.lit("Form")).otherwise(when(6, F.when(n % 4 == 0, "Register").otherwise("Other")).otherwise(when(7, F.lit("Rule")).otherwise(when(8, F.lit("Council Minutes"))))).alias("doc_type"),
        F.when(n % 20 == 6, "UNKNOWN").otherwise(F.concat(F.lit("00"), text(n % 30))).alias("number"), F.when(n % 3 == 0, "The Register").otherwise("Title").alias("title"), F.when(n % 3 == 1, "a CDR here").otherwise("none").alias("text"),
        F.when(n % 4 == 1, "GSTAT Rules 2025").alias("parent_doc"),
    )


def all_keys_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.full_index(_indexed(spark, sf_dir))


#: How questions name what the index holds: {0} is a part's size, {1} its number by 100, {2} its number by 4.
ASKED = ["what does section {0}({2}) say", "section {0}", "RULE {0} refunds", "hsn {1}", "sac {1} rate", "gstat form 0{1}", "register 00{1}", "{1}th council meeting", "rule-{1}", "nothing at all"]


def index_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first probe of every question finds in the stored index: sections with a subsection on both, without one on the section alone. All parts ask, equal
    questions once."""
    n = F.col("p_partkey")
    text = F.element_at(F.array(*[F.lit(a) for a in ASKED]), (n % len(ASKED) + 1).cast("int"))
    for k, value in enumerate((F.col("p_size"), n % 100, n % 4)):
        text = F.replace(text, F.lit(f"{{{k}}}"), value.cast("string"))
    asked = table(spark, sf_dir, "part").select(text.alias("text")).distinct().withColumn("query_id", F.col("text"))
    index = M.store_index(all_keys_index(spark, sf_dir), f"index_{uuid.uuid4().hex}", new_folder(spark, "index"), BUCKETS)
    return M.look_up(asked, index).withColumnRenamed("query_id", "question")


def case_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of each conversation after all its turns."""
    step = (F.col("turn") + F.col("conv_id")) % 6
    action = F.element_at(F.array(*[F.lit(x) for x in ("new", "decide", "mode", "done", "analyse", "switch")]), (step + 1).cast("int"))
    return cases.case_states(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("place"), action.alias("action"), F.lit(1).alias("target")))


#: Stated pairs of parties that an answer names.
PAIRS = [(1, "Small Ring Co.", "Economy Stores"), (2, "blue stores", "large bolt"), (3, "none", "nobody")]


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is passed on about each judgment that fits a pair of parties, and its line below the answer."""
    asked = spark.createDataFrame(PAIRS, "query_id int, one string, two string")
    n = F.col("external_id")
    known = judgments(spark, sf_dir).withColumns({"citation": F.concat(F.lit("2019 (3) SCC "), n.cast("string")), "case_number": F.when(n % 2 == 0, F.concat(F.lit("W.P. "), n.cast("string"), F.lit(" dated 1.2.2019"))).otherwise("")})
    found = M.match_fuzzy(asked, known).join(asked, "query_id").join(known, "external_id")
    return found.select("query_id", "rank", F.col("one").alias("party1"), F.col("two").alias("party2"), F.col("petitioner").alias("petitioner_full"), F.col("respondent").alias("respondent_full"), "citation", "case_number", R.citation_line(F.col("citation"), F.col("case_number"), F.round("score", 6)).alias("line"))


def token_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each user's prompts and answers, over all sessions; what a message doesn't tell counts as none."""
    rows = messages(spark, sf_dir).select((F.col("conv_id") % 50).alias("user_id"), "role", F.when(F.col("turn") % 7 > 0, F.col("tokens")).alias("tokens"))
    of = lambda where: F.coalesce(F.sum(F.when(where, F.col("tokens"))), F.lit(0))
    answer = F.col("role") == "assistant"
    return rows.groupBy("user_id").agg(of(~answer).alias("input_tokens"), of(answer).alias("output_tokens"), of(F.lit(True)).alias("total_tokens"))


#: What a list in the cache lives for after its last entry, in seconds, and how many entries it gives.
TTL, NEWEST = 86_400, 50


def cached_lists(spark: SparkSession, sf_dir: str, ttl: int = TTL, most: int = NEWEST) -> DataFrame:
    """Lists by user as a cache holds them when the last event is in: each entry renews its list's time; after a longer pause the list starts
    anew, and a list whose time is up is gone. The newest entries are given."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    newest = Window.partitionBy("user_id").orderBy(F.desc("at"), F.desc("event_id"))
    now = rows.agg(F.max("at")).scalar()
    rows = rows.withColumn("later", F.lag("at").over(newest)).withColumn("pause", F.coalesce("later", now) - F.col("at") > ttl * 1_000_000).withColumn("back", F.row_number().over(newest))
    live = rows.withColumn("gone", F.max("pause").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return live.where(~F.col("gone") & (F.col("back") <= most)).select("user_id", "back", "event_id")


def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after inserts, updates and deletes; the last change of a customer counts."""
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    n = F.col("o_orderkey")
    made = table(spark, sf_dir, "orders").select((F.col("o_custkey") + F.when(n % 5 == 0, 1_000_000).otherwise(0)).alias("c_custkey"), F.concat(F.lit("order "), n.cast("string")).alias("c_name"), F.when(n % 3 == 0, "delete").otherwise("upsert").alias("op"), n.alias("place"))
    return files.changed(people, made, "c_custkey")


def legal_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("act", "rule", "faq", "circular", "judgment", "other")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", M.legal_priority(kind).alias("priority"))


def full_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as judgments, their lines as chunks: all fields and the whole text of each that was found."""
    lines = table(spark, sf_dir, "lineitem")
    pos = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    chunks = lines.select(F.col("l_orderkey").alias("external_id"), pos.alias("pos"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("text"))
    found = lines.where("l_orderkey % 3 = 0 and l_linenumber <= 2").select((F.col("l_orderkey") % 5).alias("query_id"), F.col("l_orderkey").alias("external_id"), F.col("l_linenumber").alias("rank"))
    n = F.col("o_orderkey")
    records = table(spark, sf_dir, "orders").select(n.alias("external_id"), F.when(n % 2 == 0, F.concat(F.lit("2019 (3) SCC "), n.cast("string"))).alias("citation"), F.when(n % 4 > 0, F.concat(F.lit(" W.P. "), n.cast("string"))).alias("case_number"), F.col("o_orderpriority").alias("court"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("decision"))
    out = A.full_judgments(found, chunks, records, list(files.JUDGMENT_FIELDS))
    return out.withColumn("text", F.sha2("text", 256))


def active_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with messages and their sessions, by role: sessions joined with their messages."""
    sessions = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.min("conv_id") % 50).alias("user_id"))
    rows = sessions.join(table(spark, sf_dir, "conversations").select("conv_id", "role"), "conv_id")
    return rows.groupBy("role").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("conv_id").alias("sessions"), F.count("*").alias("messages"))


def publisher_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey").cast("string")
    said = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("see 2019 tmi  "), n, F.lit(" (HC)"))).otherwise(F.concat(F.lit("2019 SCC "), n))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.long_publisher(said, "TMI", "Tax Matters").alias("citation"))


def named_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parties that texts name, each once in whatever order; what is no name is left out."""
    n = F.col("p_partkey")
    names = F.initcap("p_name")
    x = F.concat(names, F.lit(" v. Other ("), n.cast("string"), F.lit("). "), F.when(n % 2 == 0, F.concat(F.lit("Other vs "), names, F.lit(" case"))).otherwise("The Court of v. None ("))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(T.party_pairs(x)).alias("n", "s")).select("p_partkey", "n", "s.a", "s.b")


def minutes_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.concat(F.lit("Page  12 "), F.coalesce("text", F.lit("")), F.lit("\n\nCouncil Secretariat page 3 "))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.clean_minutes(x), 256).alias("cleaned_sha256"))


QUERIES = {f.__name__: f for f in (hybrid_retrieval, issue_retrieval, answer_assembly, source_blocks, form_kinds, all_keys_index, index_lookups, case_states, attribution, token_counters, cached_lists, changed_rows, legal_priorities, full_judgments, active_sessions, publisher_forms, named_pairs, minutes_cleaned)}

_CH = f"""(SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN vec_id // {SPAN} END AS external_id, CASE WHEN vec_id % 3 = 0 THEN 'judgment' ELSE [{", ".join(f"'{k}'" for k in KINDS)}][label % {len(KINDS)} + 1] END AS chunk_type,
 CASE WHEN vec_id % 6 = 0 THEN 'In favour of assessee' WHEN vec_id % 6 = 3 THEN 'In favour of revenue' END AS decision, CASE WHEN vec_id % 4 = 0 THEN label END AS section, CASE WHEN vec_id % 5 > 0 THEN vec_id % 11 END AS source, label, embedding FROM embeddings)"""
_PRIORITY = "CASE chunk_type " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(M.HIERARCHY)) + " ELSE 99 END"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_COS = _DOT.format(a="q.embedding", b="w.vector") + " / sqrt(" + _DOT.format(a="q.embedding", b="q.embedding") + " * " + _DOT.format(a="w.vector", b="w.vector") + ")"


def _with(shift: int, k: int, name: str) -> str:
    """Common tables that end in one of the given name: what a pass retrieves."""
    p = f"{name}_"
    return f"""{p}q AS (SELECT vec_id - {shift} AS query_id, (vec_id - {shift}) // {QUERY_EVERY} AS nth, embedding, label FROM embeddings WHERE (vec_id - {shift}) % {QUERY_EVERY} = 0),
{p}m AS (SELECT query_id, query_id // {SPAN} AS external_id, 0 AS stage, {A.EXACT}::DOUBLE AS gain FROM {p}q WHERE nth % 3 = 0 UNION ALL SELECT query_id, query_id // {SPAN} + 1, 1, {A.PARTIAL} FROM {p}q WHERE nth % 4 = 0),
{p}w AS (SELECT external_id, arg_min(embedding, chunk_id) AS vector FROM ch WHERE external_id IS NOT NULL GROUP BY 1),
{p}near AS (SELECT query_id, vec_id AS chunk_id, 1 / (1 + d2) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS k FROM (SELECT q.query_id, e.vec_id, {D2} AS d2 FROM embeddings e, {p}q q)) WHERE k <= {TOP_K}),
{p}hits AS (SELECT query_id, chunk_id, {A.STATUTORY}::DOUBLE AS score, 2 AS stage FROM {p}q JOIN ch USING (label) WHERE nth % 2 = 0 AND external_id IS NULL UNION ALL SELECT query_id, chunk_id, score, 3 FROM {p}near),
{p}one AS (SELECT query_id, chunk_id, min(stage) AS stage, arg_min(score, stage) AS score FROM {p}hits GROUP BY 1, 2),
{p}rows AS (SELECT m.query_id, -1 - m.external_id AS chunk_id, 'judgment' AS chunk_type, round(greatest(0.3, least(1.0, {_COS})) + gain, 6) AS score, stage FROM {p}m m JOIN {p}q q USING (query_id) JOIN {p}w w USING (external_id)
 UNION ALL SELECT o.query_id, o.chunk_id, c.chunk_type, round(o.score, 6), o.stage FROM {p}one o JOIN ch c USING (chunk_id) WHERE NOT EXISTS (SELECT 1 FROM {p}m m WHERE m.query_id = o.query_id AND m.external_id = c.external_id)),
{p}levels AS (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS n FROM (SELECT DISTINCT query_id, score FROM {p}rows)),
{p}bands AS (SELECT query_id, n, score, score AS leader, 0 AS band FROM {p}levels WHERE n = 1
 UNION ALL SELECT l.query_id, l.n, l.score, CASE WHEN b.leader - l.score > 0.0500005 THEN l.score ELSE b.leader END, CASE WHEN b.leader - l.score > 0.0500005 THEN b.band + 1 ELSE b.band END FROM {p}bands b JOIN {p}levels l ON l.query_id = b.query_id AND l.n = b.n + 1),
{p}ranked AS (SELECT query_id, chunk_id, chunk_type, score, stage, CAST(row_number() OVER (PARTITION BY query_id ORDER BY band, {_PRIORITY}, score DESC, stage, chunk_id) AS INTEGER) AS rank FROM {p}rows JOIN {p}bands USING (query_id, score)),
{name} AS (SELECT query_id, rank, chunk_id, chunk_type, score, CAST(stage AS INTEGER) AS stage, stage < 2 AS complete FROM {p}ranked WHERE rank <= {k})"""


_START = f"WITH RECURSIVE ch AS {_CH}, "
_ISSUE_SCORE = """round(CASE chunk_type WHEN 'judgment' THEN 40 WHEN 'draft_reply' THEN 35 WHEN 'notification' THEN 25 WHEN 'circular' THEN 25 WHEN 'act' THEN 25 WHEN 'rule' THEN 25 WHEN 'section' THEN 25 ELSE 10 END
 + CASE WHEN chunk_type <> 'judgment' OR decision IS NULL THEN 0 WHEN (mode = 'defensive') = (decision = 'In favour of assessee') THEN 30 ELSE -20 END + least(similarity * 20, 20), 6)"""
_PART = "(SELECT *, p_partkey % 10 AS r FROM part)"
_INDEX = f"""(SELECT 'section' AS index_name, CAST(p_size AS VARCHAR) AS key, CASE WHEN p_partkey % 3 = 1 THEN CAST(p_partkey % 4 AS VARCHAR) ELSE '' END AS sub, p_partkey AS chunk_id, p_partkey AS pos FROM {_PART} WHERE r = 0
 UNION ALL SELECT 'rule', CAST(p_size AS VARCHAR), '', p_partkey, p_partkey FROM {_PART} WHERE r = 1
 UNION ALL SELECT CASE r WHEN 2 THEN 'hsn' ELSE 'sac' END, CAST(p_partkey % 100 AS VARCHAR), '', p_partkey, p_partkey FROM {_PART} WHERE r IN (2, 3)
 UNION ALL SELECT 'judgment', CAST(p_partkey % 50 AS VARCHAR), '', p_partkey, p_partkey FROM {_PART} WHERE r = 4
 UNION ALL SELECT 'citation', '20193scc' || p_partkey % 50, '', min(p_partkey), min(p_partkey) FROM {_PART} WHERE r = 4 GROUP BY 2
 UNION ALL SELECT 'case_number', 'wp' || p_partkey % 50 || '2017', '', min(p_partkey), min(p_partkey) FROM {_PART} WHERE r = 4 GROUP BY 2
 UNION ALL SELECT CASE r WHEN 5 THEN 'form' ELSE 'register' END, CAST(p_partkey % 30 AS VARCHAR), '', p_partkey, p_partkey FROM {_PART} WHERE r = 5 OR (r = 6 AND p_partkey % 20 <> 6 AND (p_partkey % 4 = 0 OR p_partkey % 3 < 2))
 UNION ALL SELECT 'court_rule', CAST(p_partkey % 30 AS VARCHAR), '', p_partkey, p_partkey FROM {_PART} WHERE r = 7 AND p_partkey % 4 = 1
 UNION ALL SELECT 'council', '00' || p_partkey % 30, '', p_partkey, p_partkey FROM {_PART} WHERE r = 8)"""

ORACLES = {
    "hybrid_retrieval": f"{_START}{_with(0, A.RESULTS, 'found')} SELECT * FROM found",
    "issue_retrieval": f"""{_START}{_with(1, A.PASS, 'first')}, {_with(0, A.PASS, 'second')},
modes AS (SELECT vec_id AS query_id, CASE WHEN vec_id % {2 * QUERY_EVERY} = 0 THEN 'defensive' ELSE 'in_favour' END AS mode FROM embeddings WHERE vec_id % {QUERY_EVERY} = 0),
hit AS (SELECT s.query_id, c.section, c.source FROM second s JOIN ch c USING (chunk_id)),
u AS (SELECT query_id, chunk_id, f.chunk_type, decision, 0 AS list, rank AS place, 0.5 AS similarity FROM first f LEFT JOIN ch USING (chunk_id) UNION ALL SELECT query_id, chunk_id, s.chunk_type, decision, 1, rank, 0.5 FROM second s LEFT JOIN ch USING (chunk_id)
 UNION ALL SELECT DISTINCT h.query_id, c.chunk_id, c.chunk_type, c.decision, 2, c.chunk_id, 0.4 FROM ch c JOIN hit h ON c.section = h.section OR c.source = h.source),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY list, place) AS k FROM u),
s AS (SELECT query_id, chunk_id, list, place, {_ISSUE_SCORE} AS score FROM o JOIN modes USING (query_id) WHERE k = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list, place) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, CAST(score AS DOUBLE) AS score, rank <= {A.PRIMARY} AS primary FROM r WHERE rank <= {A.PRIMARY + A.SUPPORTING}""",
    "answer_assembly": f"""{_START}{_with(0, A.RESULTS, 'found')},
f AS (SELECT *, complete OR (query_id // {QUERY_EVERY} % 5 = 0 AND chunk_type = 'judgment') OR (query_id // {QUERY_EVERY} % 5 = 1 AND chunk_type = 'definition') OR (query_id // {QUERY_EVERY} % 5 = 2 AND chunk_type = 'rule') AS flag FROM found),
s AS (SELECT *, CASE WHEN bool_or(flag) OVER (PARTITION BY query_id) THEN flag ELSE rank <= 3 END AS main FROM f),
l AS (SELECT query_id, coalesce(string_agg('#' || chunk_id, chr(10) || chr(10) ORDER BY rank) FILTER (WHERE main), '') AS a, coalesce(string_agg('#' || chunk_id, chr(10) || chr(10) ORDER BY rank) FILTER (WHERE NOT main), '') AS b, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY NOT main, rank) AS sources FROM s GROUP BY 1)
SELECT query_id, sha256('QUESTION:' || chr(10) || ['court says', 'meaning of it', 'how to', 'council', 'else'][query_id // {QUERY_EVERY} % 5 + 1] || chr(10) || chr(10) || CASE WHEN query_id % 3 = 0 THEN 'DOCUMENT:' || chr(10) || 'doc ' || query_id || chr(10) || chr(10) ELSE '' END
 || 'PRIMARY:' || chr(10) || a || chr(10) || chr(10) || 'SUPPORTING:' || chr(10) || b) AS answer, sources FROM l""",
    "source_blocks": """WITH t AS (SELECT p_partkey, p_partkey % 10 AS r, coalesce(CASE WHEN p_partkey % 7 > 0 THEN p_brand END, 'source') AS src, coalesce(CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size AS VARCHAR) END, 'UNKNOWN') AS sec,
 CASE WHEN p_partkey % 4 > 0 THEN p_type ELSE 'Untitled' END AS title, CASE WHEN p_partkey % 8 > 0 THEN p_type ELSE 'Content' END AS part, CASE WHEN p_partkey % 4 = 1 THEN p_partkey % 3 ELSE 0 END AS i, p_name, p_brand, p_size FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 20 = 19 THEN p_name
 WHEN r = 0 THEN '[CASE SCENARIO | ' || src || ' | Sec ' || sec || ' | Illus ' || p_partkey || ']' || chr(10) || 'PROBLEM: ' || CASE WHEN p_partkey % 3 > 0 THEN p_name ELSE 'No problem description provided.' END || chr(10) || 'SOLUTION: ' || p_brand
 WHEN r = 1 THEN '[ANALYTICAL REVIEW | ' || src || ' | Sec ' || sec || ' | ' || title || ']' || chr(10) || p_name WHEN r = 2 THEN '[FAQ | ' || src || ' | Q ' || p_partkey || ']' || chr(10) || p_name
 WHEN r = 3 THEN '[DRAFT REPLY | ' || src || ' | ' || part || ']' || chr(10) || p_name WHEN r IN (4, 5) AND i > 0 THEN '[CASE STUDY TABLE ' || i || ' | ' || src || ']' || chr(10) || p_name WHEN r IN (4, 5) THEN '[CASE STUDY | ' || src || ' | ' || part || ']' || chr(10) || p_name
 WHEN r = 8 THEN '[HSN CODE ' || p_partkey || ' | ' || src || '] ' || p_name WHEN r = 9 THEN '[SAC CODE ' || p_partkey || ' | ' || src || '] ' || p_name WHEN r = 6 THEN '[GST COUNCIL ' || p_size || 'th MEETING | ' || src || ']' || chr(10) || p_name ELSE '[RULE | ' || src || '] ' || p_name END AS block FROM t""",
    "form_kinds": """SELECT p_partkey, ['Form', 'Register', 'Other'][p_partkey % 3 + 1] AS doc_type, CASE WHEN p_partkey % 3 = 2 THEN 'UNKNOWN' ELSE CAST(p_partkey AS VARCHAR) END AS number, CASE WHEN p_partkey % 4 > 0 THEN p_name ELSE 'Untitled' END AS title, p_size || '(c)' AS related_rule FROM part""",
    "all_keys_index": f"SELECT * FROM {_INDEX}",
    "index_lookups": f"""WITH t AS (SELECT DISTINCT p_partkey % {len(ASKED)} AS r, CASE WHEN p_partkey % {len(ASKED)} < 3 THEN CAST(p_size AS VARCHAR) ELSE CAST(p_partkey % 100 AS VARCHAR) END AS key, CASE WHEN p_partkey % {len(ASKED)} = 0 THEN CAST(p_partkey % 4 AS VARCHAR) END AS sub FROM part),
a AS (SELECT ['section', 'section', 'rule', 'hsn', 'sac', 'form', 'register', 'council', 'court_rule', NULL][r + 1] AS index_name, key, sub,
 replace(replace(replace([{", ".join(f"'{a}'" for a in ASKED)}][r + 1], '{{0}}', key), '{{1}}', key), '{{2}}', coalesce(sub, '')) AS question FROM t)
SELECT question, chunk_id, pos FROM a JOIN {_INDEX} i ON a.index_name = i.index_name AND i.key = a.key WHERE a.sub IS NULL OR a.sub = i.sub""",
    "case_states": """WITH e AS (SELECT conv_id AS session, turn, ['new', 'decide', 'mode', 'done', 'analyse', 'switch'][(turn + conv_id) % 6 + 1] AS action FROM conversations),
n AS (SELECT *, sum(CASE WHEN action = 'new' THEN 1 ELSE 0 END) OVER w AS made FROM e WINDOW w AS (PARTITION BY session ORDER BY turn)),
a AS (SELECT *, last_value(CASE WHEN action = 'new' THEN made WHEN action = 'switch' AND made > 0 THEN 1 END IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn) AS active FROM n),
s AS (SELECT session, active AS case_id, arg_max(action, turn) AS action FROM a WHERE active IS NOT NULL AND action <> 'switch' GROUP BY 1, 2), z AS (SELECT session, arg_max(active, turn) AS last FROM a GROUP BY 1)
SELECT session, CAST(case_id AS INTEGER) AS case_id, CASE WHEN case_id = last THEN 'active' ELSE 'archived' END AS status, CASE action WHEN 'decide' THEN 'awaiting_mode' WHEN 'mode' THEN 'reply_in_progress' WHEN 'done' THEN 'complete' ELSE 'awaiting_decision' END AS state FROM s JOIN z USING (session)""",
    "attribution": f"""WITH f AS ({matchings_sql.ORACLES["fuzzy_pair_match_top5"]}), a(query_id, party1, party2) AS (VALUES (1, 'Small Ring Co.', 'Economy Stores'), (2, 'blue stores', 'large bolt'), (3, 'none', 'nobody'))
SELECT query_id, rank, party1, party2, p_name || ' pvt ltd' AS petitioner_full, lower(p_type) || ' stores' AS respondent_full, '2019 (3) SCC ' || external_id AS citation, CASE WHEN external_id % 2 = 0 THEN 'W.P. ' || external_id || ' dated 1.2.2019' ELSE '' END AS case_number,
 '- 2019 (3) SCC ' || external_id || CASE WHEN external_id % 2 = 0 THEN ' (W.P. ' || external_id || ')' ELSE '' END || ' [Score: ' || printf('%.2f', score) || ']' AS line FROM f JOIN a USING (query_id) JOIN part ON p_partkey = external_id""",
    "token_counters": """WITH t AS (SELECT conv_id % 50 AS user_id, role = 'assistant' AS answer, CASE WHEN turn % 7 > 0 THEN CAST(ceil(length(text) / 4.0) AS BIGINT) ELSE 0 END AS n FROM conversations)
SELECT user_id, CAST(sum(CASE WHEN answer THEN 0 ELSE n END) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN answer THEN n ELSE 0 END) AS BIGINT) AS output_tokens, CAST(sum(n) AS BIGINT) AS total_tokens FROM t GROUP BY 1""",
    "cached_lists": f"""WITH e AS (SELECT user_id, event_id, epoch_us(CAST(ts AS TIMESTAMP)) AS t0, max(epoch_us(CAST(ts AS TIMESTAMP))) OVER () AS now FROM events),
p AS (SELECT *, row_number() OVER w AS back, coalesce(lag(t0) OVER w, now) - t0 > {TTL * 1_000_000} AS pause FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t0 DESC, event_id DESC))
SELECT user_id, CAST(back AS INTEGER) AS back, event_id FROM p WHERE back <= {NEWEST} AND NOT EXISTS (SELECT 1 FROM p x WHERE x.user_id = p.user_id AND x.back <= p.back AND x.pause)""",
    "changed_rows": """WITH c AS (SELECT o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1000000 ELSE 0 END AS k, 'order ' || o_orderkey AS name, o_orderkey % 3 = 0 AS gone, row_number() OVER (PARTITION BY o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1000000 ELSE 0 END ORDER BY o_orderkey DESC) AS n FROM orders)
SELECT k AS c_custkey, name AS c_name FROM c WHERE n = 1 AND NOT gone UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT k FROM c)""",
    "legal_priorities": "SELECT p_partkey, [1, 2, 4, 4, 8, NULL][p_partkey % 6 + 1] AS priority FROM part",
    "full_judgments": f"""WITH f AS (SELECT l_orderkey AS external_id, l_orderkey % 5 AS query_id, min(l_linenumber) AS rank FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber <= 2 GROUP BY 1, 2),
b AS (SELECT l_orderkey AS external_id, string_agg(l_returnflag || ' ' || l_linestatus, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS body FROM lineitem GROUP BY 1),
r AS (SELECT o_orderkey AS external_id, CASE WHEN o_orderkey % 2 = 0 THEN '2019 (3) SCC ' || o_orderkey ELSE '' END AS citation, CASE WHEN o_orderkey % 4 > 0 THEN 'W.P. ' || o_orderkey ELSE '' END AS case_number, o_orderpriority AS court, CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderstatus AS decision FROM orders)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, external_id) AS INTEGER) AS place, external_id, citation, case_number, court, year, decision, {", ".join(f"'' AS {c}" for c in files.JUDGMENT_FIELDS if c not in ("citation", "case_number", "court", "year", "decision"))},
 sha256(concat_ws(chr(10), CASE WHEN citation <> '' THEN 'Citation: ' || citation END, CASE WHEN case_number <> '' THEN 'Case Number: ' || case_number END) || chr(10) || chr(10) || body) AS text FROM f JOIN b USING (external_id) JOIN r USING (external_id)""",
    "active_sessions": "SELECT role, count(DISTINCT conv_id % 50) AS users, count(DISTINCT conv_id) AS sessions, count(*) AS messages FROM conversations GROUP BY 1",
    "publisher_forms": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN '2019 Tax Matters ' ELSE '2019 SCC ' END || s_suppkey AS citation FROM supplier",
    "named_pairs": """SELECT p_partkey, 0 AS n, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS a, 'Other' AS b FROM part""",
    "minutes_cleaned": r"""SELECT doc_id, sha256(trim(replace(regexp_replace(regexp_replace('Page  12 ' || coalesce(text, '') || chr(10) || chr(10) || 'Council Secretariat page 3 ', '\s+', ' ', 'g'), 'Page\s+\d+', '', 'g'), 'Council Secretariat', ''))) AS cleaned_sha256 FROM documents""",
}
