"""Look-ups in metadata and matching of parties, as joins over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.functions import text as T
from sparkloom.operators import names
from sparkloom.sources.cut import cut

BAND = 0.05
#: Kinds of chunks by priority.
HIERARCHY = ["judgment", "definition", "operative", "case_scenario", "case_study", "rule", "hsn", "sac", "council_decision", "gstat_rule", "gstat_form", "gstat_register", "draft_reply", "qa_pair", "faq", "notification", "circular", "analytical_review"]


#: Ranks of sources of law; equal ranks are equal.
LEGAL_PRIORITY = {"act": 1, "rule": 2, "notification": 3, "circular": 4, "faq": 4, "illustration": 5, "article": 6, "analytical_review": 7, "judgment": 8}


def legal_priority(kind: Column) -> Column:
    """Null for other kinds."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LEGAL_PRIORITY.items() for x in pair]), kind)


def metadata_index(chunks: DataFrame, keys: dict[str, str]) -> DataFrame:
    """index_name, key, chunk_id, pos: one row for each key that a chunk has; blank keys and 'none' don't count."""
    pairs = F.array(*[F.struct(F.lit(name).alias("index_name"), T.strip(F.col(c).cast("string")).alias("key")) for name, c in keys.items()])
    rows = chunks.select("chunk_id", "pos", F.explode(pairs).alias("k")).select("k.index_name", F.lower("k.key").alias("key"), "chunk_id", "pos")
    return rows.where(F.col("key").isNotNull() & ~F.col("key").isin("", "none", "null"))


#: How questions name what they ask for, in lower case: sections with and without a subsection, rules, goods and service codes, forms and rules
#: of the court, registers, meetings of the council in two ways.
PROBES = (
    r"section\s+(\d+)\s*\(\s*(\d+)\s*\)?", r"section\s+(\d+)", r"rule\s+(\d+[a-z]?)", r"hsn\s+(\d+)", r"sac\s+(\d+)", r"(?:gstat[-\s]*)?form[-\s]*(\d+)", r"(?:gstat[-\s]*)?rule[-\s]*(\d+)",
    r"(?:gstat[-\s]*)?(?:cdr|register)[-\s]*(\d+)", r"(\d+)(?:st|nd|rd|th)?\s+council\s+(?:meeting|minutes)", r"council\s+meeting\s+(\d+)",
)
LOOSE_SECTION = r"section\s+(\d+)\s*\(?\s*(\d+)\s*\)?"


def probe(query: Column, strict: bool = True) -> Column:
    """struct<index_name, key, sub>: the first probe whose words occur, whether or not its look-up will find anything."""
    q = F.lower(query)
    group = lambda p, g=1: F.nullif(F.regexp_extract(q, p, g), F.lit(""))
    hit = lambda name, p, key, sub=None: F.when(q.rlike(p), F.struct(F.lit(name).alias("index_name"), key.alias("key"), (F.lit(None).cast("string") if sub is None else sub).alias("sub")))
    bare = lambda p: F.regexp_replace(F.regexp_extract(q, p, 1), "^0+(?=.)", "")
    both, one, rule, hsn, sac, form, court_rule, register, council, council2 = PROBES if strict else (LOOSE_SECTION, *PROBES[1:])
    return F.coalesce(
        hit("section", both, group(both), group(both, 2)), hit("section", one, group(one)), hit("rule", rule, group(rule)), hit("hsn", hsn, group(hsn)), hit("sac", sac, group(sac)),
        hit("form", form, bare(form)), hit("court_rule", court_rule, bare(court_rule)), hit("register", register, bare(register)), hit("council", council, group(council)), hit("council", council2, group(council2)),
    )


#: Fixed value: whose rules the index of court rules holds.
COURT_RULES = "GSTAT Rules 2025"


def full_index(chunks: DataFrame) -> DataFrame:
    """index_name, key, sub, chunk_id, pos: all eleven indexes of chunks, long. sub is a section's subsection, '' where there is none.

    chunks: chunk_id, pos, and as strings section_number, subsection, rule_number, hsn_code, sac_code, chunk_type, external_id, citation, case_number, doc_type,
    number, title, text, parent_doc. number is that of the form, register, rule or meeting. Of a judgment's chunks the first one alone
    stands under its citation and its case number; blank keys don't count."""
    c, kind = F.col, F.col("doc_type")
    bare = lambda x: F.when(T.strip(x) != "", F.regexp_replace(T.strip(x), "^0+(?=.)", ""))
    low = F.lower(T.strip(F.coalesce("subsection", F.lit(""))))
    sub = F.when(low.isin("none", "null"), "").otherwise(T.strip(F.coalesce("subsection", F.lit(""))))
    judged = (c("chunk_type") == "judgment") & (T.strip(c("external_id")) != "")
    register = (kind == "Register") | ((kind == "Other") & (F.coalesce("title", F.lit("")) != "") & (F.contains(F.lower("title"), F.lit("register")) | F.contains(F.lower("text"), F.lit("cdr"))))
    entries = [
        ("section", T.strip(c("section_number")), sub), ("rule", T.strip(c("rule_number")), None), ("hsn", T.strip(c("hsn_code")), None), ("sac", T.strip(c("sac_code")), None), ("judgment", F.when(judged, T.strip(c("external_id"))), None),
        ("citation", F.when(judged, T.normalize_citation(c("citation"))), None), ("case_number", F.when(judged, T.core_case_number(c("case_number"))), None), ("form", F.when(kind == "Form", bare(c("number"))), None),
        ("register", F.when(register & (c("number") != "UNKNOWN"), bare(c("number"))), None), ("court_rule", F.when((kind == "Rule") & (c("parent_doc") == COURT_RULES), bare(c("number"))), None),
        ("council", F.when(kind == "Council Minutes", T.strip(c("number"))), None),
    ]
    made = F.array(*[F.struct(F.lit(name).alias("index_name"), key.alias("key"), (F.lit("") if s is None else s).alias("sub")) for name, key, s in entries])
    rows = chunks.select("chunk_id", "pos", "external_id", F.explode(made).alias("k")).select("k.*", "chunk_id", "pos", "external_id").where("key <> ''")
    alone = F.col("index_name").isin("citation", "case_number")
    firsts = rows.where(alone).groupBy("index_name", "key", "sub", "external_id").agg(F.min(F.struct("pos", "chunk_id")).alias("m")).select("index_name", "key", "sub", "m.chunk_id", "m.pos")
    return rows.where(~alone).drop("external_id").unionByName(firsts)


def store_index(index: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """The index as a table in buckets by (index_name, key), sorted by them: what looks up in it is dealt into the same buckets, the index itself stays where it is."""
    dealt = index.repartition(buckets, "index_name", "key")  # a file a bucket
    dealt.write.mode("overwrite").bucketBy(buckets, "index_name", "key").sortBy("index_name", "key").option("path", path).saveAsTable(name)
    return index.sparkSession.table(name)


def look_up(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, chunk_id, pos: what the first probe of each query (query_id, text) finds in the index; a section without a subsection finds all of it."""
    asked = queries.select("query_id", probe(F.col("text")).alias("p")).select("query_id", "p.index_name", "p.key", F.col("p.sub").alias("want"))
    return asked.join(index, ["index_name", "key"]).where(F.col("want").isNull() | (F.col("want") == F.col("sub"))).select("query_id", "chunk_id", "pos")


def match_parties(queries: DataFrame, judgments: DataFrame) -> DataFrame:
    """queries: query_id, one, two (two may be null); judgments: external_id, petitioner, respondent. query_id, external_id, reason by
    precedence: both parties in either order, one party as petitioner, one as respondent. Equi-joins on normalised keys."""
    q = queries.select("query_id", T.normalize_party(F.col("one")).alias("n1"), T.normalize_party(F.col("two")).alias("n2"))
    j = judgments.select("external_id", T.normalize_party(F.col("petitioner")).alias("p"), T.normalize_party(F.col("respondent")).alias("r"))
    fine = lambda c: F.length(c) >= 3
    pair = lambda a, b: F.array_join(F.array_sort(F.array(a, b)), "\x01")
    both = q.where(fine("n1") & fine("n2")).withColumn("key", pair(F.col("n1"), F.col("n2"))).join(j.withColumn("key", pair(F.col("p"), F.col("r"))), "key")
    names = q.select("query_id", F.explode(F.array("n1", "n2")).alias("name")).where(fine("name")).distinct()
    sides = j.select("external_id", F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.col("p").alias("name")), F.struct(F.lit(2).alias("rank"), F.col("r").alias("name")))).alias("s")).select("external_id", "s.rank", "s.name")
    single = names.join(sides, "name").select("query_id", "external_id", "rank")
    found = both.select("query_id", "external_id", F.lit(0).alias("rank")).unionByName(single).groupBy("query_id", "external_id").agg(F.min("rank").alias("rank"))
    return found.select("query_id", "external_id", F.element_at(F.array(F.lit("both"), F.lit("petitioner"), F.lit("respondent")), F.col("rank") + 1).alias("reason"))


def match_substring(queries: DataFrame, judgments: DataFrame) -> DataFrame:
    """query_id, external_id, side: parties that contain one of a query's names or are contained in it. Names meet at their rarest run of
    characters (names.related), as distinct names; judgments and queries are looked up by what was found."""
    parts = F.array(T.normalize_party(F.col("one")), *([T.normalize_party(F.col("two"))] if "two" in queries.columns else []))
    q = queries.select("query_id", F.explode(parts).alias("name")).where(F.length("name") >= 3).distinct()
    sides = F.array(*[F.struct(F.lit(rank).alias("rank"), F.col(c).alias("said")) for rank, c in enumerate(("petitioner", "respondent"))])
    said = judgments.select("external_id", F.explode(sides).alias("s")).select("external_id", "s.rank", "s.said").where("said is not null")
    # normalising is dear: each name once, over all cores however small the files are
    clean = said.select("said").distinct().repartition(4 * judgments.sparkSession.sparkContext.defaultParallelism, "said").select("said", T.normalize_party(F.col("said")).alias("name"))
    j = said.join(clean.hint("merge"), "said").select("external_id", "rank", "name").where(F.length("name") >= 3)
    q, j = cut(q), cut(j)  # names are read several times
    found = q.join(names.related(q, j).withColumnRenamed("x", "name").hint("merge"), "name").select("query_id", F.col("y").alias("name")).distinct()
    best = found.join(j.hint("merge"), "name").groupBy("query_id", "external_id").agg(F.min("rank").alias("rank"))
    return best.select("query_id", "external_id", F.when(F.col("rank") == 0, "petitioner").otherwise("respondent").alias("side"))


REASONS = ["citation", "case_number", "both", "petitioner", "respondent", "substring"]


def find_judgments(queries: DataFrame, judgments: DataFrame) -> DataFrame:
    """queries: query_id, citation, case_number, one, two; judgments: external_id, citation, case_number, petitioner, respondent. query_id,
    external_id, reason: by citation, by case number, by both parties, by one, and only where no party was hit exactly, by a part of
    a name. The first reason that holds counts. All but the last are equi-joins on normalised keys."""
    keyed = lambda df, c, norm: df.select(*[x for x in ("query_id", "external_id") if x in df.columns], norm(F.col(c)).alias("key")).where("key <> ''")
    rows = None
    for rank, (c, norm) in enumerate((("citation", T.normalize_citation), ("case_number", T.core_case_number))):
        got = keyed(queries, c, norm).join(keyed(judgments, c, norm), "key").select("query_id", "external_id", F.lit(rank).alias("rank"))
        rows = got if rows is None else rows.unionByName(got)
    at = lambda c: (F.array_position(F.array(*[F.lit(x) for x in REASONS]), F.col(c)) - 1).cast("int")
    exact = match_parties(queries, judgments).select("query_id", "external_id", at("reason").alias("rank"))
    rest = queries.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    part = match_substring(rest, judgments).select("query_id", "external_id", F.lit(5).alias("rank"))
    best = rows.unionByName(exact).unionByName(part).groupBy("query_id", "external_id").agg(F.min("rank").alias("rank"))
    return best.select("query_id", "external_id", F.element_at(F.array(*[F.lit(x) for x in REASONS]), F.col("rank") + 1).alias("reason"))


def match_fuzzy(queries: DataFrame, judgments: DataFrame, high: float = 0.75, low: float = 0.60, top: int = 5) -> DataFrame:
    """query_id, external_id, score, rank: pairs of parties against the two sides of judgments, by a similarity join of the distinct names
    (names.paired)."""
    clean = lambda c: T.normalize_party_ends(F.col(c))
    q = queries.select("query_id", clean("one").alias("a"), clean("two").alias("b"))
    return names.paired(q, judgments.select("external_id", clean("petitioner").alias("p"), clean("respondent").alias("r")), high, low, top)


def bands(scores: Column, width: float = BAND) -> Column:
    """Band numbers for scores in falling order: a band's first score leads it, and all within `width` of the leader belong to it. Scores
    count at six places, so a gap of exactly `width` is within.

    For every score the next leader, if it were one, is found by binary search; the leaders are the chain from the first score on, which
    doubles at each step as the jumps do. So a list of n scores takes about log n passes."""
    wide = round(width * 1e6)

    def whole(xs: Column) -> Column:
        n = F.size(xs)
        rounds = F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int"))

        def following(x: Column, i: Column) -> Column:
            def halve(at: Column, _: Column) -> Column:
                mid = F.shiftright(at["low"] + at["high"], 1)
                beyond = x - F.get(xs, mid) > wide
                closer = F.struct(F.when(beyond, at["low"]).otherwise(mid).alias("low"), F.when(beyond, mid).otherwise(at["high"]).alias("high"))
                return F.when(at["high"] - at["low"] > 1, closer).otherwise(at)

            return F.aggregate(rounds, F.struct(i.cast("int").alias("low"), n.alias("high")), halve, lambda at: at["high"])

        def numbered(after: Column) -> Column:
            def double(at: Column, _: Column) -> Column:
                jump = lambda c: F.coalesce(F.get(at["jump"], c), n)
                return F.struct(F.concat(at["chain"], F.filter(F.transform(at["chain"], jump), lambda c: c < n)).alias("chain"), F.transform(at["jump"], jump).alias("jump"))

            chain = F.aggregate(rounds, F.struct(F.array(F.lit(0)).alias("chain"), after.alias("jump")), double, lambda at: at["chain"])
            return F.flatten(F.transform(chain, lambda c, b: F.array_repeat(b.cast("int"), F.get(after, c) - c)))

        return F.when(n > 0, T.once(F.transform(xs, following), numbered)).otherwise(F.array().cast("array<int>"))

    return T.once(F.transform(scores, lambda s: F.round(s * 1e6).cast("long")), whole)


def priority(kind: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(k) for k in HIERARCHY]), kind)
    return F.when(kind.isNull() | (at == 0), 99).otherwise((at - 1).cast("int"))


def kind_of(chunk_type: Column, doc_type: Column, hsn: Column, sac: Column) -> Column:
    """A chunk's kind: its own, else its document's in lower case with underscores, else that of the code it has, else null."""
    said = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(said(chunk_type), said(F.replace(F.lower(doc_type), F.lit(" "), F.lit("_"))), F.when(hsn.isNotNull(), "hsn").when(sac.isNotNull(), "sac"))


#: Words that tell what a question is about, in order; the first hit counts, inside words too.
INTENTS = [("judgment", ("judgment", "case law", "court")), ("definition", ("define", "what is section", "meaning of")), ("rcm", ("rcm", "reverse charge")), ("rate", ("rate", "gst rate")), ("procedure", ("procedure", "how to")), ("comparison", ("difference", "vs")), ("gstat", ("gstat", "form", "register", "cdr")), ("council", ("council", "meeting"))]
REVENUE_SIDE = ["in favour of revenue", "in favor of revenue", "in favour of department", "in favor of department", "against the taxpayer", "against the assessee", "support the notice", "justify the notice", "authority is correct", "department is correct", "uphold the allegation", "support the allegation", "revenue's position", "department's position", "liability of taxpayer"]
PRIMARY = {"judgment": ["judgment"], "definition": ["definition", "operative", "act"], "procedure": ["rule", "gstat_rule", "gstat_form", "gstat_register"], "gstat": ["rule", "gstat_rule", "gstat_form", "gstat_register"], "council": ["council_decision"]}


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def intent(query: Column) -> Column:
    q, out = F.lower(query), None
    for name, words in INTENTS:
        out = F.when(_any(q, words), name) if out is None else out.when(_any(q, words), name)
    return out.otherwise("general")


def reply_mode(query: Column) -> Column:
    return F.when(_any(F.lower(query), REVENUE_SIDE), "in_favour").otherwise("defensive")


def split_primary(chunks: DataFrame) -> DataFrame:
    """chunks: query_id, rank, intent, chunk_type, complete. Adds primary: complete ones always, else by intent; where a query has none, its first three."""
    wanted = F.create_map(*[x for k, v in PRIMARY.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    flag = F.col("complete") | F.coalesce(F.array_contains(F.try_element_at(wanted, F.col("intent")), F.col("chunk_type")), F.lit(False))
    some = F.max("flag").over(Window.partitionBy("query_id"))
    return chunks.withColumn("flag", flag).withColumn("primary", F.when(some, F.col("flag")).otherwise(F.col("rank") <= 3)).drop("flag")


def chunk_score(kind: Column, decision: Column, mode: Column, similarity: Column) -> Column:
    base = F.when(kind == "judgment", 40).when(kind == "draft_reply", 35).when(kind.isin("notification", "circular", "act", "rule", "section"), 25).otherwise(10)
    good = F.when(mode == "defensive", "In favour of assessee").otherwise("In favour of revenue")
    bad = F.when(mode == "defensive", "In favour of revenue").otherwise("In favour of assessee")
    bonus = F.when((kind == "judgment") & (decision == good), 30).when((kind == "judgment") & (decision == bad), -20).otherwise(0)
    return base + bonus + F.least(F.coalesce(similarity, F.lit(0.5)) * 20, F.lit(20.0))
