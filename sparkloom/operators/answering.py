"""What an answer is made from: one ranked list of complete judgments, statutory hits and neighbours; the lists of an issue; prompts and sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.functions import records as R, text as T
from sparkloom.operators import matching as M
from sparkloom.sources.cut import cut

#: What a complete judgment gains by an exact and by a partial match; the score of a statutory hit; bounds of a similarity.
EXACT, PARTIAL, STATUTORY, LEAST, MOST = 1.0, 0.65, 0.95, 0.3, 1.0
#: Results of a question, of one pass for an issue, primary and supporting ones of an issue, a sibling's similarity.
RESULTS, PASS, PRIMARY, SUPPORTING, SIBLING = 25, 15, 15, 10, 0.4
#: Fixed value: characters of a document that go into a prompt.
DOCUMENT = 12_000


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda acc, p: acc + p)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def retrieve(queries: DataFrame, matches: DataFrame, judgments: DataFrame, statutory: DataFrame, near: DataFrame, chunks: DataFrame, k: int = RESULTS, width: float = M.BAND) -> DataFrame:
    """query_id, rank, chunk_id, chunk_type, score, stage, complete: the best k of each query.

    queries: query_id, q (vector); matches: query_id, external_id, reason (one row each); judgments: external_id, chunk_id, vector (one complete text each);
    statutory: query_id, chunk_id; near: query_id, chunk_id, score, and where it is known `statutory`: that the chunk is a statutory hit as well; chunks: chunk_id, external_id,
    chunk_type.

    A matched judgment stands as one complete text, and none of its chunks stands beside it. Stages in order: exact, partial, statutory,
    near; a chunk's first stage counts. Scores are rounded to six places, so that a gap of exactly `width` is within a band. A band's first
    score leads it; inside a band kinds go by priority. A query's statutory hits have one score, so only the first k of them by kind can be among
    its best, and nothing further than `width` below its k-th score can: both are cut before a query's list is put together."""
    partial = F.col("reason") == "substring"
    similar = F.least(F.greatest(cosine(F.col("q"), F.col("vector")), F.lit(LEAST)), F.lit(MOST))
    whole = matches.join(judgments, "external_id").join(queries, "query_id").select(
        "query_id", "chunk_id", F.lit("judgment").alias("chunk_type"), (similar + F.when(partial, PARTIAL).otherwise(EXACT)).alias("score"), F.when(partial, 1).otherwise(0).alias("stage")
    )
    also = F.col("statutory") if "statutory" in near.columns else F.lit(False)
    hits = statutory.select("query_id", "chunk_id", F.lit(STATUTORY).alias("score"), F.lit(2).alias("stage")).unionByName(near.select("query_id", "chunk_id", F.when(also, STATUTORY).otherwise(F.col("score")).alias("score"), F.when(also, 2).otherwise(3).alias("stage")))
    first = hits.groupBy("query_id", "chunk_id").agg(F.min(F.struct("stage", "score")).alias("m")).select("query_id", "chunk_id", "m.stage", "m.score")
    first = first.join(chunks.select("chunk_id", "external_id", "chunk_type"), "chunk_id").join(matches.select("query_id", "external_id"), ["query_id", "external_id"], "left_anti")
    kind = M.priority(F.col("chunk_type"))
    place = F.row_number().over(Window.partitionBy("query_id", "stage").orderBy(kind, "chunk_id"))  # one pass over both stages: neighbours are dear
    named = first.withColumn("place", place).where((F.col("place") <= k) | (F.col("stage") == 3)).drop("place")
    rows = whole.unionByName(named.select(*whole.columns)).withColumn("score", F.round("score", 6))
    falling = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    lowest = F.max(F.when(F.col("n") == k, F.col("score"))).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("n", falling).withColumn("lowest", lowest).where(F.col("lowest").isNull() | (F.col("score") >= F.col("lowest") - width - 1e-6))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "stage", "chunk_id", "chunk_type"))).alias("xs"))
    zipped = lists.select("query_id", F.explode(F.arrays_zip("xs", M.bands(F.transform("xs", lambda x: -x["low"]), width).alias("band"))).alias("z"))
    out = zipped.select("query_id", "z.xs.chunk_id", "z.xs.chunk_type", (-F.col("z.xs.low")).alias("score"), "z.xs.stage", "z.band")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("band", kind, F.desc("score"), "stage", "chunk_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "chunk_type", "score", "stage", (F.col("stage") < 2).alias("complete"))


def of_topics(topics: DataFrame, chunks: DataFrame, near: DataFrame, k: int = RESULTS) -> tuple[DataFrame, DataFrame]:
    """statutory and near for retrieve, where a query's statutory hits are all chunks of its topic. topics: query_id, topic; chunks (of no judgment): chunk_id, chunk_type,
    topic; near: query_id, chunk_id, score.

    Only the first k of a topic by kind can be among a query's best, so they are taken before queries meet them; of all others it matters alone that a neighbour
    is one. So what is put together grows with queries and neighbours, not with queries times chunks."""
    place = F.row_number().over(Window.partitionBy("topic").orderBy(M.priority(F.col("chunk_type")), "chunk_id"))
    heads = chunks.where("topic is not null").withColumn("place", place).where(F.col("place") <= k).select("topic", "chunk_id")
    held = near.join(topics, "query_id").join(chunks.select("chunk_id", F.col("topic").alias("own")), "chunk_id", "left")
    same = F.coalesce(F.col("topic") == F.col("own"), F.lit(False)).alias("statutory")
    return topics.join(heads, "topic").select("query_id", "chunk_id"), held.select("query_id", "chunk_id", "score", same)


#: What a complete judgment says of itself, where it is known.
HEAD = {"citation": "Citation", "case_number": "Case Number", "petitioner": "Petitioner", "respondent": "Respondent"}


def full_judgments(found: DataFrame, chunks: DataFrame, records: DataFrame, fields: list[str]) -> DataFrame:
    """query_id, place, external_id, fields (blank where missing) and text of the judgments that chunks were found of, each once by its first chunk.
    found: query_id, external_id, rank; chunks: external_id, pos, text; records: external_id and what is known of the fields. Only the chunks
    of found judgments are put together."""
    first = found.groupBy("query_id", "external_id").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "external_id"))
    parts = chunks.join(first.select("external_id").distinct(), "external_id", "left_semi").groupBy("external_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts"))
    said = records.select("external_id", *[(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) if c in records.columns else F.lit("")).alias(c) for c in fields])
    head = F.concat_ws("\n", *[F.when(F.col(c) != "", F.concat(F.lit(f"{label}: "), c)) for c, label in HEAD.items() if c in fields])
    body = F.array_join(F.transform("parts", lambda x: x["text"]), "\n")
    text = F.concat_ws("\n\n", F.nullif(head, F.lit("")), body)
    return first.select("query_id", "external_id", place.alias("place")).join(parts, "external_id").join(said, "external_id").select("query_id", "place", "external_id", *fields, text.alias("text"))


def best_siblings(asked: DataFrame, held: DataFrame, most: int) -> DataFrame:
    """query_id, chunk_id, score: of each issue at least the `most` best chunks of its keys, by score and id. asked: query_id, mode, key; held: chunk_id, mode, key, score,
    a chunk under two keys at most.

    The first `most` of each mode and key are one list, and an issue's lists meet in its row: of them the first 2 * `most` go on, since a chunk stands in two
    of them at most. So an issue hands on as many rows whatever the number of its keys."""
    order = F.row_number().over(Window.partitionBy("mode", "key").orderBy(F.desc("score"), "chunk_id"))
    firsts = held.withColumn("n", order).where(F.col("n") <= most).groupBy("mode", "key").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("low"), "chunk_id"))).alias("xs"))
    lists = firsts.select("mode", "key", F.col("xs.low").alias("lows"), F.col("xs.chunk_id").alias("ids"))  # two plain arrays take half the room of one of structs
    met = asked.join(lists, ["mode", "key"]).groupBy("query_id").agg(F.arrays_zip(F.flatten(F.collect_list("lows")).alias("low"), F.flatten(F.collect_list("ids")).alias("chunk_id")).alias("xs"))
    best = met.select("query_id", F.explode(F.slice(F.sort_array("xs"), 1, 2 * most)).alias("x"))
    return best.select("query_id", F.col("x.chunk_id").alias("chunk_id"), (-F.col("x.low")).alias("score"))


def for_issue(reframed: DataFrame, raw: DataFrame, chunks: DataFrame, modes: DataFrame) -> DataFrame:
    """query_id, rank, chunk_id, score, primary: the two passes of an issue and siblings of the second one, scored by kind, decision and mode.

    reframed, raw: query_id, rank, chunk_id, chunk_type; chunks: chunk_id, chunk_type, decision, section, source; modes: query_id, mode. Siblings share a
    section or a source with a chunk that the raw pass found. Of equal ids the first in order of the passes stays. Of each section and source
    only the best that can be among an issue's results are kept, before siblings meet issues: at most one a chunk of the passes is
    a repetition, so PRIMARY + SUPPORTING + 2 * PASS of them are enough (best_siblings)."""
    known = chunks.select("chunk_id", "decision")
    passes = None
    for number, rows in enumerate((reframed, raw)):
        rows = rows.select("query_id", "chunk_id", "chunk_type", F.lit(number).alias("list"), F.col("rank").cast("long").alias("place"), F.lit(None).cast("double").alias("similarity"))
        passes = rows if passes is None else passes.unionByName(rows)
    passes = cut(passes.join(known, "chunk_id", "left").join(modes, "query_id"))  # read for what it found and for its siblings
    keys = lambda df: df.select("*", F.explode(F.array_compact(F.array(F.concat(F.lit("section:"), F.col("section").cast("string")), F.concat(F.lit("source:"), F.col("source").cast("string"))))).alias("key"))
    score = lambda similarity: F.round(M.chunk_score(F.col("chunk_type"), F.col("decision"), F.col("mode"), similarity), 6)
    held = keys(chunks).select("chunk_id", "chunk_type", "decision", "key", F.explode(F.array(F.lit("defensive"), F.lit("in_favour"))).alias("mode")).withColumn("score", score(F.lit(SIBLING)))
    asked = keys(passes.where("list = 1").select("query_id", "chunk_id", "mode").join(chunks.select("chunk_id", "section", "source"), "chunk_id")).select("query_id", "mode", "key").distinct()
    siblings = best_siblings(asked, held, PRIMARY + SUPPORTING + 2 * PASS).select("query_id", "chunk_id", F.lit(2).alias("list"), F.col("chunk_id").alias("place"), "score")
    rows = passes.withColumn("score", score(F.col("similarity"))).select(*siblings.columns).unionByName(siblings)
    one = rows.groupBy("query_id", "chunk_id").agg(F.min(F.struct("list", "place", "score")).alias("m")).select("query_id", "chunk_id", "m.*")
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "list", "place")))
    return ranked.where(F.col("rank") <= PRIMARY + SUPPORTING).select("query_id", "rank", "chunk_id", "score", (F.col("rank") <= PRIMARY).alias("primary"))


#: Characters of a prompt, pairs of messages that come into it, and messages below which a history that doesn't fit goes altogether.
BUDGET, PAIRS, FLOOR = 360_000, 10, 4


def trimmed(history: DataFrame, fixed: DataFrame, budget: int = BUDGET, pairs: int = PAIRS, floor: int = FLOOR) -> DataFrame:
    """query_id, place, role, content: what of each history goes into its prompt. history: those columns; fixed: query_id, size (characters of all other parts).

    Of the newest `pairs` pairs, the two oldest messages go while all doesn't fit, and all go once `floor` or fewer are left and don't. That is the longest suffix that
    fits, in steps of two: a running sum from the newest on finds it."""
    newest, whole = Window.partitionBy("query_id").orderBy(F.desc("place")), Window.partitionBy("query_id")
    rows = history.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= 2 * pairs)
    so_far = newest.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("size", F.sum(F.coalesce(F.length("content"), F.lit(0))).over(so_far)).withColumn("n", F.count("*").over(whole))
    rows = rows.join(fixed.select("query_id", F.col("size").alias("fixed")), "query_id")
    step = ((F.col("n") - F.col("back")) % 2 == 0) & ((F.col("back") >= floor - 1) | (F.col("back") == F.col("n")))
    keep = F.max(F.when(step & (F.col("fixed") + F.col("size") <= budget), F.col("back"))).over(whole)
    return rows.withColumn("keep", keep).where(F.col("back") <= F.col("keep")).select("query_id", "place", "role", "content")


#: What stands between an answer and the list of what it cites, and around a pair of parties.
CITED, PAIR = "\n\n---\n\n\n**Citations Referenced:**\n", ("\n**", " vs ", ":**")


def attributed(answers: DataFrame, judgments: DataFrame) -> DataFrame:
    """query_id, pair_no, one, two, rank, external_id, citation, case_number, score: judgments of the pairs of parties that answers (query_id, answer) name, the best
    five a pair. judgments: external_id, petitioner, respondent, citation, case_number. Answers that name one pair ask for it once."""
    pairs = answers.select("query_id", F.posexplode(T.party_pairs(F.col("answer"))).alias("pair_no", "s")).select("query_id", "pair_no", F.col("s.a").alias("one"), F.col("s.b").alias("two"))
    asked = pairs.select(F.struct("one", "two").alias("query_id"), "one", "two").distinct()
    found = M.match_fuzzy(asked, judgments).join(judgments.select("external_id", "citation", "case_number"), "external_id")
    found = found.select(F.col("query_id.one").alias("one"), F.col("query_id.two").alias("two"), "rank", "external_id", "citation", "case_number", "score")
    return pairs.join(found, ["one", "two"]).select("query_id", "pair_no", "one", "two", "rank", "external_id", "citation", "case_number", "score")


def with_citations(answers: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, answer: each answer with the list of what was found for its pairs; answers without any stay as they are. The place of a model that writes them into the
    text; a text of another length than records.length_ratio_fits allows would be told by it."""
    line = R.citation_line(F.col("citation"), F.col("case_number"), F.col("score"))
    per = found.groupBy("query_id", "pair_no", "one", "two").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    open_, between, close = (F.lit(x) for x in PAIR)
    block = F.concat(open_, "one", between, "two", close, F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    listed = per.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pair_no", block.alias("block")))), lambda x: x["block"]), "\n").alias("listed"))
    both = answers.join(listed, "query_id", "left")
    return both.select("query_id", F.concat("answer", F.coalesce(F.concat(F.lit(CITED + "\n"), "listed"), F.lit(""))).alias("answer"))


def assemble(questions: DataFrame, retrieved: DataFrame, texts: DataFrame, write: Callable[[Column], Column], document: str | None = None, history: DataFrame | None = None, budget: int = BUDGET, shared: str | None = None) -> DataFrame:
    """query_id, prompt, answer, sources (ids in order, primary ones first). questions: query_id, question, and the column `document` if named; retrieved:
    as of retrieve; texts: chunk_id, block (a chunk in words). write makes an answer of a prompt: the place for a model. history: query_id, place, role, content; as much of it
    as leaves the prompt within its budget comes first (trimmed).

    With shared, questions that have the same value in that column share what was retrieved, which has the column in place of query_id. Such a list is put in
    words once for each intent; questions are told its lengths, and meet its words only where their prompts are written."""
    asked = questions.withColumn("intent", M.intent(F.col("question")))
    keys = ["query_id"] if shared is None else [shared, "intent"]
    lists = asked.select(*dict.fromkeys([*keys, "intent"])).distinct()
    split = M.split_primary(retrieved.join(lists, keys[0]).select(F.struct(*keys).alias("query_id"), "rank", "intent", "chunk_type", "complete", "chunk_id"))
    rows = split.join(texts, "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((~F.col("primary")).alias("later"), "rank", "chunk_id", "block"))).alias("xs"))
    part = lambda later: F.array_join(F.transform(F.filter("xs", lambda x: x["later"] == F.lit(later)), lambda x: x["block"]), "\n\n")
    worded = rows.select("query_id.*", part(False).alias("first"), part(True).alias("second"), F.transform("xs", lambda x: x["chunk_id"]).alias("sources"))
    if shared is not None and history is not None:
        worded = cut(worded)  # read for its lengths and for its words
    given = None if document is None else F.left(F.col(document), F.lit(DOCUMENT))
    words = lambda c: F.coalesce(c, F.lit(""))
    if history is not None:
        lengths = worded.select(*keys, (F.length("first") + F.length("second")).alias("size"))
        sizes = asked.join(lengths, keys, "left").select("query_id", (F.length("question") + F.coalesce("size", F.lit(0))).alias("size"))
        said = trimmed(history, sizes, budget).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", "content"))).alias("said"))
        asked = asked.join(said, "query_id", "left").withColumn("said", F.coalesce("said", F.array().cast("array<struct<place:long,role:string,content:string>>")))
    made = asked.join(worded if shared is None else worded.hint("merge"), keys, "left").withColumn("sources", F.coalesce("sources", F.array().cast(worded.schema["sources"].dataType)))
    made = made.withColumn("prompt", R.prompt(F.col("question"), F.array(words(F.col("first"))), F.array(words(F.col("second"))), given, None if history is None else F.col("said")))
    return made.select("query_id", "prompt", write(F.col("prompt")).alias("answer"), "sources")
