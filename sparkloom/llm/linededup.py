"""Exact line deduplication with built-in functions only.

Every line's key is its text stripped of ASCII white space at both ends, with A-Z lower-cased, and stands for it as a
128-bit hash. The hashes are dealt by range together with a block of documents (BLOCKS blocks by a hash of doc_id), with a
secondary sort by document and position, so a line that a third of all documents share is spread over many tasks and one task
never needs all its rows. Streaming through the sorted rows, the first document of each (hash, block) is its leader; all later
documents lose the line at once. Only the leaders, at most BLOCKS rows for a hash, meet in a second exchange, where the smallest
document keeps the line. What comes back for each document is not text but a keep bitmap, packed as alternating runs (kept,
dropped, kept, ...), and only for documents that lose a line.

Defined results: a null or empty text is one empty line and stays; keys under min_chars code points never drop; equal lines
within the first document all stay; rows that share a doc_id count as one document, and each row gets its own bitmap, told from
the others by a hash of its text (rows equal in both get the same); rows without a doc_id keep all lines and take none from
others; any long is a doc_id; an empty table gives an empty result;
further columns pass through rebuild() unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WHITE, partitions, scratch, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCKS = 1024


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_hash(text: Column) -> Column:
    """Tells rows that share a doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, tie (hash of the row's text), pos, h1, h2: one row for each line whose key is long enough."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(F.col("text")).alias("tie"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    rows = rows.where(F.length("line") >= min_chars)
    rows = rows.withColumn("key", F.translate(F.btrim(F.col("line"), F.lit(WHITE)), UPPER, LOWER)).where(F.length("key") >= min_chars)
    return rows.select("doc_id", "tie", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, tie, pos of every line that goes: one row each."""
    lines = scratch(keys(docs, min_chars), "lines")  # read three times: for the ranges, the late and the leaders
    lines = lines.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(BLOCKS)).cast("int"))
    dealt = lines.repartitionByRange(partitions(docs.sparkSession), "h1", "h2", "block")
    per_block = Window.partitionBy("h1", "h2", "block").orderBy("doc_id", "pos")
    led = dealt.withColumn("leader", F.first("doc_id").over(per_block))
    late = led.where("doc_id > leader").select("doc_id", "tie", "pos")
    leaders = led.where("doc_id = leader").groupBy("h1", "h2", "block").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("tie", "pos")).alias("places"))
    first = F.min("doc_id").over(Window.partitionBy("h1", "h2"))
    beaten = leaders.withColumn("first", first).where("doc_id > first").select("doc_id", F.explode("places").alias("place")).select("doc_id", "place.tie", "place.pos")
    return late.unionByName(beaten)


def bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, tie, n_dropped, runs: lengths of alternating kept and dropped runs of lines (what follows the last run is kept)."""
    gone = dropped(docs, min_chars).groupBy("doc_id", "tie").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    # a run starts where the place before is kept, and ends where the place after is: told from neighbours, so nothing is quadratic
    marked = gone.withColumn("before", F.concat(F.array(F.lit(-2)), F.slice("gone", 1, F.size("gone") - 1)))
    marked = marked.withColumn("jumps", F.filter(F.arrays_zip("gone", "before"), lambda x: x["gone"] != x["before"] + 1))
    after = F.concat(F.slice("gone", 2, F.size("gone") - 1), F.array(F.lit(2**31 - 1)))
    marked = marked.withColumn("ends", F.filter(F.arrays_zip("gone", after.alias("after")), lambda x: x["after"] != x["gone"] + 1))
    first = F.transform("jumps", lambda x: x["gone"])
    last = F.transform("ends", lambda x: x["gone"])
    previous = F.concat(F.array(F.lit(-1)), F.slice(last, 1, F.size(last) - 1))
    runs = F.flatten(F.zip_with(F.arrays_zip(first.alias("a"), previous.alias("p")), last, lambda x, z: F.array(x["a"] - x["p"] - 1, z - x["a"] + 1)))
    return marked.select("doc_id", "tie", F.size("gone").cast("long").alias("n_dropped"), runs.alias("runs"))


def kept_text(text: Column, runs: Column) -> Column:
    """The lines that the runs keep, joined again; text itself where there are none."""
    flags = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    lines = F.arrays_zip(lines_of(text).alias("line"), flags.alias("keep"))
    kept = F.transform(F.filter(lines, lambda x: x["line"].isNotNull() & F.coalesce(x["keep"], F.lit(True))), lambda x: x["line"])
    return F.when(runs.isNull(), text).otherwise(F.array_join(kept, "\n"))


def rebuild(docs: DataFrame, min_chars: int = 10, keep_bitmap: bool = False) -> DataFrame:
    """docs with only the kept lines in text, all columns as they were; with keep_bitmap also n_dropped and runs."""
    doc, tie, n, runs = unused(docs, "__doc", "__tie", "__n", "__runs")
    marks = bitmaps(docs, min_chars).select(F.col("doc_id").alias(doc), F.col("tie").alias(tie), F.col("n_dropped").alias(n), F.col("runs").alias(runs))
    joined = docs.join(marks, (docs["doc_id"] == F.col(doc)) & (row_hash(docs["text"]) == F.col(tie)), "left")
    columns = [kept_text(docs["text"], F.col(runs)).alias("text") if c == "text" else docs[c] for c in docs.columns]
    more = [F.coalesce(F.col(n), F.lit(0).cast("long")).alias("n_dropped"), F.col(runs).alias("runs")] if keep_bitmap else []
    return joined.select(*columns, *more)
