"""Mixing sources to target weights, with built-in functions only.

Each source's words, documents in order of doc_id, are packed into blocks of BLOCK words. A source's target in words, divided
by its mean block, is the number of blocks that it should give. The mixture is made of output shards of about SHARD slots, and
for each shard the sources' counts are drawn: every source has the whole part of its expected count, and the slots that are
left are drawn one by one from a multinomial over the fractions that are left. So counts follow the weights in each shard, and the
totals stay as near the targets as a draw over the remainders alone allows. The slots of a source, shard after shard, are numbered, and slot j holds
block perm(j mod blocks) of pass j div blocks, where perm is a swap-or-not shuffle of the source's block numbers, keyed by
source and pass: a permutation of any length that needs no table and no sort. Slots and blocks meet in a join by (source,
block). A pass takes each block once, and slots beyond CAP passes are void, so no document is taken more than that.

Running sums (where a document starts among its source's words, a source's rank, a slot's number) come in two steps: sums of
range partitions, then sums inside each, so no key and no global order is one task.

Defined results: a null or empty text has size 0 and is never taken; null sources form a source of their own, which comes last;
rows that share a doc_id are told apart by the hash of their text, and equal ones by their places; rows without a doc_id come first
in their source and are taken like all others; any long is a doc_id; a source without words has target 0; an empty table gives an empty result; further columns are
ignored by plan() and assign(); passed on by mixture().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WHITE, partitions, scratch, unused

BLOCK = 128
#: Slots of an output shard.
SHARD = 4096
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
CAP = 2.0
ROUNDS = 24
#: Numbers that one row makes in an explode().
A_ROW = 1024
#: Expected counts are multiples of 1 / UNIT, so that their sums are exact in any order.
UNIT = 1 << 16


def n_words(text: Column) -> Column:
    """Words by ASCII white space: a word starts at a character that is not white and follows one that is, or nothing."""
    plain = F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))
    return F.size(F.filter(F.split(plain, " ", -1), lambda w: w != "")).cast("long")


def source_key(source: Column) -> Column:
    """Sorts as the sources do by code point, with null last."""
    return F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source.cast("string")))


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, str], tag: str, narrow: int) -> DataFrame:
    """df with, for each entry name: column of sums, the column's sum over the rows before this one of the same `by`, in order. Rows
    are dealt by range, so neither a group nor the whole is sorted in one task; what is added up in one is a row a partition."""
    spark = df.sparkSession
    dealt = df.repartitionByRange(max(1, partitions(spark) // narrow), *by, *order).withColumn("__part", F.spark_partition_id())
    dealt = scratch(dealt, tag, narrow)
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    per = dealt.groupBy(*by, "__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    per = per.select(*by, "__part", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    rows = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()])
    rows = rows.join(per, [*by, "__part"])
    return rows.select(*df.columns, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums])


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """sizes: src, source_size. Adds weight and target: the budget shared by weight, each at most cap times its size, the excess shared
    anew.

    Sources fill up in order of cap / weight; once one is not full at the level that the rest of the budget gives, none after it is.
    Only that level, the number of words and the sum of the weights come to the driver."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = running(sizes.withColumn("one", F.lit(1)), [], ["src"], {"rank": "one"}, "mix-ranks", 16)
    rows = rows.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("most", F.lit(cap) * F.col("source_size"))
    rows = rows.select("src", "source_size", "weight", "most", (F.col("most") / F.col("weight")).alias("fills"))
    rows = scratch(running(rows, [], ["fills", "src"], {"full": "most", "filled": "weight"}, "mix-fills", 16), "mix-weights", 16)
    words, weight = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    if not words:
        return rows.select("src", "source_size", "weight", F.lit(0.0).alias("target"))
    level = (F.lit(budget * words) - F.col("full")) / (F.lit(weight) - F.col("filled"))
    first = rows.withColumn("level", level).where("fills > level").agg(F.min_by("level", F.struct("fills", "src"))).first()[0]
    target = F.col("most") if first is None else F.least(F.col("most"), F.lit(first) * F.col("weight"))
    return rows.select("src", "source_size", "weight", target.alias("target"))


def counted(df: DataFrame, many: Column, name: str) -> DataFrame:
    """A row for each number from 0 to many - 1, dealt out, A_ROW numbers a row at a time."""
    wide = df.withColumn("__many", many.cast("long")).where("__many > 0").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__many - 1) div {A_ROW}L"))))
    wide = wide.repartition(partitions(df.sparkSession), *df.columns, "__part")
    first = F.col("__part") * A_ROW
    return wide.withColumn(name, F.explode(F.sequence(first, F.least(first + A_ROW, F.col("__many")) - 1))).drop("__many", "__part")


def shuffled(x: Column, n: Column, *key: Column) -> Column:
    """Swap-or-not: x's place in a pseudorandom permutation of 0 .. n - 1."""

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, F.lit("k"), *key), n) - at, n)
        return F.when(F.pmod(F.xxhash64(F.greatest(at, other), r, F.lit("s"), *key), F.lit(2)) == 0, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, swap)


def layout(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, tie, src, size, start; sources: src, source_size, n_blocks, target, want: expected blocks in 1 / UNIT)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("src"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    placed = scratch(running(rows, ["src"], ["doc_id", "tie"], {"start": "size"}, "mix-sizes", 4), "mix-places", 4)
    sources = targets(placed.groupBy("src").agg(F.sum("size").alias("source_size")))
    sources = sources.withColumn("n_blocks", F.ceil(F.col("source_size") / BLOCK).cast("long"))
    want = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size") * UNIT)).otherwise(F.lit(0.0))
    return placed, scratch(sources.withColumn("want", want.cast("long")), "mix-sources", 16)


def shard_counts(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """src, shard, count: how many blocks each source gives to each shard. The whole part of the expectation is given; what is left
    of a shard is drawn from a multinomial over the fractions, a hash for each draw."""
    spark, whole = sources.sparkSession, shards * UNIT
    rows = sources.select("src", F.expr(f"want div {whole}L").alias("sure"), F.expr(f"want % {whole}L").alias("share"))
    sure = counted(rows.where("sure > 0").select("src", "sure"), F.lit(shards), "shard").select("src", "shard", F.col("sure").alias("count"))
    open_ = scratch(running(rows.where("share > 0").select("src", "share"), [], ["src"], {"low": "share"}, "mix-shares", 16), "mix-open", 16)
    n, left = open_.agg(F.count("*"), F.coalesce(F.sum("share"), F.lit(0))).first()
    if not left:
        return sure
    # shard k draws the floor of what all shards up to it are due, less what those before it have drawn
    due = lambda k: F.floor(k * F.lit(left / whole)).cast("long")
    drawing = counted(spark.range(1).select(F.lit(0).alias("zero")), F.lit(shards), "shard").withColumn("draws", due(F.col("shard") + 1) - due(F.col("shard")))
    draws = counted(drawing.select("shard", "draws"), F.col("draws"), "draw").withColumn("at", F.pmod(F.xxhash64("shard", "draw", F.lit(seed), F.lit("draw")), F.lit(left)))
    # a draw looks for its source among those that reach into its bin
    width = max(1, left // (4 * n + A_ROW))
    bins = open_.withColumn("high", F.col("low") + F.col("share")).withColumn("bin", F.explode(F.sequence(F.expr(f"low div {width}L"), F.expr(f"(high - 1) div {width}L"))))
    drawn = draws.withColumn("bin", F.expr(f"at div {width}L")).hint("merge").join(bins, "bin").where("low <= at and at < high")
    return sure.unionByName(drawn.groupBy("src", "shard").agg(F.count("*").alias("count")))


def slots(sources: DataFrame, seed: int = 0) -> DataFrame:
    """src, shard, slot, pass, block: what every slot of the mixture holds. slot counts the source's slots, shard after shard."""
    want = sources.agg(F.coalesce(F.sum("want"), F.lit(0))).first()[0] / UNIT
    counts = shard_counts(sources.where("want > 0"), max(1, round(want / SHARD)), seed).groupBy("src", "shard").agg(F.sum("count").alias("count"))
    each = counted(running(counts, ["src"], ["shard"], {"first": "count"}, "mix-counts", 8), F.col("count"), "nth")
    each = each.join(sources.select("src", "n_blocks"), "src").withColumn("slot", F.col("first") + F.col("nth")).where(F.col("slot") < F.lit(CAP) * F.col("n_blocks"))
    each = each.withColumn("pass", F.expr("slot div n_blocks")).withColumn("place", F.expr("slot % n_blocks"))
    block = shuffled(F.col("place"), F.col("n_blocks"), F.col("src"), F.col("pass"), F.lit(seed))
    return each.select("src", "shard", "slot", "pass", block.alias("block"))


def plan(docs: DataFrame, seed: int = 0) -> DataFrame:
    """src, shard, slot, pass, block: the whole mixture, slot by slot. Words BLOCK * block and on of the source's words, documents in order of
    doc_id, stand in that slot of the shard."""
    return slots(layout(docs)[1], seed)


def assign(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, tie, src, size, source_size, target, taken: words that the mixture takes of each document, repeats counted."""
    placed, sources = layout(docs)
    drawn = slots(sources, seed).groupBy("src", "block").agg(F.count("*").alias("times"))
    end = F.col("start") + F.col("size")
    parts = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {BLOCK}L"), F.expr(f"(start + size - 1) div {BLOCK}L"))))
    overlap = F.least(end, (F.col("block") + 1) * BLOCK) - F.greatest(F.col("start"), F.col("block") * BLOCK)
    parts = parts.select("doc_id", "tie", "src", "start", "block", overlap.alias("overlap"))
    # the estimate of a side made by explode() is far too small, so it must not be broadcast on its word
    taken = parts.join(drawn.hint("merge"), ["src", "block"]).groupBy("src", "start").agg(F.sum(F.col("overlap") * F.col("times")).alias("taken"))
    per = sources.select("src", "source_size", "target")
    # only one row with words starts at a place of a source; rows without any take nothing
    out = placed.join(taken.hint("merge"), ["src", "start"], "left").join(per, "src", "left")
    out = out.withColumn("taken", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long"))
    return out.select("doc_id", "tie", "src", "size", "source_size", "target", "taken")


def mixture(docs: DataFrame, seed: int = 0) -> DataFrame:
    """docs, each row as often as its words are taken on average: taken / size, rounded by a hash of the row, so that rows
    that are barely taken go and rows taken twice stand twice. All columns as they were."""
    doc, tie, times, copies, copy = unused(docs, "__doc", "__tie", "__times", "__copies", "__copy")
    got = assign(docs, seed).where("taken > 0").select(F.col("doc_id").alias(doc), F.col("tie").alias(tie), (F.col("taken") / F.col("size")).alias(times))
    got = got.groupBy(doc, tie).agg(F.max(times).alias(times))
    luck = F.pmod(F.xxhash64(doc, tie, F.lit(seed), F.lit("copy")), F.lit(1 << 20)) / float(1 << 20)
    stand = got.withColumn(copies, F.floor(F.col(times) + luck).cast("int")).where(F.col(copies) > 0)
    rows = docs.join(stand, docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(tie)))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[docs[c] for c in docs.columns])
