"""Joins of names: by similarity of their words, and by containment. Both work on distinct names, so what a name stands for is never multiplied
before it has been found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.functions import text as T
from sparkloom.sources.cut import cut

#: Slack for sums of doubles; the score itself decides.
EPS = 1e-9
GRAM = 3


def _places(names: DataFrame, df: DataFrame) -> DataFrame:
    """name, token, weight (its length, 0 if it is short), w (sum of weights), n (tokens), from_here and count_here (weight and number of this and all
    later tokens): a name's tokens, rarest first."""
    tokens = names.select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("token"))
    rows = tokens.join(df, "token").withColumn("weight", F.when(F.length("token") > 2, F.length("token")).otherwise(0))
    whole, here = Window.partitionBy("name"), Window.partitionBy("name").orderBy("df", "token").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.select("name", "token", "weight", F.sum("weight").over(whole).alias("w"), F.count("*").over(whole).alias("n"), F.sum("weight").over(here).alias("from_here"), F.count("*").over(here).alias("count_here"))


def _class(w: Column) -> Column:
    return F.floor(F.log2(w)).cast("int")


def _as_larger(rows: DataFrame, least: float) -> DataFrame:
    """Tokens with which the heavier name of a pair can be met: two names that score `least` share that part of its weight at least, so their
    rarest common token has as much of it from there on."""
    rows = rows.where((F.col("weight") > 0) & (F.col("from_here") >= (2 * least - 1) * F.col("w") - EPS))
    return rows.select("token", _class(F.col("w")).alias("class"), "name", "w", "from_here")


def _as_smaller(rows: DataFrame, least: float) -> DataFrame:
    """The same for the lighter one, for each class (power of two) of the heavier one's weight: the further apart, the more of it must be shared."""
    rows = rows.where("weight > 0").withColumn("class", F.explode(F.sequence(_class(F.col("w")), _class(F.col("w") / (2 * least - 1) + EPS))))
    heavy = F.greatest(F.pow(F.lit(2.0), F.col("class")), F.col("w"))
    return rows.where(F.col("from_here") >= 2 * least * F.col("w") * heavy / (F.col("w") + heavy) - EPS).select("token", "class", "name", "w", "from_here")


def similar(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """x, y, s: names (column name, distinct) of left and right whose fuzzy score s is at least `least` (over one half).

    Tokens are ordered by the number of names that have them. A pair meets only at rare ones (a prefix of each name, which the least score
    bounds), and only where what is left of both from there on can still reach the score. So the list of a token that all names have
    is met by names of little else alone. Names without long tokens are compared by number of tokens, in the same way."""
    if not 0.5 < least <= 1:
        raise ValueError("the bounds hold for scores over one half")
    both = left.select("name").union(right.select("name")).distinct()
    df = both.select(F.explode(F.array_distinct(F.split("name", " "))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    a, b = _places(left, df), _places(right, df)
    named = lambda rows, side: rows.select("token", *(["class"] if "class" in rows.columns else []), *[F.col(c).alias(side + c) for c in rows.columns if c not in ("token", "class")])
    reach = F.least("xfrom_here", "yfrom_here") * (1 / F.col("xw") + 1 / F.col("yw")) / 2 >= least - EPS
    up = named(_as_smaller(a, least), "x").join(named(_as_larger(b, least), "y"), ["token", "class"]).where((F.col("xw") <= F.col("yw")) & reach)
    down = named(_as_larger(a, least), "x").join(named(_as_smaller(b, least), "y"), ["token", "class"]).where((F.col("xw") > F.col("yw")) & reach)
    few = lambda rows: rows.where((F.col("weight") == 0) & (F.col("count_here") >= least * F.col("n") - EPS)).select("token", "name", "w", "n")
    short = named(few(a), "x").join(named(few(b), "y"), "token").where(((F.col("xw") == 0) | (F.col("yw") == 0)) & (F.least("xn", "yn") >= least * F.greatest("xn", "yn") - EPS))
    pairs = [rows.select(F.col("xname").alias("x"), F.col("yname").alias("y")) for rows in (up, down, short)]
    met = pairs[0].union(pairs[1]).union(pairs[2]).distinct()
    return met.withColumn("s", T.fuzzy(F.col("x"), F.col("y"))).where(F.col("s") >= least)


def paired(queries: DataFrame, judgments: DataFrame, high: float, low: float, top: int) -> DataFrame:
    """query_id, external_id, score, rank. queries: query_id, a, b; judgments: external_id, p, r; all cleaned.

    Each party takes its better side, the two must point to opposite sides, and the lower of both counts; where any score reaches `high`, only such
    count, else those from `low` on; the best `top` stay. Equal judgments score alike, so the first `top` of them stand for all; equal queries
    are asked once. Of a query's two parties, that whose similar names have fewer judgments is followed to them; the other one is looked up there."""
    cases = cut(judgments.withColumn("nth", F.row_number().over(Window.partitionBy("p", "r").orderBy("external_id"))).where(F.col("nth") <= top).drop("nth"))
    pairs = cases.select("p", "r").distinct()
    asked = queries.select("a", "b").distinct()
    # once as it stands, a for the petitioner, and once the other way round
    both = asked.select(F.col("a").alias("xp"), F.col("b").alias("xr"), F.lit(True).alias("straight")).union(asked.select("b", "a", F.lit(False)))
    own = asked.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    like = cut(similar(own, pairs.select(F.explode(F.array("p", "r")).alias("name")).distinct(), low))  # read six times
    side = lambda c: pairs.groupBy(F.col(c).alias("y")).agg(F.count("*").alias("many"))
    cost = lambda c: like.join(side(c), "y").groupBy(F.col("x").alias(f"x{c}")).agg(F.sum("many").alias(f"cost_{c}"))
    ways = both.join(cost("p"), "xp").join(cost("r"), "xr")
    on = lambda c: like.select(F.col("x").alias(f"x{c}"), F.col("y").alias(c), F.col("s").alias(f"s{c}"))
    by_p = ways.where("cost_p <= cost_r").join(on("p"), "xp").join(pairs, "p").join(on("r"), ["xr", "r"])
    by_r = ways.where("cost_p > cost_r").join(on("r"), "xr").join(pairs, "r").join(on("p"), ["xp", "p"])
    found = by_p.select("xp", "xr", "straight", "p", "r", "sp", "sr").unionByName(by_r.select("xp", "xr", "straight", "p", "r", "sp", "sr"))
    # one party prefers its side, a strictly where it is the petitioner's and b where it is: the other must not prefer the same
    found = found.withColumn("cross_p", T.fuzzy(F.col("xp"), F.col("r"))).withColumn("cross_r", T.fuzzy(F.col("xr"), F.col("p")))
    first = (F.col("sp") > F.col("cross_p")) & (F.col("sr") >= F.col("cross_r"))
    scored = found.where(first).select(
        F.when(F.col("straight"), F.col("xp")).otherwise(F.col("xr")).alias("a"), F.when(F.col("straight"), F.col("xr")).otherwise(F.col("xp")).alias("b"), "p", "r", F.least("sp", "sr").alias("score")
    )
    best = F.max("score").over(Window.partitionBy("a", "b"))
    scored = scored.withColumn("best", best).where(F.col("score") >= F.when(F.col("best") >= high, high).otherwise(low))
    ranked = scored.join(cases, ["p", "r"]).withColumn("rank", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("score"), "external_id"))).where(F.col("rank") <= top)
    return queries.join(ranked.select("a", "b", "external_id", "score", "rank"), ["a", "b"]).select("query_id", "external_id", "score", "rank")


def run_size(n: Column) -> Column:
    """The length of the runs at which names of n characters are looked up: n up to 8, then the next of four steps to each double, so four fifths of n at least."""
    step = F.greatest(F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(n)) - 2)).cast("int")
    return (n - n % step).cast("int")


def grams(name: Column, size: Column) -> Column:
    """Hashes of the distinct runs of size characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - size + 1), lambda i: F.xxhash64(F.substring(name, i, size))))


def containing(short: DataFrame, long: DataFrame) -> DataFrame:
    """x, y: names (column name, distinct, GRAM characters at least) of short that names of long hold.

    A name of short asks at one place alone: at its run of nearly its own length that the fewest names of long hold. Names of long stand under their
    runs of such lengths as names of short have. So few names meet that don't hold one another, and what is made grows with names, not with their pairs; whether they
    do is compared in the end. Names compress well, so no side is to be broadcast by the size of its shuffled files."""
    asked = short.select("name", run_size(F.length("name")).alias("size"))
    whole = F.length("name") == F.col("size")
    used = asked.select("size", whole.alias("whole")).distinct().collect()  # some four a double of the longest name
    if not used:
        return short.select(F.col("name").alias("x"), F.col("name").alias("y"))

    def listed(sizes: set[int]) -> DataFrame:
        fit = F.filter(F.array(*[F.lit(n) for n in sorted(sizes)]), lambda n: n <= F.length("name"))
        return long.select("name", F.explode(fit).alias("size")).select("name", F.explode(grams(F.col("name"), F.col("size"))).alias("gram"))

    rows = asked.where(whole).select(F.col("name").alias("x"), F.xxhash64("name").alias("gram"))
    some = {r["size"] for r in used if not r["whole"]}
    if some:
        df = listed(some).groupBy("gram").agg(F.count("*").alias("df"))
        # a run that no name holds rules the name out: it counts as the rarest
        asks = asked.where(~whole).select("name", F.explode(grams(F.col("name"), F.col("size"))).alias("gram")).join(df.hint("merge"), "gram", "left")
        rarest = asks.groupBy("name").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("m")).where("m.df > 0")
        rows = rows.union(rarest.select("name", "m.gram"))
    met = rows.join(listed({r["size"] for r in used}).withColumnRenamed("name", "y").hint("merge"), "gram")
    return met.where((F.length("x") <= F.length("y")) & F.contains("y", F.col("x"))).select("x", "y")


def related(left: DataFrame, right: DataFrame) -> DataFrame:
    """x, y: names of left and right of which one contains the other, or that are equal."""
    fine = lambda df: df.where(F.length("name") >= GRAM).select("name").distinct()
    a, b = fine(left), fine(right)
    return containing(a, b).union(containing(b, a).select(F.col("y").alias("x"), F.col("x").alias("y")).where("x <> y"))
