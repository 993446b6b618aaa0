"""Matches of a pattern with their places, by built-in functions: the pieces between matches and the matches themselves give, by
running lengths, where each match starts. Places are code points, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Characters that never mean anything in text; found in one, they are replaced before use.
MARK, DOT, OTHER = "﷐", "﷑", "﷒"


def neutral(text: Column) -> Column:
    """text without the marks; every place stays."""
    return F.translate(F.coalesce(text, F.lit("")), MARK + DOT, OTHER + OTHER)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start int, end int, hit string>> of the leftmost non-overlapping matches; the pattern must not match nothing.

    Places are running lengths, summed in stretches of about the root of the number of matches and then across the stretches:
    appending to one array match by match would copy it each time."""
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("out"))

    def stretch(acc: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda y: F.struct((y["start"] + acc["at"]).alias("start"), (y["end"] + acc["at"]).alias("end"), y["hit"].alias("hit")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def placed(hits: Column) -> Column:
        pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits, lambda p, h: F.struct(F.length(p).alias("gap"), h.alias("hit")))

        def cut(pairs: Column) -> Column:
            many = F.ceil(F.sqrt(F.size(pairs))).cast("int")
            parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / many).cast("int")), lambda k: F.aggregate(F.slice(pairs, k * many + 1, many), F.struct(F.lit(0).alias("at"), empty.alias("out")), step))
            start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,hit:string>>>").alias("out"))
            return F.aggregate(parts, start, stretch, lambda acc: F.flatten(acc["out"]))

        return F.when(F.size(hits) > 0, _once(pairs, cut)).otherwise(empty)

    return _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _once(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)
