"""Personal data by boosted trees over candidate spans, with built-in functions only.

High-recall generators propose spans, which may overlap: e-mail addresses, dotted quads, digit chains, international and local
phone numbers, account and identity numbers, loosely written addresses. The base rules decide on their own kinds and always stand.
All other spans, of every kind, are judged by boosted trees over small codes of format (kind, length, digits, separators, capitals,
check digits or number ranges of the kind) and context (neighbours, a word that announces data before the span, one that
announces something else).

No table labels spans, so the trees learn from FINDINGS labelled findings made here by rule, for every kind: personal data in
sentences that announce it and in sentences that don't, and look-alikes (part, order and serial numbers, versions, dates, handles,
keys). They run through the same generators and codes as the corpus. Half of them grow the trees; the other half calibrates a
threshold for each kind, at which a share of PRECISION of what it lets through is right; a kind for which that can't be had
adds nothing. Only counts of code patterns reach the driver, CODES of them at most.

Patterns never repeat a group, so no text is too long for the matcher's stack, and each starts only where a run starts, so no run
is searched from all its characters.

Defined results: a null or empty text has no spans; rows that share a doc_id are judged each; a null doc_id, and any long, passes through as it is; an empty table gives an empty
result; further columns are ignored. Places are code points of the text as it is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import trees
from .common import partitions, text_of, unused
from .spans import DOT, MARK, matches, neutral

KINDS = ("email", "ip", "card", "phone", "account", "national_id", "local_phone", "loose_email")
PRECISION = 0.98
FINDINGS = 12_000
LOCAL, DOMAIN = f"A-Za-z0-9._%+{DOT}-", "A-Za-z0-9-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{DOMAIN}]++{DOT}[{DOMAIN}{DOT}]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{MARK}]++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"
LOOSE = r"(?<![^\s])[^\s@]++@[^\s@]*[^\s@,.;:!?)>\]\"']"
#: Words that announce personal data.
CUES = r"(?i)\b(e-?mail|mail|phone|tel|fon|call|fax|card|visa|ip|host|iban|konto|account|ssn|contact)\b"
#: Words that announce a number or a name of another sort.
OTHERS = r"(?i)\b(order|part|serial|invoice|item|model|version|batch|sku|ticket|tracking|ref|page|isbn|docket|handle|user|git|build|lot|key)\b"
#: Sizes of the codes; their product bounds the patterns.
SIZES = {"kind": 8, "len": 6, "digits": 5, "seps": 4, "caps": 3, "left": 4, "right": 4, "cue": 2, "other": 2, "check": 2}
CODES = int(np.prod(list(SIZES.values())))
NAMES = list(SIZES)


def _with_dots(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<=[{DOMAIN}])\.(?=[{DOMAIN}])", DOT)


def _joined(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=[0-9])[ -](?=[0-9])", MARK)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _ip_fine(hit: Column) -> Column:
    plain = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(hit, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.coalesce(plain(p).try_cast("int"), F.lit(999)) <= 255))


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,hit:string>>")


def _found(text: Column, kind: str) -> Column:
    """Spans of one generator. A cheap look first: most texts hold none."""
    if kind == "email":
        return F.when(F.contains(text, F.lit("@")), matches(_with_dots(text), EMAIL)).otherwise(_none())
    if kind == "loose_email":
        return F.when(F.contains(text, F.lit("@")), matches(text, LOOSE)).otherwise(_none())
    if kind == "card":
        return F.when(text.rlike(r"[0-9][ -]?[0-9]"), matches(_joined(text), CARD)).otherwise(_none())
    pattern, hint = {"ip": (IP, r"[0-9]\.[0-9]"), "phone": (PHONE, r"\+[0-9]"), "account": (ACCOUNT, "[A-Z]{2}[0-9]{2}"), "national_id": (NATIONAL, "[0-9]-[0-9]"), "local_phone": (LOCAL_PHONE, r"[0-9]{3}\)?[ .-][0-9]{3}")}[kind]
    return F.when(text.rlike(hint), matches(text, pattern)).otherwise(_none())


def _fine(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return _ip_fine(hit)
    if kind == "card":
        return F.length(_digits(hit)).between(13, 19) & F.call_function("luhn_check", _digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(kind == "email")


def _remainder(digits: Column, by: int) -> Column:
    """A long number's remainder, nine digits at a time."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(digits) - 1) / 9).cast("int")), lambda k: F.substring(digits, k * 9 + 1, F.lit(9)))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: F.pmod(acc * F.pow(F.lit(10), F.length(p)).cast("long") + p.cast("long"), F.lit(by)))


def _account_fine(hit: Column) -> Column:
    """Remainder 1 by 97, country code and check digits last, letters as 10 to 35."""
    turned = F.concat(F.substring(hit, 5, 64), F.left(hit, F.lit(4)))
    digits = F.array_join(F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    return _remainder(digits, 97) == 1


def _check(kind: str, hit: Column) -> Column:
    """Check digits or number ranges of a kind."""
    if kind == "account":
        return _account_fine(hit)
    if kind == "national_id":
        return ~hit.rlike("^(000|666|9)") & ~hit.rlike("^...-00") & ~hit.rlike("0000$")
    if kind == "local_phone":
        return F.regexp_replace(hit, "[^0-9]", "").rlike("^[2-9][0-9]{2}[2-9]")
    if kind == "loose_email":
        return hit.rlike(r"^[^@]+@[\p{L}\p{N}][\p{L}\p{N}.-]*[.]\p{L}{2,}$") & ~F.contains(hit, F.lit(".."))
    return _fine(kind, hit)


def _step(value: Column, *edges: int) -> Column:
    """How many edges the value reaches."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))


def _edge(char: Column) -> Column:
    return F.when(F.coalesce(char, F.lit("")) == "", 0).when(char.rlike(r"\s"), 1).when(char.rlike("[A-Za-z0-9]"), 2).otherwise(3)


def _coded(text: Column, k: int, kind: str, found: Column) -> Column:
    def code(x: Column) -> Column:
        hit, n = x["hit"], F.length(x["hit"])
        before = F.when(x["start"] > 0, F.substring(text, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24)))).otherwise(F.lit(""))
        codes = {
            "kind": F.lit(k), "len": _step(n, 8, 12, 16, 20, 28), "digits": _step(F.length(_digits(hit)) * 8 / n, 2, 4, 6, 8),
            "seps": F.least(F.length(F.regexp_replace(hit, rf"[^ ().{MARK}{DOT}-]", "")), F.lit(3)), "caps": _step(F.length(F.regexp_replace(hit, "[^A-Z]", "")), 1, 8),
            "left": _edge(F.right(before, F.lit(1))), "right": _edge(F.substring(text, x["end"] + 1, F.lit(1))), "cue": F.when(before.rlike(CUES), 1).otherwise(0),
            "other": F.when(before.rlike(OTHERS), 1).otherwise(0), "check": F.when(F.coalesce(_check(kind, hit), F.lit(False)), 1).otherwise(0),
        }
        fine = F.coalesce(_fine(kind, hit), F.lit(False))
        return F.struct(F.lit(kind).alias("kind_name"), x["start"].alias("start"), x["end"].alias("end"), fine.alias("fine"), *[codes[c].cast("int").alias(c) for c in NAMES])

    return F.transform(found, code)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, tie, cands: every span that a generator proposes, with its codes, and whether its base rule accepts it."""
    rows = text_of(docs).select("doc_id", F.xxhash64("text").alias("tie"), neutral(F.col("text")).alias("text"))
    # digit chains of other lengths than a card's are too many to be worth judging
    lists = []
    for k, kind in enumerate(KINDS):
        found = _found(F.col("text"), kind)
        if kind == "card":
            found = F.filter(found, lambda x: (x["end"] - x["start"] >= 13) & F.length(_digits(x["hit"])).between(13, 19))
        lists.append(_coded(F.col("text"), k, kind, found))
    return rows.select("doc_id", "tie", F.concat(*lists).alias("cands"))


def labelled(spark: SparkSession) -> DataFrame:
    """doc_id, text, kind, start, end: the labelled findings, a span in a sentence each; kind null where it is a look-alike."""
    h = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    pick = lambda words, salt: F.element_at(F.array(*[F.lit(w) if isinstance(w, str) else w for w in words]), (h(salt, len(words)) + 1).cast("int"))
    digits = lambda salt, n, least=0: F.lpad((h(salt, 10**n - least) + least).cast("string"), n, "0")
    name = pick(["ann.lee", "j_weber", "mara", "tom.b", "li-na", "o.diaz", "kim7", "jörg"], 1)
    host = pick(["mail", "example", "post", "web-de", "uni.bonn", "münchen"], 2)
    country = pick(["DE", "GB", "FR", "NL", "ES"], 3)
    body = F.concat(digits(4, 9), digits(5, 9))
    checked = F.concat(body, (F.ascii(country) - 55).cast("string"), (F.ascii(F.substring(country, 2, 1)) - 55).cast("string"), F.lit("00"))
    account = F.concat(country, F.lpad((98 - _remainder(checked, 97)).cast("string"), 2, "0"), body)
    sep = pick([" ", "-", "."], 6)
    area = F.concat((h(7, 8) + 2).cast("string"), digits(8, 2))
    local = F.concat(F.when(h(9, 3) == 0, F.concat(F.lit("("), area, F.lit(")"))).otherwise(area), sep, (h(10, 8) + 2).cast("string"), digits(11, 2), sep, digits(12, 4))
    national = F.concat(F.lpad((h(13, 665) + 1).cast("string"), 3, "0"), F.lit("-"), F.lpad((h(14, 99) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((h(15, 9999) + 1).cast("string"), 4, "0"))
    loose = F.concat(name, F.lit("@"), host, F.lit("."), pick(["org", "com", "de", "info", "рф"], 16))
    odd = lambda salt: F.concat(digits(salt, 3), F.lit("-"), digits(salt + 1, 2), F.lit("-"), digits(salt + 2, 4))
    letters = F.upper(F.translate(F.substring(F.sha1(F.col("id").cast("string")), 1, 16), "abcdef", "KTZQXW"))
    right = {  # kind: value, words that announce it
        "account": (account, ["IBAN", "account", "my Konto is", "pay to iban:", "acct"]), "national_id": (national, ["SSN", "ssn:", "my SSN is", "social security", "contact SSN"]),
        "local_phone": (local, ["call", "tel", "phone:", "my number is", "fax"]), "loose_email": (loose, ["mail", "e-mail:", "contact", "write to", "email"]),
        "card": (F.concat(F.lit("4"), digits(20, 9), digits(21, 6)), ["card", "visa"]), "ip": (F.concat_ws(".", *[(h(30 + k, 400)).cast("string") for k in range(4)]), ["host", "ip"]), "phone": (F.concat(F.lit("+"), digits(22, 3), F.lit(" "), digits(23, 6), F.lit(" "), digits(24, 9)), ["call", "tel"]),
    }
    wrong = {  # what looks like it, words that announce that
        "account": (F.concat(country, digits(40, 2), letters), ["part", "serial", "key", "batch", "item no"]), "national_id": (odd(41), ["order", "part", "docket", "item", "build"]),
        "local_phone": (F.concat(digits(44, 3), sep, digits(45, 3), sep, digits(46, 4)), ["order", "serial", "ref", "version", "tracking"]), "loose_email": (F.concat(pick(["user", "git", "a", "@", "x=", "{var}"], 47), F.lit("@"), pick(["host", "refs/heads", "12", "home:path", "{0}", "v1"], 48)), ["handle", "git", "version", "ref", "see"]),
        "card": (F.concat(digits(49, 9), digits(50, 6)), ["order", "serial"]), "ip": (F.concat_ws(".", *[(h(51 + k, 900)).cast("string") for k in range(4)]), ["version", "build"]), "phone": (F.concat(F.lit("+"), digits(55, 4)), ["page", "item"]),
    }
    # what breaks the kind's own rule, beside words that announce the kind all the same
    broken = right | {k: (v, right[k][1]) for k, (v, _) in wrong.items()} | {"national_id": (F.concat(F.lit("9"), F.substring(odd(41), 2, 10)), right["national_id"][1]), "local_phone": (F.concat(F.lit("0"), F.substring(wrong["local_phone"][0], 2, 11)), right["local_phone"][1])}
    kinds = list(right)
    rows = spark.range(FINDINGS).select("id", pick(kinds, 60).alias("kind"), h(61, 2).alias("real"), h(63, 4).alias("spoilt"))
    kind, real = F.col("kind"), F.col("real") == 0
    of = lambda table: F.coalesce(*[F.when(kind == k, F.struct(v.alias("value"), pick([*cues, "", ""], 62).alias("cue"))) for k, (v, cues) in table.items()])
    found = F.when(real, of(right)).when(F.col("spoilt") == 0, of(broken)).otherwise(of(wrong))
    rows = rows.select("id", "kind", "real", found.alias("found")).repartition(partitions(spark), "id")  # made once, not for each use
    before = F.concat(pick(["so ", "please ", "see the ", "", "and then "], 64), F.col("found.cue"), F.when(F.col("found.cue") == "", "").otherwise(" "))
    rows = rows.select("id", "kind", "real", before.alias("before"), F.col("found.value").alias("value"), pick(["", " today", ", thanks", ".", " or later"], 65).alias("after"))
    truly = F.when((F.col("real") == 0) & ~F.col("kind").isin("card", "ip", "phone"), F.col("kind"))
    rows = rows.select(F.col("id").alias("doc_id"), F.concat("before", "value", "after").alias("text"), truly.alias("kind"), F.length("before").alias("start"))
    return rows.repartition(partitions(spark), "doc_id", "start")


def fit(spark: SparkSession) -> tuple[float, list[trees.Node], dict[str, float]]:
    """(base score, trees, threshold of each kind) from counts of code patterns of the labelled findings."""
    made = labelled(spark)
    # explode() would put a filter on the size of cands below, which computes them all once more
    rows = candidates(made).select("doc_id", F.explode_outer("cands").alias("x")).where("x is not null").join(made.select("doc_id", "kind", F.col("start").alias("at")), "doc_id")
    right = F.coalesce((F.col("x.kind_name") == F.col("kind")) & (F.col("x.start") == F.col("at")), F.lit(False))
    # spans that a base rule accepts stand anyway and are no question to the trees
    rows = rows.where(~F.col("x.fine")).select((F.col("doc_id") % 2).alias("half"), *[F.col(f"x.{n}").alias(n) for n in NAMES], right.cast("long").alias("yes"))
    rows = rows.groupBy("half", *NAMES).agg(F.count("*").alias("n"), F.sum("yes").alias("yes")).orderBy("half", *NAMES).collect()
    half, x = np.array([r["half"] for r in rows]), np.array([[r[n] for n in NAMES] for r in rows])
    yes, n = np.array([r["yes"] for r in rows], float), np.array([r["n"] for r in rows], float)
    base, grown = trees.boosted(x[half == 0], yes[half == 0], n[half == 0])
    score = 1 / (1 + np.exp(-(base + sum(trees.predict(t, x) for t in grown))))
    least = {}
    for k, kind in enumerate(KINDS):
        at = (half == 1) & (x[:, 0] == k)
        least[kind] = max(0.5, trees.threshold(score[at], yes[at], n[at], PRECISION)) if at.any() else 1.1
    return base, grown, least


def detect(docs: DataFrame, tied: bool = False) -> DataFrame:
    """doc_id, spans: array<struct<kind, start, end, base, score>>, by kind as listed and start: all base spans, and those that
    the trees add, which cross no base span. With tied, also tie, the hash of the text."""
    base, grown, least = fit(docs.sparkSession)
    score = f"1 / (1 + exp(-({base!r}D" + "".join(f" + {trees.expression(t, [f'x.{n}' for n in NAMES])}" for t in grown) + ")))"
    bar = "case x.kind " + " ".join(f"when {k} then {least[kind]!r}D" for k, kind in enumerate(KINDS)) + " end"
    scored = candidates(docs).select("doc_id", "tie", F.expr(f"transform(cands, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'name', x.kind_name, 'base', x.fine, 'bar', {bar}, 'score', {score}))").alias("c"))
    certain = F.filter("c", lambda x: x["base"])
    more = F.filter("c", lambda x: ~x["base"] & (x["score"] >= x["bar"]))
    crosses = lambda x: F.exists("certain", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    rows = scored.select("doc_id", "tie", certain.alias("certain"), more.alias("more"))
    rows = rows.select("doc_id", "tie", F.array_sort(F.concat("certain", F.filter("more", lambda x: ~crosses(x)))).alias("all"))
    return rows.select("doc_id", *(["tie"] if tied else []), F.transform("all", lambda x: F.struct(x["name"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), x["score"].alias("score"))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id, text with each span's characters replaced by its kind in brackets; overlapping spans go together."""
    # rows of one doc_id have texts of their own, so each text's spans go by its hash, too
    doc, tie, spans, order = unused(docs, "__doc", "__tie", "__spans", "__order")
    found = detect(docs, tied=True).select(F.col("doc_id").alias(doc), F.col("tie").alias(tie), F.col("spans").alias(spans)).dropDuplicates([doc, tie])
    rows = docs.join(found, (docs["doc_id"] == F.col(doc)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(tie)), "left")
    rows = rows.withColumn(order, F.array_sort(F.transform(F.coalesce(F.col(spans), F.array().cast(found.schema[spans].dataType)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(docs["text"], acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"))

    text = F.aggregate(order, start, step, lambda acc: F.concat(acc["out"], F.substring(docs["text"], acc["at"] + 1, F.length(docs["text"]))))
    return rows.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (text)."""
    rows = detect(docs)
    said = lambda keep: F.array_join(F.transform(F.filter("spans", keep), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS[:4]]
    return rows.select("doc_id", *counts, F.sha2(said(lambda s: s["base"]), 256).alias("base_sha256"), said(lambda s: s["base"] | True).alias("spans"))
