"""Secret scan by a random forest over candidate tokens, with built-in functions only.

Candidates are unbroken tokens of LEAST letters, digits and the signs that keys use, and beside a cue word values of BESIDE characters of
any signs. '=' splits: what stands before it is context, and only padding belongs to a token. In quotes a value ends at the quote; else it
ends at a blank, without closing punctuation. Passwords in addresses (scheme://name:password@host) and the bodies of private key blocks are
candidates, too. Other values with blanks in them are none. The forest removes false positives by
length, character transitions, dictionary coverage, path and neighbouring words, all as small codes. It is trained from labelled
findings: FINDINGS synthetic ones, made here by rule from hashes (keys of public formats in assignments as true ones; names, paths,
versions, numbers, checksums named as such and repeated characters as false ones), which run through the same candidate
search and coding as the corpus. Only counts of code patterns reach the driver.

Defined results: a null or empty text has no findings; rows that share a doc_id are scanned each; a null doc_id, and any long, passes through as it is; an empty table gives an empty
result; further columns are ignored. Results carry a digest of the secret, never the secret. Places are code points.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import trees
from .common import text_of
from .spans import matches, neutral

FINDINGS = 8_000
LEAST = 16
BESIDE = 8
SIGNS = "A-Za-z0-9+/_.-"
TOKEN = rf"(?<![{SIGNS}])(?=[+/_.-]*+[A-Za-z0-9])[{SIGNS}]{{{LEAST},}}+(?:={{1,2}}(?![{SIGNS}=]))?"
#: Words beside a secret; words that name a checksum or an example; common syllables and words of plain text and code.
CUES = r"(?i)(token|secret|passw|passphrase|pwd|\bpw\b|api.?key|access.?key|private.?key|auth|bearer|credential)"
CUE = CUES.removeprefix("(?i)")
#: A cue word, the rest of its name, at most one sign of assignment, and a quote or none. The short test comes first, as it rules most places out.
NEAR = rf"(?<=[\s:=>\"'`])(?=[^\s\"'`:=>])(?<=(?i:{CUE})[A-Za-z0-9_.-]{{0,24}}[\"'`]?\s{{0,3}}(?:[:=]|=>|:=|\s)\s{{0,3}}[\"'`]?)"
QUOTED = "|".join(rf"(?<={q})[^{q}\s]{{{BESIDE},}}+(?={q})" for q in "\"'`")
BARE = rf"(?:(?!&[A-Za-z_]\w*=)[^\s\"'`<>=]){{{BESIDE - 1},}}[^\s\"'`<>=,.;:)\]}}](?:={{1,2}}(?![{SIGNS}=]))?"
IN_URL = r"(?<=:)(?<=://[^\s/@:]{1,64}:)[^\s/@]++(?=@)"
BLOCK = r"(?<=PRIVATE KEY-----)[\sA-Za-z0-9+/=]{32,}+(?=-----END)"
VALUE = rf"{IN_URL}|{BLOCK}|{NEAR}(?:{QUOTED}|{BARE})|{TOKEN}"
#: Texts without any of these hold no candidates but tokens.
HINTS = rf"{CUES}|://[^\s/@:]++:[^\s/@]++@"
PASSWORD = r"(?i)(passw|passphrase|pwd|\bpw\b)"
BENIGN = r"(?i)(sha-?(1|256|512)|md5|checksum|digest|commit|revision|etag|uuid|example|sample|placeholder|dummy|version|build)"
WORDS = r"(?i)(the|and|ing|tion|ent|ers|est|ment|able|with|that|ung|ein|sch|ver|lich|eau|que|aux|elle|ción|mente|ado|path|name|file|test|data|user|http|www|com|org)"
NAMES = ["len", "turns", "digits", "upper", "words", "path", "cue", "benign", "quoted", "repeat", "signs", "vowels", "place"]


def _step(value: Column, *edges: float) -> Column:
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))


def _kind(hit: Column) -> Column:
    """A public format's name, or the alphabet."""
    found = F.when(hit.rlike("^A[KS]IA[A-Z0-9]{16}$"), "access_key").when(hit.rlike("^gh[pousr]_[A-Za-z0-9]{36,}$"), "forge_token")
    found = found.when(hit.rlike("^eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.]"), "web_token").when(hit.rlike("^xox[baprs]-"), "chat_token").when(hit.rlike("^[0-9a-f]+$"), "hex")
    return found.when(hit.rlike(r"^\s[A-Za-z0-9+/=\s]{31,}$"), "key_block").otherwise("token")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, cands: places, kind, digest and codes of every candidate."""
    rows = text_of(docs).select("doc_id", neutral(F.col("text")).alias("text"))
    text = F.col("text")
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    found = F.when(text.rlike(HINTS), matches(text, VALUE)).when(text.rlike(f"[{SIGNS}]{{{LEAST},}}"), matches(text, TOKEN)).otherwise(none)

    def code(x: Column) -> Column:
        hit, n = x["hit"], F.length(x["hit"])
        before = F.when(x["start"] > 0, F.substring(text, F.greatest(x["start"] - 31, F.lit(1)), F.least(x["start"], F.lit(32)))).otherwise(F.lit(""))
        share = lambda pattern: F.length(F.regexp_replace(hit, pattern, "")) * 100 / n
        turns = (n - F.length(F.regexp_replace(hit, r"(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])|(?<=[a-z])(?=[A-Z])", "~"))) * -100 / n
        codes = {
            "len": _step(n, 12, 16, 20, 28, 36, 40, 41, 64), "turns": _step(turns, 10, 20, 30, 45), "digits": _step(share("[^0-9]"), 10, 25, 50, 80), "upper": _step(share("[^A-Z]"), 1, 20, 60),
            "words": _step(100 - share(WORDS), 10, 25, 50), "path": _step(share("[^/.]"), 1, 8), "cue": F.when(before.rlike(PASSWORD), 2).when(before.rlike(CUES), 1).otherwise(0), "benign": F.when(before.rlike(BENIGN), 1).otherwise(0),
            "quoted": F.when(before.rlike("[\"'`=:]\\s?$"), 1).otherwise(0), "repeat": F.when(hit.rlike(r"(.)\1{5}"), 1).otherwise(0),
            "signs": _step(share("[A-Za-z0-9]"), 1, 15, 40), "vowels": _step(share("(?i)[^aeiouyäöüéèóá]"), 12, 25, 50),
            "place": F.when(before.rlike(r"://[^\s/@:]+:$"), 1).when(before.rlike("PRIVATE KEY-----$"), 2).otherwise(0),
        }
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), _kind(hit).alias("kind"), F.sha2(hit, 256).alias("digest"), *[codes[c].cast("int").alias(c) for c in NAMES])

    return rows.select("doc_id", F.transform(found, code).alias("cands"))


def labelled(spark: SparkSession) -> DataFrame:
    """doc_id, text, secret, digest of the secret: the labelled findings."""
    a, b = F.sha1(F.col("id").cast("string")), F.sha2(F.concat(F.lit("x"), F.col("id")), 256)
    wide = F.regexp_replace(F.base64(F.unhex(b)), "=", "")
    plain = F.array(*[F.lit(w) for w in ("token", "secret", "password", "api_key", "auth")])
    word = F.array(*[F.lit(w) for w in ("reading", "mentation", "verlichung", "handler", "configuration", "testdata", "elleaux", "ciónmente", "username", "thening")])
    pick = lambda words, salt: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(salt)), F.size(words)) + 1).cast("int"))
    cue, one, two = pick(plain, 1), pick(word, 2), pick(word, 3)
    password = pick(F.array(*[F.lit(w) for w in ("password", "PASSWORD", "pwd", "pw", "db_passwd", "passphrase")]), 8)
    number = F.pmod(F.xxhash64("id"), F.lit(99999)).cast("string")
    letters = F.translate(wide, "0123456789+/", "qXwZkVbNgRtP")
    lower = F.translate(F.substring(b, 1, 12), "0123456789", "qxwzkvjngt")
    signed = F.concat(F.substring(wide, 1, 4), F.element_at(F.array(*[F.lit(x) for x in "!&$%#@"]), (F.pmod("id", F.lit(6)) + 1).cast("int")), F.substring(wide, 5, 5))
    assign = pick(F.array(*[F.lit(x) for x in ("=", ": ", " = ", ":")]), 6)
    tail = pick(F.array(*[F.lit(x) for x in ("", "", "_value", "_prod")]), 7)
    empty, quote = F.lit(""), F.lit('"')
    right = [
        (F.concat(cue, F.lit(' = "')), a, quote), (F.concat(cue, F.lit(": ")), wide, empty), (F.lit("key "), F.concat(F.lit("AKIA"), F.upper(F.substring(b, 1, 16))), empty),
        (F.concat(cue, F.lit("=")), F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(wide, "[+/]", "x"), 1, 36)), empty), (F.concat(cue, F.lit(" '")), F.substring(b, 1, 32), F.lit("'")),
        (F.lit("aws_access_key_id="), F.concat(F.lit("AKIA"), F.upper(F.substring(b, 1, 16))), empty), (F.lit("aws_secret_access_key="), F.substring(wide, 1, 40), empty), (F.concat(cue, tail, assign), F.substring(letters, 1, 16), empty),
        (F.concat(F.lit("db_"), cue, assign), signed, empty), (F.concat(cue, tail, assign), F.substring(wide, 1, 9), empty), (F.concat(cue, tail, assign), lower, empty), (F.concat(cue, assign, quote), F.concat(signed, F.lit("?")), quote),
        (F.concat(cue, tail, assign), F.concat(F.substring(letters, 1, 6), F.lit("!x9")), empty),
        # passwords made of words: beside a word for passwords the dictionary alone doesn't decide
        (F.concat(password, assign), F.concat_ws("-", one, two, F.reverse(one), two), empty), (F.concat(password, assign, quote), F.concat_ws(".", two, one, F.reverse(two)), quote),
        (F.concat(password, assign), F.concat(F.substring(two, 1, 6), number, F.lit("xyz")), empty),
        (F.concat(F.lit("https://"), one, F.lit(":")), F.substring(F.regexp_replace(wide, "[+/]", "x"), 1, 12), F.lit("@db.example/x")), (F.concat(F.lit("amqp://"), one, F.lit(":")), signed, F.lit("@host")),
        (F.concat(F.lit("postgres://"), one, F.lit(":")), F.concat(F.substring(letters, 1, 5), number), F.lit("@10.0.0.1/db")),
        (F.lit("-----BEGIN RSA PRIVATE KEY-----"), F.concat(F.lit("\n"), wide, F.lit("\n"), F.base64(F.unhex(a)), F.lit("\n")), F.lit("-----END RSA PRIVATE KEY-----")),
        (F.lit("-----BEGIN PRIVATE KEY-----"), F.concat(F.lit("\n"), F.repeat(wide, 3), F.lit("\n")), F.lit("-----END PRIVATE KEY-----")),
    ]
    wrong = [F.concat(F.lit("see "), one, F.lit("/"), two, F.lit("/"), number, F.lit(".html")), F.concat(one, F.lit("_"), two, F.lit("_"), number), F.concat(F.lit("commit "), a), F.concat(F.lit("sha256 checksum: "), b), F.concat(one, F.lit("-"), two, F.lit("-v"), number, F.lit(".0.1")), F.concat(F.lit("phone-"), number, F.lit("-"), number, F.lit("-x1")), F.concat(cue, F.lit('="xxxxxxxxxxxxxxxx12"')), F.concat(F.lit("uuid "), F.substring(a, 1, 8), F.lit("-"), F.substring(a, 9, 4), F.lit("-"), F.substring(a, 13, 4), F.lit("-"), F.substring(b, 1, 12)), F.concat(one, two, number, one, two)]
    # what has no digit, stands beside a cue word, or is all digits or signs
    wrong += [F.upper(F.concat(one, two, one)), F.concat(one, two, one), F.concat(F.initcap(one), F.initcap(two), F.initcap(one)), F.concat(cue, F.lit(" "), one, two), F.concat(cue, assign, one, two), F.concat(cue, assign, F.lit("get"), F.initcap(one), F.initcap(two)), F.concat(cue, assign, one, F.lit("."), two), F.concat(cue, assign, F.lit("your_"), one), F.concat(one, F.lit("_"), two, F.lit("_"), one, F.lit("="), two), F.concat(number, number, number, number), F.concat(F.repeat(F.lit("-"), 20), one), F.concat(cue, F.lit(": ********")), F.concat(cue, F.lit("=/"), one, F.lit("/"), two)]
    wrong += [F.concat(cue, assign, F.concat_ws("-", one, two, one)), F.concat(password, F.lit(": "), one), F.concat(password, F.lit(" "), one, F.lit(" "), two), F.concat(password, assign, F.lit("${"), F.upper(one), F.lit("_"), F.upper(two), F.lit("}")), F.concat(password, assign, F.lit("<your-"), one, F.lit(">"))]
    # placeholders and words where a password or a key would stand
    wrong += [F.concat(F.lit("https://"), one, F.lit(":"), two, F.lit("@host")), F.concat(F.lit("https://user:password@"), one), F.concat(F.lit("amqp://"), one, F.lit(":xxxxxxxx@host")), F.concat(F.lit("ftp://name:${"), F.upper(two), F.lit("}@host")), F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), F.repeat(F.concat(one, F.lit(" "), two, F.lit(" ")), 3), F.lit("\n-----END PRIVATE KEY-----")), F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), F.repeat(F.lit("x"), 64), F.lit("\n-----END PRIVATE KEY-----"))]
    rows = spark.range(FINDINGS).withColumn("secret", (F.col("id") % 2).cast("int"))
    hit = pick(F.array(*[F.struct(x.alias("before"), y.alias("value"), z.alias("after")) for x, y, z in right]), 4)
    rows, hit = rows.withColumn("hit", hit), F.col("hit")
    text = F.when(F.col("secret") == 1, F.concat(hit["before"], hit["value"], hit["after"])).otherwise(pick(F.array(*wrong), 5))
    return rows.select(F.col("id").alias("doc_id"), F.concat(one, F.lit(" "), text, F.lit(" "), two).alias("text"), "secret", F.when(F.col("secret") == 1, F.sha2(hit["value"], 256)).alias("digest"))


def fit(spark: SparkSession) -> list[trees.Node]:
    made = labelled(spark).repartition("doc_id")  # made once, not again for each use of the text
    rows = _each(candidates(made)).join(made.select("doc_id", "digest"), "doc_id")
    rows = rows.select(F.coalesce(F.col("x.digest") == F.col("digest"), F.lit(False)).cast("int").alias("secret"), "x")  # names beside a secret are none
    rows = rows.groupBy(*[F.col(f"x.{n}").alias(n) for n in NAMES]).agg(F.count("*").alias("n"), F.sum("secret").alias("yes")).orderBy(*NAMES).collect()
    return trees.forest(np.array([[r[n] for n in NAMES] for r in rows]), np.array([r["yes"] for r in rows], float), np.array([r["n"] for r in rows], float))


def _each(cands: DataFrame) -> DataFrame:
    """doc_id, x: a row a candidate. explode() would put a filter on the size of cands below, which finds them all once more."""
    return cands.select("doc_id", F.explode_outer("cands").alias("x")).where("x is not null")


def scan(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, start, end, kind, score, secret_sha256: a row for each finding whose score is at least `least`."""
    grown = fit(docs.sparkSession)
    rows = _each(candidates(docs)).select("doc_id", "x.*")
    rows = rows.withColumn("score", F.round(trees.forest_share(grown, NAMES), 6)).where(F.col("score") >= least)
    return rows.select("doc_id", "start", "end", "kind", "score", F.col("digest").alias("secret_sha256"))
