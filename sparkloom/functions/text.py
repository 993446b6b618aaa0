"""Text rules as Column -> Column functions. Patterns are Unicode-aware ((?U)) and strip all white space, not only blanks."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _without(x: Column, patterns: list[str], by: str = "") -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p, by), patterns, x)


def squeeze(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


# Citations and case numbers

#: Words that mean nothing in a citation; suffixes of party lists; clauses that add a date.
CITATION_NOISE = [rf"(?U)\b{w}\b" for w in ("no", "number", "of")]
OTHERS = [r"(?Ui)\s*[&,]\s*ors\.?", r"(?Ui)\s*&\s*others?"]
DATED = [rf"(?Ui)\s+{w}\s+\d{{1,2}}[.\-/]\d{{1,2}}[.\-/]\d{{2,4}}.*$" for w in ("dated", r"dt\.?", "on")]


def normalize_citation(x: Column) -> Column:
    return _without(_without(F.lower(F.coalesce(x, F.lit(""))), CITATION_NOISE), [r"(?U)[^\w\s]", r"(?U)\s+"])


def core_case_number(x: Column) -> Column:
    return normalize_citation(_without(F.coalesce(x, F.lit("")), OTHERS + DATED))


def long_publisher(x: Column, short: str, long: str) -> Column:
    """'2023 Short 42' becomes '2023 Long 42', and the match alone stays; other texts stay as they are."""
    pattern = rf"(?i)(\d{{4}})\s+{short}\s+(\d+)"
    return F.when(x.rlike(pattern), F.concat(F.regexp_extract(x, pattern, 1), F.lit(f" {long} "), F.regexp_extract(x, pattern, 2))).otherwise(x)


#: How citations of two publishers are written.
REPORTS, COURT_REPORTS = (r"\d{4}\s*\(\s*\d+\s*\)\s*TMI\s*\d+", r"\d{4}\s*TMI\s*\d+"), (r"\d{4}\s*\(\s*\d+\s*\)\s*SCC\s+\d+", r"\d{4}\s+SCC\s+\d+")


def first_citation(x: Column, house: tuple[str, str] | None = None) -> Column:
    """The first pattern that occurs wins. house: short and long name of a publisher that is written either way, and stands with its long name in the result."""
    own = (rf"\d{{4}}\s+{re.escape(house[1])}\s+\d+", rf"\d{{4}}\s+{re.escape(house[0])}\s+\d+") if house else ()
    found = strip(F.coalesce(*[F.nullif(F.regexp_extract(x, "(?i)" + p, 0), F.lit("")) for p in (*REPORTS, *own, *COURT_REPORTS)]))
    return long_publisher(found, *house) if house else found


#: How case numbers are written.
CASE_NUMBERS = [
    r"(?i)W\.P\.(?:M\.P\.)?No\.?\s*\d+\s+of\s+\d{4}", r"(?i)W\.P\.(?:M\.P\.)?Nos\.?\s*\d+(?:\s*[&,]\s*\d+)*\s+of\s+\d{4}",
    r"(?i)WP\(C\)\.?\s*No\.?\s*\d+\s+of\s+\d{4}", r"(?i)Civil\s+Appeal\s+No\.?\s*\d+\s+of\s+\d{4}",
]
MANY = r"(?i)(W\.P\.(?:M\.P\.)?Nos?\.?)\s*([\d,&\s]+)\s+of\s+(\d{4})"


def case_numbers(x: Column) -> Column:
    """Every case number, plural forms written out one by one, sorted."""
    found = F.flatten(F.array(*[F.regexp_extract_all(x, F.lit(p), F.lit(0)) for p in CASE_NUMBERS]))

    def expand(c: Column) -> Column:
        base = F.replace(F.regexp_extract(c, MANY, 1), F.lit("Nos"), F.lit("No"))
        several = F.transform(F.regexp_extract_all(F.regexp_extract(c, MANY, 2), F.lit(r"\d+"), F.lit(0)), lambda n: F.concat(base, F.lit(" "), n, F.lit(" of "), F.regexp_extract(c, MANY, 3)))
        return F.when((F.contains(c, F.lit("Nos")) | F.contains(c, F.lit("&"))) & c.rlike(MANY), several).otherwise(F.array(c))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(found, expand))))


# Parties

#: Titles, and forms of companies.
TITLES = ["mr", "mrs", "ms", "miss", "dr", "prof", "hon", "justice", "j", "sri", "smt", "shri", "m/s", "messrs"]
COMPANIES = [r"pvt\.?\s*ltd\.?", r"private\s+limited\b", r"ltd\.?\b", r"limited\b", r"inc\.?\b", r"incorporated\b", r"llc\.?\b", r"llp\.?\b", r"co\.?\b", r"company\b", r"corp\.?\b", r"corporation\b"]
START_TITLES = [r"m/s", "messrs", "mr", "mrs", "ms", "dr", "prof", "hon", "justice", "sri", "smt", "shri"]
END_COMPANIES = [r"pvt\.?\s*ltd\.?", r"private\s+limited", r"p\.?\s*ltd\.?", r"ltd\.?", "limited", r"inc\.?", r"llc\.?", r"llp\.?", r"co\.?", "company", r"corp\.?"]


def normalize_party(x: Column) -> Column:
    """For look-ups: titles and forms of companies go wherever they stand."""
    y = _without(F.lower(F.coalesce(x, F.lit(""))), [*OTHERS, r"(?Ui)\s*and\s+others?"])
    y = _without(y, [rf"(?U)\b{t}\.?\b" for t in TITLES] + [rf"(?U)\b{c}" for c in COMPANIES])
    return squeeze(F.regexp_replace(y, r"(?U)[^\w\s]", " "))


def normalize_party_ends(x: Column) -> Column:
    """For attribution: titles go at the start alone, forms of companies at the end alone, one pass each in the order listed."""
    y = _without(F.lower(F.coalesce(x, F.lit(""))), [r"(?U)\s*[&,]\s*ors\.?\s*$", r"(?U)\s*&\s*others?\s*$", r"(?U)\s*and\s+\d+\s+others?\s*$"])
    y = _without(y, [rf"(?U)^{t}\.?\s*" for t in START_TITLES] + [rf"(?U)\s+{c}\s*$" for c in END_COMPANIES])
    return squeeze(F.regexp_replace(y, r"[.,]+", " "))


#: Beginnings that no name has.
NO_NAMES = [r"^\s*on\s+", r"^\s*in\s+", r"^\s*the\s+", r"HC\s+on\s+", r"court\s+", r"judgment\s+", r"case\s+of\s+"]


def valid_party(x: Column) -> Column:
    return reduce(lambda c, p: c & ~x.rlike("(?i)" + p), NO_NAMES, x.rlike("[a-zA-Z]"))


#: How a name looks in prose, what stands between two, and what ends the second.
NAME, VERSUS, AFTER_NAMES = r"([A-Z][A-Za-z\s&.,()]+?)", (r"v\.?", r"vs\.?"), r"(?:\s+\(|$|\s+case|\s+judgment)"


def party_pairs(x: Column) -> Column:
    """array<struct<a, b>>: 'A v. B' and 'A vs B' in prose, valid names only, each unordered pair once."""
    pairs = []
    for word in VERSUS:
        p = rf"{NAME}\s+{word}\s+{NAME}{AFTER_NAMES}"
        pairs.append(F.zip_with(F.regexp_extract_all(x, F.lit(p), F.lit(1)), F.regexp_extract_all(x, F.lit(p), F.lit(2)), lambda a, b: F.struct(strip(a).alias("a"), strip(b).alias("b"))))
    fine = F.filter(F.concat(*pairs), lambda s: valid_party(s["a"]) & valid_party(s["b"]))
    key = lambda s: F.array_sort(F.array(F.lower(s["a"]), F.lower(s["b"])))
    return F.aggregate(fine, F.array().cast("array<struct<a:string,b:string>>"), lambda acc, s: F.when(F.exists(acc, lambda t: key(t) == key(s)), acc).otherwise(F.concat(acc, F.array(s))))


def fuzzy(a: Column, b: Column) -> Column:
    """Mean share of the long tokens' letters that both names have; by tokens alone where a name has no long ones."""
    one, two = (F.array_distinct(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")) for x in (a, b))
    weight = lambda ws: F.aggregate(F.filter(ws, lambda w: F.length(w) > 2), F.lit(0), lambda s, w: s + F.length(w))
    common, w1, w2 = weight(F.array_intersect(one, two)), weight(one), weight(two)
    tokens = F.size(F.array_intersect(one, two)) / F.size(F.array_union(one, two))
    return F.when(a == b, 1.0).when((F.size(one) == 0) | (F.size(two) == 0), 0.0).when((w1 == 0) | (w2 == 0), tokens).otherwise((common / w1 + common / w2) / 2)


# Cleaning and splitting

def clean_page(x: Column) -> Column:
    """Tabs and runs of three blanks become one; lines lose their ends; blank lines never come twice, at the start or at the end."""
    y = F.regexp_replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\t"), F.lit(" ")), " {3,}", " ")
    y = F.regexp_replace(y, r"(?U)[^\S\n]+(?=\n|$)", "")
    y = F.regexp_replace(y, r"\n{3,}", "\n\n")
    return F.regexp_replace(y, r"^\n+|\n+$", "")


#: Blanks around signs and brackets, and what stands for them, in order; how numbers of questions are written.
SPACING = [(r"(?U)\s+([.,!?;:])", "$1"), (r"(?U)([.,!?;:])([^\s\d])", "$1 $2"), (r"(?U)\s*\(\s*", " ("), (r"(?U)\s*\)\s*", ") ")]
QUESTION_NUMBERS = [r"(?i)^(?:Q\.?|Ques\.?|Question)\s*[-:\.]?\s*\d+\s*[\.:-]?\s*", r"^\d+\s*[\.:-]?\s*", r"(?i)^(?:Ques|QUES)\s*[:\.]\s*", r"(?i)^(?:Q|q)\s*[:\.]\s*"]
ANSWER, DASHES = r"(?Ui)\bAns\.?\s*:?\s*", "[-—]{4,}"


def clean_answer(x: Column) -> Column:
    y = squeeze(F.coalesce(x, F.lit("")))
    for pattern, by in SPACING:
        y = F.regexp_replace(y, pattern, by)
    return strip(y)


def clean_minutes(x: Column, boilerplate: str = "Council Secretariat") -> Column:
    return strip(_without(F.regexp_replace(x, r"(?U)\s+", " "), [r"Page\s+\d+", boilerplate]))


def question_answer(x: Column) -> Column:
    """struct<question, answer>: split at 'Ans', else at four dashes, else after the first question mark."""
    text = strip(F.coalesce(x, F.lit("")))
    empty = F.lit("")

    def at(pattern: str) -> Column:
        parts = F.split(text, pattern, 2)
        two = F.struct(clean_answer(parts[0]).alias("question"), clean_answer(F.get(parts, F.lit(1))).alias("answer"))
        return F.when((F.size(parts) == 2) & (two["question"] != "") & (two["answer"] != ""), two)

    parts = F.split(text, r"\?", 2)
    mark = F.struct(F.concat(clean_answer(parts[0]), F.lit("?")).alias("question"), clean_answer(F.get(parts, F.lit(1))).alias("answer"))
    whole = F.struct(clean_answer(text).alias("question"), empty.alias("answer"))
    return F.coalesce(at(ANSWER), at(DASHES), F.when((F.size(parts) == 2) & (mark["answer"] != ""), mark), whole)


def without_number(x: Column) -> Column:
    """The first pattern that changes anything wins."""
    tried = [F.when(F.regexp_replace(x, p, "") != x, F.regexp_replace(x, p, "")) for p in QUESTION_NUMBERS]
    return clean_answer(F.coalesce(*tried, x))


def sentences(x: Column) -> Column:
    return F.filter(F.split(strip(x), r"(?U)(?<=[.!?])\s+"), lambda s: s != "")


def first_sentence(x: Column) -> Column:
    first = F.get(sentences(x), F.lit(0))
    return F.coalesce(first, F.substring(x, 1, 200))


#: Verbs of decisions.
DECIDES = ("decided", "approved", "recommended", "agreed", "resolved")


def decision_sentences(x: Column, verbs: tuple[str, ...] = DECIDES) -> Column:
    return F.filter(sentences(x), lambda s: reduce(lambda c, v: c | F.contains(F.lower(s), F.lit(v)), verbs, F.lit(False)))


#: How texts refer to sections, rules, notifications, forms and codes.
SECTIONS, UNDER = r"(?:Section|Sec\.?)\s+(\d+)\s*(?:\((\d+[A-Za-z]*)\))?", r"(?:u/s|under\s+section)\s+(\d+)"
RULES, NOTIFICATIONS, FORMS = r"Rule\s+(\d+[A-Za-z]*)\s*(?:\((\d+[A-Za-z]*)\))?", r"Notification\s*(?:No\.?)?\s*([\d/\-]+(?:/\d{4})?)", r"(?:Form|GSTAT\s+Form)\s+(\d+[A-Z]*(?:\s+[A-Z]+-\d+)?)"
HSN, SAC = r"HSN\s+(?:Code\s+)?(\d{4,8})", r"SAC\s+(?:Code\s+)?(\d{4,6})"


def references(x: Column) -> Column:
    """struct of sorted distinct sections, rules, notifications, forms, HSN and SAC codes."""
    every = lambda p, g=1: F.regexp_extract_all(x, F.lit("(?i)" + p), F.lit(g))
    sub = lambda p: F.zip_with(every(p, 1), every(p, 2), lambda a, b: F.when(F.coalesce(b, F.lit("")) != "", F.concat(a, F.lit("("), b, F.lit(")"))).otherwise(a))
    done = lambda a: F.array_sort(F.array_distinct(a))
    return F.struct(
        done(F.concat(sub(SECTIONS), every(UNDER))).alias("sections"), done(sub(RULES)).alias("rules"), done(every(NOTIFICATIONS)).alias("notifications"),
        done(every(FORMS)).alias("forms"), done(every(HSN)).alias("hsn_codes"), done(every(SAC)).alias("sac_codes"),
    )


#: How circulars and decisions are named.
CIRCULARS, CASE_LAWS = r"Circular\s+No\.?\s*([\d/.-]+)", r"Vs\.\s*([A-Za-z\s\.]+)"


def authorities(x: Column) -> Column:
    """struct of sorted distinct circulars and other parties of decisions that a text names."""
    done = lambda p: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(p), F.lit(1)), squeeze)))
    return F.struct(done(CIRCULARS).alias("circulars"), done(CASE_LAWS).alias("case_laws"))


def rule_summary(number: Column, title: Column, x: Column, least: int = 30, most: int = 300) -> Column:
    """A rule's first sentence behind its header, cut at `most`; where it has no more than `least` characters, what number and title say."""
    body = strip(F.regexp_replace(x, r"(?s)^(.*?)Rule\s+\d+\.\s*[^\n]*?–", "$1"))
    first = F.get(F.split(body, r"(?<=[.!?]) +"), F.lit(0))
    return F.when(F.length(first) > least, F.left(first, F.lit(most))).otherwise(F.concat(F.lit("Rule "), number, F.lit(" deals with "), title, F.lit(".")))


def slices(x: Column, n: int) -> Column:
    """Pieces of n characters."""
    return F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x), F.lit(n)), lambda i: F.substring(x, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def halves(x: Column, limit: int = 80_000, overlap: int = 2_000, near: int = 500) -> Column:
    """A long text in two: cut at the last newline within `near` of the middle, else in the middle, with an overlap on both sides."""
    mid = F.floor(F.length(x) / 2).cast("int")
    window = F.substring(x, mid - near + 1, F.lit(2 * near))
    back = F.locate("\n", F.reverse(window))
    cut = F.when(back > 0, mid - near + F.length(window) - back).otherwise(mid)
    two = F.array(F.substring(x, F.lit(1), cut + overlap), F.substring(x, F.greatest(cut - overlap, F.lit(0)) + 1, F.length(x)))
    return F.when(F.length(x) > limit, two).otherwise(F.array(x))


def plain_html(x: Column) -> Column:
    """Text of a web page: scripts, styles and comments go, tags become blanks, the commonest entities are read."""
    y = _without(F.coalesce(x, F.lit("")), [r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"], " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        y = F.replace(y, F.lit(entity), F.lit(char))
    return squeeze(y)


# Packing

#: Fixed value: words that head the parts of a judgment.
HEADINGS = r"(?i)facts?|background|issues?|arguments?|submissions?|findings?|analysis|held|decision|conclusion"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def folded(xs: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column, Column]], kind: str) -> Column:
    """struct<state, out>: a fold over xs that hands out values. step(state, x) gives the next state, a value of type kind, and whether it is
    handed out. Values are gathered by stretches of about the root of the number of xs, so that none is copied more often than that."""
    empty = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        state, value, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.when(out, F.concat(acc["out"], F.array(value))).otherwise(acc["out"]).alias("out"))

    def stretch(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), empty.alias("out")), one)
        return once(inner, lambda i: F.struct(i["state"].alias("state"), F.concat(acc["outs"], F.array(i["out"])).alias("outs")))

    def whole(xs: Column) -> Column:
        many = F.greatest(F.ceil(F.sqrt(F.size(xs))), F.lit(1)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(xs) - 1) / many), F.lit(0)).cast("int")), lambda k: F.slice(xs, k * many + 1, many))
        return F.aggregate(parts, F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("outs")), stretch, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["outs"]).alias("out")))

    return once(xs, whole)


CUT = "struct<from:int,to:int,carry:int,raw:boolean>"


def _cut(from_: Column, to: Column, carry: Column, raw: Column) -> Column:
    return F.struct(from_.cast("int").alias("from"), to.cast("int").alias("to"), carry.cast("int").alias("carry"), raw.alias("raw"))


def packed(paragraphs: Column, most: int, compat: bool = False, cue: str | None = None) -> Column:
    """Paragraphs joined by a blank while they fit into `most`; one that is too long stands alone. With compat an empty chunk comes
    first where the first paragraph alone is too long. A paragraph that begins with the cue (a pattern) begins a chunk.

    The fold sees lengths alone and hands out where chunks begin and end; their texts are joined afterwards, each once."""
    right = lambda p: F.regexp_replace(p, r"(?U)\s+$", "")
    left = lambda p: F.regexp_replace(p, r"(?U)^\s+", "")
    sizes = lambda p, i: F.struct(i.cast("int").alias("i"), F.length(p).alias("raw"), F.length(right(p)).alias("right"), F.length(strip(p)).alias("core"), F.length(left(p)).alias("left"), (p.rlike(f"^(?:{cue})") if cue else F.lit(False)).alias("cue"))
    start = F.struct(F.lit(0).alias("from"), F.lit(0).alias("size"), F.lit(0).alias("core"), F.lit(0).alias("left"), F.lit(False).alias("raw"))

    def step(at: Column, p: Column) -> tuple[Column, Column, Column]:
        """size: of the buffer as it stands, core: without white space at its ends, left: if it is one paragraph that did not fit before, which stands
        as it is until another joins it, without white space at its beginning; raw: whether it began with such a one."""
        fits = (at["size"] + p["raw"] + 1 <= most) & ~((at["size"] > 0) & p["cue"])
        more = F.when(p["core"] == 0, at["core"]).when(at["core"] == 0, p["core"]).otherwise(F.greatest(at["core"], at["left"]) + 1 + p["right"])
        begins = ~fits | (at["core"] == 0)
        state = F.struct(
            F.when(begins, p["i"]).otherwise(at["from"]).alias("from"), F.when(fits, more).otherwise(p["raw"]).alias("size"), F.when(fits, more).otherwise(p["core"]).alias("core"),
            F.when(fits, 0).otherwise(p["left"]).alias("left"), (~fits | (at["raw"] & ~begins)).alias("raw"),
        )
        return state, _cut(F.when(at["size"] > 0, at["from"]).otherwise(p["i"]), p["i"], F.lit(0), at["raw"]), ~fits

    def texts(ps: Column) -> Column:
        def chunk(c: Column) -> Column:
            own = F.slice(ps, c["from"] + 1, c["to"] - c["from"])
            whole = c["raw"] & (right(F.coalesce(F.get(own, F.lit(1)), F.lit("x"))) != "")
            first = F.when(whole, F.get(own, F.lit(0))).otherwise(right(F.get(own, F.lit(0))))
            rest = F.transform(F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), right)
            text = F.array_join(F.filter(F.concat(F.array(first), rest), lambda x: x != ""), " ")
            return F.when(c["from"] == c["to"], "").when(c["raw"] & (F.size(own) == 1), first).otherwise(strip(text))

        def all_(f: Column) -> Column:
            last = F.when(f["state"]["size"] > 0, F.array(_cut(f["state"]["from"], F.size(ps), F.lit(0), f["state"]["raw"]))).otherwise(F.array().cast(f"array<{CUT}>"))
            return F.transform(F.concat(f["out"], last), chunk)

        return once(folded(F.transform(ps, sizes), start, step, CUT), all_)

    out = once(paragraphs, texts)
    return out if compat else F.filter(out, lambda c: c != "")


def packed_overlapping(parts: Column, room: Column, overlap: int = 200) -> Column:
    """Sentences joined by a blank while they fit into `room`; the next chunk begins with the last `overlap` characters of the one before. A
    single sentence that is too long stands alone, and nothing is carried over from it.

    What a chunk carries is the end of the sentences before its first, so the fold needs no text: it hands out first and last sentence and the
    number of characters carried."""
    start = F.struct(F.lit(0).alias("from"), F.lit(0).alias("carry"), F.lit(0).alias("size"))

    def step(at: Column, s: Column) -> tuple[Column, Column, Column]:
        empty = at["size"] == 0
        test = F.when(empty, s["size"]).otherwise(at["size"] + 1 + s["size"])
        over = test > s["room"]
        carry = F.least(at["size"], F.lit(overlap))
        state = F.struct(
            F.when(over | empty, s["i"]).otherwise(at["from"]).alias("from"), F.when(over, carry).when(empty, 0).otherwise(at["carry"]).alias("carry"),
            F.when(over & ~empty, carry + 1 + s["size"]).when(over, 0).otherwise(test).alias("size"),
        )
        return state, _cut(F.when(empty, s["i"]).otherwise(at["from"]), F.when(empty, s["i"] + 1).otherwise(s["i"]), F.when(empty, 0).otherwise(at["carry"]), F.lit(False)), over

    def texts(ps: Column) -> Column:
        def chunk(c: Column) -> Column:
            own = F.array_join(F.slice(ps, c["from"] + 1, c["to"] - c["from"]), " ")
            back = F.greatest(c["from"] - (overlap + 1), F.lit(0))
            before = F.transform(F.slice(ps, back + 1, c["from"] - back), lambda p: F.right(p, F.lit(overlap)))
            return strip(F.when(c["carry"] > 0, F.concat(F.right(F.array_join(before, " "), c["carry"]), F.lit(" "), own)).otherwise(own))

        def all_(f: Column) -> Column:
            last = F.when(f["state"]["size"] > 0, F.array(_cut(f["state"]["from"], F.size(ps), f["state"]["carry"], F.lit(False)))).otherwise(F.array().cast(f"array<{CUT}>"))
            return F.transform(F.concat(f["out"], last), chunk)

        sizes = F.transform(ps, lambda p, i: F.struct(i.cast("int").alias("i"), F.length(p).alias("size"), room.cast("int").alias("room")))
        return once(folded(sizes, start, step, CUT), all_)

    return once(parts, texts)


def most_frequent(terms: Column, n: int) -> Column:
    """array<struct<term, times, rank>>: the n most frequent of terms, ties by term: sorted, equal ones stand beside each other."""

    def counted(xs: Column) -> Column:
        heads = F.filter(F.transform(xs, lambda x, i: F.when((i == 0) | (x != F.get(xs, i - 1)), i)), lambda i: i.isNotNull())

        def runs(at: Column) -> Column:
            ends = F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.size(xs)))
            return F.slice(F.zip_with(at, ends, lambda a, e: F.struct((a - e).alias("less"), F.get(xs, a).alias("term"))), 1, F.size(at))  # none of no terms

        best = F.slice(F.array_sort(once(heads, runs)), 1, n)
        return F.transform(best, lambda x, i: F.struct(x["term"].alias("term"), (-x["less"]).cast("long").alias("times"), (i + 1).cast("int").alias("rank")))

    return once(F.array_sort(terms), counted)
