"""Case state: routing of documents, and lists of issues as arrays of structs (id, text, reply, status)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

ISSUE = "struct<id:int,text:string,reply:string,status:string>"


def routing(has_case: Column, unclear: Column, same_case: Column) -> Column:
    return F.when(~has_case, "add").when(unclear, "ask_user").when(same_case, "add").when(~same_case, "new_case").otherwise("ask_user")


def renumbered(issues: Column) -> Column:
    return F.transform(issues, lambda x, i: F.struct((i + 1).cast("int").alias("id"), x["text"].alias("text"), x["reply"].alias("reply"), x["status"].alias("status")))


def merge_fresh(old: Column, fresh: Column) -> Column:
    """Fresh texts in order, numbered anew; a replied old issue with the same first 120 characters takes the place of its text."""

    def pick(text: Column) -> Column:
        same = F.filter(old, lambda o: (F.left(o["text"], F.lit(120)) == F.left(text, F.lit(120))) & (F.coalesce(o["reply"], F.lit("")) != ""))
        new = F.struct(F.lit(0).alias("id"), text.alias("text"), F.lit(None).cast("string").alias("reply"), F.lit("pending").alias("status")).cast(ISSUE)
        return F.coalesce(F.get(same, F.size(same) - 1).cast(ISSUE), new)

    return renumbered(F.transform(fresh, pick))


def pending(issues: Column) -> Column:
    return F.filter(issues, lambda x: F.coalesce(x["reply"], F.lit("")) == "")


def set_reply(issues: Column, id_: Column, reply: Column) -> Column:
    return F.transform(issues, lambda x: F.when(x["id"] == id_, F.struct(x["id"].alias("id"), x["text"].alias("text"), reply.alias("reply"), F.lit("user_edited").alias("status")).cast(ISSUE)).otherwise(x))


def edit(issues: Column, action: Column, ids: Column, text: Column) -> Column:
    """merge: the chosen go and one of the text comes at the end, numbered anew; add: one more with the next number; correct: the chosen get the text and
    lose their reply; remove: the chosen go, numbered anew."""
    chosen = lambda x: F.array_contains(ids, x["id"])
    rest = F.filter(issues, lambda x: ~chosen(x))
    top = F.coalesce(F.array_max(F.transform(issues, lambda x: x["id"])), F.lit(0))
    made = lambda n: F.array(F.struct(n.cast("int").alias("id"), text.alias("text"), F.lit(None).cast("string").alias("reply"), F.lit("pending").alias("status")).cast(ISSUE))
    fixed = F.transform(issues, lambda x: F.when(chosen(x), F.struct(x["id"].alias("id"), text.alias("text"), F.lit(None).cast("string").alias("reply"), F.lit("pending").alias("status")).cast(ISSUE)).otherwise(x))
    return F.when(action == "merge", renumbered(F.concat(rest, made(F.lit(0))))).when(action == "add", F.concat(issues, made(top + 1))).when(action == "correct", fixed).when(action == "remove", renumbered(rest)).otherwise(issues)


def without_doubles(texts: Column, least: float = 0.85) -> Column:
    """Keeps the first of texts that contain each other or agree, place by place, in more than `least` of the shorter one."""

    def alike(a: Column, b: Column) -> Column:
        short = F.least(F.length(a), F.length(b))
        equal = F.aggregate(F.zip_with(F.split(F.substring(a, F.lit(1), short), ""), F.split(F.substring(b, F.lit(1), short), ""), lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
        return F.contains(a, b) | F.contains(b, a) | ((short > 0) & (equal / F.greatest(short, F.lit(1)) > least))

    return F.aggregate(texts, F.array().cast("array<string>"), lambda acc, t: F.when(F.exists(acc, lambda k: alike(F.lower(k), F.lower(t))), acc).otherwise(F.concat(acc, F.array(t))))


#: Characters of a block of a text; blocks as short as that always leave some untouched where 85 of 100 characters agree.
SIGNS = 3
#: Characters that are compared at once.
AT_ONCE = 1 << 22


class _Blocks:
    """Texts by their blocks of SIGNS characters at the same place. Two texts that differ in d places of the shorter one at most have all but d of
    its blocks in common, so any d + 1 of them, the rarest, lead to every text that is alike."""

    def __init__(self, texts: list[str], least: float):
        self.least, self.size = least, np.array([len(t) for t in texts], np.int64)
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        many = self.size // SIGNS
        self.first = np.concatenate([[0], np.cumsum(many)])
        owner = np.repeat(np.arange(len(texts)), many)
        place = np.arange(self.first[-1]) - self.first[owner]
        at, sign = self.start[owner] + place * SIGNS, np.zeros(len(owner), np.uint64)
        for k in range(SIGNS):
            sign = (sign << np.uint64(21)) | self.codes[at + k].astype(np.uint64)
        order = np.lexsort((owner, sign, place))
        new = np.ones(len(order), bool)
        new[1:] = (sign[order][1:] != sign[order][:-1]) | (place[order][1:] != place[order][:-1])
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.begin = np.append(np.flatnonzero(new), len(order))
        self.owner = owner[order]

    def alike(self, k: int) -> np.ndarray:
        """Texts, no shorter than text k, that agree with it in more than `least` of its places."""
        m = int(self.size[k])
        d = int(np.ceil(m * (1 - self.least)))
        while d >= 0 and (m - d) / m <= self.least:
            d -= 1
        own = self.group[self.first[k] : self.first[k + 1]]
        if len(own) > d:
            often = self.begin[own + 1] - self.begin[own]
            rare = own[np.argpartition(often, d)[: d + 1]]
            found = np.unique(np.concatenate([self.owner[self.begin[g] : self.begin[g + 1]] for g in rare.tolist()]))
        elif d == 0:
            return np.zeros(0, np.int64)  # the beginning of another text, which holds it
        else:
            found = np.arange(len(self.size))
        found = found[(self.size[found] >= m) & (found != k)]
        text, out = self.codes[self.start[k] : self.start[k] + m], []
        step = max(1, AT_ONCE // m)
        for x in range(0, len(found), step):
            part = found[x : x + step]
            equal = (self.codes[self.start[part][:, None] + np.arange(m)] == text).sum(1)
            out.append(part[equal / m > self.least])
        return np.concatenate([np.zeros(0, np.int64), *out])


def first_of_alike(texts: list[str], least: float = 0.85) -> list[str]:
    """Like without_doubles for long lists, with blanks squeezed; a blank text is like no other, and of equal ones the first stays.

    Texts are taken in order. One that is kept marks what it holds (an automaton finds all texts in it in one pass over it) and what agrees with
    it place by place among those that come after it; one that holds or agrees with a kept one goes. So nothing is compared that shares no rare block."""
    import ahocorasick

    squeezed = [" ".join(t.lower().split()) for t in texts]
    number = {t: k for k, t in enumerate(dict.fromkeys(t for t in squeezed if t))}
    own = list(number)
    gone = np.zeros(len(own), bool)
    if len(own) > 1:
        held, blocks = ahocorasick.Automaton(), _Blocks(own, least)
        for t, k in number.items():
            held.add_word(t, k)
        held.make_automaton()
        for k, t in enumerate(own):
            if gone[k]:
                continue
            inside = np.unique(np.fromiter((i for _, i in held.iter(t)), np.int64))
            near = np.zeros(0, np.int64)
            if not (doubled := bool((~gone[inside[inside < k]]).any())):
                near = blocks.alike(k)
                doubled = bool((~gone[near[near < k]]).any())
            if doubled:
                gone[k] = True
            else:
                gone[inside[inside > k]] = gone[near[near > k]] = True
    seen, out = set(), []
    for text, t in zip(texts, squeezed, strict=True):
        if not t or (t not in seen and not gone[number[t]]):
            out.append(text)
        seen.add(t)
    return out


#: The state that a case is in after an action.
STATES = {"new": "awaiting_decision", "analyse": "awaiting_decision", "decide": "awaiting_mode", "mode": "reply_in_progress", "done": "complete"}


def case_states(events: DataFrame) -> DataFrame:
    """session, case_id, status, state of all cases after all events. events: session, place (their order, unique in a session), action, target.

    'new' opens the next case and makes it the active one, 'switch' makes the case `target` active if there is one of that number, any other
    action of STATES sets the active case's state; actions before the first case and unknown ones change nothing. Running windows by session, so no
    session's events are gathered in one row."""
    so_far = Window.partitionBy("session").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("made", F.count_if(F.col("action") == "new").over(so_far))
    moves = F.when(F.col("action") == "new", F.col("made")).when((F.col("action") == "switch") & F.col("target").between(1, F.col("made")), F.col("target"))
    rows = rows.withColumn("case_id", F.last(moves, ignorenulls=True).over(so_far)).where("case_id is not null")
    state = F.element_at(F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair]), F.col("action"))
    told = rows.withColumn("state", F.when(F.col("action").isin(*STATES), state))
    per = told.groupBy("session", "case_id").agg(F.max_by("state", F.when(F.col("state").isNotNull(), F.col("place"))).alias("state"), F.max("place").alias("last"))
    latest = F.max("last").over(Window.partitionBy("session"))
    return per.select("session", F.col("case_id").cast("int").alias("case_id"), F.when(F.col("last") == latest, "active").otherwise("archived").alias("status"), "state")
