"""Spelling variants: words that differ by one character, found by rolling hashes of their deletions.

Words are counted on the executors, a table of counts a task, and meet by word. Then every word gives one integer key for itself and
one for each string that a single deletion leaves. With P(i) the polynomial hash of the first i characters and T that of all, in
powers of an odd base B modulo 2 ** 64, deletion i has the hash P(i) + (T - P(i + 1)) / B, so the keys of all words of a batch
come from one cumulative sum. Deleting any of several equal neighbours leaves the same string, so a stretch of them is one key.

Keys are dealt by their top bits, the radix, and sorted in each partition; keys that no other word has go at once, without their words'
texts ever having moved. What is left gets its words again, and a group of equal keys is compared as strings. In a group, all leave
the same string R: R itself and the words that have one character more are one insertion apart, and those that miss a
character at the same place are one replacement apart. A pair of near words meets in exactly one group, so counts of near words are sums over the
groups, and the best near word is the largest over them: each word of a group needs only the group's count and its best two, never
the pairs.

A word's form has at least RATIO times its occurrences, so a chain of forms has 19 steps at most, and the roots are reached by
doubling the steps.

Defined results: null and empty texts have no words; a null doc_id hashes as no digits; rows that share a doc_id are counted each; any
long is a doc_id; words of any length take part, with memory for the word alone; an empty table, or one without words, gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import named, partitions, scratch, small_batches, text_of, tidied

LETTERS = "A-Za-zÀ-ÿ"
MIN_CHARS, MIN_COUNT, RATIO, ONE_IN = 7, 2, 10, 31
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Words that a task counts before it hands them on.
COUNTED = 200_000
#: Keys that a task makes at once, about.
KEYS = 1 << 18
BASE = 0x9E3779B97F4A7C15
INVERSE = np.uint64(pow(BASE, -1, 1 << 64))
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # fixed values: the finaliser of MurmurHash3
S33 = np.uint64(33)
#: Doublings that reach 2 ** 5 steps; a chain has fewer than 20, since counts are below 2 ** 63.
ROUNDS = 5


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> S33)) * M1
    h = (h ^ (h >> S33)) * M2
    return h ^ (h >> S33)


def altered(runs: Counter, doc_id: str | None, min_chars: int, one_in: int) -> Iterator[tuple[str, int]]:
    """A document's words and their counts, with the character that the checksum of document and run takes away."""
    start = zlib.crc32(f"{doc_id or ''}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % one_in == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= min_chars:
            yield run, n


def counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, one_in: int = ONE_IN) -> DataFrame:
    """word, n: the words of at least min_chars code points that occur min_count times or more."""
    small_batches(docs.sparkSession)
    find = re.compile(f"[{LETTERS}]{{{min_chars},}}").findall  # a shorter run cannot become a word

    @tidied
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for frame in frames:
            for doc_id, text in zip(frame.doc_id, frame.text, strict=True):
                for word, n in altered(Counter(find(text.translate(LOWER))), doc_id, min_chars, one_in):
                    total[word] += n
                if len(total) >= COUNTED:
                    yield pd.DataFrame({"word": list(total), "n": list(total.values())})
                    total.clear()
        yield pd.DataFrame({"word": list(total), "n": list(total.values())}).astype({"word": object, "n": "int64"})

    per = named(text_of(docs)).mapInPandas(run, "word string, n long")
    return per.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def points_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, where each word begins and the last ends)."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    return points, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def deletion_keys(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, first, last, key), as places in points: one for each word itself (first is -1) and one for each stretch of equal
    characters, any of which a deletion takes."""
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(points)) - bounds[owner]
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(size.max(initial=0)), BASE, np.uint64))])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(points + np.uint64(1)) * powers[place])])  # wraps, as is meant
    total = sums[bounds[1:]] - sums[bounds[:-1]]
    own = mixed(total + mixed(size.astype(np.uint64)))
    head = np.ones(len(points), bool)
    head[1:] = (points[1:] != points[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(points)) - 1
    of = owner[first]
    prefix, rest = sums[first] - sums[bounds[of]], sums[bounds[of + 1]] - sums[first + 1]
    left = mixed(prefix + rest * INVERSE + mixed((size[of] - 1).astype(np.uint64)))
    nothing = np.full(len(size), -1)
    return np.concatenate([np.arange(len(size)), of]), np.concatenate([nothing, first - bounds[of]]), np.concatenate([nothing, last - bounds[of]]), np.concatenate([own, left])


def keyed(vocabulary: DataFrame) -> DataFrame:
    """key, id, first, last: what a word and its deletions leave."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ids = batch.column("word").to_pylist(), batch.column("id").to_numpy()
            size = np.cumsum([len(w) for w in words])
            for part in np.split(np.arange(len(words)), np.searchsorted(size, np.arange(KEYS, size[-1] if len(size) else 0, KEYS), "right")):
                if len(part):
                    word, first, last, key = deletion_keys(*points_of([words[k] for k in part]))
                    columns = [pa.array(key.view(np.int64)), pa.array(ids[part][word]), pa.array(first, pa.int32()), pa.array(last, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "id", "first", "last"])

    return vocabulary.select("id", "word").mapInArrow(run, "key long, id long, first int, last int")


def by_radix(rows: DataFrame) -> DataFrame:
    """rows dealt by the top bits of key and sorted by it."""
    n = partitions(rows.sparkSession)
    return rows.repartitionById(n, F.pmod(F.shiftrightunsigned("key", 40), F.lit(n)).cast("int")).sortWithinPartitions("key")


@tidied
def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, those whose key another row has."""
    held, before = None, None  # the last row, whose neighbour may come with the next batch; its key's state
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        key = rows.column("key").to_numpy()
        same = key[1:] == key[:-1]
        keep = np.append(same, False) | np.concatenate([[before == key[0]], same])
        out = rows.slice(0, rows.num_rows - 1).filter(pa.array(keep[:-1]))
        if out.num_rows:
            yield out
        held = rows.slice(rows.num_rows - 1)
        before = key[-2] if len(key) > 1 else before
    if held is not None and before == held.column("key")[0].as_py():
        yield held


def best_two(entries: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The two largest counts; ties go to the smallest word by code points."""
    return sorted(entries, key=lambda e: (-e[0], e[1]))[:2]


def met(group: list[tuple[int, int, int, str, int]]) -> Iterator[tuple[int, int, int, str]]:
    """(id, near words, count and text of the best) from the rows (id, first, last, word, n) of one key: one for each word and
    way in which it meets others."""
    left: dict[str, list] = {}
    for entry in group:
        _, first, _, word, _ = entry
        left.setdefault(word if first < 0 else word[:first] + word[first + 1 :], []).append(entry)
    for entries in left.values():
        if len(entries) < 2:
            continue
        whole = [e for e in entries if e[1] < 0]
        longer = [e for e in entries if e[1] >= 0]
        if whole and longer:  # a word that stands whole is alone with its text
            me = whole[0]
            n, word = best_two([(e[4], e[3]) for e in longer])[0]
            yield me[0], len(longer), n, word
            for e in longer:
                yield e[0], 1, me[4], me[3]
        # the character in one place: a stretch of equal ones stands for all its places
        several = len(longer) > 1
        at: dict[int, list] = {}
        for e in longer if several else ():
            for k in range(e[1], e[2] + 1):
                at.setdefault(k, []).append(e)
        for same in at.values():
            if len(same) > 1:
                best = best_two([(e[4], e[3]) for e in same])
                for e in same:
                    n, word = best[best[0][1] == e[3]]
                    yield e[0], len(same) - 1, n, word


def near(vocabulary: DataFrame) -> DataFrame:
    """id, n_near, near_n, near: how many words of the vocabulary (id, word, n) are one character apart, and the best of them."""
    several = scratch(by_radix(keyed(vocabulary)).mapInArrow(shared, "key long, id long, first int, last int"), "variants-keys")

    @tidied
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, at = [], None
        for frame in frames:
            out = []
            for key, *entry in frame[["key", "id", "first", "last", "word", "n"]].itertuples(index=False, name=None):
                if key != at:
                    out += met(group) if len(group) > 1 else ()
                    group, at = [], key
                group.append(entry)
            yield pd.DataFrame(out, columns=["id", "n_near", "best_n", "best"])
        if len(group) > 1:
            yield pd.DataFrame(list(met(group)), columns=["id", "n_near", "best_n", "best"])

    rows = by_radix(several.join(vocabulary, "id"))
    found = rows.mapInPandas(run, "id long, n_near long, best_n long, best string")
    per = found.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best"))
    return per.select("id", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.word").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that is reached from form to form. forms: word, form."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(ROUNDS):
        then = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch(at.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variants-roots", 4)
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return at


def group(docs: DataFrame, ratio: int = RATIO, **rules: int) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the documents; rules: those of counts()."""
    small_batches(docs.sparkSession)
    vocabulary = scratch(counts(docs, **rules).withColumn("id", F.monotonically_increasing_id()), "variants-words")  # from here on, id stands for a word
    # a word without near ones has no row there
    found = vocabulary.join(near(vocabulary), "id", "left")
    form = (F.col("near_n") >= ratio * F.col("n")) & F.col("near").isNotNull()
    words = found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(form, F.col("near")).alias("form"), F.when(form, F.col("near_n")).alias("form_n"))
    words = scratch(words, "variants-forms")
    ends = roots(words.where("form is not null").select("word", "form"))
    return words.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
