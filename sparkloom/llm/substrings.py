"""Long substrings that an earlier document has: a depth-limited radix sort of suffixes.

Only the first `window` bytes of a suffix count, so two suffixes are equal at full depth exactly if a window repeats. They are
ordered by most-significant-digit passes, and after each pass groups from a single document are dropped:

1. First digit: GRAM bytes, those of the window's anchor, its least-hashed place (the leftmost, on ties). Equal windows have the same
   anchor at the same place. Consecutive suffixes that share an anchor form a run and have this digit in common, so this pass
   moves a digit a run (about one byte in sixteen starts one), not a suffix. Three runs in ten are left in prose.
2. Second digit: the bytes beside the anchor, on the left for suffixes that have `side` bytes there, else on the right. Only now do
   bytes of texts move, as fragments that hold the run's suffixes of one kind, dealt by both digits. So a phrase that stands in
   many surroundings is split by what surrounds it.
3. Then the suffixes themselves, byte by byte from the first on, eight bytes a pass, down to the full depth. What is left are groups of
   equal windows; all but the smallest document lose them.

Hashes only drop suffixes (unequal hashes are unequal bytes) and deal them to tasks; whatever is removed has been compared byte by
byte. Documents live in homes of about HOME bytes. A home sends the bytes of each different fragment once, for its smallest document
(other documents' copies are answered at home after a comparison of bytes, the document's own further ones go as places), and a task's part of the corpus sends each digit once: a passage that a
third of all documents share meets as one row a home.

Defined results: matches never cross rows; null and empty texts keep 0 bytes; a text shorter than the window stays whole; rows
that share a doc_id never match each other, and each loses what smaller ids have; rows without a doc_id stay whole and take
nothing from others, as no id is smaller; any long is a doc_id; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, text_of, tidied, tidy

WINDOW, GRAM = 50, 20
#: Bytes of text of a home, and as many for each bucket of digits; bytes that a task gathers before it deals out; bytes that numpy
#: handles at once; suffixes sorted at once.
HOME, GATHER, PART, SORTED = 12_000_000, 6_000_000, 1 << 18, 400_000
PLACE_BITS = 20
NOWHERE = 0xFFFFFFFF
#: Odd multipliers of the hashes.
ODD = np.uint64(0x9E3779B97F4A7C15)
ODD2 = np.uint64(0xD6E8FEB86659FD93)
S29, S32 = np.uint64(29), np.uint64(32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> S29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> S32)


def _eights(raw: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each place on, as numbers."""
    return np.ndarray((max(0, len(raw) - 7),), order + "u8", raw, 0, (1,))


def _parts(width: int) -> list[int]:
    """Where to read eight bytes each so that all of width are read."""
    return [*range(0, width - 8, 8), width - 8]


def hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """Hash of the width (8 at least) bytes from each place on."""
    wide, n = _eights(raw), len(raw) - width + 1
    h = np.full(n, width, np.uint64)
    for at in _parts(width):
        h = (h + wide[at : at + n]) * ODD
        h ^= h >> S32
    return _mix(h)


def hashes_at(raw: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """The same for some places only."""
    wide = _eights(raw)
    h = np.full(len(places), width, np.uint64)
    for at in _parts(width):
        h = (h + wide[places + at]) * ODD
        h ^= h >> S32
    return _mix(h)


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of width values, the place of its least one by the high bits, the leftmost on ties. The low bits hold the
    place, so one minimum finds both."""
    n = len(values) - width + 1
    low = np.uint64((1 << PLACE_BITS) - 1)
    best, reach = (values & ~low) | np.arange(len(values), dtype=np.uint64), 1
    while reach < width:
        step = min(reach, width - reach)
        best = np.minimum(best[: len(best) - step], best[step:])
        reach += step
    return (best[:n] & low).astype(np.int64)


def runs(raw: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first, last, anchor, digit) of the runs in texts that lie one after the other in raw, text i in bounds[i] to
    bounds[i + 1]: starts of the first and the last window, the anchor's place, its hash. Windows never cross bounds."""
    n = len(raw) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, np.zeros(0, np.uint64)
    got = []
    for start in range(0, n, PART):  # parts overlap, and a run that crosses a border is found from both and merged below
        part = raw[start : min(len(raw), start + PART + window - 1)]
        digits = hashes(part, gram)
        at = leftmost_minima(digits, window - gram + 1)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        got.append((digits[at[first]], at[first] + start, first + start))
    digit, anchor, first = (np.concatenate(x) for x in zip(*got, strict=True))
    keep = np.diff(anchor, prepend=-1) != 0
    digit, first, anchor = digit[keep], first[keep], anchor[keep]
    last = np.append(first[1:], n) - 1
    # of a run, only windows inside the anchor's own text are windows at all
    text = np.searchsorted(bounds, anchor, "right") - 1
    first, last = np.maximum(first, bounds[text]), np.minimum(last, bounds[text + 1] - window)
    keep = first <= last
    return text[keep], first[keep], last[keep], anchor[keep], digit[keep]


def repeated(raw: np.ndarray, starts: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """Places in starts of the windows that a smaller document among docs has, too: radix passes over eight bytes each, from the
    most significant on. raw ends with seven spare bytes at least."""
    wide = _eights(raw, ">")
    alive, group = np.arange(len(starts)), None
    for depth in _parts(window):
        digit = wide[starts[alive] + depth].astype(np.uint64)
        order = np.argsort(digit) if group is None else np.lexsort((digit, group))
        alive, digit = alive[order], digit[order]
        new = np.append(True, digit[1:] != digit[:-1])
        if group is not None:
            group = group[order]
            new[1:] |= group[1:] != group[:-1]
        at = np.flatnonzero(new)
        mine = docs[alive]
        several = np.minimum.reduceat(mine, at) != np.maximum.reduceat(mine, at)
        group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(alive))))
        keep = several[group]
        alive, group = alive[keep], group[keep]
        if not len(alive):
            return alive
    at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    mine = docs[alive]
    least = np.repeat(np.minimum.reduceat(mine, at), np.diff(np.append(at, len(alive))))
    return alive[mine > least]


def covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Maximal runs (start, end) of bytes that the spans (rows start, end) cover, touching ones merged."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    at = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[at, 0], np.append(reach[at[1:] - 1], reach[-1])], 1)


# Packed rows: one blob for each receiver


def _squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _expand(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def _cuts(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) of the stretches of equal keys."""
    at = np.append(np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)), len(keys)) if len(keys) else np.zeros(1, int)
    for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield int(keys[x]), x, y


def pack_digits(digit: np.ndarray, home: np.ndarray | None) -> bytes:
    order = np.argsort(digit)
    parts = [struct.pack("<I", len(digit)), np.diff(digit[order], prepend=np.uint64(0)).tobytes()]
    return _squeeze(b"".join([*parts, *([] if home is None else [home[order].astype("<u4").tobytes()])]))


def unpack_digits(blobs, homes: bool) -> tuple[np.ndarray, np.ndarray]:
    digit, home = [np.zeros(0, np.uint64)], [np.zeros(0, "<u4")]
    for blob in blobs:
        data = _expand(blob)
        n = struct.unpack_from("<I", data)[0]
        digit.append(np.cumsum(np.frombuffer(data, "<u8", n, 4), dtype=np.uint64))
        if homes:
            home.append(np.frombuffer(data, "<u4", n, 4 + 8 * n))
    return np.concatenate(digit), np.concatenate(home)


def pack(docs: np.ndarray, turns: np.ndarray, columns: list[np.ndarray], tail: bytes = b"") -> bytes:
    """Rows of documents (doc_id, and the row's turn among those of that id) with columns and bytes."""
    both, ref = np.unique(np.stack([docs, turns]), axis=1, return_inverse=True)
    parts = [struct.pack("<II", len(docs), both.shape[1]), np.diff(both[0], prepend=0).astype("<i8").tobytes(), both[1].astype("<u4").tobytes(), ref.ravel().astype("<u4").tobytes()]
    return _squeeze(b"".join([*parts, *(c.tobytes() for c in columns), tail]))


def unpack(blobs, kinds: tuple[str, ...]) -> tuple[list[np.ndarray], bytes]:
    """([docs, turns, *columns], bytes) of all blobs together."""
    got, tails = [], []
    for blob in blobs:
        data = _expand(blob)
        n, n_docs = struct.unpack_from("<II", data)
        ids, turns = np.cumsum(np.frombuffer(data, "<i8", n_docs, 8)), np.frombuffer(data, "<u4", n_docs, 8 + 8 * n_docs)
        at = 8 + 12 * n_docs
        ref = np.frombuffer(data, "<u4", n, at)
        at, row = at + 4 * n, [ids[ref], turns[ref].astype(np.int64)]
        for kind in kinds:
            row.append(np.frombuffer(data, kind, n, at))
            at += row[-1].nbytes
        got.append(row)
        tails.append(data[at:])
    if not got:
        return [np.zeros(0, np.int64), np.zeros(0, np.int64), *(np.zeros(0, k) for k in kinds)], b""
    return [np.concatenate(x) for x in zip(*got, strict=True)], b"".join(tails)


#: Columns of a fragment: place in its text, bytes, both digits' hash, or for 0 bytes the row that holds the same ones; of an answer:
#: place and bytes.
FRAGMENT, ANSWER = ("<u4", "u1", "<u4"), ("<u4", "<u4")


def _rows(rows: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "key", "blob"]).astype({"kind": "int32", "key": "int64"})


def _home(docs: np.ndarray, n: int) -> np.ndarray:
    return (_mix(docs.astype("<i8").view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _answers(docs: np.ndarray, turns: np.ndarray, start: np.ndarray, size: np.ndarray, homes: int) -> list[tuple[int, int, bytes]]:
    home = _home(docs, homes)
    order = np.lexsort((start, turns, docs, home))
    out = []
    for key, x, y in _cuts(home[order]):
        at = order[x:y]
        out.append((1, key, pack(docs[at], turns[at], [start[at].astype("<u4"), size[at].astype("<u4")])))
    return out


def _joined(first: np.ndarray, last: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places where a stretch starts, places where it ends) of intervals sorted by same and first, joined where they touch or overlap."""
    new = np.append(True, first[1:] > last[:-1])
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    return at, np.append(at[1:], len(first)) - 1


class Texts:
    """A home's texts, one after the other, ordered by doc_id and bytes; a text's turn counts the texts of its id before it."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        rows = sorted(rows)
        self.docs = np.array([d for d, _ in rows], np.int64)
        self.bounds = np.append(0, np.cumsum([len(t) for _, t in rows])).astype(np.int64)
        self.raw = np.frombuffer(b"".join([*(t for _, t in rows), bytes(128)]), np.uint8)
        new = np.flatnonzero(np.append(True, self.docs[1:] != self.docs[:-1])) if rows else np.zeros(0, int)
        self.turns = np.arange(len(rows)) - np.repeat(new, np.diff(np.append(new, len(rows))))

    def of(self, i: int) -> bytes:
        return self.raw[self.bounds[i] : self.bounds[i + 1]].tobytes()


def fold_texts(rows: list[tuple[int, bytes]]) -> bytes:
    head = np.array([[d, len(t)] for d, t in rows], "<i8").reshape(-1, 2)
    return _squeeze(struct.pack("<I", len(rows)) + head.tobytes() + b"".join(t for _, t in rows))


def unfold_texts(blobs) -> list[tuple[int, bytes]]:
    out = []
    for blob in blobs:
        data = _expand(blob)
        n = struct.unpack_from("<I", data)[0]
        at = 4 + 16 * n
        for doc, size in np.frombuffer(data, "<i8", 2 * n, 4).reshape(-1, 2).tolist():
            out.append((doc, data[at : at + size]))
            at += size
    return out


def _gathered(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple[int, bytes]]]:
    rows, size = [], 0
    for frame in frames:
        for doc, text in zip(frame.doc_id, frame.text, strict=True):
            rows.append((doc, text.encode("utf-8", "replace")))
            size += len(rows[-1][1])
            if size >= GATHER:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def fragments(texts: Texts, alive: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first, last, digits): windows whose anchor's digit is among the alive (sorted), by kind, with the hash of both digits."""
    side = (window - gram) // 2
    text, first, last, anchor, digit = runs(texts.raw[: texts.bounds[-1]], texts.bounds, window, gram)
    at = np.minimum(np.searchsorted(alive, digit), max(len(alive) - 1, 0))
    keep = alive[at] == digit if len(alive) else np.zeros(len(digit), bool)
    text, first, last, anchor, digit = text[keep], first[keep], last[keep], anchor[keep], digit[keep]
    out = []
    for kind, x, y, beside in ((1, first, np.minimum(last, anchor - side), anchor - side), (2, np.maximum(first, anchor - side + 1), last, anchor + gram)):
        on = x <= y
        both = _mix(digit[on] * ODD2 + hashes_at(texts.raw, beside[on], side) + np.uint64(kind))
        out.append((text[on], x[on], y[on], both))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def plan(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (binary, pairs of little-endian longs: start, end of every removed run), kept_sha256."""
    if (window - gram) // 2 < 8 or gram < 8:
        raise ValueError("digits of fewer than 8 bytes are not supported")
    small_batches(docs.sparkSession)
    rows = text_of(docs)
    nameless = rows.where("doc_id is null").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lit(b"").alias("spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )
    rows = rows.where("doc_id is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    homes = max(24, -(-int(total) // HOME))
    width = -(-(window + (window - gram + 2) // 2) // 8) * 8  # bytes of the longest fragment, and more

    @tidied
    def first_pass(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Kind 0, by bucket: digits that one document here has, with its home, and once each, without a home, those that several
        have; the homes of these hear of it at once, as kind 1."""
        for gathered in _gathered(frames):
            ids = np.array([d for d, _ in gathered], np.int64)
            bounds = np.append(0, np.cumsum([len(t) for _, t in gathered])).astype(np.int64)
            raw = np.frombuffer(b"".join([*(t for _, t in gathered), bytes(8)]), np.uint8)
            text, _, _, _, digit = runs(raw[: bounds[-1]], bounds, window, gram)
            order = np.lexsort((ids[text], digit))
            digit, doc = digit[order], ids[text][order]
            at = np.flatnonzero(np.append(True, digit[1:] != digit[:-1])) if len(digit) else np.zeros(0, int)
            size = np.diff(np.append(at, len(digit)))
            several = doc[at] != doc[at + size - 1]
            homes_of = _home(doc, homes)
            sent, to = digit[at], np.where(several, NOWHERE, homes_of[at])
            bucket = ((sent >> S32) % np.uint64(homes)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            out = [(0, key, pack_digits(sent[order[x:y]], to[order[x:y]])) for key, x, y in _cuts(bucket[order])]
            known = np.repeat(several, size)
            digit, home = digit[known], homes_of[known]
            order = np.lexsort((digit, home))
            digit, home = digit[order], home[order]
            fresh = np.append(True, (digit[1:] != digit[:-1]) | (home[1:] != home[:-1]))[: len(digit)]
            digit, home = digit[fresh], home[fresh]
            out += [(1, key, pack_digits(digit[x:y], None)) for key, x, y in _cuts(home)]
            yield _rows(out)

    def first_sorted(frame: pd.DataFrame) -> pd.DataFrame:
        """Digits that more than one document may have, by home."""
        if frame.kind.iloc[0] == 1:
            return frame
        digit, home = unpack_digits(frame.blob, True)
        order = np.argsort(digit)
        digit, home = digit[order], home[order]
        at = np.flatnonzero(np.append(True, digit[1:] != digit[:-1])) if len(digit) else np.zeros(0, int)
        size = np.diff(np.append(at, len(digit)))
        alive = np.repeat((size > 1) | (home[at] == NOWHERE), size) & (home != NOWHERE)
        digit, home = digit[alive], home[alive].astype(np.int64)
        order = np.argsort(home, kind="stable")
        return _rows([(1, key, pack_digits(digit[order[x:y]], None)) for key, x, y in _cuts(home[order])])

    @tidied
    def to_homes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for gathered in _gathered(frames):
            home = _home(np.array([d for d, _ in gathered], np.int64), homes)
            order = np.argsort(home, kind="stable")
            yield pd.DataFrame([(key, fold_texts([gathered[i] for i in order[x:y]])) for key, x, y in _cuts(home[order])], columns=["key", "blob"])

    def second_pass(blobs: pd.DataFrame, digits: pd.DataFrame) -> pd.DataFrame:
        """Kind 0, by bucket: fragments, each once, for its smallest document; kind 1, by home: answers known here already."""
        alive = np.unique(unpack_digits(digits.blob, False)[0])
        if not len(blobs) or not len(alive):
            return _rows([])
        texts = Texts(unfold_texts(blobs.blob))
        text, first, last, both = fragments(texts, alive, window, gram)
        # groups of equal fragments: sorted by hash and compared as bytes
        size = (last - first + window).astype(np.int64)
        whole = np.zeros(len(text), np.uint64)
        wide = _eights(texts.raw)
        for at in range(0, width, 8):
            left = np.clip(size - at, 0, 8).astype(np.uint64)
            whole = (whole + (wide[first + at] & np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left * np.uint64(8))) - np.uint64(1)))) * ODD
            whole ^= whole >> S32
        doc, turn, begin = texts.docs[text], texts.turns[text], first - texts.bounds[text]
        order = np.lexsort((turn, doc, size, whole, both))
        head = np.ones(len(order), bool)
        head[1:] = (both[order][1:] != both[order][:-1]) | (whole[order][1:] != whole[order][:-1]) | (size[order][1:] != size[order][:-1])
        at = np.flatnonzero(head)
        lead = np.repeat(order[at], np.diff(np.append(at, len(order)))) if len(order) else order
        mine, theirs = order[order != lead], lead[order != lead]
        same = np.ones(len(mine), bool)
        for at in range(0, width, 8):
            left = np.clip(size[mine] - at, 0, 8).astype(np.uint64)
            mask = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left * np.uint64(8))) - np.uint64(1))
            same &= (wide[first[mine] + at] & mask) == (wide[first[theirs] + at] & mask)
        again = same & (doc[mine] == doc[theirs]) & (turn[mine] == turn[theirs])
        extra, extra_of = mine[again], theirs[again]
        mine = mine[same & (doc[mine] > doc[theirs])]
        by_place = mine[np.lexsort((begin[mine], turn[mine], doc[mine]))]
        out = []
        if len(by_place):
            end = begin[by_place] + size[by_place]
            at, _ = _joined(begin[by_place], end, doc[by_place], turn[by_place])
            end = np.maximum.reduceat(end, at)
            out = _answers(doc[by_place][at], turn[by_place][at], begin[by_place][at], end - begin[by_place][at], homes)
        gone = np.zeros(len(text), bool)
        gone[mine] = gone[extra] = True
        bucket = ((both >> S32) % np.uint64(homes)).astype(np.int64)
        order = np.lexsort((both, bucket))
        order = order[~gone[order]]
        by_bucket = np.argsort(bucket[extra], kind="stable")
        extra, extra_of = extra[by_bucket], extra_of[by_bucket]
        row = np.zeros(len(text), np.int64)
        for key, x, y in _cuts(bucket[order]):
            at = order[x:y]
            row[at] = np.arange(len(at))
            u, v = np.searchsorted(bucket[extra], [key, key + 1])
            more, of = extra[u:v], row[extra_of[u:v]]
            tail = b"".join(texts.raw[a:b].tobytes() for a, b in zip(first[at].tolist(), (first[at] + size[at]).tolist(), strict=True))
            all_ = np.concatenate([at, more])
            columns = [begin[all_].astype("<u4"), np.append(size[at], np.zeros(len(more), int)).astype("u1"), np.append(both[at].astype("<u4"), of.astype("<u4")).astype("<u4")]
            out.append((0, key, pack(doc[all_], turn[all_], columns, tail)))
        tidy()
        return _rows(out)

    def third_pass(frame: pd.DataFrame) -> pd.DataFrame:
        """Answers, by home: windows that a smaller document has."""
        if frame.kind.iloc[0] == 1:
            return frame
        leads, extras, tails, n = [], [], [], 0
        for blob in frame.blob:
            columns, tail = unpack([blob], FRAGMENT)
            lead = columns[3] > 0
            leads.append([c[lead] for c in columns])
            extras.append((columns[4][~lead].astype(np.int64) + n, columns[2][~lead].astype(np.int64)))
            tails.append(tail)
            n += int(lead.sum())
        doc, turn, begin, size, both = (np.concatenate(c) for c in zip(*leads, strict=True))
        extra_of, extra_at = (np.concatenate(c) for c in zip(*extras, strict=True))
        by_lead = np.argsort(extra_of, kind="stable")
        extra_of, extra_at = extra_of[by_lead], extra_at[by_lead]
        tail = b"".join(tails)
        at = np.append(0, np.cumsum(size.astype(np.int64)))[:-1]
        del leads, extras, tails
        order = np.lexsort((doc, both))
        head = np.flatnonzero(np.append(True, both[order][1:] != both[order][:-1])) if len(order) else np.zeros(0, int)
        count = np.diff(np.append(head, len(order)))
        several = np.repeat(doc[order[head]] != doc[order[head + count - 1]], count)
        order = order[several]  # digits that one document has go
        raw = np.frombuffer(tail + bytes(8), np.uint8)
        windows = size[order].astype(np.int64) - window + 1
        # slices end where the digits change
        reach, limit, cut = np.cumsum(windows), SORTED, [0]
        changes = np.flatnonzero(np.append(both[order][1:] != both[order][:-1], True)) + 1 if len(order) else np.zeros(0, int)
        for c in changes.tolist():
            if reach[c - 1] >= limit or c == len(order):
                cut.append(c)
                limit = reach[c - 1] + SORTED
        found = []
        for x, y in zip(cut, cut[1:], strict=False):
            part, n = order[x:y], windows[x:y]
            owner = np.repeat(np.arange(x, y), n)
            inside = np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
            late = repeated(raw, at[order[owner]] + inside, doc[order[owner]], window)
            if len(late):
                late = np.sort(late)
                owner, inside = owner[late], inside[late]
                a, b = _joined(inside, inside + 1, owner)
                frag = order[owner[a]]
                from_, bytes_ = inside[a], inside[b] - inside[a] + window
                # the document's other places with these bytes lose the same
                x_, y_ = np.searchsorted(extra_of, frag), np.searchsorted(extra_of, frag, "right")
                which = np.repeat(np.arange(len(frag)), y_ - x_)
                place = np.append(begin[frag], extra_at[np.repeat(x_, y_ - x_) + np.arange(len(which)) - np.repeat(np.append(0, np.cumsum(y_ - x_)[:-1]), y_ - x_)])
                which = np.append(np.arange(len(frag)), which)
                found.append((doc[frag][which], turn[frag][which], place + from_[which], bytes_[which]))
        tidy()
        return _rows(_answers(*(np.concatenate(c) for c in zip(*found, strict=True)), homes) if found else [])

    out_columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"]

    def last_pass(blobs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(blobs):
            return pd.DataFrame([], columns=out_columns)
        texts = Texts(unfold_texts(blobs.blob))
        (doc, turn, start, size), _ = unpack(answers.blob, ANSWER)
        order = np.lexsort((turn, doc))
        doc, turn, spans = doc[order], turn[order], np.stack([start[order], start[order].astype(np.int64) + size[order]], 1).astype(np.int64)
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (turn[1:] != turn[:-1]))[: len(doc)])
        lost = dict(zip(zip(doc[new].tolist(), turn[new].tolist(), strict=True), np.split(spans, new[1:]), strict=True)) if len(new) else {}
        none, out = np.zeros((0, 2), np.int64), []
        for i, (d, t) in enumerate(zip(texts.docs.tolist(), texts.turns.tolist(), strict=True)):
            text = texts.of(i)
            gone, at, digest = covered(lost.get((d, t), none), len(text)), 0, hashlib.sha256()
            for a, b in gone.tolist():
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            out.append((d, len(text), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), gone.astype("<i8").tobytes(), digest.hexdigest()))
        tidy()
        return pd.DataFrame(out, columns=out_columns)

    dealt = "kind int, key long, blob binary"
    alive = rows.mapInPandas(first_pass, dealt).groupBy("kind", "key").applyInPandas(first_sorted, dealt)
    texts = rows.mapInPandas(to_homes, "key long, blob binary").groupBy("key")
    sent = texts.cogroup(alive.groupBy("key")).applyInPandas(second_pass, dealt)
    answers = sent.groupBy("kind", "key").applyInPandas(third_pass, dealt)
    named = texts.cogroup(answers.groupBy("key")).applyInPandas(last_pass, "doc_id long, n_bytes long, n_removed long, n_spans long, spans binary, kept_sha256 string")
    return named.unionByName(nameless)
