"""Byte-level BPE encoding and decoding with overlapping chunks.

Every text, long or short, goes the same way in three steps. It is cut into chunks of CHUNK code points that overlap by OVERLAP, and
each chunk is pre-tokenised on its own, from its first character on, which may be in the middle of a piece. Then neighbours are
stitched: the pattern looks at nothing before a piece, so from the first boundary that two neighbours share (both see what follows
it) they agree, and the earlier one's pieces count up to there. Where an overlap holds no shared boundary, as within one endless run of
letters, the text from the last sure boundary on is pre-tokenised anew across the chunks, once whenever it has doubled, which is
exact and takes time in proportion. Only then are the pieces encoded. Decoding concatenates the bytes of the ids.

Texts of more than SPREAD code points take these steps in several tasks (chunks as rows, stitched stretches as rows), others in the
task that reads them; the functions are the same, and so are the results.

Defined results: a null or empty text has no ids; rows that share doc_id, or are equal altogether, are encoded each; a null
doc_id, and any long, passes through as it is; an empty table gives an empty result; further columns are ignored. No text is cut short.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import named, numbered, small_batches, text_of, tidied

CHUNK, OVERLAP = 4_096, 256
#: Code points from which a text's steps are dealt to several tasks, and chunks or stretches that one row holds then.
SPREAD, A_ROW = 1 << 18, 16
#: Bytes of pieces that a worker remembers, about; beyond that it starts anew.
REMEMBERED = 8_000_000

_coders: dict[str, Coder] = {}


class Known(dict):
    """Piece -> ids; encodes a piece that it doesn't know. Long pieces are not kept."""

    def __init__(self, encode: Callable):
        self._encode, self._size = encode, 0

    def __missing__(self, piece: str) -> list[int]:
        got = self._encode(piece)
        if len(piece) < 32:
            self[piece] = got
            self._size += 200 + 4 * len(piece)
        return got

    def trim(self) -> None:
        if self._size > REMEMBERED:
            self.clear()
            self._size = 0


class Coder:
    """Pattern, ranks and the pieces seen so far; one a worker and vocabulary."""

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known = Known(self.bpe._encode_single_piece)

    def pretokenised(self, text: str) -> list[str]:
        """Pieces of a whole text, chunk by chunk."""
        return [p for pieces in stitched(((start, chunk, self.find(chunk)) for start, chunk in cut(text)), self.find) for p in pieces]

    def encode_pieces(self, pieces: list[str]) -> list[int]:
        ids: list[int] = []
        for got in map(self.known.__getitem__, pieces):
            ids += got
        self.known.trim()
        return ids

    def encode(self, text: str) -> list[int]:
        return self.encode_pieces(self.pretokenised(text))

    def decode(self, ids: list[int]) -> bytes:
        return self.bpe.decode_bytes(ids)


def coder(ranks_path: str) -> Coder:
    if ranks_path not in _coders:
        _coders[ranks_path] = Coder(ranks_path)
    return _coders[ranks_path]


def cut(text: str, size: int | None = None, overlap: int | None = None) -> Iterator[tuple[int, str]]:
    """(start, chunk text) of every chunk."""
    size, overlap = size or CHUNK, overlap or OVERLAP
    for start in range(0, max(1, len(text)), size):
        yield start, text[start : start + size + overlap]
        if start + size + overlap >= len(text):
            return


def _ends(start: int, pieces: list[str]) -> list[int]:
    out = []
    for p in pieces:
        start += len(p)
        out.append(start)
    return out


def stitched(chunks: Iterator[tuple[int, str, list[str]]], find: Callable[[str], list[str]]) -> Iterator[list[str]]:
    """The text's pieces, stretch by stretch, from its chunks in order: start, text, pieces when pre-tokenised alone."""
    chunks = iter(chunks)
    start, text, pieces = next(chunks, (0, "", []))
    # the text from start on is open; pieces are its pieces as far as they are sure, unless more has been added since
    waiting, tried = [text], len(text)
    for n_start, n_text, n_pieces in chunks:
        stop = start + sum(map(len, waiting))
        if len(waiting) > 1:
            if stop - start < 2 * tried:  # too little has come since the last try
                waiting.append(n_text[stop - n_start :])
                continue
            text = "".join(waiting)
            waiting, tried, pieces = [text], len(text), find(text)
        ends = _ends(start, pieces)
        while ends and ends[-1] >= stop:  # a piece that touches the end may go on
            ends.pop()
        theirs = {n_start, *_ends(n_start, n_pieces)}
        shared = next((k for k, at in enumerate(ends) if at >= n_start and at in theirs), None)
        if shared is not None:
            yield pieces[: shared + 1]
            at = ends[shared]
            skip, first = n_start, 0
            while skip < at:
                skip += len(n_pieces[first])
                first += 1
            start, text, pieces = at, n_text[at - n_start :], n_pieces[first:]
            waiting, tried = [text], len(text)
        else:
            if ends:
                yield pieces[: len(ends)]
                text = text[ends[-1] - start :]
                start = ends[-1]
            waiting, tried = [text, n_text[stop - n_start :]], len(text)
    yield pieces if len(waiting) == 1 else find("".join(waiting))


def _digest(code: Coder, ids: list[int]) -> tuple:
    return len(ids), hashlib.sha256(str(ids)[1:-1].replace(", ", " ").encode()).hexdigest(), hashlib.sha256(code.decode(ids)).hexdigest()


def _as_is(code: Coder, ids: list[int]) -> tuple:
    return (ids,)


FORMS = {"ids": ("ids array<int>", _as_is), "digest": ("n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)}


def encode(docs: DataFrame, ranks_path: str, form: str = "ids") -> DataFrame:
    """doc_id and the ids, or what FORMS derives from them, of every row of docs."""
    columns, finish = FORMS[form]
    names = ["doc_id", *[c.split()[0] for c in columns.split(", ")]]
    small_batches(docs.sparkSession)
    rows = named(text_of(docs))

    @tidied
    def here(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = coder(ranks_path)
        for frame in frames:
            yield pd.DataFrame([(d, *finish(code, code.encode(t))) for d, t in zip(frame.doc_id, frame.text, strict=True)], columns=names)

    @tidied
    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc_id, tie, text in zip(frame.doc_id, frame.tie, frame.text, strict=True):
                for k, first in enumerate(range(0, max(1, len(text) - OVERLAP), CHUNK * A_ROW)):
                    yield pd.DataFrame([(doc_id, tie, k, first, text[first : first + CHUNK * A_ROW + OVERLAP])], columns=["doc_id", "tie", "nth", "start", "text"])

    @tidied
    def pretokenised(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pieces of each row's chunks, as their lengths. A row's own chunks are stitched at once."""
        code = coder(ranks_path)
        for frame in frames:
            yield frame.assign(sizes=[np.array([len(p) for p in code.pretokenised(t)], "<i4").tobytes() for t in frame.text])

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        """Stretches of sure pieces, A_ROW chunks long at least, for one text; equal rows stand for themselves."""
        code, frame = coder(ranks_path), frame.sort_values("nth", kind="stable")
        copies = int((frame.nth == 0).sum())

        def parts() -> Iterator[tuple[int, str, list[str]]]:
            for start, text, sizes in frame.drop_duplicates("nth")[["start", "text", "sizes"]].itertuples(index=False):
                ends = np.cumsum(np.frombuffer(sizes, "<i4")).tolist()
                yield start, text, [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]

        out = [(frame.doc_id.iloc[0], int(frame.tie.iloc[0]), copies, k, "".join(pieces), np.array([len(p) for p in pieces], "<i4").tobytes()) for k, pieces in enumerate(stitched(parts(), code.find))]
        return pd.DataFrame(out, columns=["doc_id", "tie", "copies", "nth", "text", "sizes"])

    @tidied
    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = coder(ranks_path)
        for frame in frames:
            ids = []
            for text, sizes in zip(frame.text, frame.sizes, strict=True):
                ends = np.cumsum(np.frombuffer(sizes, "<i4")).tolist()
                ids.append(np.array(code.encode_pieces([text[a:b] for a, b in zip([0, *ends], ends, strict=False)]), "<i4").tobytes())
            yield frame[["doc_id", "tie", "copies", "nth"]].assign(ids=ids)

    def finished(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(frame.sort_values("nth").ids), "<i4").tolist()
        return pd.DataFrame([(frame.doc_id.iloc[0], *finish(coder(ranks_path), ids))] * int(frame.copies.iloc[0]), columns=names)

    schema = f"doc_id string, {columns}"
    short = rows.where(F.length("text") <= SPREAD).mapInPandas(here, schema)
    long = rows.where(F.length("text") > SPREAD).withColumn("tie", F.xxhash64("text")).mapInPandas(chunks, "doc_id string, tie long, nth long, start long, text string")
    found = long.repartition("doc_id", "tie", "nth").mapInPandas(pretokenised, "doc_id string, tie long, nth long, start long, text string, sizes binary")
    stretches = found.groupBy("doc_id", "tie").applyInPandas(joined, "doc_id string, tie long, copies int, nth long, text string, sizes binary")
    ids = stretches.repartition("doc_id", "tie", "nth").mapInPandas(coded, "doc_id string, tie long, copies int, nth long, ids binary")
    return numbered(short.unionByName(ids.groupBy("doc_id", "tie").applyInPandas(finished, schema)))


def decode(coded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, raw binary: the bytes of the ids. Raw, since the ids of a cut text need not end at a character."""

    def back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = coder(ranks_path)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame.doc_id, "raw": [code.decode(x.tolist()) for x in frame.ids]})

    return numbered(named(coded.select("doc_id", "ids")).mapInPandas(back, "doc_id string, raw binary"))
