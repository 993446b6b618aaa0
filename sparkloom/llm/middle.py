"""Fill-in-the-middle: texts cut at two token boundaries and put together in another order.

Whole Arrow batches at once. The UTF-8 bytes of a batch's texts lie in one buffer; a byte-class table says which are white, and a
token starts at every white byte that follows one that isn't, and at a text's start: the mask of adjacent bytes. A cumulative sum of
the mask, reset at each text, counts tokens; searchsorted in it gives both cuts of all rows together. Code points are counted in the same way,
from the bytes that continue none. What a batch needs besides its bytes is a few arrays of their length, so batches are kept small
(common.BATCH_BYTES) and a long text is a batch of its own.

The cuts and the form come from sha256("<seed>:<doc_id>"), so neither the order of rows nor the batches matter, and no row meets another:
there is no shuffle.

Defined results: null and empty texts are plain, with no token and an empty output; texts that contain a sentinel are plain and stay as
they are; a text of white space alone is one token; a null doc_id hashes as no digits; rows that share a doc_id are cut by the same
numbers, each in its own text; any long is a doc_id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE, small_batches, text_of, tidied

#: The sentinels. They are three bytes, '<', a letter and '>', and no two share a letter.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
RATE, SPM = 50, 80
SEED = 42
PLAIN, PSM, SPM_FORM = 0, 1, 2
FORMS = pa.array(["plain", "psm", "spm"])

IS_WHITE = np.zeros(256, bool)
IS_WHITE[np.frombuffer(WHITE.encode(), np.uint8)] = True
CONTINUES = (np.arange(256) & 0xC0) == 0x80
LETTER = np.zeros(256, bool)
LETTER[[PREFIX[1], SUFFIX[1], MIDDLE[1]]] = True


def token_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mask over the bytes: a token starts here. offsets: where texts begin, and the end of the last."""
    white = IS_WHITE[raw]
    starts = white.copy()
    starts[1:] &= ~white[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[begins] = True  # white space at a text's start is its first token's
    return starts


def has_sentinel(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, whether '<', a sentinel's letter and '>' follow each other in it."""
    at = np.flatnonzero((raw[:-2] == 0x3C) & LETTER[raw[1:-1]] & (raw[2:] == 0x3E)) if len(raw) > 2 else np.zeros(0, int)
    text = np.searchsorted(offsets, at, "right") - 1
    out = np.zeros(len(offsets) - 1, bool)
    out[text[at + 3 <= offsets[text + 1]]] = True
    return out


def cut(raw: np.ndarray, offsets: np.ndarray, draws: np.ndarray, rate: int, spm: int) -> dict[str, np.ndarray]:
    """n, form, both cuts (bytes in raw) and the code points of prefix and middle for all texts; draws: h1 to h4, a row a text."""
    begin, end = offsets[:-1], offsets[1:]
    reached = np.concatenate([[0], np.cumsum(token_starts(raw, offsets))])  # tokens that started before each place
    first = reached[begin]
    n = reached[end] - first
    one, two = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    # k tokens of a text end where the next one starts, all of them at the text's end
    units = np.stack([np.minimum(one, two), np.maximum(one, two)], 1)
    at = np.searchsorted(reached, (first[:, None] + units + 1).ravel(), "left").reshape(-1, 2) - 1
    at = np.where(units >= n[:, None], end[:, None], at)
    points = np.concatenate([[0], np.cumsum(~CONTINUES[raw])])
    plain = (begin == end) | has_sentinel(raw, offsets) | (draws[:, 2] % 100 >= rate)
    form = np.where(plain, PLAIN, np.where(draws[:, 3] % 100 < spm, SPM_FORM, PSM))
    return {"n": n, "form": form, "first": at[:, 0], "second": at[:, 1], "prefix_chars": points[at[:, 0]] - points[begin], "middle_chars": points[at[:, 1]] - points[at[:, 0]]}


def assembled(raw: np.ndarray, offsets: np.ndarray, found: dict[str, np.ndarray]) -> pa.Array:
    """The outputs. Every row is six slices, sentinels among them, that are copied once."""
    whole, slices = memoryview(raw), []
    for a, b, x, y, form in zip(offsets[:-1].tolist(), offsets[1:].tolist(), found["first"].tolist(), found["second"].tolist(), found["form"].tolist(), strict=True):
        prefix, middle, suffix = whole[a:x], whole[x:y], whole[y:b]
        if form == PLAIN:
            slices.append(whole[a:b])
        elif form == PSM:
            slices += (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
        else:
            slices += (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    marks = np.where(found["form"] == PLAIN, 0, len(PREFIX) + len(SUFFIX) + len(MIDDLE))
    ends = np.concatenate([[0], np.cumsum(np.diff(offsets) + marks)])
    kind, width = (pa.string(), "<i4") if ends[-1] < 1 << 31 else (pa.large_string(), "<i8")
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(ends.astype(width).tobytes()), pa.py_buffer(b"".join(slices))])


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(raw, offsets) of the texts, without copying the bytes; texts has no nulls."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, "<i8" if wide else "<i4")[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def transform(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars (null where plain), output of every row.

    rate: of a hundred texts, how many are cut; spm: of a hundred of those, how many begin with the suffix."""
    small_batches(docs.sparkSession)
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("digits", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = text_of(docs).withColumn("digits", digits).select("doc_id", "text", *draws)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, offsets = bytes_of(batch.column("text"))
            found = cut(raw, offsets, np.stack([batch.column(f"h{k}").to_numpy() for k in range(1, 5)], 1), rate, spm)
            plain = found["form"] == PLAIN
            chars = [pa.array(found[c], pa.int64(), mask=plain) for c in ("prefix_chars", "middle_chars")]
            columns = [batch.column("doc_id"), pa.array(found["n"], pa.int64()), FORMS.take(pa.array(found["form"])), *chars, assembled(raw, offsets, found)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from output and form: a cut text holds each sentinel exactly once."""
    parts = F.split(output, f"{PREFIX.decode()}|{SUFFIX.decode()}|{MIDDLE.decode()}", -1)
    second, third, last = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(second, last, third)).when(form == "spm", F.concat(third, last, second)).otherwise(output)
