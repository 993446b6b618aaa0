"""Near-duplicates by HyperMinHash.

Every text's set of word shingles is sketched in one pass: the top bits of a shingle's hash choose one of 512 registers, and
a register keeps the largest leading-zero count together with mantissa bits, 16 bits in all. Registers are compressed to a byte each
for estimates. For bands they are folded in pairs, and six folded registers make a band, whose hash is the bucket key. Two sets
of Jaccard similarity s share no band with probability (1 - s ** 6) ** 42 at most: 2e-9 at 0.85, 3e-6 at 0.8; at 0.3, one pair
in thirty meets, which keeps passages that many documents share from making candidates.

Equal sets are merged first, by a 128-bit digest. In each bucket, every member is paired with one leader, which is linear in the
bucket. Pairs whose sizes allow the threshold, and whose collision-corrected estimate is not MARGIN below it, are verified on the
full sets of shingles, from the texts, and links are merged into components. Buckets that still hold several components are then
searched in blocks, all members outside the largest component against all members, sketch by sketch: first for the two likeliest
partners in each other component, which merges most of what belongs together, then, whether that found anything or not, until every
pair whose estimate passes lies in one component or has been verified. So groups of copies are never expanded into pairs, and no
link is left untested because a group is large.

Candidates never become rows by the square of a group: a member has one leader a bucket, and blocks hand on the members that have
candidates, once a block, beside a packed list of the pairs; their sets then meet block by block. A leader's text is copied once for
about STRETCH shingles of members, which are streamed past it.

Defined results: texts without words (null, empty or white) have an empty set, are linked with nothing and are kept; equal rows
are linked; rows that share a doc_id count as one document, which has the links of all its rows; rows without a doc_id are linked
with nothing, have no component and are kept; an empty table gives an empty result; further columns pass through keep_one() and
are ignored elsewhere. A text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .common import named, numbered, scratch, small_batches, text_of, tidied, unused

REGISTERS, MANTISSA, BANDS, ROWS = 512, 10, 42, 6
#: A candidate is verified unless its estimate is this many standard deviations of REGISTERS registers below the threshold, a chance of
#: 1e-9 for a pair at the threshold.
DEVIATIONS = 6
#: Members of a bucket that are compared with as many others in one go; of long texts fewer, so that they have no more than STRETCH shingles.
BLOCK = 1024
#: Up to this size, the members of a bucket are compared row by row; larger buckets go by blocks. Both compare all that is left.
SMALL = 16
#: Shingles of members that one copy of a leader's text serves, or that a block holds, about.
STRETCH = 200_000
#: Words that a worker remembers; beyond that it starts anew.
REMEMBERED = 60_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # fixed values: the finaliser of MurmurHash3
S33 = np.uint64(33)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(LOWER).split()


def shingles(text: str, n: int) -> set:
    """The full set, of tuples of words."""
    words = words_of(text)
    return set(zip(*[words[i:] for i in range(n)], strict=False)) if len(words) >= n else {tuple(words)} if words else set()


def shingle_numbers(texts: list[np.ndarray], n: int) -> list[np.ndarray]:
    """The full set of each text, given as word numbers, with a number for each different shingle: sorted and distinct. Shingles grow
    a word at a time, and each length's different ones are numbered anew, so nothing is hashed."""
    size = np.array([len(t) for t in texts], np.int64)
    ends, words = np.cumsum(size), np.concatenate([np.zeros(0, np.int64), *texts])
    left = np.repeat(ends, size) - np.arange(len(words))  # words from here to the text's end
    width = np.minimum(np.repeat(size, size), n)  # a text of fewer words is one shingle
    numbers, many = words.copy(), int(words.max(initial=0)) + 1
    for k in range(1, n):
        on = np.flatnonzero((left > k) & (width > k))
        longer = np.unique(numbers[on] * many + words[on + k], return_inverse=True)[1] if len(on) else on
        # shorter ones keep clear of these: they never equal a longer one
        rest = np.ones(len(numbers), bool)
        rest[on] = False
        numbers[rest] = np.unique(numbers[rest], return_inverse=True)[1] + len(on) if rest.any() else numbers[rest]
        numbers[on] = longer
    starts = left >= width
    return [np.unique(numbers[e - s : e][starts[e - s : e]]) for s, e in zip(size.tolist(), ends.tolist(), strict=True)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> S33)) * M1
    h = (h ^ (h >> S33)) * M2
    return h ^ (h >> S33)


def hashes(words: list[bytes], n: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = n if len(words) >= n else len(words)
    got = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        got = _mix(got + h[i : len(h) - width + 1 + i])
    return np.unique(got)


def sketch(h: np.ndarray) -> np.ndarray:
    """512 registers of 16 bits from sorted hashes: 0 if empty, else leading zeros + 1 above the complement of the mantissa."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(h):
        register = (h >> np.uint64(55)).astype(np.int64)
        rest = ((h >> np.uint64(MANTISSA)) & np.uint64((1 << 45) - 1)).astype(np.float64)
        zeros = 45 - np.frexp(rest)[1]
        low = (h & np.uint64((1 << MANTISSA) - 1)).astype(np.int64)
        value = ((zeros + 1) << MANTISSA) | ((1 << MANTISSA) - 1 - low)
        at = np.flatnonzero(np.diff(register, prepend=-1))
        out[register[at]] = np.maximum.reduceat(value, at)
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """Bucket keys of a sketch, a long for each band; 0 for a band without a shingle."""
    rows = registers.reshape(-1, 2).max(1)[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.zeros(BANDS, np.uint64)
    for i in range(ROWS):
        key = _mix(key * np.uint64(65_537) + rows[:, i] + np.uint64(1))
    return np.where(rows.any(1), key | np.uint64(1), np.uint64(0)).view("<i8")


def compressed(registers: np.ndarray) -> np.ndarray:
    """A byte for each register: 0 if empty, else one of 255 by hash."""
    return np.where(registers > 0, _mix(registers.astype(np.uint64)) % np.uint64(255) + np.uint64(1), np.uint64(0)).astype("u1")


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of compressed sketches (last axis: registers), corrected for chance collisions."""
    used = ((a > 0) | (b > 0)).sum(-1)
    equal = ((a == b) & (a > 0)).sum(-1)
    return (equal / np.maximum(used, 1) - 1 / 255) / (1 - 1 / 255)


def floor_of(num: int, den: int) -> float:
    """The least estimate that is verified."""
    at = num / den
    return at - DEVIATIONS * (at * (1 - at) / REGISTERS) ** 0.5


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, tie (hash of the text), n, d1, d2 (digest of the set), bands array<long>, sig (the compressed registers, then the low
    halves of the bands)."""

    @tidied
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        known = _Words()
        for frame in frames:
            out = []
            for doc_id, tie, text in zip(frame.doc_id, frame.tie, frame.text, strict=True):
                h = hashes(words_of(text), n, known)
                d = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), "<i8").tolist()
                registers = sketch(h)
                keys = band_keys(registers)
                out.append((doc_id, tie, len(h), *d, keys.tolist(), compressed(registers).tobytes() + keys.astype("<u4").tobytes()))
                if len(known) > REMEMBERED:
                    known.clear()
            yield pd.DataFrame(out, columns=["doc_id", "tie", "n", "d1", "d2", "bands", "sig"])

    rows = named(text_of(docs)).withColumn("tie", F.xxhash64("text"))
    return numbered(rows.mapInPandas(run, "doc_id string, tie long, n long, d1 long, d2 long, bands array<long>, sig binary"))


def _registers(sig: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(sig), "u1").reshape(-1, REGISTERS + 4 * BANDS)
    return both[:, :REGISTERS], np.ascontiguousarray(both[:, REGISTERS:]).view("<u4")


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """node, comp: smallest node reachable by edges a, b. Labels fall to the least neighbouring label and are then followed to
    their own labels, which halves the way left; every round is a written table. labels: those known so far, if any."""
    both = scratch(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links", 8)
    if labels is None:
        labels = both.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct()
    else:
        extra = both.select(F.col("a").alias("node")).join(labels, "node", "left_anti").distinct()
        labels = labels.union(extra.select("node", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        want = labels.join(near, labels["node"] == near["a"], "left").select("node", "comp", F.least("comp", F.coalesce("near", "comp")).alias("want"))
        then = labels.select(F.col("node").alias("want"), F.col("comp").alias("next"))
        moved = want.join(then, "want", "left").select("node", F.least("want", F.coalesce("next", "want")).alias("to"), "comp")
        moved = scratch(moved.select("node", F.col("to").alias("comp"), (F.col("to") < F.col("comp")).alias("moved")), "labels", 8)
        labels = moved.select("node", "comp")
        if moved.where("moved").isEmpty():
            return labels


def _pairs(rows: DataFrame, one: str, two: str) -> DataFrame:
    """a, b: each pair once. The partner with the smaller hash is a, as it is the leader of a bucket, so those with many pairs are there."""
    first, second = (F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id")) for c in (one, two))
    return rows.where(F.col(one) != F.col(two)).select(F.least(first, second).alias("x"), F.greatest(first, second).alias("y")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def verify(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """a, b of the pairs a, b, na (shingles of a) whose full sets have den * intersection >= num * union."""

    @tidied
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, lead = None, set()
        for frame in frames:
            out = []
            for a, b, text in zip(frame.a, frame.b, frame.text, strict=True):
                if b < 0:  # a leader comes before its members
                    if key != a:
                        key, lead = a, shingles(text, n)
                    continue
                mine = shingles(text, n)
                inter = len(lead & mine)
                if inter and den * inter >= num * (len(lead) + len(mine) - inter):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    # what a leader's members need in all says into how many stretches they go
    many = pairs.groupBy("a").agg(F.ceil(F.sum("na") / STRETCH).cast("int").alias("many")).where("many > 1")
    dealt = pairs.join(many, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("many", F.lit(1))).cast("int"))
    dealt = scratch(dealt.select("a", "b", "salt"), "dealt", 8)
    members = dealt.join(texts.withColumnRenamed("cid", "b"), "b").select("a", "salt", "b", "text")
    leads = dealt.select("a", "salt").distinct().join(texts.withColumnRenamed("cid", "a"), "a")
    rows = leads.select("a", "salt", F.lit(-1).cast("long").alias("b"), "text").unionByName(members)
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "b").select("a", "b", "text").mapInPandas(run, "a long, b long")


def _estimated(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that may reach the threshold, with na: their sizes allow it, and their estimate is not below the floor."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))

    @F.pandas_udf(T.DoubleType())
    def est(sa: pd.Series, sb: pd.Series) -> pd.Series:
        return pd.Series(estimate(_registers(sa)[0], _registers(sb)[0]))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    return joined.select("a", "b", "na", est("sa", "sb").alias("est")).where(F.col("est") >= floor_of(num, den)).drop("est")


def _blocks(members: DataFrame, num: int, den: int, top: int) -> DataFrame:
    """members: band, v, cid, n, comp, sig, main (the bucket's largest component), blocks, asks (blocks of the bucket, and of its members
    outside main). In each block with each block of outsiders, an outsider's candidates in each other component, all of them or,
    where top is given, only the likeliest; a pair comes from the first band that it shares. block (a hash), cid, pairs: a row for
    each member that has a candidate, the pairs, as places among these rows by cid, in a row of cid -1."""
    floor = floor_of(num, den)
    columns = ["band", "v", "block", "ask", "cid", "n", "comp", "sig"]
    home = lambda many, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(many)).cast("int")
    own = members.withColumn("block", home("blocks", 1)).withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).select(*columns, F.lit(False).alias("out"))
    out = members.where("comp <> main").withColumn("ask", home("asks", 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*columns, F.lit(True).alias("out"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = frame.out.to_numpy()
        got: list[tuple[np.ndarray, np.ndarray]] = []
        if out.any() and not out.all():
            (reg, keys), cid, comp, size = _registers(frame.sig), frame.cid.to_numpy(), frame.comp.to_numpy(), frame.n.to_numpy()
            mine = np.flatnonzero(~out)
            own_reg, own_keys, own_comp, own_size = reg[mine], keys[mine], comp[mine], size[mine]
            band = int(frame.band.iloc[0])
            for i in np.flatnonzero(out):
                fits = np.minimum(own_size, size[i]) * den >= np.maximum(own_size, size[i]) * num
                at = np.flatnonzero((own_comp != comp[i]) & fits)
                e = estimate(own_reg[at], reg[i][None])
                at, e = at[e >= floor], e[e >= floor]
                same = (own_keys[at] == keys[i]) & (keys[i] != 0)
                first = same.argmax(1) == band
                at, e = at[first], e[first]
                if top and len(at):
                    order = np.lexsort((cid[mine[at]], -e, own_comp[at]))
                    at = at[order]
                    c = own_comp[at]
                    starts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
                    rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
                    at = at[rank < top]
                got.append((np.full(len(at), cid[i]), cid[mine[at]]))
        x, y = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (zip(*got, strict=True) if got else ((), ())))
        if not len(x):
            return pd.DataFrame({"block": np.zeros(0, "int64"), "cid": np.zeros(0, "int64"), "pairs": np.zeros(0, object)})
        met, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        a, b = np.sort(at.reshape(2, -1), axis=0)
        packed = np.unique(a * len(met) + b)  # an outsider may stand on both sides
        key = int(_mix(np.array([band, frame.v.iloc[0], frame.block.iloc[0], frame.ask.iloc[0]], np.int64).view(np.uint64) * M2 + np.arange(4, dtype=np.uint64)).sum().view(np.int64))
        return pd.DataFrame({"block": key, "cid": [*met.tolist(), -1], "pairs": [None] * len(met) + [packed.astype("<i8").tobytes()]})

    return own.unionByName(out).groupBy("band", "v", "block", "ask").applyInPandas(run, "block long, cid long, pairs binary")


def _verified_blocks(blocks: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """a, b of the packed pairs whose full sets reach the threshold. A block numbers its words, and then its shingles, in the order
    that they come in, so equal numbers are equal shingles."""

    @tidied
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, key, packed, ids, words = {}, None, b"", [], []

        def links() -> pd.DataFrame:
            out, at = [], np.frombuffer(packed, "<i8")
            sets = shingle_numbers(words, n)
            for i, j in zip((at // max(1, len(ids))).tolist(), (at % max(1, len(ids))).tolist(), strict=True):
                one, two = sets[i], sets[j]
                inter = len(np.intersect1d(one, two, assume_unique=True))
                if inter and den * inter >= num * (len(one) + len(two) - inter):
                    out.append((ids[i], ids[j]))
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        for frame in frames:
            for block, cid, pairs, text in zip(frame.block, frame.cid, frame.pairs, frame.text, strict=True):
                if block != key:
                    if ids:
                        yield links()
                    known, key, packed, ids, words = {}, block, b"", [], []
                if cid < 0:
                    packed = pairs
                else:
                    ids.append(cid)
                    words.append(np.array([known.setdefault(w, len(known)) for w in words_of(text)], np.int64))
        if ids:
            yield links()

    rows = blocks.where("cid >= 0").drop("pairs").join(texts, "cid").select("block", "cid", F.lit(None).cast("binary").alias("pairs"), "text")
    rows = rows.unionByName(blocks.where("cid < 0").withColumn("text", F.lit("")))
    return rows.repartition("block").sortWithinPartitions("block", "cid").mapInPandas(run, "a long, b long")


def _few(members: DataFrame) -> DataFrame:
    """The same for small buckets: each outsider with each member of other components; SMALL rows a member at most."""
    small = members.where(F.col("size") <= SMALL)
    own = small.select("band", "v", F.col("cid").alias("b"), F.col("comp").alias("cb"))
    out = small.where("comp <> main").select("band", "v", F.col("cid").alias("a"), "comp")
    return _pairs(out.join(own, ["band", "v"]).where("comp <> cb"), "a", "b")


def groups(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs."""
    small_batches(docs.sparkSession)
    sketched = scratch(sketches(docs, n), "sketches")
    named = sketched.where("n > 0 and doc_id is not null")
    classes = named.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "tie", "n", "bands", "sig")).alias("m"))
    classes = classes.select("d1", "d2", F.col("m.doc_id").alias("rep"), "m.tie", "m.n", "m.bands", "m.sig", F.monotonically_increasing_id().alias("cid"))
    classes = scratch(classes, "classes", 2)  # from here on, cid stands for a class
    banded = classes.select("cid", F.posexplode("bands").alias("band", "v")).where("v <> 0")
    buckets = banded.groupBy("band", "v").agg(F.min(F.struct(F.xxhash64("cid").alias("h"), "cid")).alias("m"), F.count("*").alias("size"))
    buckets = scratch(buckets.where("size > 1").select("band", "v", F.col("m.cid").alias("lead"), "size"), "buckets", 4)
    rows = scratch(banded.join(buckets, ["band", "v"]), "members", 2)  # only those that meet anyone
    tested = scratch(_estimated(_pairs(rows, "cid", "lead"), classes, num, den), "tested", 4)
    met = rows.select("cid").distinct().join(classes.select("cid", F.col("rep").alias("doc_id"), "tie"), "cid")
    texts = scratch(text_of(docs).withColumn("tie", F.xxhash64("text")).join(met, ["doc_id", "tie"]).select("cid", "text"), "texts")
    links = scratch(verify(tested, texts, n, num, den), "verified", 2)
    # rows of one doc_id are one document: their classes belong together
    belongs = scratch(sketched.join(classes.select("d1", "d2", "cid", "rep"), ["d1", "d2"], "left").select("doc_id", "n", "cid", "rep"), "belongs", 4)
    several = belongs.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("most")).where("a < most")
    links = links.union(belongs.where("n > 0").join(several, "doc_id").where("cid <> a").select("a", F.col("cid").alias("b")).distinct())
    labels = components(links)
    # first the likeliest few, which merge most of what belongs together, then all that is left
    sizes = classes.select("cid", "n")
    for top in (2, 0):
        inside = rows.select("band", "v", "cid", "size").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid")).join(sizes, "cid")
        counts = inside.groupBy("band", "v", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
        mixed = counts.groupBy("band", "v").agg(F.max(F.struct("c", "comp", "n")).alias("m"), F.count("*").alias("comps"), F.sum("c").alias("c"), F.sum("n").alias("n")).where("comps > 1")
        cut = lambda rows, shingles: F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / STRETCH)).cast("int")
        mixed = mixed.select("band", "v", F.col("m.comp").alias("main"), cut(F.col("c"), F.col("n")).alias("blocks"), cut(F.col("c") - F.col("m.c"), F.col("n") - F.col("m.n")).alias("asks"))
        members = scratch(inside.join(mixed, ["band", "v"]), "mixed", 4)  # read three times
        large = members.where(F.col("size") > SMALL).join(classes.select("cid", "sig"), "cid")
        asked = scratch(_blocks(large, num, den, top), "asked", 2)
        found = _verified_blocks(asked, texts, n, num, den)
        if top:  # small buckets give all their pairs at once
            fresh = scratch(_estimated(_few(members).join(tested.select("a", "b"), ["a", "b"], "left_anti"), classes, num, den), "fresh", 4)
            found = found.union(verify(fresh, texts, n, num, den))
        found = scratch(found.distinct(), "found", 8)
        if not found.isEmpty():
            links = links.union(found)
            labels = components(links, labels)
    least = labels.join(classes.select(F.col("cid").alias("node"), "rep"), "node").groupBy("comp").agg(F.min("rep").alias("least"))
    out = belongs.join(labels.join(least, "comp").select(F.col("node").alias("cid"), "least"), "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "rep", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs with the smallest doc_id of each group; of rows with one doc_id, all stay, as do those without any."""
    (mine,) = unused(docs, "__doc")
    kept = groups(docs, n, num, den).where("doc_id = component_id").select(F.col("doc_id").alias(mine)).distinct()
    return docs.where("doc_id is not null").join(kept, docs["doc_id"] == F.col(mine), "left_semi").unionByName(docs.where("doc_id is null"))
