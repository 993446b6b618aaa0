"""A deterministic sharded writer of WARC 1.1 archives, and their reader.

Records are ordered by (page_id, hash of url and payload digest) and cut into shards of equal bytes. Which record opens a shard is
computed exactly, from running sums over the narrow keys, so it depends on the table alone; only these openings, one a shard, go to
the driver and from there to all tasks. Payloads are shuffled once, to their shard, and sorted inside it. One task writes a shard, record by
record, as gzip members without time stamps: headers and digests are made anew from the payload, and a file is closed when its
compressed size reaches the roll size. A file is written under a temporary name and moved to its own name when it is whole. A task that runs
twice writes the same bytes under the same name, so lost executors and speculation do no harm. The manifest, a row for each stretch of records
with its place, is written by Spark last: an archive without its manifest isn't there, and what the manifest doesn't name isn't read.

Of records with equal payloads (by SHA-1, length and a second hash), that with the smallest page_id is a response and all others are
revisits of it, with the response's HTTP header and no payload. Verdicts are found on the narrow keys and meet the payloads in the shard,
as a row before those of its key, so a payload that a third of all pages share is never gathered in one task.

The reader takes stretches of files, checks both digests of each record, and needs memory for the largest record.

Defined results: null and empty html is an empty payload; a null url is written as urn:page:<page_id>, and characters that no header may
hold are percent-encoded; records that share page_id, url and payload are written each, all as responses if theirs is the smallest page_id; a null
page_id comes last and is no one's original unless all have it; any long is a page_id; an empty table gives an archive without files;
further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import partitions, scratch, small_batches, tidied
from .mixing import running

#: Bytes of a shard's payloads at most, unless that makes fewer shards than the session has shuffle partitions.
SHARD = 1 << 30
#: Compressed bytes after which a file is closed.
ROLL = 256 << 20
#: Compressed bytes that a reader's task takes, about.
STRETCH = 4 << 20
#: Bytes of a record beside its payload, about.
HEADER = 512
#: pages have no time of their own.
DATE = "2024-01-01T00:00:00Z"
SOFTWARE = "sparkloom"
LAST = 2**63 - 1
NAMESPACE = uuid.UUID("00000000-0000-0000-0000-000000000000")
MANIFEST = "file string, begin long, end long, records long"


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark takes it by, as tasks without Spark understand it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return re.sub("^file:/+", "file:///", re.sub("^s3[an]:", "s3:", whole))


def store(folder: str):
    """(file system, path) of a qualified folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def records(pages: DataFrame) -> DataFrame:
    """page_id, order (page_id, nulls last), tie, url, html, n, sha (SHA-1), more (a second hash)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"order": F.coalesce("page_id", F.lit(LAST)), "n": F.octet_length("html").cast("long"), "sha": F.sha1(F.col("html").cast("binary")), "more": F.xxhash64("html")})
    return rows.withColumn("tie", F.xxhash64("url", "sha", F.col("page_id").isNull()))


def verdicts(rows: DataFrame, min_bytes: int) -> DataFrame:
    """A row for each (order, tie), without the payload: page_id, url, n, copies, first (page_id of the response that it revisits; null
    for responses), first_url, first_tie."""
    keys = scratch(rows.groupBy("order", "tie", "n", "sha", "more").agg(F.first("page_id").alias("page_id"), F.first("url").alias("url"), F.count("*").alias("copies")), "warc-keys", 2)
    payload = ["n", "sha", "more"]
    firsts = keys.where(F.col("n") >= min_bytes).groupBy(*payload).agg(F.min(F.struct(F.col("page_id").isNull().alias("nameless"), "order", "tie", "page_id", "url")).alias("f"), F.count("*").alias("many")).where("many > 1")
    firsts = firsts.select(*payload, "many", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url"), F.col("f.tie").alias("first_tie"))
    joined = keys.join(firsts.hint("merge"), payload, "left")
    own = F.col("many").isNull() | F.col("page_id").eqNullSafe(F.col("first"))  # rows with the smallest page_id are responses, all of them
    return joined.select("order", "tie", "page_id", "url", "n", "copies", own.alias("own"), *[F.when(~own, F.col(c)).alias(c) for c in ("first", "first_url", "first_tie")])


def placed(keys: DataFrame, width: int) -> DataFrame:
    """keys with low and high: the shards of a key's copies, by the bytes before them in order. One copy is never cut."""
    size = F.col("copies") * (F.col("n") + HEADER)
    at = running(keys.withColumn("size", size), [], ["order", "tie"], {"before": "size"}, "warc-places", 4)
    low, high = F.expr(f"cast(before div {width}L as int)"), F.expr(f"cast((before + size - 1) div {width}L as int)")
    return at.select(*keys.columns, low.alias("low"), F.when(F.col("copies") > 1, high).otherwise(low).alias("high"))


def shard_of(openings: list[tuple[int, int, int]], spread: list[tuple[int, int, int, int]]):
    """UDF (order, tie, place of the row) -> shard. openings: shard and its least key, sorted by key; spread: the keys whose copies
    lie in several shards."""
    keys = np.array([(o, t) for o, t, _ in openings], np.int64).reshape(-1, 2)
    shards = np.array([s for *_, s in openings], np.int32)
    wide = {(o, t): (low, high) for o, t, low, high in spread}

    @F.pandas_udf(T.IntegerType())
    def run(order: pd.Series, tie: pd.Series, place: pd.Series) -> pd.Series:
        order, tie = order.to_numpy(), tie.to_numpy()
        left, right = np.searchsorted(keys[:, 0], order, "left"), np.searchsorted(keys[:, 0], order, "right")
        at = right - 1
        for k in np.flatnonzero(right > left).tolist():  # openings of the same page
            at[k] = left[k] + np.searchsorted(keys[left[k] : right[k], 1], tie[k], "right") - 1
        out = shards[at]
        if wide:
            for k, key in enumerate(zip(order.tolist(), tie.tolist(), strict=True)):
                if key in wide:
                    low, high = wide[key]
                    out[k] = low + int(place.iloc[k]) % (high - low + 1)
        return pd.Series(out)

    return run


def head(first: str, fields: list[tuple[str, object]]) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def target(url: str | None, page_id: int | None) -> str:
    """The URL, with what no header line may hold percent-encoded."""
    return quote(url, safe="".join(map(chr, range(33, 127)))) if url is not None else f"urn:page:{'' if page_id is None else page_id}"


def record_id(page_id: int | None, tie: int, nth: str = "0") -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{tie}:{nth}')}>"


def member(raw: bytes, level: int) -> bytes:
    """A gzip member without name and time."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    return head("WARC/1.1", [*fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", len(block))]) + block + b"\r\n\r\n"


def page_record(key: dict, html: bytes, sha1: str, nth: str, date: str) -> bytes:
    """A response, or a revisit if the key has an original. sha1: of the payload, in base 32."""
    http = head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(html))])
    mine = lambda x: "" if x is None else x
    fields: list[tuple[str, object]] = [("WARC-Type", "response" if key["own"] else "revisit"), ("WARC-Record-ID", record_id(key["page_id"], key["tie"], nth)), ("WARC-Date", date), ("WARC-Target-URI", target(key["url"], key["page_id"]))]
    fields += [("WARC-Payload-Digest", f"sha1:{sha1}"), ("Page-ID", mine(key["page_id"]))]
    if not key["own"]:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(key["first"], key["first_tie"])),
            ("WARC-Refers-To-Target-URI", target(key["first_url"], key["first"])), ("WARC-Refers-To-Date", date), ("Refers-To-Page-ID", mine(key["first"])),
        ]
    return record([*fields, ("Content-Type", "application/http;msgtype=response")], http if not key["own"] else http + html)


class Files:
    """The files of one shard: rolled by compressed size, moved to their names when they are whole."""

    def __init__(self, folder: str, shard: int, roll: int, level: int, date: str):
        (self.fs, self.base), self.shard, self.roll, self.level, self.date = store(folder), shard, roll, level, date
        self.nth, self.out, self.stretches = 0, None, []

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self.name = f"pages-{self.shard:06d}-{self.nth:05d}.warc.gz"
            self.temporary = f"{self.base}/_temporary-{uuid.uuid4().hex}-{self.name}"
            self.out, self.size, self.begin, self.count = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, 0
            fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, self.name)}>"), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
            self._write(record(fields, f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode()))
        self._write(raw)
        self.count += 1
        if self.size - self.begin >= STRETCH:
            self._stretch()
        if self.size >= self.roll:
            self.close()

    def _write(self, raw: bytes) -> None:
        data = member(raw, self.level)
        self.out.write(data)
        self.size += len(data)

    def _stretch(self) -> None:
        if self.count:
            self.stretches.append((self.name, self.begin, self.size, self.count))
        self.begin, self.count = self.size, 0

    def close(self) -> None:
        if self.out is not None:
            self._stretch()
            self.out.close()
            self.fs.move(self.temporary, f"{self.base}/{self.name}")
            self.out, self.nth = None, self.nth + 1


def write(pages: DataFrame, folder: str, min_bytes: int = 0, shard_bytes: int = SHARD, roll_bytes: int = ROLL, level: int = 6, date: str = DATE) -> DataFrame:
    """Writes the archive of pages (page_id, url, html) into an empty folder and returns its manifest: file, begin, end, records."""
    spark = pages.sparkSession
    small_batches(spark)
    shared, rows = qualified(spark, folder), records(pages)
    keys = scratch(verdicts(rows, min_bytes), "warc-verdicts", 2)
    total = keys.agg(F.coalesce(F.sum(F.col("copies") * (F.col("n") + HEADER)), F.lit(0))).first()[0]
    shards = max(partitions(spark), -(-total // shard_bytes))
    keys = scratch(placed(keys, max(1, -(-total // shards))), "warc-shards", 2)
    # one row a shard: the least key of those that begin in it, and the keys whose copies reach beyond it
    openings = [(r["k"]["order"], r["k"]["tie"], r["low"]) for r in keys.groupBy("low").agg(F.min(F.struct("order", "tie")).alias("k")).orderBy("k").collect()]
    spread = [tuple(r) for r in keys.where("high > low").select("order", "tie", "low", "high").collect()]
    sha = F.base64(F.unhex("sha"))
    if not openings:
        out = spark.createDataFrame([], MANIFEST)
        out.write.parquet(f"{folder}/manifest")
        return out
    find = shard_of(openings, spread)
    payloads = rows.withColumn("place", F.monotonically_increasing_id()).select(find("order", "tie", "place").alias("shard"), "order", "tie", F.lit(1).alias("kind"), "html", sha.alias("sha"))
    about = keys.withColumn("shard", F.explode(F.sequence("low", "high"))).withColumn("spread", F.col("shard") - F.col("low"))
    about = about.select("shard", "order", "tie", F.lit(0).alias("kind"), F.struct("page_id", "url", "tie", "own", "first", "first_url", "first_tie", "spread").alias("key"))
    both = payloads.unionByName(about, allowMissingColumns=True)
    dealt = both.repartitionById(shards, "shard").sortWithinPartitions("shard", "order", "tie", "kind")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, key, nth = None, None, 0
        done = lambda files: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*files.stretches, strict=True) if files.stretches else ((),) * 4, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["file", "begin", "end", "records"])
        for batch in batches:
            shard, html, shas, about = (batch.column(c) for c in ("shard", "html", "sha", "key"))
            for k in range(batch.num_rows):
                if files is None or files.shard != shard[k].as_py():
                    if files is not None:
                        files.close()
                        yield done(files)
                    files = Files(shared, shard[k].as_py(), roll_bytes, level, date)
                if about[k].is_valid:
                    key, nth = about[k].as_py(), 0
                    continue
                sha1 = base64.b32encode(base64.b64decode(shas[k].as_py())).decode()
                files.add(page_record(key, html[k].as_buffer().to_pybytes(), sha1, f"{key['spread']}-{nth}" if nth or key["spread"] else "0", date))
                nth += 1
        if files is not None:
            files.close()
            yield done(files)

    dealt.select("shard", "html", "sha", "key").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")  # Spark's own commit makes the archive whole
    return manifest(spark, folder)



def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(stream, size: int) -> Iterator[bytes]:
    """The uncompressed gzip members of the next size bytes of a stream."""
    z, parts, waiting = zlib.decompressobj(31), [], b""
    while size or waiting:
        if not waiting:
            waiting = stream.read(min(size, 1 << 20))
            if not waiting:
                raise ValueError("the file ends before its manifest says")
            size -= len(waiting)
        parts.append(z.decompress(waiting))
        waiting = b""
        if z.eof:
            yield b"".join(parts)
            waiting, z, parts = z.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("a record is cut off")


FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of a record."""
    end = raw.index(b"\r\n\r\n") + 4
    if not raw.startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    fields = {k.decode().lower(): v.decode() for k, v in FIELD.findall(raw, raw.index(b"\r\n") + 2, end - 2)}
    return fields, raw[end : end + int(fields["content-length"])]


def checked(fields: dict[str, str], block: bytes) -> tuple:
    """The row of a record: its digests are computed anew and must be those that it states."""
    if fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"{fields['warc-record-id']}: the block has another digest")
    end = block.index(b"\r\n\r\n") + 4
    payload, kind, stated = block[end:], fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    length = int(dict(FIELD.findall(block[:end]))[b"Content-Length"])
    if kind == "response" and (digest(payload) != stated or len(payload) != length):
        raise ValueError(f"{fields['warc-record-id']}: the payload has another digest or length")
    number = lambda name: int(fields[name]) if fields.get(name) else None
    return number("page-id"), fields["warc-target-uri"], fields["warc-record-id"], length, stated, kind, number("refers-to-page-id"), fields.get("warc-refers-to"), payload.decode("utf-8", "replace") if kind == "response" else None


ROWS = {"page_id": "long", "uri": "string", "record_id": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "refers_to_record": "string", "html": "string"}
ARROW = {"long": pa.int64(), "string": pa.string()}


def read(spark: SparkSession, folder: str, columns: tuple[str, ...] = tuple(ROWS)) -> DataFrame:
    """The records of an archive with a manifest, one row each, all digests checked; html is null for revisits."""
    at, shared = [list(ROWS).index(c) for c in columns], qualified(spark, folder)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(shared)
        for batch in batches:
            for name, begin, end in zip(*(batch.column(c).to_pylist() for c in ("file", "begin", "end")), strict=True):
                with fs.open_input_file(f"{base}/{name}") as stream:
                    stream.seek(begin)
                    rows, size = [], 0
                    for raw in members(stream, end - begin):
                        fields, block = parsed(raw)
                        if fields["warc-type"] != "warcinfo":
                            rows.append(checked(fields, block))
                            size += len(raw)
                        if size > STRETCH:
                            yield packed(rows)
                            rows, size = [], 0
                    if rows:
                        yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], ARROW[ROWS[c]]) for k, c in zip(at, columns, strict=True)], list(columns))

    stretches = manifest(spark, folder).repartition(partitions(spark), "file", "begin")
    return stretches.mapInArrow(run, ", ".join(f"{c} {ROWS[c]}" for c in columns))
