"""WARC archives against a group-by in plain Python and a reader of their own."""

import base64
import gzip
import hashlib
import os
from collections import defaultdict

import pytest

from sparkloom.llm import warc

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def by_hand(rows, min_bytes=0):
    per = defaultdict(list)
    for page_id, _, html, *_ in rows:
        per[html or ""].append(page_id)
    out = []
    for html, ids in per.items():
        raw = html.encode()
        known = [i for i in ids if i is not None]
        first = min(known) if known else None
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out += [(i, len(raw), sha, *(("response", None) if i == first or len(raw) < min_bytes else ("revisit", first))) for i in ids]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    found = [(k * 7 % 400, f"http://host/{k}?q=ü\r\nX: y", f"<html>{k % 90}" + "body é 日本 " * (k % 50), "h") for k in range(400)]
    found += [(None, None, "nameless", "h"), (None, "u", None, None), (5, "a", "", "h"), (2**63 - 1, "b", "<html>3", "h"), (-(2**63), "c", "twice", "h"), (9, "d", "twice", "h"), (9, "d", "twice", "h")]
    return found + [(1000, "hot", "the same page", "h")] * 300 + [(1001, "long", "0123456789abcdef é\n" * 60_000, "h")]


@pytest.fixture(scope="module")
def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, shard string").repartition(5)


def test_round_trip(spark, pages, rows, tmp_path):
    listed = warc.write(pages, str(tmp_path / "a"), shard_bytes=40_000, roll_bytes=3_000)
    got = warc.read(spark, str(tmp_path / "a")).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == by_hand(rows)
    assert listed.agg({"records": "sum"}).first()[0] == len(rows)
    assert len({r["record_id"] for r in got}) == len(got)
    originals = {r["record_id"]: r["html"] for r in got if r["record_type"] == "response"}
    assert all(hashlib.sha1(originals[r["refers_to_record"]].encode()).digest() == base64.b32decode(r["payload_digest"]) for r in got if r["record_type"] == "revisit")
    assert {r["uri"] for r in got if r["page_id"] is None} == {"urn:page:", "u"}
    assert not [f for f in os.listdir(tmp_path / "a") if f.startswith("_temporary")]


def test_files_are_deterministic_sorted_and_rolled(spark, pages, rows, tmp_path):
    warc.write(pages, str(tmp_path / "a"), shard_bytes=40_000, roll_bytes=3_000)
    warc.write(spark.createDataFrame(rows, pages.schema).coalesce(1), str(tmp_path / "b"), shard_bytes=40_000, roll_bytes=3_000)
    names = sorted(f for f in os.listdir(tmp_path / "a") if f.endswith(".gz"))
    assert names == sorted(f for f in os.listdir(tmp_path / "b") if f.endswith(".gz")) and len(names) > 20
    order, hot = [], set()
    for name in names:
        one, two = ((tmp_path / x / name).read_bytes() for x in "ab")
        text = gzip.decompress(one)
        ids = [int(line[9:]) if line[9:] else 2**63 for line in text.split(b"\r\n") if line.startswith(b"Page-ID: ")]
        order += ids
        if 1000 in ids:
            hot.add(name.rsplit("-", 1)[0])
        else:
            assert one == two  # equal rows lie in as many shards as their bytes need, by their place in the table
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and text.count(b"WARC/1.1\r\n") == len(ids) + 1
    assert order == sorted(order) and len(order) == len(rows)
    assert len(hot) > 2


def test_smaller_payloads_are_responses(spark, pages, rows, tmp_path):
    warc.write(pages, str(tmp_path / "a"), min_bytes=100)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in warc.read(spark, str(tmp_path / "a"), COLUMNS).collect()), key=str) == by_hand(rows, 100)


def test_what_the_manifest_does_not_name_is_not_read(spark, pages, rows, tmp_path):
    warc.write(pages, str(tmp_path / "a"))
    (tmp_path / "a" / "_temporary-x-pages-000000-00000.warc.gz").write_bytes(b"half a file")
    (tmp_path / "a" / "pages-999999-00000.warc.gz").write_bytes(b"of another run")
    assert warc.read(spark, str(tmp_path / "a")).count() == len(rows)


def test_changed_bytes_are_found(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", "some text")], "page_id long, url string, html string"), str(tmp_path / "a"))
    (name,) = [f for f in os.listdir(tmp_path / "a") if f.endswith(".gz")]
    listed = warc.manifest(spark, str(tmp_path / "a")).first()
    raw = (tmp_path / "a" / name).read_bytes()
    parts = list(warc.members(__import__("io").BytesIO(raw), len(raw)))
    fields, block = warc.parsed(parts[1])
    assert warc.checked(fields, block)[3] == 9 and listed["end"] == len(raw)
    with pytest.raises(ValueError, match="digest"):
        warc.checked(fields, block.replace(b"some", b"more"))
    with pytest.raises(ValueError, match="ends before"):
        list(warc.members(__import__("io").BytesIO(raw[:-5]), len(raw)))


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write(empty, str(tmp_path / "a")).count() == 0 and warc.read(spark, str(tmp_path / "a")).count() == 0
