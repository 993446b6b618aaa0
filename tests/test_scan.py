"""Sheets as a data source: bad lines, ranges, encodings, and folders that are never opened."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import scan


def put(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_bad_lines_are_counted(spark, tmp_path):
    put(tmp_path, "gst/2020/a.csv", 'note\n\nID,Query,Extra\n1,"two\nlines",x\n2,short\n3,a,b,c,d\n , ,\n4,"café ""quoted""",\n5,"never closed\n6,x,y\n')
    rows = scan.read_sheets(spark, str(tmp_path), ["ID", "Query"]).orderBy("line").collect()
    good = [(r["line"], r["cells"]["ID"], r["cells"].get("Query"), r["category"], r["year"]) for r in rows if r["bad"] is None]
    assert good == [(3, "1", "two\nlines", "gst", "2020"), (5, "2", "short", "gst", "2020"), (8, "4", 'café "quoted"', "gst", "2020")]
    assert [(r["line"], r["bad"]) for r in rows if r["bad"] is not None] == [(6, "3,a,b,c,d"), (9, '5,"never closed\n6,x,y')]
    counts = scan.read_sheets(spark, str(tmp_path), ["ID", "Query"]).agg(F.count("bad"), F.count("cells")).first()
    assert tuple(counts) == (2, 3)


def test_folders_are_pruned(spark, tmp_path):
    """Files of other categories and years would fail if they were opened."""
    put(tmp_path, "gst/2020/a.csv", "ID,Query\n1,x\n")
    put(tmp_path, "gst/2021/b.CSV", "ID,Query\n2,y\n")
    put(tmp_path, "gst/2021/c.txt", "no sheet")
    put(tmp_path, "other/2021/bad.csv", "nothing of the kind\n")
    ids = lambda **where: sorted(r["cells"]["ID"] for r in scan.read_sheets(spark, str(tmp_path), ["ID", "Query"], **where).collect())
    assert ids(category=["gst"]) == ["1", "2"] and ids(category=["gst"], year=["2021"]) == ["2"] and ids(category=["gst", "none"], year=["2020", "1999"]) == ["1"]
    with pytest.raises(Exception, match="no header"):
        ids()


@pytest.mark.parametrize("split", [7, 64, 100_000])
def test_ranges(spark, tmp_path, split):
    rng = random.Random(split)
    lines = [f"{k},{'é' * rng.randrange(9)}{rng.choice(['', 'x,y,z'])}" for k in range(120)]
    put(tmp_path, "a.csv", "﻿ID,Query\r\n" + "\r\n".join(lines) + rng.choice(["", "\r\n"]))
    rows = scan.read_sheets(spark, str(tmp_path), ["ID", "Query"], split=split)
    assert rows.rdd.getNumPartitions() == max(1, -(-(tmp_path / "a.csv").stat().st_size // split))
    got = rows.orderBy("line").collect()
    assert [(r["cells"]["ID"] + "," + r["cells"]["Query"]) if r["bad"] is None else r["bad"] for r in got] == lines
    whole = scan.read_sheets(spark, str(tmp_path), ["ID", "Query"]).count()
    assert whole == len(lines)


def test_encodings(spark, tmp_path):
    for name, encoding in (("a", "utf-8-sig"), ("b", "cp1252"), ("c", "utf-8")):
        put(tmp_path, f"{name}.csv", "ID,Query\n1,“café” €\n".encode(encoding))
    put(tmp_path, "d.csv", b"ID,Query\n1,\x81\xe9\n")
    got = {r["file"][-5]: r["cells"]["Query"] for r in scan.read_sheets(spark, str(tmp_path), ["ID"]).collect()}
    assert got == {"a": "“café” €", "b": "“café” €", "c": "“café” €", "d": "\x81é"}
