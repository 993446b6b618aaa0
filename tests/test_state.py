"""Keyed state over several batches: membership, removal, expiry by timers, and quotas that stop a session."""

import os

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import state


@pytest.fixture
def batches(spark, tmp_path):
    """Rows of each batch as a file; the stream reads a file a batch."""

    def made(schema, *parts):
        folder = tmp_path / "in"
        for k, rows in enumerate(parts):
            df = spark.createDataFrame(rows, schema.replace("at timestamp", "at long"))
            df.coalesce(1).write.json(str(tmp_path / f"p{k}"))
            (name,) = [f for f in os.listdir(tmp_path / f"p{k}") if f.endswith(".json")]
            folder.mkdir(exist_ok=True)
            os.rename(tmp_path / f"p{k}" / name, folder / f"{k}.json")
            os.utime(folder / f"{k}.json", (1_000_000 + k, 1_000_000 + k))
        return spark.readStream.schema(schema.replace("at timestamp", "at long")).option("maxFilesPerTrigger", 1).json(str(folder)).withColumn("at", F.timestamp_seconds(F.col("at") + 1_700_000_000))

    return made


def results(df, name):
    q = df.writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


HOUR = 3600


def test_slots(spark, batches):
    rows = batches(
        "user_id long, session string, action string, at timestamp, place long",
        [(1, "a", "add", 0, 0), (1, "b", "add", 10, 1), (2, "x", "add", 5, 0), (1, "a", "check", 20, 2)],
        [(1, "c", "add", 100, 0), (1, "a", "check", 101, 1), (1, "b", "check", 102, 2), (1, "b", "remove", 103, 3), (1, "b", "check", 104, 4), (2, "zz", "remove", 104, 0)],
        [(3, "far", "add", 50 * HOUR, 0)],
        [(3, "far", "check", 50 * HOUR + 1, 1)],
        [(1, "c", "check", 51 * HOUR, 0), (2, "x", "check", 51 * HOUR, 0)],
    )
    got = results(state.session_slots(rows, n=2, ttl=24 * HOUR), "slots_test")
    said = lambda user: [(s, e) for u, s, e in got if u == user]
    assert said(1) == [
        ("a", "added"), ("b", "added"), ("a", "active"), ("a", "pushed out"), ("c", "added"), ("a", "inactive"), ("b", "active"), ("b", "removed"), ("b", "inactive"), ("c", "expired"), ("c", "inactive"),
    ]
    assert said(2) == [("x", "added"), ("zz", "unknown"), ("x", "expired"), ("x", "inactive")]


def test_history(spark, batches):
    rows = batches(
        "session long, action string, message string, at timestamp, place long",
        [(7, "push", f"m{k}", k, k) for k in range(5)] + [(7, "read", None, 6, 6), (8, "read", None, 1, 0)],
        [(7, "push", "m5", 3000, 7), (7, "read", None, 3000 + HOUR, 8)],
        [(7, "read", None, 3002 + HOUR, 9), (7, "push", "again", 3003 + HOUR, 10), (7, "read", None, 3004 + HOUR, 11)],
        [(9, "push", "later", 20 * HOUR, 0)],
        [(9, "push", "and later", 20 * HOUR + 1, 1)],  # the watermark has passed the list's time: its timer fires
        [(7, "read", None, 21 * HOUR, 12)],
    )
    got = [r[1:] for r in results(state.cached_history(rows, newest=3), "history_test") if r[0] == 7]
    assert got == [(6, "hit", ["m2", "m3", "m4"]), (8, "hit", ["m3", "m4", "m5"]), (9, "gone", []), (9, "miss", []), (11, "hit", ["again"]), (-1, "gone", []), (12, "miss", [])]


def test_quota(spark, batches):
    rows = batches(
        "session long, tokens long, at timestamp, place long",
        [(1, 40, 0, 0), (1, 50, 1, 1), (2, 500, 1, 0)],
        [(1, 30, 2, 2), (1, 5, 3, 3), (2, 1, 4, 1)],
        [(3, 1, 90 * HOUR, 0)],
        [(1, 7, 91 * HOUR, 4), (2, 8, 91 * HOUR, 2)],
    )
    got = results(state.quota_gate(rows, limit=100), "quota_test")
    assert [r[1:] for r in got if r[0] == 1] == [(0, True, 40), (1, True, 90), (2, True, 120), (3, False, 120), (4, True, 7)]
    assert [r[1:] for r in got if r[0] == 2] == [(0, True, 500), (1, False, 500), (2, True, 8)]
