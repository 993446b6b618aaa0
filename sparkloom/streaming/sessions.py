"""Structured Streaming twins of the batch reports: windows by event time with a watermark, and keyed state. The reference workload has no
streams; these are an extension for the same tables arriving bit by bit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.operators.cases import STATES

LATE = "1 day"


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Files of a table's folder as they come."""
    return spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def daily_report(events: DataFrame) -> DataFrame:
    """Counts and values by day and kind; days close when the watermark passes them."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", LATE)
    return timed.groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))


def first_time(events: DataFrame) -> DataFrame:
    """Each event once, though it may arrive again within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", LATE).dropDuplicatesWithinWatermark(["event_id"])


def capped_slots(events: DataFrame, n: int) -> DataFrame:
    """user_id, slots: the last n sign-ups of each user, kept as state and emitted whenever they change."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for frame in frames:
            held += list(zip(frame.ts.astype("int64").tolist(), frame.event_id.tolist(), strict=True))
        held = sorted(set(held))[-n:] if n else sorted(set(held))
        state.update(([x[0] for x in held], [x[1] for x in held]))
        yield pd.DataFrame({"user_id": [key[0]], "slots": [[x[1] for x in held]]})

    rows = events.where("event_type = 'signup'").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, slots array<long>", "at array<long>, ids array<long>", "update", "NoTimeout")


def case_stream(events: DataFrame) -> DataFrame:
    """session, active, states: the cases of a session, kept as state and emitted whenever they change; the twin of cases.case_states for events
    (session, place, action, target) that arrive bit by bit. Those of one batch are taken in order of place."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        active, states = state.get if state.exists else (0, [])
        states = list(states)
        for row in pd.concat(frames).sort_values("place").itertuples():
            if row.action == "new":
                states.append(STATES["new"])
                active = len(states)
            elif row.action == "switch" and 1 <= row.target <= len(states):
                active = int(row.target)
            elif row.action in STATES and active:
                states[active - 1] = STATES[row.action]
        state.update((active, states))
        yield pd.DataFrame({"session": [key[0]], "active": [active], "states": [states]})

    return events.groupBy("session").applyInPandasWithState(step, "session long, active int, states array<string>", "active int, states array<string>", "update", "NoTimeout")
