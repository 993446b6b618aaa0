"""Keyed state that ends: slots of sessions, histories in a cache, and quotas, as stateful processors with lists, values and event-time timers.

Rows of a batch are taken in order of (at, place). What a key holds is bounded by its slots or its newest entries, and a timer clears it once its time is
up, so state doesn't grow with the keys that ever were. State lives in RocksDB and its checkpoint, so a lost executor's keys are read again. A row that comes
after its key's time was up begins anew even where the watermark, and so the timer, has not got there yet."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds that a list in the cache lives after its last entry, entries that it gives, sessions of a user, tokens of a session.
TTL, NEWEST, SLOTS, LIMIT = 3_600, 50, 1, 50_000
LATE = "10 minutes"


def with_store(spark: SparkSession) -> None:
    """Processors need RocksDB; a provider that the session has stays."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, ROCKS)


def ordered(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """A batch's rows of one key in order, at in milliseconds."""
    rows = pd.concat(list(frames), ignore_index=True)
    rows["at"] = rows["at"].astype("datetime64[ns]").astype("int64") // 1_000_000
    return rows.sort_values(["at", "place"], kind="stable").itertuples(index=False)


class _Timed(StatefulProcessor):
    """A processor whose key has a time until which it lives, as a value and a timer."""

    ttl_ms: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def over(self, at: int) -> bool:
        return self.until.exists() and at > self.until.get()[0]

    def renew(self, at: int) -> None:
        until = at + self.ttl_ms
        if self.until.exists():
            if self.until.get()[0] >= until:
                return
            self.handle.deleteTimer(self.until.get()[0])
        self.until.update((until,))
        self.handle.registerTimer(until)

    def forget(self) -> None:
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
        self.until.clear()

    def expired(self, key, info) -> bool:
        return self.until.exists() and self.until.get()[0] <= info.getExpiryTimeInMs()

    def close(self) -> None:
        pass


class Slots(_Timed):
    """The last n sessions of a user: 'add' takes a slot and pushes out the oldest, 'remove' gives one back, 'check' says whether a session holds one.
    Slots of a user who does nothing for the whole time are given back."""

    def __init__(self, n: int, ttl: int):
        self.n, self.ttl_ms = n, ttl * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getListState("sessions", "session string")

    def _sessions(self) -> list[str]:
        return [s[0] for s in self.held.get()] if self.held.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = self._sessions(), []
        for row in ordered(rows):
            if self.over(row.at):
                out += [(key[0], s, "expired") for s in held]
                held = []
            if row.action == "add":
                held.append(row.session)
                out += [(key[0], s, "pushed out") for s in held[: -self.n]] + [(key[0], row.session, "added")]
                held = held[-self.n :]
            elif row.action == "remove":
                out.append((key[0], row.session, "removed" if row.session in held else "unknown"))
                held = [s for s in held if s != row.session]
            else:
                out.append((key[0], row.session, "active" if row.session in held else "inactive"))
            if held:
                self.renew(row.at)
            else:
                self.forget()
        if held:
            self.held.put([(s,) for s in held])
        else:
            self.held.clear()
        yield pd.DataFrame(out, columns=["user_id", "session", "event"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.expired(key, expiredTimerInfo):
            gone = self._sessions()
            self.held.clear()
            self.until.clear()
            yield pd.DataFrame([(key[0], s, "expired") for s in gone], columns=["user_id", "session", "event"])


class History(_Timed):
    """A session's newest messages: 'push' appends one and renews the list's time, 'read' gives what is held, newest last, or says that nothing is, so that
    the table must be asked. A list whose time is up is gone."""

    def __init__(self, newest: int, ttl: int):
        self.newest, self.ttl_ms = newest, ttl * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getListState("messages", "message string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out, changed = [m[0] for m in self.held.get()] if self.held.exists() else [], [], False
        for row in ordered(rows):
            if self.over(row.at):
                out.append((key[0], int(row.place), "gone", []))
                held, changed = [], True
                self.forget()
            if row.action == "push":
                held, changed = [*held, row.message][-self.newest :], True
                self.renew(row.at)
            else:
                out.append((key[0], int(row.place), "hit" if held else "miss", list(held)))
        if changed:
            self.held.put([(m,) for m in held]) if held else self.held.clear()
        yield pd.DataFrame(out, columns=["session", "place", "event", "messages"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.expired(key, expiredTimerInfo):
            self.held.clear()
            self.until.clear()
            yield pd.DataFrame([(key[0], -1, "gone", [])], columns=["session", "place", "event", "messages"])


class Quota(_Timed):
    """Tokens of a session against its limit: answers are given before they are counted, so the one that breaks the limit still comes and nothing
    after it does. The count begins anew once the time is up."""

    def __init__(self, limit: int, ttl: int):
        self.limit, self.ttl_ms = limit, ttl * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.spent = handle.getValueState("spent", "tokens long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spent, out = self.spent.get()[0] if self.spent.exists() else 0, []
        for row in ordered(rows):
            if self.over(row.at):
                spent = 0
                self.forget()
            given = spent <= self.limit
            if given:
                spent += int(row.tokens)
                if not self.until.exists():
                    self.renew(row.at)  # the time runs from a count's first answer
            out.append((key[0], int(row.place), given, spent))
        self.spent.update((spent,))
        yield pd.DataFrame(out, columns=["session", "place", "given", "total"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.expired(key, expiredTimerInfo):
            self.spent.clear()
            self.until.clear()
        return iter(())


def _processed(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    with_store(rows.sparkSession)
    timed = rows.withWatermark("at", LATE)
    return timed.groupBy(key).transformWithStateInPandas(processor, schema, "Update", "EventTime")


def session_slots(events: DataFrame, n: int = SLOTS, ttl: int = 86_400) -> DataFrame:
    """user_id, session, event. events: user_id, session, action ('add', 'remove', 'check'), at (timestamp), place."""
    return _processed(events.select("user_id", "session", "action", "at", "place"), "user_id", Slots(n, ttl), "user_id long, session string, event string")


def cached_history(events: DataFrame, newest: int = NEWEST, ttl: int = TTL) -> DataFrame:
    """session, place, event, messages. events: session, action ('push', 'read'), message, at, place. place is -1 where a timer fired."""
    return _processed(events.select("session", "action", "message", "at", "place"), "session", History(newest, ttl), "session long, place long, event string, messages array<string>")


def quota_gate(answers: DataFrame, limit: int = LIMIT, ttl: int = 86_400) -> DataFrame:
    """session, place, given, total. answers: session, tokens, at, place."""
    return _processed(answers.select("session", "tokens", "at", "place"), "session", Quota(limit, ttl), "session long, place long, given boolean, total long")
