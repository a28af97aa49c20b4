"""Streams that remember one thing a key: pauses in typing, throttled reports, bounced clicks (STR4, STR6, STR7).

A key's rows are handed on in the order of their time, whatever order they came in: they
wait as state until the watermark has passed them, which a timer tells; one timer, for the
first of them, as it hands on all that are due. Besides them a key has one held row at most, which lapses at a time of its own; then nothing is left of
the key. So state is bounded by what a key sends within the watermark's delay, and the
result is that of the batch form.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What every stream here consists of; ``text`` is a query or a phase, ``kind`` the event's type.
ROWS = "ms long, event_id long, kind string, text string"


class InOrder(StatefulProcessor):
    """Subclasses tell what a row does to the held one (``step``), when that lapses and what comes of it then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "rows string")  # a batch's rows in one value, as each value costs a call of the JVM
        self.held = handle.getValueState("held", ROWS)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        fresh = [(r["ms"], r["event_id"], r["kind"], r["text"]) for r in rows]
        self.pending.appendValue((json.dumps(fresh),))
        self.handle.registerTimer(min(r[0] for r in fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        # All rows up to the watermark are there; a timer set for before it would wait for the next one.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        rows = sorted((tuple(r) for part in self.pending.get() for r in json.loads(part[0])), key=lambda r: r[:2]) if self.pending.exists() else []
        due = [r for r in rows if r[0] <= now]
        if due:
            if len(due) == len(rows):
                self.pending.clear()
            else:
                self.pending.put([(json.dumps(rows[len(due) :]),)])
        if len(due) < len(rows):
            self.handle.registerTimer(rows[len(due)][0])
        held = tuple(self.held.get()) if self.held.exists() else None
        before = held
        for row in due:
            if held is not None and self.until(held) <= row[0]:
                yield from self.lapse(key, held)
                held = None
            out, held = self.step(key, held, row)
            yield from out
        if held is not None and self.until(held) <= now:
            yield from self.lapse(key, held)
            held = None
        if held is None:
            if before is not None:
                self.held.clear()
        elif held != before:
            self.held.update(held)
            self.handle.registerTimer(self.until(held))

    def close(self) -> None:
        pass

    def until(self, held: tuple) -> int:
        raise NotImplementedError

    def step(self, key, held: tuple | None, row: tuple) -> tuple[list[Row], tuple | None]:
        raise NotImplementedError

    def lapse(self, key, held: tuple) -> list[Row]:
        return []


class Debounce(InOrder):
    """A text is passed on when its key has sent nothing for a while; what comes sooner cancels it."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def until(self, held):
        return held[0] + self.gap

    def step(self, key, held, row):
        return [], row

    def lapse(self, key, held):
        return [Row(key=key[0], event_id=held[1], text=held[3])]


class Throttle(InOrder):
    """A report is passed on when its phase is new, or when a while has gone since the last; the held row is that last one."""

    def __init__(self, every_ms: int):
        self.every = every_ms

    def until(self, held):
        return held[0] + self.every  # after that any report is passed on, so nothing needs to be known

    def step(self, key, held, row):
        if held is not None and held[3] == row[3]:
            return [], held
        return [Row(key=key[0], event_id=row[1], text=row[3])], row


class Bounces(InOrder):
    """A click bounces when the next thing its user does is another search within a while, and not by typing on."""

    def __init__(self, within_ms: int):
        self.within = within_ms

    def until(self, held):
        return held[0] + self.within + 1

    def step(self, key, held, row):
        out = []
        if held is not None:
            a, b = (held[3] or "").lower(), (row[3] or "").lower()
            typed_on = a.startswith(b) or b.startswith(a)
            out.append(Row(event_id=held[1], user_id=key[0], query=held[3] or "", is_bounce=row[2] == "view" and not typed_on))
        return out, row if row[2] == "click" else None

    def lapse(self, key, held):
        return [Row(event_id=held[1], user_id=key[0], query=held[3] or "", is_bounce=False)]


def _run(events: DataFrame, key: str, text: str, kind: str | None, late: str, processor: InOrder, out: str) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    ts = F.col("ts").cast("timestamp")
    told = F.col(kind) if kind else F.lit(None).cast("string")
    rows = events.select(F.col(key).alias("key"), ts.alias("ts"), F.unix_millis(ts).alias("ms"), "event_id", told.alias("kind"), F.col(text).alias("text"))
    return rows.withWatermark("ts", late).groupBy("key").transformWithState(processor, out, "append", "eventTime")


def debounced(events: DataFrame, key: str = "user_id", text: str = "query", gap: float = 0.25, late: str = "1 minute") -> DataFrame:
    """STR6: (key, event_id, text): what a key typed last before a pause of ``gap`` seconds; later keystrokes cancel earlier ones."""
    return _run(events, key, text, None, late, Debounce(round(gap * 1000)), f"key {dict(events.dtypes)[key]}, event_id long, text string")


def throttled(events: DataFrame, key: str = "user_id", phase: str = "phase", every: float = 0.5, late: str = "0 seconds") -> DataFrame:
    """STR7: (key, event_id, text): each change of phase, else one report when ``every`` seconds have gone since the last."""
    return _run(events, key, phase, None, late, Throttle(round(every * 1000)), f"key {dict(events.dtypes)[key]}, event_id long, text string")


def bounces(events: DataFrame, within_seconds: float = 10.0, late: str = "1 minute") -> DataFrame:
    """STR4: (event_id, user_id, query, is_bounce): each click, known when the user's next event comes or the time is up. Events: event_id, user_id, ts, event_type, query."""
    return _run(events, "user_id", "query", "event_type", late, Bounces(round(within_seconds * 1000)), f"event_id long, user_id {dict(events.dtypes)['user_id']}, query string, is_bounce boolean")
