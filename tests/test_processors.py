"""Streams with state: pauses, throttled reports and bounces as their batch forms have them, in any order of arrival and after a restart."""

import datetime
import random

import pytest

from lumenspan.streaming import processors

START = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, ts timestamp, event_type string, query string"


def rows(n, seed):
    rng, out, now = random.Random(seed), [], {}
    for i in range(n):
        user = rng.randrange(4)
        now[user] = now.get(user, 0) + rng.choice([0, 40, 90, 200, 249, 250, 251, 400, 900, 11_000])
        out.append((i, user, now[user], rng.choice(["click", "view"]), rng.choice(["p", "pl", "plan", "road", None])))
    return out


def plain_debounce(events, gap):
    out = set()
    for user in {e[1] for e in events}:
        own = sorted((e[2], e[0]) for e in events if e[1] == user)
        out |= {i for k, (ms, i) in enumerate(own) if k + 1 == len(own) or own[k + 1][0] - ms >= gap}
    return out


def plain_throttle(events, every):
    out = set()
    for user in {e[1] for e in events}:
        fired = before = None
        for ms, i, phase in sorted((e[2], e[0], e[3]) for e in events if e[1] == user):
            if fired is None or phase != before or ms - fired >= every:
                out.add(i)
                fired = ms
            before = phase
    return out


def plain_bounces(events, within):
    out = {}
    for user in {e[1] for e in events}:
        own = sorted((e[2], e[0], e[3], e[4] or "") for e in events if e[1] == user)
        for k, (ms, i, kind, query) in enumerate(own):
            if kind == "click":
                after = own[k + 1] if k + 1 < len(own) else None
                out[i] = bool(after and after[2] == "view" and after[0] - ms <= within and not (query.startswith(after[3]) or after[3].startswith(query)))
    return out


@pytest.mark.parametrize("what", ["debounce", "throttle", "bounces"])
def test_stream_is_batch(spark, tmp_path, what):
    """Rows come shuffled within the watermark's delay, in files that two runs of one checkpoint read."""
    events = rows(120, 7)
    shuffled = sorted(events, key=lambda e: (e[2] // 30_000, random.Random(e[0]).random()))
    made = lambda part: spark.createDataFrame([(i, u, START + datetime.timedelta(milliseconds=ms), k, q) for i, u, ms, k, q in part], SCHEMA)
    last = [(-1, -1, 10_000_000, "end", "end")]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        job = {"debounce": lambda: processors.debounced(stream, late="1 minute"), "throttle": lambda: processors.throttled(stream, phase="event_type", late="1 minute"), "bounces": lambda: processors.bounces(stream, 10.0)}[what]()
        job.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()

    made(shuffled[:60]).coalesce(1).write.mode("append").parquet(source)
    run()
    made(shuffled[60:]).coalesce(1).write.mode("append").parquet(source)
    made(last).coalesce(1).write.mode("append").parquet(source)
    run()
    got = [r for r in spark.read.parquet(out).collect() if r["event_id"] >= 0]
    assert len(got) == len({r["event_id"] for r in got})
    if what == "bounces":
        assert {r["event_id"]: r["is_bounce"] for r in got} == plain_bounces(events, 10_000)
    else:
        want = plain_debounce(events, 250) if what == "debounce" else plain_throttle(events, 500)
        assert {r["event_id"] for r in got} == want


class Held:
    """State of one key in plain lists; tells how often timers were set."""

    def __init__(self):
        self.timers, self.set, self.values = set(), 0, {}

    def registerTimer(self, ms):  # noqa: N802
        self.timers.add(ms)
        self.set += 1

    def getListState(self, name, schema):  # noqa: N802
        return Cell(self.values, name)

    getValueState = getListState


class Cell:
    def __init__(self, values, name):
        self.values, self.name = values, name

    def exists(self):
        return self.name in self.values

    def get(self):
        return self.values[self.name]

    def appendValue(self, row):  # noqa: N802
        self.values[self.name] = [*self.values.get(self.name, []), row]

    def put(self, rows):
        self.values[self.name] = rows

    update = put

    def clear(self):
        self.values.pop(self.name, None)


class At:
    def __init__(self, ms):
        self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms


def test_a_key_sets_few_timers():
    """One timer for the first waiting row, not one for each; rows that come in any order are all handed on."""
    events = sorted(rows(400, 3), key=lambda e: (e[2] // 20_000, random.Random(e[0]).random()))
    events = [e for e in events if e[1] == 1]
    job, held, got = processors.Bounces(10_000), Held(), {}
    job.init(held)
    batches = [events[i : i + 25] for i in range(0, len(events), 25)]
    for n, batch in enumerate(batches):
        list(job.handleInputRows((1,), iter([{"ms": ms, "event_id": i, "kind": k, "text": q} for i, _, ms, k, q in batch]), None))
        low = min((e[2] for b in batches[n + 1 :] for e in b), default=1 << 40) - 1
        for ms in sorted(t for t in held.timers if t <= low):
            held.timers.discard(ms)
            got |= {r["event_id"]: r["is_bounce"] for r in job.handleExpiredTimer((1,), At(low), At(ms))}
    assert got == plain_bounces(events, 10_000) and not held.values
    assert held.set <= 4 * len(batches) < len(events)
