"""Streams with timers against a plain walk over the log, cut in several ways and out of order."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest

from caselake.streaming import timers

SCHEMA = "actor_id long, ts timestamp, seq long, event string, extra map<string,string>"
BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)


def log(n=500):
    rng, rows, at = random.Random(8), [], BEGIN
    for k in range(n):
        at += timedelta(minutes=rng.choice([0, 1, 7, 30, 200]), microseconds=rng.randrange(1000))
        rows.append((rng.choice([1, 2, 3, None]) if rng.random() > 0.3 else 9, at, k, rng.choice(["error", "purchase", "view", "click", "click"]), None))
    rows.append((1, rows[-1][1], n, "click", {"a": "b"}))
    rows.append((2, None, n + 1, "error", None))
    return rows


def last(rows, hours=1):
    now = max(r[1] for r in rows if r[1]) - timedelta(hours=hours)
    return now.replace(microsecond=now.microsecond // 1000 * 1000)


def breaches(rows, now):
    out = []
    for actor in {r[0] for r in rows}:
        own = sorted(((r[1], r[2], r[3]) for r in rows if r[0] == actor and r[1] and r[1] <= now))
        for k, (ts, seq, event) in enumerate(own):
            then = own[k + 1][0] if k + 1 < len(own) else now
            if event in ("error", "purchase") and then - ts > timedelta(hours=24):
                out.append((actor, seq))
    return sorted(out, key=str)


def verdicts(rows, now):
    rows = [r for r in rows if r[1] and r[3] == "click" and r[1] <= now]
    return sorted(((r[0], r[2], n := sum(o[0] == r[0] and r[1] - timedelta(hours=24) <= o[1] <= r[1] for o in rows), n > 3) for r in rows), key=str)


@pytest.mark.parametrize("steps", [1, 5])
def test_parts_of_a_log_give_what_the_whole_gives(spark, steps):
    rows = log()
    df = spark.createDataFrame(rows, SCHEMA)
    got = timers.arriving(df, timers.sla_breaches, steps).collect()
    want = breaches(rows, last(rows))
    assert sorted(((r.actor_id, r.seq) for r in got), key=str) == want and want
    assert sorted(((r.actor_id, r.seq) for r in timers.sla_breaches_batch(df).collect()), key=str) == want
    clicks = [r for r in rows if r[3] == "click"]
    want = verdicts(rows, last(clicks))
    assert sorted((tuple(r) for r in timers.arriving(df, timers.rate_verdicts, steps).collect()), key=str) == want
    assert {w[3] for w in want} == {True, False}
    assert sorted((tuple(r) for r in timers.rate_verdicts_batch(df).collect()), key=str) == want


def test_late_rows_within_the_delay_count(spark, tmp_path):
    """A batch whose rows come up to an hour behind; the stay is ended by a row that comes after newer ones."""
    def at(h):
        return BEGIN + timedelta(hours=h)

    batches = [[(1, at(0), 0, "error", None), (2, at(0), 1, "error", None)], [(3, at(24.5), 2, "view", None)], [(1, at(23.9), 3, "view", None)], [(3, at(60), 4, "view", None)], [(3, at(61.5), 5, "view", None)]]
    df = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    plain = timers.sla_breaches_batch(df).collect()
    order = {r[2]: k for k, b in enumerate(batches) for r in b}

    def job(stream):
        return timers.sla_breaches(stream)

    root = str(tmp_path)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(len(batches)):
            df.filter(df.seq.isin([s for s, b in order.items() if b == k])).coalesce(1).write.mode("append").parquet(f"{root}/log")
            job(spark.readStream.schema(df.schema).parquet(f"{root}/log")).writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).format("parquet").start(f"{root}/out").awaitTermination()
    finally:
        spark.conf.set(provider, before)
    got = spark.read.parquet(f"{root}/out").collect()
    assert sorted((r.actor_id, r.seq) for r in got) == sorted((r.actor_id, r.seq) for r in plain) == [(2, 1)]


def test_empty_log(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert timers.sla_breaches_batch(df).collect() == [] and timers.rate_verdicts_batch(df).collect() == []


def test_an_actor_has_one_timer_at_a_time():
    """Whatever waits: calls of a key grow with the watermark's moves, not with its events."""
    class Value:
        def __init__(self):
            self.v = None

        def get(self):
            return self.v

        def exists(self):
            return bool(self.v)

        def update(self, v):
            self.v = v

        put = update

        def appendList(self, v):
            self.v = [*(self.v or []), *v]

        def clear(self):
            self.v = None

    class Handle:
        def __init__(self):
            self.timers = set()

        def getListState(self, *_):
            return Value()

        getValueState = getListState

        def registerTimer(self, t):
            self.timers.add(t)

        def deleteTimer(self, t):
            self.timers.remove(t)

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    for made in (timers.SlaProcessor(timers.HOUR), timers.RateProcessor(timers.HOUR, 3)):
        handle = Handle()
        made.init(handle)
        frame = pd.DataFrame({"ts": pd.to_datetime(range(500, 600), unit="s"), "seq": range(100), "event": ["error"] * 100})
        for part in (frame.iloc[50:], frame.iloc[:50]):
            made.handleInputRows((1,), iter([part]), None)
            assert len(handle.timers) == 1
        assert handle.timers == {500_000}
        handle.timers.clear()  # it has expired
        list(made.handleExpiredTimer((1,), Now(549_500), None))
        assert handle.timers == {550_000}
