"""Streaming jobs that keep their own state and timers: service levels and rate limits, exact for late rows too.

An event waits in its key's state until the watermark has passed it; then all events up to there are taken in
order. So a verdict never depends on how the log is cut into files and triggers, and rows that come up to LATE
behind the newest count as if they had come in time; later ones are dropped. State is a key's waiting events and a
few numbers, in RocksDB on the executors and in the checkpoint folder. The batch twins say what a job gives for
the log up to its last watermark.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import shared_root, written
from ..sources.surrogate import CTE, audit

LATE = "1 hour"
WAITING = ("error", "purchase")  # events after which an actor's case waits for a person
SLA_HOURS = 24
LIMITED, WINDOW_HOURS, MOST = "click", 24, 3
HOUR = 3_600_000_000  # in microseconds
WAIT_SCHEMA = "ts long, seq long, event string"


class _InOrder(StatefulProcessor):
    """Keeps events until the watermark is past them, then hands them on by (ts, seq).

    A key has one timer, for the first time at which something is to be done, however many events wait: so a key is
    called once when the watermark moves on. Times are microseconds; watermark and timers are milliseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAIT_SCHEMA)
        self.wake = handle.getValueState("wake", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for f in rows:
            at = f["ts"].to_numpy("datetime64[us]").astype("int64").tolist()
            self.waiting.appendList(list(zip(at, f["seq"].tolist(), f["event"].tolist())))
            first = min([*at, first] if first is not None else at, default=None)
        if first is not None:
            old, new = self.wake.get(), -(-first // 1000)
            if old is None or new < old[0]:
                if old is not None:
                    self.handle.deleteTimer(old[0])
                self.sleep([new])
        return iter(())

    def due(self, now: int) -> tuple[list[tuple[int, int, str]], list[int]]:
        """The events up to now in order, and the milliseconds at which the first of the others is due, if any."""
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready, later = sorted(r for r in rows if r[0] <= now), [r for r in rows if r[0] > now]
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        return ready, [-(-min(later)[0] // 1000)] if later else []

    def sleep(self, times: list[int]) -> None:
        """Sets the key's timer to the first of these times; to none, where there are none."""
        if times:
            self.handle.registerTimer(min(times))
            self.wake.update((min(times),))
        else:
            self.wake.clear()

    def close(self) -> None:
        pass


class SlaProcessor(_InOrder):
    """A stay in a waiting state that is longer than the limit is one alert; the next event ends the stay."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.stay = handle.getValueState("stay", WAIT_SCHEMA)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, late = timerValues.getCurrentWatermarkInMs() * 1000, []
        open_stay = tuple(self.stay.get()) if self.stay.exists() else None
        ready, times = self.due(now)
        for ts, seq, event in ready:
            if open_stay and ts - open_stay[0] > self.limit:
                late.append(open_stay)
            open_stay = (ts, seq, event) if event in WAITING else None
        if open_stay and now > open_stay[0] + self.limit:
            # told once: the stay is over for this job, whatever comes next
            late.append(open_stay)
            open_stay = None
        self.stay.update(open_stay) if open_stay else self.stay.clear()
        self.sleep(times + [(open_stay[0] + self.limit) // 1000 + 1] if open_stay else times)
        yield pd.DataFrame({"actor_id": [key[0]] * len(late), "seq": [r[1] for r in late], "event": pd.Series([r[2] for r in late], dtype=object), "entered": pd.to_datetime([r[0] for r in late], unit="us", utc=True), "due": pd.to_datetime([r[0] + self.limit for r in late], unit="us", utc=True)})


class RateProcessor(_InOrder):
    """Each event with the number of its key's events in the window that ends with it, peers included."""

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getListState("recent", "ts long")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ready, times = self.due(timerValues.getCurrentWatermarkInMs() * 1000)
        self.sleep(times)
        before = sorted(r[0] for r in self.recent.get()) if self.recent.exists() else []
        out = []
        if ready:
            every = before + [r[0] for r in ready]
            low = high = 0
            for ts, seq, _ in ready:
                while high < len(every) and every[high] <= ts:
                    high += 1
                while every[low] < ts - self.window:
                    low += 1
                out.append((key[0], seq, high - low, high - low > self.most))
            # what may still be in a later event's window
            keep = [(t,) for t in every if t >= ready[-1][0] - self.window]
            self.recent.put(keep)
        yield pd.DataFrame(out, columns=["actor_id", "seq", "n_recent", "limited"])


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.select("actor_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "event").filter("ts IS NOT NULL").withWatermark("ts", late)


def sla_breaches(events: DataFrame, hours: int = SLA_HOURS, late: str = LATE) -> DataFrame:
    """(actor_id, seq, event, entered, due): stays in a waiting state beyond ``hours``, as soon as the watermark tells.

    ``events`` (actor_id, ts, seq, event) is a stream; rows without a time are left out, a null actor is one."""
    out = "actor_id long, seq long, event string, entered timestamp, due timestamp"
    return _timed(events, late).groupBy("actor_id").transformWithStateInPandas(SlaProcessor(hours * HOUR), out, "append", "EventTime")


def rate_verdicts(events: DataFrame, hours: int = WINDOW_HOURS, most: int = MOST, late: str = LATE) -> DataFrame:
    """(actor_id, seq, n_recent, limited) of each event of the limited kind."""
    out = "actor_id long, seq long, n_recent long, limited boolean"
    return _timed(events.filter(F.col("event") == LIMITED), late).groupBy("actor_id").transformWithStateInPandas(RateProcessor(hours * HOUR, most), out, "append", "EventTime")


def sla_breaches_batch(events: DataFrame, hours: int = SLA_HOURS, late: str = LATE) -> DataFrame:
    """What ``sla_breaches`` gives for a whole log, from each event's successor."""
    w = Window.partitionBy("actor_id").orderBy("ts", "seq")
    seen = _passed(events, late)
    x = seen.withColumn("next", F.lead("ts").over(w)).withColumn("due", F.col("ts") + F.expr(f"INTERVAL {hours} HOURS"))
    return x.filter(F.col("event").isin(*WAITING) & (F.coalesce("next", "now") > F.col("due"))).select("actor_id", "seq", "event", F.col("ts").alias("entered"), "due")


def rate_verdicts_batch(events: DataFrame, hours: int = WINDOW_HOURS, most: int = MOST, late: str = LATE) -> DataFrame:
    x = _passed(events.filter(F.col("event") == LIMITED), late).withColumn("s", F.unix_micros(F.col("ts")))
    w = Window.partitionBy("actor_id").orderBy("s").rangeBetween(-hours * HOUR, 0)
    return x.withColumn("n_recent", F.count("*").over(w)).select("actor_id", "seq", "n_recent", (F.col("n_recent") > most).alias("limited"))


def _passed(events: DataFrame, late: str) -> DataFrame:
    """The events that the last watermark has passed, with it as ``now``; the newest time is one number."""
    x = events.select("actor_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "event").filter("ts IS NOT NULL")
    last = x.agg(F.date_trunc("millisecond", F.max("ts") - F.expr(f"INTERVAL {late}")).alias("now")).first()[0]
    return x.withColumn("now", F.lit(last).cast("timestamp")).filter(F.col("ts") <= F.col("now"))


def arriving(events: DataFrame, job: Callable[[DataFrame], DataFrame], steps: int = 4) -> DataFrame:
    """Runs a job over a log that comes in ``steps`` parts by time, the job stopped and started again for each.

    Each part is a set of files; state, watermark and output go on from the checkpoint."""
    spark = events.sparkSession
    root = f"{shared_root(spark)}/arriving-{uuid.uuid4().hex}"
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    bounds = sorted(set(events.select(at.alias("t")).approxQuantile("t", [k / steps for k in range(1, steps)], 0.01))) if steps > 1 else []
    log, out, schema = f"{root}/log", f"{root}/out", None
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = events.filter((at > low if low is not None else F.lit(True)) & (at <= high if high is not None else F.lit(True)))
        part.write.mode("append").parquet(log)
        result = job(spark.readStream.schema(events.schema).parquet(log))
        schema = result.schema
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            result.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).format("parquet").start(out).awaitTermination()
        finally:
            spark.conf.set(provider, before)
    return spark.read.schema(schema).parquet(out)


def _ntz(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


QUERIES = {
    "stream_sla_timers": lambda s, d: _ntz(arriving(audit(s, d), sla_breaches)),
    "stream_rate_verdicts": lambda s, d: arriving(audit(s, d), rate_verdicts),
}
SQL = {
    "stream_sla_timers": f"""WITH {CTE}, now AS (SELECT date_trunc('milliseconds', max(ts) - INTERVAL 1 HOUR) AS now FROM audit),
x AS (SELECT actor_id, seq, event, ts AS entered, ts + INTERVAL {SLA_HOURS} HOURS AS due, lead(ts) OVER (PARTITION BY actor_id ORDER BY ts, seq) AS next, now FROM audit, now WHERE ts <= now)
SELECT actor_id, seq, event, entered, due FROM x WHERE event IN {WAITING} AND coalesce(next, now) > due""",
    "stream_rate_verdicts": f"""WITH {CTE}, c AS (SELECT * FROM audit WHERE event = '{LIMITED}'), now AS (SELECT date_trunc('milliseconds', max(ts) - INTERVAL 1 HOUR) AS now FROM c),
w AS (SELECT actor_id, seq, count(*) OVER (PARTITION BY actor_id ORDER BY ts RANGE BETWEEN INTERVAL {WINDOW_HOURS} HOURS PRECEDING AND CURRENT ROW) AS n_recent FROM c, now WHERE ts <= now)
SELECT actor_id, seq, n_recent, n_recent > {MOST} AS limited FROM w""",
}
