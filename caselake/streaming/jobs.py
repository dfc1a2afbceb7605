"""Structured Streaming over an append-only log of events, with a batch twin for each job.

Jobs read a folder of Parquet files as a stream, keep their state in Spark (watermarks, windows, or a grouped
state) and write to a folder; ``drain`` runs one to the end of what is there and reads the result back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.casework import LEVELS, first_alerts, sliding_counts, step
from ..operators.text import SHAPES, pii_types
from ..operators.triage import SQL as TRIAGE
from ..operators.triage import _precedents, triage, workflow_frame
from ..session import shared_root
from ..sources.surrogate import CTE, audit, table

LATE = "1 hour"


def stream(spark: SparkSession, sf_dir: str, name: str, files: int | None = None) -> DataFrame:
    """The table's files as they come, ``files`` of them a trigger."""
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{sf_dir}/{name}.parquet*")


def audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir, "events").selectExpr("event_id AS seq", "ts", "user_id AS actor_id", "event_type AS event", "value", "props AS details")


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the job over all that is there now and returns what it wrote.

    Update mode goes through foreachBatch: each batch's rows are kept with its number, the newest row counts."""
    spark = df.sparkSession
    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    schema = df.schema
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(f"{root}/out")
    else:
        query = writer.foreachBatch(lambda b, k: b.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{root}/out/part={k}")).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(schema).parquet(f"{root}/out")
    return spark.read.schema(schema.add("batch", "long")).parquet(f"{root}/out").drop("part")


def event_windows(events: DataFrame, late: str | None = LATE) -> DataFrame:
    """(start, event, n, total) by day: the counts that SLA and rate alarms read (T4, T5)."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant
    x = x.withWatermark("ts", late) if late else x
    x = x.groupBy(F.window("ts", "1 day").alias("w"), "event").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return x.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event", "n", F.round("total", 2).alias("total"))


def first_of_kind(events: DataFrame) -> DataFrame:
    """One alert for each actor and trigger, ever (T2, T3): the state keeps what was alerted."""

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for f in frames:
            row = f.sort_values(["ts", "seq"]).iloc[0]
            new = (row["ts"].value, int(row["seq"]))
            best = new if best is None or new < tuple(best) else best
        state.update(tuple(best))
        yield pd.DataFrame({"actor_id": [key[0]], "trigger": [key[1]], "seq": [best[1]]})

    x = events.filter("event IN ('error', 'purchase')").select("actor_id", F.col("event").alias("trigger"), "ts", "seq")
    return x.groupBy("actor_id", "trigger").applyInPandasWithState(fold, "actor_id long, trigger string, seq long", "ts long, seq long", "update", GroupStateTimeout.NoTimeout)


def trust_stream(events: DataFrame) -> DataFrame:
    """The trust ladder as grouped state (T1): four numbers an actor, however long its log is."""

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (0, 0, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        for ok in (rows["event"] != "error").tolist():
            now = step(*now, ok)
        state.update(now)
        yield pd.DataFrame([[key[0], *now]], columns=["actor_id", "level", "total", "agreed", "streak"])

    return events.select("actor_id", "ts", "seq", "event").groupBy("actor_id").applyInPandasWithState(fold, LEVELS, "level int, total long, agreed long, streak long", "update", GroupStateTimeout.NoTimeout)


def latest_state(events: DataFrame) -> DataFrame:
    """An actor's newest event (T6), a streaming aggregation in update mode."""
    return events.groupBy("actor_id").agg(F.max_by("event", F.struct("ts", "seq")).alias("event"), F.max("ts").alias("ts"), F.count("*").alias("n"))


def newest(df: DataFrame, *key: str) -> DataFrame:
    """Of rows that a job in update mode wrote, each key's last."""
    rest = [c for c in df.columns if c not in (*key, "batch")]
    x = df.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return x.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def stream_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of ``triage_batch`` on a stream of documents against static workflows and precedents (T7)."""
    requests = stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), "text")
    return drain(triage(requests, workflow_frame(spark), _precedents(spark, sf_dir))).select("request_id", "decision", "route")


def stream_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of personal data in turns as they come (complete counts, so the last batch holds them all)."""
    turns = stream(spark, sf_dir, "conversations")
    x = pii_types(turns).filter("types <> ''").select("role", F.explode(F.split("types", ",")).alias("type"))
    return newest(drain(x.groupBy("role", "type").agg(F.count("*").alias("n")), "update"), "role", "type")


QUERIES = {
    "stream_case_state": lambda s, d: newest(drain(latest_state(audit_stream(s, d)), "update"), "actor_id"),
    "stream_alerts": lambda s, d: newest(drain(first_of_kind(audit_stream(s, d)), "update"), "actor_id", "trigger"),
    "stream_trust": lambda s, d: newest(drain(trust_stream(audit_stream(s, d)), "update"), "actor_id"),
    "stream_sla": lambda s, d: newest(drain(event_windows(audit_stream(s, d)), "update"), "start", "event"),
    "stream_leaks": stream_leaks,
    "stream_triage": stream_triage,
    "alerts_twin": lambda s, d: first_alerts(audit(s, d)).select("actor_id", "trigger", "seq"),
    "rate_limit_twin": lambda s, d: sliding_counts(audit(s, d)).groupBy("actor_id").agg(F.count_if("limited").alias("n_limited")),
}
_KIND = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{t}' END" for t, _, p in SHAPES)
SQL = {
    "stream_case_state": f"WITH {CTE} SELECT actor_id, arg_max(event, (ts, seq)) AS event, max(ts) AS ts, count(*) AS n FROM audit GROUP BY 1",
    "stream_alerts": f"WITH {CTE} SELECT actor_id, event AS trigger, arg_min(seq, (ts, seq)) AS seq FROM audit WHERE event IN ('error', 'purchase') GROUP BY ALL",
    "stream_sla": f"WITH {CTE} SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event, count(*) AS n, round(sum(value), 2) AS total FROM audit GROUP BY ALL",
    "stream_leaks": f"WITH x AS (SELECT role, unnest(list_filter([{_KIND}], lambda v: v IS NOT NULL)) AS type FROM conversations) SELECT role, type, count(*) AS n FROM x GROUP BY ALL",
    "stream_triage": f"SELECT request_id, decision, route FROM ({TRIAGE['triage_batch']})",
    "alerts_twin": f"WITH {CTE} SELECT actor_id, event AS trigger, arg_min(seq, (ts, seq)) AS seq FROM audit WHERE event IN ('error', 'purchase') GROUP BY ALL",
    "rate_limit_twin": f"WITH {CTE}, w AS (SELECT actor_id, count(*) OVER (PARTITION BY actor_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n_recent FROM audit WHERE event = 'click') SELECT actor_id, count(*) FILTER (n_recent > 3) AS n_limited FROM w GROUP BY 1",
}
