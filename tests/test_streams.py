"""Grouped state against a plain fold, and the same log in several files and triggers."""

import random

from pyspark.sql import functions as F

from caselake.operators.casework import trust_ladder
from caselake.streaming import jobs


def log(spark, n=600):
    rng = random.Random(2)
    rows = [(k, f"2024-01-0{1 + k * 8 // n} 00:00:00", rng.randrange(4), "error" if rng.random() < 0.04 else "view") for k in range(n)]
    return rows, spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def plain(rows):
    out = {}
    for _, _, actor, event in sorted(rows, key=lambda r: (r[1], r[0])):
        out[actor] = jobs.step(*out.get(actor, (0, 0, 0, 0)), event != "error")
    return out


def test_trust_over_several_triggers(spark, tmp_path):
    rows, df = log(spark)
    want = plain(rows)
    got = {r.actor_id: (r.level, r.total, r.agreed, r.streak) for r in trust_ladder(df.selectExpr("user_id AS actor_id", "ts", "event_id AS seq", "event_type AS event")).collect()}
    assert got == want and len({x[0] for x in want.values()}) > 1
    for k in range(3):
        df.filter(f"event_id >= {k * 200} AND event_id < {k * 200 + 200}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    events = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log").selectExpr("event_id AS seq", "ts", "user_id AS actor_id", "event_type AS event")
    got = {r.actor_id: (r.level, r.total, r.agreed, r.streak) for r in jobs.newest(jobs.drain(jobs.trust_stream(events), "update"), "actor_id").collect()}
    assert got == want


def test_truth_table_of_steps():
    assert jobs.step(0, 9, 9, 9, True) == (1, 10, 10, 10)
    assert jobs.step(0, 10, 8, 9, True) == (0, 11, 9, 10)
    assert jobs.step(1, 24, 24, 24, True) == (2, 25, 25, 25)
    assert jobs.step(2, 25, 25, 25, False) == (1, 26, 25, 0)
