"""One schedule over all sources, however many: by halves as by the fold, and as the query's SQL has it."""

import heapq
import random

import duckdb

from caselake.llm import mixing


def earliest_deadline_first(targets: dict, units: int) -> set:
    names = sorted(targets, key=lambda s: (s is not None, s or ""))
    waiting, ready, out = sorted((i * units // targets[s], -(-(i + 1) * units // targets[s]), k, i) for k, s in enumerate(names) for i in range(targets[s])), [], set()
    for slot in range(units):
        while waiting and waiting[0][0] <= slot:
            _, due, k, i = waiting.pop(0)
            heapq.heappush(ready, (due, k, i))
        due, k, i = heapq.heappop(ready)
        s = names[k]
        out.add((s, i, slot, i * units // targets[s], due))
    return out


def test_halves_equal_the_fold_and_a_heap(spark):
    rng = random.Random(7)
    for n in (1, 2, 5, 40):
        targets = {None if k == 3 else f"s{k}": rng.choice([1, 1, 2, 3, 9, 30]) for k in range(n)}
        units = sum(targets.values())
        df = spark.createDataFrame([(s, 1, q) for s, q in targets.items()], "source string, n_docs long, q long")
        want = earliest_deadline_first(targets, units)
        for whole in (10_000, 0):
            assert {tuple(r) for r in mixing.period(df, units, whole).collect()} == want


def test_more_than_512_sources_equal_the_sql(spark, tmp_path):
    """All sources share one schedule. The SQL has 1000 slots."""
    rng = random.Random(1)
    rows = [(k, f"s{int(rng.random() ** 3 * 600)}") for k in range(2500)] + [(9000 + k, f"s{k}") for k in range(600)]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in mixing.op10_pfair_mix(spark, str(tmp_path)).select("doc_id", "source", "block", "release", "deadline", "slot").collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(mixing.SQL["op10_pfair_mix"]).fetchall()
    assert len(want) == len(rows) and got == set(want)


def test_all_of_2000_sources_keep_their_windows(spark):
    """More sources than SQL's slots: none is off by a block or more, and every slot of the period is one block's."""
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('s', if(id < 2000, 0, id % 2000)) AS source")
    got = mixing.mix(df, block_docs=1).select("source", "block", "release", "deadline", "slot").distinct().collect()
    units = mixing.UNITS_EACH * 2000
    assert all(r.release <= r.slot < r.deadline for r in got) and len({r.slot for r in got}) == len(got) == 4000
    targets = mixing.target_units(df.groupBy("source").count().withColumnRenamed("count", "n_docs"), units)
    q = {r.source: r.q for r in targets.collect()}
    want = earliest_deadline_first(q, units)
    assert {(r.source, r.block, r.slot, r.release, r.deadline) for r in got if r.block < q[r.source]} <= want
