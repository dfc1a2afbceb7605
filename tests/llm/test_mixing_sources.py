"""Mixing more sources than a period has units by default."""

import pytest

from caselake.llm import mixing


@pytest.mark.parametrize(("units", "single"), [(20, 512), (20, 16)])
def test_more_sources_than_units(spark, monkeypatch, units, single):
    monkeypatch.setattr(mixing.period, "__defaults__", (mixing.UNITS, single))
    rows = [(i, None if i % 5 == 0 else f"s{i % 61}") for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block_docs=2, units=units).collect()
    assert sorted(map(repr, ((r.doc_id, r.source) for r in got))) == sorted(map(repr, rows))
    blocks = {(r.source, r.block, r.slot, r.release, r.deadline) for r in got}
    assert len({b[2] for b in blocks}) == len(blocks) and all(b[3] <= b[2] < b[4] for b in blocks)
    total = mixing.UNITS_EACH * 62
    first = [b for b in blocks if b[2] < total and b[0] is None]
    assert len(first) > 20  # the largest source has more than one unit


def test_thousands_of_sources(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "concat('s', if(id < 3000, 0, id % 1500)) AS source")
    got = mixing.mix(df, block_docs=4).cache()
    assert got.count() == 6000 and got.filter("slot < release OR slot >= deadline").count() == 0
    assert got.select("source", "block", "slot").distinct().count() == got.select("slot").distinct().count()
