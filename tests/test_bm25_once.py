"""Absolute BM25 works out the documents' stems once, and repeated ids are one document."""

import pytest

from caselake.operators import text


@pytest.mark.parametrize("unseen", [False, True])
def test_texts_are_read_once(spark, tmp_path, unseen):
    rows = [(1, "red car"), (1, "red bus"), (2, "green car"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/requests")
    queries = spark.createDataFrame([(1, "red car"), (2, "zebra bus")], "item_id long, text string")
    found = text.bm25(spark.read.parquet(f"{tmp_path}/requests"), queries, unseen=unseen)
    assert f"{tmp_path.name}/requests" not in found._jdf.queryExecution().optimizedPlan().toString() and not any(f"{tmp_path.name}/requests" in f for f in found.inputFiles())
    got = {(r.item_id, r.doc_id): r["rank"] for r in found.collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (2, 1): 1}
