"""An anti-join that shuffles only what a sieve lets through, and near duplicates by it."""

import corpus_pipeline
from caselake.llm.common import SIEVE_BITS, without


def test_rows_without_keys(spark, monkeypatch):
    rows = [(None, "n"), (-1, "a"), (-1, "b"), (0, "c"), (5, "d"), (5 + SIEVE_BITS, "e"), (40_000, "f"), (2**62, "g"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for keys in ([], [5], [-1, 40_000, 40_000, 2**62], [5 + SIEVE_BITS, None], [r[0] for r in rows]):
        got = without(df, spark.createDataFrame([(k,) for k in keys], "doc_id long"), "doc_id").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(repr(r) for r in rows if r[0] is None or r[0] not in keys)


def test_near_duplicates_shuffle_few_texts(spark, tmp_path):
    """Only texts that may go are dealt by id: the last join's input is the sieve's rows, not all documents."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(k, f"text {k} " * 9, "en", "s", 9) for k in (0, 0, *range(1, 300))], "doc_id long, text string, lang string, source string, n_chars long")
        docs = docs.unionByName(docs.filter("doc_id = 3").selectExpr("1000L AS doc_id", "text", "lang", "source", "n_chars"))
        docs.write.parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
        out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
        assert sorted(r.doc_id for r in out.collect()) == [0, 0, *range(1, 300)]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" in plan and "Union" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
