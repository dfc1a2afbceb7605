"""Columns that hold maps, weights of no source, rows without an id."""

from caselake.llm import media, mixing
from caselake.llm.common import Scratch


def test_mixing_keeps_maps_and_rows_without_an_id(spark):
    df = spark.range(2000).selectExpr("if(id % 4 = 0, id, NULL) AS doc_id", "if(id % 3 = 0, 'a', 'b') AS source", "map('k', id) AS m", "named_struct('n', map('x', id)) AS s")
    got = mixing.mix(df, block_docs=8).collect()
    assert sorted(r.m["k"] for r in got) == list(range(2000)) and all(r.s.n["x"] == r.m["k"] for r in got)
    again = mixing.mix(df.repartition(7), block_docs=8).collect()
    assert sorted((r.m["k"], r.slot) for r in again) == sorted((r.m["k"], r.slot) for r in got)
    assert len({(r.source, r.block) for r in got}) == -(-667 // 8) + -(-1333 // 8)


def test_weights_of_no_source_are_equal_weights(spark):
    df = spark.range(300).selectExpr("id AS doc_id", "if(id < 10, 'a', 'b') AS source")
    none = spark.createDataFrame([("x", 1.0), ("a", None), ("b", -1.0)], "source string, weight double")
    got = mixing.target_units(df.groupBy("source").count().withColumnRenamed("count", "n_docs"), 10, weights=none).collect()
    assert {r.source: r.q for r in got} == {"a": 5, "b": 5}
    assert mixing.mix(df, weights=none).count() == 300


def test_media_rows_with_maps(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    facts = media.facts(media.media_table(docs, Scratch(spark)))
    pages = media.document_figures(docs).selectExpr("*", "map('k', doc_id) AS m").union(spark.sql("SELECT 3L, '', map('k', 3L)"))
    got = sorted((r.doc_id, r.m["k"], r.n_bytes) for r in media.resolve(media.interleave(pages), facts).collect() if r.doc_id != 3)
    assert got == [(1, 1, 1), (2, 2, 0)]
