"""Hybrid search works the stems of the documents out once."""

from caselake.operators import hygiene, retrieval


def test_stems_of_documents_once(spark, monkeypatch):
    made, real = [], retrieval.stems

    def counted(text):
        made.append(text)
        return real(text)

    monkeypatch.setattr(retrieval, "stems", counted)
    monkeypatch.setattr(hygiene, "stems", counted)
    docs = spark.createDataFrame([(1, "parking permit rules"), (2, None)], "doc_id long, text string")
    got = retrieval.hybrid_topk(docs, spark.createDataFrame([(1, "parking permits")], "item_id long, text string")).collect()
    assert [(r.item_id, r.doc_id) for r in got] == [(1, 1)]
    assert len(made) == 3  # the documents' once, the queries' as terms and as buckets
