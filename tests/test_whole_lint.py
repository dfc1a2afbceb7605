"""Findings planted where the given tables have none."""

from caselake.operators import knowledge, text


def test_planted_findings(spark):
    pages = spark.createDataFrame([("a", 1, "approved", "t", "r", 1), ("b", 1, "expired", "t", "r", 1), ("c", 2, "draft", "t", "r", 1)], "policy_id string, version int, status string, request_type string, rule_key string, rule_value long")
    cites = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "policy_id string, version int, cited_at int")
    cases, teams = spark.createDataFrame([("x",), ("y",), ("y",)], "team string"), spark.createDataFrame([("x",)], "team string")
    assert [tuple(r) for r in knowledge.expired_linked(cites, pages).collect()] == [("b", "expired")]
    got = {r.code: r.n for r in knowledge.lint(pages, cites, cases, teams).collect()}
    assert got == {"CONTRADICTION": 0, "EXPIRED_LINKED": 1, "STALE_CITATION": 0, "ORPHAN": 1, "MISSING_TEAM": 1}


def test_unseen_terms_lower_the_score(spark):
    docs = spark.createDataFrame([(k, f"river bank number{k}") for k in range(4)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "number1"), (2, "number1 zeppelin")], "item_id long, text string")
    got = {r.item_id: r.score for r in text.bm25(docs, items, unseen=True).filter("rank = 1").collect()}
    assert got[2] == round(got[1] / 2, 6) or abs(got[2] - got[1] / 2) < 1e-5
