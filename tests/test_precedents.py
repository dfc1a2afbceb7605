"""Matches by hand, skipped fields, facts of a case, and the scan against brute force over several passes."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from caselake.operators import precedents, retrieval, scan

CASES = "case_id long, request_type string, facts map<string,string>, text string"
PAST = "precedent_id long, request_type string, facts map<string,string>, summary string, decision_code string, fields_provided array<string>"


def test_matches_and_skipped_fields(spark):
    cases = spark.createDataFrame([(1, "billing", {"risk": "low", "team": "A"}, "refund please"), (2, "billing", {}, None), (3, None, {"risk": "low"}, "refund"), (4, "other", None, "x")], CASES)
    past = [(10, "billing", {"risk": "low", "team": "A", "more": "x"}, "refund", "route_to_team", ["invoice"]), (11, "billing", {"risk": "high", "team": "A"}, "refund", "route_to_team", None),
            (12, "billing", None, "nothing alike", "refuse_and_route", []), (13, "other", {"a": None}, None, "route_to_team", None), (None, "billing", None, "refund", None, None), (10, "billing", {"risk": "low", "team": "A", "more": "x"}, "refund", "route_to_team", ["invoice"])]
    p = spark.createDataFrame(past, PAST)
    got = precedents.matches(cases, p)
    assert sorted((r.case_id, r.precedent_id, r.score, r["rank"]) for r in got.collect()) == [(1, 10, 1.0, 1), (1, 11, 0.7, 2), (1, 12, 0.0, 3), (2, 10, 0.0, 1), (2, 11, 0.0, 2), (2, 12, 0.0, 3), (4, 13, 0.0, 1)]
    flows = spark.createDataFrame([("billing", ["invoice", "member_id"]), ("other", [])], "request_type string, required_fields array<string>")
    assert sorted((r.case_id, r.precedent_id, tuple(r.skipped)) for r in precedents.skipped_fields(got, p.dropDuplicates(["precedent_id"]), flows).collect()) == [(1, 10, ("member_id",)), (1, 11, ("invoice", "member_id"))]
    assert precedents.matches(cases.limit(0), p).collect() == [] and precedents.matches(cases, p.limit(0)).collect() == []


def test_facts_of_a_case(spark):
    df = spark.sql("SELECT 'c' AS category, array('b', 'a', 'd') AS need, map('d', '1', 'a', '') AS found, CAST(NULL AS STRING) AS risk, 'T' AS team UNION ALL SELECT NULL, array(), map(), 'high', NULL")
    got = [r[0] for r in df.select(precedents.case_facts(*[F.col(c) for c in ("category", "need", "found", "risk", "team")])).collect()]
    assert got == [{"category": "c", "missing": "a+b", "risk": "low", "team": "T"}, {"category": "unknown", "missing": "none", "risk": "high"}]


def test_scan_equals_brute_force_over_passes(spark):
    rng = random.Random(6)
    data = [(k, float(rng.randrange(50))) for k in range(700)]
    queries = [(k, float(rng.randrange(50))) for k in range(60)]

    def prepare(q: pa.StructArray):
        x = q.field("y").to_numpy()
        return lambda d: np.where(d.field("x").to_numpy()[:, None] == 7, np.nan, -np.abs(d.field("x").to_numpy()[:, None] - x))

    got = scan.top_k(spark.createDataFrame(data, "id long, x double"), spark.createDataFrame(queries, "qid long, y double"), "id", "qid", prepare, 4, -3.0, pass_queries=25)
    want = set()
    for q, y in queries:
        best = sorted((abs(x - y), k) for k, x in data if x != 7 and abs(x - y) <= 3)[:4]
        want |= {(q, k, -s, n + 1) for n, (s, k) in enumerate(best)}
    assert {tuple(r) for r in got.collect()} == want


def test_vectors_that_are_no_match(spark):
    rows = [(20, 1, [1.0, 0.0]), (1, 1, [2.0, 0.0]), (2, 1, [0.0, 0.0]), (3, 1, [float("nan"), 1.0]), (4, 1, None), (5, 1, [1.0, None]), (6, 1, [1.0]), (7, 2, [1.0, 0.0]), (8, None, [1.0, 0.0]), (40, 1, [0.0, 0.0]), (9, 1, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert [tuple(r) for r in retrieval.vector_topk(df).collect()] == [(20, 1, 1.0, 1)]
    assert retrieval.vector_topk(df.limit(0)).collect() == []


def test_hybrid_of_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, "parking permit rules"), (2, None), (3, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "parking permits"), (2, None), (3, "unseen words only")], "item_id long, text string")
    got = retrieval.hybrid_topk(docs, queries).collect()
    assert [(r.item_id, r.doc_id, r["rank"]) for r in got] == [(1, 1, 1)] and got[0].score > 0.5
    assert retrieval.hybrid_topk(docs.limit(0), queries).collect() == []
