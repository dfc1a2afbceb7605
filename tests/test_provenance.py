"""Versions in force against a walk over each page's history."""

import random
import time
from datetime import date, timedelta

from caselake.operators import provenance

VERSIONS = "policy_id string, version int, status string, effective_from date"


def test_as_of_equals_a_walk(spark):
    rng, day = random.Random(3), date(2024, 1, 1)
    versions = [(p, v, rng.choice(["approved", "expired", "draft"]), rng.choice([None, day + timedelta(rng.randrange(30))])) for p in ("A", "B", "C") for v in range(1, 9)] + [("D", 1, "expired", day), (None, 1, "approved", day)]
    claims = [(k, rng.choice(["A", "B", "C", "D", "E", None]), rng.choice([None, 1, 5, 99]), rng.choice([None, day + timedelta(rng.randrange(-3, 33))])) for k in range(300)]
    df = spark.createDataFrame(claims, "k int, policy_id string, version int, at date").selectExpr("*", "'x' AS history", "'y' AS known", "'z' AS in_force")
    got = {r.k: (r.in_force, r.source_version, r.superseded_by, r.retired, r.unknown) for r in provenance.provenance(df, spark.createDataFrame(versions, VERSIONS)).collect()}
    for k, page, version, at in claims:
        own = [v for v in versions if v[0] == page and page is not None]
        past = [(v[3], v[1]) for v in own if v[2] != "draft" and v[3] and at and v[3] <= at]
        force = max(past)[1] if past else None
        source = version if version in {v[1] for v in own} else force if version is None else None
        current = max((v[1] for v in own if v[2] == "approved"), default=None)
        assert got[k] == (force, source, current if source is not None and current is not None and current != source else None, bool(own) and current is None, source is None), (page, version, at)


def test_workflow_of_a_type(spark):
    flows = spark.createDataFrame([("W2", 1, "approved", ["a", "b"], "T1"), ("W2", 2, "approved", ["b", "b"], "T2"), ("W1", 1, "expired", ["a"], "T3"), ("W3", 1, "approved", ["b"], "T4"), ("W4", 1, "approved", None, "T5")], "workflow_id string, version int, status string, request_types array<string>, team string")
    requests = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "request_id int, request_type string")
    assert sorted(tuple(r) for r in provenance.workflow_for(requests, flows).collect()) == [(1, "a", None, None, None), (2, "b", "W2", 2, "T2"), (3, None, None, None, None)]
    assert provenance.workflow_for(requests.limit(0), flows).collect() == []


def test_pages_with_very_many_versions(spark):
    """40,000 versions of one page and 40,000 claims: no claim may walk over its page's history."""
    versions = spark.range(40000).selectExpr("'A' AS policy_id", "cast(id AS int) AS version", "'approved' AS status", "timestamp_seconds(id * 60) AS effective_from")
    claims = spark.range(40000).selectExpr("id AS k", "'A' AS policy_id", "cast(NULL AS int) AS version", "timestamp_seconds(id * 60 + 59) AS at")
    began = time.time()
    got = provenance.provenance(claims, versions)
    assert got.filter("in_force = k AND source_version = k").count() == 40000
    assert time.time() - began < 60
