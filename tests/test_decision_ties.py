"""Decisions of one case at one time and place: the reviewer's number decides, not the order of rows."""

import pytest

from caselake.operators import lifecycle


@pytest.mark.parametrize("turned", [False, True])
def test_ties_are_settled_by_reviewer_and_action(spark, turned):
    cases = spark.createDataFrame([(1, "in_review", "low", "T", 99)], "case_id long, state string, risk string, team string, requester_id long")
    users = spark.createDataFrame([(7, "senior_reviewer", "T"), (8, "senior_reviewer", "T")], "user_id long, role string, user_team string")
    made = [(1, 1, 7, "approve", True, 5), (1, 1, 7, "reject", True, 5), (1, 1, 8, "escalate", True, 5)]
    rows = spark.createDataFrame(made[::-1] if turned else made, "case_id long, pos int, reviewer_id long, action string, has_text boolean, ts int").coalesce(1)
    got = {r.action: r.verdict for r in lifecycle.apply_decisions(cases, rows, users).collect()}
    assert got == {"approve": "accepted", "reject": "already_decided", "escalate": "already_decided"}
