"""Grants against the rule asked for each pair, edits against plain multisets, JSON out of prose."""

import json
import random
from collections import Counter

from caselake.operators import access, edits

USERS = "user_id long, role string, user_team string"
ROLES = ("ops_employee", "team_specialist", "ops_manager", "senior_reviewer", "knowledge_owner", "auditor")


def sides(spark):
    rng = random.Random(4)
    users = [(k, ROLES[k % 6], rng.choice(["A", "B", None])) for k in range(24)] + [(99, None, "A")]
    cases = [(k, rng.choice([0, 6, 12, 1, None]), rng.choice(["A", "B", "C", None])) for k in range(60)]
    return users, cases, spark.createDataFrame(users, USERS), spark.createDataFrame(cases, "case_id long, requester_id long, team string")


def test_grants_equal_the_rule_of_each_pair(spark):
    users, cases, u, c = sides(spark)
    got = {(r.case_id, r.user_id, r.role) for r in access.case_grants(u, c).collect()}
    want = {(k, uid, role) for k, owner, team in cases for uid, role, own_team in users if (role == "ops_employee" and owner == uid) or (role == "team_specialist" and team is not None and team == own_team)}
    assert got == want | {(k, None, r) for k, _, _ in cases for r in access.SUMMARY_ALL}
    rows = spark.createDataFrame([(0, "hello"), (0, "hello"), (None, "system"), (1000, "unknown")], "case_id long, message string")
    assert access.visible_rows(rows, u, c).filter("message <> 'hello'").isEmpty()


def test_records_by_viewer(spark):
    users, cases, u, c = sides(spark)
    rng = random.Random(5)
    links = [(rng.randrange(8), *x) for x in cases for _ in range(2)]
    shared = {k: k % 2 == 0 for k in range(7)}
    df = spark.createDataFrame(links + links[:5], "profile_id long, case_id long, requester_id long, team string")
    got = {(r.profile_id, r.user_id, r.role): r.n_cases for r in access.patients_for(u, df, spark.createDataFrame(list(shared.items()), "profile_id long, shared boolean")).collect()}
    want = {}
    for p in range(8):
        own = {x[1:] for x in links if x[0] == p}
        for uid, role, team in users:
            if role == "team_specialist" and team is not None and (of_team := [x for x in own if x[2] == team]):
                want[p, uid, role] = len(own) if shared.get(p) else len(of_team)
            if role == "ops_employee" and (mine := [x for x in own if x[1] == uid]):
                want[p, uid, role] = len(mine)
        for role in access.RECORD_ALL:
            want[p, None, role] = 0 if role == "auditor" else len(own)
    assert got == want


def test_log_of_accesses(spark):
    rows = [(1, "2024-01-01 00:00:00", 7, "view", '{"k": 3}'), (2, "2024-01-02 00:00:00", 8, "purchase", '{"k": 3}'), (3, "2024-01-02 00:00:00", 8, "view", "no json"), (4, "2024-01-03 00:00:00", 8, "click", '{"k": 3}'), (5, None, 9, "view", '{"k": 3}'), (6, "2024-01-02 00:00:00", 9, "view", None)]
    df = spark.createDataFrame(rows, "seq long, ts string, actor_id long, event string, details string").selectExpr("seq", "cast(ts as timestamp_ntz) AS ts", "actor_id", "event", "details")
    assert [(r.profile_id, r.step, r.seq) for r in access.access_log(df).orderBy("step").collect()] == [(3, 1, 2), (3, 2, 1), (3, 3, 5)]
    assert access.access_log(df.limit(0)).collect() == []


def test_line_changes_are_multisets(spark):
    rng = random.Random(1)
    lines = ["a", "b", "", "c 12", "d"]
    drafts = [(k, "\n".join(rng.choices(lines, k=rng.randrange(6))), rng.choice(["\n", "\r\n"]).join(rng.choices(lines, k=rng.randrange(6)))) for k in range(80)] + [(100, None, "x"), (101, "x", None), (102, "x\nx", "x\nx\nx")]
    df = spark.createDataFrame(drafts, "draft_id long, old string, new string").selectExpr("*", "1 AS copy", "2 AS line")
    got = {(r.draft_id, r.change, r.line): r.n for r in edits.line_changes(df).collect()}
    want = {}
    for k, old, new in drafts:
        o, n = Counter((old or "").split("\n")), Counter((new or "").replace("\r\n", "\n").split("\n"))
        want |= {(k, "added", x): v for x, v in (n - o).items()} | {(k, "removed", x): v for x, v in (o - n).items()}
    assert got == want and want[102, "added", "x"] == 1


def test_problems_of_drafts(spark):
    rows = [("ok", "Pay 50 in 3 days.\nEnd", "Pay 50 in 3 days.\nSee page 7\nEnd", "page 7"), ("number", "Pay 50", "Pay 50\nPay 60", None), ("twice", "Pay 50", "Pay 50\nPay 50", None), ("cut", "x" * 100, "x", ""), ("grown", "x", "x\n" + "y" * 1501, ""), ("empty", "x", " ", ""), ("null", None, None, None)]
    got = {r.draft_id: r.problem for r in edits.judged_drafts(spark.createDataFrame(rows, "draft_id string, old string, new string, note string")).collect()}
    assert got == {"ok": None, "number": "new_number", "twice": None, "cut": "not_a_minimal_edit", "grown": "not_a_minimal_edit", "empty": "empty", "null": "empty"}


def test_objects_in_prose(spark):
    rows = ['{"a": 1}', 'so {"a": 2, "b": "}{\\""} then {"a": 3}', "```json\n{\"a\": 4}\n```", '<think>{"a": 9}</think>{"a": 5}', "{not} {\"a\": 6}", "none", "{", '{"a": "text"}', None, "[1, 2]", '{"b": {"c": {}}}', "{" * 20_000, '"{" {"a": 7}']
    df = spark.createDataFrame(list(enumerate(rows)), "k int, t string").selectExpr("*", "1 AS p", "2 AS parsed")
    got = {r.k: (r.parsed.a if r.parsed else None, r.bad) for r in edits.tolerant_json(df, "t", "a int, b string").collect()}
    assert got == {0: (1, False), 1: (2, False), 2: (4, False), 3: (5, False), 4: (6, False), 5: (None, True), 6: (None, True), 7: (None, True), 8: (None, True), 9: (None, True), 10: (None, False), 11: (None, True), 12: (7, False)}
    assert json.loads(edits.first_object(rows[1])) == {"a": 2, "b": '}{"'}


def test_grants_are_never_shuffled(spark):
    """A row for each case and specialist may come out of a join, none may go into a shuffle."""
    u = spark.range(2000).selectExpr("id AS user_id", "'team_specialist' AS role", "'T' AS user_team")
    c = spark.range(400).selectExpr("id AS case_id", "id AS requester_id", "'T' AS team")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = c.selectExpr("case_id", "'m' AS message")
        links = c.selectExpr("case_id % 7 AS profile_id", "case_id", "requester_id", "team")
        for df, n in ((access.visible_rows(rows, u, c), 400 * 2004), (access.patients_for(u, links, spark.range(7).selectExpr("id AS profile_id", "true AS shared")), 7 * 2003)):
            assert df.count() == n
            plan = df._jdf.queryExecution().executedPlan().toString()
            explodes = [k for k, line in enumerate(plan.splitlines()) if "Generate explode" in line]
            depth = {k: len(line) - len(line.lstrip(" :+-*()0123456789")) for k, line in enumerate(plan.splitlines())}
            for e in explodes:
                # walk up from the explode: a line nearer to the root that is less deep is an ancestor
                level = depth[e]
                for k in range(e, -1, -1):
                    if depth[k] < level:
                        level = depth[k]
                        assert "Exchange" not in plan.splitlines()[k], plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
