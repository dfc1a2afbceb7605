"""The whole chain for a table of requests as one lazy plan: guard, classify, fields, rules, evidence, decision, route.

Workflows and precedents come as frames; what they hold for a request type is joined by the type (a row for
each type), everything else is worked out in the request's own row, so requests are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.surrogate import table
from .hygiene import FIELDS, LEET, STEERING, extract_fields, steering
from .text import FLAGS, SHAPES, TYPES, keyword_type, mask_shapes, shapes_in

#: Decision codes, states, reason codes, roles and score points of the chain.
RISKS = ("low", "medium", "high", "critical")
APPROVER = {"low": "team_specialist", "medium": "ops_manager", "high": "senior_reviewer", "critical": "senior_reviewer"}
HARD = ("INJECTION", "SENSITIVE", "TOO_LONG")
#: A rule table: type, required fields, risk, action tier, team, never automatic, linked policies.
WORKFLOWS = (
    ("license_question", ("link",), "low", "read", "TEAM-LEGAL", False, 2),
    ("credential_leak", ("email",), "high", "write", "TEAM-SECURITY", True, 1),
    ("contact_change", ("email", "phone"), "medium", "write", "TEAM-ACCOUNTS", False, 1),
    ("shouting", (), "low", "read", "TEAM-FRONT", False, 0),
    ("question", (), "low", "read", "TEAM-FRONT", False, 3),
)
LONG, LARGE = 20000, 5000  # characters: refused beyond the first, risk medium beyond the second


def workflow_frame(spark: SparkSession, rows=WORKFLOWS) -> DataFrame:
    return spark.createDataFrame([(a, list(b), *c) for a, b, *c in rows], "request_type string, required array<string>, base_risk string, action_tier string, wf_team string, never_auto boolean, n_policies int")


def _in_order(*pairs):
    """Codes whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(v)) for v, c in pairs]))


def guard(requests: DataFrame) -> DataFrame:
    """Adds masked_text, pii_types, injection, too_long, sensitive and allowed (C6); a null text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    x = requests.withColumn("text", text)
    x = x.withColumn("pii_types", shapes_in(F.col("text")))
    x = x.withColumn("masked_text", F.when(F.size("pii_types") > 0, mask_shapes(F.col("text"))).otherwise(F.col("text")))
    x = x.withColumns({"injection": steering(F.col("text")), "too_long": F.length("text") > LONG, "sensitive": F.col("text").rlike(dict(FLAGS)["has_secret"])})
    return x.withColumn("allowed", ~F.col("injection") & ~F.col("too_long"))


def classify(checked: DataFrame) -> DataFrame:
    """Adds request_type, fields and is_howto (C8, C11): a question without any concrete value."""
    x = checked.withColumns({"request_type": keyword_type(F.col("text")), "fields": extract_fields(F.col("text"))})
    return x.withColumn("is_howto", F.col("text").rlike(r"\?") & (F.size("fields") == 0))


def triage(requests: DataFrame, workflows: DataFrame, precedents: DataFrame) -> DataFrame:
    """One row a request (request_id, text): guard, type, missing fields, risk, reasons, team, score, decision, route.

    precedents (request_type) are counted by type. An unknown type has no workflow. Repeated requests give equal
    rows; an empty table gives none."""
    seen = precedents.groupBy("request_type").agg(F.count("*").alias("n_precedents"))
    x = classify(guard(requests)).join(F.broadcast(workflows), "request_type", "left").join(F.broadcast(seen), "request_type", "left")
    x = x.fillna({"n_policies": 0, "n_precedents": 0, "never_auto": False, "base_risk": "low", "action_tier": "read"}).withColumn("required", F.coalesce("required", F.expr("cast(array() as array<string>)")))
    x = x.withColumn("missing", F.array_except("required", F.map_keys("fields")))
    level = F.greatest(F.array_position(F.array(*map(F.lit, RISKS)), F.col("base_risk")), F.when(F.length("text") > LARGE, 2).otherwise(1), F.when(F.col("sensitive"), 3).otherwise(1), F.when(F.col("injection"), 4).otherwise(1))
    x = x.withColumn("risk", F.element_at(F.array(*map(F.lit, RISKS)), level.cast("int")))
    hard = F.col("injection") | F.col("too_long") | F.col("sensitive")
    x = x.withColumn("reasons", _in_order(("MISSING_DATA", F.size("missing") > 0), ("INJECTION", F.col("injection")), ("TOO_LONG", F.col("too_long")), ("SENSITIVE", F.col("sensitive")), ("NEVER_AUTO", F.col("never_auto")), ("UNCLEAR_INTENT", (F.col("request_type") == "unknown") & ~hard)))
    x = x.withColumn("hard_override", F.arrays_overlap("reasons", F.array(*map(F.lit, HARD))) | (F.col("action_tier") == "write"))
    x = x.withColumn("team", F.when(~F.col("allowed"), "TEAM-COMPLIANCE").when(F.col("request_type") == "unknown", F.when(F.col("sensitive"), "TEAM-COMPLIANCE").otherwise("TEAM-OPS-TRIAGE")).otherwise(F.col("wf_team")))
    x = x.withColumn("approver", F.create_map(*[F.lit(v) for kv in APPROVER.items() for v in kv])[F.col("risk")])
    n = F.size("required")
    x = x.withColumns({
        "s_policy": F.when(F.col("n_policies") >= 2, 30).when(F.col("n_policies") == 1, 15).otherwise(0),
        "s_precedent": F.when(F.col("n_precedents") == 0, 0).when(F.col("n_precedents") == 1, 15).when(F.col("n_precedents") == 2, 20).otherwise(25),
        "s_fields": F.when(n == 0, 20).otherwise(F.bround(20 * (n - F.size("missing")) / F.nullif(n, F.lit(0)), 0)).cast("int"),
        "s_clarity": F.when(F.col("request_type") == "unknown", 0).when(F.col("is_howto"), 15).otherwise(8),
    }).withColumn("score", F.col("s_policy") + F.col("s_precedent") + F.col("s_fields") + F.col("s_clarity") + 10)
    x = x.withColumn("band", F.when(F.col("score") >= 75, "high").when(F.col("score") >= 45, "medium").otherwise("low"))
    # the first condition that holds decides
    x = x.withColumn("decision", F.when(~F.col("allowed"), "refuse_and_route").when(F.size("missing") > 0, "request_missing_info").when(F.col("risk").isin("high", "critical"), "escalate_senior")
                     .when((F.col("n_policies") == 0) & (F.col("n_precedents") == 0), "not_enough_evidence").when(F.col("is_howto") & (F.col("n_policies") > 0), "answer_from_policy").otherwise("route_to_team"))
    x = x.withColumn("route", F.when(~F.col("allowed"), "in_review").when(F.size("missing") > 0, "needs_info").when(F.col("decision") == "escalate_senior", "escalated")
                     .when((F.col("band") == "low") | (F.col("decision") == "not_enough_evidence"), "not_enough_evidence").when(F.col("band") == "medium", "in_review")
                     .when((F.col("risk") == "low") & ~F.col("hard_override"), "answered").otherwise("in_review"))
    tier = F.when(~F.col("allowed"), "none").when((F.col("risk").isin("high", "critical")) | (F.col("band") != "high"), "strong").otherwise("light")
    questions = F.array_join(F.transform("missing", lambda f: F.concat(F.lit("Please send: "), f)), "; ")
    return x.select("request_id", "allowed", F.array_join("pii_types", ",").alias("pii_types"), F.md5(F.col("masked_text").cast("binary")).alias("masked_md5"), "request_type", "is_howto", F.array_join("missing", ",").alias("missing"), "risk",
                    F.array_join("reasons", ",").alias("reasons"), "hard_override", "team", "approver", "score", "band", "decision", "route", tier.alias("model_tier"), questions.alias("questions"))


def _precedents(s: SparkSession, d: str) -> DataFrame:
    """Labelled documents of good quality are closed requests of their type."""
    good = table(s, d, "labels").filter("quality = 1").select("doc_id")
    return table(s, d, "documents").join(good, "doc_id", "left_semi").select(keyword_type(F.col("text")).alias("request_type"))


def triage_batch(s: SparkSession, d: str) -> DataFrame:
    return triage(table(s, d, "documents").select(F.col("doc_id").alias("request_id"), "text"), workflow_frame(s), _precedents(s, d))


QUERIES = {"triage_batch": triage_batch}
_MASK = "text"
for _, _token, _p in SHAPES:
    _MASK = f"regexp_replace({_MASK}, '{_p}', '{_token}', 'g')"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{t}'" for t, p in TYPES) + " ELSE 'unknown' END"
_STEER = f"coalesce(regexp_matches(lower(text), '{'|'.join(STEERING)}') OR regexp_matches(lower(translate(text, '{LEET[0]}', '{LEET[1]}')), '{'|'.join(STEERING)}'), false)"
_LIST = "list_filter([{}], lambda v: v IS NOT NULL)"
SQL = {
    "triage_batch": f"""
WITH wf(request_type, required, base_risk, action_tier, wf_team, never_auto, n_policies) AS (VALUES {', '.join(f"('{a}', {list(b)}::VARCHAR[], '{c}', '{e}', '{f}', {g}, {h})" for a, b, c, e, f, g, h in WORKFLOWS)}),
typed AS (SELECT doc_id, coalesce(text, '') AS text, {_KIND} AS request_type FROM documents),
prec AS (SELECT request_type, count(*) AS n FROM typed WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1),
a AS (SELECT t.*, {_STEER} AS injection, length(text) > {LONG} AS too_long, regexp_matches(text, '{dict(FLAGS)["has_secret"]}') AS sensitive,
  {_LIST.format(', '.join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in FIELDS))} AS have,
  array_to_string({_LIST.format(', '.join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, _, p in SHAPES))}, ',') AS pii_types, md5({_MASK}) AS masked_md5 FROM typed t),
b AS (SELECT a.*, NOT injection AND NOT too_long AS allowed, regexp_matches(text, '[?]') AND len(have) = 0 AS is_howto, coalesce(required, []) AS required, coalesce(base_risk, 'low') AS base_risk, coalesce(action_tier, 'read') AS action_tier,
  wf_team, coalesce(never_auto, false) AS never_auto, coalesce(n_policies, 0) AS n_policies, coalesce(prec.n, 0) AS n_prec FROM a LEFT JOIN wf USING (request_type) LEFT JOIN prec USING (request_type)),
c AS (SELECT *, list_filter(required, lambda f: NOT list_contains(have, f)) AS miss, {list(RISKS)}[greatest(list_position({list(RISKS)}, base_risk), CASE WHEN length(text) > {LARGE} THEN 2 ELSE 1 END, CASE WHEN sensitive THEN 3 ELSE 1 END, CASE WHEN injection THEN 4 ELSE 1 END)] AS risk FROM b),
e AS (SELECT *, CASE WHEN n_policies >= 2 THEN 30 WHEN n_policies = 1 THEN 15 ELSE 0 END + CASE n_prec WHEN 0 THEN 0 WHEN 1 THEN 15 WHEN 2 THEN 20 ELSE 25 END
  + CAST(CASE WHEN len(required) = 0 THEN 20 ELSE round_even(20.0 * (len(required) - len(miss)) / len(required), 0) END AS INT) + CASE WHEN request_type = 'unknown' THEN 0 WHEN is_howto THEN 15 ELSE 8 END + 10 AS score,
  injection OR too_long OR sensitive OR action_tier = 'write' AS hard_override FROM c),
g AS (SELECT *, CASE WHEN score >= 75 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN NOT allowed THEN 'refuse_and_route' WHEN len(miss) > 0 THEN 'request_missing_info' WHEN risk IN ('high', 'critical') THEN 'escalate_senior' WHEN n_policies = 0 AND n_prec = 0 THEN 'not_enough_evidence' WHEN is_howto AND n_policies > 0 THEN 'answer_from_policy' ELSE 'route_to_team' END AS decision FROM e)
SELECT doc_id AS request_id, allowed, pii_types, masked_md5, request_type, is_howto, array_to_string(miss, ',') AS missing, risk,
  array_to_string({_LIST.format("CASE WHEN len(miss) > 0 THEN 'MISSING_DATA' END, CASE WHEN injection THEN 'INJECTION' END, CASE WHEN too_long THEN 'TOO_LONG' END, CASE WHEN sensitive THEN 'SENSITIVE' END, CASE WHEN never_auto THEN 'NEVER_AUTO' END, CASE WHEN request_type = 'unknown' AND NOT (injection OR too_long OR sensitive) THEN 'UNCLEAR_INTENT' END")}, ',') AS reasons,
  hard_override, CASE WHEN NOT allowed THEN 'TEAM-COMPLIANCE' WHEN request_type = 'unknown' THEN CASE WHEN sensitive THEN 'TEAM-COMPLIANCE' ELSE 'TEAM-OPS-TRIAGE' END ELSE wf_team END AS team,
  CASE risk WHEN 'low' THEN 'team_specialist' WHEN 'medium' THEN 'ops_manager' ELSE 'senior_reviewer' END AS approver, score, band, decision,
  CASE WHEN NOT allowed THEN 'in_review' WHEN len(miss) > 0 THEN 'needs_info' WHEN decision = 'escalate_senior' THEN 'escalated' WHEN band = 'low' OR decision = 'not_enough_evidence' THEN 'not_enough_evidence' WHEN band = 'medium' THEN 'in_review' WHEN risk = 'low' AND NOT hard_override THEN 'answered' ELSE 'in_review' END AS route,
  CASE WHEN NOT allowed THEN 'none' WHEN risk IN ('high', 'critical') OR band <> 'high' THEN 'strong' ELSE 'light' END AS model_tier, array_to_string(list_transform(miss, lambda f: 'Please send: ' || f), '; ') AS questions FROM g
""",
}
