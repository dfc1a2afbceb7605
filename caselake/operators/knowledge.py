"""Versioned policies: current versions, publish and retire, staleness, lint, citation checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.surrogate import CTE, cases, citations, policies, table


def current(pages: DataFrame) -> DataFrame:
    """The highest approved version of each policy."""
    return pages.filter("status = 'approved'").groupBy("policy_id").agg(F.max("version").alias("current_version"))


def publish(pages: DataFrame, drafts: DataFrame) -> DataFrame:
    """SCD-2: each drafted policy gets one new approved version, the current one expires."""
    top = pages.groupBy("policy_id").agg(F.max("version").alias("top"))
    cur = current(pages).join(drafts.select("policy_id"), "policy_id", "left_semi").withColumnRenamed("current_version", "version").withColumn("_closed", F.lit(True))
    kept = pages.join(cur, ["policy_id", "version"], "left").withColumn("status", F.when(F.col("_closed"), "expired").otherwise(F.col("status"))).select("policy_id", "version", "status")
    opened = drafts.select("policy_id").distinct().join(top, "policy_id").select("policy_id", (F.col("top") + 1).alias("version"), F.lit("approved").alias("status"))
    return kept.unionByName(opened)


def retire(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """The current version of the given policies expires; other rows stay."""
    cur = current(pages).join(ids, "policy_id", "left_semi").select("policy_id", F.col("current_version").alias("version"), F.lit(True).alias("_closed"))
    return pages.join(cur, ["policy_id", "version"], "left").select("policy_id", "version", F.when(F.col("_closed"), "expired").otherwise(F.col("status")).alias("status"))


def change_requests(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of each request (request_id, policy_id, base_version): accepted on the current version, else conflict or missing."""
    x = requests.join(current(pages), "policy_id", "left")
    outcome = F.when(F.col("current_version").isNull(), "missing").when(F.col("base_version") == F.col("current_version"), "accepted").otherwise("conflict")
    return x.select("request_id", "policy_id", "base_version", "current_version", outcome.alias("outcome"))


def citation_status(cites: DataFrame, pages: DataFrame) -> DataFrame:
    """Each citation with its page's status and whether it is stale: another version is current, or none is."""
    known = pages.select("policy_id", "version", "status")
    x = cites.join(known, ["policy_id", "version"], "left").join(current(pages), "policy_id", "left")
    return x.withColumn("stale", F.col("current_version").isNull() | (F.col("version") != F.col("current_version")))


def verify_citations(cites: DataFrame, pages: DataFrame) -> DataFrame:
    """Per case and verdict the number of citations: duplicates count only after a kept one."""
    x = citation_status(cites, pages)
    verdict = F.when(F.col("status").isNull(), "unknown").when(F.col("status") != "approved", F.col("status")).when(F.col("stale"), "superseded").otherwise("ok")
    order = Window.partitionBy("case_id", "policy_id", "v").orderBy("pos", "part_id", "supp_id", "cited_at", "price")
    x = x.withColumn("v", verdict).withColumn("k", F.row_number().over(order))
    x = x.withColumn("v", F.when((F.col("v") == "ok") & (F.col("k") > 1), "duplicate").otherwise(F.col("v")))
    return x.groupBy("case_id", F.col("v").alias("verdict")).agg(F.count("*").alias("n"))


def citation_validity(cites: DataFrame, pages: DataFrame) -> DataFrame:
    x = citation_status(cites, pages)
    return x.groupBy("case_id").agg(F.count("*").alias("total"), F.count_if((F.col("status") == "approved") & ~F.col("stale")).alias("valid"), F.count_if("stale").alias("stale"))


def supersession(cites: DataFrame, pages: DataFrame) -> DataFrame:
    """Cited versions with the version that replaced them, how often they are cited, and the last citation."""
    x = cites.join(current(pages), "policy_id", "left").filter("version < current_version")
    return x.groupBy("policy_id", "version", "current_version").agg(F.count("*").alias("n_cited"), F.max("cited_at").alias("last_cited"))


def _live(pages: DataFrame) -> DataFrame:
    return pages.join(current(pages), "policy_id").filter("version = current_version")


def contradictions(pages: DataFrame) -> DataFrame:
    """Request types and rule keys for which current policies give more than one value."""
    x = _live(pages).groupBy("request_type", "rule_key").agg(F.collect_set("rule_value").alias("v"), F.collect_set("policy_id").alias("ids"))
    return x.filter(F.size("v") > 1).select("request_type", "rule_key", F.size("v").cast("long").alias("n_values"), F.array_join(F.array_sort("ids"), ",").alias("policy_ids"))


def conflict_pairs(pages: DataFrame) -> DataFrame:
    """Pairs of current policies with one request type and rule key but other values."""
    x = _live(pages).select("policy_id", "request_type", "rule_key", "rule_value")
    a, b = x.alias("a"), x.alias("b")
    return a.join(b, ["request_type", "rule_key"]).filter("a.policy_id < b.policy_id AND a.rule_value <> b.rule_value").select("request_type", "rule_key", F.col("a.policy_id").alias("left_id"), F.col("b.policy_id").alias("right_id"))


def expired_linked(cites: DataFrame, pages: DataFrame) -> DataFrame:
    """Cited policies that exist but have no current version, with the status of their highest version."""
    known = pages.groupBy("policy_id").agg(F.max_by("status", "version").alias("last_status"))
    linked = cites.select("policy_id").distinct()
    return linked.join(current(pages), "policy_id", "left_anti").join(known, "policy_id")


def orphans(pages: DataFrame, cites: DataFrame) -> DataFrame:
    """Versions that nothing cites."""
    return pages.join(cites.select("policy_id", "version").distinct(), ["policy_id", "version"], "left_anti").select("policy_id", "version", "status")


def missing_teams(cases: DataFrame, teams: DataFrame) -> DataFrame:
    return cases.join(teams, "team", "left_anti").groupBy("team").agg(F.count("*").alias("n"))


def lint(pages: DataFrame, cites: DataFrame, cases: DataFrame | None = None, teams: DataFrame | None = None) -> DataFrame:
    """All findings by code: severity and count; those of teams where cases and teams are given."""
    found = [("CONTRADICTION", "error", contradictions(pages)), ("EXPIRED_LINKED", "error", expired_linked(cites, pages)), ("STALE_CITATION", "warning", supersession(cites, pages)), ("ORPHAN", "info", orphans(pages, cites))]
    if cases is not None and teams is not None:
        found.append(("MISSING_TEAM", "error", missing_teams(cases, teams)))
    out = None
    for code, severity, x in found:
        x = x.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "n")
        out = x if out is None else out.unionByName(x)
    return out


def link_targets(pages: DataFrame) -> DataFrame:
    """Distinct link targets of raw pages with the number of pages that link there."""
    x = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target")).distinct()
    return x.groupBy("target").agg(F.count("*").alias("n_pages"))


_DRAFTS = "p_size BETWEEN 46 AND 48"


def _drafts(s, d):
    return table(s, d, "part").filter(_DRAFTS).select(F.col("p_brand").alias("policy_id")).distinct()


def _teams(s, d):
    return table(s, d, "nation").select(F.col("n_name").alias("team"))


def _requests(s, d):
    return citations(s, d).groupBy("case_id", "policy_id").agg(F.max("version").alias("base_version")).withColumnRenamed("case_id", "request_id")


QUERIES = {
    "current_pages": lambda s, d: current(policies(s, d)),
    "page_publish": lambda s, d: publish(policies(s, d), _drafts(s, d)),
    "page_retire": lambda s, d: retire(policies(s, d), _drafts(s, d)),
    "change_requests_apply": lambda s, d: change_requests(policies(s, d), _requests(s, d)),
    "stale_precedents": lambda s, d: citation_status(citations(s, d), policies(s, d)).groupBy("policy_id", "stale").agg(F.count("*").alias("n")),
    "verify_citations": lambda s, d: verify_citations(citations(s, d), policies(s, d)),
    "citation_validity": lambda s, d: citation_validity(citations(s, d), policies(s, d)),
    "supersession": lambda s, d: supersession(citations(s, d), policies(s, d)),
    "lint_contradiction": lambda s, d: contradictions(policies(s, d)),
    "policy_conflict_pairs": lambda s, d: conflict_pairs(policies(s, d)),
    "lint_expired_linked_all": lambda s, d: expired_linked(citations(s, d), policies(s, d)),
    "lint_missing_team": lambda s, d: missing_teams(cases(s, d), _teams(s, d)),
    "lint_with_teams": lambda s, d: lint(policies(s, d), citations(s, d), cases(s, d), _teams(s, d)),
    "lint_orphan": lambda s, d: orphans(policies(s, d), citations(s, d)),
    "lint_all": lambda s, d: lint(policies(s, d), citations(s, d)),
    "page_links": lambda s, d: link_targets(table(s, d, "pages")),
}
_CUR = "cur AS (SELECT policy_id, max(version) AS current_version FROM policies WHERE status = 'approved' GROUP BY policy_id)"
_LIVE = f"{_CUR}, live AS (SELECT p.* FROM policies p JOIN cur USING (policy_id) WHERE version = current_version)"
_ST = f"{_CUR}, st AS (SELECT c.*, p.status, current_version, current_version IS NULL OR c.version <> current_version AS stale FROM citations c LEFT JOIN policies p ON p.policy_id = c.policy_id AND p.version = c.version LEFT JOIN cur ON cur.policy_id = c.policy_id)"
_D = f"dr AS (SELECT DISTINCT p_brand AS policy_id FROM part WHERE {_DRAFTS})"
_CLOSED = "SELECT p.policy_id, p.version, CASE WHEN dr.policy_id IS NOT NULL AND p.version = current_version THEN 'expired' ELSE status END AS status FROM policies p LEFT JOIN cur ON cur.policy_id = p.policy_id LEFT JOIN dr ON dr.policy_id = p.policy_id"
_CONTRA = "SELECT request_type, rule_key, count(DISTINCT rule_value) AS n_values, string_agg(DISTINCT policy_id, ',' ORDER BY policy_id) AS policy_ids FROM live GROUP BY request_type, rule_key HAVING count(DISTINCT rule_value) > 1"
_SUPER = "SELECT policy_id, c.version, current_version, count(*) AS n_cited, max(cited_at) AS last_cited FROM citations c JOIN cur USING (policy_id) WHERE c.version < current_version GROUP BY ALL"
_ORPHAN = "SELECT policy_id, version, status FROM policies p WHERE NOT EXISTS (SELECT 1 FROM citations c WHERE c.policy_id = p.policy_id AND c.version = p.version)"


def _expired(where: str) -> str:
    return f"SELECT policy_id, arg_max(status, version) AS last_status FROM policies WHERE ({where}) AND policy_id IN (SELECT policy_id FROM citations) GROUP BY policy_id HAVING count(*) FILTER (status = 'approved') = 0"


SQL = {
    "current_pages": f"WITH {CTE}, {_CUR} SELECT * FROM cur",
    "page_publish": f"WITH {CTE}, {_CUR}, {_D} {_CLOSED} UNION ALL SELECT policy_id, CAST(max(version) + 1 AS INT), 'approved' FROM policies JOIN dr USING (policy_id) GROUP BY policy_id",
    "page_retire": f"WITH {CTE}, {_CUR}, {_D} {_CLOSED}",
    "change_requests_apply": f"WITH {CTE}, {_CUR}, r AS (SELECT case_id AS request_id, policy_id, max(version) AS base_version FROM citations GROUP BY ALL) SELECT request_id, policy_id, base_version, current_version, CASE WHEN current_version IS NULL THEN 'missing' WHEN base_version = current_version THEN 'accepted' ELSE 'conflict' END AS outcome FROM r LEFT JOIN cur USING (policy_id)",
    "stale_precedents": f"WITH {CTE}, {_ST} SELECT policy_id, stale, count(*) AS n FROM st GROUP BY ALL",
    "verify_citations": f"WITH {CTE}, {_ST}, v AS (SELECT *, CASE WHEN status IS NULL THEN 'unknown' WHEN status <> 'approved' THEN status WHEN stale THEN 'superseded' ELSE 'ok' END AS v FROM st), k AS (SELECT *, row_number() OVER (PARTITION BY case_id, policy_id, v ORDER BY pos, part_id, supp_id, cited_at, price) AS k FROM v) SELECT case_id, CASE WHEN v = 'ok' AND k > 1 THEN 'duplicate' ELSE v END AS verdict, count(*) AS n FROM k GROUP BY ALL",
    "citation_validity": f"WITH {CTE}, {_ST} SELECT case_id, count(*) AS total, count(*) FILTER (status = 'approved' AND NOT stale) AS valid, count(*) FILTER (stale) AS stale FROM st GROUP BY case_id",
    "supersession": f"WITH {CTE}, {_CUR} {_SUPER}",
    "lint_contradiction": f"WITH {CTE}, {_LIVE} {_CONTRA}",
    "policy_conflict_pairs": f"WITH {CTE}, {_LIVE} SELECT a.request_type, a.rule_key, a.policy_id AS left_id, b.policy_id AS right_id FROM live a JOIN live b ON a.request_type = b.request_type AND a.rule_key = b.rule_key AND a.policy_id < b.policy_id AND a.rule_value <> b.rule_value",
    "lint_orphan": f"WITH {CTE} {_ORPHAN}",
    "lint_all": f"WITH {CTE}, {_LIVE} SELECT 'CONTRADICTION' AS code, 'error' AS severity, count(*) AS n FROM ({_CONTRA}) UNION ALL SELECT 'EXPIRED_LINKED', 'error', count(*) FROM ({_expired('true')}) UNION ALL SELECT 'STALE_CITATION', 'warning', count(*) FROM ({_SUPER}) UNION ALL SELECT 'ORPHAN', 'info', count(*) FROM ({_ORPHAN})",
    "page_links": """SELECT target, count(*) AS n_pages FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) GROUP BY target""",
}
_TEAM = "SELECT team, count(*) AS n FROM cases WHERE team NOT IN (SELECT n_name FROM nation) GROUP BY team"
SQL |= {
    "lint_expired_linked_all": f"WITH {CTE} {_expired('true')}",
    "lint_missing_team": f"WITH {CTE} {_TEAM}",
    "lint_with_teams": f"{SQL['lint_all']} UNION ALL SELECT 'MISSING_TEAM', 'error', count(*) FROM ({_TEAM})",
}
