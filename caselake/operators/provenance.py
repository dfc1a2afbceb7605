"""Where a claim comes from: the page version that was in force when it was made, and what became of it since.

Versions are validity intervals: one holds from its date until the next one of its page. Dates of versions and times
of claims meet as points on a page's line, each once however many claims share it; what is in force at a point is
carried along the line, and claims find it by page and time. So no claim meets every version of its page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.surrogate import CTE, citations, policies, table


def in_force(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """(policy_id, at, in_force) for each different page and time of ``asked``: the version with the latest date up to
    then, of several with one date the highest; null before the first.

    Drafts and versions without a date or a page never hold. A page's line holds each time once."""
    v = versions.filter("policy_id IS NOT NULL AND effective_from IS NOT NULL AND status <> 'draft'").select("policy_id", F.col("effective_from").alias("at"), F.struct("version").alias("v"), F.lit(False).alias("asked"))
    a = asked.filter("policy_id IS NOT NULL AND at IS NOT NULL").select("policy_id", "at", F.lit(None).cast(v.schema["v"].dataType).alias("v"), F.lit(True).alias("asked"))
    points = v.union(a).groupBy("policy_id", "at").agg(F.max("v").alias("v"), F.bool_or("asked").alias("asked"))
    line = Window.partitionBy("policy_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return points.withColumn("v", F.last("v", ignorenulls=True).over(line)).filter("asked").select("policy_id", "at", F.col("v.version").alias("in_force"))


def provenance(claims: DataFrame, versions: DataFrame) -> DataFrame:
    """The claims (policy_id, version or null, at) with in_force, source_version, superseded_by, retired, unknown.

    in_force is the version whose interval holds ``at`` (of several with one date the highest); source_version the
    claim's own version where its page has it, else in_force. superseded_by is the page's current version where
    that is another one; retired says that none is approved any more, unknown that there is no such page or
    version. Columns of these names are replaced."""
    made = ("in_force", "source_version", "superseded_by", "retired", "unknown")
    kept = [F.col(f"`{c}`") for c in claims.columns if c not in made]
    x = claims.select(F.struct(*kept).alias("row"), F.col("policy_id").alias("_page"), F.col("version").alias("_version"), F.col("at").alias("_at"))
    x = x.join(in_force(versions, claims).select("in_force", "policy_id", "at"), (F.col("_page") == F.col("policy_id")) & (F.col("_at") == F.col("at")), "left").drop("policy_id", "at")
    pages = versions.filter("policy_id IS NOT NULL")
    known = pages.filter("version IS NOT NULL").select("policy_id", "version").distinct()
    x = x.join(known, (F.col("_page") == F.col("policy_id")) & (F.col("_version") == F.col("version")), "left").withColumn("source_version", F.coalesce("version", F.when(F.col("_version").isNull(), F.col("in_force")))).drop("policy_id", "version")
    current = pages.groupBy("policy_id").agg(F.max(F.when(F.col("status") == "approved", F.col("version"))).alias("current_version"))
    x = x.join(current, F.col("_page") == F.col("policy_id"), "left")
    return x.select("row.*", "in_force", "source_version", F.when(F.col("current_version") != F.col("source_version"), F.col("current_version")).alias("superseded_by"),
                    (F.col("policy_id").isNotNull() & F.col("current_version").isNull()).alias("retired"), F.col("source_version").isNull().alias("unknown"))


def workflow_for(requests: DataFrame, workflows: DataFrame) -> DataFrame:
    """requests (request_id, request_type) with workflow_id, version and team: the highest approved version of the
    workflow that lists the type; of several workflows the one with the smallest id. None leaves nulls.

    workflows (workflow_id, version, status, request_types array, team). An old version counts no more, even where
    only it lists the type."""
    live = workflows.filter("status = 'approved'").groupBy("workflow_id").agg(F.max_by(F.struct("version", "team", "request_types"), "version").alias("w"))
    by_type = live.select("workflow_id", "w.version", "w.team", F.explode(F.array_distinct("w.request_types")).alias("t")).groupBy("t").agg(F.min(F.struct("workflow_id", "version", "team")).alias("w"))
    return requests.select("request_id", "request_type").join(by_type, F.col("request_type") == F.col("t"), "left").select("request_id", "request_type", "w.workflow_id", "w.version", "w.team")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version is in force from the first day on which its part was shipped."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_shipdate").alias("effective_from"))
    return policies(spark, sf_dir).join(first, F.col("part_id") == F.col("l_partkey"), "left").select("policy_id", "version", "status", "effective_from")


QUERIES = {"claim_provenance": lambda s, d: provenance(citations(s, d).select("case_id", "pos", "policy_id", "version", F.col("cited_at").alias("at")), _versions(s, d)).drop("at")}
SQL = {
    "claim_provenance": f"""WITH {CTE}, v AS (SELECT policy_id, version, status, (SELECT min(l_shipdate) FROM lineitem WHERE l_partkey = part_id) AS since FROM policies),
h AS (SELECT policy_id, since, max(version) AS version FROM v WHERE status <> 'draft' AND since IS NOT NULL GROUP BY ALL),
cur AS (SELECT policy_id, max(version) FILTER (status = 'approved') AS current_version FROM policies GROUP BY 1)
SELECT c.case_id, c.pos, c.policy_id, c.version, h.version AS in_force, c.version AS source_version, CASE WHEN current_version <> c.version THEN current_version END AS superseded_by, current_version IS NULL AS retired, false AS unknown
FROM citations c ASOF LEFT JOIN h ON c.policy_id = h.policy_id AND c.cited_at >= h.since LEFT JOIN cur ON cur.policy_id = c.policy_id""",
}
