"""Operations analytics: ageing, counts, named views, cost split, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.surrogate import CTE, NOW, cases, citations

OPEN = ("in_review", "needs_info", "escalated", "not_enough_evidence")
_NOW = NOW.replace("TIMESTAMP_NTZ", "TIMESTAMP")


def hours_since(ts: Column | str, now: str = NOW) -> Column:
    """Hours from ts to now as a double, not below 0."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.greatest(F.timestamp_diff("SECOND", ts, F.expr(now)) / F.lit(3600.0), F.lit(0.0))


def queue_aging(df: DataFrame, now: str = NOW) -> DataFrame:
    """Open cases by state and team: count, average and longest hours."""
    x = df.filter(F.col("state").isin(*OPEN)).withColumn("h", hours_since("created_at", now))
    return x.groupBy("state", "team").agg(F.count("*").alias("n"), F.round(F.avg("h"), 1).alias("avg_hours"), F.round(F.max("h"), 1).alias("max_hours"))


def dashboard_counts(df: DataFrame) -> DataFrame:
    """Cases by state, team and risk in one pass of grouping sets; the grand total has all keys null."""
    x = df.groupingSets([["state"], ["team"], ["risk"], []], "state", "team", "risk")
    return x.agg(F.count("*").alias("n"), F.count_if(F.col("state").isin(*OPEN)).alias("n_open"), F.round(F.avg("amount"), 2).alias("avg_amount"))


VIEWS = {
    "queue": f"state IN {OPEN}",
    "with_reviewers": "state = 'in_review'",
    "done": "state = 'answered'",
    "high_risk": f"state IN {OPEN} AND risk IN ('high', 'critical')",
    "overdue": "state = 'in_review' AND hours > 24",
    "needs_action": "state = 'needs_info'",
}


def case_views(df: DataFrame, now: str = NOW) -> DataFrame:
    """Number of cases and amount of each named view; a case may be in several."""
    x = df.withColumn("hours", hours_since("created_at", now))
    named = F.array(*[F.when(F.expr(c), F.lit(v)) for v, c in VIEWS.items()])
    x = x.withColumn("view", F.explode(F.array_compact(named)))
    return x.groupBy("view").agg(F.count("*").alias("n"), F.min("case_id").alias("first_case"), F.max("case_id").alias("last_case"))


def cost_split(df: DataFrame) -> DataFrame:
    """Share of model tiers by request type; tier none below 50000, light below 250000, else light and strong."""
    tier = F.when(F.col("amount") < 50000, "none").when(F.col("amount") < 250000, "light").otherwise("strong")
    x = df.groupBy("request_type").agg(F.count("*").alias("n"), *[F.count_if(tier == t).alias(f"n_{t}") for t in ("none", "light", "strong")])
    return x.select("request_type", "n", *[F.round(100 * F.col(f"n_{t}") / F.nullif(F.col("n"), F.lit(0)), 2).alias(f"pct_{t}") for t in ("none", "light", "strong")])


def waiting_first(df: DataFrame, by: str = "team") -> DataFrame:
    """Per team the waiting case of the highest risk, then the oldest, then the smallest id."""
    rank = F.expr("CASE risk WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END")
    x = df.filter("state = 'in_review'").select(by, "case_id", "risk", "created_at", rank.alias("r"))
    best = F.min_by(F.struct("case_id", "risk", "created_at"), F.struct(-F.col("r"), F.col("created_at"), F.col("case_id")))
    return x.groupBy(by).agg(best.alias("b")).select(by, "b.*")


def sla_sweep(df: DataFrame, now: str = NOW, limit_hours: int = 24) -> DataFrame:
    """Cases with reviewers for longer than the limit, with whole hours over it."""
    x = df.filter("state IN ('in_review', 'escalated')").withColumn("h", hours_since("created_at", now))
    return x.filter(F.col("h") > limit_hours).select("case_id", "team", F.floor(F.col("h") - limit_hours).cast("long").alias("hours_over"))


def type_overview(df: DataFrame, kinds: DataFrame) -> DataFrame:
    """Every request type, also those without cases: reviews and the share that was answered."""
    x = df.groupBy("request_type").agg(F.count("*").alias("reviews"), F.count_if(F.col("state") == "answered").alias("agreed"))
    x = kinds.select("request_type").distinct().join(x, "request_type", "left").fillna(0, ["reviews", "agreed"])
    return x.withColumn("agreement_pct", F.coalesce(F.round(100 * F.col("agreed") / F.nullif("reviews", F.lit(0)), 1), F.lit(0.0)))


def case_edges(citations: DataFrame) -> DataFrame:
    """Distinct edges case - policy version, and policy - policy for policies that a case cites together."""
    own = citations.select(F.col("case_id").cast("string").alias("source"), F.concat_ws("@", "policy_id", "version").alias("target"), F.lit("cites").alias("relation")).distinct()
    per = citations.select("case_id", "policy_id").distinct()
    pairs = per.alias("a").join(per.alias("b"), "case_id").filter("a.policy_id < b.policy_id").select(F.col("a.policy_id").alias("source"), F.col("b.policy_id").alias("target"), F.lit("together").alias("relation")).distinct()
    return own.unionByName(pairs)


def neighbours(edges: DataFrame) -> DataFrame:
    """Number of distinct one-hop neighbours of every node."""
    x = edges.select(F.col("source").alias("node"), F.col("target").alias("other")).union(edges.select("target", "source"))
    return x.distinct().groupBy("node").agg(F.count("*").alias("n_neighbours"))


def fingerprint(df: DataFrame, volatile: tuple[str, ...] = ()) -> DataFrame:
    """One row: number of rows and an order-insensitive hash of all but the volatile columns."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns) if c not in volatile])
    return df.select(h.alias("h")).agg(F.count("*").alias("n"), F.expr("bit_xor(h)").alias("xor_hash"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("sum_hash"))


_VIEW_SQL = " UNION ALL ".join(f"SELECT '{v}' AS view, case_id FROM h WHERE {c}" for v, c in VIEWS.items())
_H = f"h AS (SELECT *, greatest(date_diff('second', created_at, {_NOW}) / 3600.0, 0) AS h, h AS hours FROM cases)"
_EDGES = """own AS (SELECT DISTINCT CAST(case_id AS VARCHAR) AS source, policy_id || '@' || version AS target, 'cites' AS relation FROM citations),
per AS (SELECT DISTINCT case_id, policy_id FROM citations),
e AS (SELECT * FROM own UNION ALL SELECT DISTINCT a.policy_id, b.policy_id, 'together' FROM per a JOIN per b ON a.case_id = b.case_id AND a.policy_id < b.policy_id)"""
QUERIES = {
    "queue_aging": lambda s, d: queue_aging(cases(s, d)),
    "dashboard_counts": lambda s, d: dashboard_counts(cases(s, d)),
    "case_views": lambda s, d: case_views(cases(s, d)),
    "cost_split": lambda s, d: cost_split(cases(s, d)),
    "risk_banner_top": lambda s, d: waiting_first(cases(s, d)),
    "sla_sweep": lambda s, d: sla_sweep(cases(s, d)),
    "trust_overview": lambda s, d: type_overview(cases(s, d).filter("amount > 100000"), cases(s, d)),
    "case_graph_edges": lambda s, d: case_edges(citations(s, d)),
    "graph_neighbours": lambda s, d: neighbours(case_edges(citations(s, d))),
    "table_fingerprint": lambda s, d: fingerprint(cases(s, d), ("created_at",)),
}
SQL = {
    "queue_aging": f"""WITH {CTE}, {_H} SELECT state, team, count(*) AS n, round(avg(h), 1) AS avg_hours, round(max(h), 1) AS max_hours FROM h WHERE state IN {OPEN} GROUP BY state, team""",
    "dashboard_counts": f"""WITH {CTE} SELECT state, team, risk, count(*) AS n, count(*) FILTER (state IN {OPEN}) AS n_open, round(avg(amount), 2) AS avg_amount FROM cases GROUP BY GROUPING SETS ((state), (team), (risk), ())""",
    "case_views": f"""WITH {CTE}, {_H}, v AS ({_VIEW_SQL}) SELECT view, count(*) AS n, min(case_id) AS first_case, max(case_id) AS last_case FROM v GROUP BY view""",
    "cost_split": f"""WITH {CTE} SELECT request_type, count(*) AS n, round(100.0 * count(*) FILTER (amount < 50000) / count(*), 2) AS pct_none, round(100.0 * count(*) FILTER (amount >= 50000 AND amount < 250000) / count(*), 2) AS pct_light, round(100.0 * count(*) FILTER (amount >= 250000) / count(*), 2) AS pct_strong FROM cases GROUP BY request_type""",
    "risk_banner_top": f"""WITH {CTE}, k AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY CASE risk WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, created_at, case_id) AS k FROM cases WHERE state = 'in_review') SELECT team, case_id, risk, created_at FROM k WHERE k = 1""",
    "sla_sweep": f"""WITH {CTE}, {_H} SELECT case_id, team, CAST(floor(h - 24) AS BIGINT) AS hours_over FROM h WHERE state IN ('in_review', 'escalated') AND h > 24""",
    "trust_overview": f"""WITH {CTE}, x AS (SELECT request_type, count(*) AS reviews, count(*) FILTER (state = 'answered') AS agreed FROM cases WHERE amount > 100000 GROUP BY request_type) SELECT t.request_type, coalesce(reviews, 0) AS reviews, coalesce(agreed, 0) AS agreed, coalesce(round(100.0 * agreed / reviews, 1), 0) AS agreement_pct FROM (SELECT DISTINCT request_type FROM cases) t LEFT JOIN x USING (request_type)""",
    "case_graph_edges": f"WITH {CTE}, {_EDGES} SELECT * FROM e",
    "graph_neighbours": f"WITH {CTE}, {_EDGES}, n AS (SELECT source AS node, target AS other FROM e UNION SELECT target, source FROM e) SELECT node, count(*) AS n_neighbours FROM n GROUP BY node",
}
