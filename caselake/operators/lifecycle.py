"""Decisions on cases, forwarding, messages, row and section visibility, histories of persons, scorecards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.surrogate import CTE, audit, cases, citations, table
from .casework import APPROVABLE, ROLE, viewers
from .text import SHAPES

#: States in which a decision can be taken, the chain of states that an action leads to, roles that see all.
DECIDABLE = ("in_review", "needs_info", "escalated", "not_enough_evidence")
CHAIN = {"approve": "approved>actioned", "edit_approve": "approved>actioned>notified", "reject": "rejected", "escalate": "escalated", "ask": "needs_info"}
SEES_ALL = ("ops_manager", "senior_reviewer", "knowledge_owner", "auditor")
#: Surrogate: a line item is a decision on its order by the customer with its supplier's number.
ACTION = "CASE l_partkey % 6 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'escalate' WHEN 3 THEN 'ask' WHEN 4 THEN 'edit_approve' ELSE 'approve' END"


def decisions(s, d) -> DataFrame:
    return table(s, d, "lineitem").selectExpr("l_orderkey AS case_id", "l_linenumber AS pos", "l_suppkey AS reviewer_id", f"{ACTION} AS action", "l_discount > 0.05 AS has_text", "l_shipdate AS ts")


def may_approve(role, risk, own_team, own_case):
    """Risk by role, the own team for specialists, never one's own case."""
    fits = F.lit(False)
    for r, risks in APPROVABLE.items():
        fits = fits | ((role == r) & risk.isin(*risks))
    return fits & ((role != "team_specialist") | own_team) & ~own_case


def apply_decisions(df: DataFrame, made: DataFrame, users: DataFrame) -> DataFrame:
    """Each decision with its verdict and the chain of states that it leads to.

    Gates in order: permission, state, text of an edited answer. Of the decisions on a case that pass all, the
    first by (ts, pos, reviewer_id, action) is accepted; later ones find the case decided. Unknown cases and reviewers are denied."""
    x = made.join(df.select("case_id", "state", "risk", "team", "requester_id"), "case_id", "left").join(users.withColumnRenamed("user_id", "reviewer_id"), "reviewer_id", "left")
    own_team, own_case = F.col("team") == F.col("user_team"), F.col("requester_id") == F.col("reviewer_id")
    ask = ~own_case & (F.col("role").isin(*SEES_ALL) | ((F.col("role") == "team_specialist") & own_team))
    allowed = F.coalesce(F.when(F.col("action") == "ask", ask).otherwise(may_approve(F.col("role"), F.col("risk"), own_team, own_case)), F.lit(False))
    gate = F.when(~allowed, "denied").when(~F.col("state").isin(*DECIDABLE), "already_decided").when((F.col("action") == "edit_approve") & ~F.col("has_text"), "invalid")
    x = x.withColumn("gate", gate)
    order = Window.partitionBy("case_id", F.col("gate").isNull()).orderBy("ts", "pos", "reviewer_id", "action")
    verdict = F.coalesce("gate", F.when(F.row_number().over(order) == 1, "accepted").otherwise("already_decided"))
    x = x.withColumn("verdict", verdict)
    chain = F.create_map(*[F.lit(v) for kv in CHAIN.items() for v in kv])[F.col("action")]
    return x.select("case_id", "pos", "action", "verdict", F.when(F.col("verdict") == "accepted", chain).alias("chain"))


def forward(df: DataFrame, moves: DataFrame) -> DataFrame:
    """Forwarding by requesters: own cases only, open ones only, once; the first move of a case wins (L3)."""
    x = moves.join(df.select("case_id", "state", "requester_id"), "case_id", "left")
    gate = F.when(~F.coalesce(F.col("requester_id") == F.col("actor_id"), F.lit(False)), "denied").when(F.col("state") == "answered", "closed")
    x = x.withColumn("gate", gate)
    order = Window.partitionBy("case_id", F.col("gate").isNull()).orderBy("ts", "pos")
    return x.select("case_id", "pos", F.coalesce("gate", F.when(F.row_number().over(order) == 1, "forwarded").otherwise("repeated")).alias("verdict"))


def fan_out(df: DataFrame, channels: tuple[str, ...] = ("email", "sms", "email", "portal")) -> DataFrame:
    """(doc_id, channel, position, recipient, status): each channel once, each recipient once a channel, shown as a token
    only; a channel without a recipient leaves one failed row. Null texts name nobody."""
    found = {"email": F.lower, "sms": lambda v: F.regexp_replace(v, "[^0-9]", "")}
    shapes, shown = {"email": SHAPES[0][2], "sms": SHAPES[2][2]}, {"email": SHAPES[0][1], "sms": SHAPES[2][1]}
    text = F.coalesce("text", F.lit(""))
    per = []
    for c in dict.fromkeys(channels):
        if c == "portal":
            sent = F.array(F.col("source"))
        else:
            sent = F.array_repeat(F.lit(shown[c]), F.size(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(shapes[c]), 0), found[c]))))
        per.append(F.struct(F.lit(c).alias("channel"), sent.alias("sent")))
    x = df.select("doc_id", F.explode(F.array(*per)).alias("c")).select("doc_id", "c.channel", F.posexplode_outer("c.sent").alias("position", "recipient"))
    return x.select("doc_id", "channel", F.coalesce("position", F.lit(0)).alias("position"), F.coalesce("recipient", F.lit("(none)")).alias("recipient"), F.when(F.col("recipient").isNull(), "failed").otherwise("simulated").alias("status"))


def case_events(s, d) -> DataFrame:
    """Audit rows whose number is a case's are about that case; the others are the system's."""
    return audit(s, d).join(cases(s, d).select(F.col("case_id").alias("seq"), "requester_id", "team"), "seq", "left").withColumn("is_case", F.col("requester_id").isNotNull())


def visible_audit(users: DataFrame, events: DataFrame) -> DataFrame:
    """How many audit rows each user may see and the newest of them: rows of visible cases, and the system's for
    roles that see all. Counted by owner and by team first, so no user meets every row."""
    def part(key, name):
        return events.filter("is_case").groupBy(F.col(key).alias(name)).agg(F.count("*").alias(f"n_{name}"), F.max("seq").alias(f"last_{name}"))

    all_ = events.agg(F.count("*").alias("n_all"), F.max("seq").alias("last_all"))
    x = users.join(part("requester_id", "user_id"), "user_id", "left").join(part("team", "user_team"), "user_team", "left").crossJoin(F.broadcast(all_))
    pick = lambda a: F.when(F.col("role").isin(*SEES_ALL), F.col(f"{a}_all")).when(F.col("role") == "team_specialist", F.col(f"{a}_user_team")).otherwise(F.col(f"{a}_user_id"))
    return x.select("user_id", "role", F.coalesce(pick("n"), F.lit(0)).alias("n_visible"), pick("last").alias("newest"))


def redacted(df: DataFrame, users: DataFrame) -> DataFrame:
    """Each case as the next customer sees it: the amount, or a marker where the section is closed to them."""
    x = df.withColumn("user_id", F.col("requester_id") + 1).join(users, "user_id")
    open_ = F.col("role").isin(*SEES_ALL) | ((F.col("role") == "team_specialist") & (F.col("team") == F.col("user_team")))
    return x.select("case_id", "user_id", F.when(open_, F.col("amount").cast("decimal(18,2)").cast("string")).otherwise("[restricted]").alias("amount"))


def person_timeline(df: DataFrame, cited: DataFrame) -> DataFrame:
    """(person_id, step, kind, ref, day): cases and citations of a person in the order of time."""
    x = df.select(F.col("requester_id").alias("person_id"), "created_at", "case_id")
    rows = x.select("person_id", F.lit("case").alias("kind"), F.col("case_id").cast("string").alias("ref"), F.col("created_at").cast("date").alias("day"))
    rows = rows.union(cited.join(x.drop("created_at"), "case_id").select("person_id", F.lit("citation"), F.concat_ws("-", "case_id", "pos"), F.col("cited_at").cast("date")))
    return rows.withColumn("step", F.row_number().over(Window.partitionBy("person_id").orderBy("day", "kind", "ref")))


def newest_cases(df: DataFrame, state: str = "in_review", risk: str = "high", most: int = 50) -> DataFrame:
    return df.filter((F.col("state") == state) & (F.col("risk") == risk)).orderBy(F.desc("created_at"), F.desc("case_id")).limit(most).select("case_id", "team", "amount")


def citation_sets(cited: DataFrame) -> DataFrame:
    """Per case: policies cited at a low and at a high price, in both, and only at a low one."""
    low, high = (F.collect_set(F.when(c, F.col("policy_id"))) for c in (F.col("price") < 30000, F.col("price") >= 30000))
    x = cited.groupBy("case_id").agg(low.alias("low"), high.alias("high"))
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    return x.select("case_id", joined(F.array_intersect("low", "high")).alias("both"), joined(F.array_except("low", "high")).alias("only_low"))


def audit_counts(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if(F.col("event") == "error").alias("blocked"), F.count_if(F.col("event") == "view").alias("reveals"), F.count_if((F.col("event") == "error") & (F.col("value") > 100)).alias("denials"), F.count("*").alias("n"))


def places(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """The element at int(share * n) of each group's sorted values, from counts of different values."""
    h = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    h = h.withColumns({"upto": F.sum("n").over(w.orderBy(value)), "all": F.sum("n").over(w)})
    return h.groupBy(by).agg(F.max("all").alias("n"), *[F.min(F.when(F.col("upto") > F.floor(F.lit(q) * F.col("all")), F.col(value))).alias(k) for k, q in shares.items()])


def adjudicated(expected: DataFrame, rulings: DataFrame) -> DataFrame:
    """Expected values with rulings (doc_id, original, value) laid over them; a ruling on another value is an error row."""
    x = expected.join(rulings, "doc_id", "left")
    stale = F.col("original").isNotNull() & (F.col("original") != F.col("quality"))
    return x.select("doc_id", F.when(stale | F.col("original").isNull(), F.col("quality")).otherwise(F.col("value")).alias("quality"), F.when(stale, "error").when(F.col("original").isNotNull(), "replaced").otherwise("kept").alias("status"))


def reconciled(df: DataFrame) -> DataFrame:
    """Tiles of the dashboard counted in one pass, and each again from the rows themselves."""
    tiles = {"waiting": "state = 'in_review'", "critical": "risk = 'critical'", "large": "amount > 200000"}
    once = df.agg(*[F.count_if(F.expr(c)).alias(k) for k, c in tiles.items()]).select(F.explode(F.create_map(*[v for k in tiles for v in (F.lit(k), F.col(k))])).alias("tile", "reported"))
    again = None
    for k, c in tiles.items():
        one = df.filter(c).select(F.lit(k).alias("tile"), "case_id").distinct().groupBy("tile").agg(F.count("*").alias("recomputed"))
        again = one if again is None else again.union(one)
    return once.join(again, "tile", "left").select("tile", "reported", F.coalesce("recomputed", F.lit(0)).alias("recomputed"), (F.col("reported") - F.coalesce("recomputed", F.lit(0))).alias("diff"))


def _rulings(s, d) -> DataFrame:
    return table(s, d, "labels").filter("toxic = 1").selectExpr("doc_id", "cast(doc_id % 2 AS int) AS original", "1 - cast(doc_id % 2 AS int) AS value")


QUERIES = {
    "apply_decisions": lambda s, d: apply_decisions(cases(s, d), decisions(s, d), viewers(s, d)),
    "forward_moves": lambda s, d: forward(cases(s, d), decisions(s, d).select("case_id", "pos", F.col("reviewer_id").alias("actor_id"), "ts")),
    "comms_fanout": lambda s, d: fan_out(table(s, d, "documents")),
    "visible_audit": lambda s, d: visible_audit(viewers(s, d), case_events(s, d)),
    "section_redaction": lambda s, d: redacted(cases(s, d), viewers(s, d)),
    "patient_timeline": lambda s, d: person_timeline(cases(s, d), citations(s, d)),
    "list_cases": lambda s, d: newest_cases(cases(s, d)),
    "citation_sets": lambda s, d: citation_sets(citations(s, d)),
    "audit_counts": lambda s, d: audit_counts(audit(s, d)),
    "latency_places": lambda s, d: places(table(s, d, "documents"), "lang", "n_chars", {"p50": 0.5, "p95": 0.95}),
    "adjudicated_scorecard": lambda s, d: adjudicated(table(s, d, "labels").select("doc_id", "quality"), _rulings(s, d)),
    "reconciliation": lambda s, d: reconciled(cases(s, d)),
}
_U = f"u AS (SELECT c_custkey AS user_id, {ROLE} AS role, n_name AS user_team FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_ALL = ", ".join(map(repr, SEES_ALL))
_RISKS = " OR ".join(f"role = '{r}' AND risk IN ({', '.join(map(repr, v))})" for r, v in APPROVABLE.items())
_DEC = f"dec AS (SELECT l_orderkey AS case_id, l_linenumber AS pos, l_suppkey AS reviewer_id, {ACTION} AS action, l_discount > 0.05 AS has_text, l_shipdate AS ts FROM lineitem)"
_FAN = {"email": (SHAPES[0][2], "lower(v)", "[EMAIL]"), "sms": (SHAPES[2][2], "regexp_replace(v, '[^0-9]', '', 'g')", "[PHONE]")}
SQL = {
    "apply_decisions": f"""WITH {CTE}, {_U}, {_DEC}, x AS (SELECT dec.*, state, risk, role, team = user_team AS mine, requester_id = reviewer_id AS self FROM dec LEFT JOIN cases USING (case_id) LEFT JOIN u ON user_id = reviewer_id),
g AS (SELECT *, CASE WHEN NOT coalesce(CASE WHEN action = 'ask' THEN NOT self AND (role IN ({_ALL}) OR role = 'team_specialist' AND mine) ELSE ({_RISKS}) AND (role <> 'team_specialist' OR mine) AND NOT self END, false) THEN 'denied'
  WHEN state NOT IN ({', '.join(map(repr, DECIDABLE))}) THEN 'already_decided' WHEN action = 'edit_approve' AND NOT has_text THEN 'invalid' END AS gate FROM x),
v AS (SELECT case_id, pos, action, coalesce(gate, CASE WHEN row_number() OVER (PARTITION BY case_id, gate IS NULL ORDER BY ts, pos, reviewer_id, action) = 1 THEN 'accepted' ELSE 'already_decided' END) AS verdict FROM g)
SELECT *, CASE WHEN verdict = 'accepted' THEN CASE action WHEN 'approve' THEN 'approved>actioned' WHEN 'edit_approve' THEN 'approved>actioned>notified' WHEN 'reject' THEN 'rejected' WHEN 'escalate' THEN 'escalated' ELSE 'needs_info' END END AS chain FROM v""",
    "forward_moves": f"WITH {CTE}, {_DEC}, g AS (SELECT case_id, pos, ts, CASE WHEN NOT coalesce(requester_id = reviewer_id, false) THEN 'denied' WHEN state = 'answered' THEN 'closed' END AS gate FROM dec LEFT JOIN cases USING (case_id)) SELECT case_id, pos, coalesce(gate, CASE WHEN row_number() OVER (PARTITION BY case_id, gate IS NULL ORDER BY ts, pos) = 1 THEN 'forwarded' ELSE 'repeated' END) AS verdict FROM g",
    "comms_fanout": " UNION ALL ".join(f"SELECT doc_id, '{c}' AS channel, CAST(k - 1 AS INT) AS position, CASE WHEN n = 0 THEN '(none)' ELSE '{t}' END AS recipient, CASE WHEN n = 0 THEN 'failed' ELSE 'simulated' END AS status FROM (SELECT doc_id, n, unnest(range(1, greatest(n, 1) + 1)) AS k FROM (SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '{p}'), lambda v: {f}))) AS n FROM documents))" for c, (p, f, t) in _FAN.items()) + " UNION ALL SELECT doc_id, 'portal', 0, coalesce(source, '(none)'), CASE WHEN source IS NULL THEN 'failed' ELSE 'simulated' END FROM documents",
    "visible_audit": f"WITH {CTE}, {_U}, e AS (SELECT seq, requester_id, team FROM audit LEFT JOIN cases ON case_id = seq), s AS (SELECT user_id, role, seq FROM u JOIN e ON CASE WHEN role IN ({_ALL}) THEN true WHEN role = 'team_specialist' THEN team = user_team ELSE requester_id = user_id END) SELECT user_id, role, count(seq) AS n_visible, max(seq) AS newest FROM u LEFT JOIN s USING (user_id, role) GROUP BY ALL",
    "section_redaction": f"WITH {CTE}, {_U} SELECT case_id, user_id, CASE WHEN role IN ({_ALL}) OR role = 'team_specialist' AND team = user_team THEN CAST(CAST(amount AS DECIMAL(18, 2)) AS VARCHAR) ELSE '[restricted]' END AS amount FROM cases JOIN u ON user_id = requester_id + 1",
    "patient_timeline": f"WITH {CTE}, r AS (SELECT requester_id AS person_id, 'case' AS kind, CAST(case_id AS VARCHAR) AS ref, CAST(created_at AS DATE) AS day FROM cases UNION ALL SELECT requester_id, 'citation', c.case_id || '-' || c.pos, CAST(cited_at AS DATE) FROM citations c JOIN cases USING (case_id)) SELECT *, CAST(row_number() OVER (PARTITION BY person_id ORDER BY day, kind, ref) AS INT) AS step FROM r",
    "list_cases": f"WITH {CTE} SELECT case_id, team, amount FROM cases WHERE state = 'in_review' AND risk = 'high' ORDER BY created_at DESC, case_id DESC LIMIT 50",
    "citation_sets": f"WITH {CTE}, x AS (SELECT case_id, coalesce(list(DISTINCT policy_id) FILTER (price < 30000), []) AS low, coalesce(list(DISTINCT policy_id) FILTER (price >= 30000), []) AS high FROM citations GROUP BY 1) SELECT case_id, array_to_string(list_sort(list_filter(low, lambda p: list_contains(high, p))), ',') AS both, array_to_string(list_sort(list_filter(low, lambda p: NOT list_contains(high, p))), ',') AS only_low FROM x",
    "audit_counts": f"WITH {CTE} SELECT count(*) FILTER (event = 'error') AS blocked, count(*) FILTER (event = 'view') AS reveals, count(*) FILTER (event = 'error' AND value > 100) AS denials, count(*) AS n FROM audit",
    "latency_places": "WITH l AS (SELECT lang, count(*) AS n, list_sort(list(n_chars)) AS v FROM documents WHERE n_chars IS NOT NULL GROUP BY 1) SELECT lang, n, v[CAST(floor(0.5 * n) AS INT) + 1] AS p50, v[CAST(floor(0.95 * n) AS INT) + 1] AS p95 FROM l",
    "adjudicated_scorecard": "SELECT doc_id, CASE WHEN toxic = 1 AND quality = doc_id % 2 THEN CAST(1 - quality AS INT) ELSE quality END AS quality, CASE WHEN toxic <> 1 OR toxic IS NULL THEN 'kept' WHEN quality <> doc_id % 2 THEN 'error' ELSE 'replaced' END AS status FROM labels",
    "reconciliation": f"WITH {CTE}, t AS (SELECT unnest([('waiting', count(*) FILTER (state = 'in_review')), ('critical', count(*) FILTER (risk = 'critical')), ('large', count(*) FILTER (amount > 200000))]) AS t FROM cases) SELECT t[1] AS tile, t[2] AS reported, t[2] AS recomputed, CAST(0 AS BIGINT) AS diff FROM t",
}
