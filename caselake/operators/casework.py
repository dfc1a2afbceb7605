"""Visibility, decision tables and the case life cycle."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.surrogate import CTE, audit, cases, table

#: Who may do what: a viewer is a customer; fixed rule for the surrogate roles.
ROLE = "CASE c_custkey % 6 WHEN 0 THEN 'ops_employee' WHEN 1 THEN 'team_specialist' WHEN 2 THEN 'ops_manager' WHEN 3 THEN 'senior_reviewer' WHEN 4 THEN 'knowledge_owner' ELSE 'auditor' END"
APPROVABLE = {"team_specialist": ("low",), "ops_manager": ("low", "medium"), "senior_reviewer": ("low", "medium", "high", "critical")}


def viewers(s, d) -> DataFrame:
    return table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey AS user_id", f"{ROLE} AS role", "n_name AS user_team")


def visible_counts(users: DataFrame, df: DataFrame) -> DataFrame:
    """How many cases each user may see at summary level.

    Own cases, team cases and the total are counted apart and joined by key, so no user meets every case."""
    own = df.groupBy(F.col("requester_id").alias("user_id")).agg(F.count("*").alias("own"))
    team = df.groupBy(F.col("team").alias("user_team")).agg(F.count("*").alias("of_team"))
    x = users.join(own, "user_id", "left").join(team, "user_team", "left").join(df.agg(F.count("*").alias("everything")), how="cross")
    n = F.when(F.col("role") == "ops_employee", F.col("own")).when(F.col("role") == "team_specialist", F.col("of_team")).otherwise(F.col("everything"))
    return x.select("user_id", "role", F.coalesce(n, F.lit(0)).alias("n_visible"))


def approvable_counts(users: DataFrame, df: DataFrame) -> DataFrame:
    """Cases that wait and that each user may approve: risk by role, own team for specialists, never one's own."""
    risks = F.create_map(*[x for r, v in APPROVABLE.items() for x in (F.lit(r), F.array(*map(F.lit, v)))])
    w = df.filter("state = 'in_review'")
    by = w.groupBy("team", "risk").agg(F.count("*").alias("n"))
    may = users.withColumn("risk", F.explode(risks[F.col("role")]))
    total = by.groupBy("risk").agg(F.sum("n").alias("n_all"))
    x = may.join(total, "risk", "left").join(by.select(F.col("team").alias("user_team"), "risk", "n"), ["user_team", "risk"], "left")
    x = x.withColumn("n", F.when(F.col("role") == "team_specialist", F.col("n")).otherwise(F.col("n_all")))
    # one's own cases are taken off where they were counted: those of one's team for a specialist, else all
    own = w.groupBy(F.col("requester_id").alias("user_id"), "risk", "team").agg(F.count("*").alias("mine"))
    everywhere = own.groupBy("user_id", "risk").agg(F.sum("mine").alias("mine_all"))
    x = x.join(own.withColumnRenamed("team", "user_team"), ["user_id", "risk", "user_team"], "left").join(everywhere, ["user_id", "risk"], "left")
    mine = F.when(F.col("role") == "team_specialist", F.col("mine")).otherwise(F.col("mine_all"))
    return x.groupBy("user_id", "role").agg(F.sum(F.coalesce("n", F.lit(0)) - F.coalesce(mine, F.lit(0))).alias("n_approvable"))


def risk_escalation(df: DataFrame, threshold: float = 300000.0, old: str = "1996-01-01") -> DataFrame:
    """Risk is raised by amount (strictly above) and by age, never lowered; reasons in a fixed order."""
    base = F.expr("CASE risk WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END")
    level = F.greatest(base, F.when(F.col("amount") > threshold, 2).otherwise(0), F.when(F.col("created_at") < F.lit(old).cast("timestamp_ntz"), 1).otherwise(0))
    reasons = F.array_compact(F.array(F.when(F.col("amount") > threshold, "AMOUNT"), F.when(F.col("created_at") < F.lit(old).cast("timestamp_ntz"), "RETROACTIVE"), F.when(base == 3, "CRITICAL")))
    return df.select("case_id", F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), level + 1).alias("final_risk"), F.array_join(reasons, ",").alias("reasons"))


def scored(df: DataFrame, lines: DataFrame) -> DataFrame:
    """Evidence score of a case from its line items: policy 0/15/30, precedent 0/15/20/25, fields 0..20 (half-even), clarity, no conflict."""
    per = lines.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.02).alias("ok"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open"))
    x = df.join(per, "case_id", "left").fillna(0, ["n", "ok", "returned", "open"])
    parts = {
        "policy": F.when(F.col("n") >= 3, 30).when(F.col("n") >= 1, 15).otherwise(0),
        "precedent": F.when(F.col("open") == 0, 0).when(F.col("open") == 1, 15).when(F.col("open") == 2, 20).otherwise(25),
        "fields": F.when(F.col("n") == 0, 20).otherwise(F.bround(20 * F.col("ok") / F.nullif("n", F.lit(0)), 0)).cast("int"),
        "clarity": F.when(F.col("request_type") == "MACHINERY", 0).when(F.col("amount") > 200000, 15).otherwise(8),
        "no_conflict": F.when(F.col("returned") > 1, 0).otherwise(10),
    }
    x = x.withColumns(parts).withColumn("score", F.expr(" + ".join(parts)))
    band = F.when(F.col("score") >= 75, "high").when(F.col("score") >= 45, "medium").otherwise("low")
    return x.withColumn("band", F.when((F.col("no_conflict") == 0) & (band == "high"), "medium").otherwise(band))


def confidence(df: DataFrame, lines: DataFrame) -> DataFrame:
    return scored(df, lines).select("case_id", "policy", "precedent", "fields", "clarity", "no_conflict", "score", "band")


DECIDE = """CASE WHEN request_type = 'BUILDING' AND risk = 'critical' THEN 'refuse_and_route' WHEN fields < 10 THEN 'request_missing_info' WHEN risk IN ('high', 'critical') THEN 'escalate_senior'
 WHEN policy = 0 AND precedent = 0 THEN 'not_enough_evidence' WHEN request_type = 'HOUSEHOLD' AND policy > 0 THEN 'answer_from_policy' WHEN request_type = 'HOUSEHOLD' THEN 'not_enough_evidence' ELSE 'route_to_team' END"""
#: safety, incomplete, override, low band or abstention, medium band, automatic, else a person.
ROUTE = """CASE WHEN decision = 'refuse_and_route' THEN 'in_review' WHEN fields < 10 THEN 'needs_info' WHEN decision = 'escalate_senior' THEN 'escalated' WHEN band = 'low' OR decision = 'not_enough_evidence' THEN 'not_enough_evidence'
 WHEN band = 'medium' THEN 'in_review' WHEN band = 'high' AND risk = 'low' THEN 'answered' ELSE 'in_review' END"""


def decide(df: DataFrame, lines: DataFrame) -> DataFrame:
    return scored(df, lines).withColumn("decision", F.expr(DECIDE)).withColumn("route", F.expr(ROUTE)).select("case_id", "decision", "route", F.when(F.expr("route = 'answered'"), "auto").otherwise("human").alias("routing"))


def state_history(events: DataFrame) -> DataFrame:
    """Rows of the audit log at which an actor's state changes, with how often so far."""
    w = Window.partitionBy("actor_id").orderBy("ts", "seq")
    x = events.withColumn("before", F.lag("event").over(w)).filter("before IS NULL OR before <> event")
    return x.select("actor_id", "seq", "event", F.row_number().over(Window.partitionBy("actor_id").orderBy("ts", "seq")).cast("long").alias("step"))


def streaks(events: DataFrame) -> DataFrame:
    """Longest run of events without an error of each actor, and the run that is going on."""
    w = Window.partitionBy("actor_id").orderBy("ts", "seq")
    bad = F.when(F.col("event") == "error", 1).otherwise(0)
    x = events.withColumn("island", F.sum(bad).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("good", 1 - bad)
    runs = x.groupBy("actor_id", "island").agg(F.sum("good").alias("run"))
    return runs.groupBy("actor_id").agg(F.max("run").alias("longest"), F.max_by("run", "island").alias("going"))


def step(level: int, total: int, agreed: int, streak: int, ok: bool, least: int = 10, share: float = 0.9, reviews: int = 25, share2: float = 0.95) -> tuple[int, int, int, int]:
    """One review: an error takes a level; ten agreements in a row, nine in ten of all, raise to 1; 25 reviews with 95 % to 2."""
    total, agreed = total + 1, agreed + ok
    if not ok:
        return max(0, level - 1), total, agreed, 0
    streak += 1
    if level == 0 and streak >= least and agreed / total >= share:
        return 1, total, agreed, streak
    return 2 if level == 1 and total >= reviews and agreed / total >= share2 else level, total, agreed, streak


LEVELS = "actor_id long, level int, total long, agreed long, streak long"


def trust_ladder(events: DataFrame, streak: int = 10, share: float = 0.9, reviews: int = 25, share2: float = 0.95) -> DataFrame:
    """Level 0 to 2 of each actor after all events in order: an error takes one level, agreements raise it.

    Each actor's events are sorted by Spark and pass by one after another; four numbers are carried, so an actor's
    log may be of any length. A null actor is one; a null event is no error."""
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in LEVELS.split(", ")])

    def run(batches):
        actor, now, out = None, None, []
        for b in batches:
            for who, ok in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if now and who != actor:
                    out.append((actor, *now))
                    now = None
                actor, now = who, step(*(now or (0, 0, 0, 0)), ok, streak, share, reviews, share2)
            if out:
                yield batch(out)
                out = []
        if now:
            yield batch([(actor, *now)])

    x = events.select(F.col("actor_id").cast("long").alias("actor_id"), F.coalesce(F.col("event") != "error", F.lit(True)).alias("ok"), "ts", "seq")
    return x.repartition("actor_id").sortWithinPartitions("actor_id", "ts", "seq").select("actor_id", "ok").mapInArrow(run, LEVELS)


def sliding_counts(events: DataFrame, event: str = "click", hours: int = 24, most: int = 3) -> DataFrame:
    """Events of a kind with the number of the actor's in the interval that ends there; over the limit or not."""
    x = events.filter(F.col("event") == event)
    x = x.withColumn("n_recent", F.expr(f"count(*) OVER (PARTITION BY actor_id ORDER BY ts RANGE BETWEEN INTERVAL {hours} HOURS PRECEDING AND CURRENT ROW)"))
    return x.select("actor_id", "seq", "n_recent", (F.col("n_recent") > most).alias("limited"))


def first_alerts(events: DataFrame) -> DataFrame:
    """One alert for each actor and trigger, ever: the first one."""
    x = events.filter("event IN ('error', 'purchase')")
    return x.groupBy("actor_id", F.col("event").alias("trigger")).agg(F.min_by("seq", F.struct("ts", "seq")).alias("seq"), F.min("ts").alias("ts"))


def audit_gaps(df: DataFrame, lines: DataFrame) -> DataFrame:
    """Answered cases without any evidence row, and cases whose first evidence is older than the case."""
    first = lines.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.min("l_shipdate").alias("first"))
    none = df.filter("state = 'answered'").join(first, "case_id", "left_anti").select("case_id", F.lit("no_evidence").alias("violation"))
    early = df.join(first, "case_id").filter("first < created_at").select("case_id", F.lit("evidence_before_case").alias("violation"))
    return none.union(early)


def details_merge(turns: DataFrame) -> DataFrame:
    """Per conversation the first user text wins over later ones; number of turns by role."""
    x = turns.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("request"))
    n = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "assistant").alias("n_answers"))
    return n.join(x, "conv_id", "left")


QUERIES = {
    "visible_case_counts": lambda s, d: visible_counts(viewers(s, d), cases(s, d)),
    "risk_escalation": lambda s, d: risk_escalation(cases(s, d)),
    "confidence_score": lambda s, d: confidence(cases(s, d), table(s, d, "lineitem")),
    "decide_route": lambda s, d: decide(cases(s, d), table(s, d, "lineitem")),
    "state_history": lambda s, d: state_history(audit(s, d)),
    "trust_streaks": lambda s, d: streaks(audit(s, d)),
    "trust_ladder_batch": lambda s, d: trust_ladder(audit(s, d)),
    "rate_limit_sliding": lambda s, d: sliding_counts(audit(s, d)),
    "alert_dedup": lambda s, d: first_alerts(audit(s, d)),
    "audit_gaps": lambda s, d: audit_gaps(cases(s, d), table(s, d, "lineitem")),
    "details_merge": lambda s, d: details_merge(table(s, d, "conversations")),
    "approvable_cases": lambda s, d: approvable_counts(viewers(s, d), cases(s, d)),
}
_PER = """per AS (SELECT l_orderkey AS case_id, count(*) AS n, count(*) FILTER (l_discount > 0.02) AS ok, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open FROM lineitem GROUP BY 1),
x AS (SELECT c.*, coalesce(n, 0) AS n, coalesce(ok, 0) AS ok, coalesce(returned, 0) AS returned, coalesce(open, 0) AS open FROM cases c LEFT JOIN per USING (case_id)),
y AS (SELECT *, CASE WHEN n >= 3 THEN 30 WHEN n >= 1 THEN 15 ELSE 0 END AS policy, CASE WHEN open = 0 THEN 0 WHEN open = 1 THEN 15 WHEN open = 2 THEN 20 ELSE 25 END AS precedent,
  CAST(CASE WHEN n = 0 THEN 20 ELSE round_even(20.0 * ok / n, 0) END AS INT) AS fields, CASE WHEN request_type = 'MACHINERY' THEN 0 WHEN amount > 200000 THEN 15 ELSE 8 END AS clarity, CASE WHEN returned > 1 THEN 0 ELSE 10 END AS no_conflict FROM x),
z AS (SELECT *, policy + precedent + fields + clarity + no_conflict AS score FROM y),
sc AS (SELECT *, CASE WHEN no_conflict = 0 AND score >= 75 THEN 'medium' WHEN score >= 75 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END AS band FROM z)"""
_LEVEL = "greatest(CASE risk WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END, CASE WHEN amount > 300000 THEN 2 ELSE 0 END, CASE WHEN created_at < TIMESTAMP '1996-01-01' THEN 1 ELSE 0 END)"
_MAY = " OR ".join(f"(role = '{r}' AND risk IN ({', '.join(map(repr, v))}))" for r, v in APPROVABLE.items())
SQL = {
    "approvable_cases": f"WITH {CTE}, u AS (SELECT c_custkey AS user_id, {ROLE} AS role, n_name AS user_team FROM customer JOIN nation ON c_nationkey = n_nationkey), w AS (SELECT team, risk, requester_id FROM cases WHERE state = 'in_review'), t AS (SELECT team, risk, count(*) AS n FROM w GROUP BY ALL), m AS (SELECT requester_id, team, risk, count(*) AS n FROM w GROUP BY ALL), a AS (SELECT user_id, role, sum(t.n) AS n FROM u JOIN t ON ({_MAY}) AND (role <> 'team_specialist' OR team = user_team) GROUP BY ALL), o AS (SELECT user_id, sum(m.n) AS n FROM u JOIN m ON requester_id = user_id AND ({_MAY}) AND (role <> 'team_specialist' OR team = user_team) GROUP BY 1) SELECT user_id, role, CAST(coalesce(a.n, 0) - coalesce(o.n, 0) AS BIGINT) AS n_approvable FROM u LEFT JOIN a USING (user_id, role) LEFT JOIN o USING (user_id) WHERE role IN ({', '.join(map(repr, APPROVABLE))})",
    "visible_case_counts": f"WITH {CTE}, u AS (SELECT c_custkey AS user_id, {ROLE} AS role, n_name AS user_team FROM customer JOIN nation ON c_nationkey = n_nationkey), o AS (SELECT requester_id, count(*) AS n FROM cases GROUP BY 1), t AS (SELECT team, count(*) AS n FROM cases GROUP BY 1) SELECT user_id, role, coalesce(CASE role WHEN 'ops_employee' THEN o.n WHEN 'team_specialist' THEN t.n ELSE (SELECT count(*) FROM cases) END, 0) AS n_visible FROM u LEFT JOIN o ON requester_id = user_id LEFT JOIN t ON team = user_team",
    "risk_escalation": f"WITH {CTE} SELECT case_id, ['low', 'medium', 'high', 'critical'][{_LEVEL} + 1] AS final_risk, concat_ws(',', CASE WHEN amount > 300000 THEN 'AMOUNT' END, CASE WHEN created_at < TIMESTAMP '1996-01-01' THEN 'RETROACTIVE' END, CASE WHEN risk = 'critical' THEN 'CRITICAL' END) AS reasons FROM cases",
    "confidence_score": f"WITH {CTE}, {_PER} SELECT case_id, policy, precedent, fields, clarity, no_conflict, score, band FROM sc",
    "decide_route": f"WITH {CTE}, {_PER}, d AS (SELECT *, {DECIDE} AS decision FROM sc), r AS (SELECT *, {ROUTE} AS route FROM d) SELECT case_id, decision, route, CASE WHEN route = 'answered' THEN 'auto' ELSE 'human' END AS routing FROM r",
    "state_history": f"WITH {CTE}, b AS (SELECT *, lag(event) OVER (PARTITION BY actor_id ORDER BY ts, seq) AS before FROM audit) SELECT actor_id, seq, event, row_number() OVER (PARTITION BY actor_id ORDER BY ts, seq) AS step FROM b WHERE before IS NULL OR before <> event",
    "trust_streaks": f"WITH {CTE}, i AS (SELECT actor_id, event, sum(CASE WHEN event = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY actor_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM audit), r AS (SELECT actor_id, island, count(*) FILTER (event <> 'error') AS run FROM i GROUP BY ALL) SELECT actor_id, max(run) AS longest, arg_max(run, island) AS going FROM r GROUP BY actor_id",
    "rate_limit_sliding": f"WITH {CTE}, w AS (SELECT actor_id, seq, count(*) OVER (PARTITION BY actor_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n_recent FROM audit WHERE event = 'click') SELECT actor_id, seq, n_recent, n_recent > 3 AS limited FROM w",
    "alert_dedup": f"WITH {CTE} SELECT actor_id, event AS trigger, arg_min(seq, (ts, seq)) AS seq, min(ts) AS ts FROM audit WHERE event IN ('error', 'purchase') GROUP BY ALL",
    "audit_gaps": f"WITH {CTE}, f AS (SELECT l_orderkey AS case_id, min(l_shipdate) AS first FROM lineitem GROUP BY 1) SELECT case_id, 'no_evidence' AS violation FROM cases WHERE state = 'answered' AND case_id NOT IN (SELECT case_id FROM f) UNION ALL SELECT case_id, 'evidence_before_case' FROM cases JOIN f USING (case_id) WHERE first < created_at",
    "details_merge": "SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'assistant') AS n_answers, arg_min(text, turn) FILTER (role = 'user') AS request FROM conversations GROUP BY conv_id",
}
