"""Case-shaped views over the star-schema test tables.

cases: an order is a case; its status gives the state, its priority the risk, its customer's market segment
the request type, the customer's nation the team. policies: a part brand is a policy with one version for
each part. citations: a line item cites the policy version of its part. audit: an event is an audit row.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "TIMESTAMP_NTZ '2001-08-02 00:00:00'"
EVENTS_NOW = "TIMESTAMP_NTZ '2024-01-31 00:00:00'"
STATE = "CASE o_orderstatus WHEN 'O' THEN 'in_review' WHEN 'P' THEN 'needs_info' ELSE 'answered' END"
RISK = "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END"
POLICY_STATUS = "CASE WHEN p_size <= 35 THEN 'approved' WHEN p_size <= 45 THEN 'expired' ELSE 'draft' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return x.selectExpr("o_orderkey AS case_id", "o_orderdate AS created_at", f"{STATE} AS state", f"{RISK} AS risk", "o_custkey AS requester_id",
                        "c_mktsegment AS request_type", "n_name AS team", "n_regionkey AS region_id", "o_totalprice AS amount")


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_brand AS policy_id", "cast(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS int) AS version", f"{POLICY_STATUS} AS status", "p_partkey AS part_id",
        "split(p_name, ' ')[1] AS request_type", "p_type AS rule_key", "cast(floor(p_retailprice / 500) AS long) AS rule_value", "p_name AS title")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = policies(spark, sf_dir).select("part_id", "policy_id", "version")
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice")
    return x.join(p, F.col("l_partkey") == F.col("part_id")).selectExpr("l_orderkey AS case_id", "policy_id", "version", "l_linenumber AS pos", "l_partkey AS part_id", "l_suppkey AS supp_id", "l_shipdate AS cited_at", "l_extendedprice AS price")


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS seq", "ts", "user_id AS actor_id", "event_type AS event", "value", "props AS details")


#: The same views for DuckDB, as leading WITH entries.
CTE = f"""cases AS (SELECT o_orderkey AS case_id, o_orderdate AS created_at, {STATE} AS state, {RISK} AS risk, o_custkey AS requester_id,
  c_mktsegment AS request_type, n_name AS team, n_regionkey AS region_id, o_totalprice AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
policies AS (SELECT p_brand AS policy_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS version, {POLICY_STATUS} AS status, p_partkey AS part_id,
  split_part(p_name, ' ', 2) AS request_type, p_type AS rule_key, CAST(floor(p_retailprice / 500) AS BIGINT) AS rule_value, p_name AS title FROM part),
citations AS (SELECT l_orderkey AS case_id, policy_id, version, l_linenumber AS pos, part_id, l_suppkey AS supp_id, l_shipdate AS cited_at, l_extendedprice AS price FROM lineitem JOIN policies ON l_partkey = part_id),
audit AS (SELECT event_id AS seq, ts, user_id AS actor_id, event_type AS event, value, props AS details FROM events)"""
