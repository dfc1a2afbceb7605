"""URL filters: a sorted range join of reversed-host keys with nested rule intervals.

A host is turned round label by label (``www.example.net`` -> ``net.example.www.``), so a rule's host and
all its subdomains are one interval ``[key, key + max)`` of sorted keys, and intervals of rules nest or are
apart. Each distinct host is swept once: within a range of keys, sorted hosts and rule starts pass by and a
stack holds the rules that are open. A rule is sent to the ranges that its interval touches and to no other.
Then each url tests its path against the few rules of its host; the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, whole_groups

#: Fixed values of the contract: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT_VERDICT = "allow"
RANGE_SAMPLE = 4096  # hosts that set the borders of ranges; only balance depends on them
SALTS = 16
_LAST = "\U0010ffff"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://``; null or no ``://`` gives empty ones. Only A-Z are lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^?#]*)", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    rows = [f"({', '.join(repr(x) for x in r)})" for r in rules]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS r(verdict, rule_host, rule_path)")


def _sweep(batches):
    """Rows (range, key, kind, host, end, rule) sorted by range, key, kind; kind 0 opens a rule, 1 is a host."""
    for t, starts in whole_groups(batches, ["range"]):
        begins = set(starts.tolist())
        hosts, found, stack = [], [], []
        cols = zip(t["kind"].to_pylist(), t["key"].to_pylist(), t["host"].to_pylist(), t["end"].to_pylist(), t["rule"].to_pylist())
        for k, (kind, key, host, end, rule) in enumerate(cols):
            if k in begins:
                stack = []
            while stack and stack[-1][0] <= key:
                stack.pop()
            if kind == 0:
                stack.append((end, rule))
            elif stack:
                hosts.append(host)
                found.append([r for _, r in stack])
        yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "active": pa.array(found, pa.list_(pa.int64()))})


def match_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Adds host, path, rule (``host + path`` of the rule or null) and verdict to every row.

    Of the rules that fit, the one with the longest host + path wins, then the longer host, then the
    greater text, then block. Null or malformed urls get empty parts, no rule and the default verdict.
    Repeated urls get equal rows; no rules give the default everywhere; columns of the input that have
    one of the new names are replaced."""
    spark = pages.sparkSession
    host, path = split_url(F.col(f"`{url}`"))
    # the input's columns travel in one, so that names of this work can't meet theirs
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    pages = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), host.alias("host"), path.alias("path"), F.pmod(F.xxhash64(F.col(f"`{url}`"), F.spark_partition_id()), F.lit(SALTS)).cast("int").alias("salt"))
    rules = rules.withColumn("rule_id", F.xxhash64("verdict", "rule_host", "rule_path")).dropDuplicates(["rule_id"])
    hosts = pages.select("host").filter("host <> ''").distinct().withColumn("key", reversed_key(F.col("host")))
    n = shuffle_partitions(spark)
    sample = sorted(r.key for r in hosts.orderBy(F.xxhash64("host")).limit(RANGE_SAMPLE).select("key").collect())
    borders = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    edge = F.array(*[F.lit(x) for x in borders]) if borders else F.expr("cast(array() as array<string>)")

    def at(key: Column) -> Column:
        return F.size(F.filter(edge, lambda b: b <= key))

    opens = rules.withColumn("key", reversed_key(F.col("rule_host"))).withColumn("end", F.concat("key", F.lit(_LAST)))
    opens = opens.withColumn("range", F.explode(F.sequence(at(F.col("key")), at(F.col("end")))))
    events = hosts.select(at(F.col("key")).alias("range"), "key", F.lit(1).alias("kind"), "host", F.lit(None).cast("string").alias("end"), F.lit(None).cast("long").alias("rule"))
    events = events.unionByName(opens.select("range", "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "end", F.col("rule_id").alias("rule")))
    swept = events.repartition(n, "range").sortWithinPartitions("range", "key", "kind").mapInArrow(_sweep, "host string, active array<long>")
    by_host = swept.select("host", F.explode("active").alias("rule_id")).join(rules, "rule_id")
    by_host = by_host.groupBy("host").agg(F.collect_list(F.struct("rule_host", "rule_path", "verdict")).alias("_rules"))
    # a host may have a third of all urls: its rules are copied to each salt
    by_host = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = pages.join(by_host, ["host", "salt"], "left")
    fits = F.filter("_rules", lambda r: F.startswith(F.col("path"), r["rule_path"]))
    ranked = F.transform(fits, lambda r: F.struct(F.length(F.concat(r["rule_host"], r["rule_path"])), F.length(r["rule_host"]), F.concat(r["rule_host"], r["rule_path"]).alias("rule"), r["verdict"].alias("verdict")))
    out = joined.withColumn("best", F.array_max(ranked))
    return out.select("row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; nulls, ties, repeated rows and empty tables as in ``match_urls``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return match_urls(pages, rules_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


SQL = {
    "op8_url_filters": r"""
WITH u AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, regexp_extract(rest, '^([^?#]*)', 1) AS hp FROM u),
h AS (SELECT page_id, translate(regexp_extract(hp, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(hp, length(regexp_extract(hp, '^([^/]*)', 1)) + 1) AS path FROM p),
r(verdict, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f AS (SELECT page_id, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
      FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT h.page_id, host, path, f.rule AS rule, coalesce(f.verdict, 'allow') AS verdict FROM h LEFT JOIN f ON f.page_id = h.page_id AND k = 1
""",
}
QUERIES = {"op8_url_filters": op8_url_filters}
