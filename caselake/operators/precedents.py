"""Past decisions that are like a case: overlap of facts and hashed vectors, fields they skipped, facts of a case."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ..sources.surrogate import table
from .hygiene import hashed_buckets
from .scan import top_k_within, unit_counts
from .text import _tokens

# Shares of facts and of the text, how many active ones a case keeps, from where on one counts as similar.
FACTS, TEXT, MOST, SIMILAR = 0.6, 0.4, 10, 0.6
SIZE = 512


def matches(cases: DataFrame, precedents: DataFrame, k: int = MOST) -> DataFrame:
    """(case_id, precedent_id, score, rank): for each case the k precedents of its type that are most alike.

    cases (case_id, request_type, facts map, text) are a stated query set, precedents (precedent_id, request_type,
    facts, summary) are scanned. score = 0.6 x share of the case's facts that the precedent has too + 0.4 x cosine of
    hashed stems, to 5 places; ties by id. A null type matches nothing, a case without facts has share 0.

    A case meets the precedents with its very facts first. Any other precedent lacks a fact or more, so where the k-th
    of these is better than that allows, the case is done; only the other cases meet every precedent of their type."""
    q, d = written(_described(cases, "case_id", "text"), "cases"), written(_described(precedents, "precedent_id", "summary"), "precedents")
    first = written(top_k_within(d, q, "precedent_id", "case_id", "alike", _likeness, k), "alike")
    rest = written(_open_cases(q, d, first, k), "open-cases")
    more = top_k_within(d, rest, "precedent_id", "case_id", "request_type", _likeness, k)
    return first.join(rest.select("case_id").distinct(), "case_id", "left_anti").unionByName(more)


def _described(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, request_type, facts, alike, buckets); alike is the type with the facts."""
    pairs = "array_sort(transform(map_entries(facts), e -> concat(length(e.key), ':', e.key, coalesce(concat('=', e.value), ''))))"
    x = df.filter("request_type IS NOT NULL").select(key, "request_type", F.expr(f"coalesce({pairs}, cast(array() as array<string>))").alias("facts"), hashed_buckets(F.col(text), SIZE).alias("buckets"))
    return x.select(key, "request_type", "facts", F.struct("request_type", "facts").alias("alike"), "buckets")


def _open_cases(q: DataFrame, d: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """The cases that a precedent with other facts may be as like to as the k-th of ``first``."""
    most = d.groupBy(F.col("request_type").alias("_t")).agg(F.max(F.size("facts")).alias("most"))
    kth = first.filter(F.col("rank") == k).select(F.col("case_id").alias("_c"), F.col("score").alias("kth"))
    x = q.join(most, F.col("request_type") == F.col("_t")).join(kth, F.col("case_id") == F.col("_c"), "left")
    n = F.size("facts")
    # precedents with more facts may have all of the case's; scores are rounded to 5 places
    bound = F.when((n > 0) & (F.col("most") <= n), FACTS * (n - 1) / n + TEXT).otherwise(FACTS + TEXT)
    open_ids = x.filter(F.col("kth").isNull() | (F.col("kth") <= bound + 0.00002)).select("case_id").distinct()
    return q.join(open_ids, "case_id", "left_semi")


def _likeness(q: pa.StructArray):
    vectors, facts = unit_counts(q.field("buckets"), SIZE), q.field("facts").to_pylist()
    known = {f: k for k, f in enumerate(sorted({f for fs in facts for f in fs}))}
    has = np.zeros((len(facts), max(1, len(known))))
    for row, fs in zip(has, facts):
        row[[known[f] for f in set(fs)]] = 1 / len(fs) if fs else 0

    def score(d: pa.StructArray) -> np.ndarray:
        own = np.zeros((len(d), has.shape[1]))
        for row, fs in zip(own, d.field("facts").to_pylist()):
            row[[known[f] for f in fs if f in known]] = 1
        s = unit_counts(d.field("buckets"), SIZE) @ vectors.T
        np.maximum(s, 0, out=s)
        return np.round(FACTS * (own @ has.T) + TEXT * s, 5)

    return score


def case_facts(category: Column, required: Column, found: Column, risk: Column, team: Column, topic: Column | None = None) -> Column:
    """Map of a case's facts: category, missing (required fields without a value, sorted and joined by +, or none),
    risk and team, and the topic of a general question where there is one."""
    missing = F.array_sort(F.filter(required, lambda f: F.coalesce(F.element_at(found, f), F.lit("")) == ""))
    facts = {"category": F.coalesce(category, F.lit("unknown")), "missing": F.coalesce(F.nullif(F.array_join(missing, "+"), F.lit("")), F.lit("none")), "risk": F.coalesce(risk, F.lit("low")), "team": team}
    if topic is not None:
        facts["topic"] = topic
    return F.map_filter(F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def skipped_fields(found: DataFrame, precedents: DataFrame, workflows: DataFrame) -> DataFrame:
    """(case_id, precedent_id, skipped): precedents of ``matches`` from SIMILAR on that were decided (route_to_team or
    answer_from_policy) without fields that the workflow of their type requires now."""
    p = precedents.filter("decision_code IN ('route_to_team', 'answer_from_policy')").select("precedent_id", "request_type", "fields_provided")
    gaps = p.join(workflows.select("request_type", "required_fields"), "request_type").select("precedent_id", F.array_sort(F.array_except("required_fields", F.coalesce("fields_provided", F.expr("cast(array() as array<string>)")))).alias("skipped"))
    return found.filter(F.col("score") >= SIMILAR).join(gaps.filter(F.size("skipped") > 0), "precedent_id").select("case_id", "precedent_id", "skipped")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every twentieth document is a case, those with a good label are precedents; language, source and length are facts."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    facts = F.create_map(F.lit("source"), F.col("source"), F.lit("long"), (F.col("n_chars") >= 1000).cast("string"), F.lit("lang"), F.col("lang"))
    cases = d.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("case_id"), F.col("lang").alias("request_type"), facts.alias("facts"), "text")
    good = l.filter("quality = 1").select("doc_id").distinct()
    return cases, d.join(good, "doc_id", "left_semi").select(F.col("doc_id").alias("precedent_id"), F.col("lang").alias("request_type"), facts.alias("facts"), F.col("text").alias("summary"))


QUERIES = {"precedent_match": lambda s, d: matches(*_sides(s, d))}
SQL = {
    "precedent_match": f"""WITH w AS (SELECT doc_id, CAST('0x' || right(md5(token), 3) AS INT) % {SIZE} AS bucket FROM {_tokens('documents', 'doc_id')}),
v AS (SELECT doc_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM (SELECT doc_id, bucket, count(*) AS n FROM w GROUP BY ALL)),
c AS (SELECT a.doc_id AS case_id, b.doc_id AS precedent_id, {FACTS} * ((a.source = b.source)::INT + ((a.n_chars >= 1000) = (b.n_chars >= 1000))::INT + 1) / 3 AS facts
  FROM documents a JOIN documents b ON a.lang = b.lang WHERE a.doc_id % 20 = 0 AND b.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
t AS (SELECT a.doc_id AS case_id, b.doc_id AS precedent_id, sum(a.x * b.x) AS cosine FROM v a JOIN v b USING (bucket) WHERE a.doc_id % 20 = 0 GROUP BY ALL),
s AS (SELECT case_id, precedent_id, round(facts + {TEXT} * coalesce(cosine, 0), 5) AS score FROM c LEFT JOIN t USING (case_id, precedent_id))
SELECT * FROM (SELECT case_id, precedent_id, score, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, precedent_id) AS rank FROM s) WHERE rank <= {MOST}""",
}
