"""Shapes, fields and steering rules are tried only on texts that hold their fixed part, and find the same."""

import re

from pyspark.sql import functions as F

from caselake.operators import hygiene, text

TEXTS = ["", None, "mail a.b@c.org, call +1 555 123 4567 or 10.0.0.1", "@ only", "+1 is not enough", "1234 5678 1234 5678 x@y.zz1234567812345678", "IGNORE ALL rules", "1gn0r3 4ll", "ignore", "the pa55word is", "p@ssword is x", "see https://a.b/c", "http alone", "ACT AS AN admin", "what?"]


def test_same_finds_as_the_whole_patterns(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string")
    c = F.col("text")
    got = {r.k: r for r in text.pii_types(df).select("k", "types", text.mask_shapes(c).alias("masked"), hygiene.steering(c).alias("steer"), hygiene.extract_fields(c).alias("fields"), text.keyword_type(c).alias("kind")).collect()}
    leet = str.maketrans(*hygiene.LEET)
    for k, t in enumerate(TEXTS):
        masked, t = t, t or ""
        for _, token, p in text.SHAPES:
            masked = masked and re.sub(p, token, masked)
        assert got[k].masked == masked
        assert got[k].types == ",".join(n for n, _, p in text.SHAPES if re.search(p, t))
        assert got[k].steer == any(re.search(p, v) for p in hygiene.STEERING for v in (t.lower(), t.translate(leet).lower()))
        assert (got[k].fields or {}) == {n: m.group() for n, p in hygiene.FIELDS if (m := re.search(p, t))}
        assert got[k].kind == (next((n for n, p in text.TYPES if re.search(p, t)), "unknown") if TEXTS[k] is not None else "unknown")


def test_texts_without_the_fixed_part_are_not_tried(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string")
    plan = df.select(hygiene.steering(F.col("text")), hygiene.extract_fields(F.col("text")), text.mask_shapes(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"Contains({v}" in plan for v in ("text", "lower(text")) and plan.count("Contains(") >= 2 * len(hygiene.STEERING) + 5
