"""Topics taken many at a time against a greedy cover that takes one word at a time."""

import math
import random
from collections import Counter

from caselake.operators import topics

WORDS = [f"word{k}x" for k in range(30)]


def greedy(items, corpus, least):
    df = Counter(t for text in corpus for t in set((text or "").split()))
    n, out = max(1, len(corpus)), {}
    for kind in {i[0] for i in items}:
        left = {}
        for k, ref, text in items:
            if k == kind and ref is not None:
                left.setdefault(ref, set()).update((text or "").split())
        place = 0
        while True:
            c = Counter(t for w in left.values() for t in w)
            known = [(round(v * math.log((n + 1) / (df[t] + 1)), 9), t) for t, v in c.items() if v >= least]
            if not known:
                break
            place, topic = place + 1, max(known)[1]
            refs = sorted(r for r, w in left.items() if topic in w)
            out[kind, topic] = (place, len(refs), refs[0])
            for r in refs:
                del left[r]
    return out


def made(n=400):
    rng = random.Random(5)
    weights = [1 / (k + 1) for k in range(len(WORDS))]
    rows = [(rng.choice(["a", "b", None]), k, " ".join(rng.choices(WORDS, weights, k=rng.randrange(0, 5)))) for k in range(n)]
    return rows + [rows[0], ("a", 1, "word29x"), ("a", None, "word1x"), ("b", 5000, None), ("c", 5001, "word2x")]


def test_rounds_equal_one_word_at_a_time(spark):
    rows = made()
    corpus = [r[2] for r in made(150)]
    items = spark.createDataFrame(rows, "request_type string, ref long, text string").selectExpr("*", "1 AS token", "2 AS type", "map('a', 1) AS b")
    got = topics.topic_clusters(items, spark.createDataFrame([(t,) for t in corpus], "text string"), 5)
    assert {(r.request_type, r.topic): (r.place, r.n, r.first_ref) for r in got.collect()} == greedy(rows, corpus, 5)


def test_empty_items_and_empty_corpus(spark):
    none = spark.createDataFrame([], "request_type string, ref long, text string")
    assert topics.topic_clusters(none, none).collect() == []
    rows = [("a", k, "word1x word2x") for k in range(5)]
    got = topics.topic_clusters(spark.createDataFrame(rows, none.schema), none.select("text")).collect()
    assert [(r.topic, r.n) for r in got] == [("word2x", 5)]


def test_hotspot_takes_the_rare_word_and_names_drafts(spark):
    rows = [("enrolment", k, f"provider telehealth case{k}") for k in range(8)] + [("enrolment", 20 + k, f"provider visit{k}") for k in range(3)]
    corpus = [("provider office",)] * 20 + [("telehealth",)]
    drafts = spark.createDataFrame([(1, "Telehealth visits"), (2, "Other things"), (3, None)], "page_id long, text string")
    got = topics.hotspots(spark.createDataFrame(rows, "request_type string, ref long, text string"), spark.createDataFrame(corpus, "text string"), drafts).collect()
    assert [(r.severity, r.code, r.topic, r.n, r.n_drafts) for r in got] == [("warning", "ESCALATION_HOTSPOT", "telehealth", 8, 1)]


def test_gap_radar_rows_by_hand(spark):
    schema = "case_id long, request_type string, text string, reasons array<string>, is_open boolean, hours double"
    rows = [(1, "a", "parking permits", ["POLICY_GAP"], True, 10.0), (2, "a", "parking tickets", ["POLICY_GAP", "SENSITIVE"], False, 99.0), (3, "a", "holiday", ["POLICY_GAP"], False, 5.0),
            (4, "b", None, ["MISSING_INFO"], True, 20.0), (5, "b", "x", None, True, None), (6, None, "y", ["MISSING_INFO"], True, 30.0)]
    got = {(r.request_type, r.reason_code, r.topic): (r.n, r.avg_hours_in_queue, r.est_hours_saved) for r in topics.gap_radar(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("a", "POLICY_GAP", "park"): (2, 10.0, 20.0), ("a", "POLICY_GAP", "other"): (1, 20.0, 20.0), ("b", "MISSING_INFO", ""): (1, 20.0, 20.0), ("unknown", "MISSING_INFO", ""): (1, 30.0, 30.0)}
    assert topics.gap_radar(spark.createDataFrame([], schema)).collect() == []
