"""Frequent topics are taken from items as rows: words are not dealt as rows of their own, and any list length gives the same."""

import pytest
from test_topics import greedy, made

from caselake.operators import topics


@pytest.mark.parametrize("candidates,most_left", [(1, 1.0), (1, 0.0)])
def test_short_lists_and_the_rest_give_the_same(spark, monkeypatch, candidates, most_left):
    monkeypatch.setattr(topics, "FEW", 0)
    monkeypatch.setattr(topics, "CANDIDATES", candidates)
    monkeypatch.setattr(topics, "MOST_LEFT", most_left)
    rows = made(120)
    corpus = [r[2] for r in made(50)]
    got = topics.topic_clusters(spark.createDataFrame(rows, "request_type string, ref long, text string"), spark.createDataFrame([(t,) for t in corpus], "text string"), 5)
    assert {(r.request_type, r.topic): (r.place, r.n, r.first_ref) for r in got.collect()} == greedy(rows, corpus, 5)


def test_no_round_writes_a_row_for_each_word(spark, monkeypatch):
    written, sizes = topics.written, []

    def counted(df, name):
        out = written(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(topics, "written", counted)
    monkeypatch.setattr(topics, "FEW", 0, raising=False)
    rows = [("a", k, " ".join(f"word{(k + j) % 60}x" for j in range(40))) for k in range(200)]
    got = topics.topic_clusters(spark.createDataFrame(rows, "request_type string, ref long, text string"), spark.createDataFrame([(r[2],) for r in rows], "text string"), 5)
    assert sum(r.n for r in got.collect()) == 200
    assert max(sizes) <= 200
