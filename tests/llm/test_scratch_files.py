"""Scratch tables and stages of few rows are few files, however many partitions a shuffle has."""

from pathlib import Path

import corpus_pipeline as cp
import pytest
from caselake.llm import common
from caselake.llm.common import Scratch, connected_components

PARTITIONS = 60


@pytest.fixture
def many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rounds_of_components(spark, many_partitions, monkeypatch):
    edges = spark.range(400).selectExpr("id AS a", "id + 1 AS b").filter("a % 20 < 19")
    scratch = Scratch(spark)
    got = connected_components(edges, scratch, files=2)
    assert {(r.id, r.component) for r in got.collect()} == {(i, i - i % 20) for i in range(400)}
    assert all(len(list(p.glob("part-*"))) <= 2 for p in Path(scratch.root.removeprefix("file:")).iterdir())
    # more edges are more files
    monkeypatch.setattr(common, "FILE_EDGES", 40)
    scratch = Scratch(spark)
    assert {(r.id, r.component) for r in connected_components(edges, scratch).collect()} == {(i, i - i % 20) for i in range(400)}
    assert sum(len(list(p.glob("part-*"))) for p in Path(scratch.root.removeprefix("file:")).iterdir()) > 5


def test_stages_of_few_documents(spark, many_partitions):
    texts = [" ".join(f"w{g}x{k}" for k in range(60)) + f" v{i}" for i in range(20) for g in range(3)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    near = cp.near_duplicates(spark, docs, "")
    assert near.rdd.getNumPartitions() == 1 and sorted(r.doc_id for r in near.select("doc_id").collect()) == [0, 1, 2]
    root = Path(cp._LEFT[spark.sparkContext.applicationId, "ngram_jaccard"][-1].root.removeprefix("file:"))
    files = {p.name: len(list(p.glob("part-*"))) for p in root.iterdir() if p.name not in ("about", "counts")}
    assert len(files) >= 5 and max(files.values()) == 1, files
