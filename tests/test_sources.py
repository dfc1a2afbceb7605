"""Feeds read and written on small fixtures."""

import pytest

from caselake.sources import files


def test_feeds(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,amount\n1,2.5\nx,3\n")
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), "id int, amount double").collect()
    assert [(r.id, r._bad) for r in rows] == [(1, None), (None, "x,3")]
    (tmp_path / "a.json").write_text('{"id": 1}\nnot json\n')
    assert [(r.id, r._bad) for r in files.read_json(spark, str(tmp_path / "a.json"), "id int").collect()] == [(1, None), (None, "not json")]


def test_pages_and_sections(spark, tmp_path):
    (tmp_path / "p.md").write_text("---\nid: POL-1\ntitle: Refunds\nstatus: approved\n---\nIntro\n\n## When\nAlways.\n\n## How\nSlowly.\n")
    (tmp_path / "q.md").write_text("# Plain page\ntext\n")
    pages = files.read_pages(spark, str(tmp_path))
    got = {r.title: r for r in pages.collect()}
    assert got["Refunds"].meta["id"] == "POL-1" and got["Plain page"].meta == {}
    parts = [(r.heading, r.text) for r in files.split_sections(pages).filter("path LIKE '%p.md'").orderBy("position").collect()]
    assert parts == [("", "Intro"), ("When", "Always."), ("How", "Slowly.")]
    assert files.catalog(spark, str(tmp_path)).count() == 2


def test_upsert_and_log(spark, tmp_path):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b"), (None, 1, "n")], "k int, at int, v string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 4, "d"), (3, 1, "e"), (3, 1, "f")], "k int, at int, v string")
    assert sorted(files.upserted(old, new, "k", "at").collect(), key=str) == sorted([(1, 2, "c"), (2, 5, "b"), (3, 1, "f"), (None, 1, "n")], key=str)
    log = f"{tmp_path}/log"
    files.append_audit(spark.createDataFrame([(1, "x"), (2, "y")], "seq long, e string"), log)
    with pytest.raises(ValueError):
        files.append_audit(spark.createDataFrame([(2, "z")], "seq long, e string"), log)
    files.append_audit(spark.createDataFrame([(3, "z")], "seq long, e string"), log)
    assert spark.read.parquet(log).count() == 3


def test_numbers_follow_the_order(spark):
    got = files.numbered(spark.createDataFrame([(k * 7 % 100,) for k in range(100)], "at int"), "at", ranges=4).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["at"])] == [f"CASE-{k + 1:06d}" for k in range(100)]


def test_numbers_of_many_rows_differ_and_stay_whole(spark):
    df = spark.range(300_000).selectExpr("cast(id % 1000 as int) AS at", "id AS v", "'x' AS id", "1 AS p", "2 AS o")
    x = files.numbered(df, "at", start=900_000).selectExpr("at", "cast(substring(id, 6) as long) AS n", "length(id) AS l")
    assert x.agg({"n": "min"}).first()[0] == 900_000 and x.agg({"n": "max"}).first()[0] == 1_199_999
    assert x.select("n").distinct().count() == 300_000 and {r.l for r in x.select("l").distinct().collect()} == {11, 12}
    assert x.groupBy("at").agg({"n": "max"}).selectExpr("at", "`max(n)` AS m").join(x.groupBy("at").agg({"n": "min"}).selectExpr("at + -1 AS at", "`min(n)` AS next"), "at").filter("m >= next").isEmpty()
    assert files.numbered(df.limit(0), "at").collect() == []


def test_two_writers_of_one_log(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    log = f"{tmp_path}/log"

    def add(rows):
        try:
            files.append_audit(spark.createDataFrame(rows, "seq long, e string"), log)
            return True
        except ValueError:
            return False

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(add, [[(1, w), (2, w)] for w in "abcd"]))
    assert got.count(True) == 1 and files.read_audit(spark, log).count() == 2
    assert not add([]) and not add([(5, "x"), (5, "y")]) and not add([(None, "x")]) and add([(5, "x")]) and not add([(4, "x")])
    # a writer that stopped between its claim and its move
    spark.createDataFrame([(9, "z")], "seq long, e string").write.parquet(f"{log}/_staged/left")
    assert files._Log(spark, log).claim(2, {"low": 9, "high": 9, "n": 1, "folder": "left"})
    assert sorted(r.seq for r in files.read_audit(spark, log).collect()) == [1, 2, 5, 9]
