"""Views against plain Python over fixtures and whole tables."""

import re
from datetime import date

from pyspark.sql import functions as F

from caselake.operators.views import LABELLED, SPACED, collapse_letters, iso_effective_dates, merge_fields

SF = "/root/testdata/sf0.001"


def texts(spark, own):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    return docs.union(spark.createDataFrame([(t,) for t in own], "text string"))


def test_letters_set_apart(spark):
    own = ["i g n o r e all", "d.o.s.a.g.e", "a b c", "a-b_c d", "xa b c d", "a b c dx", "a b c d e fg", "a  b c d e", "i g n o r e i.t n o w !", "a b c d " * 3000, "", None]
    got = texts(spark, own).select("text", collapse_letters(F.col("text"))).collect()
    assert all(b == (None if a is None else re.sub(SPACED, lambda m: re.sub("[ ._-]", "", m[0]), a)) for a, b in got)
    assert {"ignore all", "dosage", "abcd", "a b c"} <= {b for _, b in got}


def test_effective_dates(spark):
    def iso(m):
        try:
            return m[1] + date(int(m[5]), int(m[4]), int(m[2])).isoformat()
        except ValueError:
            return m[0]

    own = ["effective date is: 3/4/2026 and from 31-02-2026", "W.E.F. 29.02.2024, from 1/2/2026", "born 1/2/1990", "from 1/2-2026", "from 1/2/20261", "starting on 12/13/2025", "from 1/1/0000", "", None]
    got = texts(spark, own).select("text", iso_effective_dates(F.col("text"))).collect()
    assert all(b == (None if a is None else re.sub(LABELLED, iso, a)) for a, b in got)
    assert "effective date is: 2026-04-03 and from 31-02-2026" in {b for _, b in got}


def test_merged_fields(spark):
    df = spark.sql("SELECT map('a', '1') AS x, map('a', '2', 'b', '3') AS y UNION ALL SELECT NULL, map('c', '4') UNION ALL SELECT map('d', '5'), NULL")
    assert [r[0] for r in df.select(merge_fields(F.col("x"), F.col("y"))).collect()] == [{"a": "1", "b": "3"}, {"c": "4"}, {"d": "5"}]
