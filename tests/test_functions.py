"""SQL functions equal the column functions."""

from pyspark.sql import functions as F

from caselake.functions import register
from caselake.operators.text import keyword_type, mask_shapes


def test_sql_functions(spark):
    register(spark)
    df = spark.createDataFrame([("mail a.b@example.org now?",), ("LOUD",), ("my password 1.2.3.4",), (None,)], "text string")
    for r in df.select(F.expr("caselake_mask(text)") == mask_shapes(F.col("text")), F.expr("caselake_type(text)") == keyword_type(F.col("text"))).collect():
        assert r[0] in (True, None) and r[1] is True
    assert spark.sql("SELECT caselake_nfkc('ﬁ')").first()[0] == "fi"
