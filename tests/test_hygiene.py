"""Checksums and normal forms on small fixtures."""

import unicodedata

from pyspark.sql import functions as F

from caselake.operators.hygiene import normalize_text, verhoeff_digit, verhoeff_valid


def test_verhoeff(spark):
    df = spark.createDataFrame([("236",), ("12345",), ("",), ("12a",), (None,)], "d string")
    assert [r[0] for r in df.select(verhoeff_digit(F.col("d"))).collect()] == [3, 1, None, None, None]
    df = spark.createDataFrame([("2363",), ("2364",), ("123451",), ("213451",), (None,)], "d string")
    assert [r[0] for r in df.select(verhoeff_valid(F.col("d"))).collect()] == [True, False, True, False, False]


def test_normal_form(spark):
    texts = ["plain\ttext\r\n", "a\u200bb\u00adc\x00d", "\uff21\uff22\u2460 \ufb01", "\u0430\u0415 \u03bf\u0393", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(normalize_text(F.col("t"))).collect()]
    assert got == ["plain\ttext\r\n", "abcd", unicodedata.normalize("NFKC", texts[2]), "aE oG", "", None]
