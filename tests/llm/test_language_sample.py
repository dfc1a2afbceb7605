"""The dictionary sample of a language that is mostly copies of a few texts."""

from caselake.llm import langid


def test_copied_language_is_learned(spark):
    rows = [(f"wort{k} und noch ein satz der sprache nummer {k}", "de") for k in range(3) for _ in range(2000)]
    rows += [(f"word{k} and another sentence of this language number {k * k}", "en") for k in range(300)]
    known = langid.learn(spark.createDataFrame(rows, "text string, lang string"), sample_docs=4)
    assert set(known) == {"de", "en"} and all(f"wort{k}".encode() in known["de"] for k in range(3))
    once = langid.learn(spark.createDataFrame(sorted(set(rows)), "text string, lang string"), sample_docs=4)
    assert once == known
