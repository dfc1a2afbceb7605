"""Captions and text of malformed figures, and whole pages."""

import re

import pytest

from caselake.llm import media


def read(html):
    return [(i["kind"], i["text"] or i["digest"], i["caption"]) for i in media.read_items(html)]


IMG = '<img src="media:sha256/ab" alt="alt">'


@pytest.mark.parametrize(("html", "want"), [
    (f"<figure>{IMG}<figcaption>cap</figure><p>more</p>tail", [("media", "ab", "cap"), ("text", "more", None), ("text", "tail", None)]),
    (f"<figure><figcaption>cap</figcaption>{IMG}</figure>", [("media", "ab", "cap")]),
    (f"<figure>{IMG}<figcaption>one<figure>{IMG}<figcaption>two", [("media", "ab", "one"), ("media", "ab", "two")]),
    ("a<figure><pre>code</pre><figcaption>cap</figcaption></figure>b", [("text", "a", None), ("text", "code", None), ("text", "cap", None), ("text", "b", None)]),
    ("<figcaption>alone</figcaption>b", [("text", "alone", None), ("text", "b", None)]),
    (f"<figure>{IMG}{IMG}<figcaption><p>x</p><p>y</p></figcaption></figure>{IMG}", [("media", "ab", "x y"), ("media", "ab", "x y"), ("media", "ab", "alt")]),
    (f"<figure>{IMG}<figcaption></figcaption></figure>", [("media", "ab", "alt")]),
])
def test_figures(html, want):
    assert read(html) == want


def test_pages_keep_their_words(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in media.interleave(pages).collect():
        seen = " ".join(x for i in r["items"] for x in (i.text, i.caption) if x)
        bare = re.sub(r"(?is)<(script|style|template|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ", html[r.page_id] or "")
        assert set(re.findall(r"[A-Za-z]{4,}", bare)) <= set(re.findall(r"[A-Za-z]{4,}", seen)), r.page_id
