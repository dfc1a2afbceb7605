"""Notices whose words are parted by lines, comment markers or punctuation, with and without the prefilter."""

import pytest

from caselake.llm import license

PHRASES = [
    *(p.replace("(?:or )?", "").replace("(?:in|into|to)", "into").replace("(?:proprietary and confidential|confidential and proprietary)", "confidential and proprietary") for p, *_ in license.NOTICES),
    "licensed under the open software license", "licensed under the boost software license", "creative commons attribution share alike 4 0 international license", *(p for p, _ in license.BASE),
]


@pytest.mark.parametrize("between", [" ", "  ", "\n", "\n * ", "\n# ", "-", ",\r\n// "])
def test_prefilter_drops_nothing(monkeypatch, between):
    ordered = license.rules()
    got = [license.detect(between.join(p.upper().split()).encode(), ordered) for p in PHRASES]
    assert all(got)
    monkeypatch.setattr(license, "GATES", (b"",))
    bare = [r._replace(keywords=()) for r in ordered]
    plain = [license.detect(p.encode(), bare) for p in PHRASES]
    assert [[(a, z, r.label, r.confidence) for a, z, r in x] for x in got] == [[(a, z, r.label, r.confidence) for a, z, r in x] for x in plain]
