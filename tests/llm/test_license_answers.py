"""License scans: answers for versions, expressions and nested matches; base counts against a plain search."""

import re

from caselake.llm import license


def labels(text):
    return {r.label for _, _, r in license.detect(text.encode(), license.rules())}


def test_versions_expressions_and_nesting():
    assert labels("CC BY-NC-SA 4.0") == {"cc-by-nc", "cc-by-nc-sa"}
    assert labels("GNU General Public License v3.0") == labels("the GNU General Public License version 3") == {"gpl-3"}
    assert labels("SPDX: MIT OR Apache-2.0") == {"mit", "apache-2"}
    assert labels("SPDX-License-Identifier: GPL-2.0-only AND MIT") == {"gpl-2", "mit"}
    assert labels('BSD 3-Clause "New" License') == {"bsd-3-clause"}
    assert labels("the gel likes music") == set()


def test_long_text_of_one_phrase():
    text = ("under the MIT license\n" * 20000).encode()
    found = license.detect(text, license.rules())
    assert sum(not r.priority for _, _, r in found) == 20000


def test_base_places_against_plain_search(spark):
    texts = ["Under\nthe MIT-license. under the mit license", "cc by nc cc by nc nd", "Apache License, Version 2.0", "", None, "é under the mit licenseé", "mit"]
    got = {r.doc_id: r for r in license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().lower())
        want = [(i, label) for phrase, label in license.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.encode().split()]
        base = [(d.first, d.label) for d in got[k].detections if not d.priority]
        assert (got[k].n_words, sorted(base)) == (len(words), sorted(want)), t
