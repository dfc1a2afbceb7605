"""Base finds against a plain scan, the Markov chains against held-out strings."""

import random
import re
import string

import numpy as np
import pytest

from caselake.llm import secrets

SF = "/root/testdata/sf0.001"


def plain(text):
    """The contract's base by hand: each kind alone, left to right, failing matches dropped but not searched again."""
    out, text = [], text or ""
    word = re.compile("(?i:password|passwd|secret|token|api_?key)", re.ASCII)
    at = 0
    while m := word.search(text, at):
        k = m.end()
        k += text[k : k + 1] in ("'", '"') and text[k : k + 1] != ""
        while text[k : k + 1] == " ":
            k += 1
        if text[k : k + 1] not in (":", "=") or not text[k : k + 1]:
            at = m.start() + 1
            continue
        k += 1
        while text[k : k + 1] == " ":
            k += 1
        k += text[k : k + 1] in ("'", '"') and text[k : k + 1] != ""
        end = k
        while text[end : end + 1] and text[end] in string.ascii_letters + string.digits + "+/_.=-":
            end += 1
        if end == k:
            at = m.start() + 1
            continue
        if end - k >= 12:
            out.append((m.start(), 0, end))
        at = end
    for kind, first, chars, least in ((1, "AKIA", string.ascii_uppercase + string.digits, 18), (2, "", "0123456789abcdef", 16)):
        at = 0
        while at < len(text):
            if text.startswith(first, at) and (first or text[at] in chars):
                end = at + len(first)
                while end < len(text) and text[end] in chars:
                    end += 1
                if end > at + len(first):
                    if end - at >= least:
                        out.append((at, kind, end))
                    at = end
                    continue
            at += 1
    return sorted(out)


CASES = ['token = "04dbebab91ab85687d33eeaaf9ac699e"', "PASSWORD:hunter2", "api_key=ABCDEFGHIJKL", "apikey : 'abc.def/ghi+jkl='", "tokentoken=abcdefghijklm", "secret==============x", "AKIAABCDEFGHIJKLMN", "AKIAAKIAABCDEFGHIJ", "xAKIA0123456789ABCD9",
         "ſecret=abcdefghijklmno", "toKen=abcdefghijklmno", "0123456789abcdef0", "0123456789ABCDEF", "é" * 40 + " token: " + "a" * 13, "", None, "secret \n= abcdefghijklmn", "passwd" + " " * 50_000, "password=" + "x" * 100_000, "token='\"abcdefghijklmnop", "api__key=abcdefghijklmnop"]


def test_base_equals_a_plain_scan(spark):
    rng = random.Random(3)
    pieces = ["token", "Secret", "=", ":", " ", '"', "AKIA", "0f1e2d3c", "ABCD1234", "x", "é", "\n", "pass", "word", ".-"]
    texts = CASES + ["".join(rng.choices(pieces, k=60)) for _ in range(500)]
    for t in texts:
        assert (secrets.base_spans(t) if t else []) == plain(t), t
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in secrets.op13_secret_scan(spark, SF).collect()}
    for r in docs.collect():
        want = plain(r.text)
        spans = [s for s in got[r.doc_id].spans.split(",") if s and not s.startswith("random")]
        assert spans == [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want]
        assert [got[r.doc_id][f"n_{k}"] for k in secrets.KINDS[:3]] == [sum(x[1] == i for x in want) for i in range(3)]


@pytest.fixture(scope="module")
def ratios(spark):
    docs = spark.createDataFrame([(f"The customer account manager updated the payment record number {k} for the northern region office while reviewing delivery schedule documents, and wrote a note about abstract factory builder classes, retry connections, maximum size values and user names.",) for k in range(50)], "text string")
    return secrets.learn(docs)


def test_held_out_random_strings_and_identifiers(ratios):
    rng = random.Random(9)
    alphabets = (string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits)
    hits = [secrets.score("".join(rng.choices(a, k=rng.randrange(20, 40))), ratios) >= secrets.THRESHOLD for a in alphabets for _ in range(500)]
    assert np.mean(hits) >= 0.95
    words = "customer account manager payment record number northern region office delivery schedule documents user names".split()
    made = [f(rng.sample(words, 3)) for f in ("_".join, "-".join, "/".join, lambda w: "_".join(w).upper(), lambda w: w[0] + "".join(x.capitalize() for x in w[1:])) for _ in range(200)]
    assert np.mean([secrets.score(w, ratios) >= secrets.THRESHOLD for w in made]) <= 0.01


def test_nulls_ties_long_texts_repeats_and_clashing_names(spark, ratios):
    value = "gH7xQ2pL9sVt4KzR8wNb"
    rows = [(1, f"see {value} there"), (1, f"see {value} there"), (2, None), (None, ""), (3, "token=" + value), (4, "word " * 200_000 + value), (5, "-" * 100 + "=" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS id", "map('a', 1) AS kind")
    got = sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in secrets.find_secrets(df, ratios).collect()), key=str)
    assert got == sorted([(1, [("random", 4, 24)]), (1, [("random", 4, 24)]), (2, []), (None, []), (3, [("assign", 0, 26)]), (4, [("random", 1_000_000, 1_000_020)]), (5, [])], key=str)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.find_secrets(none, secrets.learn(none)).collect() == []
