"""Leaves, levels, proofs and tampered folds against plain hashing."""

import hashlib
import zlib

from caselake.llm import merkle
from caselake.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(hashes):
    """Root of neighbours, and for each its siblings level by level."""
    above, place, now = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(now) > 1:
        for k in range(len(hashes)):
            run = place[k] // 16
            above[k].append((place[k] % 16, now[run * 16 : run * 16 + 16]))
            place[k] = run
        now = [sha(*now[i : i + 16]) for i in range(0, len(now), 16)]
    return now[0], above


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        made[s] = (own, *climb([leaf(*r) for r in own]))
    root, tops = climb([made[s][1] for s in order])
    out = []
    for s, top in zip(order, tops):
        own, subroot, above = made[s]
        for r, path in zip(own, above):
            path = path + top
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            fold = leaf(r[0], "".join(c.lower() if c.isascii() else c for c in r[1]), *r[2:]) if bad else leaf(*r)
            for k, run in path:
                fold = sha(*run[:k], fold, *run[k + 1 :])
            proof = sha(*[h for k, run in path for i, h in enumerate(run) if i != k])
            out.append((str(r[0]), leaf(*r), subroot, root, proof, fold, fold == root))
    return sorted(out)


def found(spark, rows, schema=SCHEMA, more=()):
    scratch = Scratch(spark)
    df = spark.createDataFrame(rows, schema).selectExpr("*", *more)
    x = merkle.proofs(merkle.build(df, scratch), scratch).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((str(r[0]), *r[1:]) for r in x.collect())


def made():
    rows = [(k, f"Text {k % 7} ÄB", "en", "hot", 9) for k in range(700)] + [(k, "Same", None, f"s{k % 40:02d}", None) for k in range(60)]
    rows += [(None, "No id", "en", "hot", 1), (5, None, None, None, None), (5, None, None, None, None), (3, "", "", "", 0), (-4, "Lone", "de", "é", 4)]
    return rows + [(1, "X" * 50_000, "en", "hot", 50_000)] + rows[:3]


def test_proofs_equal_plain_hashing(spark):
    want = plain(made())
    assert found(spark, made()) == want
    assert {r[-1] for r in want} == {True, False}


def test_hot_nodes_are_copied(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SALT_RUNS", 3)
    monkeypatch.setattr(merkle, "CLIMB", merkle.CLIMB.replace("div 4096", "div 3"))
    assert found(spark, made()) == plain(made())


def test_one_document_empty_table_and_clashing_names(spark):
    assert found(spark, [(1, "A", "en", "s", 1)]) == plain([(1, "A", "en", "s", 1)])
    assert found(spark, []) == []
    more = ["1 AS leaf", "'x' AS root", "map('k', 1) AS run", "3 AS src", "4 AS tie", "5 AS p"]
    assert found(spark, made()[690:720], more=more) == plain(made()[690:720])
