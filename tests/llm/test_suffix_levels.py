"""Many texts of one id, batches that outgrow the first one, and many hot heads, against a plain scan."""

import random

import numpy as np

from caselake.llm import sarray
from caselake.llm.common import Scratch


def plain(rows, length=50):
    """Removed bytes of each (id, text): windows that also start in a text with a smaller id."""
    seen, out = {}, []
    for d, t in rows:
        data = t.encode()
        for k in range(len(data) - length + 1):
            w = data[k : k + length]
            seen[w] = min(seen.get(w, d), d)
    for d, t in rows:
        data = t.encode()
        gone = set()
        for k in range(len(data) - length + 1):
            if seen[data[k : k + length]] < d:
                gone.update(range(k, k + length))
        out.append((d, len(data), len(gone)))
    return sorted(out)


def cut(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    x = sarray.cut_repeats(df, Scratch(spark), sarray.digest, sarray.DIGEST)
    return sorted((r.doc_id, r.n_bytes, r.n_removed) for r in x.collect())


def test_thousands_of_texts_with_one_id(spark):
    rng = random.Random(1)
    passage = "".join(rng.choices("abcdefghij ", k=64))
    rows = [(1, passage)] + [(5, "".join(rng.choices("klmnopq ", k=70)) + (passage if k % 2 else "")) for k in range(2300)]
    got = cut(spark, rows)
    assert sum(n for _, _, n in got) == 1150 * 64 and got == plain(rows)


def test_a_larger_batch_deals_the_levels_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sarray, "PART_BYTES", 2000)
    rng = random.Random(2)
    passages = ["".join(rng.choices("abcdefghij ", k=80)) for _ in range(12)]
    rows = [(d, "".join(rng.choices("klmnopqrst ", k=rng.randrange(0, 200))) + rng.choice(passages)) for d in range(150)]
    family = sarray.SuffixFamily(spark, str(tmp_path))
    removed, parts = {}, []
    for low, high in ((0, 5), (5, 12), (12, 60), (60, 150)):
        got = family.add(spark.createDataFrame([r for r in rows if low <= r[0] < high], "doc_id long, text string"))
        parts.append(family.parts)
        for r in got[1].collect():
            removed[r.doc] = sum(b - a for a, b in sarray.merged_spans(*(np.array([x[k] for x in r.covered]) for k in ("place", "mask")), 0))
    assert parts[0] < parts[-1]
    assert {d: n for d, _, n in plain(rows) if n} == {d: n for d, n in removed.items() if n}


def test_many_hot_heads(spark, monkeypatch):
    monkeypatch.setattr(sarray, "HOT", 3)
    rng = random.Random(3)
    starts = ["".join(rng.choices("abcdef ", k=60)) for _ in range(20)]
    rows = [(d, rng.choice(starts)[: rng.randrange(40, 60)] + "".join(rng.choices("xyz ", k=60))) for d in range(300)]
    assert cut(spark, rows) == plain(rows)
