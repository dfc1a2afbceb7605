"""Recall of the hashed tables at the threshold, also for vectors with a large mean."""

import numpy as np
import pytest

from caselake.llm import itq


@pytest.mark.parametrize("cosine", [0.0, 0.5, 0.8])
def test_recall_at_the_threshold(cosine):
    rng = np.random.default_rng(8)

    def draw(n):
        x = rng.standard_normal((n, 64)) * np.sqrt((1 - cosine) / 64)
        x[:, 0] += np.sqrt(cosine)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    bits, tables, radius, mean, turn = itq.plan(draw(4096), 100_000)
    a = draw(3000)
    u = draw(3000) - draw(3000)
    u -= (u * a).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    one, two = (itq.signs(x, bits, tables, mean, turn) for x in (a, b))
    meet = (itq.numbers(one, bits, tables) == itq.numbers(two, bits, tables)).any(axis=1)
    found = (meet & ((one != two).sum(axis=1) <= radius)).mean()
    print(cosine, bits, tables, found)
    assert bits >= 6 and found >= 0.985


def test_pairs_within_a_radius_meet_brute_force():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 16, (90, 2)).astype(np.uint64)
    stop = np.repeat([1, 30, 32, 90], [1, 29, 2, 58])
    radius = np.where(np.arange(90) < 30, 2, 3)
    got = {(int(a), int(b)) for i, j in itq.pairs_within(words, stop, radius) for a, b in zip(i, j)}
    want = {(a, b) for a in range(90) for b in range(a + 1, int(stop[a])) if sum((int(x) ^ int(y)).bit_count() for x, y in zip(words[a], words[b])) <= radius[a]}
    assert got == want and want


def test_links_equal_brute_force_over_float_vectors_of_two_lengths(spark):
    """Float and long chains of near copies, two lengths in one label, a bucket of more than one part."""
    from caselake.llm.common import Scratch

    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 24))
    rows = [(k, int(k % 3), (base[k % 40] + 0.12 * rng.standard_normal(24)).astype(np.float32).tolist()) for k in range(1600)]
    rows += [(2000 + k, 0, rng.standard_normal(5).astype(np.float32).tolist()) for k in range(30)]
    found = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), Scratch(spark))
    got = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}
    links, root = {k: 0 for k, *_ in rows}, {k: k for k, *_ in rows}
    groups = {}
    for k, label, v in rows:
        groups.setdefault((label, len(v)), []).append((k, np.array(v) / np.linalg.norm(np.array(v))))
    for group in groups.values():
        ids, v = [k for k, _ in group], np.array([x for _, x in group])
        near = v @ v.T >= 0.93
        for a, row in enumerate(near):
            links[ids[a]] = int(row.sum()) - 1
        reach = near.copy()
        while ((wider := reach @ near) != reach).any():
            reach = wider
        for a, row in enumerate(reach):
            root[ids[a]] = min(ids[b] for b in np.flatnonzero(row))
    wrong = [k for k in got if got[k] != (links[k], root[k])]
    assert sum(got[k][0] for k in got) >= 0.99 * sum(links.values()) and len(wrong) <= 0.02 * len(rows)
