"""The conversation trie against a plain one, over shards so small that several rounds are needed."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from caselake.llm import trie
from caselake.llm.common import Scratch

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Nodes of (conv_id, turn, role, text) by the contract, one dictionary of prefixes."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((t is not None, t or 0), hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - int(np.fmod(c, 5))
        whole[c] = tuple(own.get(first, [])[:h] + v[h:])
    members = {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def nodes(spark, rows, steps):
    found = trie.prefix_trie(trie.rebuilt(spark.createDataFrame(rows, SCHEMA)), Scratch(spark), steps)
    return sorted(map(tuple, found.collect()))


def made(n, seed=1):
    """Conversations that share beginnings: a hot first turn, copies, ties, nulls, one long one, families without a first."""
    rng, rows = random.Random(seed), []
    for c in range(-20, n):
        if rng.random() < 0.1:
            continue
        copy = rng.random() < 0.3
        for t in range(rng.choice([1, 2, 3, 8, 9, 12]) if c != 7 else 300):
            text = f"same {t}" if copy or t == 0 else rng.choice(["a", "b", "ü" * 5, "", None])
            rows.append((c, None if t == 1 else t, rng.choice(["user", None]) if not copy else "user", text))
    return rows + [rows[3], (None, 1, "user", "nobody's"), (10**12, 0, None, None)]


@pytest.mark.parametrize("steps", [40, 400, 10**6])
def test_nodes_equal_a_plain_trie(spark, steps):
    rows = made(400)
    assert nodes(spark, rows, steps) == plain(rows)


def test_many_copies_and_turnless(spark):
    # nine of ten conversations take nothing of their own: fewer turns than they give up, and no first of the family
    rows = [(c, 0, "user", "x") for c in range(1, 9000) if c % 5]
    want = plain(rows)
    assert nodes(spark, rows, 20_000) == want and want[0][1] == 0 and len(want) == 2


def test_empty_table_and_clashing_names(spark):
    assert nodes(spark, [], 100) == []
    df = spark.createDataFrame([(1, 0, "user", "a")], SCHEMA).selectExpr("*", "1 AS seq", "'x' AS path", "2 AS n", "map('a', 1) AS step")
    assert len(trie.prefix_trie(trie.rebuilt(df), Scratch(spark)).collect()) == len(plain([(1, 0, "user", "a")]))


def test_double_array_holds_branches_of_far_steps():
    rng = np.random.default_rng(4)
    made = sorted({tuple(rng.integers(0, 500, rng.integers(1, 6)).tolist()) for _ in range(2000)})
    steps = [np.array(s) for s in made]
    shard = trie.pack(steps)
    seen = {}
    for s, cells in zip(made, shard.cells):
        for d, c in enumerate(cells.tolist()):
            assert seen.setdefault(c, s[:d]) == s[:d]
            if d:
                assert shard.check[c] == cells[d - 1] and c == shard.base[cells[d - 1]] + s[d - 1]
    assert len(seen) == len({s[:d] for s in made for d in range(len(s) + 1)})
