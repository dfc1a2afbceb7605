"""Prefix trie of conversations: double-array tries of sorted shards, whose shared upper nodes are merged in rounds.

A turn (role, text) becomes a step of 24 bytes: the md5 of both and the number of the text's bytes. A
conversation is the string of its steps, so prefixes of conversations are prefixes of strings. Equal
conversations are counted once with their members. The strings are dealt to ranges and sorted, and cut into
shards of about SHARD_STEPS steps; a shard that many conversations share a beginning with is cut like any other.

A shard numbers its different steps densely and packs the trie into BASE and CHECK arrays: the child of node s
over step t is BASE[s] + t where CHECK there is s. Walking the arrays gives each node its members and, from the
deepest up, its subtree's figures. Nodes on the shard's first and last path may go on in the neighbouring
shards: these two paths, with what the shard adds to each of their nodes, are the strings of the next round,
until one shard holds all. Then the smallest members of the paths' nodes go back to the rounds before, as the
parents of the nodes below them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, released, shuffle_partitions
from .merkle import crc32_sql

HEAD = 9  # the rebuilt conversations take up to HEAD - 1 turns from another one
FAMILY = 5
STEP = 24
SHARD_STEPS = 20_000
SHARD_PATHS = 16  # a shard holds as many at least, however long they are, so that rounds end
MEMBERS = 4096  # ids joined in one piece
NONE = hashlib.sha256(b"").hexdigest()
_FAR = np.iinfo(np.int64).max

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PATH = "path string, seq binary, n array<long>, low array<long>, kids array<long>, leaves array<long>, saved array<long>, ends array<string>"
#: kind 0: a node; 1: a node whose parent is on a path; 2: a path for the next round; 3: what a given path knows of its nodes.
OUT = f"kind int, {NODE}, {PATH}, above string"


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, seq) of every conversation of (conv_id, turn, role, text), its first turns taken from its family's first.

    Turns go by turn, nulls first, ties by the hash of role and text; null role or text is empty. Rows without a
    conv_id belong to no conversation and are left out. Other columns are left out too."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in ("role", "text"))
    size = F.octet_length(text).cast("long")
    step = F.concat(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")), F.lower(F.lpad(F.hex(size), 16, "0")))
    x = turns.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").alias("turn"), F.unhex(step).alias("step")).filter("conv_id IS NOT NULL")
    own = x.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "step"))).alias("t")).select("conv_id", F.col("t.step").alias("steps"))
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = own.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("first"), F.slice("steps", 1, HEAD - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    y = own.withColumn("first", first).withColumn("h", h).join(heads, "first", "left")
    steps = F.concat(F.slice(F.coalesce("head", F.expr("cast(array() as array<binary>)")), F.lit(1), F.col("h")), F.slice("steps", F.col("h") + 1, F.size("steps")))
    return y.select("conv_id", F.unhex(F.array_join(F.transform(steps, F.hex), "")).alias("seq"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, seq, n, low, ids) sorted by key and part: one path each key, with the hash of all its ids.

    A path of many members passes by in pieces; nothing but a hash is kept of them."""
    key, seq, n, low, digest = None, None, 0, 0, None

    def done():
        return {"path": None, "seq": seq, "n": [0] * (len(seq) // STEP) + [n], "low": [_FAR] * (len(seq) // STEP) + [low], "ends": [None] * (len(seq) // STEP) + [digest.hexdigest()]}

    rows, size = [], 0

    def batch():
        paths = pa.array([r["seq"] for r in rows], pa.binary())
        nothing = pa.array([[0] * len(r["n"]) for r in rows], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.string()), paths, pa.array([r["n"] for r in rows], pa.list_(pa.int64())), pa.array([r["low"] for r in rows], pa.list_(pa.int64())),
                                           nothing, nothing, nothing, pa.array([r["ends"] for r in rows], pa.list_(pa.string()))], ["path", "seq", "n", "low", "kids", "leaves", "saved", "ends"])

    for b in batches:
        for k, s, m, first, ids in zip(*(b.column(c).to_pylist() for c in ("key", "seq", "n", "low", "ids"))):
            if k != key:
                if key is not None:
                    rows.append(done())
                    size += len(rows[-1]["n"])
                    if size > SHARD_STEPS:
                        yield batch()
                        rows, size = [], 0
                key, seq, n, low, digest = k, s, 0, first, hashlib.sha256()
            elif n:
                digest.update(b",")
            digest.update(ids.encode())
            n, low = n + m, min(low, first)
    if key is not None:
        rows.append(done())
        yield batch()


def paths(conversations: DataFrame) -> DataFrame:
    """Different strings of (conv_id, seq) as paths: members, smallest member and hash of members at the last node."""
    part = F.expr(f"conv_id div {MEMBERS}")
    x = conversations.groupBy("seq", part.alias("part")).agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    x = x.withColumn("key", F.md5("seq"))
    return x.repartition(shuffle_partitions(x.sparkSession), "key").sortWithinPartitions("key", "part").mapInArrow(released(_ends), PATH)


class Shard(NamedTuple):
    base: np.ndarray
    check: np.ndarray
    cells: list[np.ndarray]  # for each path, its nodes' cells from the root on


def pack(steps: list[np.ndarray]) -> Shard:
    """The double-array trie of paths sorted by their strings; steps are dense numbers of the shard.

    The root is cell 0. A node with one child takes the next free cell; one with several takes the first place
    where all of its children's cells are free."""
    longest = max(map(len, steps))
    labels = 1 + max((int(s.max()) for s in steps if len(s)), default=0)
    nodes = 1 + sum(map(len, steps))
    base, check = np.zeros(nodes + 2 * labels + 1, np.int64), np.full(nodes + 2 * labels + 1, -1, np.int64)
    check[0] = 0
    free = 1  # no free cell lies before it
    lengths = np.array([len(s) for s in steps])
    at = np.zeros(len(steps), np.int64)
    cells = [np.zeros(len(s) + 1, np.int64) for s in steps]
    for d in range(longest):
        own = np.flatnonzero(lengths > d)
        parent, label = at[own], np.array([steps[k][d] for k in own])
        # sorted paths: equal nodes stand together
        new = np.ones(len(own), bool)
        new[1:] = (parent[1:] != parent[:-1]) | (label[1:] != label[:-1])
        p, l = parent[new], label[new]
        starts = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        counts = np.diff(np.append(starts, len(p)))
        single = starts[counts == 1]
        for s, c in zip(starts[counts > 1], counts[counts > 1]):
            kids = np.sort(l[s : s + c])
            span, room = int(kids[-1] - kids[0]) + 1, len(check)
            base, check = np.concatenate((base, np.zeros(span, np.int64))), np.concatenate((check, np.full(span, -1, np.int64)))
            # the cells just added are free, so there is a place
            cell = next(c for c in free + np.flatnonzero(check[free : room + 1] < 0) if (check[c - kids[0] + kids] < 0).all())
            base[p[s]] = cell - kids[0]
            check[cell - kids[0] + kids] = p[s]
            while check[free] >= 0:
                free += 1
        if len(single):
            places = free + np.flatnonzero(check[free:] < 0)[: len(single)]
            base[p[single]] = places - l[single]
            check[places] = p[single]
            free = int(places[-1]) + 1 if len(places) else free
        at[own] = base[parent] + label
        assert (check[at[own]] == parent).all()
        for k, c in zip(own, at[own]):
            cells[k][d + 1] = c
    return Shard(base, check, cells)


def dense(seqs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each string's steps as dense numbers, in the order in which they come by depth; and the bytes of each number's text."""
    every = [np.frombuffer(s, np.dtype((np.void, STEP))) for s in seqs]
    depth = np.concatenate([np.arange(len(e)) for e in every])
    flat = np.concatenate(every)
    _, first, number = np.unique(flat[np.argsort(depth, kind="stable")], return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first, kind="stable")] = np.arange(len(first))
    out = np.empty(len(flat), np.int64)
    out[np.argsort(depth, kind="stable")] = rank[number.reshape(-1)]
    size = np.zeros(len(first), np.int64)
    size[out] = flat.view(np.uint8).reshape(-1, STEP)[:, 16:].copy().view(">i8").reshape(-1)
    return np.split(out, np.cumsum([len(e) for e in every])[:-1]), size


def shard_nodes(rows: dict[str, list], name: str, last: bool) -> pa.RecordBatch:
    """Nodes and, unless it is the last, the two outer paths of a shard given as sorted paths."""
    seqs = rows["seq"]
    steps, size = dense(seqs)
    trie = pack(steps)
    cell = np.concatenate(trie.cells)
    depth = np.concatenate([np.arange(len(c)) for c in trie.cells])
    width = len(trie.check)
    n, kids, leaves, saved = (np.zeros(width, np.int64) for _ in range(4))
    low, level, text = np.full(width, _FAR), np.full(width, -1, np.int64), np.zeros(width, np.int64)
    level[cell] = depth
    for of, given in ((n, "n"), (kids, "kids"), (leaves, "leaves"), (saved, "saved")):
        np.add.at(of, cell, np.concatenate([np.asarray(v, np.int64) for v in rows[given]]))
    np.minimum.at(low, cell, np.concatenate([np.asarray(v, np.int64) for v in rows["low"]]))
    ends = {int(c): e for cs, es in zip(trie.cells, rows["ends"]) for c, e in zip(cs, es) if e is not None}
    text[np.concatenate([c[1:] for c in trie.cells])] = size[np.concatenate(steps)] if len(size) else 0
    outer = np.zeros(width, bool)
    if not last:
        outer[trie.cells[0]] = outer[trie.cells[-1]] = True
    used = np.flatnonzero(level >= 0)
    for d in range(int(level.max()), -1, -1):
        now = used[(level[used] == d) & ~outer[used]]
        leaves[now] += kids[now] == 0
        saved[now] += (n[now] - 1) * text[now]
        if d:
            up = trie.check[now]
            for of in (n, leaves, saved):
                np.add.at(of, up, of[now])
            np.add.at(kids, up, 1)
            np.minimum.at(low, up, low[now])
    whole = used[~outer[used]]
    up = trie.check[whole]
    hangs = outer[up] & (level[whole] > 0)
    # a node below a path: on the first one as far as its parent is there, else on the last
    first_path = set(trie.cells[0].tolist())
    side = [f"{name}/{0 if int(p) in first_path else 1}" if h else None for p, h in zip(up, hangs)]
    parents = np.where(level[whole] > 0, low[up], 0)
    columns: dict[str, list] = {
        "kind": np.where(hangs, 1, 0).tolist(), "conv_id": low[whole].tolist(), "depth": level[whole].tolist(),
        "parent_conv_id": [None if h or not d else p for h, d, p in zip(hangs, level[whole].tolist(), parents.tolist())], "n_convs": n[whole].tolist(), "n_children": kids[whole].tolist(),
        "n_leaves": leaves[whole].tolist(), "saved_tokens": saved[whole].tolist(), "ends_sha256": [ends.get(c, NONE) for c in whole.tolist()], "above": side,
    }
    more: list[dict] = []
    if not last:
        told: set[int] = set()
        for k, place in ((0, 0), (len(seqs) - 1, 1))[: min(2, len(seqs))]:
            own = trie.cells[k].tolist()
            fresh = [c not in told for c in own]

            def of(values, other, own=own, fresh=fresh):
                return [values[c] if f else other for c, f in zip(own, fresh)]

            more.append({"kind": 2, "path": f"{name}/{place}", "seq": seqs[k], "n": of(n, 0), "low": of(low, _FAR), "kids": of(kids, 0), "leaves": of(leaves, 0), "saved": of(saved, 0), "ends": [ends.get(c) if f else None for c, f in zip(own, fresh)]})
            told.update(own)
    if rows["path"][0] is not None:
        for path, own in zip(rows["path"], trie.cells):
            # the nodes on an outer path are known one round later
            inside = int(outer[own].sum())
            above = None if not inside else f"{name}/{0 if int(own[inside - 1]) in first_path else 1}"
            more.append({"kind": 3, "path": path, "low": low[own[inside:]].tolist(), "depth": inside, "above": above})
    total = len(whole) + len(more)
    schema = _arrow()
    arrays = [pa.array([*(columns.get(f.name) or [None] * len(whole)), *(m.get(f.name) for m in more)], f.type) for f in schema]
    assert all(len(a) == total for a in arrays)
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _arrow() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in OUT.split(", "))])


def _round(partitioned: DataFrame, last: bool, shard_steps: int) -> DataFrame:
    def run(batches):
        import pyspark

        part, number, held, size = pyspark.TaskContext.get().partitionId(), 0, {c.split()[0]: [] for c in PATH.split(", ")}, 0
        for b in batches:
            at = 0
            lengths = [len(s) // STEP for s in b.column("seq").to_pylist()]
            for k, length in enumerate(lengths):
                size += length + 1
                if not last and size >= shard_steps and len(held["seq"]) + k + 1 - at >= SHARD_PATHS:
                    for c, v in held.items():
                        v.extend(b.column(c).slice(at, k + 1 - at).to_pylist())
                    yield shard_nodes(held, f"{part}.{number}", last)
                    number, held, size, at = number + 1, {c: [] for c in held}, 0, k + 1
            for c, v in held.items():
                v.extend(b.column(c).slice(at).to_pylist())
        if held["seq"]:
            yield shard_nodes(held, f"{part}.{number}", last)

    return partitioned.sortWithinPartitions("seq").mapInArrow(released(run), OUT)


def prefix_trie(conversations: DataFrame, scratch: Scratch, shard_steps: int = SHARD_STEPS) -> DataFrame:
    """One row a node of the trie of (conv_id, seq): conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id is not null and each occurs once; an empty seq ends at the root. Without conversations there is no
    node. A conversation is held whole, 24 bytes a turn. conv_id and depth together name a node."""
    n_parts = shuffle_partitions(scratch.spark)
    now, k, made, before = scratch.save(paths(conversations), "paths0"), 0, [], None
    while True:
        steps, n = now.agg(F.coalesce(F.sum(F.length("seq") / STEP + 1), F.lit(0)), F.count("*")).first()
        # rounds shrink by SHARD_PATHS / 2 at least, unless more ranges are forced on the exchange than asked for
        last = steps <= shard_steps or n <= SHARD_PATHS or (before is not None and n > before / 2)
        before = n
        dealt = now.coalesce(1) if last else now.repartitionByRange(max(1, min(n_parts, int(steps // shard_steps) + 1, n // SHARD_PATHS + 1)), "seq")
        made.append(scratch.save(_round(dealt, last, shard_steps), f"round{k}"))
        if last:
            break
        now, k = made[-1].filter("kind = 2").select(*[c.split()[0] for c in PATH.split(", ")]), k + 1
    out, known = made[-1].filter("kind = 0"), made[-1].filter("kind = 3").select("path", "low")
    names = [c.split()[0] for c in NODE.split(", ")]
    out = out.select(*names)
    for r in reversed(range(k)):
        # known: every path of this round with the smallest members of all its nodes
        below = made[r].filter("kind = 1").drop("parent_conv_id", "path", "low").join(known, F.col("above") == F.col("path")).withColumn("parent_conv_id", F.get("low", (F.col("depth") - 1).cast("int")))
        out = out.unionByName(made[r].filter("kind = 0").select(*names)).unionByName(below.select(*names))
        if r:
            told = made[r].filter("kind = 3").select(F.col("path").alias("of"), F.col("low").alias("own"), "depth", "above").join(known, F.col("above") == F.col("path"), "left")
            known = scratch.save(told.select(F.col("of").alias("path"), F.when(F.col("above").isNull(), F.col("own")).otherwise(F.concat(F.slice("low", F.lit(1), F.col("depth").cast("int")), "own")).alias("low")), f"known{r}")
    return out


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node; nulls,
    ties, repeated rows and empty tables as in ``rebuilt`` and ``prefix_trie``."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie(rebuilt(turns), Scratch(spark))


_STEP_SQL = "md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"
SQL = {
    "op11_prefix_trie": f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_STEP_SQL}) AS k, {_STEP_SQL} AS step, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS first, {crc32_sql('conv_id::VARCHAR')} % {HEAD} AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, k, step, size FROM c JOIN t ON t.conv_id = c.first AND k <= h UNION ALL SELECT c.conv_id, 1, k, step, size FROM c JOIN t ON t.conv_id = c.conv_id AND k > h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS depth, step, size FROM r),
p AS (SELECT conv_id, depth, size, depth || ':' || md5(string_agg(step, ',') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS node FROM s UNION ALL SELECT conv_id, 0, 0, '0:' FROM c),
q AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS up, row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1 AS ends FROM p),
n AS (SELECT node, any_value(up) AS up, any_value(depth) AS depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY node),
k AS (SELECT up AS node, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT q.node, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens FROM n LEFT JOIN k ON k.node = n.node JOIN q ON q.conv_id = n.conv_id AND q.depth <= n.depth GROUP BY q.node)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN below USING (node) LEFT JOIN k ON k.node = n.node LEFT JOIN n m ON m.node = n.up""",
}
QUERIES = {"op11_prefix_trie": op11_prefix_trie}
