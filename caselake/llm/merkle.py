"""Merkle manifest of a dataset: levels of parent-linked nodes, and a recursive query that climbs from the leaves.

Each row is a leaf. The leaves of a source, in the order of their ids, are numbered by ranges: rows go to
ranges of (source, id) once, ranges are counted, and a row's number follows from the counts before its range,
so no source is sorted in one task. Every 16 neighbours become their parent until one is left, the subroot;
subroots become the root likewise. Each level is written: a node's row names its parent and holds the hashes
of its siblings before and after it.

The proofs come from a recursive query over these rows. The leaves of a run share all siblings above it, so
what climbs is a run: its siblings so far and the hashes that its leaves, tampered or not, fold to; equal ones
are folded once. Many runs meet at an upper node; its row is copied for each 4096 runs below it.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SALT_RUNS = 4096  # runs at most that meet one copy of a node's row, on average
TAMPER_EVERY = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Manifest(NamedTuple):
    runs: DataFrame  # src, run, node, n_runs, leaves (doc_id, leaf, fold), folded
    nodes: DataFrame  # id, parent, hash, before, after, subroot, runs, parent_runs
    root_id: str | None
    root: str | None


def leaf_hash(fields: dict[str, Column]) -> Column:
    """sha256 (binary) of the fields: ``-`` for null, else the bytes' count, ``:`` and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields.values()]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _grouped(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of FAN neighbours of nodes (*keys, idx, id, hash, n, runs): (*keys, up, run, n, runs)."""
    up = F.expr(f"idx div {FAN}").alias("up")
    return nodes.groupBy(*keys, up).agg(F.sort_array(F.collect_list(F.struct("idx", "id", "hash", "subroot", "runs"))).alias("run"), F.first("n").alias("n"), F.sum("runs").alias("runs"))


def _links(grouped: DataFrame, parent: Column) -> DataFrame:
    """Node rows of a level: each child with its parent and the hashes, as text, of the siblings before and after it."""
    x = grouped.select(parent.alias("parent"), F.col("runs").alias("parent_runs"), F.transform("run", lambda r: _hex(r["hash"])).alias("hashes"), F.posexplode("run").alias("k", "c"))
    before, after = F.array_join(F.slice("hashes", 1, F.col("k")), ""), F.array_join(F.slice("hashes", F.col("k") + 2, F.lit(FAN)), "")
    return x.select("c.id", "parent", "c.hash", before.alias("before"), after.alias("after"), "c.subroot", "c.runs", "parent_runs")


def build(docs: DataFrame, scratch: Scratch) -> Manifest:
    """The manifest of (doc_id, source, lang, n_chars, text), with the hashes of tampered leaves beside it.

    Ties of doc_id go by the leaf's hash; null ids and a null source come first; repeated rows are leaves of
    their own. An empty table has no nodes and no root. Other columns are left out."""
    spark = docs.sparkSession
    c = {k: F.col(f"`{k}`") for k in FIELDS}
    bad = F.crc32(c["doc_id"].cast("string").cast("binary")) % TAMPER_EVERY == 0
    lowered = F.translate(c["text"], _UPPER, _LOWER)
    leaves = docs.select(c["doc_id"].cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), c["source"]), F.lit("n")).alias("skey"), leaf_hash(c).alias("leaf"), F.when(bad, leaf_hash({**c, "text": lowered})).alias("tampered"), F.monotonically_increasing_id().alias("tie"))
    leaves = scratch.save(leaves, "leaves")
    order = [F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("tie")]
    # the ranges are drawn once and written with their numbers
    dealt = scratch.save(leaves.repartitionByRange(shuffle_partitions(spark), F.asc("skey"), *order).withColumn("p", F.spark_partition_id()), "dealt")
    per = dealt.groupBy("p", "skey").agg(F.count("*").alias("m"))
    by_source = per.groupBy("skey").agg(F.min("p").alias("p0"), F.sum("m").alias("n"))
    ranges = by_source.groupBy("p0").agg(F.count("*").alias("m"))
    # one row a range of the exchange
    ranges = ranges.select(F.col("p0").alias("q"), F.coalesce(F.sum("m").over(Window.partitionBy(F.lit(0)).orderBy("p0").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    numbered = by_source.withColumn("k", F.row_number().over(Window.partitionBy("p0").orderBy("skey")).cast("long")).join(ranges, F.col("p0") == F.col("q"))
    numbered = numbered.select(F.col("skey").alias("s"), (F.col("earlier") + F.col("k") - 1).alias("src"), "n")
    before = F.coalesce(F.sum("m").over(Window.partitionBy("skey").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = scratch.save(per.withColumn("earlier", before).join(numbered, F.col("skey") == F.col("s")).select(F.col("p").alias("q"), "s", "src", "n", "earlier"), "ranges")
    k = F.row_number().over(Window.partitionBy("p", "skey").orderBy(*order))
    placed = dealt.withColumn("k", k.cast("long")).join(per, (F.col("p") == F.col("q")) & (F.col("skey") == F.col("s")))
    placed = placed.select("src", "n", (F.col("earlier") + F.col("k") - 1).alias("at"), "doc_id", "leaf", "tampered")
    runs = placed.groupBy("src", F.expr(f"at div {FAN}").alias("run")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "doc_id", "leaf", "tampered"))).alias("l"))
    runs = runs.select("src", "run", "n", "l", F.transform("l", lambda r: _hex(r["leaf"])).alias("hashes"))
    runs = scratch.save(runs, "runs_of_leaves")
    alone = F.col("n") == 1
    whole = F.unhex(F.sha2(F.array_join("hashes", "").cast("binary"), 256))

    def fold(r: Column, i: Column) -> Column:
        other = F.concat(F.array_join(F.slice("hashes", F.lit(1), i), ""), _hex(r["tampered"]), F.array_join(F.slice("hashes", i + 2, F.lit(FAN)), ""))
        return F.when(r["tampered"].isNull(), F.when(alone, r["leaf"]).otherwise(F.col("whole"))).when(alone, r["tampered"]).otherwise(F.unhex(F.sha2(other.cast("binary"), 256)))

    runs = runs.withColumn("whole", whole).withColumn("folds", F.transform("l", fold))
    runs = runs.select("src", "run", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n_runs"), F.when(alone, F.col("l")[0]["leaf"]).otherwise(F.col("whole")).alias("hash"),
                       F.concat_ws("/", F.when(alone, "0").otherwise("1"), "src", "run").alias("node"), F.array_distinct("folds").alias("folded"),
                       F.transform("l", lambda r, i: F.struct(r["doc_id"].alias("doc_id"), r["leaf"].alias("leaf"), F.get("folds", i).alias("fold"))).alias("leaves"))
    runs = scratch.save(runs, "runs")
    for name in ("leaves", "dealt", "ranges", "runs_of_leaves"):
        scratch.drop(name)
    most, sources = runs.agg(F.max("n_runs"), F.count_distinct("src")).first()
    if not sources:
        return Manifest(runs, _no_nodes(spark), None, None)
    now = runs.select("src", F.col("run").alias("idx"), F.col("node").alias("id"), "hash", F.col("n_runs").alias("n"), (F.col("n_runs") == 1).alias("subroot"), F.lit(1).cast("long").alias("runs"))
    levels, level = [], 1
    done = now.filter("n = 1")
    while most > 1:
        grouped = scratch.save(_grouped(now.filter("n > 1"), ["src"]), f"level{level}")
        level += 1
        levels.append(_links(grouped, F.concat_ws("/", F.lit(str(level)), "src", "up")))
        n = F.expr(f"(n + {FAN - 1}) div {FAN}")
        now = grouped.select("src", F.col("up").alias("idx"), F.concat_ws("/", F.lit(str(level)), "src", "up").alias("id"), _over("run").alias("hash"), n.alias("n"), (n == 1).alias("subroot"), "runs")
        done = done.unionByName(now.filter("n = 1"))
        most = -(-most // FAN)
    tops = done.select(F.col("src").alias("idx"), "id", "hash", F.lit(sources).alias("n"), "subroot", "runs")
    level = 0
    while sources > 1:
        grouped = scratch.save(_grouped(tops, []), f"top{level}")
        level += 1
        levels.append(_links(grouped, F.concat_ws("/", F.lit("t"), F.lit(str(level)), "up")))
        tops = grouped.select(F.col("up").alias("idx"), F.concat_ws("/", F.lit("t"), F.lit(str(level)), "up").alias("id"), _over("run").alias("hash"), "n", F.lit(False).alias("subroot"), "runs")
        sources = -(-sources // FAN)
    root = tops.select("id", _hex(F.col("hash")).alias("hash")).first()
    nodes = _no_nodes(spark)
    for x in levels:
        nodes = nodes.unionByName(x)
    return Manifest(runs, scratch.save(nodes, "nodes"), root.id, root.hash)


def _over(run: str) -> Column:
    return F.unhex(F.sha2(F.array_join(F.transform(run, lambda r: _hex(r["hash"])), "").cast("binary"), 256))


def _no_nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id string, parent string, hash binary, before string, after string, subroot boolean, runs long, parent_runs long")


CLIMB = f"""
WITH RECURSIVE climb(src, run, mark, node, salt, above, folded, subroot) AS (
  SELECT src, run, mark, node, salt, above, folded, subroot FROM {{runs}}
  UNION ALL
  SELECT c.src, c.run, c.mark, n.parent, pmod(c.mark, 1 + n.parent_runs div {SALT_RUNS}), concat(c.above, unhex(concat(n.before, n.after))),
    transform(c.folded, f -> unhex(sha2(CAST(concat(n.before, lower(hex(f)), n.after) AS BINARY), 256))), coalesce(c.subroot, CASE WHEN n.subroot THEN n.hash END)
  FROM climb c JOIN {{nodes}} n ON c.node = n.id AND c.salt = n.salt)
SELECT src, run, above, folded, subroot FROM climb WHERE node = '{{root}}'
"""


def proofs(manifest: Manifest, scratch: Scratch) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf.

    A leaf's proof is its siblings from its run up to the root; folded_root is what its tampered form, or it
    itself, folds to along them."""
    spark = scratch.spark
    if manifest.root is None:
        return manifest.runs.select(F.inline("leaves")).select("doc_id", *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified"))
    tag = uuid.uuid4().hex[:12]
    runs, nodes = f"caselake_runs_{tag}", f"caselake_nodes_{tag}"
    mark = F.xxhash64("src", "run")
    start = manifest.runs.select("src", "run", mark.alias("mark"), "node", F.lit(0).cast("long").alias("salt"), F.unhex(F.lit("")).alias("above"), "folded", F.lit(None).cast("binary").alias("subroot"))
    start.createOrReplaceTempView(runs)
    manifest.nodes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"runs div {SALT_RUNS}")))).createOrReplaceTempView(nodes)
    # every leaf climbs, so the default limit of a million rows would stop a large table
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        climbed = scratch.save(spark.sql(CLIMB.format(runs=runs, nodes=nodes, root=manifest.root_id)), "climbed")
    finally:
        spark.conf.set(limit, before)
        spark.catalog.dropTempView(runs)
        spark.catalog.dropTempView(nodes)
    x = climbed.join(manifest.runs.select("src", "run", "leaves", F.col("folded").alias("first_folds"), F.transform("leaves", lambda l: _hex(l["leaf"])).alias("hashes")), ["src", "run"])
    x = x.select("above", "folded", "first_folds", "subroot", "hashes", F.posexplode("leaves").alias("k", "l"))
    siblings = F.concat(F.array_join(F.slice("hashes", F.lit(1), F.col("k")), ""), F.array_join(F.slice("hashes", F.col("k") + 2, F.lit(FAN)), ""), _hex(F.col("above")))
    folded = _hex(F.get("folded", (F.array_position("first_folds", F.col("l.fold")) - 1).cast("int")))
    root = F.lit(manifest.root)
    x = x.select(F.col("l.doc_id").alias("doc_id"), _hex(F.col("l.leaf")).alias("leaf"), F.coalesce(_hex(F.col("subroot")), root).alias("subroot"), root.alias("root"), F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return x.withColumn("verified", F.col("folded_root") == root)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document; nulls, ties, repeated
    rows and empty tables as in ``build``."""
    scratch = Scratch(spark)
    return proofs(build(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch), scratch)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of ASCII text; 3988292384 is the polynomial, and -1 stands for a shift by a bit."""
    steps = f"[4294967295::BIGINT] || flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce({steps}, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"


def _sql(levels: int = 7, top: int = 4) -> str:
    """Levels written out one by one, enough for 16 ** levels leaves a source and 16 ** top sources."""
    def leaf(text: str) -> str:
        fields = [("doc_id::VARCHAR"), "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(concat(" + ", ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + "))"

    out = f"""WITH d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc32_sql('doc_id::VARCHAR')} % {TAMPER_EVERY} = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS tampered FROM documents),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS src FROM (SELECT DISTINCT source FROM d)),
l0 AS (SELECT doc_id, leaf, coalesce(tampered, leaf) AS f0, '' AS above, src, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i0 FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
n0 AS (SELECT src, i0 AS idx, leaf AS hash, count(*) OVER (PARTITION BY src) AS n FROM l0)"""
    for k in range(levels):
        out += f""",
r{k} AS (SELECT src, idx // {FAN} AS up, list(hash ORDER BY idx) AS run, any_value(n) AS n FROM n{k} GROUP BY ALL),
n{k + 1} AS (SELECT src, up AS idx, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS hash, (n + {FAN - 1}) // {FAN} AS n FROM r{k}),
l{k + 1} AS (SELECT l.doc_id, l.leaf, l.src, i{k} // {FAN} AS i{k + 1}, concat(above, array_to_string(run[:i{k} % {FAN}], ''), array_to_string(run[i{k} % {FAN} + 2:], '')) AS above,
  CASE WHEN n = 1 THEN f{k} ELSE sha256(concat(array_to_string(run[:i{k} % {FAN}], ''), f{k}, array_to_string(run[i{k} % {FAN} + 2:], ''))) END AS f{k + 1} FROM l{k} l JOIN r{k} r ON r.src = l.src AND r.up = i{k} // {FAN})"""
    out += f""",
t0 AS (SELECT src AS idx, hash, count(*) OVER () AS n FROM n{levels}),
u0 AS (SELECT doc_id, leaf, hash AS subroot, m.src AS j0, above, f{levels} AS g0 FROM l{levels} m JOIN n{levels} n ON n.src = m.src)"""
    for k in range(top):
        out += f""",
v{k} AS (SELECT idx // {FAN} AS up, list(hash ORDER BY idx) AS run, any_value(n) AS n FROM t{k} GROUP BY ALL),
t{k + 1} AS (SELECT up AS idx, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS hash, (n + {FAN - 1}) // {FAN} AS n FROM v{k}),
u{k + 1} AS (SELECT doc_id, leaf, subroot, j{k} // {FAN} AS j{k + 1}, concat(above, array_to_string(run[:j{k} % {FAN}], ''), array_to_string(run[j{k} % {FAN} + 2:], '')) AS above,
  CASE WHEN n = 1 THEN g{k} ELSE sha256(concat(array_to_string(run[:j{k} % {FAN}], ''), g{k}, array_to_string(run[j{k} % {FAN} + 2:], ''))) END AS g{k + 1} FROM u{k} JOIN v{k} ON up = j{k} // {FAN})"""
    return out + f"""
SELECT doc_id, leaf, subroot, hash AS root, sha256(above) AS proof_sha256, g{top} AS folded_root, g{top} = hash AS verified FROM u{top} JOIN t{top} ON idx = j{top}"""


SQL = {"op12_merkle_manifest": _sql()}
QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
