"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, reranking with the vectors.

Rotations learned on a bounded sample turn vectors into balanced binary codes. The codes are cut into
substrings, one for each table; codes of a label that agree on a substring meet in that table's bucket, and
those with another one there within the radius are joined with their vectors and compared by cosine in double
precision. Only codes go into the tables; a vector goes where its code has a candidate.

The substring length follows the logarithm of the largest label, so buckets stay small. The number of tables
and the radius follow from pairs at the threshold that are made around sampled vectors: the bits they agree on
after centring, and their largest distance. Where too many tables were needed (vectors that are close to their
mean), substrings get shorter, down to none, when all vectors of a label are compared. A pair counts in the
first table that it meets in, so every link counts once, and only counts and a spanning forest of each bucket
leave it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, connected_components, released, shuffle_partitions, slices, whole_groups

THRESHOLD = 0.93
SAMPLE = 8192  # vectors a dimension that the rotations are fitted on
ROUNDS = 30
MISS = 0.005  # chance to miss a pair at the threshold, by the bits that made pairs agree on
RECALL = 0.99  # of other made pairs at the threshold, measured with the codes themselves
PAIRS = 4096
MOST_TABLES = 64
BUCKET = 16  # vectors of one label in a bucket that the substring length aims at
TILE = 1024  # a larger bucket is compared in pairs of parts of about this size


def fit(x: np.ndarray, rotations: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, dim x bits): PCA turned by iterative quantisation, from ``rotations`` random starts."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = x.mean(axis=0)
    centred = x - mean
    axes = np.linalg.eigh(centred.T @ centred)[1].T[::-1]
    v, rng, out = centred @ axes.T, np.random.default_rng(seed), []
    for _ in range(rotations):
        r = np.linalg.qr(rng.standard_normal((x.shape[1],) * 2))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(v.T @ np.where(v @ r > 0, 1.0, -1.0))
            r = u @ w
        out.append(axes.T @ r)
    return mean, np.hstack(out)


def pairs_at(x: np.ndarray, threshold: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors whose cosine is the threshold: rows of x, and these turned towards another vector.

    Half of them turn in any direction, half in that of a difference of two rows of x."""
    a = x[rng.integers(0, len(x), PAIRS)]
    u = rng.standard_normal(a.shape)
    u[::2] = 1e-9 * u[::2] + x[rng.integers(0, len(x), PAIRS // 2)] - x[rng.integers(0, len(x), PAIRS // 2)]
    u -= (u * a).sum(axis=1, keepdims=True) * a
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    return a, threshold * a + math.sqrt(1 - threshold**2) * u


def signs(x: np.ndarray, bits: int, tables: int, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The bits of all substrings, table by table."""
    return ((x - mean) @ turn > 0)[:, : bits * tables]


def numbers(code: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Rows of the substrings' numbers, one for each table."""
    return code.reshape(len(code), tables, bits) @ (1 << np.arange(bits))


def plan(x: np.ndarray, largest: int, threshold: float = THRESHOLD) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """(bits of a substring, tables, radius, mean, turn) for sampled vectors and the number of vectors of the largest label."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    dim, rng = x.shape[1], np.random.default_rng(11)
    mean, turn = fit(x, 2)
    a, b = pairs_at(x, threshold, rng)
    agree = (((a - mean) @ turn > 0) == ((b - mean) @ turn > 0)).mean(axis=1)
    other = pairs_at(x, threshold, rng)
    for bits in range(min(20, max(4, round(math.log2(max(1, largest) / BUCKET + 1)))), 0, -1):
        missed = 1 - agree**bits
        tables = next((t for t in range(1, MOST_TABLES + 1) if (missed**t).mean() <= MISS), None)
        while tables and tables <= MOST_TABLES:
            mean, turn = fit(x, -(-bits * tables // dim))
            one, two = (signs(o, bits, tables, mean, turn) for o in other)
            if (numbers(one, bits, tables) == numbers(two, bits, tables)).any(axis=1).mean() >= RECALL:
                return bits, tables, int((one != two).sum(axis=1).max()), mean, turn
            tables += -(-tables // 4)
    return 0, 1, 0, mean, np.zeros((dim, 0))


def unit_rows(v: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision."""
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def unpacked(packed: pa.Array) -> np.ndarray:
    """Rows of the bytes of binary values of one width."""
    return np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), -1)


def pairs_within(words: np.ndarray, stop: np.ndarray, radius: np.ndarray):
    """Pairs of rows of one group whose codes differ in ``radius`` bits at most, in steps of one distance in rows;
    ``stop`` is the end of each row's group."""
    i, d = np.arange(len(words)), 1
    while len(i := i[i + d < stop[i]]):
        near = np.bitwise_count(words[i] ^ words[i + d]).sum(axis=1) <= radius[i]
        if near.any():
            yield i[near], i[near] + d
        d += 1


def first_meeting(c: np.ndarray, i: np.ndarray, j: np.ndarray, tab: np.ndarray) -> np.ndarray:
    """Whether pairs agree on no substring before that of their table."""
    new = np.ones(len(i), bool)
    for k in range(int(tab.max(initial=0))):
        new &= (c[i, k] != c[j, k]) | (tab <= k)
    return new


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row number of each row's component under links i - j."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def near_duplicates(vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Vectors link when labels are equal, lengths are equal and the cosine is at least the threshold. Rows with
    a null label, or a vector that is null, empty, zero or holds null or non-finite components, link with
    nothing and stay. Equal vectors of a label go through the tables once and count for each other. Each row
    counts as a vector of its own, also with a repeated id. An empty table gives no rows."""
    spark = vectors.sparkSession
    n = shuffle_partitions(spark)
    kind = vectors.schema[vector_col].dataType
    held = "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(held).alias("v"))
    good = F.expr("label IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity')) AND exists(v, e -> e <> 0)")
    good = F.coalesce(good, F.lit(False))
    keys = [F.when(good, F.xxhash64(F.lit(k), "label", "v")).alias(f"k{k}") for k in (1, 2)]
    rows = x.select("id", "label", "v", *keys)
    reps = rows.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    reps = scratch.save(reps.withColumn("dim", F.size("v")), "vectors")
    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()
    models = {}
    for r in sizes:
        sample = reps.filter(F.col("dim") == r.dim).orderBy(F.xxhash64("k1")).limit(SAMPLE).select("v").collect()
        models[r.dim] = plan(np.array([s.v for s in sample]), r.n, threshold)

    # codes of all lengths of vectors take the same number of words
    width = 8 * max([1, *(-(-m[0] * m[1] // 64) for m in models.values())])

    def coded(with_codes: bool):
        def run(batches):
            for b in slices(batches):
                for dim in b.column("dim").unique().to_pylist():
                    s = b.filter(pc.equal(b.column("dim"), dim))
                    bits, tables, _, mean, turn = models[dim]
                    code = signs(unit_rows(s.column("v")), bits, tables, mean, turn)
                    row = np.repeat(np.arange(len(code)), tables)
                    if with_codes:
                        packed = np.zeros((len(code), width), np.uint8)
                        packed[:, : -(-code.shape[1] // 8)] = np.packbits(code, axis=1)
                        held = pa.array([p.tobytes() for p in packed], pa.binary()).take(row)
                    else:
                        held = pa.array([b""], pa.binary()).take(np.zeros(len(row), np.int64))
                    tab = np.tile(np.arange(tables, dtype=np.int32), len(code))
                    columns = [s.column("label").take(row), pa.array(np.full(len(row), dim, np.int32)), pa.array(tab), pa.array(numbers(code, bits, tables).ravel().astype(np.int32)), s.column("k1").take(row), held]
                    yield pa.RecordBatch.from_arrays(columns, ["label", "dim", "tab", "bucket", "key", "code"])

        return reps.select("label", "dim", "k1", "v").mapInArrow(released(run), "label string, dim int, tab int, bucket int, key long, code binary")

    where = ["label", "dim", "tab", "bucket"]
    large = coded(False).groupBy(*where).agg(F.count("*").alias("n")).filter(F.col("n") > TILE).withColumn("parts", F.ceil(F.col("n") / TILE).cast("int")).drop("n")
    tiles = coded(True).join(large, where, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")})
    by = [*where, "p", "q"]
    tiles = tiles.select(*by, "part", "key", "code").repartition(n, *by).sortWithinPartitions(*by)

    def substrings(raw, dims):
        c = np.zeros((len(raw), max(m[1] for m in models.values())), np.int64)
        for dim in np.unique(dims):
            bits, tables = models[int(dim)][:2]
            at = np.flatnonzero(dims == dim)
            c[at, :tables] = numbers(np.unpackbits(raw[at], axis=1)[:, : bits * tables], bits, tables)
        return c

    def candidates(batches):
        for t, starts in whole_groups(batches, by):
            dims, tab, part = (t[k].to_numpy() for k in ("dim", "tab", "part"))
            across = t["p"].to_numpy() != t["q"].to_numpy()
            raw = unpacked(t["code"])
            ends = np.append(starts[1:], t.num_rows)
            radius = np.array([models[d][2] for d in dims.tolist()])
            c, marked = substrings(raw, dims), np.zeros(t.num_rows, bool)
            for i, j in pairs_within(raw.view(np.uint64), np.repeat(ends, ends - starts), radius):
                ok = ~across[i] | (part[i] != part[j])
                i, j = i[ok], j[ok]
                ok = first_meeting(c, i, j, tab[i])
                marked[i[ok]] = marked[j[ok]] = True
            if marked.any():
                yield from t.filter(pa.array(marked)).to_batches()

    near = tiles.mapInArrow(released(candidates), tiles.schema)
    near = near.join(reps.select(F.col("k1").alias("key"), "copies", "v"), "key").select(*by, "part", "key", "copies", "v", "code")
    near = near.repartition(n, *by).sortWithinPartitions(*by)

    def compare(batches):
        for t, starts in whole_groups(batches, by):
            keys, copies, part = t["key"].to_numpy(), t["copies"].to_numpy(), t["part"].to_numpy()
            dims, tab, p, q = (t[k].to_numpy() for k in ("dim", "tab", "p", "q"))
            c = substrings(unpacked(t["code"]), dims)
            vectors = t["v"].combine_chunks()
            a_out, b_out, links_out = [], [], []
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows]):
                v = unit_rows(vectors.slice(at, end - at))
                i, j = np.nonzero(np.triu(v @ v.T >= threshold, 1))
                if p[at] != q[at]:
                    ok = part[at:end][i] != part[at:end][j]
                    i, j = i[ok], j[ok]
                ok = first_meeting(c[at:end], i, j, np.full(len(i), tab[at]))
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                own = copies[at:end]
                links = np.bincount(i, own[j], end - at) + np.bincount(j, own[i], end - at)
                root = forest(end - at, i, j)
                there = np.flatnonzero(links)
                a_out.append(keys[at:end][there])
                b_out.append(keys[at:end][root[there]])
                links_out.append(links[there].astype(np.int64))
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a_out, b_out, links_out)], ["a", "b", "links"])

    found = scratch.save(near.mapInArrow(released(compare), "a long, b long, links long"), "found")
    links = found.groupBy(F.col("a").alias("k1")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("a", "b"), scratch).withColumnRenamed("id", "k1")
    known = reps.select("k1", "k2", "rep", "copies").join(links, "k1", "left").join(parts, "k1", "left").withColumn("component", F.coalesce("component", "k1"))
    known = scratch.save(known, "known")
    lowest = known.groupBy("component").agg(F.min("rep").alias("low"))
    known = known.join(lowest, "component").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "low")
    # rows that link with nothing get keys of their own, so that they don't meet in one task
    out = rows.select("id", F.coalesce("k1", F.xxhash64("id")).alias("k1"), "k2").join(known, ["k1", "k2"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("low", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def op2_itq_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark))


SQL: dict[str, str] = {
    "op2_itq_near_dups": f"""
WITH RECURSIVE g AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
r AS (SELECT vec_id AS id, vec_id AS low FROM embeddings UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.id WHERE r.low < e.b),
c AS (SELECT id, min(low) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON id = vec_id LEFT JOIN n ON a = vec_id
""",
}
QUERIES = {"op2_itq_near_dups": op2_itq_near_dups}
