"""What the corpus operators share: scratch tables, whole groups of sorted Arrow rows, byte hashes, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a local one only for a local master that has none, as in tests."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="caselake-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


BATCH_ROWS = 2000


class Scratch:
    """Written tables in the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_root(spark)}/caselake-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}
        # whole texts go to Python and back in short batches: 10,000 of them at a time fill a worker
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def save(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """files: so many at most, where the rows, as the caller knows them, ask for fewer than the last step has tasks.

        Each file of a local folder has its mode set by a process that the executor's JVM starts, and which has the
        JVM's memory until it runs."""
        path = f"{self.root}/{name}"
        if files:
            df = df.coalesce(files)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_bucketed(self, df: DataFrame, name: str, n: int, key: str, dealt: bool = False) -> DataFrame:
        """One file a bucket, sorted by the key: later joins and groupings on the key need no exchange.

        dealt says that the rows stand in n partitions by the key already."""
        table = f"caselake_{name}_{uuid.uuid4().hex[:12]}"
        ((df if dealt else df.repartition(n, key)).write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/{name}")
         .bucketBy(n, key).sortBy(key).saveAsTable(table))
        self.tables[name] = table
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        if name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.free()

    def remove(self) -> None:
        """Remove all tables, once nothing reads them any more."""
        for name in list(self.tables):
            self.drop(name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.free()

    def free(self) -> None:
        """Ask the JVM to collect: Spark removes the files of shuffles whose plans are gone. Only disk use depends on it."""
        gc.collect()
        self.spark._jvm.System.gc()


def row_hash(df: DataFrame, *columns: str):
    """A hash of columns of any type: those that hold maps, which have no hash, by their JSON."""
    whole = F.struct(*[F.col(c) for c in columns])
    maps = any("map<" in df.select(F.col(c).alias("c")).schema["c"].dataType.simpleString() for c in columns)
    return F.xxhash64(F.to_json(whole)) if maps else F.xxhash64(*columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by keys: tables of complete groups with the row numbers where groups begin.

    A group that goes over the end of a batch is held back until it is complete."""

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            c = t.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if held and all(held[-1].column(k)[-1] == t.column(k)[0] and t.column(k)[0] == t.column(k)[-1] for k in keys):
            held.append(t)
            continue
        t = pa.concat_tables([*held, t]).combine_chunks()
        at = starts(t)
        if at[-1]:
            yield t.slice(0, at[-1]), at[:-1]
        held = [t.slice(at[-1])]
    if held:
        t = pa.concat_tables(held).combine_chunks()
        yield t, starts(t)


FILE_DOCS, FILE_EDGES = 2000, 1 << 16  # rows of a scratch table's file at least, where there are few


def files_of(rows: int, least: int = FILE_DOCS) -> int:
    return max(1, -(-rows // least))


SLICE_ROWS = 256


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in short slices, so that few whole texts stand in Python's memory at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def released(run):
    """``run`` for mapInArrow, which hands memory that it has freed back to the system when its task ends.

    Workers are used again by later steps, and allocators keep what the largest step took."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


def byte_texts(column: pa.Array) -> list[bytes]:
    """Whole texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED_CODE = BYTE_CODE.copy()
FOLDED_CODE[65:91] = BYTE_CODE[97:123]


def powers(n: int, way: str = "up") -> np.ndarray:
    if len(_powers[way]) < n:
        size = max(n, 2 * len(_powers[way]))
        x = np.full(size, _BASE if way == "up" else _INVERSE, np.uint64)
        x[0] = 1
        _powers[way] = np.cumprod(x, dtype=np.uint64)
    return _powers[way][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def prefix_sums(a: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """Sums of byte codes times powers of an odd base modulo 2**64, for hashes of any substring."""
    c = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(code[a] * powers(len(a)), out=c[1:])
    return c


def substring_hashes(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((c[end] - c[start]) * powers(len(c), "down")[start] + (end - start).astype(np.uint64) * _M2)


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", files: int | None = None) -> DataFrame:
    """(id, component) of every id in edges (a, b), component being the smallest id that links reach.

    Large-star and small-star rounds, each an aggregation of minima and an equi-join, until the edges
    stay the same. Rounds are written to the shared folder; no edge comes to the driver. Pairs with a
    null or with a = b are ignored; no edges give no rows. files: of the edges as given, at most; those of a round
    follow the number of edges before it."""

    def both(e):
        return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def state(e):
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 1))")).first())

    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct()
    e, last, k = scratch.save(e, f"{name}0", files), None, 0
    while (now := state(e)) != last and now[0]:
        last = now
        d = both(e)
        low = d.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = d.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").filter("a <> b").distinct()
        e = scratch.save(small, f"{name}{k + 1}", files_of(now[0], FILE_EDGES))
        scratch.drop(f"{name}{k}")
        k += 1
    roots = e.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).union(roots)


SIEVE_BITS = 1 << 24


def _sieve_bit(column: str):
    # the bitmap functions number bits from 1
    return F.expr(f"(cast(`{column}` AS long) & {SIEVE_BITS - 1}L) + 1")


def _sieve_rows(keys: DataFrame, column: str) -> DataFrame:
    return keys.select(_sieve_bit(column).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))


def without(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """rows whose long key is none of keys, as by an anti-join; only those that the keys' sieve lets through are shuffled.

    A null key stays. keys are read twice."""
    sieve = F.broadcast(_sieve_rows(keys, column).select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")))
    x = rows.withColumn("_bit", _sieve_bit(column)).join(sieve, F.bitmap_bucket_number("_bit") == F.col("_bucket"), "left")
    x = x.withColumn("_at", F.bitmap_bit_position("_bit"))
    byte = "cast(conv(hex(substring(_bits, cast(_at div 8 AS int) + 1, 1)), 16, 10) AS int)"
    held = F.coalesce(F.expr(f"shiftright({byte}, cast(_at % 8 AS int)) & 1"), F.lit(0)) == 1
    maybe, sure = (x.filter(c).select(*[F.col(f"`{c}`") for c in rows.columns]) for c in (held, ~held))
    return sure.unionByName(maybe.join(keys.select(column).distinct(), column, "left_anti").select(*sure.columns))


def build_sieve(keys: DataFrame, column: str) -> dict[int, bytes]:
    """A bitmap of 2 MB at most, whatever the input, of the low bits of hashed long keys: it lets through every
    key of the frame and few others, so that rows without a partner are left out before a shuffle."""
    return {r.bucket: bytes(r.bits) for r in _sieve_rows(keys, column).collect()}


def in_sieve(bits: dict[int, bytes], keys: np.ndarray) -> np.ndarray:
    flat = np.zeros(SIEVE_BITS // 8, np.uint8)
    for bucket, own in bits.items():
        flat[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(own, np.uint8)
    at = keys.astype(np.int64) & (SIEVE_BITS - 1)
    return (flat[at >> 3] >> (at & 7) & 1).astype(bool)
