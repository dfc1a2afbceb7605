"""Token ids as directly addressable codes: random access to any token without decoding a block.

A shard holds the ids of consecutive documents. An id is cut into 8-bit chunks, the lowest in level 0; a
bitmap of each level says which ids go on in the next, and a directory keeps the number of set bits before
every 512th bit, so the place of an id in the next level is a directory entry plus a short count.

Layout of a shard, little-endian: b"DAC1", u32 levels, u64 documents, u64 ids; u64 end offset of each
document's ids; then for each level: u64 chunks, the chunks (u8), the bitmap (ceil(chunks / 8) bytes, low bit
first), the directory (u32 for every 512 chunks).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions
from .tokens import PieceEncoder

MAGIC = b"DAC1"
STRIDE = 512
SHARD_IDS = 2_000_000  # a shard is closed by the first document that reaches this
END_ID = 2
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def pack(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """A shard of ids (unsigned) and the end of each document in them."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(_ONES[bits].astype(np.uint32), np.arange(0, len(bits), STRIDE // 8)) if len(bits) else np.zeros(0, np.uint32)
        directory = np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])[: len(ones)]
        levels.append((rest.astype(np.uint8).tobytes(), bits.tobytes(), directory.astype("<u4").tobytes()))
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            break
    head = [MAGIC, np.array([len(levels)], "<u4").tobytes(), np.array([len(ends), len(ids)], "<u8").tobytes(), ends.astype("<u8").tobytes()]
    return b"".join(head + [x for c, b, d in levels for x in (np.array([len(c)], "<u8").tobytes(), c, b, d)])


class Shard:
    """Views of a packed shard's parts; nothing is decoded before it is asked for."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard of directly addressable codes")
        n_levels = int(np.frombuffer(data, "<u4", 1, 4)[0])
        docs, self.n_ids = map(int, np.frombuffer(data, "<u8", 2, 8))
        self.ends = np.frombuffer(data, "<u8", docs, 24)
        at, self.levels = 24 + 8 * docs, []
        for _ in range(n_levels):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            at += 8
            parts = []
            for kind, count in ((np.uint8, n), (np.uint8, -(-n // 8)), ("<u4", -(-n // STRIDE))):
                parts.append(np.frombuffer(data, kind, count, at))
                at += parts[-1].nbytes
            self.levels.append(parts)

    def id_at(self, i: int) -> int:
        """One id by its place: a few bytes of each level are read."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // STRIDE
            before = bits[block * STRIDE // 8 : i >> 3]
            i = int(directory[block]) + int(_ONES[before].sum()) + int(_ONES[int(bits[i >> 3]) & ((1 << (i & 7)) - 1)])
        return value

    def all_ids(self) -> np.ndarray:
        value = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            here = chunks.astype(np.uint32)
            here[more] |= value << np.uint32(8)
            value = here
        return value


SHARDS = "task int, number int, docs array<long>, n_ids long, payload binary"


def write_shards(docs: DataFrame, scratch: Scratch, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, name: str = "dac") -> DataFrame:
    """Encodes whole texts, appends end_id to each, and writes shards in ascending order of the id column.

    Null and empty texts give the end id alone. Rows with a null id come first; repeated ids stay, each row with
    its own ids, next to one another (equal rows in equal shards too: a shard is named by its task and its number
    there, and both follow the order). A document longer than a shard has one of its own. Other columns are
    not carried on, whatever their names. An empty table writes no shard."""

    def run(batches):
        from pyspark import TaskContext

        encoder, task, number = PieceEncoder(tokenizer_path, "kept"), TaskContext.get().partitionId(), 0
        keys, ids, sizes, total = [], [], [], 0

        def close():
            row = {"task": pa.array([task], pa.int32()), "number": pa.array([number], pa.int32()), "docs": pa.array([keys], pa.list_(pa.int64()))}
            payload = pack(np.concatenate(ids), np.cumsum(np.concatenate(sizes)))
            return pa.RecordBatch.from_pydict(row | {"n_ids": pa.array([total], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for b in batches:
            at, names = 0, b.column(0).to_pylist()
            for n, found, size in encoder.encode_array(b.column(1)):
                found, size = np.insert(found, np.cumsum(size), end_id), size + 1
                # a shard ends with the first document that fills it
                while n:
                    k = min(n, int(np.searchsorted(np.cumsum(size), shard_ids - total)) + 1)
                    taken = int(size[:k].sum())
                    keys += names[at : at + k]
                    ids.append(found[:taken])
                    sizes.append(size[:k])
                    total += taken
                    found, size, n, at = found[taken:], size[k:], n - k, at + k
                    if total >= shard_ids:
                        yield close()
                        keys, ids, sizes, total, number = [], [], [], 0, number + 1
        if keys:
            yield close()

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    x = x.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return scratch.save(x.mapInArrow(run, SHARDS), name)


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from written shards; start counts the ids of all documents before it.

    Sums of tasks, a row for each, go through one ordered sum; those of shards through one for each task."""
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = shards.groupBy("task").agg(F.sum("n_ids").alias("n")).select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("task").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    heads = shards.select("task", "number", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inner")).join(tasks, "task")
    heads = heads.select("task", "number", (F.col("base") + F.col("inner")).alias("before"))

    def run(batches):
        for b in batches:
            for task, number, keys, payload in zip(*(c.to_pylist() for c in b.columns)):
                s = Shard(payload)
                ids, ends = memoryview(s.all_ids().astype("<u4")).cast("B"), s.ends.astype(np.int64)
                starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
                sums = [zlib.crc32(ids[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist())]
                own = [np.full(len(keys), x, np.int32) for x in (task, number)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, own), *(pa.array(c, pa.int64()) for c in (keys, starts, ends - starts, sums))], ["task", "number", "doc_id", "place", "n_tokens", "ids_crc32"])

    rows = shards.select("task", "number", "docs", "payload").mapInArrow(run, "task int, number int, doc_id long, place long, n_tokens long, ids_crc32 long")
    return rows.join(heads, ["task", "number"]).select("doc_id", (F.col("place") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op5_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row, read back from the written shards. Null and empty texts
    have the end id alone; repeated ids keep a row each, the smaller text first; an empty table gives no rows."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_documents(write_shards(docs, Scratch(spark), public_tokenizers.path("byte_bpe_50k.json")))


SQL: dict[str, str] = {}
QUERIES = {"op5_dac_tokens": op5_dac_tokens}
