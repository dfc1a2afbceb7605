"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts texts into chunks, so passages that documents share become equal chunks
wherever they stand. Chunks that different texts share are encoded once and their ids joined back; the rest
of a document is encoded as runs between them. At each join the words around it are encoded again, one more
on each side until the ids kept on both sides agree exactly with what was encoded alone.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, build_sieve, files_of, in_sieve, mix, powers, prefix_sums, released, shuffle_partitions, slices
from .tokens import PieceEncoder

WINDOW = 16  # bytes the rolling hash sees
AVERAGE = 512  # bytes between cuts, on average
SHORTEST = 64
KEEP = 250_000  # pieces kept by a worker, whose memory also holds texts with the ids of their chunks
SALTS = 8  # of a text's rows that share chunks
FILE_CHUNKS = 1 << 14  # rows of texts and chunks for each file of a scratch table at least
_BLANK = re.compile(rb"[ \n]")


def cuts(data: bytes) -> list[int]:
    """Ends of chunks, the last one len(data). A cut depends on the WINDOW bytes before it and never parts a character."""
    n = len(data)
    if n <= SHORTEST:
        return [n] if n else []
    a = np.frombuffer(data, np.uint8)
    c = prefix_sums(a)
    h = mix((c[WINDOW:] - c[:-WINDOW]) * powers(n + 1, "down")[: n + 1 - WINDOW])
    at = np.flatnonzero(h % np.uint64(AVERAGE) == 0) + WINDOW
    at = at[at < n]
    at = at[(a[at] & 0xC0) != 0x80]
    out, last = [], 0
    for x in at.tolist():
        if x - last >= SHORTEST:
            out.append(x)
            last = x
    return [*out, n]


def digest(chunk: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(chunk)


def _before(data: bytes, p: int, words: int) -> int:
    """Start of the words-th word before p (the word that p is in counts), or 0."""
    for k in range(words):
        p = max(data.rfind(b" ", 0, p - 1 if k else p), data.rfind(b"\n", 0, p - 1 if k else p)) + 1
        if p <= 0:
            return 0
    return p


def _after(data: bytes, p: int, end: int, words: int) -> int:
    for k in range(words):
        m = _BLANK.search(data, p + 1 if k else p, end)
        if not m:
            return end
        p = m.start()
    return p


def _segments(data: bytes, known: dict[bytes, bytes]) -> list[tuple[int, int, bytes | None]]:
    """Known chunks with their ids, and the runs between them."""
    segments, start, run = [], 0, 0
    for end in cuts(data):
        ids = known.get(digest(data[start:end]))
        if ids is not None:
            if run < start:
                segments.append((run, start, None))
            segments.append((start, end, ids))
            run = end
        start = end
    if run < len(data):
        segments.append((run, len(data), None))
    return segments


def _apart(data: bytes, a: int) -> bool:
    return not a or data[a - 1] in b" \n" or data[a] in b" \n"


def assemble_all(texts: list[bytes], known: list[dict[bytes, bytes]], encoder: PieceEncoder) -> list[bytes]:
    """ids of whole texts from the ids of known chunks, runs between them and repaired joins.

    All runs and the first try at every join are encoded together; only joins that need more words go on singly."""
    special = [s.encode() for s in encoder.special]
    plans = [[(0, len(t), None)] if any(s in t for s in special) else _segments(t, k) for t, k in zip(texts, known)]
    asked: dict[tuple[int, int, int], bytes | None] = {}
    for k, (data, segments) in enumerate(zip(texts, plans)):
        for a, b, ids in segments:
            if ids is None:
                asked[k, a, b] = None
            if not _apart(data, a):
                left, right = _before(data, a, 1), _after(data, a, b, 1)
                asked |= {(k, left, a): None, (k, a, right): None, (k, left, right): None}
    asked = dict(zip(asked, encoder.encode_all([texts[k][a:b].decode() for k, a, b in asked])))

    def one(k: int, data: bytes) -> bytes:
        def enc(a: int, b: int) -> bytes:
            ids = asked.get((k, a, b))
            return encoder.encode_all([data[a:b].decode()])[0] if ids is None else ids

        out = bytearray()
        for a, b, ids in plans[k]:
            ids = enc(a, b) if ids is None else ids
            if _apart(data, a):
                out += ids
                continue
            words = 1
            while True:
                left, right = _before(data, a, words), _after(data, a, b, words)
                tail, head = enc(left, a), enc(a, right)
                if out.endswith(tail) and ids.startswith(head):
                    del out[len(out) - len(tail) :]
                    out += enc(left, right) + ids[len(head) :]
                    break
                if left == 0 and right == b:
                    out = bytearray(enc(0, b))
                    break
                words += 1
        return bytes(out)

    return [one(k, t) for k, t in enumerate(texts)]


def assemble(data: bytes, known: dict[bytes, bytes], encoder: PieceEncoder) -> bytes:
    return assemble_all([data], [known], encoder)[0]


class Decoder:
    """Texts as the library's decode(ids, skip_special_tokens=False), in UTF-8."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        # without a decoder tokens are joined by blanks
        self.tokens = None if tokenizer.decoder is not None else pa.array([f"{tokenizer.id_to_token(i) or ''} " for i in range(tokenizer.get_vocab_size(with_added_tokens=True))], pa.large_string())

    def __call__(self, ids: list[bytes]) -> list[bytes]:
        if self.tokens is None:
            return [self.tokenizer.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False).encode() for x in ids]
        end = np.cumsum([len(x) // 4 for x in ids])
        if not len(end) or not end[-1]:
            return [b""] * len(ids)
        joined = self.tokens.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        at = np.frombuffer(joined.buffers()[1], np.int64)[: end[-1] + 1]
        data, at = memoryview(joined.buffers()[2]), at[np.concatenate([np.zeros(1, np.int64), end])].tolist()
        return [bytes(data[a : max(a, z - 1)]) for a, z in zip(at, at[1:])]


def encode(docs: DataFrame, scratch: Scratch, tokenizer_path: str, finish=None, finish_schema: str = "ids binary", text_col: str = "text", name: str = "bpe") -> DataFrame:
    """Every row without its text but with ``ids`` (little-endian u32), or with what ``finish`` makes of them.

    finish(tokenizer) returns a function from a list of ids to Arrow columns for finish_schema; it runs in the
    same task, so ids need not be stored. Null and empty texts have no ids. A text that stands in many rows and
    shares chunks with others is encoded once; repeated rows give equal rows. An empty table stays empty. Result
    columns replace columns of the input with their names; other columns stay, whatever their names."""
    spark = docs.sparkSession
    made = [f.strip().split(" ")[0] for f in finish_schema.split(",")]
    rest = [c for c in docs.columns if c != text_col and c not in made]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(True).alias("_"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    x = docs.select(row.alias("row"), text.alias("text")).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    row_type = x.schema["row"].dataType.simpleString()
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in rest]).schema.fields), finish_schema])
    n = shuffle_partitions(spark)

    def chunked(batches):
        seen: set[bytes] = set()
        for b in slices(batches):
            keys, found = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key in seen:
                    continue
                seen.add(key)
                data, start, own = text.encode(), 0, set()
                for end in cuts(data):
                    own.add(digest(data[start:end]))
                    start = end
                keys += [key] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["key", "chunk"])

    def own_chunks(batches):
        encoder = PieceEncoder(tokenizer_path, "dropped", keep=KEEP)
        for b in slices(batches):
            chunks, texts = [], []
            for wanted, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                wanted, data, start = set(wanted), text.encode(), 0
                for end in cuts(data):
                    d = digest(data[start:end])
                    if d in wanted:
                        wanted.discard(d)
                        chunks.append(d)
                        texts.append(data[start:end].decode())
                    start = end
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.binary()), pa.array(encoder.encode_all(texts), pa.binary())], ["chunk", "ids"])

    def make():
        encoder = PieceEncoder(tokenizer_path, "dropped", keep=KEEP)
        return encoder, finish(encoder.tokenizer) if finish else lambda ids: [pa.array(ids, pa.binary())]

    def plain(batches):
        encoder, finished = make()
        for s in slices(batches):
            row = dict(zip([f.name for f in s.schema.field(0).type], s.column(0).flatten()))
            yield pa.RecordBatch.from_arrays([*(row[c] for c in rest), *finished(encoder.encode_all(s.column(1).to_pylist()))], [*rest, *made])

    def with_chunks(batches):
        encoder, finished = make()
        for s in slices(batches):
            known = [{u["chunk"]: u["ids"] for u in used or ()} for used in s.column(2).to_pylist()]
            ids = assemble_all([t.encode() for t in s.column(1).to_pylist()], known, encoder)
            yield pa.RecordBatch.from_arrays([s.column(0), *finished(ids)], ["key", *made])

    chunks = scratch.save(x.select("key", "text").mapInArrow(released(chunked), "key binary, chunk binary").distinct(), f"{name}_chunks")
    shared = chunks.groupBy("chunk").agg(F.min("key").alias("owner"), F.max("key").alias("other")).filter("owner <> other").select("chunk", "owner")
    few = files_of(chunks.count(), FILE_CHUNKS)
    uses = scratch.save(chunks.join(shared, "chunk"), f"{name}_uses", few)
    scratch.drop(f"{name}_chunks")
    sieve = spark.sparkContext.broadcast(build_sieve(uses.select(F.xxhash64("key").alias("h")), "h"))

    def alone(batches):
        for b in batches:
            mask = in_sieve(sieve.value, b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays(b.filter(pa.array(~mask)).columns[:2], ["row", "text"])

    def sharing(batches):
        """Each text once a task, so that a text of many rows comes to the next task a few times only."""
        seen: set[bytes] = set()
        for b in batches:
            b = b.filter(pa.array(in_sieve(sieve.value, b.column(2).to_numpy())))
            new = []
            for key in b.column(0).to_pylist():
                new.append(key not in seen)
                seen.add(key)
            yield pa.RecordBatch.from_arrays(b.filter(pa.array(new, pa.bool_())).columns[:2], ["key", "text"])

    def sharing_rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(b.filter(pa.array(in_sieve(sieve.value, b.column(2).to_numpy()))).columns[:2], ["row", "key"])

    h = F.xxhash64("key").alias("h")
    others = x.select("row", "text", h).mapInArrow(released(alone), f"row {row_type}, text string").mapInArrow(released(plain), out_schema)
    texts = x.select("key", "text", h).mapInArrow(released(sharing), "key binary, text string").repartition(n, "key").dropDuplicates(["key"])
    texts = scratch.save_bucketed(texts, f"{name}_texts", n, "key", dealt=True)
    owned = uses.filter("key = owner").groupBy("key").agg(F.collect_list("chunk").alias("wanted"))
    encoded = scratch.save(owned.join(texts, "key").select("wanted", "text").mapInArrow(released(own_chunks), "chunk binary, ids binary"), f"{name}_ids", few)
    used = uses.select("key", "chunk").join(encoded, "chunk").groupBy("key").agg(F.collect_list(F.struct("chunk", "ids")).alias("used"))
    found = texts.join(used, "key", "left").select("key", "text", "used").mapInArrow(released(with_chunks), f"key binary, {finish_schema}")
    found = scratch.save(found, f"{name}_found", few)
    # a text of many rows: its rows are salted, its result, one row, is there for each salt
    salts = F.explode(F.expr(f"sequence(0, {SALTS - 1})")).alias("salt")
    rows = x.select("row", "key", h).mapInArrow(released(sharing_rows), f"row {row_type}, key binary").withColumn("salt", F.expr(f"pmod(spark_partition_id(), {SALTS})"))
    joined = rows.join(found.select("*", salts), ["key", "salt"])
    return others.union(joined.select(*[F.col("row")[c].alias(c) for c in rest], *made))


HASHES = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def id_and_text_hashes(tokenizer):
    decode = Decoder(tokenizer)

    def make(ids: list[bytes]):
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in decode(ids)], pa.string())]

    return make


def op7_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; null and empty texts have no ids and decode to
    the empty text; repeated ids keep a row each; an empty table gives no rows."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, Scratch(spark), public_tokenizers.path("word_bpe_49k.json"), id_and_text_hashes, HASHES)


SQL: dict[str, str] = {}
QUERIES = {"op7_bpe_chunks": op7_bpe_chunks}
