"""Suffix-array dedup by a logarithmic index family.

A suffix array of all bytes would hold as many entries as bytes; here it is sparse: of the 35 places in a
50-byte window at which 16 bytes begin, the one with the smallest hash is the window's anchor, so equal
windows have equal anchors, and only suffixes at anchors (about one in 18) are kept. An entry holds the
suffix's first 16 bytes (its head), a hash of all bytes that the anchor's windows cover (its form), the
document and the place. Parts, dealt by a hash of the head, are each sorted by head: sparse suffix arrays.

Batches of documents come in the order of their ids. A batch's runs are merge-scanned with the levels of the
index: where head and form stand already, all windows of the anchor are repeats; where only the head does
(neighbours with a common prefix of 16 bytes or more, the ends of long matches), the suffixes' bytes are
fetched, sorted, and the common prefix of neighbours, with the bytes to the left, says which windows agree.
Then the batch's new forms become a level, and levels of equal size are merged, so there are at most
log2(batches) levels. A family is a folder: a later call opens it and adds the next batch.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import BYTE_CODE, Scratch, files_of, mix, powers, prefix_sums, released, shuffle_partitions, whole_groups

LENGTH = 50
HEAD = 16
BATCHES = 2
PIECE = 1 << 20  # bytes of a text looked at together; windows go on over the border
SLICE = 1 << 22  # bytes of texts whose entries are sorted into one run
PART_BYTES = 1 << 22  # bytes of a batch's texts for each part of the index
FILE_BYTES = 1 << 21  # bytes of a batch's texts for each file of a scratch table at least
TEXTS_OF_ID = 1 << 20  # different texts with one id that can be told apart
HOT = 4096  # suffixes with one head beyond which their windows are dealt out singly
WHOLE = -1  # mask: all windows of the place
_LOW = np.uint64(PIECE - 1)
_U = np.uint64


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(head's two halves, form, hash of the head, place, first window, last window) of each anchor; windows are
    numbered by their first byte."""
    out = []
    for start in range(0, max(0, len(data) - length + 1), PIECE - 2 * length):
        a = np.frombuffer(data[start : start + PIECE - length], np.uint8)
        if len(a) < length:
            break
        c, down = prefix_sums(a), powers(len(a) + 1, "down")
        h = mix((c[HEAD:] - c[:-HEAD]) * down[: len(c) - HEAD])
        low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        span, size = length - HEAD + 1, 1
        while 2 * size <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < span:
            low = np.minimum(low[: len(low) - span + size], low[span - size :])
        place = (low & _LOW).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        place = place[first]
        heads = a[place[:, None] + np.arange(HEAD)].view(">u8").astype(np.uint64)
        form = mix((c[last + length] - c[first]) * down[first] ^ mix((place - first).astype(np.uint64)))
        out.append((heads[:, 0], heads[:, 1], form >> _U(16), h[place], place + start, first + start, last + start))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64),) * 4 + (np.zeros(0, np.int64),) * 3


def pack_place(tag, first, windows, lead) -> np.ndarray:
    """One number: which of the texts with one id (20 bits), first window (31 bits, as a text has less than 2 GB),
    number of windows, bytes before the anchor."""
    return (np.int64(tag) << 43) | (first << 12) | (windows << 6) | lead


def unpack_place(x: np.ndarray):
    return x >> 43, (x >> 12) & ((1 << 31) - 1), (x >> 6) & 63, x & 63


def pack_run(k1, k2, form, doc, place) -> bytes:
    """Sorted entries as compressed planes of bytes."""
    import zstandard

    cols = ((np.diff(k1, prepend=_U(0)), 8), (k2, 8), (form, 6), (doc.view(np.uint64), 8), (place.view(np.uint64), 8))
    return zstandard.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for c, w in cols), 1)


def unpack_run(data: bytes):
    import zstandard

    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    n, at, out = len(raw) // 38, 0, []
    for w in (8, 8, 6, 8, 8):
        c = np.zeros((n, 8), np.uint8)
        c[:, :w] = raw[at : at + w * n].reshape(w, n).T
        out.append(c.reshape(-1).view(np.uint64))
        at += w * n
    return np.cumsum(out[0], dtype=np.uint64), out[1], out[2], out[3].view(np.int64), out[4].view(np.int64)


def _joined(runs):
    return tuple(np.concatenate(c) for c in zip(*runs)) if runs else (np.zeros(0, np.uint64),) * 3 + (np.zeros(0, np.int64),) * 2


def _sorted(e):
    o = np.lexsort((e[4], e[3], e[2], e[1], e[0]))
    return tuple(c[o] for c in e)


def _begins(*cols) -> np.ndarray:
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def _table(names, *cols):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)


def part_of(heads: np.ndarray, parts: int) -> np.ndarray:
    """Parts of hashed heads; anchors have small hashes, so these are mixed once more to deal them out evenly."""
    return (((mix(heads) >> _U(16)) * _U(parts)) >> _U(48)).astype(np.int64)


def sorted_runs(parts: int, length: int):
    """Rows (part, kind, data) of rows (doc, tag, text): sorted runs (kind 0), and places that a smaller document
    of the same slice covers (kind 1), so that a form comes once from a slice however many documents hold it."""

    def rows(entries, h):
        e = _joined(entries)
        entries.clear()
        part = part_of(np.concatenate(h), parts)
        o = np.lexsort((e[4], e[3], e[2], e[1], e[0], part))
        e, part = tuple(c[o] for c in e), part[o]
        begin = np.flatnonzero(_begins(e[0], e[1], e[2]))
        later = e[3] > np.repeat(e[3][begin], np.diff(np.append(begin, len(part))))
        kinds = (0, ~later), (1, later)
        for kind, chosen in kinds:
            own, p = tuple(c[chosen] for c in e), part[chosen]
            at = np.append(np.flatnonzero(_begins(p)), len(p)).tolist()
            data = [pack_run(*(c[a:z] for c in own)) for a, z in zip(at, at[1:])]
            if data:
                yield pa.RecordBatch.from_arrays([pa.array(p[at[:-1]].astype(np.int32)), pa.array(np.full(len(data), kind, np.int32)), pa.array(data, pa.binary())], ["part", "kind", "data"])

    def run(batches):
        entries, h, size = [], [], 0
        for b in batches:
            for doc, tag, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data = text.as_buffer().to_pybytes()
                k1, k2, form, hashed, place, first, last = anchors(data, length)
                entries.append((k1, k2, form, np.full(len(k1), doc, np.int64), pack_place(tag, first, last - first + 1, place - first)))
                h.append(hashed)
                size += len(data)
                if size >= SLICE:
                    yield from rows(entries, h)
                    entries, h, size = [], [], 0
        if entries:
            yield from rows(entries, h)

    return run


FOUND = "kind int, part int, doc long, place long, key long, data binary"


def merge_scan(with_level: bool):
    """From rows (part, runs, old levels): covered places (kind 0), suffixes with a common head and other bytes
    (kind 1 new, 2 old), and the part's new sorted suffixes (kind 3)."""

    def found(kind, part, doc, place, key=None, data=None):
        n = len(doc)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array(key, pa.int64()) if key is not None else pa.nulls(n, pa.int64()), pa.array(data, pa.binary()) if data is not None else pa.nulls(n, pa.binary())], [f.split(" ")[0] for f in FOUND.split(", ")])

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                part, runs, *levels = (c[k].as_py() for c in b.columns)
                for r in runs:
                    if r["kind"] == 1:
                        *_, doc, place = unpack_run(r["data"])
                        yield found(0, part, doc, place)
                new = _joined([unpack_run(r["data"]) for r in runs if r["kind"] == 0])
                if not len(new[0]):
                    continue
                old = _joined([unpack_run(x) for x in levels if x])
                # documents of the levels are smaller than all of the batch
                e = _joined([old, new])
                o = np.lexsort((e[4], e[3], e[2], e[1], e[0]))
                e, is_new = tuple(c[o] for c in e), o >= len(old[0])
                begins = _begins(e[0], e[1], e[2])
                begin = np.flatnonzero(begins)
                count = np.diff(np.append(begin, len(o)))
                low = np.repeat(e[3][begin], count)
                covered = is_new & (e[3] > low)
                yield found(0, part, e[3][covered], e[4][covered])
                keys = np.flatnonzero(_begins(e[0], e[1]))
                size = np.diff(np.append(keys, len(o)))
                forms = np.add.reduceat(begins.astype(np.int64), keys)
                fresh = np.repeat(is_new[begin], count)
                some = np.add.reduceat(fresh.astype(np.int64), keys) > 0
                open_ = np.repeat((forms > 1) & some, size)
                key = mix(mix(e[0]) ^ e[1]).view(np.int64)
                for kind, chosen in ((1, open_ & is_new & ~covered & fresh), (2, open_ & ~is_new & begins)):
                    yield found(kind, part, e[3][chosen], e[4][chosen], key[chosen])
                if with_level:
                    own = begins & is_new
                    if own.any():
                        yield found(3, part, [0], [0], None, [pack_run(*(c[own] for c in e))])

    return run


def contexts(length: int):
    """Rows (key, suffix, left, doc, place, fresh) of rows (doc, tag, text, wanted): the bytes from the anchor on,
    as far as a window goes, and those before it, the nearest first."""

    def run(batches):
        for b in batches:
            docs, tags, texts, wanted = b.columns
            at, inner = wanted.offsets.to_numpy() - wanted.offsets[0].as_py(), wanted.flatten()
            places, keys, fresh = (inner.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            out = {k: [] for k in ("key", "suffix", "left", "doc", "place", "fresh")}
            for k, (doc, tag) in enumerate(zip(docs.to_pylist(), tags.to_pylist())):
                own = slice(at[k], at[k + 1])
                of, first, windows, lead = unpack_place(places[own])
                ok = of == tag
                if not ok.any():
                    continue
                data = texts[k].as_buffer()
                data = memoryview(data)
                ends = np.minimum(first + lead + length, first + windows - 1 + length)
                for f, l, z in zip(first[ok].tolist(), lead[ok].tolist(), ends[ok].tolist()):
                    out["suffix"].append(bytes(data[f + l : z]))
                    out["left"].append(bytes(data[f : f + l])[::-1])
                out["key"].append(keys[own][ok])
                out["place"].append(places[own][ok])
                out["fresh"].append(fresh[own][ok])
                out["doc"].append(np.full(int(ok.sum()), doc, np.int64))
            if out["key"]:
                cols = [pa.array(np.concatenate(out[c])) if c not in ("suffix", "left") else pa.array(out[c], pa.binary()) for c in out]
                yield pa.RecordBatch.from_arrays(cols, list(out))

    return run


CONTEXTS = "key long, suffix binary, left binary, doc long, place long, fresh boolean"


def _matrix(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes, padded with zeros, and their lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size, data = np.diff(offsets), np.frombuffer(column.buffers()[2] or b"", np.uint8)
    m = np.zeros((len(column), width), np.uint8)
    row = np.repeat(np.arange(len(column)), size)
    m[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = data[offsets[0] : offsets[-1]]
    return m, size


def _left_hashes(m: np.ndarray) -> np.ndarray:
    """Column l: a hash of the l nearest bytes to the left."""
    out = np.zeros((len(m), m.shape[1] + 1), np.uint64)
    np.cumsum((m.astype(np.uint64) + _U(1)) * mix(np.arange(1, m.shape[1] + 1, dtype=np.uint64)), axis=1, out=out[:, 1:])
    return out


def agreeing_windows(length: int):
    """Rows (doc, place, mask) from suffixes sorted by key and bytes: the windows that a smaller document has.

    Suffixes that share the next ``length - l`` bytes are neighbours whose common prefixes are all that long;
    those of them whose l bytes to the left are equal too hold one window."""

    def run(batches):
        most = length - HEAD
        for t, starts in whole_groups(batches, ["key"]):
            m, size = _matrix(t["suffix"], length)
            left, _ = _matrix(t["left"], most)
            doc, place, fresh = t["doc"].to_numpy(), t["place"].to_numpy(), t["fresh"].to_numpy(zero_copy_only=False)
            _, _, windows, lead = unpack_place(place)
            common = np.zeros(len(doc), np.int64)
            same = m[1:] == m[:-1]
            common[1:] = np.where(same.all(axis=1), length, same.argmin(axis=1))
            common[1:] = np.minimum(common[1:], np.minimum(size[1:], size[:-1]))
            common[starts] = 0
            hashes, mask = _left_hashes(left), np.zeros(len(doc), np.int64)
            for l in range(most + 1):
                rows = np.flatnonzero((l <= lead) & (lead - l < windows))
                if not len(rows):
                    continue
                block = np.cumsum(common < length - l)[rows].astype(np.uint64)
                which = mix(mix(block) ^ hashes[rows, l])
                o = np.lexsort((doc[rows], which))
                begin = _begins(which[o])
                least = np.repeat(doc[rows][o][begin], np.diff(np.append(np.flatnonzero(begin), len(o))))
                hit = rows[o][least < doc[rows][o]]
                mask[hit] |= np.int64(1) << (lead[hit] - l)
            keep = (mask != 0) & fresh
            yield _table(["doc", "place", "mask"], doc[keep], place[keep], mask[keep])

    return run


def single_windows(length: int):
    """Rows (window, doc, place, bit, fresh): every window of suffixes whose head is a hot one."""

    def run(batches):
        most = length - HEAD
        for b in batches:
            if not b.num_rows:
                continue
            c = dict(zip(b.schema.names, b.columns))
            m, _ = _matrix(c["suffix"], length)
            left, _ = _matrix(c["left"], most)
            right, hashes = _left_hashes(m), _left_hashes(left)
            _, _, windows, lead = unpack_place(c["place"].to_numpy())
            key, doc, place, fresh = (c[k].to_numpy(zero_copy_only=False) for k in ("key", "doc", "place", "fresh"))
            for l in range(most + 1):
                r = np.flatnonzero((l <= lead) & (lead - l < windows))
                w = mix(mix(right[r, length - l] ^ mix(key[r].view(np.uint64))) + hashes[r, l] * _U(3) + _U(l))
                yield _table(["window", "doc", "place", "bit", "fresh"], w.view(np.int64), doc[r], place[r], lead[r] - l, fresh[r])

    return run


def merged_spans(places: np.ndarray, masks: np.ndarray, tag: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the marked windows cover, of the text with this tag."""
    of, first, windows, _ = unpack_place(places)
    whole = (of == tag) & (masks == WHOLE)
    a, z = [first[whole]], [first[whole] + windows[whole] - 1 + length]
    part = np.flatnonzero((of == tag) & (masks != WHOLE))
    if len(part):
        row, bit = np.nonzero((masks[part][:, None] >> np.arange(length)) & 1)
        a.append(first[part][row] + bit)
        z.append(a[-1] + length)
    a, z = np.concatenate(a), np.concatenate(z)
    if not len(a):
        return []
    o = np.argsort(a, kind="stable")
    a, z = a[o], np.maximum.accumulate(z[o])
    new = np.flatnonzero(np.append(True, a[1:] > z[:-1]))
    return list(zip(a[new].tolist(), z[np.append(new[1:], len(a)) - 1].tolist()))


class SuffixFamily:
    """An index family in a folder: texts of each batch, and levels of sorted sparse suffixes.

    The folder's manifest names the current segments and levels; opening a folder that has one goes on from
    there, in this session or a later one. The number of parts follows the bytes of the largest batch so far."""

    def __init__(self, spark: SparkSession, root: str, length: int = LENGTH):
        self.spark, self.root, self.length, self.version = spark, root.rstrip("/"), length, 0
        self.segments: list[tuple[int, int, int, str]] = []  # smallest and largest id, buckets, name
        self.levels: list[tuple[int, str]] = []  # batches, name
        self.parts = 0
        self.tables: dict[str, DataFrame] = {}
        try:
            rows = spark.read.parquet(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        rows = rows.filter(F.col("version") == rows.agg(F.max("version")).first()[0]).orderBy("position").collect()
        self.version = rows[0].version
        for r in rows:
            if r.kind == "segment":
                self.segments.append((r.low, r.high, r.n, r.name))
            elif r.kind == "level":
                self.levels.append((r.n, r.name))
            else:
                self.parts, self.length = r.n, r.low

    def _keep_manifest(self) -> None:
        self.version += 1
        rows = [(self.version, -1, "parts", "", self.length, 0, self.parts)]
        rows += [(self.version, k, "segment", name, low, high, n) for k, (low, high, n, name) in enumerate(self.segments)]
        rows += [(self.version, k, "level", name, 0, 0, size) for k, (size, name) in enumerate(self.levels)]
        self.spark.createDataFrame(rows, "version int, position int, kind string, name string, low long, high long, n long").coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def segment(self, k: int) -> DataFrame:
        """(doc, tag, text, row) of a batch, bucketed and sorted by doc: joins on doc leave its texts where they are."""
        _, _, n, name = self.segments[k]
        if name not in self.tables:
            schema = self.spark.read.parquet(f"{self.root}/{name}").schema
            cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            table = f"caselake_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {table} ({cols}) USING parquet CLUSTERED BY (doc) SORTED BY (doc) INTO {n} BUCKETS LOCATION '{self.root}/{name}'")
            self.tables[name] = self.spark.table(table)
        return self.tables[name]

    def _deal_levels(self, parts: int) -> None:
        """Levels in more parts, for a batch that is larger than those before, so that no part of it grows with it."""
        for k, (size, old) in enumerate(self.levels):
            name = f"level_{uuid.uuid4().hex[:12]}"
            dealt = self.level(old).mapInArrow(released(dealt_levels(parts)), "part int, data binary").groupBy("part").agg(F.collect_list("data").alias("runs"))
            dealt.mapInArrow(released(merge_levels), "part int, data binary").write.option("compression", "none").parquet(f"{self.root}/{name}")
            self.levels[k] = (size, name)
        self.parts = parts

    def level(self, name: str) -> DataFrame:
        return self.spark.read.schema("part int, data binary").parquet(f"{self.root}/{name}")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: bool = True) -> tuple[int, DataFrame] | None:
        """(number of the batch's segment, (doc, covered) of its documents with repeats) of one more batch.

        covered is an array of (place, mask) for ``merged_spans``. Rows with a null id or text, or with less bytes
        than a window, are not in the segment; None says that there are no others. Ids must be larger than those of
        earlier batches, else ValueError. Rows with one id are judged each by its own text (tag tells these
        apart), against smaller ids only; equal rows get equal results. With index=False the batch is scanned
        but no level of it is left behind."""
        spark, n = self.spark, shuffle_partitions(self.spark)
        scratch = Scratch(spark)
        rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
        x = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"), rest.alias("row")).filter(f"doc IS NOT NULL AND octet_length(text) >= {self.length}")
        name = f"segment_{uuid.uuid4().hex[:12]}"
        tag = F.dense_rank().over(Window.partitionBy("doc").orderBy(F.xxhash64("text"))) - 1
        table = f"caselake_{name}"
        (x.repartition(n, "doc").select("doc", tag.alias("tag"), "text", "row").write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/{name}")
         .bucketBy(n, "doc").sortBy("doc").saveAsTable(table))
        scratch.free()
        low, high, size, most = spark.table(table).agg(F.min("doc"), F.max("doc"), F.sum(F.octet_length("text")), F.max("tag")).first()
        if low is None:
            spark.sql(f"DROP TABLE {table}")
            return None
        if self.segments and low <= max(s[1] for s in self.segments):
            raise ValueError("ids of a batch must be larger than those of earlier batches")
        if most >= TEXTS_OF_ID:
            raise ValueError(f"more than {TEXTS_OF_ID} different texts have one id")
        parts, few = max(1, size // PART_BYTES), files_of(size, FILE_BYTES)
        if parts > 2 * self.parts:
            self._deal_levels(parts)
        self.tables[name] = spark.table(table)
        self.segments.append((low, high, n, name))
        runs = self.tables[name].select("doc", "tag", "text").mapInArrow(released(sorted_runs(self.parts, self.length)), "part int, kind int, data binary")
        # dealt out first, so that lists are only made where they are used
        scanned = runs.repartition(n, "part").groupBy("part").agg(F.collect_list(F.struct("kind", "data")).alias("runs"))
        for k, (_, level) in enumerate(self.levels):
            scanned = scanned.join(self.level(level).withColumnRenamed("data", f"old{k}"), "part", "left")
        found = f"{scratch.root}/found"
        scanned.mapInArrow(released(merge_scan(index)), FOUND).write.option("compression", "zstd").partitionBy("kind").parquet(found)
        scratch.free()
        found = spark.read.schema(FOUND).parquet(found)
        fetched, wanted = None, found.filter("kind IN (1, 2)").select("doc", "place", "key", (F.col("kind") == 1).alias("fresh"))
        for k, (low, high, _, _) in enumerate(self.segments):
            own = wanted.filter(F.col("doc").between(low, high)).groupBy("doc").agg(F.collect_list(F.struct("place", "key", "fresh")).alias("wanted"))
            own = self.segment(k).select("doc", "tag", "text").join(own.hint("merge"), "doc").select("doc", "tag", "text", "wanted").mapInArrow(released(contexts(self.length)), CONTEXTS)
            fetched = own if fetched is None else fetched.union(own)
        fetched = scratch.save(fetched, "contexts", few)
        scratch.free()
        hot_keys = scratch.save(wanted.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("key"), "hot", few)
        hot = not hot_keys.isEmpty()
        scratch.free()
        usual = fetched.join(hot_keys, "key", "left_anti").select(*fetched.columns) if hot else fetched
        settled = usual.repartition(n, "key").sortWithinPartitions("key", "suffix").mapInArrow(released(agreeing_windows(self.length)), "doc long, place long, mask long")
        if hot:
            one = fetched.join(hot_keys, "key", "left_semi").select(*fetched.columns).mapInArrow(released(single_windows(self.length)), "window long, doc long, place long, bit long, fresh boolean")
            one = scratch.save(one, "windows")
            least = one.groupBy("window").agg(F.min("doc").alias("least"))
            one = one.filter("fresh").join(least, "window").filter("least < doc").select("doc", "place", F.expr("shiftleft(1L, cast(bit as int))").alias("mask"))
            settled = settled.union(one)
        covered = found.filter("kind = 0").select("doc", "place", F.lit(WHOLE).cast("long").alias("mask")).union(settled)
        covered = scratch.save(covered.groupBy("doc").agg(F.collect_list(F.struct("place", "mask")).alias("covered")), "covered", few)
        scratch.drop("contexts")
        if hot:
            scratch.drop("windows")
        if index:
            name = f"level_{uuid.uuid4().hex[:12]}"
            found.filter("kind = 3").select("part", "data").write.option("compression", "none").parquet(f"{self.root}/{name}")
            self.levels.append((1, name))
            while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
                (size, a), (_, b) = self.levels.pop(), self.levels.pop()
                name = f"level_{uuid.uuid4().hex[:12]}"
                both = self.level(a).union(self.level(b)).groupBy("part").agg(F.collect_list("data").alias("runs"))
                both.mapInArrow(released(merge_levels), "part int, data binary").write.option("compression", "none").parquet(f"{self.root}/{name}")
                self.levels.append((2 * size, name))
            self._keep_manifest()
        scratch.drop("found")
        return len(self.segments) - 1, covered


def dealt_levels(parts: int):
    """Rows (part, data) of a level, each split by the parts that its heads fall into."""

    def run(batches):
        place = powers(HEAD)
        for b in batches:
            for data in b.column(1).to_pylist():
                e = unpack_run(data)
                heads = np.stack(e[:2], axis=1).astype(">u8").view(np.uint8).reshape(-1, HEAD)
                part = part_of(mix((BYTE_CODE[heads] * place).sum(axis=1, dtype=np.uint64)), parts)
                o = np.argsort(part, kind="stable")
                at = np.append(np.flatnonzero(_begins(part[o])), len(o)).tolist()
                for a, z in zip(at, at[1:]):
                    yield pa.RecordBatch.from_arrays([pa.array([part[o[a]]], pa.int32()), pa.array([pack_run(*(c[o[a:z]] for c in e))], pa.binary())], ["part", "data"])

    return run


def merge_levels(batches):
    """One sorted array of each part, of every form the smallest document."""
    for b in batches:
        for part, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            e = _sorted(_joined([unpack_run(r) for r in runs]))
            begin = _begins(e[0], e[1], e[2])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack_run(*(c[begin] for c in e))], pa.binary())], ["part", "data"])


def cut_repeats(docs: DataFrame, scratch: Scratch, finish, finish_schema: str, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, length: int = LENGTH, family: SuffixFamily | None = None) -> DataFrame:
    """Every row with what finish(text bytes, merged spans) makes; the text itself goes.

    Spans cover every byte of a ``length``-byte string which also starts in a document with a smaller id. A row
    without spans (null ids, null, empty and short texts among them) is finished with an empty list. Rows with
    one id are judged each by its own text against smaller ids. An empty table stays empty. Result columns
    replace columns of the input with their names; all other columns stay as they are, whatever their names.
    With a family, its documents count as earlier ones, and these batches are added to it."""
    spark = docs.sparkSession
    made = [f.strip().split(" ")[0] for f in finish_schema.split(",")]
    rest = [c for c in docs.columns if c != text_col and c not in made]
    keep_index = family is not None
    family = family or SuffixFamily(spark, f"{scratch.root}/family", length)
    ids = F.col(f"`{id_col}`").cast("long")
    borders = sorted(set(docs.select(ids.alias("doc")).approxQuantile("doc", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in rest]).schema.fields), finish_schema])
    arrow = [to_arrow_type(f.dataType) for f in spark.createDataFrame([], finish_schema).schema.fields]

    def finished(b, spans):
        rows = [finish(t.as_buffer().to_pybytes() if t.is_valid else b"", s) for t, s in zip(b.column(b.num_columns - 1), spans)]
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate(arrow)]

    def free(parts):
        for b in parts:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*s.columns[:-1], *finished(s, [[]] * s.num_rows)], [*rest, *made])

    def held(parts):
        for b in parts:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                spans = []
                for tag, own in zip(s.column(1).to_pylist(), s.column(2)):
                    own = own.values if own.is_valid else None
                    spans.append(merged_spans(own.field(0).to_numpy(), own.field(1).to_numpy(), tag, length) if own is not None and len(own) else [])
                row = dict(zip([f.name for f in s.schema.field(0).type], s.column(0).flatten()))
                yield pa.RecordBatch.from_arrays([*(row[c] for c in rest), *finished(s, spans)], [*rest, *made])

    text = F.col(f"`{text_col}`")
    out = docs.filter(ids.isNull() | text.isNull() | (F.octet_length(text) < length)).select(*[f"`{c}`" for c in rest], text).mapInArrow(released(free), out_schema)
    edges = [None, *borders, None]
    for k in range(len(edges) - 1):
        batch = docs
        if edges[k] is not None:
            batch = batch.filter(ids >= edges[k])
        if edges[k + 1] is not None:
            batch = batch.filter(ids < edges[k + 1])
        got = family.add(batch, id_col, text_col, index=keep_index or k < len(edges) - 2)
        if got:
            segment = family.segment(got[0]).join(got[1].hint("merge"), "doc", "left").select("row", "tag", "covered", "text")
            out = out.union(segment.mapInArrow(released(held), out_schema))
    return out


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def digest(data: bytes, spans: list[tuple[int, int]]):
    return len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept(data, spans)).hexdigest()


def kept_characters(data: bytes, spans: list[tuple[int, int]]) -> str:
    """The text that is left; a character of which only a part is covered stays whole."""
    whole = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b < len(data) and b > a and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            whole.append((a, b))
    return kept(data, whole).decode()


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row. Null texts count as empty; repeated ids are
    judged each by its own text; a row with a null id keeps all; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cut_repeats(docs, Scratch(spark), digest, DIGEST)


SQL: dict[str, str] = {}
QUERIES = {"op3_suffix_array_dedup": op3_suffix_array_dedup}
