"""Media columns: interleaved document sequences with payloads kept once in a media table.

HTML is read into an ordered list of items, text or a media reference with its caption; a reference names
its payload by digest (``media:sha256/<hex>``). Payloads stand in a media table in their stored form, a
binary grey-map image (P5) of 64 samples a row, 8 bits each. A join on the digest gives each reference its
payload's facts while position and caption stay on the item, so they cannot drift apart.
"""

from __future__ import annotations

import hashlib
import zlib

from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_texts, row_hash, slices

ROW = 64
SALTS = 4  # of references to one payload
SCHEME = "media:sha256/"
SILENT = ("script", "style", "template", "noscript")
BLOCKS = ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "article", "section", "td", "tr", "title", "footer", "nav")
ITEM = "array<struct<position:int, kind:string, text:string, digest:string, caption:string>>"
_ITEM = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))


class _Reader(HTMLParser):
    """Items in reading order. A figure's caption goes to the media of that figure, else alt is the caption.

    A caption ends with its end tag, its figure, the next caption or figure, or the input; where its figure has
    no media, or there is no figure, it is a text item in its place."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.silent, self.caption, self.figures = [], [], 0, None, []

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def close_caption(self):
        if self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            if text:
                item = {"kind": "text", "text": text, "digest": None, "caption": None}
                self.items.append(item)
                if self.figures:
                    self.figures[-1]["captions"].append(item)

    def close_figure(self):
        figure = self.figures.pop()
        if figure["media"] and figure["captions"]:
            for x in figure["media"]:
                x["caption"] = " ".join(c["text"] for c in figure["captions"])
            for c in figure["captions"]:
                c["kind"] = None

    def finish(self) -> list[dict]:
        self.close()
        self.close_caption()
        self.flush()
        while self.figures:
            self.close_figure()
        return [x for x in self.items if x["kind"]]

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag in ("img", "video", "audio", "source"):
            a = dict(attrs)
            if a.get("src"):
                self.flush()
                src = a["src"]
                self.items.append({"kind": "media", "text": None if src.startswith(SCHEME) else src, "digest": src[len(SCHEME):] if src.startswith(SCHEME) else None, "caption": a.get("alt")})
                if self.figures:
                    self.figures[-1]["media"].append(self.items[-1])
        elif tag == "figure":
            self.close_caption()
            self.flush()
            self.figures.append({"media": [], "captions": []})
        elif tag == "figcaption":
            self.close_caption()
            self.flush()
            self.caption = []
        elif self.caption is not None and tag in BLOCKS:
            self.caption.append(" ")
        elif tag in BLOCKS:
            self.flush()

    def handle_startendtag(self, tag, attrs):
        if tag not in SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption":
            self.close_caption()
        elif tag == "figure":
            self.close_caption()
            self.flush()
            if self.figures:
                self.close_figure()
        elif self.caption is not None and tag in BLOCKS:
            self.caption.append(" ")
        elif tag in BLOCKS and tag != "br":
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def read_items(html: str) -> list[dict]:
    r = _Reader()
    r.feed(html)
    return [{"position": k} | x for k, x in enumerate(r.finish())]


def interleave(df: DataFrame, html_col: str = "html", out: str = "items") -> DataFrame:
    """Replaces html by items, the ordered text and media references. Null or empty html has no items."""
    rest = [c for c in df.columns if c not in (html_col, out)]
    x = df.select(*rest, html_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields[:-1]), f"`{out}` {ITEM}"])

    def run(batches):
        for b in slices(batches):
            items = [read_items(t.decode("utf-8", "replace")) for t in byte_texts(b.column(len(rest)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(items, _ITEM)], [*rest, out])

    return x.mapInArrow(run, schema)


def padded(text: bytes) -> bytes:
    return text + bytes(ROW - len(text) % ROW if len(text) % ROW or not text else 0)


def to_image(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def from_image(stored: bytes) -> bytes:
    kind, size, depth, samples = stored.split(b"\n", 3)
    w, h = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(samples) != w * h:
        raise ValueError("not a whole 8-bit grey map")
    return samples


def feature(payload: bytes) -> str:
    """Sixteen-bin histogram, mean and a 64-bit sign code of column means against the overall mean."""
    a = np.frombuffer(payload, np.uint8)
    bins = np.bincount(a >> 4, minlength=16)
    columns = a.reshape(-1, ROW).sum(axis=0, dtype=np.int64) * ROW
    code = np.packbits(columns > int(a.sum(dtype=np.int64))).tobytes().hex()
    return f"hist={'.'.join(map(str, bins))};mean={int(a.sum(dtype=np.int64)) * 1000 // len(a)};cols={code}"


def media_table(texts: DataFrame, scratch: Scratch, text_col: str = "text", name: str = "media") -> DataFrame:
    """Writes (digest, n_bytes, stored) of whole texts, each text once a task, and returns the written table."""

    def run(batches):
        seen: set[bytes] = set()
        for b in slices(batches):
            rows = []
            for t in byte_texts(b.column(0)):
                key = hashlib.sha256(t).digest()
                if key not in seen:
                    seen.add(key)
                    rows.append((key.hex(), len(t), to_image(padded(t))))
            yield pa.RecordBatch.from_pydict({"digest": pa.array([r[0] for r in rows], pa.string()), "n_bytes": pa.array([r[1] for r in rows], pa.int64()), "stored": pa.array([r[2] for r in rows], pa.binary())})

    return scratch.save(texts.select(text_col).mapInArrow(run, "digest string, n_bytes long, stored binary"), name)


FACTS = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def facts(media: DataFrame) -> DataFrame:
    """One row a digest, from the stored bytes read back."""

    def run(batches):
        for b in slices(batches):
            rows = []
            for key, n, stored in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                p = from_image(stored)
                rows.append((key, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(p)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 8, [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])], ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("digest", "n_bytes", "stored").mapInArrow(run, FACTS).dropDuplicates(["digest"])


def resolve(sequences: DataFrame, media_facts: DataFrame, items: str = "items") -> DataFrame:
    """One row an item, in the order of position, with the facts of its payload; null where there is none.

    A row without items stays as one row with a null position. Columns of items and facts replace columns of the
    input with their names, the others stay; a digest that is not in the media table keeps its position and
    caption. References are salted and each payload's facts are there for every salt, so a payload that many
    documents name (an empty one, a logo) does not come to one task."""
    made = {"position", "kind", "text", "digest", "caption", items, *media_facts.columns}
    rest = F.struct(*[F.col(f"`{c}`") for c in sequences.columns if c not in made]).alias("row")
    rows = sequences.select(rest, F.explode_outer(F.col(f"`{items}`")).alias("item")).select("row", "item.*")
    rows = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    facts = media_facts.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    # a row without a digest meets nothing, so it gets a key of its own
    rows = rows.withColumn("at", F.coalesce("digest", F.concat(F.lit("-"), row_hash(rows, "row", "position").cast("string"))))
    joined = rows.join(facts.withColumnRenamed("digest", "at"), ["at", "salt"], "left")
    return joined.select("row.*", "position", "kind", "text", "digest", "caption", *[c for c in media_facts.columns if c != "digest"])


def document_figures(docs: DataFrame) -> DataFrame:
    """(doc_id, html): a figure that names the whole text's payload by digest."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return docs.select("doc_id", F.concat(F.lit(f'<figure><img src="{SCHEME}'), digest, F.lit('"><figcaption>document '), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("</figcaption></figure>")).alias("html"))


def op6_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position,
    caption) of every row. Null and empty texts are one payload of 64 zeros; equal texts share a payload; repeated
    ids keep a row each; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = media_table(docs, Scratch(spark))
    rows = resolve(interleave(document_figures(docs)), facts(stored))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


SQL: dict[str, str] = {}
QUERIES = {"op6_media_sequences": op6_media_sequences}
__all__ = ["interleave", "resolve", "media_table", "facts", "read_items", "to_image", "from_image", "feature", "padded", "op6_media_sequences"]
