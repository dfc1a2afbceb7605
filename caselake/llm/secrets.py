"""Secret scans: fixed shapes, and character Markov models that tell random strings from ordinary identifiers.

The base finds assignments, access keys and runs of hex digits. Beside it every other long token is judged by two
chains over characters: one of random strings, one of ordinary words and identifiers. Both are counted by Spark
from labelled samples: what the base finds in a bounded sample of different texts, and generated strings of stated
alphabets, are random; the tokens of these texts outside the base's finds, and identifiers made of their words, are ordinary. A token whose mean
log-likelihood ratio reaches a threshold is a find of kind ``random``. The models are two tables of 68 x 67
numbers, whatever the input; texts are scanned whole, each in its own row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, slices

# Fixed values of the contract: kinds in their order, patterns, least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LENGTH = 12
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
HEX = re.compile("[0-9a-f]{16,}")
WORDS_OF_ASSIGN = ("password", "passwd", "secret", "token", "api")

KINDS = ("assign", "access", "hex", "random")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN_LENGTH = 16  # shorter tokens are not judged: too few characters tell
TOKEN = re.compile("[A-Za-z0-9+/_=-]{%d,}" % TOKEN_LENGTH)
SAMPLE_TOKEN = re.compile("[A-Za-z0-9+/_=-]{4,}")
WORD = re.compile("[A-Za-z]{3,}")
SAMPLE_DOCS = 4000  # different texts that the models learn from, at most
GENERATED = 4000  # strings of each alphabet that the model of random strings learns from
SMOOTHING = 0.5
UNSEEN = 0.1  # weight of a character's own frequency, for steps that the sample doesn't hold
THRESHOLD = 1.0  # mean log-likelihood ratio a character, natural logarithm

_CODE = np.full(128, 255, np.uint8)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
_START = len(ALPHABET)
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base's finds, sorted; ends are exclusive, places are code points."""
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    low = text.lower()
    if any(w in low for w in WORDS_OF_ASSIGN):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    return sorted(out)


def _outside(spans: list[tuple[int, int, int]], start: int, end: int) -> bool:
    """Whether no span covers the whole of start..end."""
    return not any(s <= start and end <= e for s, _, e in spans)


def _pairs(token: str) -> np.ndarray:
    """Numbers of the token's steps (character before, character), the first one from the start."""
    c = _CODE[np.frombuffer(token.encode("ascii"), np.uint8)].astype(np.int64)
    return np.concatenate(([_START], c[:-1])) * len(ALPHABET) + c


def _counted(tokens: list[str]) -> np.ndarray:
    """How often each step occurs in tokens."""
    c = _CODE[np.frombuffer(("\n".join(["", *tokens])).encode("ascii"), np.uint8)].astype(np.int64)
    before, after = c[:-1], c[1:]
    inner = after != 255
    return np.bincount(np.where(before == 255, _START, before)[inner] * len(ALPHABET) + after[inner], minlength=(_START + 1) * len(ALPHABET))


def _styled(text: str) -> list[str]:
    """Identifiers as code has them, of neighbouring words: camelCase, CONSTANT_CASE, snake_case, kebab-case, paths."""
    words = WORD.findall(text)
    pairs = list(zip(words, words[1:]))
    return [x for a, b in pairs for x in (a + b.capitalize(), f"{a}_{b}".upper(), f"{a}_{b}", f"{a}-{b}", f"{a}/{b}")]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of steps in texts: label 1 for what the base finds, 0 for the other tokens and for styled words."""
    for b in slices(batches):
        known: tuple[list[str], list[str]] = ([], [])
        for text in b.column("text").to_pylist():
            found = base_spans(text)
            values = {text[s:e] for s, k, e in found if k}
            values |= {m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH and "." not in m[2]}
            known[1].extend(sorted(values))
            known[0].extend(m[0] for m in SAMPLE_TOKEN.finditer(text) if not any(s < m.end() and m.start() < e for s, _, e in found))
            known[0].extend(_styled(text))
        n = np.stack([_counted(t) for t in known])
        label, step = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"label": pa.array(label, pa.int64()), "step": pa.array(step, pa.int64()), "n": pa.array(n[label, step])})


def _generated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same counts of generated strings, all of label 1."""
    for b in batches:
        n = _counted(b.column("token").to_pylist())
        step = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"label": pa.array(np.ones(len(step), np.int64)), "step": pa.array(step, pa.int64()), "n": pa.array(n[step])})


def random_strings(spark: SparkSession, n: int = GENERATED) -> DataFrame:
    """(token): strings of base64, base64 without punctuation, capitals with digits, and hex digits, n of each, from a fixed rule."""
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    plain = F.base64(F.unhex(digest))
    alphabets = (plain, F.translate(plain, "+/=", ""), F.upper(F.translate(plain, "+/=", "")), digest)
    return spark.range(n).select(F.explode(F.array(*alphabets)).alias("token"))


def learn(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """The table of log-likelihood ratios of steps, as a matrix (character before or start, character).

    Learns from the ``sample_docs`` different texts with the smallest hashes, copies once; null texts are left
    out. Without texts both chains are even but for the generated strings, and little is judged random."""
    spark = docs.sparkSession
    t = F.col(f"`{text}`")
    x = docs.select(t.alias("text"), F.xxhash64(t).alias("h")).filter("text IS NOT NULL")
    last = x.select("h").distinct().orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    counts = random_strings(spark).mapInArrow(_generated, "label long, step long, n long")
    if last is not None:
        sample = x.filter(F.col("h") <= last).groupBy("h").agg(F.min("text").alias("text")).select("text")
        counts = counts.union(sample.mapInArrow(_sampled, "label long, step long, n long"))
    n = np.full((2, len(ALPHABET) + 1, len(ALPHABET)), SMOOTHING)
    # at most 2 x 68 x 67 rows
    for r in counts.groupBy("label", "step").agg(F.sum("n").alias("n")).collect():
        n[r.label].flat[r.step] += r.n
    alone = n.sum(axis=1, keepdims=True) / n.sum(axis=(1, 2), keepdims=True)
    p = np.log((1 - UNSEEN) * n / n.sum(axis=2, keepdims=True) + UNSEEN * alone)
    return p[1] - p[0]


def score(token: str, ratios: np.ndarray) -> float:
    return float(ratios.reshape(-1)[_pairs(token)].mean())


def find_secrets(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, spans) of every row: spans hold kind, start, end (code points, exclusive) and, of kind random, the mean ratio.

    Sorted by start, then by kind in the order of KINDS. Null and empty texts have no spans, repeated rows equal
    ones; other columns are left out, whatever their names. A token that a base span covers is not judged; of
    other tokens outer ``+/_-`` and leading ``=`` are cut, and one without a letter is never random."""
    table = ratios.astype(np.float64)

    def judged(text: str) -> list[dict]:
        found = base_spans(text)
        out = [(s, k, e, None) for s, k, e in found]
        for m in TOKEN.finditer(text):
            token = m[0].rstrip("+/_-")
            end = m.start() + len(token)
            token = token.lstrip("+/_=-")
            start = end - len(token)
            if len(token) < TOKEN_LENGTH or not _outside(found, start, end) or not re.search("[A-Za-z]", token):
                continue
            value = score(token, table)
            if value >= threshold:
                out.append((start, 3, end, value))
        return [{"kind": KINDS[k], "start": s, "end": e, "score": v} for s, k, e, v in sorted(out, key=lambda r: r[:3])]

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([judged(t) if t else [] for t in b.column("text").to_pylist()], kind)], ["id", "spans"])

    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    out = given.mapInArrow(released(run), f"id {given.schema['id'].dataType.simpleString()}, spans {SPANS}")
    return out.select(F.col("id").alias(id_col), "spans")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, max_score) of every document; nulls, repeated rows and empty tables as in ``find_secrets``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs, learn(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    counts = [number(k) for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.array_max(F.transform("spans", lambda s: s["score"])).alias("max_score"))


#: Likelihoods have no SQL; tests hold the base against brute force and the models against held-out strings.
SQL: dict[str, str] = {}
QUERIES = {"op13_secret_scan": op13_secret_scan}
