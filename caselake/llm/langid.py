"""Language ID by compression: the language whose text helps most to compress a document is its language.

A raw-content zstandard dictionary for each language is filled from labelled text. A document is encoded in
blocks with each dictionary; the smallest total size wins. A narrow margin to the second size is a rejection.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import released, slices

DICT_BYTES = 64 * 1024  # of a language; bounds what the driver and each task hold: languages x this
PIECE_CHARS = 256  # labelled text is drawn in pieces of so many characters
SAMPLE_DOCS = 4000  # expected number of different labelled texts of a language that pieces are drawn from
BLOCK_BYTES = 64 * 1024
LEVEL = 6
MIN_MARGIN = 0.002  # of the second size
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dict_bytes: int = DICT_BYTES, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """lang -> raw dictionary, from (text, lang) rows; rows with a null in either, or no text, teach nothing.

    The sample is bounded by dict_bytes a language: pieces with the smallest hashes out of about sample_docs
    different texts a language, chosen by their hashes, so equal tables give equal dictionaries however many
    copies a text has. A language with no more than sample_docs different texts gives them all."""
    x = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL AND text <> ''")
    x = x.withColumn("h", F.xxhash64("text"))
    counts = {r.lang: r.n for r in x.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, sample_docs / n))])
    x = x.filter(F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    x = x.select("lang", F.explode(F.expr(f"transform(sequence(1, length(text), {PIECE_CHARS}), i -> substr(text, i, {PIECE_CHARS}))")).alias("piece"))
    x = x.withColumn("h", F.xxhash64("piece", F.lit(7))).dropDuplicates(["lang", "h"])
    keep = max(1, dict_bytes // PIECE_CHARS)
    rows = x.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))).filter(F.col("k") <= keep)
    parts: dict[str, list[bytes]] = {}
    for r in rows.orderBy("lang", "k").collect():
        parts.setdefault(r.lang, []).append(r.piece.lower().encode())
    return {k: b"\n".join(v)[:dict_bytes] for k, v in parts.items()}


def compressors(dictionaries: dict[str, bytes], level: int = LEVEL) -> list[tuple[str, object]]:
    import zstandard as z

    out = []
    for lang in sorted(dictionaries):
        d = z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((lang, z.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_dict_id=False)))
    return out


def has_letter(text: str) -> bool:
    """Whether a character is a letter (category L*); digits and number signs such as ² are none."""
    return any(map(str.isalpha, text))


def judge(text: str | None, by_lang: list[tuple[str, object]], min_margin: float = MIN_MARGIN) -> tuple[str, float, float, bool]:
    """(lang, score, margin, rejected) of a whole text, read in lower case."""
    if not by_lang or not text or not has_letter(text):
        return UNKNOWN, 0.0, 0.0, True
    low = text.lower().encode()
    blocks = [low[i : i + BLOCK_BYTES] for i in range(0, len(low), BLOCK_BYTES)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in by_lang)
    best, lang = sizes[0]
    if len(sizes) == 1:
        return lang, 1.0, 1.0, False
    score = 1.0 / sum(2.0 ** -min(64.0, (s - best) / 4.0) for s, _ in sizes)
    margin = (sizes[1][0] - best) / sizes[1][0]
    return lang, score, margin, margin < min_margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """Adds lang_pred, score (0 to 1), margin and rejected to every row; only the text is looked at.

    Null texts and texts without a letter get ``und``, score 0 and rejected. Ties go to the smaller language
    name and are rejected. With nothing learned all rows are ``und``. Columns with these names are replaced."""
    new = ["lang_pred", "score", "margin", "rejected"]
    x = docs.drop(*new)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields), "lang_pred string, score double, margin double, rejected boolean"])
    names, at = [*x.columns, *new], x.columns.index(text_col)

    def run(batches):
        by_lang = compressors(dictionaries)
        for b in slices(batches):
            got = [judge(t, by_lang, min_margin) for t in b.column(at).to_pylist()]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names)

    return x.mapInArrow(released(run), schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin, rejected) of every row. Null texts and texts without a letter are
    ``und`` with score 0; repeated rows get equal rows; an empty table gives none, a table without labels ``und``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    known = learn(docs.filter("NOT held_out").select("text", "lang"))
    return identify(docs.select("doc_id", "held_out", "text"), known).drop("text")


SQL: dict[str, str] = {}
QUERIES = {"op1_language_id": op1_language_id}
