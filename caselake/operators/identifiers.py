"""Health identifiers in free text: a scan over digit groups behind a two-letter prefix.

A prefix opens a window of 48 characters. The groups of digits in it are counted until they make 12; a date, an
amount or a business number ends the count, as these are never part of an identifier. Twelve digits with no
thirteenth behind are an identifier, any other number of three or more right behind the prefix a malformed one.
The scan is a Python function over one text; texts without a prefix and a digit don't reach it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that are read as C and as G, the window, business prefixes end in a letter and a dash.
C_LIKE = "CcСсϹϲΣσⅭⅽꓚ⊂"
G_LIKE = "GgΓγГгɡԌԍꓖℊ"
WINDOW = 48
REACH = WINDOW + 24  # the last group begins in the window and may go on beyond it
PREFIX = r"(?<![A-Za-z0-9])(?:C[\W_]?G|G[\W_]?C)(?![A-Za-z])"
MALFORMED = r"[\W_]{0,3}\d(?:[\W_]{0,3}\d){2,22}"
#: Digits that are something else: a date, an amount, a number behind money or a business prefix, a date set aside.
OTHERS = r"\d{4}-\d\d-\d\d|(?<![\d,])\d{1,3}(?:,\d{3})+(?!\d)|(?:₹|\brs\.?|\binr)\s{0,2}\d|[a-z]-\d|\ue000"

_FOLD = str.maketrans(C_LIKE + G_LIKE, "C" * len(C_LIKE) + "G" * len(G_LIKE))
_PREFIX, _MALFORMED = re.compile(PREFIX), re.compile(MALFORMED)
_STEP = re.compile(rf"(?i)(?P<other>{OTHERS})|(?P<digits>\d+)")
_THIRTEENTH = re.compile(r"[\W_]{0,3}\d")
SPANS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n in ("start", "end") else T.StringType()) for n in ("start", "end", "digits")]))


def _digits_from(folded: str, at: int) -> tuple[str, int] | None:
    """The twelve digits of the window that begins at ``at``, and where they end."""
    digits = ""
    for m in _STEP.finditer(folded, at, at + REACH):
        if m["other"] is not None or m.start() - at > WINDOW:
            return None
        digits += m["digits"]
        if len(digits) >= 12:
            return (digits, m.end()) if len(digits) == 12 and not _THIRTEENTH.match(folded, m.end()) else None
    return None


def _malformed_end(folded: str, at: int) -> int | None:
    tail = _MALFORMED.match(folded, at)
    if not tail:
        return None
    first = _STEP.search(folded, at, tail.end() + REACH)
    return tail.end() if first and first["digits"] is not None and folded[tail.end() : tail.end() + 1] != "\ue001" else None


def health_spans(text: str) -> list[tuple[int, int, str | None]]:
    """(start, end, twelve digits) of each identifier of a normalised text; digits are None for a malformed one."""
    folded, out, at = text.translate(_FOLD), [], 0
    for m in _PREFIX.finditer(folded):
        if m.start() < at:
            continue
        if found := _digits_from(folded, m.end()):
            out.append((m.start(), found[1], found[0]))
        elif (end := _malformed_end(folded, m.end())) is not None:
            out.append((m.start(), end, None))
        else:
            continue
        at = out[-1][1]
    return out


@F.pandas_udf(SPANS)
def _spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([[{"start": a, "end": z, "digits": d} for a, z, d in health_spans(t)] if isinstance(t, str) else None for t in s], dtype=object)


# so marked, projections before and after are not folded into one with it
_spans = _spans.asNondeterministic()


def spans_of(text: Column) -> Column:
    """array<struct(start, end, digits)> of a normalised text; places are code points, ends exclusive. Null for null."""
    # few texts hold a digit, so the long class is asked last
    near = text.rlike(r"\d") & text.rlike(f"[{C_LIKE}{G_LIKE}]")
    empty = F.array().cast(SPANS)
    return F.when(text.isNotNull(), F.when(near, F.coalesce(_spans(F.when(near, text)), empty)).otherwise(empty))


def masked_spans(text: Column, spans: Column, token: str = "[HEALTH_ID]") -> Column:
    """The text with each span replaced."""
    ends = F.concat(F.array(F.lit(0)), spans["end"])
    starts = F.concat(spans["start"], F.array(F.length(text)))
    return F.when(F.size(spans) > 0, F.array_join(F.zip_with(ends, starts, lambda a, z: F.substring(text, a + 1, z - a)), token)).otherwise(text)


class HealthIds:
    """Table function health_id_spans(text): (start, end, digits, is_valid) of each identifier of a normalised text."""

    def eval(self, text: str):
        for start, end, digits in health_spans(text or ""):
            yield start, end, digits, digits is not None and _check(digits)


def _check(digits: str) -> bool:
    from .hygiene import PLACES, PRODUCTS

    c = 0
    for k, d in enumerate(reversed(digits)):
        c = PRODUCTS[c * 10 + PLACES[(k % 8) * 10 + int(d)]]
    return c == 0


def register(spark: SparkSession) -> None:
    """Adds the table function to SQL: SELECT d.doc_id, h.* FROM docs d, LATERAL health_id_spans(d.text) h."""
    spark.udtf.register("health_id_spans", F.udtf(HealthIds, returnType="start: int, end: int, digits: string, is_valid: boolean"))


def health_ids(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, one for each identifier, with start, end, digits; columns of these names are replaced."""
    from .hygiene import normalize_text

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("start", "end", "digits")]
    x = docs.select(F.struct(*kept).alias("row"), spans_of(normalize_text(F.col(f"`{text}`"))).alias("spans"))
    return x.select("row", F.inline("spans")).select("row.*", "start", "end", "digits")
