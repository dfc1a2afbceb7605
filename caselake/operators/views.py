"""Views of a text that detectors read: letters set apart joined again, labelled dates in one form, sentences.

All native. Null texts stay null, empty ones empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.surrogate import table
from .hygiene import normalize_text

# Letters set apart, and dates behind a label that says from when something holds.
SPACED = r"(?<![A-Za-z0-9])(?:[A-Za-z][ ._-]){3,}[A-Za-z](?![A-Za-z0-9])"
LABELLED = (r"(?i)\b((?:effective(?:\s+date)?(?:\s+(?:on|from|of|is))?|starting(?:\s+(?:on|from))?|from|w\.?e\.?f\.?)\s{0,2}[:-]?\s{0,2})"
            r"(\d{1,2})([/.-])(\d{1,2})\3(\d{4})(?!\d)")


def replace_each(text: Column, pattern: str, make) -> Column:
    """The text with every match replaced by make(match); what lies between matches stays."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.array_join(F.zip_with(between, found, lambda b, m: F.concat(b, F.coalesce(make(m), F.lit("")))), "")


def collapse_letters(text: Column) -> Column:
    """Four or more single letters parted by one blank, dot, dash or low line each are joined to a word."""
    return F.when(text.rlike(SPACED), replace_each(text, SPACED, lambda m: F.regexp_replace(m, "[ ._-]", ""))).otherwise(text)


def detection_views(text: Column) -> Column:
    """struct(norm, collapsed)."""
    norm = normalize_text(text)
    return F.struct(norm.alias("norm"), collapse_letters(norm).alias("collapsed"))


def iso_effective_dates(text: Column) -> Column:
    """Labelled dates, day first, as year-month-day; those that are no date stay as they are."""

    def fix(m: Column) -> Column:
        day, month, year = (F.regexp_extract(m, LABELLED, k) for k in (2, 4, 5))
        date = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
        real = F.try_to_date(date, "yyyy-MM-dd").isNotNull() & (year != "0000")
        return F.when(real, F.concat(F.regexp_extract(m, LABELLED, 1), date)).otherwise(m)

    return F.when(text.rlike(LABELLED), replace_each(text, LABELLED, fix)).otherwise(text)


def merge_fields(found: Column, added: Column) -> Column:
    """Map of both; keys of ``found`` win."""
    found = F.coalesce(found, F.create_map().cast("map<string,string>"))
    return F.map_concat(found, F.map_filter(F.coalesce(added, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(found, k)))


def view_counts(df: DataFrame) -> DataFrame:
    """(source, n, n_collapsed, n_dated): texts, and those of them that each view changes."""
    x = df.select("source", detection_views(F.col("text")).alias("v"))
    x = x.select("source", (F.col("v.norm") != F.col("v.collapsed")).alias("c"), (F.col("v.norm") != iso_effective_dates(F.col("v.norm"))).alias("d"))
    return x.groupBy("source").agg(F.count("*").alias("n"), F.count_if("c").alias("n_collapsed"), F.count_if("d").alias("n_dated"))


QUERIES = {"detection_views": lambda s, d: view_counts(table(s, d, "documents"))}
SQL: dict[str, str] = {}
