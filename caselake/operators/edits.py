"""Drafted edits against what stands: lines as multisets, guarded numbers and growth; JSON objects out of prose."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..sources.surrogate import table

# Characters that an edit may add, and the least share that it keeps.
MOST_MORE, LEAST_KEPT = 1500, 0.5
NUMBER = r"\d[\d,./:-]*\d|\d"


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, copy): lines of a text, of equal ones each with its number."""
    x = df.select(key, F.explode(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")).alias("line"))
    return x.withColumn("copy", F.row_number().over(Window.partitionBy(key, "line").orderBy(F.lit(1))))


def line_changes(drafts: DataFrame, key: str = "draft_id") -> DataFrame:
    """(key, change, line, n): lines that a draft (key, old, new) adds or removes, as many times as it does.

    A line that stood once and stands twice is added once; lines that only moved are no change. Keys are
    different; a null text is an empty one."""
    old, new = _lines(drafts, key, "old"), _lines(drafts, key, "new")
    on = [key, "line", "copy"]
    both = new.join(old, on, "left_anti").withColumn("change", F.lit("added")).unionByName(old.join(new, on, "left_anti").withColumn("change", F.lit("removed")))
    return both.groupBy(key, "change", "line").agg(F.count("*").alias("n"))


def judged_drafts(drafts: DataFrame, key: str = "draft_id") -> DataFrame:
    """(key, n_added, n_removed, problem): of drafts (key, old, new, note).

    problem is ``empty``, ``new_number`` (a number in an added line that neither the old text nor the note has),
    ``not_a_minimal_edit`` (grows by too much or drops more than half) or null. Keys are different and not null."""
    counts = line_changes(drafts, key)
    added = counts.filter("change = 'added'").select(key, "n", F.array_distinct(F.regexp_extract_all("line", F.lit(NUMBER), 0)).alias("numbers"))
    added = added.groupBy(key).agg(F.sum("n").alias("n_added"), F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("numbers"))
    removed = counts.filter("change = 'removed'").groupBy(key).agg(F.sum("n").alias("n_removed"))
    x = drafts.select(key, *[F.coalesce(c, F.lit("")).alias(c) for c in ("old", "new", "note")]).join(added, key, "left").join(removed, key, "left")
    known = F.array_distinct(F.regexp_extract_all(F.concat_ws("\n", "old", "note"), F.lit(NUMBER), 0))
    size, before = F.length("new"), F.length("old")
    problem = (F.when(F.trim("new") == "", "empty").when(F.size(F.array_except(F.coalesce("numbers", F.array().cast("array<string>")), known)) > 0, "new_number")
               .when((size - before > MOST_MORE) | (size < before * LEAST_KEPT), "not_a_minimal_edit"))
    return x.select(key, F.coalesce("n_added", F.lit(0)).alias("n_added"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), problem.alias("problem"))


_THOUGHT, _FENCE = re.compile(r"(?is)<think>.*?</think>"), re.compile(r"(?s)```(?:json)?\s*(.*?)```")


def first_object(text: str) -> str | None:
    """The first JSON object in a text: each brace is tried as its beginning, and what doesn't parse is passed over.

    A fenced block is tried before the rest; what stands in thought marks is left out."""
    text, decoder = _THOUGHT.sub(" ", text), json.JSONDecoder()
    fence = _FENCE.search(text)
    for part in ([fence[1], text] if fence else [text]):
        at = part.find("{")
        while at >= 0:
            try:
                return part[at : decoder.raw_decode(part, at)[1]]
            except (ValueError, RecursionError):
                at = part.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def _objects(texts: pd.Series) -> pd.Series:
    return pd.Series([first_object(t) if isinstance(t, str) else None for t in texts], dtype=object)


def tolerant_json(df: DataFrame, text: str, schema: str) -> DataFrame:
    """The rows with ``parsed`` (struct of the schema) and ``bad``: whether there is no object, or one with other types.

    Columns of these names are replaced; a null text has no object."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("parsed", "bad")]
    found: Column = F.when(F.col(f"`{text}`").contains("{"), _objects(F.col(f"`{text}`")))
    x = df.select(F.struct(*kept).alias("row"), F.from_json(found, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("p"))
    bad = F.col("p").isNull() | F.col("p._corrupt").isNotNull()
    return x.select("row.*", F.when(~bad, F.col("p").dropFields("_corrupt")).alias("parsed"), bad.alias("bad"))


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn as the draft that replaces the turn before it; the turn's role is the note."""
    t = table(spark, sf_dir, "conversations")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("old"))
    return t.join(before, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("draft_id"), "old", F.col("text").alias("new"), F.col("role").alias("note"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.lit("<think>{no}</think> It is {not this} but\n```json\n"), F.col("props"), F.lit("\n``` as asked.")).alias("answer"))


QUERIES = {
    "draft_edits": lambda s, d: judged_drafts(_drafts(s, d)),
    "tolerant_json": lambda s, d: tolerant_json(_answers(s, d), "answer", "k long").select("event_id", F.col("parsed.k").alias("k"), "bad"),
}
_SPLIT = "unnest(regexp_split_to_array(coalesce({}, ''), '\\r\\n|\\n|\\r'))"
_COPIES = "SELECT draft_id, line, row_number() OVER (PARTITION BY draft_id, line) AS copy FROM (SELECT draft_id, " + _SPLIT + " AS line FROM d)"
SQL = {
    "draft_edits": f"""WITH d AS (SELECT b.conv_id || '-' || b.turn AS draft_id, a.text AS old, b.text AS new, b.role AS note FROM conversations b JOIN conversations a ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
o AS ({_COPIES.format('old')}), n AS ({_COPIES.format('new')}),
added AS (SELECT draft_id, line FROM n ANTI JOIN o USING (draft_id, line, copy)), removed AS (SELECT draft_id FROM o ANTI JOIN n USING (draft_id, line, copy)),
num AS (SELECT draft_id, unnest(regexp_extract_all(line, '{NUMBER}')) AS v FROM added),
new_number AS (SELECT DISTINCT num.draft_id FROM num JOIN d USING (draft_id) WHERE NOT list_contains(regexp_extract_all(concat_ws(chr(10), coalesce(old, ''), coalesce(note, '')), '{NUMBER}'), v))
SELECT draft_id, (SELECT count(*) FROM added a WHERE a.draft_id = d.draft_id) AS n_added, (SELECT count(*) FROM removed r WHERE r.draft_id = d.draft_id) AS n_removed,
 CASE WHEN trim(coalesce(new, '')) = '' THEN 'empty' WHEN draft_id IN (SELECT draft_id FROM new_number) THEN 'new_number' WHEN length(coalesce(new, '')) - length(coalesce(old, '')) > {MOST_MORE} OR length(coalesce(new, '')) < length(coalesce(old, '')) * {LEAST_KEPT} THEN 'not_a_minimal_edit' END AS problem FROM d""",
    "tolerant_json": "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, false AS bad FROM events",
}
