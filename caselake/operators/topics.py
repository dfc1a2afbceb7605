"""Topics of requests that no page answers: greedy covers of each type's requests by rare and frequent words.

The next topic of a type is the word with the greatest count times idf among the requests that are left; its
requests are taken away and the rest is counted again, until no word has enough requests. A score never grows
while requests go. So a word that is the best of every request that holds it will be taken with all of these,
whatever goes first; each round takes all such words of all types at once, at least one of each type, and gives
what one word at a time would. Frequent words go first: few of them are tried on items that stand as rows with their
words, so that nothing but short lists is joined or shuffled while many items are left. Rounds are written to the
shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from ..sources.surrogate import NOW, table
from .text import _STEM, STOP, stems

HOTSPOT_ITEMS = 5
RADAR_ITEMS = 2
CANDIDATES = 64  # words of a type that are tried together at first
FEW = 10_000  # items of all types that are covered by all of their words at once
MOST_LEFT = 0.9  # frequent words end when a turn leaves more of the items
GAP = "POLICY_GAP"


def _words(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.explode(F.array_distinct(stems(F.col("text")))).alias("token"))


def _scores(counts: DataFrame, idf: DataFrame) -> DataFrame:
    # sums in any order give the same score, so ties are ties
    return counts.join(idf, "token").select("type", "token", "n", F.round(F.col("n") * F.col("idf"), 9).alias("score"))


def _best_first(rows: DataFrame) -> DataFrame:
    """A row for each type with its words as ``best``, by descending score and word."""
    own = F.reverse(F.array_sort(F.collect_list(F.struct("score", "token"))))
    return rows.groupBy("type").agg(F.transform(own, lambda x: x["token"]).alias("best"))


def _once(rows: DataFrame) -> DataFrame:
    """Rows of (type, ref, words) with those of one type and ref made one, which only repeated ones are shuffled for."""
    again = written(rows.groupBy("type", "ref").agg(F.count("*").alias("c")).filter("c > 1").drop("c"), "topic-again")
    merged = rows.join(again, ["type", "ref"], "left_semi").select("type", "ref", F.explode("words").alias("token")).distinct().groupBy("type", "ref").agg(F.collect_list("token").alias("words"))
    return rows.join(again, ["type", "ref"], "left_anti").unionByName(merged)


def _frequent_topics(left: DataFrame, idf: DataFrame, min_items: int) -> tuple[DataFrame, list[DataFrame]]:
    """Items (type, ref, words) that are left, and what was taken of them (type, ref, token, n, score) by frequent words.

    Words are counted once for many rounds: the best words of each type are tried for as long as their scores are
    above what the next word had, as no other word can come before them. Items are read where they stand, and only
    short lists of a type's words are joined to them, longer ones as fewer items are left. It ends when few
    items are left, when no word has enough of them, or when a turn takes few."""
    found, n_left, most = [], left.count(), CANDIDATES
    place = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("score"), F.desc("token")))
    while n_left > FEW:
        counts = left.select("type", F.explode("words").alias("token")).groupBy("type", "token").agg(F.count("*").alias("n")).filter(f"n >= {min_items}")
        top = written(_scores(counts, idf).withColumn("place", place).filter(F.col("place") <= most + 1), "topic-top")
        if top.isEmpty():
            return left, found
        bound = top.filter(F.col("place") > most).select("type", F.struct("score", "token").alias("bound"))
        lists = written(_best_first(top.filter(F.col("place") <= most)), "topic-lists")
        held = written(left.join(lists, "type").select("type", "ref", "words", F.array_intersect("best", "words").alias("own")), "topic-held")
        tried, gone = held.select("type", "ref", "own").filter("size(own) > 0"), []
        while True:
            counts = tried.select("type", F.explode("own").alias("token")).groupBy("type", "token").agg(F.count("*").alias("n")).filter(f"n >= {min_items}")
            now = _scores(counts, idf).join(bound, "type", "left").filter(F.col("bound").isNull() | (F.struct("score", "token") > F.col("bound"))).drop("bound")
            now = written(now, "topic-now")
            if now.isEmpty():
                break
            own = tried.join(_best_first(now), "type").select("type", "ref", "own", F.get(F.array_intersect("best", "own"), F.lit(0)).alias("token"))
            own = written(own.filter("token IS NOT NULL"), "topic-own")
            chosen = written(own.groupBy("type", "token").agg(F.count("*").alias("v")).join(now, ["type", "token"]).filter("v = n").drop("v"), "topic-chosen")
            gone.append(chosen)
            found.append(own.select("type", "ref", "token").join(chosen, ["type", "token"]).select("type", "ref", "token", "n", "score"))
            tried = own.join(chosen.select("type", "token"), ["type", "token"], "left_anti").drop("token")
        names = reduce(DataFrame.unionByName, gone).groupBy("type").agg(F.collect_list("token").alias("gone"))
        left = held.join(written(names, "topic-gone"), "type", "left").filter("gone IS NULL OR NOT arrays_overlap(own, gone)").select("type", "ref", "words")
        before, n_left, most = n_left, left.count(), 4 * most
        if n_left > before * MOST_LEFT:
            break
    return left, found


def topic_members(items: DataFrame, corpus: DataFrame | None = None, min_items: int = HOTSPOT_ITEMS) -> DataFrame:
    """(request_type, ref, topic, n, score) of the items (request_type, ref, text) that a topic covers.

    idf is ln((texts + 1) / (texts with the word + 1)) over the corpus (text), which is that of the items where none is
    given. n is the topic's number of items; topics of a type were taken by descending score, ties by descending
    word. Rows of one type and ref are one item with the words of all; a null type is a type; null refs and texts
    without words are in no topic; other columns are left out."""
    type_ = F.coalesce(F.concat(F.lit("s"), F.col("request_type")), F.lit("n")).alias("type")
    rows = written(items.select(type_, "ref", F.array_distinct(stems(F.col("text"))).alias("words")), "topic-rows")
    n_docs = max(1, (rows if corpus is None else corpus).count())
    words = rows.select(F.explode("words").alias("token")) if corpus is None else _words(corpus.select("text"))
    df = words.groupBy("token").agg(F.count("*").alias("df"))
    items = _once(rows.filter("ref IS NOT NULL AND size(words) > 0"))
    enough = items.select("type", F.explode("words").alias("token")).groupBy("type", "token").agg(F.count("*").alias("n")).filter(f"n >= {min_items}")
    idf = enough.select("token").distinct().join(df, "token", "left").select("token", F.log((F.lit(n_docs) + 1) / (F.coalesce("df", F.lit(0)) + 1)).alias("idf"))
    idf = written(idf, "topic-idf")
    left, found = _frequent_topics(items, idf, min_items)
    # what is left has many topics of few items: all words of all types are tried at once
    left = left.select("type", "ref", F.explode("words").alias("token"))
    while True:
        counts = left.groupBy("type", "token").agg(F.count("*").alias("n")).filter(f"n >= {min_items}")
        left = written(left.join(_scores(counts, idf), ["type", "token"]).select("type", "ref", "token", "n", "score"), "topic-words")
        best = left.groupBy("type", "ref").agg(F.max(F.struct("score", "token", "n")).alias("b")).select("type", "ref", "b.*")
        best = written(best, "topic-best")
        chosen = best.groupBy("type", "token").agg(F.count("*").alias("v"), F.first("n").alias("n")).filter("v = n").select("type", "token")
        taken = written(best.join(chosen, ["type", "token"]).select("type", "ref", "token", "n", "score"), "topic-taken")
        found.append(taken)
        if taken.isEmpty():
            break
        left = left.join(taken.select("type", "ref"), ["type", "ref"], "left_anti").select("type", "ref", "token")
    found = reduce(DataFrame.unionByName, found)
    return found.select(F.when(F.col("type") != "n", F.substring("type", 2, 2**30)).alias("request_type"), "ref", F.col("token").alias("topic"), "n", "score")


def topic_clusters(items: DataFrame, corpus: DataFrame, min_items: int = HOTSPOT_ITEMS) -> DataFrame:
    """(request_type, topic, place, n, first_ref) of each topic; place counts a type's topics in the order they were taken."""
    x = topic_members(items, corpus, min_items).groupBy("request_type", "topic", "score").agg(F.count("*").alias("n"), F.min("ref").alias("first_ref"))
    place = F.row_number().over(Window.partitionBy("request_type").orderBy(F.desc("score"), F.desc("topic"))).cast("long")
    return x.select("request_type", "topic", place.alias("place"), "n", "first_ref")


def hotspots(items: DataFrame, corpus: DataFrame, drafts: DataFrame, min_items: int = HOTSPOT_ITEMS) -> DataFrame:
    """Findings (severity, code, request_type, topic, n, n_drafts): topics without an approved page, and how many
    drafts (page_id, text) hold the topic's word."""
    topics = topic_clusters(items, corpus, min_items)
    held = _words(drafts, "page_id").groupBy("token").agg(F.count_distinct("page_id").alias("n_drafts"))
    x = topics.join(held, F.col("topic") == F.col("token"), "left")
    return x.select(F.lit("warning").alias("severity"), F.lit("ESCALATION_HOTSPOT").alias("code"), "request_type", "topic", "n", F.coalesce("n_drafts", F.lit(0)).alias("n_drafts"))


def gap_radar(cases: DataFrame, precedents: DataFrame | None = None, min_items: int = RADAR_ITEMS) -> DataFrame:
    """(request_type, reason_code, topic, n, avg_hours_in_queue, est_hours_saved), what would save most queue hours.

    cases: case_id, request_type, text, reasons array<string>, is_open boolean, hours double; precedents: id (of the
    type of case_id), request_type, text, reasons. Cases and precedents with a policy gap fall into topics, the rest
    of a type into ``other``; any other reason of an open case is a row with topic ''. Hours are the mean of the
    row's open cases, of all open cases where it has none, 0 where there are none at all. idf is that of the
    precedents, or of the gap cases where there are no precedents given."""
    cases = cases.select("case_id", "request_type", "text", "reasons", "is_open", "hours")
    items = cases.filter(F.array_contains("reasons", GAP)).select("request_type", F.col("case_id").alias("ref"), "text")
    corpus = None
    if precedents is not None:
        items = items.unionByName(precedents.filter(F.array_contains("reasons", GAP)).select("request_type", F.col("id").alias("ref"), "text"))
        corpus = precedents.select("text")
    topics = topic_members(items, corpus, min_items).select(F.col("request_type").alias("t"), F.col("ref").alias("r"), "topic")
    gaps = items.filter("ref IS NOT NULL").select("request_type", "ref").distinct().join(topics, F.col("request_type").eqNullSafe(F.col("t")) & (F.col("ref") == F.col("r")), "left")
    gaps = gaps.select("request_type", F.lit(GAP).alias("reason_code"), F.coalesce("topic", F.lit("other")).alias("topic"), "ref")
    others = cases.filter("is_open").select(F.coalesce("request_type", F.lit("unknown")).alias("request_type"), F.explode("reasons").alias("reason_code"), F.lit("").alias("topic"), F.col("case_id").alias("ref")).filter(F.col("reason_code") != GAP)
    hours = cases.filter("is_open AND case_id IS NOT NULL").groupBy(F.col("case_id").alias("c")).agg(F.avg("hours").alias("hours"))
    x = gaps.unionByName(others).join(hours, F.col("ref") == F.col("c"), "left").groupBy("request_type", "reason_code", "topic").agg(F.count("*").alias("n"), F.avg("hours").alias("own"))
    every = cases.filter("is_open").agg(F.avg("hours")).first()[0] or 0.0
    avg = F.coalesce("own", F.lit(float(every)))
    return x.select("request_type", "reason_code", "topic", "n", F.round(avg, 1).alias("avg_hours_in_queue"), F.round(F.col("n") * avg, 1).alias("est_hours_saved"))


def text_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cases with a text: the language is the type, the order of the same number gives state and age, labels
    and length the reasons; what no label calls good is a policy gap."""
    d, o, l = (table(spark, sf_dir, t) for t in ("documents", "orders", "labels"))
    marks = l.groupBy(F.col("doc_id").alias("k")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    x = d.join(o, F.col("doc_id") == F.col("o_orderkey"), "left").join(marks, F.col("doc_id") == F.col("k"), "left")
    reasons = F.array_compact(F.array(F.when(F.coalesce("quality", F.lit(0)) == 0, GAP), F.when(F.col("toxic") == 1, "SENSITIVE"), F.when(F.col("n_chars") < 200, "MISSING_INFO")))
    hours = (F.unix_seconds(F.expr(NOW).cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))) / 3600
    return x.select(F.col("doc_id").alias("case_id"), F.col("lang").alias("request_type"), "text", reasons.alias("reasons"), F.coalesce(F.col("o_orderstatus").isin("O", "P"), F.lit(False)).alias("is_open"), hours.alias("hours"))


def _gap_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_cases(spark, sf_dir).filter(F.array_contains("reasons", GAP)).select("request_type", F.col("case_id").alias("ref"), "text")


QUERIES = {
    "topic_clusters": lambda s, d: topic_clusters(_gap_items(s, d), table(s, d, "documents").select("text")),
    "gap_radar": lambda s, d: gap_radar(text_cases(s, d)),
}


def _topics_sql(min_items: int, corpus: str) -> str:
    """One topic of each type at a time, in a recursive query whose rows hold a type's requests that are left."""
    words = f"list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains({STOP!r}, w)), lambda w: {_STEM}), lambda w: w IS NOT NULL))"
    return f"""gaps AS (SELECT lang AS request_type, doc_id AS ref, text FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY 1 HAVING min(quality) <> 0)),
words AS (SELECT request_type, ref, {words} AS toks FROM gaps),
df AS (SELECT tok, count(*) AS df FROM (SELECT unnest({words}) AS tok FROM ({corpus})) GROUP BY tok),
total AS (SELECT greatest(1, count(*)) AS n FROM ({corpus})),
greedy AS (SELECT 0 AS place, request_type, list({{'ref': ref, 'toks': toks}}) AS lot, NULL::VARCHAR AS topic, NULL::BIGINT AS n, NULL::BIGINT AS first_ref FROM words GROUP BY request_type
  UNION ALL
  SELECT place + 1, request_type, list_filter(lot, lambda x: NOT list_contains(x.toks, t)), t, len(list_filter(lot, lambda x: list_contains(x.toks, t))), list_min(list_transform(list_filter(lot, lambda x: list_contains(x.toks, t)), lambda x: x.ref))
  FROM (SELECT *, (SELECT arg_max(tok, (round(c * ln((total.n + 1) / (coalesce(df.df, 0) + 1)), 9), tok)) FROM (SELECT tok, count(*) AS c FROM (SELECT unnest(flatten(list_transform(lot, lambda x: x.toks))) AS tok) GROUP BY tok HAVING count(*) >= {min_items}) LEFT JOIN df USING (tok), total) AS t FROM greedy) WHERE t IS NOT NULL)"""


SQL = {
    "topic_clusters": f"WITH RECURSIVE {_topics_sql(HOTSPOT_ITEMS, 'SELECT text FROM documents')} SELECT request_type, topic, place, n, first_ref FROM greedy WHERE place > 0",
}
