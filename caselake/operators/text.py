"""Text hygiene, personal data shapes, ordered classification and lexical retrieval over request texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from ..sources.surrogate import table

#: Shapes without look-around, so Java, RE2 and Python read them alike: type, token, pattern; order is semantics.
SHAPES = (
    ("EMAIL", "[EMAIL]", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(\.[A-Za-z0-9-]{1,63}){1,4}"),
    ("CARD", "[ID]", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b"),
    ("PHONE", "[PHONE]", r"\+1[ -]?[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{4}"),
    ("IPV4", "[ID]", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
)
#: What every find of a shape holds.
FIXED = {"EMAIL": "@", "PHONE": "+1"}
STOP = "a an and are as at be by for from has have how i in is it me my of on or our please that the this to we what when which who with you your can do does need want would should".split()
#: Ordered types, first match wins.
TYPES = (
    ("license_question", r"(?i)\blicen[sc]e"),
    ("credential_leak", r"(?i)\b(password|token|secret|api[_ -]?key)\b"),
    ("contact_change", r"@[A-Za-z0-9-]+\."),
    ("shouting", r"^[^a-z]*$"),
    ("question", r"\?"),
)
FLAGS = (("has_card", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"), ("has_secret", r"(?i)\b(password|token|secret)\b"), ("has_link", r"https?://"), ("has_number", r"[0-9]{5,}"))


def holds(text: Column, pattern: str, fixed: str | None = None) -> Column:
    """Whether the pattern is in the text; where ``fixed`` is a part of all it finds, only texts with that are tried."""
    return text.contains(fixed) & text.rlike(pattern) if fixed else text.rlike(pattern)


def pii_types(df: DataFrame, col: str = "text") -> DataFrame:
    """Types found in each row's text, comma-joined in a fixed order; never the values."""
    return df.withColumn("types", F.array_join(shapes_in(F.col(col)), ","))


def shapes_in(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(holds(text, p, FIXED.get(t)), F.lit(t)) for t, _, p in SHAPES]))


def mask_shapes(text: Column) -> Column:
    for kind, token, pattern in SHAPES:
        cut = F.regexp_replace(text, pattern, token.replace("$", r"\$"))
        text = F.when(text.contains(FIXED[kind]), cut).otherwise(text) if kind in FIXED else cut
    return text


def leak_scan(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(label, type, n) over several tables of (frame, id column, text column)."""
    out = None
    for label, (df, _, col) in tables.items():
        x = pii_types(df.select(F.col(col).alias("text"))).filter("types <> ''").select(F.lit(label).alias("label"), F.explode(F.split("types", ",")).alias("type"))
        x = x.groupBy("label", "type").agg(F.count("*").alias("n"))
        out = x if out is None else out.unionByName(x)
    return out


def keyword_type(text: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(TYPES):
        kind = F.when(holds(text, pattern, "@" if pattern.startswith("@") else None), name).otherwise(kind)
    return F.coalesce(kind, F.lit("unknown"))


def stems(text: Column) -> Column:
    """Lower-case words of two letters or more without stop words, one ending cut where three letters stay."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda w: (F.length(w) > 1) & ~w.isin(*STOP))

    def cut(w):
        out = F.when(w.endswith("ing") & (F.length(w) >= 6), F.substring(w, F.lit(1), F.length(w) - 3))
        for end in ("ed", "es"):
            out = out.when(w.endswith(end) & (F.length(w) >= 5), F.substring(w, F.lit(1), F.length(w) - 2))
        out = out.when(w.endswith("s") & ~w.endswith("ss") & (F.length(w) >= 4), F.substring(w, F.lit(1), F.length(w) - 1))
        return out.when(w.endswith("e") & (F.length(w) >= 4), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)

    return F.transform(words, cut)


def corpus_df(df: DataFrame) -> DataFrame:
    """Documents and occurrences of every stem."""
    x = df.select("doc_id", F.explode(stems(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
    return x.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, k: int = 5, unseen: bool = False) -> DataFrame:
    """Top k documents of each query (item_id, text) by BM25 over the sum of its terms' idf, in 0..1.

    Stems are worked out once and kept in the shared folder. Only words that a query has (a stated set, sent to all
    tasks) become postings; idf is the smoothed non-negative form. With unseen, terms that no document has count in
    the sum with the largest idf of the corpus."""
    words = written(docs.select("doc_id", stems(F.col("text")).alias("t")).filter("size(t) > 0"), "words")
    length = words.groupBy("doc_id").agg(F.sum(F.size("t")).alias("dl"))
    stats = length.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    terms = queries.select("item_id", F.explode(F.array_distinct(stems(F.col("text")))).alias("token"))
    asked = F.broadcast(terms.select("token").distinct())
    post = words.select("doc_id", F.explode("t").alias("token")).join(asked, "token", "left_semi").groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
    idf = post.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats)).withColumn("idf", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weighted = terms.join(idf, "token")
    every = weighted
    if unseen:
        # dealt by document first, so that an id that is repeated counts once and words are not shuffled one by one
        every_post = words.repartition("doc_id").select("doc_id", F.explode("t").alias("token")).distinct()
        rarest = every_post.groupBy("token").agg(F.count("*").alias("df")).agg(F.min("df").alias("df")).crossJoin(stats).select(F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("most"))
        every = terms.join(idf, "token", "left").crossJoin(F.broadcast(rarest)).withColumn("idf", F.coalesce("idf", "most"))
    best = every.groupBy("item_id").agg(F.sum("idf").alias("total"))
    x = weighted.join(post, "token").join(length, "doc_id")
    s = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    x = x.groupBy("item_id", "doc_id").agg(F.sum(s).alias("s")).join(best, "item_id").withColumn("score", F.round(F.least(F.lit(1.0), F.col("s") / F.col("total") / (k1 + 1)), 6))
    return x.withColumn("rank", F.expr("row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)")).filter(F.col("rank") <= k).select("item_id", "doc_id", "score", "rank")


def luhn_runs(df: DataFrame) -> DataFrame:
    """Card-like runs of each source: how many pass the checksum."""
    x = df.select("source", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]{4} ?[0-9]{4} ?[0-9]{4} ?[0-9]{4}"), 0)).alias("run"))
    return x.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.expr("luhn_check(replace(run, ' ', ''))")).alias("valid"))


def scorecard(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Ratios of a length rule against the labels by language: numerator, denominator, percent."""
    x = docs.join(labels, "doc_id").withColumn("guess", F.when(F.col("n_chars") >= 500, 1).otherwise(0))
    x = x.groupBy("lang").agg(F.count_if(F.col("guess") == F.col("quality")).alias("num"), F.count("*").alias("den"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return x.withColumn("pct", F.round(100 * F.col("num") / F.col("den"), 1))


def misses(docs: DataFrame, labels: DataFrame) -> DataFrame:
    x = docs.join(labels, "doc_id")
    reasons = F.array_compact(F.array(F.when((F.col("n_chars") >= 500) & (F.col("quality") == 0), "long_but_poor"), F.when((F.col("n_chars") < 500) & (F.col("quality") == 1), "short_but_good"), F.when(F.col("toxic") == 1, "toxic")))
    return x.select("doc_id", F.array_join(reasons, ",").alias("reasons")).filter("reasons <> ''")


_DOCS = lambda s, d: table(s, d, "documents")
QUERIES = {
    "pii_types": lambda s, d: pii_types(_DOCS(s, d)).select("doc_id", "types"),
    "pii_mask_simple": lambda s, d: _DOCS(s, d).select("doc_id", F.md5(mask_shapes(F.col("text")).cast("binary")).alias("masked_md5")),
    "leak_scan": lambda s, d: leak_scan({"documents": (_DOCS(s, d), "doc_id", "text"), "conversations": (table(s, d, "conversations"), "conv_id", "text")}),
    "leak_scan_all": lambda s, d: leak_scan({"documents": (_DOCS(s, d), "doc_id", "text"), "conversations": (table(s, d, "conversations"), "conv_id", "text"), "pages": (table(s, d, "pages"), "page_id", "html"), "events": (table(s, d, "events"), "event_id", "props")}),
    "keyword_type": lambda s, d: _DOCS(s, d).select("doc_id", keyword_type(F.col("text")).alias("kind")),
    "safety_flags": lambda s, d: _DOCS(s, d).select("doc_id", *[F.col("text").rlike(p).alias(n) for n, p in FLAGS]),
    "corpus_df": lambda s, d: corpus_df(_DOCS(s, d)),
    "bm25_abs": lambda s, d: bm25(_DOCS(s, d), table(s, d, "benchmark")),
    "bm25_unseen": lambda s, d: bm25(_DOCS(s, d), table(s, d, "benchmark"), unseen=True),
    "luhn_quality": lambda s, d: luhn_runs(_DOCS(s, d)),
    "scorecard": lambda s, d: scorecard(_DOCS(s, d), table(s, d, "labels")),
    "scorecard_misses": lambda s, d: misses(_DOCS(s, d), table(s, d, "labels")),
}
_T = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{t}' END" for t, _, p in SHAPES)
_MASK = "text"
for _, _token, _p in SHAPES:
    _MASK = f"regexp_replace({_MASK}, '{_p}', '{_token}', 'g')"
_STEM = """CASE WHEN w LIKE '%ing' AND length(w) >= 6 THEN left(w, -3) WHEN (w LIKE '%ed' OR w LIKE '%es') AND length(w) >= 5 THEN left(w, -2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) >= 4 THEN left(w, -1) WHEN w LIKE '%e' AND length(w) >= 4 THEN left(w, -1) ELSE w END"""


def _tokens(frame: str, key: str) -> str:
    return f"(SELECT {key}, {_STEM} AS token FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM {frame}) WHERE length(w) > 1 AND w NOT IN ({', '.join(map(repr, STOP))}))"


SQL = {
    "pii_types": f"SELECT doc_id, concat_ws(',', {_T}) AS types FROM documents",
    "pii_mask_simple": f"SELECT doc_id, md5({_MASK}) AS masked_md5 FROM documents",
    "leak_scan": " UNION ALL ".join(f"SELECT '{f}' AS label, '{t}' AS type, count(*) AS n FROM {f} WHERE regexp_matches(text, '{p}') HAVING count(*) > 0" for f in ("documents", "conversations") for t, _, p in SHAPES),
    "keyword_type": "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TYPES) + " ELSE 'unknown' END AS kind FROM documents",
    "safety_flags": "SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{p}') AS {n}" for n, p in FLAGS) + " FROM documents",
    "corpus_df": f"WITH p AS (SELECT doc_id, token, count(*) AS tf FROM {_tokens('documents', 'doc_id')} GROUP BY ALL) SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY token",
    "bm25_abs": f"""WITH p AS (SELECT doc_id, token, count(*) AS tf FROM {_tokens('documents', 'doc_id')} GROUP BY ALL), l AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
t AS (SELECT DISTINCT item_id, token FROM {_tokens('benchmark', 'item_id')}), i AS (SELECT token, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf, avgdl FROM p, st WHERE token IN (SELECT token FROM t) GROUP BY token, n, avgdl),
w AS (SELECT item_id, token, idf, avgdl FROM t JOIN i USING (token)), b AS (SELECT item_id, sum(idf) AS total FROM w GROUP BY 1),
x AS (SELECT item_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM w JOIN p USING (token) JOIN l USING (doc_id) GROUP BY ALL),
y AS (SELECT item_id, doc_id, round(least(1.0, s / total / 2.5), 6) AS score FROM x JOIN b USING (item_id)), z AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM y) SELECT * FROM z WHERE rank <= 5""",
    "scorecard": "SELECT lang, count(*) FILTER ((CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END) = quality) AS num, count(*) AS den, count(*) FILTER (toxic = 1) AS toxic, round(100.0 * count(*) FILTER ((CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END) = quality) / count(*), 1) AS pct FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "scorecard_misses": "SELECT * FROM (SELECT doc_id, concat_ws(',', CASE WHEN n_chars >= 500 AND quality = 0 THEN 'long_but_poor' END, CASE WHEN n_chars < 500 AND quality = 1 THEN 'short_but_good' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS reasons FROM documents JOIN labels USING (doc_id)) WHERE reasons <> ''",
}
SQL |= {
    "leak_scan_all": " UNION ALL ".join(f"SELECT '{f}' AS label, '{t}' AS type, count(*) AS n FROM {f} WHERE regexp_matches({c}, '{p}') HAVING count(*) > 0" for f, c in (("documents", "text"), ("conversations", "text"), ("pages", "html"), ("events", "props")) for t, _, p in SHAPES),
    "bm25_unseen": SQL["bm25_abs"].replace("b AS (SELECT item_id, sum(idf) AS total FROM w GROUP BY 1)", "m AS (SELECT ln(1 + (n - low + 0.5) / (low + 0.5)) AS most FROM st, (SELECT min(df) AS low FROM (SELECT count(*) AS df FROM p GROUP BY token))), b AS (SELECT item_id, sum(coalesce(idf, most)) AS total FROM t LEFT JOIN i USING (token), m GROUP BY 1)"),
}
