"""Lexical and vector retrieval: Okapi statistics with a floor, absolute BM25, hybrid relevance, nearest vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from ..sources.surrogate import table
from .hygiene import buckets_of, hashed_buckets
from .scan import lists_of, top_k, unit_counts
from .text import _tokens, stems

#: BM25's parameters, and the share of the mean idf that a negative idf is raised to.
K1, B, FLOOR = 1.5, 0.75, 0.25


def okapi_idf(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, df, idf) and one row (n, avgdl, idf_max). Lengths come from a row's own stems, so only partial counts
    by token are shuffled; a negative idf is raised to a quarter of the mean idf."""
    return _idf_of(docs.select(stems(F.col("text")).alias("t")))


def _idf_of(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    stats = x.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    df = x.select(F.explode(F.array_distinct("t")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(stats)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    raw = written(raw, "idf")
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = raw.crossJoin(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return idf, stats.crossJoin(idf.agg(F.max("idf").alias("idf_max")))


def hybrid_topk(docs: DataFrame, queries: DataFrame, k: int = 5, floor: float = 0.10) -> DataFrame:
    """Top k documents of each query (a stated set) by half absolute BM25 and half cosine of hashed vectors, from
    ``floor`` on; ties by id. A document is scored in its own row against all queries; no pair is shuffled.

    Absolute BM25 is the score over what a document of average length with every query term once would get; query
    terms count as often as they stand, and one that no document has counts with the largest idf."""
    # stems are worked out once and read for the counts, the lengths and the scan
    words = written(docs.select("doc_id", stems(F.col("text")).alias("t")), "hybrid-words")
    idf, stats = _idf_of(words.select("t"))
    terms = queries.select("item_id", F.explode(stems(F.col("text"))).alias("token")).groupBy("item_id", "token").agg(F.count("*").alias("qf"))
    weighted = terms.join(idf, "token", "left").crossJoin(F.broadcast(stats.select("idf_max"))).withColumn("w", F.greatest(F.coalesce("idf", "idf_max"), F.lit(0.0)))
    per = weighted.groupBy("item_id").agg(F.sum(F.col("qf") * F.col("w")).alias("best"), F.collect_list(F.struct("token", (F.col("qf") * F.col("idf")).alias("w"))).alias("terms"))
    # small, and read in every pass
    q = written(queries.select("item_id", hashed_buckets(F.col("text")).alias("buckets")).join(per, "item_id", "left"), "query-terms")
    avgdl = words.agg(F.avg(F.size("t"))).first()[0] or 1.0

    def prepare(q: pa.StructArray):
        vectors, rows = unit_counts(q.field("buckets"), 512), q.field("terms").to_pylist()
        place: dict[str, int] = {}
        for row in rows:
            for t in row or ():
                if t["w"] is not None:
                    place.setdefault(t["token"], len(place))
        weights = np.zeros((len(place) + 1, len(rows)))
        for at, (row, best) in enumerate(zip(rows, q.field("best").to_pylist())):
            for t in row or ():
                if t["w"] is not None and best:
                    weights[place[t["token"]], at] = t["w"] / best

        def score(d: pa.StructArray) -> np.ndarray:
            lexical = np.zeros((len(d), len(rows)))
            for at, tokens in enumerate(d.field("t").to_pylist()):
                known = np.array([place[t] for t in tokens or () if t in place], np.int64)
                if len(known):
                    own, tf = np.unique(known, return_counts=True)
                    lexical[at] = (tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(tokens) / avgdl))) @ weights[own]
            return np.round(0.5 * np.clip(lexical, 0.0, 1.0) + 0.5 * (unit_counts(d.field("buckets"), 512) @ vectors.T), 5)

        return score

    found = top_k(words.select("doc_id", "t", buckets_of(F.col("t")).alias("buckets")), q, "doc_id", "item_id", prepare, k, floor)
    return found.select("item_id", "doc_id", "score", "rank")


def vector_topk(vectors: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest vectors of the same label of every vector whose id is divisible by 20, by cosine; ties by id.

    Null, zero or unlike long vectors, and those with a null or non-finite component, are no match."""
    x = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v")).filter("label IS NOT NULL AND size(v) > 0 AND NOT exists(v, e -> e IS NULL)")

    def matrix(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = lists_of(rows.field("v"))
        out, size = np.zeros((len(parts), max(map(len, parts), default=0))), np.array([len(p) for p in parts])
        for at, p in enumerate(parts):
            out[at, : len(p)] = p
        with np.errstate(all="ignore"):
            return out / np.linalg.norm(out, axis=1, keepdims=True), size, np.array(rows.field("label").to_pylist(), object), rows.field("_id").to_numpy()

    def prepare(q: pa.StructArray):
        w, size, label, ids = matrix(q)

        def score(d: pa.StructArray) -> np.ndarray:
            v, own, kind, own_ids = matrix(d)
            n = min(v.shape[1], w.shape[1])
            fits = (own[:, None] == size) & (kind[:, None] == label) & (own_ids[:, None] != ids)
            with np.errstate(all="ignore"):
                return np.where(fits, np.round(v[:, :n] @ w[:, :n].T, 5), np.nan)

        return score

    found = top_k(x, x.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), "vec_id", "query_id", prepare, k)
    return found.select("query_id", "vec_id", F.col("score").alias("cosine"), "rank")


QUERIES = {
    "okapi_idf": lambda s, d: okapi_idf(table(s, d, "documents"))[0].withColumn("idf", F.round("idf", 6)),
    "hybrid_topk": lambda s, d: hybrid_topk(table(s, d, "documents"), table(s, d, "benchmark")),
    "vector_topk": lambda s, d: vector_topk(table(s, d, "embeddings")),
}
_IDF = f"""p AS (SELECT doc_id, token, count(*) AS tf FROM {_tokens('documents', 'doc_id')} GROUP BY ALL), l AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM l) / (SELECT count(*) FROM documents) AS avgdl),
r AS (SELECT token, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, st GROUP BY token),
idf AS (SELECT token, df, CASE WHEN raw < 0 THEN {FLOOR} * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r)"""
_BUCKET = "(CAST('0x' || right(md5(token), 3) AS INT) % 512)"
SQL = {
    "okapi_idf": f"WITH {_IDF} SELECT token, df, round(idf, 6) AS idf FROM idf",
    "hybrid_topk": f"""WITH {_IDF}, q AS (SELECT item_id, token, count(*) AS qf FROM {_tokens('benchmark', 'item_id')} GROUP BY ALL),
w AS (SELECT item_id, token, qf, idf, greatest(coalesce(idf, (SELECT max(idf) FROM idf)), 0) AS w FROM q LEFT JOIN idf USING (token)), best AS (SELECT item_id, sum(qf * w) AS best FROM w GROUP BY 1),
bm AS (SELECT item_id, doc_id, least(1.0, greatest(0.0, sum(qf * idf * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / avgdl))) / any_value(best))) AS bm25 FROM p JOIN l USING (doc_id) JOIN w USING (token) JOIN best USING (item_id), st WHERE idf IS NOT NULL GROUP BY ALL),
dv AS (SELECT doc_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM (SELECT doc_id, {_BUCKET} AS bucket, sum(tf) AS n FROM p GROUP BY ALL)),
qv AS (SELECT item_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS x FROM (SELECT item_id, {_BUCKET} AS bucket, sum(qf) AS n FROM q GROUP BY ALL)),
co AS (SELECT item_id, doc_id, sum(dv.x * qv.x) AS cosine FROM dv JOIN qv USING (bucket) GROUP BY ALL),
s AS (SELECT item_id, doc_id, round(0.5 * coalesce(bm25, 0) + 0.5 * coalesce(cosine, 0), 5) AS score FROM co FULL JOIN bm USING (item_id, doc_id))
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score >= 0.10) WHERE rank <= 5""",
    "vector_topk": """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL),
c AS (SELECT q.vec_id AS query_id, x.vec_id, round(list_cosine_similarity(q.v, x.v), 5) AS cosine FROM v q JOIN v x ON q.label = x.label AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM c) WHERE rank <= 5""",
}
