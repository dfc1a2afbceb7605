"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations only.

Each source's documents are dealt, in a hashed order, into blocks. In a period of ``units`` slots a source
with weight q / units owns q slots; its block i (counted in the period) is released at floor(i * units / q)
and due at ceil((i + 1) * units / q). Earliest deadline first over the released blocks of all sources fills every slot
of the period, so after any number of slots each source is less than one block off its weight. A period has
UNITS slots, or UNITS_EACH for each source where there are more sources than slots. The schedule repeats, so one
period is worked out and a block's slot follows from its number by arithmetic: a short one by a fold over its slots, a
longer one by halves (``_halved``), with the same result. A source that has run out leaves its slots empty and the
others keep their proportions, so every row is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_hash

BLOCK_DOCS = 32
UNITS = 1000
UNITS_EACH = 8  # slots of a period for each source, on average, where UNITS has less than one
WHOLE = 1024  # slots of a period at most that are folded in one task
SMALL = 100_000  # rows of a schedule at most that is sent to all tasks
ALPHA = 0.5  # target weight of a source: its number of documents to this power
BUCKET_ROWS = 20_000


def target_units(counts: DataFrame, units: int = UNITS, alpha: float = ALPHA, weights: DataFrame | None = None) -> DataFrame:
    """(source, n_docs, q) from (source, n_docs): the weight in whole units, at least 1 each.

    The weight is that of ``weights`` (source, weight; 0 for a source that is not there, or for a null or negative
    one; all alike where none is above 0), else n_docs ** alpha.
    Largest remainders get the units left over. There is one row a source."""
    one = Window.partitionBy(F.lit(0))
    if weights is None:
        w = counts.withColumn("w", F.pow(F.col("n_docs").cast("double"), F.lit(float(alpha))))
    else:
        given = weights.select(F.col("source").alias("_t"), F.col("weight").cast("double").alias("w"))
        w = counts.join(given, F.col("source").eqNullSafe(F.col("_t")), "left").select("source", "n_docs", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)).alias("w"))
    w = w.withColumn("w", F.when(F.sum("w").over(one) > 0, F.col("w")).otherwise(F.lit(1.0)))
    w = w.withColumn("x", 1 + F.col("w") * (F.lit(units) - F.count("*").over(one)) / F.sum("w").over(one))
    w = w.withColumn("q0", F.floor(F.round("x", 9)).cast("long")).withColumn("left", F.lit(units) - F.sum("q0").over(one))
    w = w.withColumn("k", F.row_number().over(one.orderBy(F.round(F.col("x") - F.col("q0"), 6).desc(), F.col("source").asc_nulls_first())))
    return w.select("source", "n_docs", (F.col("q0") + F.when(F.col("k") <= F.col("left"), 1).otherwise(0)).alias("q"))


def _folded(targets: DataFrame) -> DataFrame:
    """(source, q, i, slot): the sources that earliest deadline first gives the slots to; i counts a source's turns."""
    one = targets.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "q"))).alias("s"), F.sum("q").alias("u"))
    # the inner fold goes over a short run of slots, so that picks are appended to short arrays
    pick = "array_min(filter(transform(s, (x, j) -> named_struct('due', ceil((a.done[j] + 1) * u / x.q), 'j', j, 'ok', a.done[j] < x.q and (a.done[j] * u) div x.q <= t)), y -> y.ok)).j"
    step = f"(a, t) -> transform(array({pick}), p -> named_struct('done', transform(a.done, (d, j) -> if(j = p, d + 1L, d)), 'picks', array_append(a.picks, p)))[0]"
    run = f"aggregate(sequence(r * width, least((r + 1) * width, u) - 1), named_struct('done', b.done, 'picks', cast(array() as array<int>)), {step})"
    fold = f"""aggregate(sequence(0L, (u - 1) div width), named_struct('done', transform(s, x -> 0L), 'runs', cast(array() as array<array<int>>)),
        (b, r) -> transform(array({run}), g -> named_struct('done', g.done, 'runs', array_append(b.runs, g.picks)))[0])"""
    picks = one.filter("u > 0").withColumn("width", F.ceil(F.sqrt("u")).cast("long")).select("s", F.expr(f"flatten({fold}.runs)").alias("picks")).select("s", F.posexplode("picks").alias("slot", "j"))
    picks = picks.select(F.expr("s[j].source").alias("source"), F.expr("s[j].q").alias("q"), F.col("slot").cast("long").alias("slot"))
    return picks.withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy("slot")).cast("long") - 1)


def _halved(targets: DataFrame, units: int) -> DataFrame:
    """The rows of ``_folded``, by halves of the blocks in the order of deadline and source.

    A block takes the first slot from its release on that no earlier block of this order takes, so which slots the first
    half fills follows from its releases alone: of the slots before t it fills the least of (released before u) + t - u
    over all u up to t. The halves then go on apart, each with its blocks and slots numbered anew, down to one block and
    its slot."""
    jobs = targets.select("source", "q", F.explode(F.expr("sequence(0L, q - 1)")).alias("i"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.expr(f"((i + 1) * {units}L + q - 1) div q"), F.col("source").asc_nulls_first())).cast("long") - 1
    jobs = jobs.select(F.lit(0).cast("long").alias("node"), F.expr(f"(i * {units}L) div q").alias("at"), rank.alias("rank"), F.struct("source", "q", "i").alias("job"), F.lit(None).cast("long").alias("slot"))
    kind = jobs.schema["job"].dataType
    slots = targets.sparkSession.range(units).select(F.lit(0).cast("long").alias("node"), F.col("id").alias("at"), F.lit(None).cast("long").alias("rank"), F.lit(None).cast(kind).alias("job"), F.col("id").alias("slot"))
    x = jobs.union(slots)
    for bit in reversed(range((units - 1).bit_length())):
        x = x.withColumn("first", F.expr(f"rank IS NOT NULL AND shiftright(rank, {bit}) & 1 = 0"))
        # of one place the slot comes before the blocks that are released there
        place = Window.partitionBy("node").orderBy("at", F.col("rank").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        x = x.withColumn("before", F.count_if("first").over(place)).withColumn("low", F.min(F.when(F.col("slot").isNotNull(), F.col("before") - F.col("at"))).over(place))
        x = x.withColumn("met", F.count_if("first").over(Window.partitionBy("node").orderBy("at"))).withColumn("filled", F.col("at") + F.col("low"))
        x = x.withColumn("own", F.when(F.col("slot").isNull(), F.col("first")).otherwise(F.col("met") > F.col("filled")))
        x = x.select((2 * F.col("node") + F.when(F.col("own"), 0).otherwise(1)).alias("node"), F.when(F.col("own"), F.col("filled")).otherwise(F.col("at") - F.col("filled")).alias("at"), "rank", "job", "slot")
    return x.groupBy("node").agg(F.first("job", True).alias("job"), F.max("slot").alias("slot")).select("job.*", "slot")


def period(targets: DataFrame, units: int = UNITS, whole: int = WHOLE) -> DataFrame:
    """(source, i, slot, release, deadline) of one period: units rows, units being the sum of q. No source, no rows."""
    y = _folded(targets) if units <= whole else _halved(targets, units)
    return y.select("source", "i", "slot", F.expr(f"(i * {units}L) div q").alias("release"), F.expr(f"((i + 1) * {units}L + q - 1) div q").alias("deadline"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", block_docs: int = BLOCK_DOCS, units: int = UNITS, alpha: float = ALPHA, weights: DataFrame | None = None) -> DataFrame:
    """Every row with block (its number in its source), release, deadline and slot (block times over all periods).

    Order in a source: rows without an id, by md5 of the row, then the others by md5 of the id, the id, and a hash of
    the row, so repeated rows take neighbouring places in any order. A null source is a source of its own. Weights are those of ``target_units``. A period has ``units`` slots, more
    where there are more sources than that. Ranks come from counts of (source, bucket of hashes), so no source is sorted in one task.
    Columns named like the new ones are replaced; an empty table stays empty."""
    new = ["block", "release", "deadline", "slot"]
    docs = docs.drop(*new)
    spark = docs.sparkSession
    # the input's columns travel in one, so that names of this work can't meet theirs
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    x = docs.select(row, F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").alias("id"))
    x = x.withColumn("md5", F.coalesce(F.md5(F.col("id").cast("string")), F.md5(F.to_json(F.struct("row")))))
    counts = x.groupBy("source").agg(F.count("*").alias("n_docs"))
    sources, largest = counts.agg(F.count("*"), F.coalesce(F.max("n_docs"), F.lit(0))).first()
    units = units if sources <= units else UNITS_EACH * sources
    digits = max(1, min(8, len(f"{max(1, largest // BUCKET_ROWS):x}")))
    # rows without an id come first, dealt by their own hash: a source may have many
    unnamed = F.concat(F.lit("!"), F.substring("md5", 1, digits))
    x = x.withColumn("bucket", F.when(F.col("id").isNull(), unnamed).otherwise(F.substring("md5", 1, digits)))
    per = x.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    targets = target_units(counts, units, alpha, weights)
    per = per.join(targets.select(F.col("source").alias("t"), "q"), F.col("s2").eqNullSafe(F.col("t"))).drop("t")
    inner = Window.partitionBy("source", "bucket").orderBy(F.col("md5").asc_nulls_first(), F.col("id").asc_nulls_first(), row_hash(x, "row"))
    x = x.withColumn("k", F.row_number().over(inner)).join(per, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
    x = x.withColumn("block", F.expr(f"(before + k - 1) div {block_docs}")).select("row", "source", "block", F.expr("block % q").alias("turn"), F.expr(f"(block div q) * {units}L").alias("base"))
    plan = period(targets, units).select(F.col("source").alias("p"), "i", "slot", "release", "deadline")
    # one row a unit
    plan = F.broadcast(plan) if units <= SMALL else plan
    x = x.join(plan, F.col("source").eqNullSafe(F.col("p")) & (F.col("turn") == F.col("i")))
    return x.select("row.*", "block", *[(F.col(c) + F.col("base")).alias(c) for c in ("release", "deadline", "slot")])


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, block, release, deadline, slot) of every row; nulls, repeated rows and empty tables as in ``mix``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs)


SQL = {
    "op10_pfair_mix": f"""
WITH RECURSIVE c AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
x AS (SELECT source, 1 + pow(n_docs::DOUBLE, {ALPHA}) * ({UNITS} - count(*) OVER ()) / sum(pow(n_docs::DOUBLE, {ALPHA})) OVER () AS x FROM c),
y AS (SELECT source, x, floor(round(x, 9))::BIGINT AS q0 FROM x),
q AS (SELECT source, q0 + CASE WHEN row_number() OVER (ORDER BY round(x - q0, 6) DESC, source NULLS FIRST) <= {UNITS} - sum(q0) OVER () THEN 1 ELSE 0 END AS q FROM y),
s AS (SELECT list(source ORDER BY source NULLS FIRST) AS names, list(q ORDER BY source NULLS FIRST) AS qs FROM q),
edf AS (SELECT -1 AS t, 0 AS pick, list_transform(qs, lambda v: 0::BIGINT) AS done, names, qs FROM s
  UNION ALL
  SELECT t + 1, p, list_transform(range(1, len(qs) + 1), lambda j: done[j] + CASE WHEN j = p THEN 1 ELSE 0 END), names, qs
  FROM (SELECT t, done, names, qs, list_min(list_transform(list_filter(range(1, len(qs) + 1), lambda j: done[j] < qs[j] AND (done[j] * {UNITS}) // qs[j] <= t + 1), lambda j: [((done[j] + 1) * {UNITS} + qs[j] - 1) // qs[j], j]))[2]::INT AS p FROM edf WHERE t < {UNITS - 1})),
slots AS (SELECT t AS slot, names[pick] AS source, row_number() OVER (PARTITION BY names[pick] ORDER BY t) - 1 AS i FROM edf WHERE t >= 0),
b AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) // {BLOCK_DOCS} AS block FROM documents)
SELECT b.doc_id, b.source, b.block, (i * {UNITS}) // q + (block // q) * {UNITS} AS release, ((i + 1) * {UNITS} + q - 1) // q + (block // q) * {UNITS} AS deadline, slot + (block // q) * {UNITS} AS slot
FROM b JOIN q ON b.source IS NOT DISTINCT FROM q.source JOIN slots ON slots.source IS NOT DISTINCT FROM b.source AND slots.i = b.block % q.q
""",
}
QUERIES = {"op10_pfair_mix": op10_pfair_mix}
