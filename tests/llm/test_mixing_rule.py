"""One rule of mixing for any number of sources."""

from caselake.llm import mixing


def test_groups_are_dealt_alike_on_both_sides_of_their_number(spark):
    """A source alone in its group is scheduled as in one level; with one source more than there are groups, only the
    two that share a group lose their own windows."""
    for n in (8, 9):
        targets = spark.createDataFrame([(f"s{k}", 1, 20 - k) for k in range(n)], "source string, n_docs long, q long")
        units = sum(20 - k for k in range(n))
        got = mixing.period(targets, units, 8).collect()
        assert sorted(r.slot for r in got) == list(range(units))
        shared = {"s4", "s8"} if n == 9 else set()
        for r in got:
            q = 20 - int(r.source[1:])
            assert r.release <= r.slot < r.deadline
            assert r.source in shared or (r.release, r.deadline) == (r.i * units // q, -(-(r.i + 1) * units // q))


def test_order_of_rows_without_an_id_does_not_hang_on_the_size_of_buckets(spark, monkeypatch):
    df = spark.range(400).selectExpr("cast(NULL AS long) AS doc_id", "'a' AS source", "id AS n").coalesce(1)
    slots = []
    for most in (20_000, 10):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", most)
        slots.append(sorted((r.n, r.block) for r in mixing.mix(df, block_docs=2).collect()))
    assert slots[0] == slots[1]
