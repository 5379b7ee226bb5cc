"""Samples that read only their groups, and the shuffle without a sort."""

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import corpus


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/d"
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), F.expr("cast(id % 7 as int)")).alias("text"), F.lit("x").alias("grpx"))
    rows.coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_ranges_reach_the_scan(stored):
    sample = corpus.stride_sample(stored, "doc_id", 50, 3, 4)
    assert sorted({r["doc_id"] // 50 for r in sample.collect()}) == [0, 4, 8] and sample.count() == 150
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,200)" in plan.split("PushedFilters")[1]
    assert corpus.stride_sample(stored, "doc_id", 50, 0, 4).count() == 0


def test_spread_numbers_are_the_spread_order(spark):
    for n in (0, 1, 2, 7, 100):
        want = [r["grp"] for r in corpus.spread_order(spark, n).orderBy("ord").collect()] if n else []
        assert [*corpus.spread_numbers(n)] == want and sorted(want) == [*range(n)]


def budget(rows, size, target, kept):
    """Groups in spread order until their bytes reach the target."""
    out, total = [], 0
    for ord_, g in enumerate(corpus.spread_numbers(max(r for r, _ in rows) // size + 1)):
        if total >= target:
            break
        own = [(d, t) for d, t in rows if d // size == g and kept(t)]
        out += [(d, g, ord_) for d, _ in own]
        total += sum(len(t.encode()) for _, t in own)
    return sorted(out)


def test_budget_of_what_is_kept(stored):
    rows = [(r["doc_id"], r["text"]) for r in stored.collect()]
    for target in (0, 1, 900, 5_000, 10**9):
        for keep, kept in ((None, lambda t: True), (lambda df: df.where("length(text) > 3"), lambda t: len(t) > 3)):
            found = corpus.byte_budget_sample(stored, "doc_id", 20, target, keep)
            assert sorted((r["doc_id"], r["grp"], r["ord"]) for r in found.collect()) == budget(rows, 20, target, kept), target
    assert corpus.byte_budget_sample(stored.limit(0), "doc_id", 20, 100).count() == 0


def test_shuffle_is_a_permutation(spark):
    for n in (1, 2, 3, 10, 1000, 4097):
        places = [r["p"] for r in spark.range(n).select(corpus.shuffled_place(F.col("id"), n, 5).alias("p")).collect()]
        assert sorted(places) == [*range(n)]
        if n == 1000:
            again = [r["p"] for r in spark.range(n).repartition(3).orderBy("id").select(corpus.shuffled_place(F.col("id"), n, 5).alias("p")).collect()]
            other = [r["p"] for r in spark.range(n).select(corpus.shuffled_place(F.col("id"), n, 6).alias("p")).collect()]
            assert again == places != other
            assert sum(abs(p - i) for i, p in enumerate(places)) / n > 250  # a random order is 333 apart
