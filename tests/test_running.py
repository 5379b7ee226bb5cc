"""Running sums whose quantiles differ each time they are computed, and rows without an order or a length."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import corpus, running


@pytest.fixture
def shaken(spark, monkeypatch):
    """Quantiles that are others in each evaluation, as merged sketches may be, in plans that reuse no exchange."""
    anywhere = F.udf(lambda last: sorted(random.SystemRandom().sample(range(last), 63)), "array<long>").asNondeterministic()
    monkeypatch.setattr(running.F, "percentile_approx", lambda order, shares, accuracy: anywhere(F.max(order)))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield
    spark.conf.unset("spark.sql.exchange.reuse")


def batches(rows, size, key):
    ordered = [n for _, n in sorted(rows, key=key)]
    some = [ordered[i : i + size] for i in range(0, len(ordered), size)]
    known = [[n for n in b if n is not None] for b in some]
    return {(i, len(b), max(k, default=None), sum(k) if k else None, len(b) * max(k) if k else None) for i, (b, k) in enumerate(zip(some, known))}


def last(value):
    return value is None, value or 0


def test_rows_and_sums_are_cut_alike(spark, shaken):
    rng = random.Random(3)
    rows = [(i, rng.choice([3, 3, 5, 900])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").repartition(5)
    assert {tuple(r) for r in corpus.padded_batches(df, 16, by_length=False).collect()} == batches(rows, 16, lambda r: r[0])
    assert {tuple(r) for r in corpus.padded_batches(df, 16).collect()} == batches(rows, 16, lambda r: (r[1], r[0]))
    placed = running.with_running_sum(df, [], "doc_id", F.col("n_tokens"), "before").collect()
    assert sorted((r["doc_id"], r["before"]) for r in placed) == [*enumerate(accumulate([0] + [n for _, n in rows[:-1]]))]


def test_rows_without_an_order_or_a_length_come_last(spark):
    rows = [(i, [7, None, 4, 0, 7][i % 5]) for i in range(100)] + [(None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    assert {tuple(r) for r in corpus.padded_batches(df, 8, by_length=False).collect()} == batches(rows, 8, lambda r: last(r[0]))
    assert {tuple(r) for r in corpus.padded_batches(df, 8).collect()} == batches(rows, 8, lambda r: (last(r[1]), last(r[0])))
