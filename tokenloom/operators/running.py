"""Running sums that no single task has to hold: within chunks of the order, plus the sums of the chunks before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.operators.staged import staged

#: Chunks per group, about: one for so many rows of the table, within these limits.
CHUNK_ROWS, LEAST_CHUNKS, MOST_CHUNKS = 500_000, 64, 4096


def joined_by(rows: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of few, by equal values, of which nulls are one too."""
    named = few.withColumnsRenamed({c: f"__by_{i}" for i, c in enumerate(by)})
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__by_{i}")) for i, c in enumerate(by)))
    return rows.join(named, same).drop(*(f"__by_{i}" for i in range(len(by))))


def with_running_sum(rows: DataFrame, by: list[str], order: str, value: Column, name: str, then: tuple[str, ...] = ()) -> DataFrame:
    """rows with `name`: the sum of value over the group's rows before this one in the order of a column of numbers.

    The column must be unique unless `then` names columns that order its equal values; those share a chunk.

    A group of any size is cut into chunks at quantiles of the order; only the chunks' sums are summed over the
    whole group. The quantiles are approximate and may differ each time they are computed, so they are staged:
    the rows and the chunks' sums must be cut at the same places. Groups are joined without hints: their few rows
    are broadcast while they are small, and a hot group's rows are split otherwise. Rows without an order come
    last, as in SQL, in a chunk of their own.
    """
    rows = staged(rows.withColumn("__value", value), "running")  # what the rows are made of is read once
    chunks = min(MOST_CHUNKS, max(LEAST_CHUNKS, rows.count() // CHUNK_ROWS))
    shares, accuracy = [i / chunks for i in range(1, chunks)], max(1000, 10 * chunks)
    cuts = rows.groupBy(*by).agg(F.percentile_approx(order, shares, accuracy).alias("__cuts")) if by else rows.agg(F.percentile_approx(order, shares, accuracy).alias("__cuts"))
    cuts = staged(cuts, "cuts")
    placed = joined_by(rows, cuts, by) if by else rows.crossJoin(F.broadcast(cuts))
    chunk = F.when(F.col(order).isNull(), chunks).otherwise(F.size(F.filter("__cuts", lambda c: c < F.col(order))))
    placed = placed.withColumn("__chunk", chunk).drop("__cuts")
    sums = placed.groupBy(*by, "__chunk").agg(F.sum("__value").alias("__sum"))
    before = sums.select(*by, "__chunk", (F.sum("__sum").over(Window.partitionBy(*by).orderBy("__chunk")) - F.col("__sum")).alias("__before"))
    own = F.sum("__value").over(Window.partitionBy(*by, "__chunk").orderBy(F.col(order).asc_nulls_last(), *then).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__value")
    return joined_by(placed.withColumn("__own", own), before, [*by, "__chunk"]).withColumn(name, F.col("__before") + F.col("__own")).drop("__own", "__before", "__value", "__chunk")
