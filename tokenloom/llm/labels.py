"""Labelled rows: held-out folds, and all or a bounded sample of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod modulus is remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def training_labels(labels: DataFrame, column: str, modulus: int, remainder: int, rows: int | None = None) -> DataFrame:
    """(doc_id, y) of the labelled documents outside the held-out fold: all, or at most about `rows` of either class.

    With `rows` the balance of the classes depends on the input's size, so shares and priors need all. Null
    labels and null doc_ids are left out; a doc_id with several labels takes the largest.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"), modulus, remainder)).groupBy("doc_id").agg(F.max("y").alias("y"))
    if rows is None:
        return known
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for y, count in n.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, rows / count))).otherwise(share)
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
