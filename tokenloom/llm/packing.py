"""Packing by optimal length buckets: bucket boundaries that minimise padding, and token-budget batches inside them.

The global histogram of lengths goes to the driver: one row of 16 bytes for each distinct length. d distinct
lengths need d^2 / 2 tokens at least, so 10^13 tokens have some 4.5 million at the very most.
Dynamic programming finds the boundaries with the least padding for a number of buckets, exactly: the cost of
a bucket is linear in its end for a given start, so each layer is a lower envelope of lines. A document is
padded to its bucket's length; a batch holds as many documents as the token budget allows at that length,
and at least one, so none is ever cut or dropped. Documents are numbered within a bucket by counting over
small chunks, so that a bucket with any share of the rows is not gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import stage
from tokenloom.llm.token_store import library_ids, text_slices

BUCKETS = 16
#: Tokens of a batch, padding included.
BUDGET = 65_536
#: Rows of a chunk, about; a chunk is numbered within one task.
CHUNK_ROWS = 20_000


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The largest length of each bucket, at most `buckets` of them, with the least total padding.

    lengths ascend and are distinct. Ties go to fewer buckets, then to the earliest cut found.
    """
    n = len(lengths)
    if not n:
        return []
    lengths, upto = [int(x) for x in lengths], [0, *np.cumsum(counts).tolist()]
    best = [0, *([float("inf")] * n)]
    cuts: list[list[int]] = []
    ends = []
    for _ in range(min(buckets, n)):
        now, cut = [float("inf")] * (n + 1), [0] * (n + 1)
        lines: list[int] = []  # starts i as lines -upto[i] * length + best[i]; the best one for growing lengths
        head = 0

        def crossing(i: int, j: int) -> tuple[int, int]:
            """From which length on the line of j lies below that of i (i < j), as a fraction."""
            return best[j] - best[i], upto[j] - upto[i]

        for j in range(1, n + 1):
            i = j - 1
            if best[i] < float("inf"):
                while len(lines) - head >= 2:
                    (p, q), (r, s) = crossing(lines[-2], lines[-1]), crossing(lines[-1], i)
                    if r * q > p * s:
                        break
                    lines.pop()
                lines.append(i)
            length = lengths[j - 1]
            value = lambda k: best[k] + length * (upto[j] - upto[k])  # noqa: B023, E731
            while len(lines) - head >= 2 and value(lines[head + 1]) < value(lines[head]):
                head += 1
            if len(lines) > head:
                now[j], cut[j] = value(lines[head]), lines[head]
        cuts.append(cut)
        ends.append(now[n])
        best = now
    k = int(np.argmin(ends))
    out, j = [], n
    while j > 0:
        out.append(lengths[j - 1])
        j, k = cuts[k][j], k - 1
    return out[::-1]


def token_lengths(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens by the tokenizers library; 0 for a null or empty text."""

    def run(batches):
        for batch in batches:
            n = [len(x) for some in text_slices(batch) for x in library_ids(path, some.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long")


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """lengths(doc_id, n_tokens) -> doc_id, n_tokens, bucket, bucket_len, batch_id, slot.

    bucket counts from 0 in order of bucket_len. Within a bucket, slots of batches are filled in the order of
    a hash of doc_id and n_tokens (then these), so batch_id (unique with its bucket) and slot depend on the
    rows only. Empty documents are packed like others; a null length counts as 0; repeated rows are counted
    first, numbered as one and packed each for itself; an empty table gives an empty table. A document longer
    than the budget is a batch alone.
    """
    rows = stage(lengths.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens")), "lengths")
    histogram = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toArrow()
    length, count = histogram["n_tokens"].to_numpy(), histogram["n"].to_numpy()
    ends = optimal_boundaries(length, count, buckets)
    if not ends:
        return rows.selectExpr("doc_id", "n_tokens", "cast(0 as int) bucket", "n_tokens bucket_len", "n_tokens batch_id", "cast(0 as int) slot")
    upto = np.r_[0, np.cumsum(count)][np.searchsorted(length, ends, side="right")].tolist()
    held = [b - a for a, b in zip([0, *upto], upto)]
    pick = lambda values, kind: F.element_at(F.array(*map(F.lit, values)), F.col("bucket") + 1).cast(kind)
    placed = rows.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("copies")).withColumn("bucket", F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col("n_tokens"))))
    placed = placed.withColumns({"bucket_len": pick(ends, "long"), "room": pick([max(1, budget // max(1, e)) for e in ends], "long"), "h": F.xxhash64("doc_id", "n_tokens")})
    placed = placed.withColumn("chunk", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * pick([max(1, -(-n // CHUNK_ROWS)) for n in held], "double")).cast("long"))
    counts = placed.groupBy("bucket", "chunk").agg(F.sum("copies").alias("n"))
    before = counts.select("bucket", "chunk", (F.sum("n").over(Window.partitionBy("bucket").orderBy("chunk")) - F.col("n")).alias("before"))
    own = F.sum("copies").over(Window.partitionBy("bucket", "chunk").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    place = placed.withColumn("own", own).join(before, ["bucket", "chunk"])
    # copies in stretches, so that no long array is made
    place = place.select("*", F.explode(F.expr(f"sequence(0L, copies - 1, {CHUNK_ROWS}L)")).alias("from"))
    place = place.select("*", F.explode(F.expr(f"sequence(`from`, least(`from` + {CHUNK_ROWS - 1}, copies - 1))")).alias("i")).withColumn("at", F.expr("before + own + i"))
    return place.select("doc_id", "n_tokens", "bucket", "bucket_len", F.expr("at div room").alias("batch_id"), F.expr("cast(at % room as int)").alias("slot"))
