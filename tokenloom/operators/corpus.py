"""Corpus preparation: sampling, overlap with evaluation texts, mixing, packing, batching, context fit."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions import text as T
from tokenloom.operators.overlap import overlapping_keys
from tokenloom.operators.running import joined_by, with_running_sum
from tokenloom.operators.staged import staged


#: Groups that a byte budget reads first, and at most at once; beyond as many in all, a join picks them instead of ranges.
FIRST_GROUPS, MOST_GROUPS = 8, 512


def in_ranges(key: str, size: int, groups: Iterable[int]) -> Column:
    """Whether a whole number lies in one of the groups of `size` neighbouring ones, as ranges that a scan can skip by.

    Neighbouring groups make one range.
    """
    out, begin, end = F.lit(False), None, None
    for g in [*sorted(groups), None]:
        if begin is not None and (g is None or g > end):
            out, begin = out | ((F.col(key) >= begin * size) & (F.col(key) < end * size)), None
        if g is not None:
            begin, end = g if begin is None else begin, g + 1
    return out


def stride_sample(docs: DataFrame, key: str, size: int, groups: int, every: int, holdout: bool = False) -> DataFrame:
    """Rows of `groups` groups of `size` neighbouring keys, every `every`-th one; a held-out sample begins half a stride later.

    every must be 2 or more: with 1 the two samples would share their groups. The groups are ranges of the key, so
    a scan reads only the row groups of files that hold some; null keys are in no group.
    """
    if every < 2:
        raise ValueError("every must be at least 2")
    start = every // 2 if holdout else 0
    return docs.where(in_ranges(key, size, range(start, start + groups * every, every)))


def spread_order(spark: SparkSession, n: int) -> DataFrame:
    """(ord, grp): 0 to n-1 in an order of which every prefix is spread over the whole range.

    Level k of 0, 1, 2, ... visits the middles of 2^k equal parts; the first visit of a number counts.
    """
    levels = max(1, math.ceil(math.log2(max(2, n))) + 2)
    visits = spark.range(levels).select(F.col("id").alias("level"), F.expr("explode(sequence(0L, shiftleft(1L, cast(id as int)) - 1))").alias("i"))
    place = visits.withColumn("grp", F.expr(f"(2 * i + 1) * {n}L div shiftleft(2L, cast(level as int))"))
    first = place.where(F.col("grp") < n).groupBy("grp").agg(F.min(F.struct("level", "i")).alias("at"))
    return first.select(F.row_number().over(Window.orderBy("at")).cast("long").alias("ord"), "grp").withColumn("ord", F.col("ord") - 1)


def contains_any(docs: DataFrame, banned: DataFrame, least: int = 30, by: str | None = None) -> DataFrame:
    """docs with `overlap`: whether the text holds one of banned(text) of `least` characters or more, as a substring.

    With `by`, a column of both tables such as the language, only evaluation texts of the document's own value
    count; a null there meets nothing. Null texts hold nothing. The texts that overlap are found by anchors
    (operators/overlap.py) and joined to the documents by a digest, so copies are compared as one.
    """
    own = F.col(by).cast("string") if by else F.lit("")
    wanted = banned.where(F.char_length("text") >= least).select("text", own.alias("own")).where("own is not null").distinct()
    texts = docs.select("text", own.alias("own"), F.sha2(F.col("text").cast("binary"), 256).alias("key")).where("text is not null and own is not null")
    found = staged(overlapping_keys(texts, wanted, least).select(F.col("key").alias("__key"), F.col("own").alias("__found")), "overlap")
    # rows without a key are spread over the join by the partition they come from
    spread = F.concat(F.lit("-"), F.spark_partition_id().cast("string"))
    keyed = docs.withColumns({"__text_key": F.coalesce(F.sha2(F.col("text").cast("binary"), 256), spread), "__own": F.coalesce(own, F.lit(""))})
    joined = keyed.join(found, (F.col("__text_key") == F.col("__key")) & (F.col("__own") == F.col("__found")), "left")
    joined = joined.withColumn("overlap", F.col("__key").isNotNull() & own.isNotNull())
    return joined.drop("__text_key", "__own", "__key", "__found")


def decontaminate(docs: DataFrame, banned: DataFrame, least: int = 30, by: str | None = None) -> DataFrame:
    """docs without those that hold an evaluation text, of their own value of `by` if that is given."""
    return contains_any(docs, banned, least, by).where(~F.col("overlap")).drop("overlap")


def spread_numbers(n: int) -> Iterator[int]:
    """0 to n-1 in the order of spread_order(), one after another."""
    seen: set[int] = set()
    for level in range(max(1, math.ceil(math.log2(max(2, n))) + 2)):
        for i in range(1 << level):
            at = (2 * i + 1) * n // (2 << level)
            if at < n and at not in seen:
                seen.add(at)
                yield at


def byte_budget_sample(docs: DataFrame, key: str, size: int, target: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Documents of whole groups in spread order until their bytes reach the target; the group that reaches it stays whole.

    A group is `size` neighbouring whole numbers of the key. Of its documents only those that `keep` leaves are
    taken and count, such as decontaminate(). Adds grp and ord, the group and its place in the order. Groups are
    read in batches until the bytes suffice, each by ranges of the key that a scan can skip by, the next batch as
    large as the bytes so far suggest; other groups are never read. Rows without a key are in no group.
    """
    spark = docs.sparkSession
    last = docs.agg(F.max(key)).first()[0]
    left = spread_numbers(0 if last is None or last < 0 else int(last) // size + 1)
    taken: list[tuple[int, int]] = []  # groups in order and the bytes before them
    done, step, total = False, FIRST_GROUPS, 0
    while not done and (batch := [*itertools.islice(left, step)]):
        some = docs.where(in_ranges(key, size, batch))
        some = keep(some) if keep else some
        found = some.groupBy(F.floor(F.col(key) / size).alias("grp")).agg(F.sum(T.octets(F.col("text"))).alias("size")).collect()
        sizes = {r["grp"]: r["size"] or 0 for r in found}
        for g in batch:
            if total >= target:
                done = True
                break
            taken.append((len(taken), g))
            total += sizes.get(g, 0)
        each = max(1, total // max(1, len(taken)))
        step = min(MOST_GROUPS, max(1, (target - total) // each + 1))
    order = spark.createDataFrame(taken, "ord long, grp long")
    some = docs.where(in_ranges(key, size, [g for _, g in taken])) if len(taken) <= MOST_GROUPS else docs
    some = (keep(some) if keep else some).withColumn("grp", F.floor(F.col(key) / size).cast("long"))
    return some.join(order, "grp")


def mixture(sized: DataFrame, caps: dict[str, int]) -> DataFrame:
    """sized(doc_id, lang, size) of the languages in caps, interleaved so that each keeps its share of bytes.

    size is a document's bytes; texts are better joined to the result than carried through it.

    A document's place is the share of its language's bytes that go before it; documents beyond a language's
    cap do not take part; equal places go to the language named first. Adds bytes_before, share and rank_lang.
    """
    langs = [*caps]
    own = with_running_sum(sized.where(F.col("lang").isin(langs)), ["lang"], "doc_id", F.col("size"), "bytes_before")
    cap = F.lit(None).cast("long")
    place = F.lit(None).cast("int")
    for i, (lang, most) in enumerate(caps.items()):
        cap, place = F.when(F.col("lang") == lang, F.lit(most)).otherwise(cap), F.when(F.col("lang") == lang, F.lit(i)).otherwise(place)
    return own.where(F.col("bytes_before") < cap).withColumns({"share": F.col("bytes_before") / cap, "rank_lang": place})


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with `name`: their number from 0 in the order of a unique key of numbers, counted over chunks."""
    return with_running_sum(rows, [], key, F.lit(1).cast("long"), name)


def in_mixed_order(mixed: DataFrame, value: Column, name: str) -> DataFrame:
    """mixed with `name`: the sum of value over the rows before in the mixture's order."""
    return with_running_sum(mixed, [], "share", value, name, then=("rank_lang", "doc_id"))


#: Rounds of the shuffle's bijection.
ROUNDS = 6


def shuffled_place(i: Column, n: int, seed: int) -> Column:
    """The place of row i of n (0 <= i < n) in a repeatable shuffle: a keyed bijection of 0 to n-1, without a sort.

    A Feistel network permutes the numbers of as many bits, up to four times n; a place beyond n is sent through
    again until it lies within (cycle walking), which keeps it a bijection and takes four steps a row at most on average.
    """
    if n < 2:
        return i
    half = max(1, math.ceil(math.log2(n) / 2))

    @F.arrow_udf("long")
    def walked(column: pa.Array) -> pa.Array:
        v = column.to_numpy(zero_copy_only=False).astype(np.int64)
        mask, away = (1 << half) - 1, np.ones(len(v), bool)
        while away.any():
            at = v[away]
            left, right = at >> half, at & mask
            for k in range(ROUNDS):
                left, right = right, left ^ (((right * 2654435769 + 40503 * (k + 1) + seed * 1000003) >> 7) & mask)
            v[away] = left << half | right
            away &= v >= n
        return pa.array(v)

    return walked(i)


def packed_blocks(lengths: DataFrame, seq: int) -> DataFrame:
    """lengths(doc_id, n_tokens) laid end to end and cut into blocks of seq + 1: (doc_id, block, begins, tokens).

    One row for each part of a document that lies in a whole block; what is left after the last whole block
    is dropped.
    """
    size = seq + 1
    placed = with_running_sum(lengths, [], "doc_id", F.col("n_tokens"), "at")
    total = F.lit(lengths.agg(F.sum("n_tokens")).first()[0] or 0)
    spans = placed.where("n_tokens > 0").withColumn("block", F.explode(F.expr(f"sequence(at div {size}, (at + n_tokens - 1) div {size})")))
    spans = spans.where(F.col("block") < F.floor(total / size))
    first = F.greatest(F.col("at"), F.col("block") * size)
    return spans.select("doc_id", "block", (first - F.col("block") * size).alias("begins"), (F.least(F.col("at") + F.col("n_tokens"), (F.col("block") + 1) * size) - first).alias("tokens"))


def rank_shard(blocks: DataFrame, n_blocks: int, world: int) -> DataFrame:
    """blocks with the rank that reads each; the blocks that do not fill a round are dropped."""
    return blocks.where(F.col("block") < n_blocks - n_blocks % world).withColumn("rank", (F.col("block") % world).cast("int"))


def padded_batches(lengths: DataFrame, batch: int, by_length: bool = True) -> DataFrame:
    """Batches of `batch` documents in order of length (or of doc_id): batch_id, docs, longest, padded cost.

    Rows are numbered by counts over lengths and running sums, not in one sorted partition. Rows without a length
    come last, and count as rows only.
    """
    key = F.col("n_tokens") if by_length else F.lit(0).cast("long")
    rows = lengths.withColumn("__key", key)
    counts = rows.groupBy("__key").agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__offset", F.sum("__n").over(Window.orderBy(F.col("__key").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).drop("__n")
    rows = joined_by(with_running_sum(rows, ["__key"], "doc_id", F.lit(1).cast("long"), "__in_key"), counts, ["__key"])
    placed = rows.withColumn("batch_id", F.expr(f"(__offset + __in_key) div {batch}"))
    return placed.groupBy("batch_id").agg(F.count("*").alias("docs"), F.max("n_tokens").alias("longest"), F.sum("n_tokens").alias("tokens")).withColumn("padded", F.col("docs") * F.col("longest"))


def context_fit(texts: DataFrame, by: list[str], order: str, context: int) -> DataFrame:
    """texts(n_tokens): per group how many of the first texts fit into a context together, and whether all do."""
    run = with_running_sum(texts, by, order, F.col("n_tokens"), "before")
    fits = F.count_if(F.col("before") + F.col("n_tokens") <= context)
    return run.groupBy(*by).agg(F.count("*").alias("sentences"), F.sum("n_tokens").alias("tokens"), fits.alias("fit"), (fits == F.count("*")).alias("fits_all"))


def long_document(docs: DataFrame, n: int = 3000) -> DataFrame:
    """The first document of more than n characters, cut to n."""
    return docs.where(F.char_length("text") > n).orderBy("doc_id").limit(1).withColumn("text", F.substring("text", 1, n))


def learning_rates(spark: SparkSession, steps: int, warm_up: int, peak: float, last: float = 0.1) -> DataFrame:
    """(step, rate): linear warm-up, then a cosine down to `last` of the peak."""
    step = F.col("id").cast("double")
    cosine = last + (1 - last) * 0.5 * (1 + F.cos(F.lit(math.pi) * (step - warm_up) / max(1, steps - warm_up)))
    return spark.range(steps).select(F.col("id").alias("step"), (peak * F.when(step < warm_up, (step + 1) / max(1, warm_up)).otherwise(cosine)).alias("rate"))
