"""Byte-pair vocabularies over distinct words: counting, learning, encoding, confining, appending, checking.

Words are strings of bytes in hexadecimal, their symbols marked as <65><66>, so that merging a pair is one
string replacement from the left, which is what byte-pair encoding does with a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions import text as T
from tokenloom.functions.replay import Merge, replayed
from tokenloom.operators.learner import MOST_PAIRS, MOST_SEGMENTS, learned_round
from tokenloom.operators.staged import staged, unstaged

#: Pairs looked at in a round of the learner, at least.
TOP_PAIRS = 256
#: Merges that are applied as nested replacements; more are applied by rank, over Arrow batches.
NESTED = 8


def word_counts(texts: DataFrame, keep: Callable[[Column], Column] | None = None, pattern: str = T.PATTERN, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, word, n): pieces of the pre-tokenizer that keep accepts, as hexadecimal bytes."""
    pieces = texts.select(*by, F.explode(T.pieces(F.col("text"), pattern)).alias("piece"))
    if keep is not None:
        pieces = pieces.where(keep(F.col("piece")))
    return pieces.groupBy(*by, F.hex(F.encode("piece", "UTF-8")).alias("word")).agg(F.count("*").alias("n"))


def bytes_as_symbols(word: Column) -> Column:
    """<65><66> of the hexadecimal 6566."""
    return F.regexp_replace(word, "(..)", "<$1>")


def symbols(marked: Column) -> Column:
    """The symbols of <65><66> as an array."""
    return F.filter(F.split(F.regexp_replace(marked, "^<|>$", ""), "><"), lambda s: s != "")


def merged(marked: Column, merges: Iterable[Merge]) -> Column:
    """marked after the merges, in order."""
    merges = [*merges]
    if len(merges) > NESTED:
        return _by_rank(merges)(marked)
    for a, b in merges:
        marked = F.replace(marked, F.lit(f"<{a}><{b}>"), F.lit(f"<{a}{b}>"))
    return marked


def _by_rank(merges: list[Merge]):
    ranks: dict[Merge, list[int]] = {}

    @F.pandas_udf("string")
    def apply(marked: pd.Series) -> pd.Series:
        if not ranks:
            for i, m in enumerate(merges):
                ranks.setdefault(tuple(m), []).append(i)
        return marked.map(lambda m: "<" + "><".join(replayed(m[1:-1].split("><"), merges, ranks)) + ">" if m else m, na_action="ignore")

    return apply


def pair_counts(words: DataFrame) -> DataFrame:
    """words(marked, n) -> (left, right, count): how often each pair of symbols stands side by side."""
    s = words.select(symbols(F.col("marked")).alias("s"), "n").where(F.size("s") > 1)
    pairs = s.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.struct(F.element_at("s", i).alias("left"), F.element_at("s", i + 1).alias("right")))).alias("p"), "n")
    return pairs.groupBy("p.left", "p.right").agg(F.sum("n").alias("count"))


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs by count, then by left and right symbol."""
    return pairs.orderBy(F.desc("count"), "left", "right")


def learn(words: DataFrame, n: int, base: list[Merge] = (), least: int = 2, most_pairs: int = MOST_PAIRS, most_segments: int = MOST_SEGMENTS) -> list[Merge]:
    """Up to n merges that continue base on words(word, n); learning stops below `least` occurrences.

    The result is that of one merge a step: a round makes as many as the counts of its frequent stretches decide
    (operators/learner.py). Where more pairs are equally frequent than a round may hold, it makes those that
    are certain from the counts alone. Words are written after each round, and what was written before is deleted.
    """
    words = staged(words.select(merged(bytes_as_symbols(F.col("word")), base).alias("marked"), "n"), "words")
    made: list[Merge] = []
    known, looked = {a + b for a, b in base}, min(most_pairs, max(TOP_PAIRS, 8 * n))  # few merges need few pairs
    while len(made) < n:
        top = [(r["left"], r["right"], r["count"]) for r in ranked_pairs(pair_counts(words)).limit(looked + 1).collect()]
        whole = len(top) <= looked or top[-1][2] < least
        top = [t for t in top if t[2] >= least]
        if not top:
            break
        step, used = learned_round(words, top, whole, n - len(made), least, {*known}, most_segments)
        if not step:
            step = certain_merges(top, n - len(made), least, whole, known)
        made += step
        known |= {a + b for a, b in step}
        looked = min(most_pairs, max(TOP_PAIRS, 4 * used))
        if len(made) < n:
            words, before = staged(words.select(merged(F.col("marked"), step).alias("marked"), "n"), "words"), words
            unstaged(before)
    unstaged(words)
    return made


def certain_merges(top: list[tuple[str, str, int]], most: int, least: int, whole: bool, known: Iterable[str] = ()) -> list[Merge]:
    """The longest run of merges from ranked pairs that counting again after each would give too.

    Merging (a, b) makes pairs rarer that end in a or begin with b, and no others; the new pairs are no more
    frequent than the ones they come from. So a pair stays next in rank while it, and all as frequent, are not
    of that kind. If the new symbol was there before (known), its old pairs grow, and the run ends with it.
    """
    out: list[Merge] = []
    lefts, rights, symbols_made = set(), set(), {*known}
    for a, b, n in top:
        if len(out) == most or n < least:
            break
        if out:
            equals = [p for p in top if p[2] == n]
            if any(p in rights or q in lefts for p, q, _ in equals) or (not whole and equals[-1] == top[-1]):
                break
        out.append((a, b))
        lefts.add(a)
        rights.add(b)
        # in a run of one symbol the new pairs can rank anywhere below
        if a == b or a + b in symbols_made:
            break
        symbols_made.add(a + b)
    return out


def encoded(words: DataFrame, merges: list[Merge]) -> DataFrame:
    """words(word, ...) with ids' symbols: base bytes merged in order of rank."""
    return words.withColumn("symbols", symbols(merged(bytes_as_symbols(F.col("word")), merges)))


def confine(merges: DataFrame, vocab: DataFrame, marker: Callable[[Column], Column]) -> DataFrame:
    """Of merges(rank, left, right) those whose token marker accepts and whose parts are tokens of vocab or made before.

    Merges with a part that neither vocab(token) nor an earlier merge left gives are dropped, round after round
    until none is; as ranks ascend, what is left then is the only such set. Needs a round for each merge in the
    longest chain that falls, two or three as a rule.
    """
    known = vocab.select("token", F.lit(-1).alias("made")).distinct()
    left = staged(merges.select("rank", "left", "right", F.concat("left", "right").alias("token")).where(marker(F.concat("left", "right"))), "merges")
    while True:
        made = left.groupBy("token").agg(F.min("rank").alias("made")).unionByName(known).groupBy("token").agg(F.min("made").alias("made"))
        of = lambda side: made.select(F.col("token").alias(side), F.col("made").alias(f"made_{side}"))  # noqa: B023, E731
        next_ = staged(left.join(of("left"), "left").join(of("right"), "right").where("made_left < rank and made_right < rank").select("rank", "left", "right", "token"), "merges")
        if next_.count() == left.count():
            return next_.select("rank", "left", "right")
        left = next_


def learn_confined(words: DataFrame, n: int, vocab: DataFrame, marker: Callable[[Column], Column], base: list[Merge] = (), margin: float = 1.25) -> DataFrame:
    """Up to n confined merges(rank, left, right): n * margin are learned, as confining drops some of them."""
    spark = words.sparkSession
    learned = learn(words, int(n * margin), base)
    merges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(learned)], "rank int, left string, right string")
    return confine(merges, vocab, marker).orderBy("rank").limit(n)


def in_script(script: str) -> Callable[[Column], Column]:
    """A marker for tokens of hexadecimal bytes: whether they hold the start of a character of the script."""
    return lambda token: T.bytes_in_script(F.unhex(token), script)


def new_merges(own: DataFrame, merges: DataFrame) -> DataFrame:
    """merges(rank, left, right) that own(left, right) lacks, each once at its first rank."""
    return merges.groupBy("left", "right").agg(F.min("rank").alias("rank")).join(own, ["left", "right"], "left_anti").select("rank", "left", "right")


def appended_ids(spark: SparkSession, vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """vocab(token, id), merges(rank, left, right) -> (token, id) of the new tokens, numbered after the largest id."""
    made = merges.groupBy(F.concat("left", "right").alias("token")).agg(F.min("rank").alias("rank")).join(vocab, "token", "left_anti")
    last = vocab.agg(F.max("id")).first()[0]
    return made.select("token", (F.row_number().over(Window.orderBy("rank")) + F.lit(-1 if last is None else last)).cast("long").alias("id"))


def extended_config(spark: SparkSession, config: dict, merges: DataFrame) -> dict:
    """A tokenizer configuration with merges(rank, left, right) that it lacks behind its own, and their tokens.

    Added tokens take part in the numbering. A configuration is one file, so the result is made on the driver.
    """
    model = config["model"]
    in_pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
    more = staged(new_merges(spark.createDataFrame(in_pairs, "left string, right string"), merges), "new-merges")
    ids = [*model["vocab"].items(), *((t["content"], t["id"]) for t in config.get("added_tokens") or ())]
    fresh = appended_ids(spark, spark.createDataFrame(ids, "token string, id long"), more)
    behind = [[r["left"], r["right"]] for r in more.orderBy("rank").collect()]
    as_text = bool(model["merges"]) and isinstance(model["merges"][0], str)
    tokens = model["vocab"] | {r["token"]: r["id"] for r in fresh.collect()}
    return {**config, "model": {**model, "vocab": tokens, "merges": [*model["merges"], *(map(" ".join, behind) if as_text else behind)]}}


def ladder(words: DataFrame, merges: list[Merge], sizes: list[int], by: tuple[str, ...] = (), base: list[Merge] = ()) -> DataFrame:
    """(by, size, tokens): tokens of words(by, word, n) with base and the first `size` merges, all sizes in one pass."""
    marked, columns = merged(bytes_as_symbols(F.col("word")), base), []
    done = 0
    for size in sorted(sizes):
        marked = merged(marked, merges[done:size])
        done = size
        columns.append(F.struct(F.lit(size).alias("size"), F.size(symbols(marked)).alias("tokens")))
    rows = words.select(*by, F.explode(F.array(*columns)).alias("s"), "n")
    return rows.groupBy(*by, "s.size").agg(F.sum(F.col("s.tokens") * F.col("n")).alias("tokens"))


def unreachable(vocab: DataFrame, pattern: str = T.PATTERN) -> DataFrame:
    """vocab(token, ...), tokens as text: those that the pre-tokenizer always splits, with the number of pieces."""
    return vocab.withColumn("pieces", T.floor(F.col("token"), pattern)).where("pieces > 1")


def stop_tokens(vocab: DataFrame) -> DataFrame:
    """Tokens whose text holds a line break."""
    return vocab.where(F.contains("token", F.lit("\n")))


def new_tokens(extended: DataFrame, base: DataFrame) -> DataFrame:
    """Tokens of one vocabulary that another lacks."""
    return extended.join(base, "token", "left_anti")


def mean_vectors(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """members(token, vec_id), vectors(vec_id, embedding) -> (token, embedding): means of the members' vectors.

    A vector stays one value: each task adds up the vectors of a token before the shuffle.
    """
    each = members.join(vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v")), "vec_id")
    return each.groupBy("token").agg(Summarizer.mean(F.col("v")).alias("m")).select("token", vector_to_array("m").alias("embedding"))


def base_pieces(tokens: DataFrame, merges: list[Merge], vocab: DataFrame) -> DataFrame:
    """tokens(token), vocab(token, id) -> (token, vec_id): the ids into which the base merges encode each token's bytes, one row each."""
    cut = encoded(tokens.select(F.col("token").alias("word")), merges).select("word", F.posexplode("symbols").alias("at", "piece"))
    return cut.join(vocab.select(F.col("token").alias("piece"), F.col("id").alias("vec_id")), "piece").select(F.col("word").alias("token"), "vec_id")


def extended_embeddings(vectors: DataFrame, vocab: DataFrame, merges: list[Merge], fresh: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding) of a vocabulary, and fresh(token, id) -> (id, token, embedding): the rows to add.

    A new token's row is the mean of the rows of its pieces in the base vocabulary. The table they go to has
    padded_size() rows of both.
    """
    means = mean_vectors(base_pieces(fresh, merges, vocab), vectors)
    return fresh.join(means, "token").select("id", "token", "embedding")


def padded_size(n: int, multiple: int = 128) -> int:
    """n rounded up to a multiple."""
    return -(-n // multiple) * multiple


def cosine_to_mean(vectors: DataFrame) -> DataFrame:
    """(vec_id, cosine): cosine of each vector with the mean of all."""
    mean = vectors.select(F.posexplode("embedding").alias("at", "v")).groupBy("at").agg(F.avg(F.col("v").cast("double")).alias("v"))
    m = np.array([r["v"] for r in mean.orderBy("at").collect()])
    centre = F.array(*map(F.lit, m.tolist()))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    own = F.transform("embedding", lambda x: x.cast("double"))
    return vectors.select("vec_id", (dot(own, centre) / F.sqrt(dot(own, own) * float(m @ m))).alias("cosine"))
