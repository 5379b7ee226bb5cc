"""Scores over tables of model outputs: bits per byte, choice accuracy, chrF++, throughput, comparisons."""

from __future__ import annotations

import re
import string
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions import text as T


def bits_per_byte(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """scored(logp, bytes, tokens): -log2 p per byte; natural logarithms are given."""
    return scored.groupBy(*by).agg(F.try_divide(-F.sum("logp") / F.log(F.lit(2.0)), F.sum("bytes")).alias("bits_per_byte"), F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"))


def choices(scored: DataFrame) -> DataFrame:
    """scored(question, k, logp, bytes) -> (question, choice): the best log-probability per byte, the first of equals."""
    best = F.row_number().over(Window.partitionBy("question").orderBy(F.desc(F.col("logp") / F.col("bytes")), "k"))
    return scored.withColumn("__place", best).where("__place = 1").select("question", F.col("k").alias("choice"))


def accuracy(chosen: DataFrame, answers: DataFrame) -> DataFrame:
    """Share of questions whose choice is the answer."""
    right = (F.col("choice") == F.col("answer")).cast("int")
    return chosen.join(answers, "question").agg(F.avg(right).alias("accuracy"), F.count("*").alias("questions"))


_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_PUNCTUATION = frozenset(string.punctuation)


def _words(text: str) -> list[str]:
    """Words, with one punctuation mark at an end (the last, else the first) parted from them."""
    out = []
    for w in filter(None, _SPACE.split(text)):
        if len(w) > 1 and w[-1] in _PUNCTUATION:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in _PUNCTUATION:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def gram_counts(hypothesis: str, reference: str, characters: int, words: int) -> list[int]:
    """For each order of character and word n-grams: common ones (clipped), those of the hypothesis, those of the reference."""
    out = []
    plain = [_SPACE.sub("", t) for t in (hypothesis, reference)]
    parted = [_words(t) for t in (hypothesis, reference)]
    for units, most in ((plain, characters), (parted, words)):
        for n in range(1, most + 1):
            h, r = (Counter(u[i : i + n] if isinstance(u, str) else tuple(u[i : i + n]) for i in range(len(u) - n + 1)) for u in units)
            out += [(h & r).total(), h.total(), r.total()]
    return out


def chrf(pairs: DataFrame, by: tuple[str, ...] = (), characters: int = 6, words: int = 2, beta: float = 2.0) -> DataFrame:
    """pairs(hypothesis, reference) -> corpus chrF++ from clipped n-gram counts, 0 to 100.

    Both texts are in one row, so n-grams are counted there, and only three numbers for each order are shuffled. A
    pair with a null text does not count; orders that one side lacks drop out of the mean; without any, it is null.
    """

    @F.pandas_udf("array<long>")
    def counted(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
        return pd.Series([None if h is None or r is None else gram_counts(h, r, characters, words) for h, r in zip(hypothesis, reference)], dtype=object)

    orders = range(characters + words)
    counts = pairs.select(*by, counted("hypothesis", "reference").alias("c"))
    sums = counts.groupBy(*by).agg(*(F.sum(F.get("c", F.lit(3 * i + k))).alias(f"{x}{i}") for i in orders for k, x in enumerate("mhr")))
    both = [(F.col(f"h{i}") > 0) & (F.col(f"r{i}") > 0) for i in orders]
    mean = lambda side: sum((F.when(ok, F.col(f"m{i}") / F.col(f"{side}{i}")).otherwise(0.0) for i, ok in zip(orders, both)), F.lit(0.0)) / sum((F.when(ok, 1).otherwise(0) for ok in both), F.lit(0))
    any_ = sum((F.when(ok, 1).otherwise(0) for ok in both), F.lit(0)) > 0
    means = sums.where(any_).select(*by, mean("h").alias("p"), mean("r").alias("r"))
    f = (1 + beta**2) * F.col("p") * F.col("r") / (beta**2 * F.col("p") + F.col("r"))
    return means.select(*by, F.when(F.col("p") + F.col("r") > 0, 100 * f).otherwise(0.0).alias("chrf"))


def throughput(timings: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """timings(seconds, tokens, sentences): milliseconds a token, seconds a sentence, tokens a second."""
    s = timings.groupBy(*by).agg(F.sum("seconds").alias("seconds"), F.sum("tokens").alias("tokens"), F.sum("sentences").alias("sentences"))
    return s.withColumns({"ms_per_token": F.try_divide(1000 * F.col("seconds"), F.col("tokens")), "seconds_per_sentence": F.try_divide("seconds", "sentences"), "tokens_per_second": F.try_divide("tokens", "seconds")})


def best_of(timings: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The fastest repeat."""
    return timings.groupBy(*by).agg(F.min("seconds").alias("seconds"))


def speed_up(rows: DataFrame, base: str) -> DataFrame:
    """rows(tokenizer, lang, seconds): the baseline's seconds over each tokenizer's, by language."""
    own = F.max(F.when(F.col("tokenizer") == base, F.col("seconds"))).over(Window.partitionBy("lang"))
    return rows.withColumn("speed_up", F.try_divide(own, "seconds"))


def latest(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Of rows with equal keys the last by `order`, null first; one aggregate, so hot keys are reduced where they lie."""
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in key), F.lit(0).alias("__any")), F.struct(order)).alias("__last"))
    return last.select(*key, "__last.*").drop("__any").select(*rows.columns)


def ordered_distinct(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, order): every distinct value with the place where it is first met."""
    return rows.groupBy(value).agg(F.min(order).alias(order))


def ordinary(rows: DataFrame, column: str) -> DataFrame:
    """Result rows that have the column; rows of another kind, such as prefill timings, lack it."""
    return rows.where(F.col(column).isNotNull())


def beside(base: DataFrame, extended: DataFrame) -> DataFrame:
    """base(lang, tax), extended(lang, tax) -> (lang, tax, extended_tax, gain) of languages that both have."""
    both = base.select("lang", "tax").join(extended.select("lang", F.col("tax").alias("extended_tax")), "lang")
    return both.withColumn("gain", F.try_divide("tax", "extended_tax"))


def with_training(evaluations: DataFrame, training: DataFrame) -> DataFrame:
    """Evaluation rows with the training row of the same name; arms that were not trained have nulls there."""
    return evaluations.join(training, "name", "left")


def parallel_pairs(texts: DataFrame, source: str, target: str) -> DataFrame:
    """texts(lang, sent_id, text) -> (sent_id, source, target): the sentences that both languages have."""
    side = lambda lang, name: texts.where(F.col("lang") == lang).select("sent_id", F.col("text").alias(name))
    return side(source, "source").join(side(target, "target"), "sent_id")


def few_shot_prompts(examples: DataFrame, texts: DataFrame, source: str, target: str, names: dict[str, str], shots: int = 5) -> DataFrame:
    """examples and texts(lang, sent_id, text) -> (sent_id, prompt, reference): each text to translate behind the first example pairs.

    Both are paired by sentence; a sentence that one language lacks, or whose
    text is null in it, has no pair. The examples are the `shots`
    first ones by sent_id, fewer if there are no more; none give a prompt of the text alone.
    """
    spoken = lambda some: parallel_pairs(some.where("text is not null"), source, target)
    first = spoken(examples).orderBy("sent_id").limit(shots)
    given = F.array_sort(F.collect_list(F.struct("sent_id", F.col("source"), F.col("target"))))
    head = first.agg(F.transform(given, lambda s: F.struct(s["source"].alias("source"), s["target"].alias("target"))).alias("shots"))  # one row
    pairs = spoken(texts).crossJoin(head)
    return pairs.select("sent_id", T.shots_prompt(F.col("shots"), F.col("source"), names[source], names[target]).alias("prompt"), F.col("target").alias("reference"))


def agree(rows: DataFrame, value: str) -> DataFrame:
    """Whether all rows have one value."""
    return rows.agg((F.count_distinct(value) <= 1).alias("agree"))
