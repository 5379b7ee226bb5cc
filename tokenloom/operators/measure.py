"""Token measures of a corpus: counts of each text, sums by tokenizer and language, ratios to a baseline language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions import graphemes
from tokenloom.functions import text as T
from tokenloom.functions.letters import letters
from tokenloom.sources.tokenizers import Tokenizer

COUNTS = ["tokens", "letters", "chars", "bytes", "words", "unk", "floor", "exact", "exact_tokens", "exact_letters", "fragments", "broken"]


def text_counts(texts: DataFrame, *tokenizers: Tokenizer) -> DataFrame:
    """texts with the counts of each text, a row for every tokenizer; what does not depend on one is counted once a text.

    Measures of bytes are null where the pieces do not spell the text. Of tokenizers that say where their tokens
    end, only that goes to Python, and one function measures them all; of others, the bytes of their pieces. If
    all cut by bytes or characters, only fragments and broken letters need Python, and nothing does if they are not asked for.
    """
    text, name = F.col("text"), "counts"
    while any(c.startswith(name) for c in texts.columns):
        name += "_"
    cuts = [t.cuts(text) for t in tokenizers]
    known = [c for c in cuts if c is not None]
    lengths = {f"{name}_l{i}": c[1] for i, c in enumerate(cuts) if c is not None and c[1] is not None}
    texts_, texts = texts, texts.withColumns(lengths) if lengths else texts
    shared = graphemes.measured_cuts([c for c, _ in known])(text, *map(F.col, lengths)) if known else F.lit(None)
    # what all tokenizers share is made in columns of its own, before the rows of each
    rows, places = texts.withColumns({f"{name}_m": shared, f"{name}_chars": T.chars(text), f"{name}_bytes": T.octets(text), f"{name}_words": T.words(text), f"{name}_letters": letters(text)}), iter(range(len(known)))
    measures = [graphemes.measured(text, t.pieces(text)) if c is None else F.get(f"{name}_m", F.lit(next(places))) for t, c in zip(tokenizers, cuts)]
    rows = rows.withColumn(f"{name}_all", F.array(*measures))
    # where the lengths of tokens are known, their number is too, and is not made again
    number = lambda i, t: t.tokens(text) if cuts[i] is None or cuts[i][1] is None else F.size(F.col(f"{name}_l{i}")).cast("long")
    own = [F.struct(F.lit(i).alias("i"), F.lit(t.key).alias("tokenizer"), number(i, t).alias("tokens"), t.unknown(text).alias("unk"), t.floor(text).alias("floor")) for i, t in enumerate(tokenizers)]
    each = rows.withColumn(name, F.explode(F.array(*own)))
    measured = {c: F.get(f"{name}_all", F.col(f"{name}.i"))[c] for c in graphemes.MEASURED.names} | {"letters": F.col(f"{name}_letters")}
    if all(c is not None and c[0].size is not None for c in cuts):
        there = lambda value: F.when(text.isNotNull(), value)
        measured |= {"exact": there(F.lit(1).cast("long")), "exact_tokens": there(F.col(f"{name}.tokens")), "exact_letters": F.col(f"{name}_letters")}
    plain = {c: F.col(f"{name}_{c}") for c in ("chars", "bytes", "words")}
    counted = {"tokenizer": F.col(f"{name}.tokenizer"), "tokens": F.col(f"{name}.tokens")} | plain | {c: F.col(f"{name}.{c}") for c in ("unk", "floor")} | measured
    return each.select(*texts_.columns, *(v.alias(c) for c, v in counted.items()))


def corpus_counts(counted: DataFrame, by: tuple[str, ...] = ("tokenizer", "lang")) -> DataFrame:
    """Sums of every count, and the number of texts; a sum over nulls only is null, `exact` then 0."""
    sums = [F.sum(c).alias(c) for c in COUNTS if c in counted.columns]
    out = counted.groupBy(*by).agg(F.count("*").alias("sentences"), *sums)
    return out.withColumn("exact", F.coalesce("exact", F.lit(0).cast("long"))) if "exact" in out.columns else out


def of_base(value: Column, base: str, by: str = "tokenizer") -> Column:
    """The baseline language's value, on each row of its tokenizer."""
    return F.max(F.when(F.col("lang") == base, value)).over(Window.partitionBy(by))


def tax(sums: DataFrame, base: str) -> DataFrame:
    """Ratios of corpus sums: tax, floor_tax (over the baseline's tokens), floor_ratio (over its floor) and shares.

    Ratios with an empty denominator, or of counts that a tokenizer lacks, are null.
    """
    tokens = of_base(F.col("tokens"), base)
    return sums.withColumns(
        {
            "tax": F.try_divide("tokens", tokens),
            "tokens_per_letter": F.try_divide("tokens", "letters"),
            "chars_per_token": F.try_divide("chars", "tokens"),
            "floor_tax": F.try_divide("floor", tokens),
            "floor_ratio": F.try_divide("floor", of_base(F.col("floor"), base)),
            "broken_letters": F.try_divide("broken", "exact_letters"),
            "byte_fragments": F.try_divide("fragments", "exact_tokens"),
        }
    )


def speaker_weighted(taxes: DataFrame, languages: DataFrame, by: tuple[str, ...] = ("tokenizer",)) -> DataFrame:
    """Mean tax weighted by speakers; languages without speakers drop out."""
    joined = taxes.join(languages.select(F.col("code").alias("lang"), "speakers"), "lang")
    return joined.groupBy(*by).agg(F.try_divide(F.sum(F.col("tax") * F.col("speakers")), F.sum("speakers")).alias("weighted_tax"))


def distinct_piece_counts(texts: DataFrame, by: tuple[str, ...] = ("lang",)) -> DataFrame:
    """(by, piece, n): pieces never share a token, so what is measured on distinct pieces adds up to the whole."""
    return texts.select(*by, F.explode(T.pieces(F.col("text"))).alias("piece")).groupBy(*by, "piece").agg(F.count("*").alias("n"))


def crosstab(taxes: DataFrame, value: str = "tax") -> DataFrame:
    """A row per language, a column per tokenizer."""
    return taxes.groupBy("lang").pivot("tokenizer").agg(F.first(value))


def identical_languages(base: DataFrame, other: DataFrame) -> DataFrame:
    """(lang, identical): whether all texts (lang, sent_id, ids) have the same ids in both."""
    joined = base.select("lang", "sent_id", "ids").join(other.select("lang", "sent_id", F.col("ids").alias("other_ids")), ["lang", "sent_id"], "full")
    return joined.groupBy("lang").agg(F.bool_and(F.col("ids").eqNullSafe(F.col("other_ids"))).alias("identical"))


def identical_summary(identical: DataFrame) -> DataFrame:
    """identical_languages() as one row: the languages whose texts all keep their ids, in order, their number, and that of all."""
    kept = F.col("identical")
    return identical.agg(F.array_sort(F.collect_list(F.when(kept, F.col("lang")))).alias("languages"), F.count_if(kept).alias("n"), F.count("*").alias("of"))
