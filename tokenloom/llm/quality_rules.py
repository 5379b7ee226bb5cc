"""Quality rules whose thresholds follow from quantile sketches of each language and source.

Every document gets counts of its words, symbols, repeated lines and repeated word windows. Documents that
fail the base rules go. Of the others, five integer features are put into mergeable sketches: a histogram
whose buckets keep the leading bits of a value (relative error under 1/64), so merging is adding counts, in
any order and with the same result. Equal texts of a group are put in once, so that a group of copies does
not narrow its source's spread, and features that are mostly 0 are sketched where they are not.

Sketches are merged along a hierarchy by weight, whatever a group's size: that of a language has PRIOR
documents of the overall sketch added, that of a (language, source) PRIOR documents of its language's. All
weights are integers, so the quantiles are exact. A document is kept if each feature lies within SPREADS
interquartile ranges of its group's quartiles, or is not among the outer tenth of its group. No threshold is
a constant.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import BROADCAST_ROWS, byte_words, stage, texts

#: Interquartile ranges beyond the quartiles that are still accepted.
SPREADS = 4
#: Documents of the sketch above that are added to a group's own, as if the group had so many of them.
PRIOR = 10
#: Feature: its value as SQL over the counts, the documents whose values are sketched, whether low values fail too.
FEATURES = {
    "symbols": ("10000 * n_symbols div greatest(n_words, 1)", "true", False),
    "dup_lines": ("10000 * n_dup_lines div greatest(n_lines, 1)", "n_dup_lines > 0", False),
    "repeats": ("10000 * n_repeat_words div greatest(n_words, 1)", "n_repeat_words > 0", False),
    "word_length": ("1000 * word_chars div greatest(n_words, 1)", "true", True),
    "upper": ("10000 * n_upper div greatest(word_chars, 1)", "true", False),
}
#: Quantile of the sketches: its share as a fraction.
QUANTILES = {"q10": (1, 10), "q25": (1, 4), "q75": (3, 4), "q90": (9, 10)}
_SALTS = 32
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper"]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    own: dict[bytes, int] = {}
    w = np.fromiter((own.setdefault(x, len(own)) for x in words), np.int64, n)
    if len(own) < 1 << 21:
        tri = (w[:-2] << 42) | (w[1:-1] << 21) | w[2:]
        _, inverse, count = np.unique(tri, return_inverse=True, return_counts=True)
    else:
        _, inverse, count = np.unique(np.stack([w[:-2], w[1:-1], w[2:]], 1), axis=0, return_inverse=True, return_counts=True)
    twice = (count > 1)[inverse.reshape(-1)]
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of _COUNTS; all 0 for a null or empty text."""
    if not text:
        return (0,) * len(_COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    without = lambda some: len(raw) - len(raw.translate(None, some))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\v\f")]
    words = byte_words(text)
    return (len(words), len(text) - without(b" \t\n\r\v\f"), without(b"#*$%&|<>"), len(lines), len(lines) - len(set(lines)), repeated_words(words), without(bytes(range(65, 91))))


def _count(batches):
    kept = ["doc_id", "lang", "source", "h"]
    for batch in batches:
        rows = np.array([counts_of(t) for t in texts(batch.column("text"))], np.int64).reshape(-1, len(_COUNTS))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(rows[:, i]) for i in range(len(_COUNTS))], names=[*kept, *_COUNTS])


def text_counts(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text, lang, source) with h, a hash of its text, its counts and base_failed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
    rows = rows.withColumn("h", F.xxhash64("text"))
    counted = rows.mapInArrow(_count, "doc_id long, lang string, source string, h long, " + ", ".join(f"{c} long" for c in _COUNTS))
    return counted.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, feature, low, n): how many different texts of the group have the feature in the bucket from low."""
    rows = counted.where("not base_failed").select("lang", "source", "h", *_COUNTS).distinct()
    made = ", ".join(f"if({domain}, struct('{k}' as feature, {sql} as v), null)" for k, (sql, domain, _) in FEATURES.items())
    values = rows.select("lang", "source", F.explode(F.expr(f"filter(array({made}), x -> x is not null)")).alias("x")).select("lang", "source", "x.feature", "x.v")
    low = F.expr("shiftleft(shiftright(v, greatest(length(bin(v)) - 7, 0)), greatest(length(bin(v)) - 7, 0))")
    return values.groupBy("lang", "source", "feature", low.alias("low")).agg(F.count("*").alias("n"))


def _added(*parts: DataFrame) -> DataFrame:
    """Weighted sketches added up: columns of the first part, of which all but w are keys."""
    keys = [c for c in parts[0].columns if c != "w"]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy(*keys).agg(F.sum("w").cast("decimal(38,0)").alias("w"))


def _quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Per group and feature the buckets that hold the quantiles: their low ends below the middle, their high ends above."""
    w = Window.partitionBy(*by, "feature")
    ranked = sketch.select(*by, "feature", "low", F.sum("w").over(w.orderBy("low").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("w").over(w).alias("total"))
    high = F.expr("low + shiftleft(1L, greatest(length(bin(low)) - 7, 0)) - 1")
    return ranked.groupBy(*by, "feature").agg(*(F.min(F.when(F.expr(f"{d} * upto >= {m} * total"), F.col("low") if 2 * m < d else high)).alias(q) for q, (m, d) in QUANTILES.items()))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, <feature>_lo, <feature>_hi) for every group that has a sketch; null where no document has the feature.

    sketch is small: a feature has some 3,600 buckets at most. The overall one, of at most 18,000 rows, is broadcast.
    """
    many = lambda c: F.col(c).cast("decimal(38,0)")
    times = lambda a, b: (a * b).cast("decimal(38,0)")
    prior = F.lit(PRIOR).cast("decimal(38,0)")
    overall = sketch.groupBy("feature", "low").agg(F.sum("n").alias("n"))
    size = overall.groupBy("feature").agg(F.sum("n").alias("size"))
    of_lang = sketch.groupBy("lang", "feature", "low").agg(F.sum("n").alias("n")).join(F.broadcast(size), "feature").select("lang", "feature", "low", times(many("n"), many("size")).alias("w"))
    langs = sketch.select("lang").distinct().select("lang", F.explode(F.array(*map(F.lit, FEATURES))).alias("feature"))
    above = langs.join(F.broadcast(overall), "feature").select("lang", "feature", "low", times(prior, many("n")).alias("w"))
    by_lang = stage(_added(of_lang, above), "language-sketches")
    total = by_lang.groupBy("lang", "feature").agg(F.sum("w").cast("decimal(38,0)").alias("total"))
    own = sketch.join(total, ["lang", "feature"]).select("lang", "source", "feature", "low", times(many("n"), F.col("total")).alias("w"))
    above = sketch.select("lang", "source").distinct().join(by_lang, "lang").select("lang", "source", "feature", "low", times(prior, F.col("w")).alias("w"))
    found = _quantiles(_added(own, above), ["lang", "source"])
    far = f"{SPREADS} * (q75 - q25)"
    bounds = found.select("lang", "source", "feature", F.expr(f"least(q25 - {far}, q10)").alias("lo"), F.expr(f"greatest(q75 + {far}, q90)").alias("hi"))
    return bounds.groupBy("lang", "source").agg(*(F.max(F.when(F.col("feature") == k, F.col(end))).alias(f"{k}_{end}") for k in FEATURES for end in ("lo", "hi")))


def apply_rules(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, source) -> doc_id, the counts, base_failed and kept, one row per row.

    Null or empty texts have no words and fail the base rules; a null language or source counts as an empty
    one; repeated rows are judged each for itself and sketched once; other columns of docs are
    ignored, whatever their names. An empty table gives an empty table.
    """
    counted = stage(text_counts(docs), "counts")
    bounds = stage(thresholds(stage(sketches(counted), "sketches")), "thresholds")
    inside = F.lit(True)
    for name, (sql, _, both) in FEATURES.items():
        inside &= F.coalesce(F.expr(f"{sql} <= {name}_hi"), F.lit(True))
        if both:
            inside &= F.coalesce(F.expr(f"{sql} >= {name}_lo"), F.lit(True))
    if bounds.count() <= BROADCAST_ROWS:
        judged = counted.join(F.broadcast(bounds), ["lang", "source"], "left")
    else:
        salted = bounds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        judged = counted.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int")).join(salted, ["lang", "source", "salt"], "left")
    kept = F.when(F.col("base_failed"), False).otherwise(inside)
    return judged.select("doc_id", *_COUNTS, "base_failed", kept.alias("kept"))


_VALUE_SQL = {k: sql.replace(" div ", " // ") for k, (sql, _, _) in FEATURES.items()}
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
three AS (SELECT doc_id, i, a, lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM word),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM three WHERE c IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM tri WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT doc_id, lang, source, t, CAST(len(w) AS BIGINT) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
u AS (SELECT DISTINCT lang, source, t, {', '.join(_COUNTS)} FROM s WHERE NOT base_failed),
f AS ({' UNION ALL '.join(f"SELECT lang, source, '{k}' AS k, {v} AS v FROM u WHERE {FEATURES[k][1]}" for k, v in _VALUE_SQL.items())}),
b AS (SELECT lang, source, k, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS low, CAST(count(*) AS HUGEINT) AS n FROM f GROUP BY ALL),
b0 AS (SELECT k, low, sum(n) AS n FROM b GROUP BY ALL), size AS (SELECT k, sum(n) AS size FROM b0 GROUP BY k),
b1 AS (SELECT lang, k, low, sum(w) AS w FROM (
    SELECT lang, k, low, n * size AS w FROM b JOIN size USING (k) UNION ALL SELECT lang, k, low, {PRIOR}::HUGEINT * n FROM (SELECT DISTINCT lang FROM b), b0) GROUP BY ALL),
b2 AS (SELECT lang, source, k, low, sum(w) AS w FROM (
    SELECT lang, source, k, low, n * total AS w FROM b JOIN (SELECT lang, k, sum(w) AS total FROM b1 GROUP BY ALL) USING (lang, k)
    UNION ALL SELECT lang, source, k, low, {PRIOR}::HUGEINT * w FROM (SELECT DISTINCT lang, source FROM b) JOIN b1 USING (lang)) GROUP BY ALL),
{''.join(f'''
r{i} AS (SELECT {by} k, low, low + (1::BIGINT << greatest(length(bin(low)) - 7, 0)) - 1 AS high, sum(w) OVER (PARTITION BY {by} k ORDER BY low) AS upto, sum(w) OVER (PARTITION BY {by} k) AS total FROM b{i}),
q{i} AS (SELECT {by} k, {', '.join(f"min({'low' if 2 * m < d else 'high'}) FILTER (WHERE {d} * upto >= {m} * total) AS {q}" for q, (m, d) in QUANTILES.items())} FROM r{i} GROUP BY ALL),''' for i, by in ((2, "lang, source,"),))}
h AS (SELECT lang, source, k, least(q25 - far, q10) AS lo, greatest(q75 + far, q90) AS hi
  FROM (SELECT *, {SPREADS} * (q75 - q25) AS far FROM q2)),
bounds AS (SELECT lang, source, {', '.join(f"max(CASE WHEN k = '{k}' THEN {e} END) AS {k}_{e}" for k in FEATURES for e in ('lo', 'hi'))} FROM h GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE {' AND '.join(f"coalesce({_VALUE_SQL[k]} <= {k}_hi, true)" + (f" AND coalesce({_VALUE_SQL[k]} >= {k}_lo, true)" if both else '') for k, (_, _, both) in FEATURES.items())} END AS kept
FROM s LEFT JOIN bounds USING (lang, source)
"""
