"""Letters by the native grammar against the regex library."""

import random

import regex
from pyspark.sql import functions as F

from tokenloom.functions.letters import letter_lengths, letters
from tokenloom.operators import measure
from tokenloom.sources.tokenizers import Characters, FixedCut

KINDS = ["a", " ", "é", "\r", "\n", "\r\n", "\t", "क", "्", "ष", "ि", "ा", "ক", "্", "ਕ", "੍", "క", "్", "ସ", "ତ", "ର", "ୀ", "\u0300", "\u200d", "\u200c", "👨", "👩", "❤", "\ufe0f", "🏽", "🇫", "🇷", "각", "가", "ᄀ", "ᅡ", "ᆨ", "\u0600", "\u0d4e", "\u00ad", "中", "😀", "©", "\u0e33", "ไ"]


def texts():
    rng = random.Random(11)
    some = ["".join(rng.choices(rng.choice([KINDS, KINDS[:8], KINDS[7:22], KINDS[22:33], KINDS[32:40]]), k=rng.randint(0, 12))) for _ in range(6000)]
    return [*some, "", "plain text", "naïve café\n" * 50, "क्षत्रिय " * 4000, "é" * 100_000, None]


def test_letters_and_their_lengths(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    found = spark.createDataFrame(rows, "i int, text string").select("i", letters(F.col("text")).alias("n"), letter_lengths(F.col("text")).alias("lengths")).collect()
    for r in found:
        text = rows[r["i"]][1]
        want = None if text is None else [len(m.encode()) for m in regex.findall(r"\X", text)]
        assert r["lengths"] == want, ascii(text)[:200]
        assert r["n"] == (None if want is None else len(want)), ascii(text)[:200]


def test_counts_without_python(spark):
    docs = spark.createDataFrame([("क्षa\r\n", "hi"), (None, "hi"), ("", "en")], "text string, lang string")
    counted = measure.text_counts(docs, FixedCut(3), Characters())
    sums = measure.corpus_counts(counted).select("tokenizer", "lang", "tokens", "letters", "exact", "exact_tokens", "exact_letters")
    assert {tuple(r) for r in sums.collect()} == {("bytes3", "hi", 4, 3, 1, 4, 3), ("chars", "hi", 6, 3, 1, 6, 3), ("bytes3", "en", 0, 0, 1, 0, 0), ("chars", "en", 0, 0, 1, 0, 0)}
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "measured_cuts" not in plan and "EvalPython" not in plan and "apply(" not in plan
