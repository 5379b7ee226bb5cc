import math
import random

import pytest
from pyspark.sql import functions as F

from tokenloom.functions.rounding import rounded
from tokenloom.operators import corpus, score, vocabulary
from tokenloom.sources import files


@pytest.mark.parametrize("places", [1, 3, 4])
def test_rounding_as_python_does(spark, places):
    rng = random.Random(places)
    values = [2.675, 0.0005, 0.0015, 1.0005, 0.00005, 0.5, 2.5, 1e-12, 0.0, 1e15 + 0.5, 1234567.00035]
    values += [rng.uniform(0, 20) for _ in range(2000)] + [rng.randrange(1, 10**6) * 10**-places / 2 for _ in range(2000)] + [(2 * rng.randrange(10**5) + 1) / 2**rng.randrange(1, 20) for _ in range(2000)]
    values += [-v for v in values]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", rounded(F.col("x"), places).alias("y")).collect()
    assert [r["y"] for r in rows] == [v if abs(v) >= 2**39 else round(v, places) for v in values]


def test_rounding_leaves_what_has_no_places(spark):
    rows = spark.createDataFrame([(None,), (math.inf,), (math.nan,)], "x double").select(rounded(F.col("x"), 3).alias("y")).collect()
    assert rows[0]["y"] is None and rows[1]["y"] == math.inf and math.isnan(rows[2]["y"])
    with pytest.raises(ValueError):
        rounded(F.lit(1.0), 5)


def test_last_line_of_a_key_counts(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"name": "{"xyz"[i % 3]}", "v": {i}}}\n' for i in range(300)))
    (tmp_path / "b.jsonl").write_text('{"name": "y", "v": -1}\n')
    got = {r["name"]: r["v"] for r in files.results(spark, str(tmp_path), "name string, v long", ["name"]).collect()}
    assert got == {"x": 297, "y": -1, "z": 299}
    assert {r["v"] for r in files.results(spark, str(tmp_path), "name string, v long", ["name"], "v").collect()} == {297, 298, 299}


def test_latest_keeps_nulls_and_prefers_known_orders(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", None, "x"), ("b", None, None), ("c", 2, "p"), ("c", 3, None)], "k string, o int, v string")
    assert sorted(map(tuple, score.latest(rows, ["k"], F.col("o")).collect())) == [("a", 1, None), ("b", None, None), ("c", 3, None)]
    assert score.latest(rows.limit(0), ["k"], F.col("o")).count() == 0


def test_joins_of_results(spark):
    base = spark.createDataFrame([("or", 9.0), ("hi", 4.0), ("en", 0.0)], "lang string, tax double")
    more = spark.createDataFrame([("or", 1.5), ("en", 0.0)], "lang string, tax double")
    assert {tuple(r) for r in score.beside(base, more).collect()} == {("or", 9.0, 1.5, 6.0), ("en", 0.0, 0.0, None)}
    trained = score.with_training(spark.createDataFrame([("base",), ("A",)], "name string"), spark.createDataFrame([("A", 10)], "name string, steps int"))
    assert {tuple(r) for r in trained.collect()} == {("base", None), ("A", 10)}
    texts = spark.createDataFrame([("en", 0, "one"), ("or", 0, "ek"), ("en", 1, "two")], "lang string, sent_id long, text string")
    assert [tuple(r) for r in score.parallel_pairs(texts, "en", "or").collect()] == [(0, "one", "ek")]
    mixed = spark.createDataFrame([("en", 5), (None, 1), ("en", 2)], "lang string, at int")
    assert score.ordinary(mixed, "lang").count() == 2
    assert {tuple(r) for r in score.ordered_distinct(mixed, "lang", "at").collect()} == {("en", 2), (None, 1)}


def test_overlap_within_a_language(spark):
    held = "a sentence of the evaluation, long enough"
    docs = spark.createDataFrame([(0, "en", f"see: {held}."), (1, "fr", held), (2, None, held), (3, "en", None)], "doc_id long, lang string, text string")
    banned = spark.createDataFrame([("en", held), ("de", held), (None, held)], "lang string, text string")
    assert {r["doc_id"] for r in corpus.decontaminate(docs, banned, by="lang").collect()} == {1, 2, 3}
    assert {r["doc_id"] for r in corpus.decontaminate(docs, banned).collect()} == {3}


def test_learning_more_than_is_kept(spark):
    texts = spark.createDataFrame([("été étés " * 30 + "the then " * 50,)], "text string")
    vocab = spark.createDataFrame([(f"{b:02X}",) for b in range(256)], "token string")
    words = vocabulary.word_counts(texts)
    marker = lambda t: t.rlike("^(?:..)*?[89A-F]")
    some = vocabulary.learn_confined(words, 2, vocab, marker, margin=5).orderBy("rank").collect()
    every = vocabulary.confine(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(vocabulary.learn(words, 10))], "rank int, left string, right string"), vocab, marker).orderBy("rank").collect()
    assert some == every[:2] and len(some) == 2
