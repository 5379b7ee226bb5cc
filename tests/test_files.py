"""Lines numbered across splits, results of different columns, picks and order."""

import random

from pyspark.sql import functions as F

from tokenloom.operators import corpus, measure, score
from tokenloom.sources import files


def test_lines_of_files_in_many_splits(spark, tmp_path):
    rng = random.Random(1)
    texts = {lang: ["".join(rng.choices("ab é\r\t\u0085", k=rng.choice([0, 1, 40, 900]))) for _ in range(n)] for lang, n in (("en", 4000), ("or", 4000), ("fr", 1), ("xx", 0))}
    for lang, lines in texts.items():
        (tmp_path / f"{lang}.devtest").write_bytes("".join(f"{t}\n" for t in lines).encode())
    (tmp_path / "de.devtest").write_bytes(b"no end\nof line")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    found = files.parallel_texts(spark, str(tmp_path))
    assert files.numbered_lines(spark, f"{tmp_path}/*.devtest").rdd.getNumPartitions() > 4
    by_lang = {}
    for r in found.collect():
        by_lang.setdefault(r["lang"], []).append((r["sent_id"], r["text"]))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {lang: [*enumerate(t)] for lang, t in texts.items() if t} | {"de": [(0, "no end"), (1, "of line")]}
    assert {lang: sorted(rows) for lang, rows in by_lang.items()} == want


def test_results_with_other_columns(spark, tmp_path):
    one, two = spark.createDataFrame([("x", 1)], "lang string, tax int"), spark.createDataFrame([("y", 0.5)], "lang string, floor double")
    files.write_results(one, str(tmp_path / "r"), two)
    got = spark.read.csv(str(tmp_path / "r/csv"), header=True)
    assert got.columns == ["lang", "tax", "floor"] and {tuple(r) for r in got.collect()} == {("x", "1", None), ("y", None, "0.5")}
    assert spark.read.json(str(tmp_path / "r/json")).count() == 2


def test_questions(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"flores_passage": "p", "question": "q", "mc_answer1": "a", "mc_answer2": "b", "mc_answer3": "c", "mc_answer4": "d", "correct_answer_num": "3"}\n')
    row = files.questions(spark, str(tmp_path / "q.jsonl")).first()
    assert (row["passage"], row["answers"], row["answer"]) == ("p", ["a", "b", "c", "d"], 3)


def test_identical_languages_and_cross_table(spark):
    kind = "lang string, sent_id long, ids array<int>"
    base = spark.createDataFrame([("en", 0, [1]), ("en", 1, [2]), ("or", 0, [3]), ("hi", 0, [])], kind)
    other = spark.createDataFrame([("en", 0, [1]), ("en", 1, [2]), ("or", 0, [4]), ("hi", 0, [])], kind)
    assert tuple(measure.identical_summary(measure.identical_languages(base, other)).first()) == (["en", "hi"], 2, 3)
    assert tuple(measure.identical_summary(measure.identical_languages(base.limit(0), other.limit(0))).first()) == ([], 0, 0)
    taxes = spark.createDataFrame([("en", "a", 1.0), ("or", "a", 2.0), ("or", "b", 3.0)], "lang string, tokenizer string, tax double")
    assert {r["lang"]: (r["a"], r["b"]) for r in measure.crosstab(taxes).collect()} == {"en": (1.0, None), "or": (2.0, 3.0)}


def test_long_document(spark):
    docs = spark.createDataFrame([(3, "c" * 50), (1, "short"), (2, "é" * 40), (4, None)], "doc_id long, text string")
    assert tuple(corpus.long_document(docs, 30).first()) == (2, "é" * 30)
    assert corpus.long_document(docs, 60).count() == 0
