"""chrF++ against a slow reading of its formula, means of vectors against numpy, running sums with nulls."""

import random
import string

import numpy as np
import pytest

from tokenloom.operators import score, vocabulary
from tokenloom.operators.running import with_running_sum


def slow_chrf(pairs, beta=2.0):
    """Every n-gram of the reference is looked up, and crossed out, among those of the hypothesis."""

    def words(t):
        out = []
        for w in "".join(" " if c in " \t\n\r\f\v" else c for c in t).split(" "):
            if w and len(w) > 1 and w[-1] in string.punctuation:
                out += [w[:-1], w[-1]]
            elif w and len(w) > 1 and w[0] in string.punctuation:
                out += [w[0], w[1:]]
            elif w:
                out.append(w)
        return out

    precision, recall = [], []
    for kind, n in [("c", n) for n in range(1, 7)] + [("w", 1), ("w", 2)]:
        common = given = wanted = 0
        for h, r in pairs:
            units = [[c for c in t if c not in " \t\n\r\f\v"] if kind == "c" else words(t) for t in (h, r)]
            left, right = ([tuple(u[i : i + n]) for i in range(len(u) - n + 1)] for u in units)
            given, wanted = given + len(left), wanted + len(right)
            for g in right:
                if g in left:
                    left.remove(g)
                    common += 1
        if given and wanted:
            precision.append(common / given)
            recall.append(common / wanted)
    if not precision:
        return None
    p, r = sum(precision) / len(precision), sum(recall) / len(recall)
    return 100 * (1 + beta**2) * p * r / (beta**2 * p + r) if p + r else 0.0


def test_chrf(spark):
    rng = random.Random(4)
    odd = ["", " ", "a", "the cat.", "(the cat", "the  cat\n", "'", "..", "क्षत्रिय है।", "😀 ok!", " x y", "é" * 40]
    groups = {g: [(rng.choice(odd) + " ".join(rng.choices(["the", "cat", "sat,", "mat"], k=rng.randint(0, 5))), rng.choice(odd)) for _ in range(rng.randint(1, 6))] for g in range(25)}
    rows = [(g, *p) for g, pairs in groups.items() for p in pairs] + [(0, None, "x"), (99, None, None), (98, "", "")]
    found = {r["g"]: r["chrf"] for r in score.chrf(spark.createDataFrame(rows, "g int, hypothesis string, reference string"), ("g",)).collect()}
    want = {g: slow_chrf(pairs) for g, pairs in groups.items()}
    assert found == {g: pytest.approx(v) for g, v in want.items() if v is not None} and len(found) > 20


def test_rows_for_new_tokens(spark):
    merges = [("61", "62"), ("6162", "63")]
    vocab = spark.createDataFrame([("61", 0), ("62", 1), ("63", 2), ("64", 3), ("6162", 4), ("616263", 5)], "token string, id long")
    vectors = np.random.default_rng(1).normal(size=(6, 5)).round(3)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    fresh = spark.createDataFrame([("61626364", 6), ("6464", 7), ("6162626162", 8)], "token string, id long")
    pieces = {"61626364": [5, 3], "6464": [3, 3], "6162626162": [4, 1, 4]}
    found = {r["token"]: (r["id"], r["embedding"]) for r in vocabulary.extended_embeddings(table, vocab, merges, fresh).collect()}
    assert {t: i for t, (i, _) in found.items()} == {"61626364": 6, "6464": 7, "6162626162": 8}
    for token, ids in pieces.items():
        assert found[token][1] == pytest.approx(vectors[ids].mean(0).tolist(), abs=1e-6)
    assert vocabulary.extended_embeddings(table, vocab, merges, fresh.limit(0)).count() == 0


def test_running_sums_of_null_groups(spark):
    rows = [("x", 1, 5), (None, 2, 7), ("x", 3, 1), (None, 4, 2), ("y", 5, 9)]
    found = with_running_sum(spark.createDataFrame(rows, "g string, i int, n long"), ["g"], "i", __import__("pyspark.sql.functions", fromlist=["col"]).col("n"), "before")
    assert {(r["i"], r["before"]) for r in found.collect()} == {(1, 0), (2, 0), (3, 5), (4, 7), (5, 0)} and found.columns == ["g", "i", "n", "before"]


def test_prompts(spark):
    kind = "lang string, sent_id long, text string"
    dev = spark.createDataFrame([("en", 2, "b"), ("en", 1, "a"), ("en", 3, "c"), ("or", 1, "A"), ("or", 2, "B"), ("or", 4, "D"), ("en", 4, None), ("en", 9, "%s"), ("or", 9, "E")], kind)
    test = spark.createDataFrame([("en", 1, "x"), ("or", 1, "X"), ("en", 2, "only here")], kind)
    names = {"en": "English", "or": "Odia"}
    assert [tuple(r) for r in score.few_shot_prompts(dev, test, "en", "or", names, 2).collect()] == [(1, "English: a\nOdia: A\n\nEnglish: b\nOdia: B\n\nEnglish: x\nOdia:", "X")]
    assert score.few_shot_prompts(dev, test, "en", "or", names).first()["prompt"].count("%s") == 1
    assert score.few_shot_prompts(dev.limit(0), test, "or", "en", names).first()["prompt"] == "Odia: X\nEnglish:"
