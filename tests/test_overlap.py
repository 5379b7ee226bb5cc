"""Anchors and overlap against a search for every evaluation text in every document."""

import random

import numpy as np

from tokenloom.operators import corpus
from tokenloom.operators.overlap import smallest_places, window_hashes, window_sizes


def test_hashes_depend_on_their_characters_alone():
    text = "".join(random.Random(1).choices("abक😀é ", k=300))
    for k in (1, 2, 3, 7, 16, 21):
        h = window_hashes(text, k)
        assert len(h) == 301 - k
        alone = [int(window_hashes(text[i : i + k], k)[0]) for i in range(len(h))]
        assert h.tolist() == alone
        assert (len(set(alone)) == len({text[i : i + k] for i in range(len(h))}))
    assert len(window_hashes("ab", 3)) == 0


def test_smallest_of_some_neighbours():
    rng = np.random.default_rng(2)
    for n in (0, 3, 15, 40):
        for w in (1, 2, 5, 15):
            h = rng.integers(0, 9, n).astype(np.uint64)
            want = sorted({j for i in range(n - w + 1) for j in range(i, i + w) if h[j] == h[i : i + w].min()})
            assert smallest_places(h, w).tolist() == want
    assert window_sizes(30) == (16, 15) and sum(window_sizes(31)) == 32 and window_sizes(1) == (1, 1)


def test_overlap_at_any_place(spark):
    rng = random.Random(3)
    letters = "abcd éक😀"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 400))) for _ in range(150)] + [" " * 500, "a" * 300, "", "ab" * 400]
    banned = ["".join(rng.choices(letters, k=rng.choice([29, 30, 31, 60, 500]))) for _ in range(40)] + [" " * 30, "a" * 31, "ab" * 150, "short"]
    for i in range(0, 150, 2):
        b = rng.choice(banned)
        if rng.random() < 0.3:
            b = b[:-1] + "#"  # nearly
        at = rng.randint(0, len(texts[i]))
        texts[i] = texts[i][:at] + b + texts[i][at:]
    rows = [(i if i % 9 else None, t, rng.choice(["x", "y", None]), 1) for i, t in enumerate(texts)] + [(500, None, "x", 1), (None, None, None, 1)]
    docs = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, doc_id long, text string, lang string, key int")
    langs = [rng.choice(["x", "y", None]) for _ in banned]
    evaluation = spark.createDataFrame([*zip(banned, langs), (None, "x")], "text string, lang string")
    for least in (30, 8, 31):
        found = {r["n"]: r["overlap"] for r in corpus.contains_any(docs, evaluation, least).collect()}
        assert found == {n: any(len(b) >= least and b in (r[1] or "") for b in banned) for n, r in enumerate(rows)}
    found = {r["n"]: r["overlap"] for r in corpus.contains_any(docs, evaluation, by="lang").collect()}
    assert found == {n: any(len(b) >= 30 and b in (r[1] or "") and r[2] == lang and lang is not None for b, lang in zip(banned, langs)) for n, r in enumerate(rows)}
    assert corpus.contains_any(docs, evaluation).columns == [*docs.columns, "overlap"]
    assert corpus.decontaminate(docs, evaluation.limit(0)).count() == docs.count()
    assert corpus.decontaminate(docs.limit(0), evaluation).count() == 0
