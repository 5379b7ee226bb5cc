import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tokenloom.llm import jaccard_join
from tokenloom.llm.common import WordHashes, shingles
from tokenloom.llm.components import connected_components
from tokenloom.llm.jaccard_join import Bands, JaccardJoin, one_of_each, signatures

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, fp string, n long"


def brute_force(rows, width, percent):
    """doc_id -> (set size, smallest linked doc_id) by comparing all pairs."""
    sets = {}
    for d, t in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    top = {d: d for d in sets}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    inverted = defaultdict(list)
    for d in sorted(sets):
        for s, n in Counter(e for x in sets[d] for e in inverted[x]).items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[s]) - n):
                a, b = sorted((find(d), find(s)))
                top[b] = a
        for x in sets[d]:
            inverted[x].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus(seed, n=120):
    """Texts with exact copies, near copies at many distances, short and empty ones."""
    r = random.Random(seed)
    rows, texts = [], []
    for d in range(n):
        kind = r.random()
        if texts and kind < 0.6:
            words = r.choice(texts).split()
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                if words:
                    words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
            if r.random() < 0.3:
                words = words[: max(1, len(words) - r.randrange(6))]
            text = " ".join(words)
        else:
            text = " ".join(f"w{r.randrange(400)}" for _ in range(r.choice([0, 1, 2, 3, 4, 5, 8, 20, 60, 150])))
        texts.append(text)
        rows.append((d, text))
    return rows


@pytest.mark.parametrize("seed,width,percent", [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_classes_match_brute_force(spark, seed, width, percent):
    rows = [*corpus(seed), (1000, None), (1001, " \n"), (1002, "A b C d E"), (1003, "a B c D e")]
    got = JaccardJoin(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA), width, percent).classes()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_force(rows, width, percent)


def test_linked_sets_always_share_a_signature():
    r = np.random.default_rng(5)
    for percent in (60, 80, 85, 95):
        bands = Bands(percent)
        for _ in range(300):
            n = int(r.integers(1, 400))
            a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
            k = (100 - percent) * 2 * len(a) // (100 + percent)
            drop = int(r.integers(0, k + 1))
            b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 2**64, int(r.integers(0, k + 1)), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= percent * (len(a) + len(b) - common) and not np.array_equal(a, b):
                assert len(np.intersect1d(signatures(a, bands), signatures(b, bands)))


@pytest.mark.parametrize("share,least", [(32, 256), (1, 2)])
def test_hot_group_of_near_copies(spark, monkeypatch, share, least):
    monkeypatch.setattr(jaccard_join, "HOT_SHARE", share)
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", least)
    base = [f"w{i}" for i in range(80)]
    rows = [(d, " ".join(base[:i] + [f"x{d}"] + base[i + 1 :])) for d, i in enumerate(random.Random(7).choices(range(80), k=400))]
    rows += [(1000 + d, " ".join(base)) for d in range(300)]
    got = JaccardJoin(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)).classes().collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_force(rows, 4, 85)


def test_copies_in_any_order_of_rows(spark):
    rows = sorted(corpus(11), reverse=True)
    got = JaccardJoin(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).coalesce(1)).classes().collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_force(rows, 4, 85)
    text, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(59)) + " z"
    rows = [(None, text, "x", 1), (9, text, "x", 1), (5, text, "x", 1), (7, near, "x", 1)]
    got = JaccardJoin(spark.createDataFrame(rows, SCHEMA).coalesce(1)).classes().collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(None, 5), (9, 5), (5, 5), (7, 5)}


def test_links_are_all_links_between_texts(spark):
    rows = corpus(9, 60)
    sets = {d: {*shingles(t, 4, WordHashes()).tolist()} for d, t in rows}
    reps = {}
    for d, t in rows:
        if sets[d]:
            reps.setdefault(frozenset(sets[d]), d)
    want = {(a, b) for a in reps.values() for b in reps.values() if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    got = JaccardJoin(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)).links()
    assert {(r["a"], r["b"]) for r in got.collect()} == want


def test_empty_table_repeated_rows_and_null_ids(spark):
    assert JaccardJoin(spark.createDataFrame([], SCHEMA)).classes().count() == 0
    text = "one two three four five six"
    rows = [(1, text, "x", 1), (1, text, "x", 1), (None, text, "x", 1), (None, "other words are here now", "x", 1)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in JaccardJoin(spark.createDataFrame(rows, SCHEMA)).classes().collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, None)], key=str)


def test_one_of_each_keeps_whole_rows(spark):
    text, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(59)) + " z"
    rows = [(5, text, "a", 1), (3, near, "b", 2), (7, "", "c", 3), (8, "", "c", 3), (9, "else", "d", 4), (9, "else", "d", 4), (None, "unnamed", "e", 5), (None, "unnamed", "e", 5), (None, text, "f", 6)]
    got = one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "fp", "n"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([rows[1], rows[2], rows[3], rows[4], rows[6]], key=str)


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    top = {}
    for a, b in links:
        top.setdefault(a, a), top.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(top[a], top[b])
            changed |= top[a] != m or top[b] != m
            top[a] = top[b] = m
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {k: v for k, v in top.items() if k in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
