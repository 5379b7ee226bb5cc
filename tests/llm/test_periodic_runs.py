"""Periodic runs against trying every period at every place."""

import hashlib
import random
import zlib

import numpy as np

from tokenloom.llm.periodic_runs import find_runs, run_digests, with_runs


def every_run(w):
    """Maximal stretches whose words p apart are equal, for all p; the smallest p of a stretch is its period."""
    out, n = {}, len(w)
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                out.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((a, length, p) for (a, length), p in out.items())


def looped(rng, n, letters, loops):
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(loops):
        if n > 8:
            p, a = rng.randint(1, n // 4), rng.randrange(n - 4)
            for i in range(a, a + rng.randint(0, n - a)):
                w[i] = w[a + (i - a) % p]
    return w


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        w = looped(rng, rng.randint(0, 120), rng.choice([1, 2, 3, 5]), rng.randint(0, 3))
        assert find_runs(np.array(w, np.int32)) == every_run(w)


def test_runs_of_long_texts():
    rng = random.Random(2)
    for n in (4096, 4097, 6000):  # both ways of probing
        w = looped(rng, n, 40, 4)
        assert find_runs(np.array(w, np.int32)) == every_run(w)
    assert find_runs(np.zeros(150_000, np.int32)) == [(0, 150_000, 1)]
    assert find_runs(np.arange(120_000) // 12)[:2] == [(0, 12, 1), (12, 12, 1)]
    assert find_runs(np.arange(200_000) % 7) == [(0, 200_000, 7)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = every_run(words)
    gone = {i for a, length, p in runs for i in range(a + p, a + length)}
    top = min(((-length, a, p) for a, length, p in runs), default=None)
    sha = lambda s: hashlib.sha256(s).hexdigest()
    longest = (top[1], -top[0], top[2], -top[0] * 1000 // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *longest, sha("".join(f"{a},{length},{p}\n" for a, length, p in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_with_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{x}" for x in looped(rng, rng.randint(0, 90), 9, 2))) for i in range(120)]
    rows += [(None, "a a a a a a a"), (7, None), (8, ""), (9, " \t\r\n"), (None, None), (3, "x y x y x y x y x y x y"), (3, "x y x y x y x y x y x y")]
    rows += [(200 + i, "na " * 60_000) for i in range(2)] + [(300, "क्ष b " * 9)]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, found string, words int")
    found = run_digests(docs).drop("n_words").collect()
    small = [r for r in rows if r[0] is None or r[0] not in (200, 201)]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r) for r in found if r["doc_id"] not in (200, 201)), key=key) == sorted((expected(*r) for r in small), key=key)
    # a loop of equal words stays a run of period 1, whatever the loop is
    assert {(r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) for r in found if r["doc_id"] in (200, 201)} == {(1, 0, 60_000, 1, 60_000_000)}
    assert run_digests(docs.limit(0)).count() == 0


def test_spans_and_texts(spark):
    row = with_runs(spark.createDataFrame([("a b c x y x y x y x y d",)], "t string"), __import__("pyspark.sql.functions", fromlist=["col"]).col("t")).first()
    assert [tuple(r) for r in row["found"]["runs"]] == [(3, 8, 2)] and row["found"]["collapsed"] == "a b c x y d" and row["found"]["n_words"] == 12
