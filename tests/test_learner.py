"""Learning in rounds against counting again after every merge."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tokenloom.operators import vocabulary
from tokenloom.operators.learner import Segments, segments


def joined(symbols, a, b):
    out, i = [], 0
    while i < len(symbols):
        pair = symbols[i : i + 2] == [a, b]
        out.append(a + b if pair else symbols[i])
        i += 2 if pair else 1
    return out


def one_at_a_time(counts, n, least=2, state=None):
    """Merges by counting all pairs again; only words that changed are counted anew, to be done with thousands."""
    state = state or {w: [w[i : i + 2] for i in range(0, len(w), 2)] for w in counts}
    pairs, holders = Counter(), {}
    for w, s in state.items():
        for p in zip(s, s[1:]):
            pairs[p] += counts[w]
            holders.setdefault(p, set()).add(w)
    out = []
    while len(out) < n and pairs:
        (a, b), best = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        if best < least:
            break
        out.append((a, b))
        for w in holders.pop((a, b)):
            for p in zip(state[w], state[w][1:]):
                pairs[p] -= counts[w]
            state[w] = joined(state[w], a, b)
            for p in zip(state[w], state[w][1:]):
                pairs[p] += counts[w]
                holders.setdefault(p, set()).add(w)
        pairs = +pairs
    return out


def test_a_round_decides_nothing_too_early():
    """For any bound, a round's merges are those of counting again, also where two ways make one symbol."""
    for seed in range(400):
        r = random.Random(seed)
        letters = ["61", "62", "63", "64", "65"][: r.randint(2, 5)]
        counts = {"".join(r.choices(letters, k=r.randint(1, 12))): r.randint(1, 9) for _ in range(r.randint(1, 25))}
        want, made, known = one_at_a_time(dict(counts), 60), [], set()
        state = {w: [w[i : i + 2] for i in range(0, len(w), 2)] for w in counts}
        while len(made) < 60:
            pairs = Counter()
            for w, s in state.items():
                for p in zip(s, s[1:]):
                    pairs[p] += counts[w]
            often = sorted(n for n in pairs.values() if n >= 2)
            if not often:
                break
            bound, parts = r.choice(often), Counter()
            for w, s in state.items():
                begin = 0
                for i in range(1, len(s) + 1):
                    if i == len(s) or pairs[s[i - 1], s[i]] < bound:
                        parts[tuple(s[begin:i])] += counts[w] if i - begin > 1 else 0
                        begin = i
            step = Segments((list(p), n) for p, n in parts.items() if n).merges(bound, 60 - len(made), {*known})
            assert step
            made += step
            known |= {a + b for a, b in step}
            for a, b in step:
                state = {w: joined(s, a, b) for w, s in state.items()}
        assert made == want, seed


def test_segments(spark):
    words = spark.createDataFrame([("<61><62><63><64>", 2), ("<62><63>", 3), ("<64>", 9), ("", 1), (None, 1)], "marked string, n long")
    assert {tuple(r) for r in segments(words, [("61", "62"), ("62", "63")]).collect()} == {("61><62><63", 2), ("62><63", 3)}
    assert segments(words, []).count() == 0


def test_rounds_of_any_size(spark):
    r = random.Random(9)
    counts = {"".join(r.choices(["61", "62", "63", "64", "65", "66"], [9, 7, 5, 3, 2, 1], k=r.randint(1, 14))): r.randint(1, 90) for _ in range(80)}
    words = spark.createDataFrame([*counts.items()], "word string, n long").cache()
    want = one_at_a_time(dict(counts), 90)
    assert vocabulary.learn(words, 90) == want and len(want) == 90
    assert vocabulary.learn(words, 25, most_pairs=3, most_segments=4) == want[:25]  # rounds of one or few merges
    assert vocabulary.learn(words, 90, most_pairs=40, most_segments=60) == want
    assert want[:30] + vocabulary.learn(words, 40, want[:30]) == want[:70]
    assert vocabulary.learn(words.limit(0), 5) == []


def test_two_thousand_merges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = vocabulary.word_counts(docs.select("text")).cache()
    counts = {row["word"]: row["n"] for row in words.collect()}
    want = one_at_a_time(counts, 2000)
    assert vocabulary.learn(words, 2000, most_segments=3000) == want and len(want) > 1000
    # the words spelled with these merges are the words
    spelled = words.select("word", F.array_join(vocabulary.symbols(vocabulary.merged(vocabulary.bytes_as_symbols(F.col("word")), want)), "").alias("again"))
    assert spelled.where("word <> again").count() == 0
