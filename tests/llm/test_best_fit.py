"""Best-fit packing against a list of bins searched one by one, and against the library's ids."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tokenloom.llm.best_fit import OpenBins, best_fit, document_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")


def searched(lengths, capacity, limit):
    """The same rule over a plain list: the fullest bin that takes the item, the fullest closes."""
    bins, closed = [], []
    for length in lengths:
        fitting = [b for b in bins if capacity - sum(b) >= length]
        if fitting:
            best = max(fitting, key=sum)
            best.append(length)
        else:
            bins.append(best := [length])
        if sum(best) == capacity:
            bins = [b for b in bins if b is not best]
            closed.append(best)
        elif len(bins) > limit:
            fullest = max(bins, key=sum)
            bins = [b for b in bins if b is not fullest]
            closed.append(fullest)
    return sorted(sum(b) for b in closed), sorted(sum(b) for b in bins)


def test_bitset_against_a_list():
    rng = random.Random(1)
    for _ in range(300):
        capacity, limit = rng.randint(3, 70), rng.randint(1, 9)
        lengths = [rng.randint(1, rng.choice([capacity, max(1, capacity // 4)])) for _ in range(rng.randint(0, 80))]
        own, closed = OpenBins(capacity, limit), []
        for x in lengths:
            done = own.place(x, x)
            closed += [done] if done is not None else []
            assert own.n <= limit
        assert (sorted(map(sum, closed)), sorted(map(sum, own.rest()))) == searched(lengths, capacity, limit)


def test_pieces():
    ids = np.arange(10, dtype=np.uint32)
    assert document_pieces(7, ids, 4)[["piece", "start", "length"]].tolist() == [(0, 0, 4), (1, 4, 4), (2, 8, 2)]
    assert document_pieces(None, ids[:4], 4)["known"].tolist() == [0] and len(document_pieces(1, ids[:4], 4)) == 1


def checked(rows, found, capacity):
    """Every piece of every document is there, and each sequence is filled without gaps up to the capacity."""
    own = Tokenizer.from_file(PATH)
    want = []
    for doc, text in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), capacity):
            part = ids[i : i + capacity]
            want.append((doc, i // capacity, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in found), key=key) == sorted(want, key=key)
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r["length"] for r in found) // capacity)


def test_packing_of_odd_rows(spark):
    rng = random.Random(2)
    words = "the cat sat on a mat while eleven birds sang an étude".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 20, 90])))) for i in range(300)]
    rows += [(None, "no id"), (None, None), (5, None), (6, ""), (6, ""), (7, "same row"), (7, "same row"), (8, "long " * 30_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, piece int, part string").repartition(40)
    for capacity, open_bins in ((64, 4), (100, 64), (4096, 512)):
        n, bound = checked(rows, best_fit(docs, PATH, 1, capacity, open_bins).collect(), capacity)
        assert n <= bound * 1.04 + 1
    assert best_fit(docs.limit(0), PATH).count() == 0
    only = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r)[:4] for r in best_fit(only, PATH).collect()] == [(1, 0, 0, 1)]
