import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tokenloom.llm import token_store as store
from tokenloom.llm.bpe import PairMerges, Recent, WordEncoder, encode_documents, piece_starts, plain_lower, plain_pieces
from tokenloom.llm.packing import optimal_boundaries, pack, token_lengths
from tokenloom.llm.token_store import EliasFano, Shard, library_ids, read_token_store, shard_bytes, token_store, write_token_store

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, start long"
ODD = ["", "don't", "É́x", "İstanbul", "ΑΣ", "１２", "é́", "日本語", "한국어", "a\x1fb", "a\x0bb", "x" * 3000, "ab" * 90 + "'s", "\U0001f600'll", "ﬁ", "a\x85b", " b", "<|endoftext|>", "<|EndOfText|>x<|startoftext|>", "It's  we'll\n\tgo ÜBER café’s 3.14"]


def texts(n=300):
    r = random.Random(1)
    pool = "abcdefghijklmnopqrstuvwxyzABCéüßÀ'#$%&|<>0123日́ Σσİı’ "
    return ODD + ["".join(r.choice(pool) for _ in range(r.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library(library):
    own, some = WordEncoder(PATH), texts()
    want = [library.encode(t, add_special_tokens=False).ids for t in some]
    assert own.plain and own.encode(some) == want
    assert [own.decoded(ids) for ids in want] == [library.decode(ids, skip_special_tokens=False) for ids in want]
    assert [x.tolist() for x in library_ids(PATH, some)] == want


def test_speculation_is_verified():
    with open(PATH) as file:
        pairs = PairMerges(json.load(file))
    r = random.Random(2)
    words = ["".join(r.choice("abcdeinorst") for _ in range(r.randint(1, 100))) for _ in range(400)]
    exact = [pairs.merged(w) for w in words]
    greedy = [pairs.longest_match(w) for w in words]
    assert pairs.encode(words) == exact and 0 < sum(a != b for a, b in zip(exact, greedy)) < len(words)


def test_recent_keeps_a_generation():
    cache = Recent(2)
    cache.update(a=1, b=2)
    assert cache.make_room(1) and cache.missing(["a", "c"]) == ["c"] and cache["a"] == 1


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "x", 7) for d, t in rows], SCHEMA)


def test_op9_rows(spark, library):
    rows = [*enumerate(texts(100)), (500, None), (500, None), (None, "x")]
    got = sorted(map(tuple, encode_documents(documents(spark, rows), PATH).collect()), key=str)
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert encode_documents(documents(spark, []), PATH).count() == 0


def test_elias_fano():
    r = np.random.default_rng(3)
    for n, most in ((1, 1), (1, 0), (5, 3), (300, 10), (1000, 10**9), (2000, 2**40)):
        values = np.sort(r.integers(0, most + 1, n))
        code, size = EliasFano.from_bytes(memoryview(EliasFano.of(values).to_bytes() + b"more"))
        assert size == len(EliasFano.of(values).to_bytes()) and code.values().tolist() == values.tolist()
        assert [code.select(i) for i in range(n)] == values.tolist()
        assert size < 25 + 5 + n * (2 + np.log2(max(2, (most + 1) / n)) + 1) / 8 + 4 * (n / 256 + 1)
    assert len(EliasFano.of(np.empty(0)).values()) == 0


def test_shard_selects_documents():
    ids = [np.array(x, np.uint16) for x in ([2], [5, 6, 2], [7, 2])]
    shard = Shard(shard_bytes([None, -4, 9], ids, 2))
    assert [shard.doc_id(i) for i in range(3)] == [None, -4, 9] and shard.span(1) == (1, 4)
    assert shard.ids(2).tolist() == [7, 2] and [(d, a, x.tolist()) for d, a, x in shard.rows()] == [(None, 0, [2]), (-4, 1, [5, 6, 2]), (9, 4, [7, 2])]


def test_op2_rows(spark, library, tmp_path):
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts(60))] + [(7_000, None), (7_000, "same id")]
    random.Random(1).shuffle(rows)
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_store(documents(spark, rows), PATH, 2).collect())) == sorted(want)
    write_token_store(documents(spark, rows), PATH, f"file://{tmp_path}/store", 2, shard_ids=50)
    assert len([*(tmp_path / "store/shards").glob("ids-*.bin")]) > 5 and not [*(tmp_path / "store/shards").glob(".*")]
    assert sorted(map(tuple, read_token_store(spark, f"file://{tmp_path}/store").collect())) == sorted(want)
    assert token_store(documents(spark, []), PATH, 2).count() == 0


def test_boundaries_are_optimal():
    from itertools import combinations

    r = np.random.default_rng(4)
    cost = lambda lengths, counts, ends: sum(c * next(e for e in ends if e >= x) for x, c in zip(lengths, counts))
    for _ in range(200):
        n, k = int(r.integers(1, 9)), int(r.integers(1, 5))
        lengths, counts = np.sort(r.choice(40, n, replace=False)), r.integers(1, 9, n)
        ends = optimal_boundaries(lengths, counts, k)
        best = min(cost(lengths, counts, [*s, lengths[-1]]) for m in range(k) for s in combinations(lengths[:-1].tolist(), m))
        assert len(ends) <= k and cost(lengths, counts, ends) == best


def test_packing_is_whole(spark, library):
    r = random.Random(5)
    rows = [(i, " ".join(["word"] * r.choice([0, 1, 3, 3, 3, 9, 40, 200]))) for i in range(500)] + [(1, None), (None, "x")]
    lengths = token_lengths(documents(spark, rows), PATH)
    got = pack(lengths, buckets=4, budget=100).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(d), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    batches = {}
    for r in got:
        assert r["n_tokens"] <= r["bucket_len"]
        batches.setdefault((r["bucket"], r["batch_id"]), []).append(r)
    for own in batches.values():
        assert sorted(r["slot"] for r in own) == [*range(len(own))] and (len(own) == 1 or len(own) * own[0]["bucket_len"] <= 100)
    for b in {b for b, _ in batches}:
        numbers = sorted(n for k, n in batches if k == b)
        room = max(1, 100 // max(1, batches[b, 0][0]["bucket_len"]))
        assert numbers == [*range(len(numbers))] and all(len(batches[b, n]) == room for n in numbers[:-1])
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_added_tokens_of_other_files(tmp_path):
    with open(PATH, encoding="utf-8") as file:
        config = json.load(file)
    flags = {k: False for k in ("single_word", "lstrip", "rstrip")}
    config["added_tokens"] += [{"id": 49408, "content": "[END]", "normalized": False, "special": True, **flags}, {"id": 49409, "content": "Ünit", "normalized": True, "special": False, **flags}]
    path = str(tmp_path / "more.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(config, file)
    library, own = Tokenizer.from_file(path), WordEncoder(path)
    some = ["a [END] b", "[end] a[END][END]", "x ÜNIT y ünit", "plain words", "", *texts(60)]
    want = [library.encode(t, add_special_tokens=False).ids for t in some]
    assert 49408 in want[0] and own.encode(some) == want
    assert [x.tolist() for x in library_ids(path, some)] == want == [x.tolist() for x in library_ids(path, some, whole=True)]


def test_pieces_over_bytes_against_the_pattern():
    rng = random.Random(5)
    texts = ["", "'", "''s 's's don't 'tis we're'd l'll'l 5's 'é", "x" * 9 + "12,.\t\n\r\"'ve"]
    for letters in ("'stmdrevl ", "'strevlmdaé1.\" \n\tÉB7-", "".join(map(chr, range(32, 127))) + "\t\n\rÀÖØöøÿß"):
        texts += ["".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in range(2000)]
    plain = [(t, low) for t in texts if (low := plain_lower(t)) is not None]
    raw = np.frombuffer(b"\n".join([*(low for _, low in plain), b"\n\n"]), np.uint8)
    start, inside = piece_starts(raw)
    offsets, kept = [*np.flatnonzero(start[inside]).tolist(), int(inside.sum())], raw[inside].tobytes()
    assert [kept[a:b].decode() for a, b in zip(offsets, offsets[1:])] == [p for t, _ in plain for p in plain_pieces(t)]
    own = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in library_ids(PATH, texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_text_slices(monkeypatch):
    monkeypatch.setattr(store, "TEXT_BYTES", 10)
    for texts in ([], [None], ["a" * 30], ["a" * 4] * 7 + [None, "é" * 20, "", "b"], [""] * 50):
        slices = [s.column("text").to_pylist() for s in store.text_slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]))]
        assert [t for s in slices for t in s] == texts and all(slices)
        assert all(sum(len((t or "").encode()) for t in s[1:]) < 10 for s in slices)
