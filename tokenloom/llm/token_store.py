"""Token ids as binary shards with Elias-Fano document boundaries.

A shard file holds, little-endian: a header, the Elias-Fano code of the documents' end offsets, that of
their doc_ids (less the first), and the concatenated ids in 2 bytes each (4 if the vocabulary needs it).
An Elias-Fano code keeps the low bits of each value packed, the high bits in unary in a bit vector, and the
place of every 256th one bit, so select() finds a value from a sample and a short scan; offsets are relative
to the shard, so no table of 64-bit offsets exists. Shards are in ascending doc_id order; a manifest has one
row for each and the number of ids before it.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tokenloom.llm.bpe import Recent, has_plain_pieces, piece_starts, plain_lower
from tokenloom.llm.common import CACHE_WORDS, READERS, filesystem, new_folder, stage

_MAGIC = b"IDSHARD1"
#: Ids after which a task begins another shard.
SHARD_IDS = 8_000_000
_SAMPLE = 256
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of integers from 0 in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        low_bits = max(0, int(int(v[-1]) // n).bit_length() - 1) if n else 0
        bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        place = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(place[-1]) + 1 if n else 0, np.uint8)
        high[place] = 1
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little"), np.packbits(high, bitorder="little"), place[::_SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value."""
        place = int(self.samples[i // _SAMPLE])
        left, byte = i % _SAMPLE, place >> 3
        word = int(self.high[byte]) >> (place & 7) << (place & 7)
        while left >= (ones := int(_ONES[word])):
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = (byte << 3) + (word & -word).bit_length() - 1
        low = 0
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            low |= (int(self.low[at >> 3]) >> (at & 7) & 1) << b
        return (place - i) << self.low_bits | low

    def select_range(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1, found from the samples around them; nothing before or after them is decoded."""
        j = min(j, self.n)
        if i >= j:
            return np.empty(0, np.int64)
        a, b = i // _SAMPLE, -(-j // _SAMPLE)
        first, last = int(self.samples[a]), int(self.samples[b]) if b < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[first >> 3 : (last + 7) >> 3], bitorder="little")
        bits[: first & 7] = 0
        place = np.flatnonzero(bits)[i - a * _SAMPLE : j - a * _SAMPLE] + (first >> 3 << 3)
        out = (place - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            start = i * self.low_bits
            low = np.unpackbits(self.low[start >> 3 : (j * self.low_bits + 7) >> 3], bitorder="little")[start & 7 :][: (j - i) * self.low_bits]
            out |= (low.reshape(j - i, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out.astype(np.int64)

    def values(self) -> np.ndarray:
        """All values, decoded at once."""
        return self.select_range(0, self.n)

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview) -> tuple[EliasFano, int]:
        """The code at the start of raw, and its length."""
        n, low_bits, a, b = struct.unpack_from("<QBQQ", raw)
        at = struct.calcsize("<QBQQ")
        samples = -(-n // _SAMPLE)
        return cls(n, low_bits, np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a), np.frombuffer(raw, "<u4", samples, at + a + b)), at + a + b + 4 * samples


def shard_bytes(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """A shard of documents in ascending doc_id order, null ones first."""
    nulls = sum(d is None for d in doc_ids)
    first = doc_ids[nulls] if nulls < len(doc_ids) else 0
    ends = EliasFano.of(np.cumsum([len(x) for x in ids]))
    keys = EliasFano.of(np.array([d - first for d in doc_ids[nulls:]], np.uint64))
    head = struct.pack("<8sBQqQ", _MAGIC, width, nulls, first, sum(map(len, ids)))
    return head + ends.to_bytes() + keys.to_bytes() + b"".join(x.astype(f"<u{width}").tobytes() for x in ids)


class Shard:
    """A shard read back: number of documents, doc_id(i), span(i) and ids(i)."""

    def __init__(self, raw: bytes):
        magic, width, self.nulls, self.first, self.n_ids = struct.unpack_from("<8sBQqQ", raw)
        if magic != _MAGIC:
            raise ValueError("not a shard of token ids")
        view, at = memoryview(raw), struct.calcsize("<8sBQqQ")
        self.ends, size = EliasFano.from_bytes(view[at:])
        self.keys, more = EliasFano.from_bytes(view[at + size :])
        self.flat = np.frombuffer(raw, f"<u{width}", self.n_ids, at + size + more)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.first + self.keys.select(i - self.nulls)

    def span(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.span(i)
        return self.flat[a:b]

    def rows(self):
        """(doc_id, start, ids) of every document, in order; ends and keys are selected a few samples' stretch at a time."""
        start, step = 0, 16 * _SAMPLE
        for i in range(0, self.ends.n, step):
            ends = self.ends.select_range(i, i + step).tolist()
            known = (self.keys.select_range(max(0, i - self.nulls), max(0, i + len(ends) - self.nulls)) + self.first).tolist()
            for d, end in zip([None] * (len(ends) - len(known)) + known, ends):
                yield d, start, self.flat[start:end]
                start = end


class _Library:
    """A tokenizer of the library; for vocabularies with word ends, a cache of pieces and the ids that end one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.own, self.cache = Tokenizer.from_file(path), None
        suffix = config["model"].get("end_of_word_suffix")
        if suffix and has_plain_pieces(config):
            self.cache, vocab = Recent(CACHE_WORDS), config["model"]["vocab"]
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces as words of one text; each ends with one id that ends a word."""
        ids = np.array(self.own.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        raw, ends, start = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), 0
        if len(ends) != len(pieces):
            raise ValueError("the tokenizer cuts its own pieces")
        for piece, end in zip(pieces, ends):
            self.cache[piece] = raw[start:end]
            start = end

    def plain_ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of plain_lower() texts: those of each different piece, laid out where it stands."""
        raw = np.frombuffer(b"\n".join([*texts, b"\n\n"]), np.uint8)
        start, inside = piece_starts(raw)
        offsets = np.append(np.flatnonzero(start[inside]), np.count_nonzero(inside))
        pieces = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(raw[inside])).dictionary_encode()
        keys = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = self.cache.missing(keys)
        if self.cache.make_room(len(new)):
            new = self.cache.missing(keys)
        for at in range(0, len(new), 4096):
            self.learn(new[at : at + 4096])
        own = [*map(self.cache.__getitem__, keys)]
        n, at = np.fromiter(map(len, own), np.int64, len(own)) // 4, pieces.indices.to_numpy()
        length, first = n[at], (np.cumsum(n) - n)[at]
        before = np.concatenate([[0], np.cumsum(length)])
        ids = np.frombuffer(b"".join(own), np.uint32)[np.arange(before[-1]) + np.repeat(first - before[:-1], length)]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        bounds = before[np.searchsorted(np.flatnonzero(start), ends)].tolist()
        return [ids[a:b] for a, b in zip([0, *bounds], bounds)]


#: Bytes of texts that are encoded at once, about: enough for their pieces to recur.
TEXT_BYTES = 1 << 22


def text_slices(batch: pa.RecordBatch):
    """A batch with a column of texts, in slices of about TEXT_BYTES; a longer text is the first of its slice."""
    group = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // TEXT_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if a < b)


_tokenizers: dict[str, _Library] = {}


def library_ids(path: str, texts: list[str | None], whole: bool = False) -> list[np.ndarray]:
    """Ids of texts by the tokenizers library.

    The library encodes each piece of plain texts once (a bounded cache) if its file cuts such texts in the known
    way, and other texts whole; with `whole` it encodes every text whole, which gives the same ids in more time.
    """
    if path not in _tokenizers:
        _tokenizers[path] = _Library(path)
    library = _tokenizers[path]
    plain = [plain_lower(t or "") if library.cache is not None and not whole else None for t in texts]
    some = [t for t in plain if t is not None]
    found = iter(library.plain_ids(some) if some else [])
    return [library.ids(t or "") if p is None else next(found) for t, p in zip(texts, plain)]


def _write(path: str, folder: str, end_id: int, shard_ids: int):
    names = ["part", "seq", "file", "n_docs", "n_ids"]

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, seq, docs, ids, held = TaskContext.get().partitionId(), 0, [], [], 0
        width = 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        fs, base = filesystem(folder)
        fs.create_dir(base)

        def written():
            nonlocal seq, docs, ids, held
            name = f"ids-{part:06d}-{seq:05d}.bin"
            temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary, compression=None) as out:
                out.write(shard_bytes(docs, ids, width))
            fs.move(temporary, f"{base}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, seq, name, len(docs), held)], names=names)
            seq, docs, ids, held = seq + 1, [], [], 0
            return row

        for batch in batches:
            for some in text_slices(batch):
                for doc, found in zip(some.column("doc_id").to_pylist(), library_ids(path, some.column("text").to_pylist())):
                    docs.append(doc)
                    ids.append(np.append(found, np.uint32(end_id)).astype(f"<u{width}"))
                    held += len(found) + 1
                    if held >= shard_ids:
                        yield written()
        if docs:
            yield written()

    return run, "part long, seq long, file string, n_docs long, n_ids long"


def write_token_store(docs: DataFrame, path: str, folder: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Writes docs(doc_id, text) as shards and a manifest into folder, in ascending doc_id order.

    A null text counts as an empty one and gives only the end id; null doc_ids come first; rows with equal
    doc_id stand in order of their texts; an empty table gives a manifest without rows; other columns are
    ignored, whatever their names. Shards are written under temporary names and then renamed, and a task that
    runs again writes the same shards; the manifest, written last, names those that count.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    run, schema = _write(path, f"{folder}/shards", end_id, shard_ids)
    shards = stage(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, schema), "shards")
    # one row for each writing task is summed in one place, a task's own shards where they lie
    before = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).selectExpr("part", "sum(n) over (order by part) - n as before")
    placed = shards.selectExpr("*", "sum(n_ids) over (partition by part order by seq) - n_ids as within").join(before, "part")
    placed.selectExpr("file", "n_docs", "n_ids", "before + within as base").write.parquet(f"{folder}/manifest")


def read_token_store(spark: SparkSession, folder: str) -> DataFrame:
    """The store's documents: doc_id, start (ids of all documents before it), n_tokens and ids_crc32."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches):
        fs, base = filesystem(f"{folder}/shards")
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with fs.open_input_file(f"{base}/{file}") as source:
                    shard = Shard(source.read())
                rows = [(d, before + a, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, a, x in shard.rows()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    manifest = spark.read.schema("file string, n_docs long, n_ids long, base long").parquet(f"{folder}/manifest")
    # a task for each shard, at most READERS; a given number of ranges is not coalesced
    files = manifest.count()
    return manifest.repartitionByRange(max(1, min(READERS, files)), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Writes docs as a store in the shared folder and reads it back."""
    folder = new_folder(docs.sparkSession, "token-store")
    write_token_store(docs, path, folder, end_id)
    return read_token_store(docs.sparkSession, folder)
