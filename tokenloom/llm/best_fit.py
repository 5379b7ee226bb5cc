"""Bounded-space online best-fit: documents into sequences of a fixed capacity, with few places left free.

A task keeps a fixed number of open bins. A bitset has a bit for each free space that some open bin has, so the
fullest bin that takes an item is the lowest bit at or above the item's length; if none takes it, a bin is
opened, and when too many are open the fullest one closes. Only whole sequences and what exceeds them is cut
from long documents. Items come in the order of the rows, those of a look-ahead (of tokens for half the
open bins) longest first, which is an order that an online packer may choose freely.

The packing takes place where the documents are read and encoded, and nothing is shuffled but what is open at
the end: each task's open bins are then items of another round, in which one task packs the bins of FAN tasks,
and so on, until one task has packed the last. A bin travels as the records of its pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import stage
from tokenloom.llm.token_store import library_ids, text_slices

CAPACITY = 4096
#: Bins that a task keeps open.
OPEN_BINS = 512
#: Tasks whose open bins are packed by one task of the next round.
FAN = 32
#: A piece of a document; known is 0 for a document without an id.
_PIECE = np.dtype([("doc_id", "<i8"), ("piece", "<i8"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4"), ("known", "u1")])


class OpenBins:
    """Open bins by their free space, at most `limit` of them; place() returns the bins that close."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.n = capacity, limit, 0
        self.bits = 0  # bit f is set if a bin has f places free
        self.bins: list[list[list]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> list:
        same = self.bins[free]
        bin_ = same.pop()
        self.n -= 1
        if not same:
            self.bits ^= 1 << free
        return bin_

    def _put(self, bin_: list, free: int) -> None:
        self.bins[free].append(bin_)
        self.bits |= 1 << free
        self.n += 1

    def place(self, item, length: int) -> list | None:
        """Puts an item into the fullest bin that takes it, or a new one; the bin that closed, if one did."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, []
        bin_.append(item)
        if free == length:
            return bin_
        self._put(bin_, free - length)
        # the new bin is the emptiest as a rule; it closes only if it is itself the fullest
        return self._take((self.bits & -self.bits).bit_length() - 1) if self.n > self.limit else None

    def rest(self) -> Iterator[list]:
        """The open bins, fullest first."""
        while self.n:
            yield self._take((self.bits & -self.bits).bit_length() - 1)


class Packer:
    """Items of one task, in order, through a look-ahead into open bins; items are bytes that a bin joins."""

    def __init__(self, capacity: int, open_bins: int):
        self.open, self.window = OpenBins(capacity, open_bins), max(1, open_bins // 2) * capacity
        self.waiting: list[tuple[int, bytes]] = []
        self.held = 0

    def add(self, item: bytes, length: int) -> Iterator[bytes]:
        """Closed bins."""
        self.waiting.append((length, item))
        self.held += length
        if self.held >= self.window:
            yield from self.flush()

    def flush(self) -> Iterator[bytes]:
        self.waiting.sort(key=lambda x: -x[0])
        for length, item in self.waiting:
            closed = self.open.place(item, length)
            if closed is not None:
                yield b"".join(closed)
        self.waiting, self.held = [], 0

    def rest(self) -> Iterator[bytes]:
        yield from self.flush()
        yield from map(b"".join, self.open.rest())


def document_pieces(doc_id: int | None, ids: np.ndarray, capacity: int) -> np.ndarray:
    """The pieces of a document: whole sequences, and the rest."""
    out = np.empty(-(-len(ids) // capacity), _PIECE)
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    for i in range(len(out)):
        part = raw[4 * i * capacity : 4 * (i + 1) * capacity]
        out[i] = doc_id or 0, i, i * capacity, len(part) // 4, zlib.crc32(part), doc_id is not None
    return out


_BINS = pa.schema([("part", pa.int64()), ("bin", pa.int64()), ("closed", pa.bool_()), ("pieces", pa.binary())])
_BINS_DDL = "part long, bin long, closed boolean, pieces binary"
_PLACES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


class _Writer:
    """Bins of one task as batches, numbered in the order in which they close."""

    def __init__(self):
        self.part, self.n, self.rows, self.held = TaskContext.get().partitionId(), 0, [], 0

    def add(self, pieces: bytes, closed: bool) -> Iterator[pa.RecordBatch]:
        self.rows.append((self.part, self.n, closed, pieces))
        self.n, self.held = self.n + 1, self.held + len(pieces)
        if self.held >= 1 << 22:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), _BINS)] if self.rows else [pa.array([], f.type) for f in _BINS], schema=_BINS)
        self.rows, self.held = [], 0
        return out


def _packed_documents(path: str, end_id: int, capacity: int, open_bins: int):
    def run(batches):
        packer, out = Packer(capacity, open_bins), _Writer()
        for batch in batches:
            for some in text_slices(batch):
                for doc, found in zip(some.column("doc_id").to_pylist(), library_ids(path, some.column("text").to_pylist())):
                    ids = np.append(found, np.uint32(end_id))
                    pieces = document_pieces(doc, ids, capacity)
                    for i, length in enumerate(pieces["length"].tolist()):
                        raw = pieces[i : i + 1].tobytes()
                        for closed in [raw] if length == capacity else packer.add(raw, length):
                            yield from out.add(closed, True)
        for rest in packer.rest():
            yield from out.add(rest, False)
        yield out.batch()

    return run


def _packed_bins(capacity: int, open_bins: int, last: bool):
    def run(batches):
        packer, out = Packer(capacity, open_bins), _Writer()
        for batch in batches:
            for pieces in batch.column("pieces"):
                raw = pieces.as_py()
                for closed in packer.add(raw, int(np.frombuffer(raw, _PIECE)["length"].sum())):
                    yield from out.add(closed, True)
        for rest in packer.rest():
            yield from out.add(rest, last)
        yield out.batch()

    return run


def _places(round_: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = np.frombuffer(batch.column("pieces")[i].as_buffer(), _PIECE)
                sequence = round_ << 58 | batch.column("part")[i].as_py() << 32 | batch.column("bin")[i].as_py()
                length = found["length"].astype(np.int64)
                columns = [found["piece"], found["start"], length, found["crc"].astype(np.int64), np.full(len(found), sequence), np.cumsum(length) - length]
                arrays = [pa.array(found["doc_id"], mask=found["known"] == 0), *(pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=_PLACES)

    return run


def _gathered(bins: DataFrame, tasks: int) -> DataFrame:
    """The open bins of neighbouring tasks in one task each, in order."""
    return bins.withColumn("__to", F.floor(F.col("part") / FAN)).repartitionByRange(tasks, "__to").sortWithinPartitions("part", "bin").drop("__to")


def best_fit(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset: each piece's place.

    A document is its ids and end_id. Only longer ones than capacity are cut, into pieces of that length and a
    rest. sequence_id is unique and otherwise without meaning; the pieces of a sequence stand in it without gaps
    from 0. A null or empty text has only the end id; a null doc_id stays null; repeated rows are packed each for
    itself; texts of any length are encoded whole; an empty table gives an empty table; other columns are
    ignored, whatever their names. The same files read in the same splits give the same sequences.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bins = stage(rows.mapInArrow(_packed_documents(path, end_id, capacity, open_bins), _BINS_DDL), "bins")
    found = [bins.where("closed")]
    tasks = (bins.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        tasks = -(-tasks // FAN)
        last = tasks == 1
        bins = stage(_gathered(bins.where("not closed"), tasks).mapInArrow(_packed_bins(capacity, open_bins, last), _BINS_DDL), "bins")
        found.append(bins.where("closed"))
        if last:
            break
    places = [b.mapInArrow(_places(i), "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long") for i, b in enumerate(found)]
    out = places[0]
    for more in places[1:]:
        out = out.unionByName(more)
    return out
