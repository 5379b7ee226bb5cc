"""Overlap of documents with evaluation texts as substrings, through anchors chosen by winnowing.

A text of `least` characters or more has an anchor: of the windows of k characters in its first `least`
characters, that with the smallest hash. A document that holds the text holds those characters too, and the
same window is the smallest of w neighbouring ones there. So a document's candidates are the windows that are the
smallest of some w neighbours, one in eight or so; those whose hash is none of an evaluation text's are passed
over by a bitmap of fixed size, and the few left are joined with the evaluation texts on the hash and compared
character by character at their place. No evaluation text goes to the driver and no document is written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.operators.staged import staged

#: Bits of the bitmap for each evaluation text, and in all: 64 MB at most, beyond which more candidates are compared.
BITS, MOST_BITS = 256, 1 << 29
_BASE = 0x9E3779B97F4A7C15
_ONE = np.uint64(1)


def window_sizes(least: int) -> tuple[int, int]:
    """k and w: windows of k characters, and how many of them lie in `least` characters."""
    k = least // 2 + 1
    return k, least - k + 1


def window_hashes(text: str, k: int) -> np.ndarray:
    """A hash of each k neighbouring characters, from those of stretches of 1, 2, 4, ... characters."""
    part = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + _ONE
    n, size, out, done = len(part), 1, None, 0
    if n < k:
        return np.empty(0, np.uint64)
    while True:
        if k & size:  # the stretch of this size goes behind those of smaller sizes
            power = np.uint64(pow(_BASE, size, 1 << 64))
            out = part if out is None else out[: len(part) - done] * power + part[done:][: len(out)]
            done += size
        if done == k:
            break
        part = part[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size:]
        size *= 2
    out = out[: n - k + 1].copy()
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _sliding(values: np.ndarray, w: int, of) -> np.ndarray:
    """of(...) over each w neighbouring values, by doubling."""
    size = 1
    while 2 * size <= w:
        values = of(values[:-size], values[size:])
        size *= 2
    return of(values[: len(values) - (w - size)], values[w - size :]) if w > size else values


def smallest_places(h: np.ndarray, w: int) -> np.ndarray:
    """The places of all hashes that are the smallest of some w neighbours."""
    if len(h) < w:
        return np.empty(0, np.int64)
    least = _sliding(h, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), w, np.maximum) == h)


def _bits(h: np.ndarray, size: int) -> list[np.ndarray]:
    """Two bits of each hash in a bitmap of `size` bits, a power of two."""
    mask = np.uint64(size - 1)
    return [h & mask, (h >> np.uint64(33)) & mask]


def _anchors(least: int):
    k, w = window_sizes(least)

    def run(batches):
        for batch in batches:
            at = [int(window_hashes(t[:least], k)[:w].argmin()) for t in batch.column("text").to_pylist()]
            h = [int(window_hashes(t[i : i + k], k)[0].astype(np.int64)) for i, t in zip(at, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(at, pa.int32()), batch.column("text"), batch.column("own")], names=["hash", "at", "text", "own"])

    return run


def _candidates(least: int, longest: int, bitmap: np.ndarray):
    k, w = window_sizes(least)
    names = ["key", "own", "hash", "lead", "part"]

    def run(batches):
        size = 8 * len(bitmap)
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                h = window_hashes(text, k)
                places = smallest_places(h, w)
                held = np.ones(len(places), np.uint8)
                for bit in _bits(h[places], size):
                    held &= (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
                places = places[held == 1].tolist()
                for begin in range(0, len(places), 256):
                    some = places[begin : begin + 256]
                    lead = [min(p, w - 1) for p in some]
                    parts = [text[p - a : p + longest] for p, a in zip(some, lead)]
                    hashes = h[some].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column("key")[i].as_py()] * len(some), pa.string()), pa.array([batch.column("own")[i].as_py()] * len(some), pa.string()), pa.array(hashes), pa.array(lead, pa.int32()), pa.array(parts, pa.string())],
                        names=names,
                    )

    return run


def overlapping_keys(docs: DataFrame, banned: DataFrame, least: int) -> DataFrame:
    """docs(text, own, key), banned(text, own) -> the distinct (key, own) whose text holds one of the banned texts."""
    anchors = staged(banned.mapInArrow(_anchors(least), "hash long, at int, text string, own string"), "anchors")
    n, longest = anchors.agg(F.count("*"), F.max(F.char_length("text"))).first()
    if not n:
        return docs.select("key", "own").limit(0)
    size = min(MOST_BITS, 1 << max(20, (BITS * n - 1).bit_length()))
    # words of the bitmap that are not empty: at most two for each text and never more than the bitmap has
    bit = F.explode(F.array(F.col("hash").bitwiseAND(size - 1), F.shiftrightunsigned("hash", 33).bitwiseAND(size - 1)))
    words = anchors.select(bit.alias("b")).groupBy(F.floor(F.col("b") / 8).cast("long").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(b % 8 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(size // 8, np.uint8)
    bitmap[words["byte"].to_numpy()] = words["bits"].to_numpy().astype(np.uint8)
    found = docs.where(F.char_length("text") >= least).mapInArrow(_candidates(least, longest, bitmap), "key string, own string, hash long, lead int, part string")
    same = F.expr("lead >= at and substring(part, lead - at + 1, char_length(b.text)) = b.text")
    return found.alias("f").join(anchors.alias("b"), (F.col("f.hash") == F.col("b.hash")) & (F.col("f.own") == F.col("b.own")) & same).select("key", "f.own").distinct()
