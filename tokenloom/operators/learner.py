"""Byte-pair learning in rounds of many merges, each exactly what counting again after every merge would give.

A merge makes its own pair's neighbours rarer, and a new pair is never more frequent than the old pair whose
place it takes. So while the most frequent pair occurs t times or more, every pair that does so stands in a
stretch of a word in which all old pairs occurred t times or more. A round therefore

1. counts the pairs of all words, where the words lie, and takes for t the count from which on the pairs are few;
2. cuts the words into those stretches and adds up the distinct ones, of which there are far fewer than words,
   and none outside a bound: with too many, t is raised;
3. makes merges on the stretches alone: an index from each pair to the stretches that hold it gives, for a merge,
   the signed changes of the counts of the pairs beside it; nothing else is counted again. It ends when the best
   count falls below t, or when a merge makes a symbol that exists already, as the pairs of that symbol may then
   stand outside the stretches too;
4. applies the round's merges to all words, in one pass.

The driver holds no more than MOST_PAIRS counts and MOST_SEGMENTS stretches, whatever the corpus.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.replay import Merge

#: Pairs that a round looks at, and distinct stretches that it takes to the driver, at most.
MOST_PAIRS, MOST_SEGMENTS = 32_768, 100_000


class Segments:
    """Stretches of symbols with their numbers, their pairs' counts, and the stretches in which each pair stands."""

    def __init__(self, segments: Iterable[tuple[list[str], int]]):
        self.symbols: list[list[str]] = []
        self.n: list[int] = []
        self.counts: dict[Merge, int] = defaultdict(int)
        self.where: dict[Merge, set[int]] = defaultdict(set)
        same: dict[str, str] = {}  # one object for each symbol
        for i, (symbols, n) in enumerate(segments):
            symbols = [same.setdefault(s, s) for s in symbols]
            self.symbols.append(symbols)
            self.n.append(n)
            for pair in zip(symbols, symbols[1:]):
                self.counts[pair] += n
                self.where[pair].add(i)
        self.heap = [(-n, *pair) for pair, n in self.counts.items()]
        heapq.heapify(self.heap)

    def best(self) -> tuple[Merge, int] | None:
        """The most frequent pair, the first in order of its symbols among equals."""
        while self.heap:
            n, a, b = self.heap[0]
            if self.counts.get((a, b)) == -n:
                return (a, b), -n
            heapq.heappop(self.heap)
        return None

    def merge(self, pair: Merge) -> None:
        """Joins the pair wherever it stands, from the left, and changes the counts by what changed."""
        a, b = pair
        changes: dict[Merge, int] = defaultdict(int)
        for i in self.where.pop(pair, ()):
            old, new, at, n = self.symbols[i], [], 0, self.n[i]
            while at < len(old):
                joined = old[at] == a and at + 1 < len(old) and old[at + 1] == b
                new.append(a + b if joined else old[at])
                at += 2 if joined else 1
            if len(new) == len(old):
                continue  # an earlier merge took the pair from here
            self.symbols[i] = new
            for p in zip(old, old[1:]):
                changes[p] -= n
            for p in zip(new, new[1:]):
                changes[p] += n
                self.where[p].add(i)
        for p, change in changes.items():
            if change:
                self.counts[p] += change
                if self.counts[p] > 0:
                    heapq.heappush(self.heap, (-self.counts[p], *p))
                else:
                    del self.counts[p]

    def merges(self, least: int, most: int, known: set[str]) -> list[Merge]:
        """Up to `most` merges of pairs that occur `least` times or more; one that makes a known symbol is the last."""
        out: list[Merge] = []
        while len(out) < most and (found := self.best()) and found[1] >= least:
            pair = found[0]
            out.append(pair)
            self.merge(pair)
            if pair[0] + pair[1] in known:
                break
            known.add(pair[0] + pair[1])
        return out


def segments(words: DataFrame, pairs: Iterable[Merge]) -> DataFrame:
    """words(marked, n) -> (segment, n): the longest stretches of two symbols or more whose neighbours are all of the pairs."""
    wanted = frozenset(pairs)

    @F.pandas_udf("array<string>")
    def cut(marked: pd.Series) -> pd.Series:
        def one(m: str) -> list[str]:
            s = m[1:-1].split("><")
            out, begin = [], 0
            for i in range(1, len(s) + 1):
                if i == len(s) or (s[i - 1], s[i]) not in wanted:
                    if i - begin > 1:
                        out.append("><".join(s[begin:i]))
                    begin = i
            return out

        return marked.map(lambda m: one(m) if m else [], na_action="ignore")

    return words.select(F.explode(cut("marked")).alias("segment"), "n").groupBy("segment").agg(F.sum("n").alias("n"))


def learned_round(words: DataFrame, top: list[tuple[str, str, int]], whole: bool, most: int, least: int, known: set[str], most_segments: int) -> tuple[list[Merge], int]:
    """The merges of one round and the number of pairs it looked at; none if the first pairs cannot be told apart.

    top holds the most frequent pairs in order; whole says that there are no others of `least` or more.
    """
    bound = least if whole else top[-1][2] + 1
    while True:
        pairs = [(a, b) for a, b, n in top if n >= bound]
        if not pairs:
            return [], 0
        found = segments(words, pairs).limit(most_segments + 1).toArrow()
        if found.num_rows <= most_segments:
            held = Segments(zip((s.split("><") for s in found["segment"].to_pylist()), found["n"].to_pylist()))
            return held.merges(bound, most, known), len(pairs)
        bound = top[len(pairs) // 4][2] + 1
