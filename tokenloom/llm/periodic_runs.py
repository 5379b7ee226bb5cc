"""Periodic runs of words: harmonic grid probing, and extension of what survives by chunked comparison.

A run of period p and length 4p or more holds four neighbouring points of the grid 0, p, 2p, ..., whose words
are then equal. So for each p the words at jp and (j+1)p are compared, for all j at once: n/p probes, n log n
for all periods of a text. Only where three such tests in a row succeed is the stretch extended to both sides,
a chunk of words at a time, as far as words p apart are equal. Points of the grid that lie in a run found
before, of that period or of one that divides it, would give the same stretch again and are skipped; what is
left has p for its smallest period. A text is worked on whole, in the task that read it; nothing is shuffled.
"""

from __future__ import annotations

import functools
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from tokenloom.llm.common import SLICE_ROWS

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words compared at once when a stretch is extended: the first time, and at most.
_CHUNK, _LARGEST_CHUNK = 32, 8192
#: Words up to which all grids of a text are compared at once; their places are kept for texts of about that size.
_SHORT = 4096
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
FOUND = from_arrow_type(_FOUND)


def _end_of_match(w: np.ndarray, i: int, p: int) -> int:
    """The first place from i on whose word differs from that p behind it, or the last place with none behind it."""
    step, last = _CHUNK, len(w) - p
    while i < last:
        stop = min(i + step, last)
        differ = w[i:stop] != w[i + p : stop + p]
        at = int(differ.argmax())
        if differ[at]:
            return i + at
        i, step = stop, min(2 * step, _LARGEST_CHUNK)
    return last


def _start_of_match(w: np.ndarray, i: int, p: int) -> int:
    """The first place of the stretch up to i whose words all equal those p behind them."""
    step = _CHUNK
    while i > 0:
        stop = max(i - step, 0)
        differ = (w[stop:i] != w[stop + p : i + p])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return i - at
        i, step = stop, min(2 * step, _LARGEST_CHUNK)
    return 0


@functools.lru_cache(maxsize=64)
def _grids(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The grids 0, p, 2p, ... of all periods of n words, end to end with a gap (place n) behind each, and where each begins."""
    grids = [np.append(np.arange(0, n, p), n) for p in range(1, n // LEAST_PERIODS + 1)]
    return np.concatenate(grids), np.cumsum([0, *map(len, grids[:-1])])


def _three_in_a_row(same: np.ndarray) -> np.ndarray:
    """The places of three neighbouring true values."""
    if same.tobytes().find(b"\1\1\1") < 0:
        return np.empty(0, np.int64)
    return np.flatnonzero(same[2:] & same[1:-1] & same[:-2])


def _probes(w: np.ndarray):
    """(p, all j at which the words at jp, (j+1)p, (j+2)p and (j+3)p are equal), p ascending, where there is any."""
    n = len(w)
    if n <= _SHORT:  # one gather for all periods, over a size that other texts share
        size = -(-n // 32) * 32 if n <= 512 else -(-n // 256) * 256
        places, begins = _grids(size)
        # words behind the end equal no word and not each other
        grid = np.concatenate([w, np.arange(-1, n - size - 2, -1, dtype=w.dtype)])[places]
        at = _three_in_a_row(grid[1:] == grid[:-1])
        if len(at):
            p = np.searchsorted(begins, at, "right")
            yield from _by_period(p, at - begins[p - 1])
        return
    most, few = n // LEAST_PERIODS, int(1.5 * n**0.5)
    for p in range(1, min(few, most) + 1):
        grid = w[::p]
        at = _three_in_a_row(grid[1:] == grid[:-1])
        if len(at):
            yield p, at
    # long periods have few points: all periods up to twice the first are tested at the same j
    first = few + 1
    while first <= most:
        stop = min(2 * first, most + 1)
        periods, js = [], []
        for j in range((n - 1) // first - 2):
            p = np.arange(first, min(stop, (n - 1) // (j + 3) + 1))
            at = j * p
            hit = p[w[at] == w[at + p]]
            for more in (1, 2):
                if not len(hit):
                    break
                at = (j + more) * hit
                hit = hit[w[at] == w[at + hit]]
            if len(hit):
                periods.append(hit)
                js.append(np.full(len(hit), j))
        if periods:
            p, j = np.concatenate(periods), np.concatenate(js)
            order = np.lexsort((j, p))
            yield from _by_period(p[order], j[order])
        first = stop


def _by_period(p: np.ndarray, j: np.ndarray):
    """(period, its j) of sorted pairs."""
    cuts = (np.flatnonzero(np.diff(p)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(p)]):
        yield int(p[a]), j[a:b]


def find_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the integers w, by start, then period.

    A run is a stretch with smallest period p that no neighbour extends keeping p, of max(6, 4p) words or more.
    """
    found: dict[int, tuple[list[int], list[int]]] = {}  # period -> starts and ends, both ascending
    if len(w) >= LEAST_WORDS:
        for p, js in _probes(w):
            at = js * p
            for q, (starts, ends) in found.items():
                if p % q == 0 and len(at):
                    place = np.searchsorted(starts, at, "right") - 1
                    at = at[(place < 0) | (at + p >= np.asarray(ends)[place])]
            done = -1
            for i in at.tolist():
                if i + p < done:
                    continue
                a, done = _start_of_match(w, i, p), _end_of_match(w, i, p) + p
                if done - a >= max(LEAST_WORDS, LEAST_PERIODS * p):
                    starts, ends = found.setdefault(p, ([], []))
                    place = bisect_right(starts, a)
                    starts.insert(place, a)
                    ends.insert(place, done)
    return sorted((a, b - a, p) for p, (starts, ends) in found.items() for a, b in zip(starts, ends))


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds behind its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def text_runs(text: str | None) -> tuple[int, list[tuple[int, int, int]], str]:
    """Number of words, runs and collapsed text of a text."""
    words = (text or "").encode().split()  # bytes part at the same six characters as the words of this package
    numbers: dict[bytes, int] = {}
    w = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int32, len(words))
    runs = find_runs(w)
    return len(words), runs, collapsed_words(words, runs).decode()


@F.arrow_udf(FOUND)
def _found(column: pa.Array) -> pa.Array:
    parts = []
    for at in range(0, len(column), SLICE_ROWS):
        rows = [text_runs(t) for t in column.slice(at, SLICE_ROWS).to_pylist()]
        runs = pa.array([[{"start": a, "length": n, "period": p} for a, n, p in r] for _, r, _ in rows], pa.list_(_RUN))
        parts.append(pa.StructArray.from_arrays([pa.array([n for n, _, _ in rows], pa.int64()), runs, pa.array([c for _, _, c in rows], pa.string())], fields=[*_FOUND]))
    return pa.concat_arrays(parts) if parts else pa.array([], _FOUND)


def with_runs(docs: DataFrame, text: Column, name: str = "found") -> DataFrame:
    """docs with `name`: a struct of n_words, runs (start, length, period; by start, then period) and the collapsed text.

    Words are [^\\x20\\x09-\\x0D]+, numbered from 0. A null or empty text has no words, no runs and an empty
    collapsed text; rows are worked on one by one, so ids may be null or repeated and other columns have any
    names but `name`; texts of any length are searched whole; an empty table gives an empty table.
    """
    return docs.withColumn(name, _found(text.cast("string")))


def with_loops(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with one id in ten, by its crc32, having a tail of words that repeats with one period.

    With h the crc32 of the decimal id, g = h div 10 and n words: if h is a multiple of 10, each word i >= a
    becomes word a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8). The words are then
    joined by one space. Texts without words and rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.select("doc_id", "text", "words", "g", F.size("words").cast("long").alias("n"), (F.col("g") % F.nullif(F.size("words"), F.lit(0))).alias("a"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    # the words are a column of their own, so that they are cut once and not for each place
    looped = F.expr("array_join(concat(slice(words, 1, int(a)), transform(sequence(0L, n - a - 1), i -> get(words, int(a + i % p)))), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, looped).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text), looped by with_loops(): the number of runs, the longest one and digests, a row for each row.

    start, length, period and exponent_milli describe the longest run (ties: smallest start, then period) and
    are null without one; the digests are never null. Odd rows as in with_runs().
    """
    rows = with_loops(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    rows = with_runs(rows, F.col("text")).select("doc_id", "found.n_words", "found.runs", "found.collapsed")
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = rows.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, longest).alias("top"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = -F.col("top.l"), F.col("top.period")
    return rows.select("doc_id", "n_runs", F.col("top.start").alias("start"), length.alias("length"), period.alias("period"), F.expr("(-top.l * 1000) div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")


#: crc32 of a string of ASCII characters, with a table made from the polynomial.
CRC_SQL = """
crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, i)) AS t)"""


def crc_sql(s: str) -> str:
    return f"xor(list_reduce(list_transform(string_split({s}, ''), lambda c: ascii(c)::BIGINT), lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


SQL = rf"""
WITH {CRC_SQL.strip()},
cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w, CASE WHEN doc_id IS NULL THEN 1 ELSE {crc_sql("doc_id::VARCHAR")} END AS h FROM documents, crc_table),
sized AS (SELECT row_number() OVER () AS k, doc_id, w, len(w) AS n, h % 10 = 0 AS looped, h // 10 AS g FROM cut),
sources AS (SELECT k, unnest(w) AS word, unnest(range(n)) AS i FROM sized),
aims AS (SELECT k, i, CASE WHEN looped AND i >= g % n THEN g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) ELSE i END AS of_ FROM sources JOIN (SELECT k, n, looped, g FROM sized) USING (k)),
words AS (SELECT aims.k, aims.i, word FROM aims JOIN sources ON sources.k = aims.k AND sources.i = of_),
probes AS (SELECT k, p, unnest(range(0, n - p, p)) AS i FROM (SELECT k, n, unnest(range(1, n // 4 + 1)) AS p FROM sized)),
pairs AS (SELECT probes.k, p, probes.i, CASE WHEN a.word = b.word THEN 1 ELSE 0 END AS same FROM probes JOIN words a ON a.k = probes.k AND a.i = probes.i JOIN words b ON b.k = probes.k AND b.i = probes.i + p),
hits AS (SELECT DISTINCT k, p FROM (SELECT k, p, sum(same) OVER (PARTITION BY k, p ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS three FROM pairs) WHERE three = 3),
breaks AS (SELECT hits.k, p, a.i FROM hits JOIN words a ON a.k = hits.k JOIN words b ON b.k = hits.k AND b.i = a.i + p WHERE a.word <> b.word
  UNION ALL SELECT k, p, -1 FROM hits UNION ALL SELECT hits.k, p, n - p FROM hits JOIN sized USING (k)),
gaps AS (SELECT k, p, i + 1 AS start, lead(i) OVER (PARTITION BY k, p ORDER BY i) - i - 1 + p AS length FROM breaks),
runs AS (SELECT k, start, length, min(p) AS period FROM gaps WHERE length >= greatest(6, 4 * p) GROUP BY k, start, length),
facts AS (SELECT k, count(*) AS n_runs, first(start ORDER BY length DESC, start, period) AS start, max(length) AS length, first(period ORDER BY length DESC, start, period) AS period,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY k),
gone AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256, n AS n_words
FROM sized LEFT JOIN facts USING (k) LEFT JOIN kept USING (k)
"""
