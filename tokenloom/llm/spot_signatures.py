"""Document fingerprints by SpotSigs: chains of content words that follow common-word anchors.

Words are runs of letters in lower case. At every anchor (a frequent function word) the next CHAIN content
words (words that aren't anchors) form a signature with it; a document's signatures are a set of 32-bit
hashes, and the fingerprint is that set, sorted, in hexadecimal. Natural-language passages are full of
anchors and page furniture is not, so near copies keep most signatures. Texts without any anchor take every
word as one. The likeness of two fingerprints is their Jaccard similarity; sets whose sizes alone rule a
threshold out are not compared, which also partitions a collection by set length in near_pairs().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import CACHE_WORDS, mix, stage

#: Rows of a range of doc_id, about, and ranges at most; a range is sorted and read as a stream in one task.
RANGE_ROWS, MOST_RANGES = 4_000, 10_000
#: Content words of a signature.
CHAIN = 2
#: Common words of the languages of the corpus. Fixed values.
ANCHORS = frozenset(
    "a an and are as at be by for from had has have he in is it not of on or that the this to was were which with "
    "au aux avec ce dans de des du elle en est et il la le les mais ne par pas pour que qui sur un une "
    "als am auch auf aus bei das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "al como con del el ella era es lo los las no para por se su sus una y".split()
)
_LETTERS = regex.compile(r"\p{L}+")
_ANCHOR, _CONTENT = 1, 2


class _Words(dict):
    """White-space-free word -> its letter runs as (hash << 2 | kind) packed in bytes."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        runs = _LETTERS.findall(word.lower())
        codes = [xxhash.xxh3_64_intdigest(r.encode("utf-8", "surrogatepass")) >> 2 << 2 | (_ANCHOR if r in ANCHORS else _CONTENT) for r in runs]
        self[word] = out = np.array(codes, np.uint64).tobytes()
        return out


def signature_set(text: str, words: _Words) -> np.ndarray:
    """Sorted distinct 32-bit signatures of a text."""
    code = np.frombuffer(b"".join(map(words.__getitem__, text.split())), np.uint64)
    anchor = (code & np.uint64(3)) == _ANCHOR
    if not anchor.any():  # no function words: every word is an anchor of the words after it
        starts, content, at = code, code, np.arange(1, len(code) + 1)
    else:
        content = code[~anchor]
        starts, at = code[anchor], np.cumsum(~anchor)[anchor]
    if not len(starts):
        return np.empty(0, np.uint32)
    padded = np.concatenate([content, np.zeros(CHAIN, np.uint64)])
    sig = mix(starts)
    for i in range(CHAIN):
        sig = mix(sig + padded[at + i])
    return np.unique((sig >> np.uint64(32)).astype(np.uint32))


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard similarity of two signature sets (1 for two empty ones), or 0 where sizes rule at_least out."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < at_least * max(len(a), len(b)):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def to_text(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint, n_signatures. A null text counts as empty and has no signatures."""

    def run(batches):
        words = _Words()
        for batch in batches:
            sets = [signature_set(t or "", words) for at in range(0, batch.num_rows, 128) for t in batch.column("text").slice(at, 128).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(to_text, sets), pa.string()), pa.array(map(len, sets), pa.int64())], names=["doc_id", "fingerprint", "n_signatures"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string, n_signatures long")


def _edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the start of the following one."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def _range_starts(docs: DataFrame) -> list[int]:
    """doc_ids that cut the table into ranges of about RANGE_ROWS rows, at most MOST_RANGES of them."""
    parts = min(MOST_RANGES, max(2, -(-docs.count() // RANGE_ROWS)))
    found = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts).alias("q")).first()["q"]
    return sorted(set(found or []))


def _range_of(doc_id: Column, starts: list[int]) -> Column:
    """The number of the range of a doc_id, 0 for null: first among every 64th start, then among the 64 behind it."""
    if not starts:
        return F.lit(0)
    blocks = [starts[at : at + 64] for at in range(0, len(starts), 64)]
    at = F.size(F.filter(F.array(*(F.lit(b[0]) for b in blocks)), lambda c: c <= doc_id))
    own = F.element_at(F.array(*(F.array(*map(F.lit, b)) for b in blocks)), F.greatest(at, F.lit(1)))
    place = (F.greatest(at, F.lit(1)) - 1) * 64 + F.size(F.filter(own, lambda c: c <= doc_id))
    return F.when(doc_id.isNull(), 0).otherwise(place).cast("int")


def _task_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n tasks a number that hash partitioning sends there, so that no two ranges meet in one by chance."""
    rows = spark.range(40 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("task")).agg(F.min("id").alias("id")).collect()
    found = {r["task"]: r["id"] for r in rows}
    return [found.get(t, t) for t in range(n)]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and the next document in ascending doc_id order (after the last: the first).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document. Null texts count as empty ones; null doc_ids come first; rows with equal doc_id stand in
    order of their texts; a table of one row is its own next; an empty table gives an empty table; other
    columns are ignored, whatever their names. Rows are shuffled once, by ranges of doc_id (rows of one id stay together); the first row of
    each range, found beforehand, is also sent to the range before it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    starts = _range_starts(rows)
    ranged = rows.withColumn("part", _range_of(F.col("doc_id"), starts))
    # the first row of each range that has rows, as the row after the last of the range before it
    keys = rows.select("doc_id").withColumn("part", _range_of(F.col("doc_id"), starts))
    firsts = keys.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("doc_id"))).alias("f")).orderBy("part").collect()
    after = {firsts[i - 1]["part"]: r["f"]["doc_id"] for i, r in enumerate(firsts)}
    wanted = F.array(*(F.struct(F.lit(p).alias("part"), F.lit(d).cast("long").alias("doc_id")) for p, d in after.items())) if after else None
    if wanted is not None:
        heads = sorted({d for d in after.values() if d is not None})
        one = F.col("doc_id").isin(heads) if heads else F.lit(False)
        if None in after.values():
            one |= F.col("doc_id").isNull()
        head = rows.where(one).groupBy("doc_id").agg(F.min("text").alias("text"))
        sent = head.select("doc_id", "text", F.explode(F.filter(wanted, lambda x: x["doc_id"].eqNullSafe(F.col("doc_id")))).alias("to")).select("doc_id", "text", F.col("to.part").alias("part"), F.lit(1).alias("last"))
        ranged = ranged.withColumn("last", F.lit(0)).unionByName(sent)
    else:
        ranged = ranged.withColumn("last", F.lit(0))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = pa.schema([pa.field(n, t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))])

    def run(batches):
        words, held = _Words(), None
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                for doc, text, part, last in zip(*(some.column(c).to_pylist() for c in ("doc_id", "text", "part", "last"))):
                    own = signature_set(text, words)
                    if held and held[3] == part:
                        d, t, s, _ = held
                        edited = _edited(t, text)
                        e = signature_set(edited, words)
                        out.append((d, len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_text(s), to_text(e), likeness(s, e), likeness(s, own)))
                    held = None if last else (doc, text, own, part)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(names), schema)], schema=schema)

    keys = _task_keys(docs.sparkSession, len(starts) + 1)
    key = F.element_at(F.array(*(F.lit(k).cast("long") for k in keys)), F.col("part") + 1)
    dealt = ranged.withColumn("task", key).repartition(len(keys), "task").sortWithinPartitions("part", "last", "doc_id", "text").select("doc_id", "text", "part", "last")
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_pairs(docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of class representatives with a likeness of at_least or more, and their classes' rows.

    Documents with equal fingerprints are one class, named by its smallest doc_id. Classes are partitioned by
    set length into bands as wide as the threshold, and meet in their own band or the next over the rarest
    signatures that a pair above the threshold must share (a prefix of the set in order of document
    frequency); then their whole sets are compared. Documents without signatures have no pairs.
    """
    own = stage(fingerprints(docs), "fingerprints")
    classes = stage(own.where("n_signatures > 0 and doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("doc"), F.first("n_signatures").alias("n")), "classes")
    each = classes.select("doc", "n", "fingerprint", F.explode(F.expr("transform(sequence(0, cast(n as int) - 1), i -> substring(fingerprint, 8 * i + 1, 8))")).alias("sig"))
    freq = each.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = each.select("doc", "n", "sig").join(freq, "sig").selectExpr("doc", "n", "sig", "row_number() over (partition by doc order by df, sig) r")
    prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(at_least * F.col("n")) + 1).select("doc", "n", "sig")
    band = F.floor(F.log("n") / (1e-9 - np.log(at_least))).cast("long")
    left = prefix.withColumn("band", F.explode(F.array(band, band + 1)))
    right = prefix.withColumn("band", band).withColumnsRenamed({"doc": "doc_b", "n": "n_b"})
    inside = left.join(right, ["sig", "band"]).where((F.col("doc") != F.col("doc_b")) & (F.least("n", "n_b") >= at_least * F.greatest("n", "n_b")))
    pairs = inside.select(F.least("doc", "doc_b").alias("a"), F.greatest("doc", "doc_b").alias("b")).distinct()
    sets = classes.select("doc", "fingerprint")
    both = pairs.join(sets.withColumnsRenamed({"doc": "a", "fingerprint": "fa"}), "a").join(sets.withColumnsRenamed({"doc": "b", "fingerprint": "fb"}), "b")

    def run(batches):
        for batch in batches:
            near = [likeness(from_text(x), from_text(y), at_least) for x, y in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.float64())], names=["a", "b", "likeness"])

    return both.mapInArrow(run, "a long, b long, likeness double").where(F.col("likeness") >= at_least)
