"""N-gram Jaccard self-join by PartEnum signatures, exact, with near-copy classes.

Sets of word shingles are put into size bands whose width is the similarity, so that two linked sets lie in
the same or in neighbouring bands; a set takes part in the instance below and the one above. Within an
instance two linked sets differ in at most k features. The feature domain is cut into n1 first-level
partitions, each into n2 second-level ones, and every subset of n2 - k2 second-level partitions of a
first-level partition gives one signature (k2 = 1, n2 = 2: either half). n1 is chosen so that at least one
first-level partition holds at most k2 differences, so linked sets share a signature. Some more first-level
partitions than that are taken, so that signatures of empty partitions are only needed by sets that have
many of them; without this, unrelated sets would meet there.

Candidates are settled in two exact steps. First each signature's members are compared with its smallest
member, and the links found are joined into components. Then, only where a signature's members are still in
different components, they are compared pair by pair, in blocks of a bounded size, on small sketches, and what
is left on whole ones, that bound the number of differing features from below (a pair beyond the bound cannot be linked); what is left
then is verified on the whole sets.
Exact copies are one representative throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import BROADCAST_ROWS, SLICE_ROWS, WordHashes, drop_staged, free_name, mix, shingles, stage, texts
from tokenloom.llm.components import connected_components

#: Members of one comparison centre that are verified in one group; larger centres are split by salt.
SALT_ROWS = 256
#: Members of a signature that are compared with each other in one group; more are split into blocks, and blocks meet in pairs.
BLOCK_ROWS = 1024
#: A signature is hot if one in HOT_SHARE documents holds it HOT_ROWS times; its rows are then dealt to HOT_PARTS tasks.
#: Which ones are hot decides where rows lie and not what is found; of more than HOT_SIGNATURES the hottest are taken.
HOT_SHARE, HOT_ROWS, HOT_PARTS, HOT_SIGNATURES = 32, 256, 256, 100_000
#: Bytes of the sketches that travel with the members of signatures, of sets of up to 1,023 features.
SMALL_BLOCKS = 256
_ONE = np.uint64(1)


class Bands:
    """Size bands and, for each instance of PartEnum, its number of first-level partitions."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [1]

    def _reach(self, size: int) -> None:
        while self.low[-1] <= size:
            self.low.append(self.low[-1] * 100 // self.percent + 1)

    def of(self, size: int) -> int:
        self._reach(size)
        return int(np.searchsorted(self.low, size, side="right")) - 1

    def high(self, band: int) -> int:
        while len(self.low) <= band + 1:
            self._reach(self.low[-1])
        return self.low[band + 1] - 1

    def differences(self, both: int) -> int:
        """The most features in which linked sets with so many features together may differ."""
        return (100 - self.percent) * both // (100 + self.percent)

    def instance(self, band: int, size: int) -> tuple[int, int, int]:
        """(n1, own, spare) of the instance for this band and the next one, for a set of a size in either.

        n1 first-level partitions are enough for any linked sets of these bands, with `spare` to spare; the first
        `own` of them for those that a set of this size can be linked with.
        """
        k = self.differences(self.high(band) + self.high(band + 1))
        spare = 2 + k // 24
        # the largest partner: of the next band if this set lies in the lower one, else of the lower one
        most = min(self.high(band + 1), size * 100 // self.percent) if size <= self.high(band) else self.high(band)
        return (0, 0, 0) if k == 0 else (k // 2 + 1 + spare, min(k, self.differences(size + most)) // 2 + 1 + spare, spare)


def signatures(h: np.ndarray, bands: Bands) -> np.ndarray:
    """PartEnum signatures of a sorted set of uniform 64-bit features.

    Linked sets differ in d features at most, so of the first d // 2 + 1 + spare first-level partitions, which
    both sets use, spare + 1 hold one difference at most and have an equal half. A set leaves out the signatures
    of its empty halves unless more than `spare` of its partitions have one; so one equal half is left.
    """
    out, band = [], bands.of(len(h))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h))])
    for i in (band - 1, band):
        if i < 0 or not (found := bands.instance(i, len(h)))[0]:
            continue
        n1, own, spare = found
        halves = 2 * own
        block = ((h >> np.uint64(32)) * np.uint64(2 * n1)) >> np.uint64(32)
        edge = np.searchsorted(block, np.arange(halves + 1, dtype=np.uint64))
        empty = edge[1:] == edge[:-1]
        sig = mix((total[edge[1:]] - total[edge[:-1]]) ^ mix(np.arange(halves, dtype=np.uint64) + np.uint64((i + 1) << 32)))
        out.append(sig if int(empty.reshape(own, 2).any(1).sum()) > spare else sig[~empty])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sketch(h: np.ndarray) -> bytes:
    """One byte per block of the feature domain, the xor of its features; 8 blocks or more, a power of two.

    Up to 512 blocks there are as many as features or more, beyond that half as many at least, so that the
    blocks that differ stay a sharp bound on the features that do, for long texts too.
    """
    n = int(len(h)).bit_length()
    bits = max(3, n if n <= 9 else n - 1, 9 if n > 9 else 0)
    edge = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    run = np.concatenate([np.zeros(1, np.uint8), np.bitwise_xor.accumulate((mix(h) & np.uint64(255)).astype(np.uint8))])
    return (run[edge[1:]] ^ run[edge[:-1]]).tobytes()


def folded(own: bytes, n: int) -> bytes:
    """The sketch of a set of size n over wider blocks: SMALL_BLOCKS, or a quarter of the size or more.

    Sets that differ in 2/3 of n features, far from any link, then still differ in more blocks than linked
    ones may in features (0.222 n at a similarity of 0.8), so pairs of long texts can be ruled out by it.
    """
    width = max(SMALL_BLOCKS, 1 << max(0, int(n).bit_length() - 2))
    return np.bitwise_xor.reduce(np.frombuffer(own, np.uint8).reshape(width, -1), axis=1).tobytes() if len(own) > width else own


def _folded(sketches: list[bytes], width: int) -> np.ndarray:
    out = np.empty((len(sketches), width), np.uint8)
    for i, s in enumerate(sketches):
        a = np.frombuffer(s, np.uint8)
        out[i] = np.bitwise_xor.reduce(a.reshape(width, -1), axis=1) if len(a) > width else a
    return out


def _links(na, nb, differ, percent) -> np.ndarray:
    """Whether sets of these sizes that differ in this many features (or more) may be linked."""
    return (100 + percent) * differ <= (100 - percent) * (na + nb)


def _prepare(width: int, percent: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("sigs", pa.list_(pa.int64())), ("sketch", pa.binary()), ("small", pa.binary())])

    def run(batches):
        hashes, bands, seen = WordHashes(), Bands(percent), {}
        for batch in batches:
            ids, rows = batch.column(0), []
            named = ids.is_valid().to_pylist()
            for at, text in enumerate(texts(batch.column(1))):
                h = shingles(text, width, hashes)
                fp = xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None
                first = named[at] and fp is not None and fp not in seen
                if first:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen[fp] = True
                own = sketch(h) if first else None
                rows.append((len(h), fp, signatures(h, bands).view(np.int64) if first else None, own, folded(own, len(h)) if first else None))
                if len(rows) == 512 or at + 1 == len(ids):
                    n, f, s, k, m = zip(*rows)
                    yield pa.RecordBatch.from_arrays([ids.slice(at + 1 - len(rows), len(rows)), pa.array(n, pa.int64()), pa.array(f, pa.binary()), pa.array(s, pa.list_(pa.int64())), pa.array(k, pa.binary()), pa.array(m, pa.binary())], schema=schema)
                    rows = []

    return run, "doc_id long, n long, fp binary, sigs array<long>, sketch binary, small binary"


def _sets(width: int):
    schema = pa.schema([("doc", pa.int64()), ("h", pa.binary())])

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, out = batch.column(0), []
            for at, text in enumerate(texts(batch.column(1))):
                out.append(shingles(text, width, hashes).tobytes())
                if len(out) == 512 or at + 1 == len(ids):
                    yield pa.RecordBatch.from_arrays([ids.slice(at + 1 - len(out), len(out)), pa.array(out, pa.binary())], schema=schema)
                    out = []

    return run, "doc long, h binary"


def _verify(percent: int):
    """Rows (a, kind, b, h), each centre's own row (kind 0) before those it is compared with."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(x, y):
        spot = np.searchsorted(x, y)
        spot[spot == len(x)] = 0
        common = int((x[spot] == y).sum())
        return 100 * common >= percent * (len(x) + len(y) - common)

    def run(batches):
        centre, own = None, []
        for batch in batches:
            found, sets = [], batch.column("h")
            for row, (a, b, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "kind")))):
                h = np.frombuffer(sets[row].as_buffer(), np.uint64)
                if kind == 0:
                    own = [*own, h.copy()] if a == centre else [h.copy()]
                    centre = a
                elif a == centre and any(linked(x, h) for x in own):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], schema=schema)

    return run, "a long, b long"


def _pruned(percent: int):
    """Rows (a, b, na, nb, sa, sb): keeps pairs whose sketches allow a link; few sketches are unpacked at a time."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(start, SLICE_ROWS)
                na, nb = (some.column(c).to_numpy() for c in ("na", "nb"))
                sa, sb = some.column("sa").to_pylist(), some.column("sb").to_pylist()
                differ = np.zeros(len(na), np.int64)
                width = np.array([min(len(x), len(y)) for x, y in zip(sa, sb)], np.int64)
                for w in np.unique(width):
                    at = np.flatnonzero(width == w)
                    differ[at] = (_folded([sa[i] for i in at], w) != _folded([sb[i] for i in at], w)).sum(1)
                keep = _links(na, nb, np.maximum(differ, np.abs(na - nb)), percent)
                yield pa.RecordBatch.from_arrays([some.column("a"), some.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run, "a long, b long"


def _unsettled(percent: int):
    """Rows (sig, i, j, block, doc, n, label, sketch) sorted by (sig, i, j): pairs that may be linked, of different labels.

    The members of one (sig, i, j) are blocks i and j of a signature, BLOCK_ROWS rows each about; where the
    blocks differ only pairs across them are looked at, as the others have a group of their own.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(rows, one_block):
        doc, n, label, block = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        order = np.lexsort((doc, n))
        doc, n, label, block = doc[order], n[order], label[order], block[order]
        held = [rows[i][4] for i in order]
        flat = _folded(held, min(len(s) for s in held))
        out_a, out_b = [], []
        for i in range(len(doc) - 1):
            end = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
            other = label[i + 1 : end] != label[i]
            if not one_block:
                other &= block[i + 1 : end] != block[i]
            at = i + 1 + np.flatnonzero(other)
            if len(at):
                at = at[_links(n[i], n[at], (flat[at] != flat[i]).sum(1), percent)]
                out_a.append(np.minimum(doc[i], doc[at]))
                out_b.append(np.maximum(doc[i], doc[at]))
        return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.empty(0, np.int64),) * 2

    def run(batches):
        now, rows, seen = None, [], set()

        def ended():
            a, b = pairs(rows, now[1] == now[2]) if len(rows) > 1 else (np.empty(0, np.int64),) * 2
            fresh = [p for p in zip(a.tolist(), b.tolist()) if p not in seen]
            if len(seen) > 300_000:
                seen.clear()
            seen.update(fresh[:300_000])
            for at in range(0, len(fresh), 10_000):
                part = fresh[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64())], schema=schema)

        for batch in batches:
            for start in range(0, batch.num_rows, 4 * SLICE_ROWS):
                some = batch.slice(start, 4 * SLICE_ROWS)
                keys, columns = ([some.column(c).to_pylist() for c in names] for names in (("sig", "i", "j"), ("doc", "n", "label", "block", "sketch")))
                for key, row in zip(zip(*keys), zip(*columns)):
                    if key != now:
                        if now:
                            yield from ended()
                        now, rows = key, []
                    rows.append(row)
        if now:
            yield from ended()

    return run, "a long, b long"


class JaccardJoin:
    """Links and classes of documents whose shingle sets have a Jaccard similarity of at least percent / 100.

    docs needs the columns doc_id and text; others are ignored, whatever their names. A null, empty or blank
    text has an empty set and no links. Repeated rows are copies of each other; texts that share a doc_id are
    one document with the links of either. A row whose doc_id is null appears in classes() too, and can only
    be linked as an exact copy. An empty table gives an empty table.
    """

    def __init__(self, docs: DataFrame, width: int = 4, percent: int = 85):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.width, self.percent = width, percent
        self.staged: list[DataFrame] = []
        run, schema = _prepare(width, percent)
        self.prepared = self._stage(self.docs.mapInArrow(run, schema), "sets")
        self.copies = self._stage(self.prepared.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "copies")

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        self.staged.append(stage(df, name))
        return self.staged[-1]

    def close(self) -> None:
        """Deletes the staged tables; frames made by this join cannot be read any more."""
        drop_staged(*self.staged)
        self.staged.clear()

    def _shared(self) -> DataFrame:
        """(sig, doc) of signatures with two documents or more.

        Hot signatures are known to be shared from the documents that show them to be hot, so their rows need
        not meet in one task.
        """
        rows = self.prepared.where("sigs is not null and doc_id is not null").select(F.col("doc_id").alias("doc"), F.explode("sigs").alias("sig"))
        some = rows.where(F.pmod(F.xxhash64("doc", F.lit(11)), F.lit(HOT_SHARE)) == 0).groupBy("sig").agg(F.count("*").alias("c"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
        hot = some.where(f"c >= {HOT_ROWS} and lo <> hi").orderBy(F.desc("c"), "sig").limit(HOT_SIGNATURES).select("sig", F.lit(True).alias("hot"))
        dealt = rows.join(F.broadcast(hot), "sig", "left").selectExpr("sig", "doc", f"if(hot, pmod(xxhash64(doc), {HOT_PARTS}) + 1, 0) part")
        ends = dealt.selectExpr("sig", "doc", "part", "min(doc) over (partition by sig, part) lo", "max(doc) over (partition by sig, part) hi")
        return ends.where("part > 0 or lo <> hi").select("sig", "doc")

    def _buckets(self) -> DataFrame:
        """(sig, doc) of signatures with two texts or more, one signature for each set of members."""
        members = self._shared()
        rep = self.prepared.where("sigs is not null").select("doc_id", "fp").join(self.copies, "fp").select(F.col("doc_id").alias("doc"), "rep").distinct()
        members = members.join(rep, "doc").select("sig", F.col("rep").alias("doc")).distinct()
        members = stage(members, "members")  # dropped below
        same = members.groupBy("sig").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.sum(F.xxhash64("doc", F.lit(7)).cast("decimal(38,0)")).alias("y")).where("c > 1")
        buckets = self._stage(members.join(same.groupBy("c", "x", "y").agg(F.min("sig").alias("sig")), "sig").select("sig", "doc"), "buckets")
        drop_staged(members)
        return buckets

    def _reps(self) -> DataFrame:
        """Size and sketches of each class of exact copies, from any row that has them: the first one of a task need not be rep."""
        one = self.prepared.where("sigs is not null").select("fp", "n", "sketch", "small").join(self.copies, "fp")
        return one.select(F.col("rep").alias("doc"), "n", "sketch", "small").distinct()

    def _possible(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that may be linked by their sizes and whole sketches."""
        run, schema = _pruned(self.percent)
        both = pairs.join(reps.selectExpr("doc a", "n na", "sketch sa"), "a").join(reps.selectExpr("doc b", "n nb", "sketch sb"), "b")
        return both.mapInArrow(run, schema).distinct()

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the staged pairs (a, b) that are linked, on the whole sets."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        ids = stage(ids, "needed")
        small = ids.count() <= BROADCAST_ROWS
        docs = self.docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
        run, schema = _sets(self.width)
        sets = stage(docs.mapInArrow(run, schema).distinct(), "needed-sets")
        salt = F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt")
        counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).alias("parts"))
        members = pairs.join(counts, "a").select("a", salt, "b").join(sets.withColumnRenamed("doc", "b"), "b").select("a", "salt", F.lit(1).alias("kind"), "b", "h")
        centres = counts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt")).join(sets.withColumnRenamed("doc", "a"), "a").select("a", "salt", F.lit(0).alias("kind"), F.col("a").alias("b"), "h")
        run, schema = _verify(self.percent)
        out = self._stage(members.unionByName(centres).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind", "b").select("a", "kind", "b", "h").mapInArrow(run, schema), "links")
        drop_staged(ids, sets)
        return out

    def links(self, connected: bool = False) -> DataFrame:
        """Links (a, b) between representatives. connected: leave out links inside what others already connect."""
        buckets, reps = self._buckets(), self._stage(self._reps(), "reps")
        low = buckets.groupBy("sig").agg(F.min("doc").alias("a"))
        stars = buckets.join(low, "sig").select("a", F.col("doc").alias("b")).where("a <> b").distinct()
        found = self._verified(self._stage(self._possible(stars, reps), "stars"))
        rest = buckets.withColumn("label", F.col("doc"))
        if connected:
            label = connected_components(found)
            rest = buckets.join(label.selectExpr("node doc", "component"), "doc", "left").select("sig", "doc", F.coalesce("component", "doc").alias("label"))
            rest = self._stage(rest, "labelled")
        open_ = rest.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count("*") / BLOCK_ROWS).alias("parts")).where("lo <> hi").select("sig", "parts")
        rest = rest.join(open_, "sig").withColumn("block", F.expr("pmod(xxhash64(doc), parts)")).join(reps.select("doc", "n", F.col("small").alias("sketch")), "doc")
        met = F.explode(F.expr("transform(sequence(0L, parts - 1), p -> struct(least(p, block) as i, greatest(p, block) as j))")).alias("met")
        run, schema = _unsettled(self.percent)
        dealt = rest.select("sig", met, "block", "doc", "n", "label", "sketch").select("sig", "met.i", "met.j", "block", "doc", "n", "label", "sketch")
        more = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "doc").mapInArrow(run, schema).distinct()
        more = more.join(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        more = self._stage(self._possible(more, reps), "unsettled")
        return found.unionByName(self._verified(more)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def classes(self) -> DataFrame:
        """Per row of docs: doc_id, n_shingles, rep (its smallest exact copy), component_id (smallest linked document)."""
        label = connected_components(self.links(connected=True))
        near = self.copies.join(label.selectExpr("node rep", "component"), "rep", "left")
        return self.prepared.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(near, "fp", "left").select(
            "doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("component", "rep", "doc_id").alias("component_id")
        )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, without near copies: of each class the smallest doc_id stays.

    Of rows with equal doc_id the one with the smallest text stays; rows without doc_id stay one for each text
    that no row with a doc_id has. Empty texts have no links, so all stay.
    """
    join = JaccardJoin(docs, width, percent)
    gone = stage(join.classes().where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct(), "copies-gone")
    join.close()
    left = docs.where("doc_id is not null").join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc_id", "left_anti").select(*docs.columns)
    again = stage(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "repeated")
    if not again.take(1):
        return left
    place, other = free_name(docs, "place"), free_name(docs, "text_of")
    repeated = left.join(again, "doc_id", "left_semi").select(*docs.columns)
    first = repeated.withColumn(place, F.expr("row_number() over (partition by doc_id order by text)")).where(F.col(place) == 1).drop(place)
    unnamed = docs.where("doc_id is null")
    known = docs.where("doc_id is not null").select(F.col("text").alias(other)).distinct()
    unnamed = unnamed.join(known, F.col("text").eqNullSafe(F.col(other)), "left_anti").withColumn(place, F.expr("row_number() over (partition by text order by doc_id)")).where(F.col(place) == 1).drop(place)
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(first).unionByName(unnamed)
