"""Repair of the turn structure of conversations by a scan of min-plus matrices.

A repaired conversation has role initials (s?(ua)+)?. Its four states are: nothing yet (0), behind a system turn
(1), behind a user turn (2), behind an assistant turn (3); 0 and 3 may end it. Each turn is a 4 x 4 matrix of
its edits from state to state, an element being the least (cost, audit), and turns may be inserted in front of it
(the closure of insertion is multiplied in). The product of matrices, taking the least over the middle state
of the sums of costs and the joined audits, is associative: turns of equal cost never differ by one audit being the
beginning of another, so joining on either side keeps their order. So turns are reduced in a tree: within a
chunk of turns, and the chunks of a long conversation in rounds of FAN, each round in many tasks.

Rows are sorted by ranges of (conv_id, turn), so a conversation of any length is spread over tasks. A task
repairs a conversation that it holds whole; the first and last one of a task, and those of more than CHUNK
turns, are written as chunks and joined afterwards. Turns repeated in another chunk are found by a shuffle of
one digest for each different turn of a chunk.

Internal letters of audits name the role as well, which keeps their order: D delete, I and J insert a user or
assistant turn, K keep, R and S change the role to user or assistant.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tokenloom.llm.common import stage

#: Costs of edits. A truncated turn that is not deleted costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Turns of a chunk, and characters after which one ends.
CHUNK, CHUNK_CHARS = 2048, 1 << 20
#: Chunks that are joined in one group of a round.
FAN = 16
_SPACE = " \t\n\x0b\x0c\r"

Element = tuple[int, str] | None
Matrix = tuple[tuple[Element, ...], ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    """The least (cost, audit) from state to state through a, then b."""
    out = []
    for row in a:
        new: list[Element] = [None] * 4
        for left, through in zip(row, b):
            if left is not None:
                cost, audit = left
                for j, right in enumerate(through):
                    if right is not None:
                        sum_, best = cost + right[0], new[j]
                        if best is None or sum_ < best[0] or (sum_ == best[0] and audit + right[1] < best[1]):
                            new[j] = (sum_, audit + right[1])
        out.append(tuple(new))
    return tuple(out)


def _matrix(edits: dict[tuple[int, int], Element]) -> Matrix:
    return tuple(tuple(edits.get((i, j)) for j in range(4)) for i in range(4))


#: No turn at all: each state stays. And any number of insertions: a user turn from 0, 1, 3, an assistant turn from 2.
UNIT = _matrix({(i, i): (0, "") for i in range(4)})
CLOSURE = _matrix(
    {(i, i): (0, "") for i in range(4)}
    | {(i, 2): (INSERT, "I") for i in (0, 1, 3)} | {(2, 3): (INSERT, "J")} | {(i, 3): (2 * INSERT, "IJ") for i in (0, 1)}
)


def turn_matrix(initial: str, forced: bool, truncated: bool) -> Matrix:
    """Insertions, then the edits of one turn: its role's initial, whether it must be deleted, whether it is truncated."""
    edits: dict[tuple[int, int], Element] = {(i, i): (DELETE, "D") for i in range(4)}
    if not forced:
        more = TRUNCATED if truncated else 0
        edits |= {(i, 2): (more, "K") if initial == "u" else (REROLE + more, "R") for i in (0, 1, 3)}
        edits[2, 3] = (more, "K") if initial == "a" else (REROLE + more, "S")
        if initial == "s":
            edits[0, 1] = (more, "K")
    return product(CLOSURE, _matrix(edits))


_TURNS = {(i, forced, cut): turn_matrix(i, forced, cut) for i in ("s", "u", "a", "") for forced in (False, True) for cut in (False, True)}


def reduced(matrices: list[Matrix]) -> Matrix:
    """Their product, as a tree."""
    while len(matrices) > 1:
        matrices = [product(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0] if matrices else UNIT


def cheapest(matrix: Matrix) -> tuple[int, str]:
    """The cost and audit of a whole conversation's matrix."""
    first = product(matrix, CLOSURE)[0]
    return min(first[j] for j in (0, 3) if first[j] is not None)


@dataclass(frozen=True)
class Segment:
    """What is known of neighbouring turns of a conversation; join() is associative and Segment() its unit."""

    rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    least: int | None = None
    most: int | None = None
    turns: int = 0
    matrix: Matrix = UNIT

    @classmethod
    def of(cls, turns: list[int | None], roles: list[str], texts: list[str], repeated: list[bool]) -> Segment:
        """Turns in order; repeated says which of them were there before."""
        counts, matrices = [0, 0, 0], []
        for role, text, again in zip(roles, texts, repeated):
            bare = text.strip(_SPACE)
            cut = bare[-1:] not in (".", "!", "?")
            if not bare:
                counts[0] += 1
            elif again:
                counts[1] += 1
            elif cut:
                counts[2] += 1
            initial = role[:1]
            matrices.append(_TURNS[initial if initial in ("s", "u", "a") else "", not bare or again, cut])
        initials, known = [r[:1] for r in roles], sorted({t for t in turns if t is not None})
        ends = (initials[0], initials[-1]) if initials else (None, None)
        spans = (known[0], known[-1], len(known)) if known else (None, None, 0)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        return cls(len(roles), *counts, illegal, *ends, *spans, reduced(matrices))

    def join(self, other: Segment) -> Segment:
        if not self.rows or not other.rows:
            return self if self.rows else other
        add = {f: getattr(self, f) + getattr(other, f) for f in ("rows", "blank", "duplicate", "truncated", "illegal", "turns")}
        add["illegal"] += self.last + other.first not in ("su", "ua", "au")
        add["turns"] -= self.most is not None and self.most == other.least
        least = [t for t in (self.least, other.least) if t is not None]
        most = [t for t in (self.most, other.most) if t is not None]
        return replace(self, **add, last=other.last, least=min(least, default=None), most=max(most, default=None), matrix=product(self.matrix, other.matrix))

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


def repaired_lines(roles: list[str], texts: list[str], audit: str) -> list[str]:
    """role:text of the repaired turns, from the turns and the internal letters of their audit."""
    out, at = [], 0
    for letter in audit:
        if letter in "IJ":
            out.append("user:" if letter == "I" else "assistant:")
            continue
        if letter != "D":
            role = roles[at] if letter == "K" else "user" if letter == "R" else "assistant"
            out.append(f"{role}:{texts[at]}")
        at += 1
    return out


def audit_slices(audit: str, sizes: list[int]) -> list[str]:
    """The audit cut into one part for each chunk: its turns' letters and the insertions before them; the last has what is left."""
    out, begin, at = [], 0, 0
    for size in sizes[:-1]:
        left = size
        while left:
            left -= audit[at] not in "IJ"
            at += 1
        out.append(audit[begin:at])
        begin = at
    return [*out, audit[begin:]] if sizes else []


_RESULT = [pa.field(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())]
_STRINGS = pa.list_(pa.string())
_HELD = [pa.field("turns", pa.list_(pa.int64())), pa.field("roles", _STRINGS), pa.field("texts", _STRINGS), pa.field("digests", pa.list_(pa.binary()))]
_KEY = [pa.field("conv_id", pa.int64()), pa.field("part", pa.int64()), pa.field("seq", pa.int64())]
_PIECES = pa.schema([*_KEY, pa.field("whole", pa.bool_()), *_RESULT, *_HELD])
_NODES = pa.schema([*_KEY] + [pa.field(c, pa.int64()) for c in ("rows", "blank", "duplicate", "truncated", "illegal")] + [pa.field("first", pa.string()), pa.field("last", pa.string())]
                   + [pa.field(c, pa.int64()) for c in ("least", "most", "turns")] + [pa.field("costs", pa.list_(pa.int64())), pa.field("audits", _STRINGS)])
_FACTS = [f for f in _NODES.names if f not in ("conv_id", "part", "seq", "costs", "audits")]


def _result(found: Segment, sha256: str | None) -> dict:
    cost, audit = cheapest(found.matrix)
    own = {"gaps": found.gaps(), "cost": cost, "audit": audit, "repaired_sha256": sha256}
    return own | {c: getattr(found, c) for c in ("blank", "duplicate", "truncated", "illegal")}


def _pieces(most: int):
    """Sorted turns -> a finished row for each conversation that lies whole in this task, chunks of at most `most` turns of the others."""

    def run(batches):
        part, seq, n_convs = TaskContext.get().partitionId(), 0, 0
        conv, long, chars = None, False, 0
        held: tuple[list, list, list, list] = ([], [], [], [])
        rows: list[dict] = []

        def chunk():
            nonlocal seq, chars
            rows.append({"conv_id": conv, "part": part, "seq": seq, "whole": False, **dict(zip(("turns", "roles", "texts", "digests"), map(list, held)))})
            seq, chars = seq + 1, 0
            for column in held:
                column.clear()

        def finished(last: bool):
            if not held[0]:
                return
            if long or last or n_convs == 1:
                return chunk()
            seen, repeated = set(), []
            for digest in held[3]:
                repeated.append(digest in seen)
                seen.add(digest)
            found = Segment.of(*held[:3], repeated)
            own = _result(found, None)
            own["repaired_sha256"] = hashlib.sha256("\n".join(repaired_lines(held[1], held[2], own["audit"])).encode()).hexdigest()
            rows.append({"conv_id": conv, "part": part, "whole": True, **own})
            for column in held:
                column.clear()

        def written(least: int):
            nonlocal rows
            if rows and (len(rows) >= least or not rows[-1]["whole"]):
                out, rows = pa.RecordBatch.from_pylist(rows, schema=_PIECES), []
                yield out

        for batch in batches:
            for row in batch.to_pylist():
                if not n_convs or row["conv_id"] != conv:
                    finished(False)
                    conv, long, chars, n_convs = row["conv_id"], False, 0, n_convs + 1
                    yield from written(512)
                for column, name in zip(held, ("turn", "role", "text", "digest")):
                    column.append(row[name])
                chars += len(row["text"])
                if len(held[0]) >= most or chars >= CHUNK_CHARS:
                    long = True
                    chunk()
                    yield from written(1)
        finished(True)
        yield from written(1)

    return run


def _node(key: dict, found: Segment) -> dict:
    flat = [e for row in found.matrix for e in row]
    return key | {f: getattr(found, f) for f in _FACTS} | {"costs": [None if e is None else e[0] for e in flat], "audits": [None if e is None else e[1] for e in flat]}


def _segment(node: dict) -> Segment:
    flat = [None if c is None else (c, a) for c, a in zip(node["costs"], node["audits"])]
    return Segment(**{f: node[f] for f in _FACTS}, matrix=tuple(tuple(flat[4 * i : 4 * i + 4]) for i in range(4)))


def _leaves(batches):
    """Chunks with `again`, the places of turns that were there before, -> their segments."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            repeated = [False] * len(row["turns"])
            for at in row["again"] or ():
                repeated[at] = True
            found = Segment.of(row["turns"], row["roles"], row["texts"], repeated)
            yield pa.RecordBatch.from_pylist([_node({k: row[k] for k in ("conv_id", "part", "seq")}, found)], schema=_NODES)


def _joined(group: pa.Table) -> pa.Table:
    """The segments of a group, at most FAN, as one that stands at the group's first place."""
    nodes = sorted(group.select(_NODES.names).to_pylist(), key=lambda n: (n["part"], n["seq"]))
    found = reduce(Segment.join, map(_segment, nodes))
    return pa.Table.from_pylist([_node({k: nodes[0][k] for k in ("conv_id", "part", "seq")}, found)], schema=_NODES)


def _sliced(batches):
    """Whole conversations with the sizes of their chunks -> results, and the part of the audit that is each chunk's."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            own = _result(_segment(row), None)
            chunks = sorted((c["part"], c["seq"], c["n"]) for c in row["chunks"])
            for at, ((part, seq, _), slice_) in enumerate(zip(chunks, audit_slices(own["audit"], [n for _, _, n in chunks]))):
                facts = own if not at else {}
                yield pa.RecordBatch.from_pylist([{"conv_id": row["conv_id"], "part": part, "seq": seq, **facts, "slice": slice_}], schema=_SLICES)


_SLICES = pa.schema([*_KEY, *_RESULT[:-1], pa.field("slice", pa.string())])
_LINES = pa.schema([*_KEY, *_RESULT[:-1], pa.field("n", pa.int64()), pa.field("lines", pa.binary())])


def _lines(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            lines = repaired_lines(row["roles"], row["texts"], row["slice"])
            yield pa.RecordBatch.from_pylist([{k: row[k] for k in _LINES.names if k in row} | {"n": len(lines), "lines": "\n".join(lines).encode()}], schema=_LINES)


def _hashed(batches):
    """Chunks of lines in order -> one row for each conversation, its digest taken chunk by chunk."""
    conv, own, digest, any_ = None, None, None, False
    schema = pa.schema([_KEY[0], *_RESULT])

    def done():
        return pa.RecordBatch.from_pylist([own | {"conv_id": conv, "repaired_sha256": digest.hexdigest()}], schema=schema)

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if own is None or row["conv_id"] != conv:
                if own is not None:
                    yield done()
                conv, own, digest, any_ = row["conv_id"], {f.name: row[f.name] for f in _RESULT[:-1]}, hashlib.sha256(), False
            if row["n"]:
                digest.update(b"\n" * any_ + row["lines"])
                any_ = True
    if own is not None:
        yield done()


def _kind(schema: pa.Schema):
    return from_arrow_schema(schema)


def _long_conversations(chunks: DataFrame, fan: int) -> DataFrame:
    """The results of the conversations that lie in chunks."""
    # a turn repeated in its own chunk is known there; one row for each different turn of a chunk is compared with the others
    turns = chunks.select("conv_id", "part", "seq", F.posexplode("digests").alias("at", "digest"))
    own = turns.groupBy("conv_id", "part", "seq", "digest").agg(F.min("at").alias("first"), F.collect_list("at").alias("all"))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy("part", "seq")) > 1
    again = own.withColumn("earlier", earlier).select("part", "seq", F.explode(F.when(F.col("earlier"), F.col("all")).otherwise(F.array_remove("all", F.col("first")))).alias("at"))
    again = again.groupBy("part", "seq").agg(F.collect_list("at").alias("again"))
    nodes = stage(chunks.join(again, ["part", "seq"], "left").mapInArrow(_leaves, _kind(_NODES)), "segments")
    tall = nodes.agg(F.max("part"), F.max("seq")).first()
    sizes = nodes.groupBy("conv_id").agg(F.collect_list(F.struct("part", "seq", F.col("rows").alias("n"))).alias("chunks"))
    for column, others, most in (("seq", ["part"], tall[1] or 0), ("part", [], tall[0] or 0)):
        width = 1
        while width <= most:
            width *= fan
            nodes = stage(nodes.groupBy("conv_id", *others, F.expr(f"{column} div {width}").alias("__group")).applyInArrow(_joined, _kind(_NODES)), "segments")
    slices = nodes.alias("n").join(sizes.alias("s"), F.expr("n.conv_id <=> s.conv_id")).select("n.*", "chunks").mapInArrow(_sliced, _kind(_SLICES))
    lines = chunks.select("part", "seq", "roles", "texts").join(slices, ["part", "seq"]).mapInArrow(_lines, _kind(_LINES))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_hashed, _kind(pa.schema([_KEY[0], *_RESULT])))


def repair(conversations: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id and the faults, cheapest edits and digest of each one's repair.

    gaps, blank, duplicate, truncated and illegal count faults (a turn counts by the first of blank, duplicate,
    truncated that it has); cost and audit are the least cost of edits and their letters (D, I, K, R), the least
    in ASCII of those; repaired_sha256 is that of the repaired role:text lines.

    Turns stand in order of turn, nulls first; those of one turn in order of role and of a digest of the text;
    repeated rows are duplicates. Null and unknown roles have no place in the grammar and can only be changed or
    deleted; a null role counts as one space, and so does a null text, which is blank. A null conv_id is a
    conversation of its own; an empty table gives an empty table; other columns are ignored, whatever their
    names. One conversation's audit, one text of as many letters as turns, and its digest, which cannot be taken
    in parts, are made in one task from its chunks.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat_ws("\0", "role", "text"), 256))).withColumn("__salt", F.spark_partition_id())
    order = ["conv_id", "turn", "role", "digest", "__salt"]  # equal rows may go to several tasks
    pieces = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__salt").mapInArrow(_pieces(chunk), _kind(_PIECES)), "repair")
    results = [f.name for f in _RESULT]
    found = pieces.where("whole").select("conv_id", *results)
    rest = pieces.where("not whole").select("conv_id", "part", "seq", "turns", "roles", "texts", "digests")
    return found.unionByName(_long_conversations(rest, fan)).withColumn("audit", F.translate("audit", "JS", "IR"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with faults put in by crc32(`conv_id:turn`) % 20, a null being one space.

    0 drops the row, 1 empties its text, 2 removes `.`, `!` and `?` from it, 3 repeats it, 4 sets its role to user.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text: Column = F.when(k == 1, "").when(k == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    rows = conversations.where(k != 0).select("conv_id", "turn", F.when(k == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), F.when(k == 3, 2).otherwise(1).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """The repair of damaged(conversations), with a row for every conv_id of conversations: zeros if no turn is left."""
    conversations = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    every = conversations.select(F.col("conv_id").alias("own")).distinct()
    found = every.join(repair(damaged(conversations)), F.expr("own <=> conv_id"), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("own").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _dp_sql() -> str:
    """The least (cost, audit, lines) per state after each turn, as a fold over events: insertions twice, then the turn."""
    state = lambda i: f"v.s{i}"
    grown = lambda i, cost, letter, line: f"{{c: v.s{i}.c + {cost}, a: v.s{i}.a || '{letter}', t: {'v.s%d.t' % i if line is None else f'list_append(v.s{i}.t, {line})'}}}"
    inserted = [[state(0)], [state(1)], [state(2), *(grown(i, INSERT, "I", "'user:'") for i in (0, 1, 3))], [state(3), grown(2, INSERT, "I", "'assistant:'")]]
    stay = [grown(i, DELETE, "D", None) for i in range(4)]
    keep, cut = "CASE WHEN NOT e.forced AND e.i = '{}' THEN e.more ELSE 1000000000 END", "CASE WHEN e.forced THEN 1000000000 ELSE e.more + %d END" % REROLE
    kept = lambda i, initial: grown(i, keep.format(initial), "K", "e.role || ':' || e.text")
    changed = lambda i, role: grown(i, cut, "R", f"'{role}:' || e.text")
    edited = [[stay[0]], [stay[1], kept(0, "s")], [stay[2], *(f(i) for i in (0, 1, 3) for f in (lambda i: kept(i, "u"), lambda i: changed(i, "user")))], [stay[3], kept(2, "a"), changed(2, "assistant")]]
    vector = lambda options: "{" + ", ".join(f"s{i}: {o[0] if len(o) == 1 else 'list_min([' + ', '.join(o) + '])'}" for i, o in enumerate(options)) + "}"
    return f"CASE WHEN e.ins THEN {vector(inserted)} ELSE {vector(edited)} END"


SQL = rf"""
WITH crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, i)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hashed AS (SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT), lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS k FROM keyed, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE k <> 0),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(role || chr(0) || text), copy) AS pos, regexp_replace(text, '[ \t-\r]+', '', 'g') AS bare FROM damaged),
faults AS (SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, right(bare, 1) NOT IN ('.', '!', '?') AS cut_,
  lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS follows FROM rows_),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(NOT blank AND again) AS duplicate, count_if(NOT blank AND NOT again AND cut_) AS truncated,
  count_if(follows IS NOT NULL AND left(role, 1) || follows NOT IN ('su', 'ua', 'au')) AS illegal,
  list({{ins: false, i: left(role, 1), forced: blank OR again, more: CASE WHEN cut_ THEN 1 ELSE 0 END, role: role, text: text}} ORDER BY pos) AS turns FROM faults GROUP BY conv_id),
nothing AS (SELECT {{ins: true, i: '', forced: false, more: 0, role: '', text: ''}} AS gap, {{c: 1000000000, a: '', t: []::VARCHAR[]}} AS far),
folded AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal,
  list_reduce(list_concat(flatten(list_transform(turns, lambda x: [gap, gap, x])), [gap, gap]), lambda v, e: {_dp_sql()}, {{s0: {{c: 0, a: '', t: []::VARCHAR[]}}, s1: far, s2: far, s3: far}}) AS v FROM sums, nothing),
best AS (SELECT *, list_min([v.s0, v.s3]) AS b FROM folded)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN best ON ids.conv_id IS NOT DISTINCT FROM best.conv_id
"""
