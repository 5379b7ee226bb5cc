"""Repair of conversations against trying all edits, and against one scan of a whole conversation."""

import hashlib
import itertools
import random
import re
import zlib

from tokenloom.llm.conversation_repair import Segment, audit_slices, cheapest, damaged_and_repaired, product, repair, turn_matrix

SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_edits(rows):
    """(cost, audit, lines) of the cheapest edits by breadth: every choice for every row, with up to two insertions before each."""
    inserts = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    best = {"": (0, "", [])}  # by the initials so far, as far as they can still be completed
    found = faults(rows)

    def allowed(initials):
        return re.fullmatch(r"s?(ua)*u?", initials)

    def grown(state, extra):
        cost, audit, lines = state
        for roles in extra:
            yield roles, (cost + 2 * len(roles), audit + "I" * len(roles), [*lines, *(f"{r}:" for r in roles)])

    short = lambda s: s[:1] if s in ("", "s") else s[-1]
    for (_, role, text), fault in zip([*rows, (None, None, None)], [*found, "end"]):
        now = {}
        for initials, state in best.items():
            for roles, (cost, audit, lines) in grown(state, inserts):
                spelled = initials + "".join(r[0] for r in roles)
                options = [(spelled, cost + 3, audit + "D", lines)] if fault != "end" else [(spelled, cost, audit, lines)]
                if fault in ("", "truncated"):
                    more = fault == "truncated"
                    options.append((spelled + role[:1] if role[:1] in ("s", "u", "a") else spelled + "?", cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                    options += [(spelled + r[0], cost + 2 + more, audit + "R", [*lines, f"{r}:{text}"]) for r in ("user", "assistant")]
                for spelled_, *new in options:
                    if allowed(spelled_):
                        key = "" if not spelled_ else "s" if spelled_ == "s" else "ua" if spelled_[-1] == "a" else "u"
                        now[key] = min(now.get(key, (10**9, "", [])), tuple(new))
        best = now
    return min(best[k] for k in ("", "ua") if k in best)


def expected(rows):
    """rows: (turn, role, text) in order."""
    found = faults(rows)
    cost, audit, lines = all_edits(rows)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def ordered(rows):
    digest = lambda r: hashlib.sha256(f"{r[1]}\0{r[2]}".encode()).digest()
    return sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: ((r[0] is not None, r[0] or 0), r[1], digest(r)))


TEXTS = ["Yes.", "No?", "half", "", " \t", "Yes.", "and so on", " ", "ok!"]
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", ""]


def conversations(seed, n, most=6):
    rng = random.Random(seed)
    return [(c, t if rng.random() > 0.05 else None, rng.choice([*ROLES, None] if rng.random() < 0.2 else ROLES), rng.choice([*TEXTS, None])) for c in range(n) for t in sorted(rng.choices(range(9), k=rng.randint(1, most)))]


def by_conversation(found):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in found.collect()}


def test_product_is_associative_on_audits_too():
    rng = random.Random(4)
    kinds = [turn_matrix(i, f, t) for i in ("s", "u", "a", "") for f in (False, True) for t in (False, True)]
    for _ in range(400):
        a, b, c = rng.choices(kinds, k=3)
        assert product(product(a, b), c) == product(a, product(b, c))


def test_segments_join_alike_in_any_tree():
    rng = random.Random(5)
    for _ in range(100):
        n = rng.randint(1, 12)
        turns = sorted(rng.choices(range(9), k=n))
        roles, texts, again = rng.choices(ROLES, k=n), rng.choices(TEXTS, k=n), rng.choices([True, False], k=n)
        cut = rng.randint(0, n)
        part = lambda a, b: Segment.of(turns[a:b], roles[a:b], texts[a:b], again[a:b])  # noqa: E731, B023
        assert part(0, cut).join(part(cut, n)) == part(0, n)


def test_slices():
    assert audit_slices("IKRDIJK", [1, 0, 2, 1]) == ["IK", "", "RD", "IJK"] and audit_slices("DD", [2]) == ["DD"]


def test_against_all_edits(spark):
    rows = conversations(6, 150)
    for partitions, chunk, fan in ((1, 2048, 16), (3, 2, 2)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found = by_conversation(repair(spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, seq string"), chunk, fan))
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert len(found) == 150
        for c in found:
            own = ordered([r[1:] for r in rows if r[0] == c])
            assert found[c] == expected(own), own


def test_long_conversations_over_many_tasks(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(ROLES), rng.choice([*TEXTS, f"line {t}.", f"line {t % 50}"])) for c, n in ((1, 3000), (2, 40), (None, 700)) for t in range(n)] + [(5, 1, "user", "Hot.")] * 2000
    found = by_conversation(repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), 16, 3))
    for c in (1, 2, None, 5):
        own = ordered([r[1:] for r in rows if r[0] == c])
        marks = faults(own)
        seen, again = set(), []
        for _, role, text in own:
            again.append((role, text) in seen)
            seen.add((role, text))
        cost, audit = cheapest(Segment.of([t for t, _, _ in own], [r for _, r, _ in own], [x for _, _, x in own], again).matrix)
        assert found[c][1:4] == tuple(marks.count(m) for m in ("blank", "duplicate", "truncated")), c
        assert found[c][5:7] == (cost, audit.translate(str.maketrans("JS", "IR"))), c
    assert found[5][5:7] == (2 + 3 * 1999, "K" + "D" * 1999 + "I")


def test_query_on_odd_rows(spark):
    rows = conversations(8, 60) + [(None, None, None, None), (None, 3, "user", "Hi."), (70, None, "user", "x" * 200_000 + "."), (71, 1, "user", "A.")]
    found = by_conversation(damaged_and_repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert set(found) == {r[0] for r in rows}
    for c in found:
        own = []
        for conv, turn, role, text in rows:
            if conv == c:
                k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
                role, text = " " if role is None else role, " " if text is None else text
                text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
                own += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        assert found[c] == (expected(ordered(own)) if own else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())), c
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert damaged_and_repaired(empty).count() == 0 and repair(empty).count() == 0
