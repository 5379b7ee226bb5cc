import gzip
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tokenloom.llm import quality_rules, spot_signatures, warc
from tokenloom.llm.chat_format import format_conversations, formatted_and_read, round_trip

CHAT = "conv_id long, turn long, role string, text string, formatted string"


def told(rows):
    """(conv_id, n_turns, turns digest, loss characters, loss digest) of conversations."""
    out = []
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def test_any_text_survives_the_round_trip(spark):
    r = random.Random(8)
    parts = ["[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ASST]", "</s>", "[ROLE:41]", "[/ROLE]", "[\\INST]", "[\\\\/INST]", "<\\/s>", "[", "]", "<", "/", "\\", "$1", " ", "\n", "é", "日", "😀", "ROLE:", "INST]", ""]
    roles = ["user", "assistant", "system", "tool", "[/ROLE]", "", None, "rôle"]
    rows = [(c, t, r.choice(roles), "".join(r.choice(parts) for _ in range(r.randint(0, 9))), "x") for c in range(60) for t in range(r.randint(1, 6))]
    rows += [(100, 0, "user", None, "x"), (100, 0, "user", None, "x"), (100, None, "assistant", "null turn", "x"), (None, 1, "user", "no id", "x"), (101, 1, "assistant", "long " * 50_000 + "</s>", "x")]
    got = round_trip(format_conversations(spark.createDataFrame(rows, CHAT))).collect()
    assert sorted(((g["conv_id"], g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) for g in got), key=str) == told(rows)
    assert {g["escape_rounds"] for g in got} == {0, 1}


def test_plain_conversations_are_not_escaped(spark):
    rows = [(1, 0, "user", "hello [x] <y>", "x"), (1, 1, "assistant", "a\\b", "x")]
    out = format_conversations(spark.createDataFrame(rows, CHAT)).first()
    assert out["formatted"] == "[INST]hello [x] <y>[/INST][ASST]a\\b</s>" and out["escape_rounds"] == 0
    spans = [(s["start"], s["chars"]) for s in out["loss_spans"]]
    assert [out["formatted"][a : a + n] for a, n in spans] == ["a\\b"]


def test_conflicting_conversation_and_empty_table(spark):
    got = formatted_and_read(spark.createDataFrame([], CHAT)).collect()
    assert len(got) == 1 and got[0]["conv_id"] == -1 and got[0]["loss_chars"] == 21 and got[0]["escape_rounds"] == 1


PAGES = "page_id long, url string, html string, digest string, kind int"


def test_archives(spark, tmp_path):
    long, other = "é" * 80, "z" * 200
    rows = [(i, f"http://x/{i}", long if i % 3 else f"own {i}" * 30, "c", 1) for i in range(40)]
    rows += [(50, None, None, "c", 1), (51, "bad url\r\nX: y é", other, "c", 1), (52, "u", "tiny", "c", 1), (53, "u", "tiny", "c", 1), (60, "b", other, "c", 1), (60, "a", other, "c", 1), (None, "n", long, "c", 1)]
    folder = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(rows, PAGES), folder, file_bytes=2_000)
    got = warc.read_archives(spark, folder).collect()
    first = {}
    for page, _, html, _, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(html, page)
    want, seen = [], Counter()
    for page, _, html, _, _ in rows:
        raw = (html or "").encode()
        again = page is not None and len(raw) >= 100 and (page != first[html] or seen[page, html] > 0)
        seen[page, html] += 1
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    assert sorted(((g["page_id"], g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"]) for g in got), key=str) == sorted(want, key=str)
    paths = sorted((tmp_path / "w/files").iterdir())
    assert len(paths) > 3 and all(p.name.endswith(".warc.gz") for p in paths)
    assert all(gzip.decompress(p.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: ") for p in paths)
    again = f"file://{tmp_path}/v"
    warc.write_archives(spark.createDataFrame(rows, PAGES), again, file_bytes=2_000)
    assert [p.read_bytes() for p in paths] == [p.read_bytes() for p in sorted((tmp_path / "v/files").iterdir())]
    manifest = spark.read.parquet(f"{folder}/manifest").collect()
    assert {m["file"]: m["sha256"] for m in manifest} == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in paths}
    assert warc.archives(spark.createDataFrame([], PAGES)).count() == 0


def test_archives_depend_on_the_pages_alone(spark, tmp_path):
    """More rows than a range sampler looks at, in other partitions and another order: the same files, byte for byte."""
    pages = spark.range(30_000).selectExpr("cast(id * 7919 % 40000 as long) as page_id", "concat('http://x/', id) as url", "repeat(concat('page ', id % 20000, ' '), 12) as html")
    files = []
    for name, rows, advisory in (("a", pages.repartition(3), "64m"), ("b", pages.orderBy(F.desc("url")).repartition(11), "100k")):
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
        warc.write_archives(rows, f"file://{tmp_path}/{name}", file_bytes=60_000, range_bytes=400_000)
        files.append({p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / name / "files").iterdir()})
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert files[0] == files[1] and len({f.split("-")[1] for f in files[0]}) > 5
    got = warc.read_archives(spark, f"file://{tmp_path}/b")
    assert got.count() == 30_000 and got.where("record_type = 'revisit'").count() == 9_900  # payloads of some hundred pages are too short


def test_damage_is_noticed():
    raw = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parse_record(raw)["page_id"] == 1
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"payload\r\n", b"pAyload\r\n"))


def slow_counts(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_counts_match_a_slow_version():
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice(["a ", "b ", "c ", "é", "#", "|", "\n", "\t", "\x0b", " ", "\x1c", "a b c "]) for _ in range(r.randint(0, 60)))
        n = quality_rules.counts_of(text)
        assert (n[0], n[1], n[2], n[4], n[5]) == slow_counts(text)
    assert quality_rules.counts_of(None) == (0,) * 7


def test_rules_follow_each_group(spark):
    plain = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    marked = lambda i: " ".join(f"w{i}x{j}#####" for j in range(60))
    rows = [(i, plain(i), "en", "a", 1) for i in range(300)] + [(1000 + i, marked(i), "en", "b", 1) for i in range(300)]
    rows += [(2000, marked(7), "en", "a", 1), (2001, None, None, None, 1), (2002, "a " * 60, "en", "a", 1), (2003, marked(8), "fr", "new", 1), (2000, marked(7), "en", "a", 1)]
    got = quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")).collect()
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert len(got) == len(rows) and all(kept[i] for i in range(300)) and all(kept[1000 + i] for i in range(300))
    assert [kept[i] for i in (2000, 2001, 2002)] == [False] * 3
    assert {r["doc_id"] for r in got if r["base_failed"]} == {2001, 2002}
    assert quality_rules.apply_rules(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


DOCS = "doc_id long, text string, part int, last string"


def test_next_documents(spark):
    r = random.Random(6)
    words = ["the", "of", "is", "la", "und", *(f"w{i}" for i in range(50)), "日本", "x!"]
    rows = [(i * 7 - 100, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 9, 60]))), 0, "z") for i in range(80)]
    rows += [(10_000, None, 0, "z"), (10_000, "the same id here", 0, "z"), (None, "of no id", 0, "z")]
    got = spot_signatures.compare_with_next(spark.createDataFrame(rows, DOCS)).collect()
    cache = spot_signatures._Words()
    order = sorted(((d, t or "") for d, t, _, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = []
    for (d, t), (_, f) in zip(order, order[1:] + order[:1]):
        n = len(t) // 2
        edited = t[: len(t) - n] + f[:n]
        a, b, c = (spot_signatures.signature_set(x, cache) for x in (t, edited, f))
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), spot_signatures.to_text(a), spot_signatures.to_text(b), spot_signatures.likeness(a, b), spot_signatures.likeness(a, c)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    one = spot_signatures.compare_with_next(spark.createDataFrame(rows[:1], DOCS)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert spot_signatures.compare_with_next(spark.createDataFrame([], DOCS)).count() == 0


def test_near_fingerprints_match_brute_force(spark):
    r = random.Random(2)
    base = [" ".join(r.choice(["the", "is", *(f"w{i}" for i in range(300))]) for _ in range(200)) for _ in range(8)]
    rows = []
    for d in range(60):
        words = r.choice(base).split()
        for _ in range(r.choice([0, 1, 3, 10])):
            words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
        rows.append((d, " ".join(words), 0, "z"))
    cache = spot_signatures._Words()
    sets, reps = {d: spot_signatures.signature_set(t, cache) for d, t, _, _ in rows}, {}
    for d, s in sets.items():
        reps.setdefault(s.tobytes(), d)
    want = {(a, b) for a in reps.values() for b in reps.values() if a < b and spot_signatures.likeness(sets[a], sets[b]) >= 0.8}
    got = spot_signatures.near_pairs(spark.createDataFrame(rows, DOCS)).collect()
    assert {(g["a"], g["b"]) for g in got} == want and len(got) == len(want)


def test_texts_without_anchors_have_signatures():
    cache = spot_signatures._Words()
    assert len(spot_signatures.signature_set("xx yy zz", cache)) and not len(spot_signatures.signature_set("", cache)) and not len(spot_signatures.signature_set("12 !!", cache))
    a = spot_signatures.signature_set("the cat sat", cache)
    assert spot_signatures.from_text(spot_signatures.to_text(a)).tolist() == a.tolist()
