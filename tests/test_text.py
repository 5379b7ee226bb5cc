import random
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from tokenloom.functions import graphemes
from tokenloom.functions import text as T
from tokenloom.functions.bytelevel import ALPHABET, from_byte_level, from_sentence_piece, to_byte_level

ODIA = "ଓଡ଼ିଆ"


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    return [tuple(r) for r in df.orderBy("i").select(*columns).collect()]


def test_letters_join_conjuncts(spark):
    assert values(spark, ["ସ୍ତ୍ରୀ", ODIA, "नमस्ते", "", None], graphemes.letters("text")) == [(1,), (3,), (3,), (0,), (None,)]


def test_native_counts_match_python(spark):
    texts = ["a  1", "a\x1cb c", ODIA, "", "x\n\n y\t", "don't stop now"]
    got = values(spark, texts, T.chars(F.col("text")), T.octets(F.col("text")), T.words(F.col("text")), T.floor(F.col("text")))
    assert got == [(len(t), len(t.encode()), len(t.split()), len(regex.findall(T.PATTERN, t))) for t in texts]


def words_with_marks(block, n=40):
    """Words of the consonants and vowel signs of a block, each letter with up to two marks; long known to Java too."""
    r = random.Random(block)
    letters, marks = ([chr(c) for c in range(block + a, block + b) if unicodedata.category(chr(c))[0] == kind] for a, b, kind in ((0x15, 0x2E, "L"), (0x31, 0x4E, "M")))
    return ["".join(r.choice(letters) + "".join(r.choices(marks, k=r.randint(0, 2))) for _ in range(r.randint(1, 6))) for _ in range(n)]


def test_marks_join_words_of_their_own_scripts_only(spark):
    patterns = T.PATTERN, T.fix_marks(T.PATTERN, T.INDIC_MARKS), T.fix_marks(T.PATTERN)
    floors = lambda texts: [[r[0] for r in values(spark, texts, T.floor(F.col("text"), p))] for p in patterns]
    for block in (0x0900, 0x0B00, 0x0C80):
        plain, indic, every = floors(words_with_marks(block))
        assert indic == every == [1] * len(indic) and max(plain) > 1
    plain, indic, every = floors(words_with_marks(0x0E00))
    assert indic == plain and every == [1] * len(every) and max(plain) > 1
    plain, indic, every = floors(["Nothing here has a mark: 3 x 14.", "can't\n\n  stop", "Über Ärger"])
    assert plain == indic == every


def test_patterns_without_letters_are_refused():
    split = {"type": "Split", "pattern": {"Regex": T.PATTERN}}
    for config in ({"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "ByteLevel"}]}}):
        with pytest.raises(ValueError):
            T.with_marks(config)
    with pytest.raises(ValueError):
        T.fix_marks(r"\d+|\S+")
    config = {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, {"type": "ByteLevel"}]}}
    changed = T.with_marks(config)
    assert changed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == T.fix_marks(T.PATTERN) != T.PATTERN == split["pattern"]["Regex"]


def test_script_predicates_agree_with_the_ranges(spark):
    r = random.Random(3)
    own = [chr(r.randint(a, b)) for a, b in T.SCRIPTS["indic"] for _ in range(30)]
    other = [chr(r.choice([r.randint(0x41, 0x24F), r.randint(0x370, 0x5FF), r.randint(0x0E00, 0x0E7F), r.randint(0x4E00, 0x9FFF), r.randint(0x1F300, 0x1F5FF)])) for _ in range(120)]
    texts = [f"a{c}" for c in own + other]
    got = values(spark, texts, T.in_script(F.col("text"), "indic"), T.bytes_in_script(F.encode("text", "UTF-8"), "indic"))
    assert got == [(True, True)] * len(own) + [(False, False)] * len(other)


def test_bytes_are_matched_where_they_begin(spark):
    rows = spark.createDataFrame([(bytearray.fromhex("01E0AC"),), (bytearray.fromhex("0E0AC1"),)], "b binary")
    assert [r[0] for r in rows.select(T.bytes_in_script(F.col("b"), "odia")).collect()] == [True, False]


def slow_measure(text, pieces):
    """The counts of pieces that spell a text, letter by letter and piece by piece."""
    letters, at, broken = regex.findall(r"\X", text), 0, 0
    cuts = {sum(map(len, pieces[:i])) for i in range(1, len(pieces))}
    for letter in letters:
        end = at + len(letter.encode())
        broken += any(at < c < end for c in cuts)
        at = end
    return len(letters), 1, len(pieces), len(letters), sum(p.decode(errors="replace").encode() != p for p in pieces), broken


def test_measures_of_texts_cut_anywhere():
    r = random.Random(6)
    for text in ["plain words", "line\r\nbreaks\r\n", ODIA, "é e\u0301 \U0001f600\u200d\U0001f525", "", *words_with_marks(0x0B00, 20)]:
        raw = text.encode()
        for _ in range(10):
            cuts = sorted(r.choices(range(len(raw) + 1), k=r.randint(0, 6)))
            pieces = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]
            assert graphemes.measure(text, pieces) == slow_measure(text, pieces)


def test_measures_of_pieces_in_other_forms():
    assert graphemes.measure("ab", [b" a", b"b"]) == (2, 1, 2, 2, 0, 0)
    assert graphemes.measure("e\u0301", ["\u00e9".encode()])[1] == 1
    for lost in ([b"a", None], [b"ax"], None):
        assert graphemes.measure("ab", lost) == (2, None, None, None, None, None)
    assert graphemes.measure("", []) == (0, 1, 0, 0, 0, 0)


def test_segments_cover_the_text():
    pieces = [b"ab", *(bytes([b]) for b in (" " + ODIA).encode())]
    got = [(s["chunk"], s["tokens"], s["letters"]) for s in graphemes.segment("ab " + ODIA, pieces)]
    assert got == [("ab", 1, 2), (" ", 1, 1), ("ଓ", 3, 1), ("ଡ଼ି", 9, 1), ("ଆ", 3, 1)]
    assert graphemes.segment("ab", [b"x"]) is None and graphemes.segment("ab", [None]) is None


def test_byte_alphabet():
    assert len({*ALPHABET}) == 256 and from_byte_level(to_byte_level(bytes(range(256)))) == bytes(range(256))
    assert from_sentence_piece("<0x0A>") == b"\n" and from_sentence_piece("▁a") == b" a"


def test_normal_forms(spark):
    assert values(spark, ["é", "ﬁ", None], graphemes.normalised("NFC")("text"), graphemes.normalised("NFKC")("text")) == [("é", "é"), ("ﬁ", "fi"), (None, None)]


def test_prompts(spark):
    got = values(spark, ["p"], T.choice_prompt(F.col("text"), F.lit("q")), T.truncated(F.lit("abc"), 2))
    assert got == [("Passage: p\nQuestion: q\nAnswer:", "ab")]
