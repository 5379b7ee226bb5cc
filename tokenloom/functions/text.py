"""Text measures as native column expressions, and pre-tokenizer patterns."""

from __future__ import annotations

import copy
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The pre-tokenizer pattern that several public byte-level tokenizers share. Fixed value.
PATTERN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
#: Combining marks of the Indian scripts, as a character class. Fixed value.
INDIC_MARKS = r"[\p{M}&&[\x{0900}-\x{0DFF}\x{1C50}-\x{1C7F}\x{ABC0}-\x{ABFF}]]"
#: Code-point ranges of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)],
    "odia": [(0x0B00, 0x0B7F)],
    "indic": [(0x0900, 0x0DFF), (0x1C50, 0x1C7F), (0xABC0, 0xABFF), (0x0600, 0x06FF)],
}
#: Unicode white space and the four separators that Python's str.split() also parts words at.
_WORD_GAP = r"(?U)[\s\x1c-\x1f]+"


def chars(text: Column) -> Column:
    """Code points."""
    return F.char_length(text).cast("long")


def octets(text: Column) -> Column:
    """Bytes of UTF-8."""
    return F.octet_length(text).cast("long")


def words(text: Column) -> Column:
    """White-space-separated words; Unicode white space and U+001C to U+001F separate."""
    return F.size(F.filter(F.split(text, _WORD_GAP), lambda w: w != "")).cast("long")


def floor(text: Column, pattern: str = PATTERN) -> Column:
    """Pieces that the pre-tokenizer makes of a text: no vocabulary can use fewer tokens."""
    return F.regexp_count(text, F.lit(f"(?U){pattern}")).cast("long")


def pieces(text: Column, pattern: str = PATTERN) -> Column:
    """The pre-tokenizer's pieces."""
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))


def script_class(script: str) -> str:
    """A regular-expression character class of a script's code points."""
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in SCRIPTS[script]) + "]"


def in_script(text: Column, script: str) -> Column:
    """Whether a text holds a character of the script."""
    return text.rlike(script_class(script))


def script_letters(text: Column, script: str) -> Column:
    """Characters of the script in a text."""
    return F.regexp_count(text, F.lit(script_class(script))).cast("long")


def alphabetic(text: Column) -> Column:
    """Letters in a text."""
    return F.regexp_count(text, F.lit(r"\p{L}")).cast("long")


def mostly_in_script(text: Column, script: str) -> Column:
    """Whether more than half of a text's letters (of one at least) are of the script."""
    return 2 * script_letters(text, script) > F.greatest(F.lit(1), alphabetic(text))


def script_leads(script: str) -> list[bytes]:
    """The shortest byte prefixes that characters of the script, and no others but by whole prefix, begin with in UTF-8."""
    leads = set()
    for a, b in SCRIPTS[script]:
        step = 64
        for c in range(a - a % step, b + 1, step):
            raw = chr(max(c, a)).encode()
            leads.add(raw[:-1])
    return sorted(leads)


def bytes_in_script(raw: Column, script: str) -> Column:
    """Whether a binary holds the start of a character of the script, at byte-aligned places."""
    return F.hex(raw).rlike("^(?:..)*?(?:" + "|".join(x.hex().upper() for x in script_leads(script)) + ")")


#: What a pattern is made of, as far as letters matter: a character class, an escape, anything else.
_PARTS = re.compile(r"\[\^?(?:\\p\{\w+\}|\\.|[^\]\\])*\]|\\p\{\w+\}|\\.|.", re.S)


def fix_marks(pattern: str, marks: str = r"\p{M}") -> str:
    """The pattern with combining marks taken for letters: in classes that name letters, and where letters stand alone.

    ValueError if the pattern names letters nowhere.
    """
    letters, parts = r"\p{L}", _PARTS.findall(pattern)
    if not any(letters in part for part in parts):
        raise ValueError("the pattern has no letter class to extend")
    return "".join(f"[{letters}{marks}]" if part == letters else part.replace(letters, letters + marks) for part in parts)


def with_marks(config: dict, marks: str = r"\p{M}") -> dict:
    """A copy of a tokenizer configuration whose first Split keeps marks inside words. ValueError if it has none."""
    config = copy.deepcopy(config)
    steps = config["pre_tokenizer"].get("pretokenizers") or [config["pre_tokenizer"]]
    split = next((s for s in steps if s["type"] == "Split"), None)
    if split is None:
        raise ValueError("the configuration has no Split")
    split["pattern"]["Regex"] = fix_marks(split["pattern"]["Regex"], marks)
    return config


def truncated(text: Column, n: int = 2000) -> Column:
    """The first n code points."""
    return F.substring(text, 1, n)


def choice_prompt(passage: Column, question: Column) -> Column:
    """The prompt of a multiple-choice question."""
    return F.format_string("Passage: %s\nQuestion: %s\nAnswer:", passage, question)


def shots_prompt(shots: Column, source: Column, source_name: str, target_name: str) -> Column:
    """A few-shot translation prompt; shots is an array of (source, target)."""
    given = F.transform(shots, lambda s: F.format_string(f"{source_name}: %s\n{target_name}: %s\n\n", s["source"], s["target"]))
    return F.concat(F.array_join(given, ""), F.format_string(f"{source_name}: %s\n{target_name}:", source))


def overcut(tokens: Column, letters: Column) -> Column:
    """Whether a segment has more tokens than letters."""
    return tokens > F.greatest(letters, F.lit(1))
