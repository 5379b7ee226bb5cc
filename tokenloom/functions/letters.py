"""Letters (extended grapheme clusters) as native expressions: the grapheme grammar as one regular expression.

Java's own \\X lacks the rule that joins Indic conjuncts and follows an older Unicode version. The grammar of the
Unicode text segmentation rules is written out here instead, its character classes being listed from the
properties that the regex library knows, once, on the driver.
"""

from __future__ import annotations

import functools

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters up to here never join their neighbours, but for CR and LF.
ALONE = 0x02FF


@functools.cache
def property_ranges(name: str) -> tuple[tuple[int, int], ...]:
    """Ranges of the code points that have a property, such as GCB=Extend."""
    out = []
    for first, last in ((0, 0xD7FF), (0xE000, 0x10FFFF)):
        for m in regex.finditer(rf"\p{{{name}}}+", "".join(map(chr, range(first, last + 1)))):
            out.append((first + m.start(), first + m.end() - 1))
    return tuple(out)


def _class(*names: str, negated: bool = False) -> str:
    """A Java character class of the code points that have any of the properties."""
    ranges = sorted(r for n in names for r in property_ranges(n))
    return "[" + "^" * negated + "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


@functools.cache
def cluster_pattern() -> str:
    """One letter from its first code point on, as long as the rules make it."""
    extend, linker, consonant = _class("InCB=Extend"), _class("InCB=Linker"), _class("InCB=Consonant")
    either = _class("InCB=Extend", "InCB=Linker")
    conjunct = f"{consonant}(?:{extend}*{linker}{either}*{consonant})+"
    picture = _class("Extended_Pictographic")
    joined_pictures = rf"{picture}(?:{_class('GCB=Extend')}*\x{{200D}}{picture})+"
    lead, vowel, tail, lv, lvt = (_class(f"GCB={c}") for c in ("L", "V", "T", "LV", "LVT"))
    syllable = f"{lead}*(?:{vowel}+|{lv}{vowel}*|{lvt}){tail}*|{lead}+|{tail}+"
    flag = f"{_class('GCB=RI')}{{2}}"
    control = _class("GCB=Control", "GCB=CR", "GCB=LF")
    other = "[^" + control[1:]
    # ASCII first, then what is rare; a plain character with what follows it comes last
    core = f"(?![ -~])(?:{conjunct}|{joined_pictures}|{flag}|{syllable})|{other}"
    return rf"(?s:\r\n|{control}|{_class('GCB=Prepend')}*(?:{core}){_class('GCB=Extend', 'GCB=ZWJ', 'GCB=SpacingMark')}*)"


@functools.cache
def joined_pattern() -> str:
    """A letter that may have several code points: the next one can join, or this one can go before another."""
    joins = _class(*(f"GCB={c}" for c in ("Extend", "ZWJ", "SpacingMark", "RI", "L", "V", "T", "LV", "LVT")))
    beyond = rf"[^\x00-\x{{{ALONE:X}}}]"
    # the cheap tests come first: almost every character fails them at once
    return rf"(?s:\r\n|(?=.{beyond}|{beyond})(?=.{joins}|{_class('GCB=Prepend')}){cluster_pattern()})"


def letters(text: Column) -> Column:
    """Letters as a reader sees them; null for null."""
    rare = rf"[^\x00-\x{{{ALONE:X}}}]|\r\n"
    more = F.aggregate(F.regexp_extract_all(text, F.lit(joined_pattern()), F.lit(0)), F.lit(0).cast("long"), lambda n, m: n + F.char_length(m) - 1)
    return F.when(text.rlike(rare), F.char_length(text) - more).otherwise(F.char_length(text)).cast("long")


def letter_lengths(text: Column) -> Column:
    """The bytes of each letter of a text, in order; their running sums are where letters end."""
    return F.transform(F.regexp_extract_all(text, F.lit(cluster_pattern()), F.lit(0)), F.octet_length)
