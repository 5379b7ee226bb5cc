"""The byte-level alphabet and the bytes of tokens."""

from __future__ import annotations

import re

_RAW = re.compile(r"<0x([0-9A-Fa-f]{2})>")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if it is visible, else the next from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


ALPHABET = byte_alphabet()
BYTES = {c: b for b, c in enumerate(ALPHABET)}


def to_byte_level(raw: bytes) -> str:
    return "".join(ALPHABET[b] for b in raw)


def from_byte_level(token: str) -> bytes:
    return bytes(BYTES[c] for c in token)


def from_sentence_piece(token: str) -> bytes:
    """<0xNN> is a raw byte; U+2581 is a space."""
    raw = _RAW.fullmatch(token)
    return bytes([int(raw[1], 16)]) if raw else token.replace("▁", " ").encode()
