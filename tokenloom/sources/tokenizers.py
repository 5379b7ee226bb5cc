"""Tokenizers as builders of column expressions: token ids, the bytes of each token, the pre-tokenizer's floor."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import text as T
from tokenloom.functions.bytelevel import from_byte_level, from_sentence_piece
from tokenloom.functions.graphemes import Cuts
from tokenloom.functions.replay import replayed


class Tokenizer:
    """The protocol: pieces(text) is an array of binaries (null for none; an unknown token is a null entry)."""

    key: str
    style: str
    vocab_size: int | None = None

    def tokens(self, text: Column) -> Column:
        return F.size(self.pieces(text)).cast("long")

    def pieces(self, text: Column) -> Column:
        raise NotImplementedError

    def floor(self, text: Column) -> Column:
        return F.lit(None).cast("long")

    def unknown(self, text: Column) -> Column:
        return F.lit(0).cast("long")

    def cuts(self, text: Column) -> tuple[Cuts, Column | None] | None:
        """Where the tokens end, if they spell the text by their making; then no piece has to be made to measure it."""
        return None


@dataclass
class FixedCut(Tokenizer):
    """Tokens of `size` bytes each; 1 is a byte tokenizer."""

    size: int = 1
    style: str = "bytelevel"

    def __post_init__(self):
        self.key, self.vocab_size = f"bytes{self.size}", 256 if self.size == 1 else None

    def tokens(self, text: Column) -> Column:
        return F.ceil(T.octets(text) / self.size).cast("long")

    def cuts(self, text: Column) -> tuple[Cuts, Column | None]:
        return Cuts(self.size), None

    def pieces(self, text: Column) -> Column:
        # of hexadecimal digits in one pass; places in the bytes would have them encoded again for each piece
        return F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(f".{{1,{2 * self.size}}}"), F.lit(0)), F.unhex)


class Characters(Tokenizer):
    """A token for each code point."""

    key, style = "chars", "tiktoken"

    def tokens(self, text: Column) -> Column:
        return T.chars(text)

    def cuts(self, text: Column) -> tuple[Cuts, Column | None]:
        return Cuts(0), None

    def pieces(self, text: Column) -> Column:
        return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.encode(c, "UTF-8"))


@dataclass
class PreTokens(Tokenizer):
    """A token for each piece of a pre-tokenizer: a tokenizer of unlimited vocabulary."""

    pattern: str = T.PATTERN
    key: str = "pretokens"
    style: str = "tiktoken"

    def tokens(self, text: Column) -> Column:
        return T.floor(text, self.pattern)

    def floor(self, text: Column) -> Column:
        return T.floor(text, self.pattern)

    def pieces(self, text: Column) -> Column:
        return F.transform(T.pieces(text, self.pattern), lambda p: F.encode(p, "UTF-8"))

    def cuts(self, text: Column) -> tuple[Cuts, Column | None]:
        return Cuts(), F.transform(T.pieces(text, self.pattern), F.octet_length)


def style_of(config: dict) -> str:
    """wordpiece by the model's type; bytelevel if the decoder or pre-tokenizer has a ByteLevel step; else spm."""
    if config["model"]["type"] == "WordPiece":
        return "wordpiece"
    steps = json.dumps([config.get("decoder"), config.get("pre_tokenizer")])
    return "bytelevel" if "ByteLevel" in steps else "spm"


class Library(Tokenizer):
    """A tokenizer.json file, run by the tokenizers library over Arrow batches."""

    def __init__(self, key: str, config: dict):
        from tokenizers import Tokenizer as Implementation

        self.key, self.style, self.text = key, style_of(config), json.dumps(config)
        own = Implementation.from_str(self.text)
        self.vocab_size = own.get_vocab_size(with_added_tokens=True)
        model = config["model"]
        self.unk_id = model.get("unk_id") if model.get("unk_id") is not None else own.token_to_id(model["unk_token"]) if isinstance(model.get("unk_token"), str) else None
        self.end = model.get("end_of_word_suffix") or ""

    @classmethod
    def from_file(cls, key: str, path: str) -> Library:
        with open(path, encoding="utf-8") as file:
            return cls(key, json.load(file))

    def _function(self, kind: str, of):
        text = self.text

        @F.pandas_udf(kind)
        def apply(batch: pd.Series) -> pd.Series:
            own = _implementation(text)
            return pd.Series([None if t is None else of(own, t) for t in batch], dtype=object)

        return apply

    def ids(self, text: Column) -> Column:
        return self._function("array<int>", lambda own, t: own.encode(t, add_special_tokens=False).ids)(text)

    def tokens(self, text: Column) -> Column:
        return F.size(self.ids(text)).cast("long")

    def unknown(self, text: Column) -> Column:
        return F.size(F.filter(self.ids(text), lambda i: i == self.unk_id)).cast("long") if self.unk_id is not None else F.lit(0).cast("long")

    def pieces(self, text: Column) -> Column:
        if self.style == "wordpiece" or self.end:
            return F.lit(None).cast("array<binary>")
        unk, of = self.unk_id, from_byte_level if self.style == "bytelevel" else from_sentence_piece
        return self._function("array<binary>", lambda own, t: [None if i == unk else of(own.id_to_token(i)) for i in own.encode(t, add_special_tokens=False).ids])(text)

    def floor(self, text: Column) -> Column:
        if self.style != "bytelevel":
            return F.lit(None).cast("long")

        def count(own, t):
            if own.pre_tokenizer is None:
                return None
            return len(own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(t) if own.normalizer is not None else t))

        return self._function("long", count)(text)


_built: dict[int, object] = {}


def _implementation(text: str):
    from tokenizers import Tokenizer as Implementation

    if (key := hash(text)) not in _built:
        _built[key] = Implementation.from_str(text)
    return _built[key]


class Ranks(Tokenizer):
    """A tiktoken vocabulary file with its pattern."""

    style = "tiktoken"

    def __init__(self, key: str, path: str, pattern: str):
        self.key, self.path, self.pattern = key, path, pattern
        with open(path, "rb") as file:
            self.vocab_size = sum(1 for line in file if line.strip())

    def _encoding(self):
        import base64

        import tiktoken

        if (key := hash((self.path, self.pattern))) not in _built:
            with open(self.path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            _built[key] = tiktoken.Encoding(self.key, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return _built[key]

    def pieces(self, text: Column) -> Column:
        @F.pandas_udf("array<binary>")
        def apply(batch: pd.Series) -> pd.Series:
            own = self._encoding()
            return pd.Series([None if t is None else [own.decode_single_token_bytes(i) for i in own.encode_ordinary(t)] for t in batch], dtype=object)

        return apply(text)

    def floor(self, text: Column) -> Column:
        pattern = self.pattern

        @F.pandas_udf("long")
        def apply(batch: pd.Series) -> pd.Series:
            found = regex.compile(pattern)
            return batch.map(lambda t: len(found.findall(t)), na_action="ignore").astype("Int64")

        return apply(text)


class Merges(Tokenizer):
    """A byte-level vocabulary given by its ranked merges of hexadecimal symbols, replayed by this library.

    Pieces of the pre-tokenizer never share tokens, so a worker replays the merges once for each different piece
    and keeps the lengths of its tokens (CACHED pieces at most); only lengths leave it.
    """

    style = "bytelevel"
    CACHED = 200_000

    def __init__(self, key: str, merges: list[tuple[str, str]], pattern: str = T.PATTERN):
        self.key, self.merges, self.pattern = key, merges, pattern
        self.vocab_size = 256 + len({a + b for a, b in merges})

    @classmethod
    def from_config(cls, key: str, config: dict, pattern: str = T.PATTERN) -> Merges:
        """From a byte-level tokenizer configuration, whose tokens are spelled in the byte alphabet."""
        own = lambda token: from_byte_level(token).hex().upper()
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in config["model"]["merges"]]
        return cls(key, [(own(a), own(b)) for a, b in pairs], pattern)

    def lengths(self, pieces: Column) -> Column:
        """The bytes of each token of an array of pieces."""
        merges, most = self.merges, self.CACHED
        ranks: dict[tuple[str, str], list[int]] = {}
        known: dict[str, list[int]] = {}

        @F.pandas_udf("array<int>")
        def apply(batch: pd.Series) -> pd.Series:
            if not ranks:
                for i, m in enumerate(merges):
                    ranks.setdefault(tuple(m), []).append(i)
            out = []
            for pieces in batch:
                own = None if pieces is None else []
                for piece in () if pieces is None else pieces:
                    if piece not in known:
                        if len(known) >= most:
                            known.clear()
                        raw = piece.encode().hex().upper()
                        known[piece] = [len(s) // 2 for s in replayed([raw[i : i + 2] for i in range(0, len(raw), 2)], merges, ranks)]
                    own += known[piece]
                out.append(own)
            return pd.Series(out, dtype=object)

        return apply(pieces)

    def cuts(self, text: Column) -> tuple[Cuts, Column | None]:
        return Cuts(), self.lengths(T.pieces(text, self.pattern))

    def tokens(self, text: Column) -> Column:
        return F.size(self.lengths(T.pieces(text, self.pattern))).cast("long")

    def floor(self, text: Column) -> Column:
        return T.floor(text, self.pattern)


def vocabulary(spark: SparkSession, config: dict) -> DataFrame:
    """(token, id) of a tokenizer configuration."""
    return spark.createDataFrame([(t, i) for t, i in config["model"]["vocab"].items()], "token string, id int")


def merges(spark: SparkSession, config: dict) -> DataFrame:
    """(rank, left, right) of a tokenizer configuration; merges may be pairs or strings with a space."""
    pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in config["model"]["merges"]]
    return spark.createDataFrame([(r, a, b) for r, (a, b) in enumerate(pairs)], "rank int, left string, right string")
