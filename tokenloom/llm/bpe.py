"""BPE encoding by speculation and verification, and decoding, for word-end vocabularies.

A piece of the pre-tokenizer is first cut greedily into the longest tokens of the vocabulary. Merging would
give just these tokens if and only if it would keep every adjacent pair of them apart, which is checked for
all pairs of a batch at once: the pair's merges are undone from the latest backwards along the boundary, and
the check fails if two tokens that then touch would have merged before either was merged away from it. Only
pieces with a failing pair are merged exactly. Pieces that were met before are taken from a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tokenloom.functions.bytelevel import byte_alphabet
from tokenloom.llm.common import CACHE_WORDS

_NEVER = 1 << 40
_END = "\x00"
#: Texts whose lower case and normal form need no library: printable ASCII, the letters of Latin-1, plain white space.
_PLAIN = re.compile("[ -~À-ÖØ-öø-ÿ\t\n\r]*")
_PLAIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 \t\n\r]+")
#: The normalizer and pre-tokenizer that plain_pieces() stands for. Fixed values of that tokenizer format.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def has_plain_pieces(config: dict) -> bool:
    """Whether a tokenizer cuts plain texts into plain_pieces(): its steps, and no added token in texts without "<|"."""
    if not all(t["content"].startswith("<|") for t in config.get("added_tokens") or []):
        return False
    steps = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    byte_level = steps[-1].get("type") == "ByteLevel" and not steps[-1].get("add_prefix_space") and not steps[-1].get("use_regex")
    return config.get("normalizer") == _NORMALIZER and len(steps) == 2 and steps[0] == _SPLIT and byte_level


def plain_pieces(text: str) -> list[str] | None:
    """The pre-tokenizer's pieces of a plain text, lower case; None for other texts, which the library must cut."""
    return _PLAIN_PIECES.findall(text.lower()) if _PLAIN.fullmatch(text) and "<|" not in text else None


def plain_lower(text: str) -> bytes | None:
    """A plain text in lower case and UTF-8; None for other texts."""
    return text.lower().encode() if _PLAIN.fullmatch(text) and "<|" not in text else None


#: Kinds of bytes in lower-case plain texts: 0 white space, 1 letters, 2 digits, 3 others.
_KINDS = np.full(256, 3, np.uint8)
_KINDS[[*b"\0 \t\n\r"]], _KINDS[[*b"abcdefghijklmnopqrstuvwxyz", *range(128, 256)]], _KINDS[[*b"0123456789"]] = 0, 1, 2


def piece_starts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where plain_pieces() begin in bytes of plain_lower() texts, and which bytes belong to one; the bytes end with three of white space.

    A piece begins where the kind changes and at every digit. An apostrophe that begins one takes in s, t, m, d, re,
    ve or ll, after which another begins.
    """
    kind = _KINDS[raw]
    inside = kind > 0
    start = inside & (kind == 2)
    start[0] = inside[0]
    start[1:] |= inside[1:] & (kind[1:] != kind[:-1])
    mark = np.flatnonzero(raw == ord("'"))
    mark = mark[start[mark]]
    one, two = raw[mark + 1], raw[mark + 2]
    short = np.isin(one, [*b"stmd"])
    long = (two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (one == ord("l")) & (two == ord("l"))
    start[mark[short | long] + 1] = False
    after = np.concatenate([mark[short] + 2, mark[long] + 3])
    start[after] |= kind[after] == 1
    return start, inside


class Recent(dict):
    """A cache of at most `limit` entries and as many of the generation before, from which used ones come back."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.before = limit, {}

    def missing(self, keys) -> list:
        """The keys without a value, each once."""
        out = []
        for k in [*filterfalse(self.__contains__, {*keys})]:
            if k in self.before:
                self[k] = self.before[k]
            else:
                out.append(k)
        return out

    def make_room(self, coming: int) -> bool:
        """Begins another generation if `coming` more entries do not fit; then some keys may be missing again."""
        if len(self) + coming <= self.limit:
            return False
        self.before = dict(self)
        self.clear()
        return True


class PairMerges:
    """A vocabulary and its ranked merges as arrays."""

    def __init__(self, config: dict):
        model = config["model"]
        self.end = model.get("end_of_word_suffix") or ""
        own = lambda t: t[: -len(self.end)] + _END if self.end and t.endswith(self.end) and len(t) > len(self.end) else t
        self.vocab = {own(t): i for t, i in model["vocab"].items()}
        self.text = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in config["added_tokens"]}
        size = max(self.vocab.values()) + 1
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ", 1)
            a, b = own(a), own(b)
            i, j, k = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if self.rank[k] >= 0 or max(self.rank[i], self.rank[j]) >= r:
                raise ValueError("a token is merged twice, or before its parts")
            self.rank[k], self.left[k], self.right[k] = r, i, j
            self.merges[i, j] = r, k
        keys = np.array([i << 32 | j for i, j in self.merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.known = {t: i for t, i in self.vocab.items() if self.rank[i] >= 0 or len(t.rstrip(_END)) == 1}
        #: Lengths of the tokens that begin with three given characters, or are a beginning of them; longest first.
        starts: dict[str, set[int]] = {}
        for t in self.known:
            starts.setdefault(t[:3], set()).add(len(t))
        self.lengths = {k: (*sorted(v | {n for n in (1, 2) if k[:n] in self.known}, reverse=True),) for k, v in starts.items()}

    def longest_match(self, piece: str) -> list[int]:
        """Greedy tokens of a piece over the byte alphabet."""
        s, at, out = piece + _END if self.end else piece, 0, []
        bare = len(piece) if self.end else -1  # the mark of the end is never left alone
        known, lengths, size = self.known, self.lengths, len(s)
        while at < size:
            for n in lengths.get(s[at : at + 3], (2, 1)):
                to = at + n
                if to <= size and to != bare and (t := known.get(s[at:to])) is not None:
                    out.append(t)
                    at = to
                    break
            else:
                raise ValueError(f"no token for {s[at]!r}")
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of a followed by that of b gives a and b again, for each pair."""
        ok = np.ones(len(a), bool)
        live, x, y = np.arange(len(a)), a.copy(), b.copy()
        px, py = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        while len(live):
            spot = np.searchsorted(self.keys, key := x << 32 | y)
            spot[spot == len(self.keys)] = 0
            r = np.where(self.keys[spot] == key, self.key_rank[spot], _NEVER)
            bad = (r < px) & (r <= py) & (r < _NEVER)
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~bad & ((rx >= 0) | (ry >= 0))
            undo_x = rx > ry
            px, py = np.where(undo_x, rx, px), np.where(undo_x, py, ry)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            live, x, y, px, py = live[on], x[on], y[on], px[on], py[on]
        return ok

    def merged(self, piece: str) -> list[int]:
        """Exact tokens of a piece: merges in order of rank, the leftmost first."""
        s = [*piece]
        if self.end:
            s[-1] += _END
        ids = [self.vocab[c] for c in s]
        if len(ids) <= 64:  # few enough to look through for the lowest rank
            find, none = self.merges.get, (_NEVER, 0)
            found = [find(p, none) for p in zip(ids, ids[1:])]
            while found and (best := min(found))[0] < _NEVER:
                i = found.index(best)
                ids[i : i + 2] = [best[1]]
                del found[i]
                if i:
                    found[i - 1] = find((ids[i - 1], ids[i]), none)
                if i < len(found):
                    found[i] = find((ids[i], ids[i + 1]), none)
            return ids
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = k, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := self.merges.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (*m, p, ids[p], ids[q]))
        return [i for i in ids if i >= 0]

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Tokens of pieces: speculation, one check of all adjacent pairs, exact merging where it fails."""
        out = [self.longest_match(p) for p in pieces]
        n = np.array([len(x) for x in out], np.int64)
        if not n.sum():
            return out
        flat, of = np.concatenate([np.array(x, np.int64) for x in out]), np.repeat(np.arange(len(out)), n)
        inside = of[1:] == of[:-1]
        failed = np.unique(of[1:][inside][~self.compatible(flat[:-1][inside], flat[1:][inside])])
        for i in failed.tolist():
            out[i] = self.merged(pieces[i])
        return out


class WordEncoder:
    """Encodes texts with a tokenizer file: its special tokens, normalizer, pieces and merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.pairs = PairMerges(config)
        self.library = Tokenizer.from_file(path)
        added = config.get("added_tokens") or []
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in white space or match whole words only are not supported")
        #: Added tokens that are looked for in the text, and those that are looked for in its normal form.
        self.special = {t["content"]: t["id"] for t in added if not t.get("normalized")}
        self.normal = {self.library.normalizer.normalize_str(t["content"]) if self.library.normalizer else t["content"]: t["id"] for t in added if t.get("normalized")}
        self.specials, self.normals = (re.compile("(" + "|".join(map(re.escape, sorted(some, key=len, reverse=True))) + ")") if some else None for some in (self.special, self.normal))
        self.joined = config.get("decoder") is None
        self.alphabet = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})

        self.plain = has_plain_pieces(config)

    def byte_level(self, piece: str) -> str:
        return piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(self.alphabet)

    def pieces(self, text: str) -> list[str | int]:
        """Pieces over the byte alphabet, and the ids of special tokens."""
        if self.plain and (found := plain_pieces(text)) is not None:
            return [self.byte_level(p) for p in found]
        out: list[str | int] = []
        for i, part in enumerate(self.specials.split(text) if self.specials else (text,)):
            if i % 2:
                out.append(self.special[part])
                continue
            part = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
            for j, own in enumerate(self.normals.split(part) if self.normals else (part,)):
                if j % 2:
                    out.append(self.normal[own])
                elif own:
                    out += [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(own)]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        plans = [self.pieces(t) for t in texts]
        wanted = [*{p: None for plan in plans for p in plan if isinstance(p, str)}]
        ids = dict(zip(wanted, self.pairs.encode(wanted)))
        return [[i for p in plan for i in ((p,) if isinstance(p, int) else ids[p])] for plan in plans]

    def decoded(self, ids: list[int]) -> str:
        """Tokens joined by one space, as a tokenizer without a decoder does; special tokens stay."""
        if not self.joined:
            raise ValueError("tokenizers with a decoder are not supported")
        return " ".join(self.pairs.text[i] for i in ids)


_encoders: dict[str, tuple[WordEncoder, Recent, Recent]] = {}


def _encode(path: str):
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def known(encoder: WordEncoder, cache: Recent, keys: list, byte_level: bool) -> None:
        new = cache.missing(keys)
        if cache.make_room(len(new)):
            new = cache.missing(keys)
        pieces = [p for p in new if isinstance(p, str)]
        made = dict(zip(pieces, encoder.pairs.encode(pieces if byte_level else [*map(encoder.byte_level, pieces)])))
        for p in new:
            ids = made.get(p, [p])
            cache[p] = " ".join(map(str, ids)), encoder.decoded(ids)

    def run(batches):
        if path not in _encoders:
            _encoders[path] = WordEncoder(path), Recent(CACHE_WORDS), Recent(CACHE_WORDS // 4)
        encoder, plain, other = _encoders[path]
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 64):
                plans = []
                for text in batch.column("text").slice(at, 64).to_pylist():
                    pieces = plain_pieces(text or "") if encoder.plain else None
                    plans.append((plain, pieces) if pieces is not None else (other, encoder.pieces(text or "")))
                known(encoder, plain, [p for c, keys in plans if c is plain for p in keys], False)
                known(encoder, other, [p for c, keys in plans if c is other for p in keys], True)
                for cache, keys in plans:
                    parts = [*map(cache.__getitem__, keys)]
                    ids, decoded = (" ".join([x[i] for x in parts]) for i in (0, 1))
                    out.append((ids.count(" ") + 1 if ids else 0, *(hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (ids, decoded))))
            columns = [*zip(*out)] or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=names)

    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, and digests of the ids and of the text decoded from them.

    A null text counts as an empty one (no tokens); an empty table gives an empty table; repeated rows each
    give a row; other columns are ignored, whatever their names. Texts of any length are encoded whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
