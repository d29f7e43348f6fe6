"""Byte-pair encoding and decoding from a tokenizer file, without the tokenizers library.

The file's normaliser (canonical composition, white space, lower case), its
splitting pattern and its merges are rebuilt here. A pre-token is a doubly
linked list of symbols and a priority queue of the merges that its neighbours
allow, least rank first: the best one joins two symbols, the two new
neighbours are queued, and entries whose symbols have changed since are
skipped when they come up. So a run of n symbols takes n log n steps, however
long it is. Decoding concatenates the vocabulary's strings.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.packing import _byte_chars
from millrace.llm.util import batches, texts

#: White space as the tokenizer files mean it (Unicode's property), which is less than Python's own.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pattern of the public file, and of all its kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


# What Unicode 16 has beyond Python's version: (first, last) of letters and numbers, (first, last, least lower-case one) of capitals.
NEWER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEWER_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
NEWER_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)


def _ranges(kind: str, newer: tuple[tuple[int, int], ...], below: int) -> str:
    """The inside of a character class: all code points under ``below`` whose category begins with ``kind``."""
    of = [i for i in range(below) if unicodedata.category(chr(i))[0] == kind] + [i for a, b in newer for i in range(a, min(b + 1, below))]
    of = sorted(set(of))
    parted = [i for i in range(1, len(of)) if of[i] != of[i - 1] + 1]
    return "".join(f"{chr(of[a])}-{chr(of[b - 1])}" for a, b in zip([0, *parted], [*parted, len(of)], strict=True))


@cache
def _splitter(below: int) -> Callable[[str], list[str]]:
    """``SPLIT`` for texts of code points under ``below``: short classes are matched much faster than whole Unicode."""
    return re.compile(SPLIT.replace(r"\s", WHITE).replace(r"\p{L}", _ranges("L", NEWER_LETTERS, below)).replace(r"\p{N}", _ranges("N", NEWER_NUMBERS, below))).findall


_CAPITALS = {a + i: c + i for a, b, c in NEWER_CAPITALS for i in range(b - a + 1)} | {0x3A3: 0x3C3}
_capital = re.compile("[" + "".join(map(chr, _CAPITALS)) + "]").search


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text: composed, lower case letter by letter (the end of a word changes nothing), split."""
    if text.isascii():
        return _splitter(0x80)(text.lower())
    text = unicodedata.normalize("NFC", text)
    if _capital(text):
        text = text.translate(_CAPITALS)
    text = text.lower()
    return _splitter(_below(text))(text)


def _below(text: str) -> int:
    """The least of three bounds that all code points of the text are under."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return 0x10000 if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else sys.maxunicode + 1
    return 0x100


class Merges:
    """Symbols of pre-tokens joined by rank; ``path`` is a tokenizers file whose model is BPE."""

    def __init__(self, model: dict):
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.size = max(self.vocab.values()) + 1
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.rank[self.vocab[left] * self.size + self.vocab[right]] = len(self.made)
            self.made.append(self.vocab[left + right])

    def symbols(self, word: str) -> list[int]:
        """Ids of single characters, the last one with the mark of a word's end."""
        found = [self.vocab[c] for c in word[:-1]]
        found.append(self.vocab[word[-1] + self.suffix])
        return found

    def encode(self, word: str) -> list[int]:
        """Ids of one pre-token that is not empty."""
        sym = self.symbols(word)
        n, size, rank, made = len(sym), self.size, self.rank.get, self.made
        # pair[i] is the rank of the symbols at i and at right[i], or -1; an entry is that rank and the place.
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [rank(sym[i] * size + sym[i + 1], -1) for i in range(n - 1)]
        pair.append(-1)
        bits = n.bit_length()
        place = (1 << bits) - 1
        queue = [r << bits | i for i, r in enumerate(pair) if r >= 0]
        heapify(queue)
        while queue:
            best = heappop(queue)
            i, r = best & place, best >> bits
            if pair[i] != r:
                continue  # stale: one of the two is no longer what it was
            j = right[i]
            sym[i] = whole = made[r]
            sym[j] = pair[j] = pair[i] = -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                pair[i] = r = rank(whole * size + sym[k], -1)
                if r >= 0:
                    heappush(queue, r << bits | i)
            h = left[i]
            if h >= 0:
                pair[h] = r = rank(sym[h] * size + whole, -1)
                if r >= 0:
                    heappush(queue, r << bits | h)
        return [s for s in sym if s >= 0]


class Codec(dict):
    """Pre-token -> its ids as native uint32 bytes.

    Two generations of ``size`` pre-tokens of up to ``LONGEST`` characters are
    kept, longer ones are encoded each time.
    """

    LONGEST = 64

    def __init__(self, path: str, size: int = 300_000):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._accept(spec)
        self.merges = Merges(spec["model"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (max([*self.merges.vocab.values(), *self.special.values()]) + 1)
        for name, i in [*self.merges.vocab.items(), *self.special.items()]:
            self.names[i] = name
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if longest_first else lambda text: [text]
        self.bytes, self.size = _byte_chars(), size
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _accept(spec: dict) -> None:
        """Refuses a file with parts that are not rebuilt here."""
        norms = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split, level = ((spec["pre_tokenizer"] or {}).get("pretokenizers", []) + [{}, {}])[:2]
        model = spec["model"]
        rebuilt = (
            norms == ["NFC", "Replace", "Lowercase"]
            and split.get("pattern") == {"Regex": SPLIT}
            and split.get("behavior") == "Removed"
            and level.get("type") == "ByteLevel"
            and not level.get("add_prefix_space")
            and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and spec["post_processor"] is None
            and spec["decoder"] is None
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        )
        if not rebuilt:
            raise ValueError("a tokenizer file of another kind: normaliser, pattern, model or decoder is not the lower-casing BPE with word ends")

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        made = self.old.get(word)
        if made is None:
            shown = word if word.isascii() and word.isprintable() else "".join(map(self.bytes.__getitem__, word.encode()))
            made = array("I", self.merges.encode(shown)).tobytes()
        if len(word) <= self.LONGEST:
            self[word] = made
        return made

    def encode(self, text: str) -> bytes:
        parts = self.cut(text)
        return self._plain(text) if len(parts) == 1 else b"".join(array("I", [self.special[p]]).tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def _plain(self, part: str) -> bytes:
        return b"".join(map(self.__getitem__, pre_tokens(part)))

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each Python worker, kept from task to task."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens long, ids array<int>: each whole text as the tokenizers library encodes it, no special tokens added.

    A special token's string in a text is that token. Null and empty texts
    have no ids; texts may be as long as a value can be. Rows with a null or
    repeated id are encoded each for itself, other columns, whatever their
    names, are not read, and an empty table gives an empty one.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches(stream, 256):
            made = [own.encode(text) for text in batch.column(1).to_pylist()]
            sizes = np.fromiter((len(m) // 4 for m in made), np.int64, len(made))
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(made), np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "n_tokens", "ids"])

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of ``encoded`` that ``encode`` gave, and decoded: the ids' strings of the vocabulary in order.

    The file names no decoder, so the strings are parted by spaces and keep
    their marks. Null ids decode as no ids do, to the empty text. An id
    outside the vocabulary is an error.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches(stream, 256):
            decoded = pa.array([own.decode(ids or ()) for ids in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")
