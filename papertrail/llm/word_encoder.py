"""Ids of whole texts from the ids of their words, for tokenizers none of whose matches crosses white space.

The library's own model encodes every word.  For plain words (printable ASCII and precomposed Latin letters) the steps
before the model, which cost most of a call, are done here: lower case and the split into letters, digits and other
signs.  That is only done if the tokenizer's file states exactly these steps; all other words, and those that may hold a
special string, take the library's whole way.  Words are remembered in two generations, so memory is bounded and frequent
words survive when the older generation goes.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

#: Words in a generation; longer words (bytes) are not remembered.
REMEMBERED = 250_000
LONG_WORD = 256

# The steps before the model that are done here, as tokenizer files state them.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "behavior": "Removed", "invert": True,
          "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

#: Characters of plain words: printable ASCII and the precomposed letters of Latin-1.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall


def _byte_signs() -> dict[int, str]:
    """The sign that stands for each byte: visible Latin-1 signs stand for themselves, others follow from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_SIGNS = _byte_signs()


def _bytes_of(part: str) -> str:
    """The signs of the part's bytes."""
    return part if part.isascii() else part.encode().decode("latin-1").translate(_SIGNS)


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Words(dict):
    """word (UTF-8) -> its ids as little-endian unsigned 32-bit integers, encoded when first asked for."""

    def __init__(self, encode, older: dict[bytes, bytes]):
        super().__init__()
        self.encode, self.older = encode, older

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = _packed(self.encode(word.decode()))
        if len(word) <= LONG_WORD:
            self[word] = ids
        return ids


class WordEncoder:
    """Encodes whole texts; ``remembered``: words in each of the two generations."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.remembered = remembered
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        self.specials = [t["content"] for t in stated["added_tokens"]]
        self.model = None
        if (stated["normalizer"] or {}).get("normalizers") == _NORMALIZERS and \
                (stated["pre_tokenizer"] or {}).get("pretokenizers") == [_SPLIT, _BYTES] and \
                stated["model"]["type"] == "BPE" and not any(s.isalpha() or len(s) < 2 for s in self.specials):
            self.model = self.tokenizer.model
            self.signs = {c: [t.id for t in self.model.tokenize(c)] for c in map(chr, range(ord("!"), ord("~") + 1))}
        heads = sorted({s[:2] for s in self.specials})
        self.special = re.compile("|".join(map(re.escape, heads)) or "(?!)").search
        self.words = _Words(self.word, {})

    def word(self, word: str) -> list[int]:
        """The ids of a word."""
        if self.model is not None:
            if word.isascii() and word.isalpha():
                return [t.id for t in self.model.tokenize(word.lower())]
            if _PLAIN(word) and not self.special(word):
                out = []
                for part in _PARTS(word.lower()):
                    out += self.signs.get(part) or [t.id for t in self.model.tokenize(_bytes_of(part))]
                return out
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out = b"".join(map(self.words.__getitem__, text.encode().split()))  # splits at ASCII white space only
        if len(self.words) > self.remembered:
            self.words.older = {}
            self.words = _Words(self.word, self.words)
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Frees the words that this process remembers."""
    _ENCODERS.clear()


def vocabulary_size(path: str) -> int:
    """Ids that the tokenizer can give, added tokens included."""
    with open(path, encoding="utf-8") as f:
        stated = json.load(f)
    return 1 + max([*stated["model"]["vocab"].values(), *(t["id"] for t in stated["added_tokens"])])
