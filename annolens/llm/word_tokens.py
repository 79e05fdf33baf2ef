"""Ids of the word tokenizer, as little-endian unsigned 32-bit integers.

The tokenizers library is the reference. In this vocabulary white space only separates and words are merged one by
one, so texts in Latin-1 are split into the library's words here, each distinct word is merged once by tiktoken's core (under
ranks read from the tokenizer file's merges; a byte that UTF-8 never uses stands for the end of a word) and kept in a bounded
memory. All other texts go chunk by chunk, those that Latin-1 cannot write through the library itself, as do texts with
the control characters that only Python counts as space. The driver encodes a sample of the vocabulary both ways,
and if any id differs everything goes through the library. A special token that a text spells out is that token, as in the library.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable
from functools import cache, cached_property

import numpy as np
import tiktoken

# Word ends: a byte that no UTF-8 text holds.
_END = b"\xff"
# The library's threads would compete with Spark's tasks.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

KEPT_WORDS = 150_000
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def _latin(*kinds: str) -> str:
    """The Latin-1 characters of general categories, as the inside of a character class."""
    return "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] in kinds)


# The tokenizer's word pattern over Latin-1 alone, commonest words first; white space there is Unicode's.
_SPACE = "\t\n\v\f\r \x85\xa0"
_WORDS = re.compile(f"[{_latin('L')}]+|[{_latin('N')}]|'(?:s|t|re|ve|m|ll|d)|[^{_SPACE}{_latin('L', 'N')}]+")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, others follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Memory(dict):
    """Ids by word: an unknown word is merged when it is asked for, and kept while there is room."""

    def __init__(self, merged: Callable[[str], bytes], kept: int):
        super().__init__()
        self.merged, self.kept = merged, kept

    def __missing__(self, word: str) -> bytes:
        found = self.merged(word)
        if len(self) < self.kept and len(word) <= 64:
            self[word] = found
        return found


class WordTokenizer:
    def __init__(self, path: str, kept: int = KEPT_WORDS, exact: bool | None = None):
        """exact: what an earlier load has found; unless it is given, the two ways are compared now."""
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.memory = _Memory(self._merged, kept)
        self._load_ranks(spec["model"])
        # Added tokens stand for themselves wherever a text spells them out, and cut the text before anything else is done to it.
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        self.cuts = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})" if self.added else "(?!)")
        #: One more than the largest id.
        self.size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.exact = self._agrees(spec["model"]["vocab"]) if exact is None else exact

    @cached_property
    def library(self):
        """The tokenizers library's own object, which few texts need."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _agrees(self, vocabulary: dict[str, int]) -> bool:
        words = [w[:-4] for w in vocabulary if w.endswith("</w>")]
        sample = [w for w in words if w.isascii() and w.isalpha() and w.islower()][::16]
        return [self._merged(w) for w in sample] == [self._by_library(w) for w in sample]

    def _load_ranks(self, model: dict) -> None:
        alphabet, suffix = _byte_alphabet(), model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            ends = token.endswith(suffix)
            return bytes(alphabet[c] for c in (token[: -len(suffix)] if ends else token)) + _END * ends

        ranks = {bytes([b]): b for b in range(256)}
        # A last character and its word end are one symbol from the start, so they merge before anything else.
        for b in range(255):
            ranks[bytes([b]) + _END] = len(ranks)
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            ranks.setdefault(raw(left + right), len(ranks))
        self.core = tiktoken.Encoding("word", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})._core_bpe
        ids = np.full(len(ranks), -1, np.int64)
        for token, number in model["vocab"].items():
            if not token.startswith("<|") and (found := ranks.get(raw(token))) is not None:
                ids[found] = number
        self.bytes = [x.tobytes() for x in ids.astype("<u4")]

    def _by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, word: str) -> bytes:
        table = self.bytes
        return b"".join([table[k] for k in self.core.encode_single_piece(word.encode() + _END)])

    def _latin_ids(self, text: str) -> bytes:
        return b"".join(map(self.memory.__getitem__, _WORDS.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        if self.cuts.search(text):
            return b"".join([self.added.get(x) or self._between(x) for x in self.cuts.split(text) if x])
        return self._between(text)

    def _between(self, text: str) -> bytes:
        if not self.exact or _ODD_SPACE.search(text):
            return self._by_library(text)
        if _is_latin(text):
            return self._latin_ids(text)
        return b"".join([self._latin_ids(x) if _is_latin(x) else self._by_library(x) for x in text.split()])


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@cache
def word_tokenizer(path: str, exact: bool | None = None) -> WordTokenizer:
    return WordTokenizer(path, exact=exact)
