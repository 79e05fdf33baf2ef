"""CRC-32 of runs of words, for whole batches at once.

The CRC of a joined text follows from those of its parts: that of the first is carried over the second's length, which is linear
in its bits, and the second's is added. So each distinct word is hashed once and runs of words cost a few table look-ups.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np

#: Lengths with a table of their own; longer words go bit by bit of their length.
TABLES = 64
KEPT_WORDS = 1 << 19


def _bytes_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    return crc


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """(tables of 0 to TABLES - 1 bytes, tables of 1, 2, 4, 8... bytes): what each byte of a CRC becomes."""
    step = _bytes_table()
    start = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    small = [start]
    for _ in range(TABLES - 1):
        small.append((small[-1] >> np.uint32(8)) ^ step[small[-1] & 255])
    powers = [small[1]]
    for _ in range(31):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.stack(small), powers


_SMALL, _POWERS = _tables()


def carried(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRCs carried over so many bytes each."""
    near = np.minimum(sizes, TABLES - 1)
    out = _SMALL[near, 0, crc & 255] ^ _SMALL[near, 1, (crc >> 8) & 255] ^ _SMALL[near, 2, (crc >> 16) & 255] ^ _SMALL[near, 3, crc >> 24]
    far = np.flatnonzero(sizes >= TABLES)
    if len(far):
        left, value = sizes[far].astype(np.int64), crc[far]
        for bit, table in enumerate(_POWERS):
            value = np.where((left >> bit) & 1, _apply(table, value), value)
        out[far] = value
    return out


class Words(dict):
    """Numbers of words (bytes), with what is needed to hash runs of them. Forgotten once there are too many."""

    def __init__(self, kept: int = KEPT_WORDS):
        super().__init__()
        self.kept = kept
        self.crc, self.after, self.size = array("I"), array("I"), array("q")

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.crc)
        self.crc.append(zlib.crc32(word))
        self.after.append(zlib.crc32(b" " + word))
        self.size.append(len(word))
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers; those given before hold no longer."""
        if len(self) > self.kept:
            self.clear()
            self.crc, self.after, self.size = array("I"), array("I"), array("q")
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def first(self, numbers: np.ndarray) -> np.ndarray:
        """CRCs of the words alone."""
        return np.frombuffer(self.crc, np.uint32)[numbers] if len(numbers) else np.zeros(0, np.uint32)

    def joined(self, crc: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """CRCs of texts, given theirs, with a space and a word after them."""
        if not len(numbers):
            return np.zeros(0, np.uint32)
        return carried(crc, np.frombuffer(self.size, np.int64)[numbers] + 1) ^ np.frombuffer(self.after, np.uint32)[numbers]
