"""Words of many texts in flat arrays: runs of ASCII letters and digits, upper and lower case alike, hashed without Python strings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SEP = 0xFF  # occurs in no UTF-8 text
_FOLD = np.zeros(256, np.uint8)
for _r in (range(48, 58), range(97, 123)):
    _FOLD[list(_r)] = list(_r)
_FOLD[65:91] = np.arange(97, 123)
#: For texts of any script: every byte beyond ASCII belongs to a word, and a character of a script written without blanks begins one.
_FOLD_ALL = _FOLD.copy()
_FOLD_ALL[128:_SEP] = np.arange(128, _SEP)
_BEGINS = np.zeros(256, bool)
_BEGINS[0xE3:0xF5] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """Words of a chunk: hash, text number, and byte span in the joined texts."""

    hash: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: bytes
    offset: np.ndarray

    def of(self, i: int) -> list[bytes]:
        """The words of text ``i`` in lower case."""
        lo, hi = np.searchsorted(self.text, i), np.searchsorted(self.text, i, "right")
        return [self.data[a:b].lower() for a, b in zip(self.start[lo:hi].tolist(), self.end[lo:hi].tolist(), strict=True)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def split_words(texts: list[bytes], all_scripts: bool = False) -> Words:
    """All words of texts in UTF-8; every other byte parts words. With ``all_scripts`` letters beyond ASCII are words too, and each ideograph or kana is one."""
    data = bytes([_SEP]).join(texts) + bytes([_SEP])
    offset = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    raw = np.frombuffer(data, np.uint8)
    folded = (_FOLD_ALL if all_scripts else _FOLD)[raw]
    inside = folded != 0
    before = np.append(False, inside[:-1])
    begins = inside & ~before
    if all_scripts:
        begins |= _BEGINS[raw]
    start = np.flatnonzero(begins)
    stop = np.append(start[1:], len(raw))
    # a word ends where the next begins, or at the first byte outside
    outside = np.flatnonzero(~inside)
    end = np.minimum(stop, outside[np.minimum(np.searchsorted(outside, start), max(0, len(outside) - 1))] if len(outside) else stop)
    size = end - start
    if not len(start):
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), start, end, data, offset)
    at = np.flatnonzero(inside)
    within = at - np.repeat(start, size)
    power = np.cumprod(np.full(int(size.max()), _MIX, np.uint64))
    head = np.cumsum(size) - size
    value = np.add.reduceat(folded[at].astype(np.uint64) * power[within], head)
    return Words(mixed(value), np.searchsorted(offset, start, "right") - 1, start, end, data, offset)


def windows(hashes: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of every ``width`` consecutive words of one text: (hash, place of the first word)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    for j in range(width):
        value = value * _MIX + hashes[j : j + n]
    place = np.flatnonzero(text[:n] == text[width - 1 :])
    return mixed(value[place]), place
