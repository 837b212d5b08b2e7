"""Words of whole texts as 64-bit hashes, and hashes of word windows, computed with numpy on Arrow's own buffers.

Nothing here makes a Python object per word. A hash is a polynomial over the bytes (or over the word hashes)
modulo 2**64 with a final mix; equal hashes are taken for equal words, which is wrong for about one pair
in 2**60.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BYTE, _WORD = 0x9E3779B97F4A7C1B, 0xD6E8FEB86659FD93  # odd, 3 modulo 4: swapped neighbours stay apart
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_PIECE = 1 << 20


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes of words that white space (20, 09-0D) separates, and of words of digits, lower-case letters and all beyond ASCII.
NON_SPACE = ~_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = _class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_LOW = _powers(_BYTE, 4096)
_HIGH = int(_LOW[-1]) * _BYTE % 2**64


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    length = end - start
    out = np.zeros(len(start), np.uint64)
    upto, at = np.cumsum(length), 0
    high = _powers(_HIGH, (int(length.max()) >> 12) + 1) if len(start) else None
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PIECE, "right")))
        if to == at + 1:  # maybe one very long word: piece by piece
            for a in range(0, int(length[at]), _PIECE):
                b = min(a + _PIECE, int(length[at]))
                k = np.arange(a, b)
                out[at] += np.sum((data[start[at] + a : start[at] + b].astype(np.uint64) + np.uint64(1)) * _LOW[k & 4095] * high[k >> 12], dtype=np.uint64)
        else:
            n = length[at:to]
            first = np.cumsum(n) - n
            k = np.arange(int(n.sum())) - np.repeat(first, n)
            value = data[np.repeat(start[at:to], n) + k].astype(np.uint64) + np.uint64(1)
            value *= _LOW[k & 4095]
            if int(n.max()) > 4096:
                value *= high[k >> 12]
            out[at:to] = np.add.reduceat(value, first)
        at = to
    return mixed(out ^ (length.astype(np.uint64) << np.uint64(40)))


@dataclass
class Words:
    """``hash``, ``start`` and ``end`` (byte positions in ``data``) of each word; the words of text i are ``first[i]:first[i + 1]``."""

    data: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self) -> np.ndarray:
        """The text's number, for each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def place(self) -> np.ndarray:
        """The place in its text, for each word."""
        return np.arange(len(self.hash)) - np.repeat(self.first[:-1], self.count)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of k words within a text, and the index of each one's first word."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        inside = self.place() + k <= np.repeat(self.count, self.count)
        return window_hashes(self.hash, k)[inside[: n - k + 1]], np.flatnonzero(inside[: n - k + 1])


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i+k] for each i, by prefix sums."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_WORD, len(h)), dtype=np.uint64)])
    back = _powers(pow(_WORD, -1, 2**64), len(h) - k + 1)
    return mixed((sums[k:] - sums[:-k]) * back)


def sequence_hash(h: np.ndarray) -> int:
    """Hash of a whole sequence; for k words the same as window_hashes(h, k)[0]."""
    return int(mixed(np.array([np.sum(h * _powers(_WORD, len(h)), dtype=np.uint64)]))[0])


def cuts(texts: pa.Array, is_word: np.ndarray = NON_SPACE, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string array without nulls, where its words start and end in them, and the number of each text's first word (and of all words). ``lower``: A-Z are lower-cased first."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    inside = is_word[data]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(len(texts) + 1, np.int64)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return data, start, end, np.searchsorted(start, offsets)


def words(texts: pa.Array, is_word: np.ndarray = NON_SPACE, lower: bool = False) -> Words:
    """Words of a string array without nulls, with their hashes."""
    data, start, end, first = cuts(texts, is_word, lower)
    return Words(data, _span_hashes(data, start, end) if len(start) else np.zeros(0, np.uint64), start, end, first)
