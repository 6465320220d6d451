"""Word and shingle hashes of a batch of whole texts, vectorised over the batch's UTF-8 bytes.

Words are maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``; as these are ASCII,
cutting the UTF-8 bytes equals cutting the code points. Nothing is cut short: a text of any
length is hashed whole, in pieces of about ``PIECE`` bytes, so that working memory stays small.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 17
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_AS_IS = np.arange(1, 257, dtype=np.uint64)
_AS_IS[SPACE] = 0
_LOWER = _AS_IS.copy()
_LOWER[65:91] = _AS_IS[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """Words of a batch: byte ``starts`` and ``ends``, and ``first[i]:first[i+1]`` are text ``i``'s."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word's bytes, with A-Z read as a-z if ``lower``."""
        table, out = (_LOWER if lower else _AS_IS), np.empty(len(self.starts), np.uint64)
        longest = int((self.ends - self.starts).max(initial=0))
        powers = np.cumprod(np.full(longest + 1, _BASE, np.uint64))
        at, total = 0, len(self.starts)
        while at < total:
            until = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + PIECE, "right")))
            low, high = self.starts[at], self.ends[until - 1]
            begin = self.starts[at:until] - low
            place = np.arange(high - low)
            place -= np.repeat(begin, np.diff(begin, append=high - low))
            np.minimum(place, longest, out=place)  # white space, which counts for nothing
            terms = table[self.data[low:high]]
            terms *= powers[place]
            out[at:until] = np.add.reduceat(terms, begin)
            at = until
        return mix(out)


def words_of(texts: pa.Array) -> Words:
    """The words of an Arrow string array; a null counts as an empty text."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()).fill_null("")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0]:offsets[-1]] if len(texts) else np.empty(0, np.uint8)
    offsets = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
    word = np.zeros(len(data) + 1, bool)
    word[:-1] = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge))
    ends = np.flatnonzero(before & (~word | edge))
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def shingles_of(word_hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``size`` words, and where each text's begin.

    A text of fewer words, but one at least, has its whole sequence as one shingle.
    """
    counts = np.diff(first)
    own = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(own)))
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], own)
    left = np.repeat(first[1:], own) - at
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = left > k
        if inside.all():
            out = (out + word_hashes[at + k]) * _STEP
        else:
            out[inside] = (out[inside] + word_hashes[at[inside] + k]) * _STEP
    return mix(out), begin
