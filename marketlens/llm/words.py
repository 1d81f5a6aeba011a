"""Words of whole text batches as positions and hashes, for both word definitions of the dedup operators."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from marketlens.llm.common import BYTE_CODES, mix, prefix_hash, slice_hash

#: A-Z to a-z, byte by byte; bytes of longer UTF-8 characters stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes after lower-casing: digits, a-z and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Word bytes: all but blank and the five ASCII control characters that count as white space.
SOLID = np.ones(256, bool)
SOLID[0x20] = False
SOLID[0x09:0x0E] = False

_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Words:
    """Words of a chunk of documents: byte slices of `lower`, hashes, and first[i]:first[i+1] of document i."""

    lower: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, a: int, b: int) -> str:
        """Words a..b-1 joined by single blanks."""
        return b" ".join(self.lower[self.start[i] : self.stop[i]].tobytes() for i in range(a, b)).decode("utf-8", "replace")

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the n words from each word on, mask of those that end in their document)."""
        count = len(self.hashes)
        if count < n:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.zeros(count - n + 1, np.uint64)
        for i in range(n):
            out = out * _MULTIPLIER + self.hashes[i : count - n + 1 + i]
        document = self.document
        return mix(out), document[: count - n + 1] == document[n - 1 :]


def split_words(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> Words:
    """Words of documents data[offsets[i]:offsets[i+1]]; no word crosses documents."""
    lower = LOWER[data]
    inside = solid[lower]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # The edges of documents cut words.
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = slice_hash(prefix_hash(BYTE_CODES[lower]), start, stop)
    return Words(lower, start, stop, hashes, np.searchsorted(start, offsets))
