"""Words of many texts at once, as numbers: split and named by Arrow, no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on at a time; a longer text is worked on alone.
CHUNK = 4 << 20


@dataclass(frozen=True)
class Words:
    """codes: the words of all texts in order, as places in vocabulary; text i has codes[ends[i] : ends[i + 1]]."""

    codes: np.ndarray
    ends: np.ndarray
    vocabulary: pa.Array

    def hashes(self) -> np.ndarray:
        """Two 64-bit hashes a word."""
        digest = xxhash.xxh3_128_digest
        known = np.frombuffer(b"".join(digest(w) for w in self.vocabulary.to_pylist()), "<u8").reshape(-1, 2)
        return known[self.codes]


def split(texts: pa.Array) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of every text (string or binary holding UTF-8); null has none."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    flat, bounds = parts.values, parts.offsets.to_numpy()
    flat = flat.slice(bounds[0], bounds[-1] - bounds[0])
    word = np.not_equal(pc.binary_length(flat).to_numpy(zero_copy_only=False), 0)
    before = np.r_[0, np.cumsum(word)]
    named = flat.dictionary_encode()
    codes = named.indices.to_numpy(zero_copy_only=False)[word]
    return Words(codes, before[bounds - bounds[0]], named.dictionary)


def chunks(batch: pa.RecordBatch, text: int, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    number = (np.cumsum(lengths, dtype=np.int64) - lengths) // size
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else []
    for a, b in zip(starts, [*starts[1:], len(number)], strict=True):
        yield batch.slice(a, b - a)


class Ranges:
    """Hashes of any range of a sequence of words: two polynomials modulo 2^64 over the words' own hashes."""

    #: Odd and 5 modulo 8, so that powers differ in their low bits.
    FACTORS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums, self.back = [], []
        for i, factor in enumerate(self.FACTORS):
            power = np.r_[np.uint64(1), np.multiply.accumulate(np.full(n, factor, np.uint64))]
            self.sums.append(np.r_[np.uint64(0), np.cumsum(hashes[:, i] * power[:n], dtype=np.uint64)])
            inverse = np.uint64(pow(factor, -1, 1 << 64))
            self.back.append(np.r_[np.uint64(1), np.multiply.accumulate(np.full(n, inverse, np.uint64))])

    def of(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        found = (self.sums[which][end] - self.sums[which][start]) * self.back[which][start]
        return mixed(found + (end - start).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
