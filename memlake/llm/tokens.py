"""Words of many texts as 64-bit hashes, computed on whole Arrow batches."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
CHUNK = 1 << 19
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Words:
    """Hashes of the words of rows ``first`` to ``first + len(bounds) - 2``; row i has bounds[i]:bounds[i+1].

    ``tails``: the last three bytes of each word.
    """

    first: int
    bounds: np.ndarray
    hashes: np.ndarray
    tails: np.ndarray

    def rows(self) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(len(self.bounds) - 1):
            yield self.first + i, self.hashes[self.bounds[i] : self.bounds[i + 1]]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, ASCII capitals like small letters; powers of a random odd number, and inverse."""
    rng = np.random.default_rng(20_26)
    of_byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    of_byte[ord("A") : ord("Z") + 1] = of_byte[ord("a") : ord("z") + 1]
    base = int(rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1
    powers = np.ones(CHUNK + 1, np.uint64)
    powers[1:] = base
    inverse = np.ones(CHUNK + 1, np.uint64)
    inverse[1:] = pow(base, -1, 1 << 64)
    return of_byte, np.multiply.accumulate(powers), np.multiply.accumulate(inverse)


def _hash_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, tail and first byte of each word; a word ends at white space and at the positions in ``cuts``."""
    of_byte, powers, inverse = _tables()
    space = _SPACES[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:] = space[:-1]
    after[:-1] = space[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(of_byte[data] * powers[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
    tails = _LOWER[data[ends - 1]]
    for k in (2, 3):
        tails = tails * np.uint32(256) + np.where(ends - k >= starts, _LOWER[data[np.maximum(ends - k, 0)]], np.uint32(0))
    return mix(hashes), tails, starts


def _hash_long_word(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and tail of one word of any length: its sum is carried over from chunk to chunk."""
    of_byte, powers, _ = _tables()
    every, total, scale = (1 << 64) - 1, len(data), 1
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        total += scale * int(np.add.reduce(of_byte[part] * powers[: len(part)]))
        scale = scale * int(powers[CHUNK]) & every
    tail = 0
    for byte in data[: -4 : -1].tolist():
        tail = tail * 256 + int(_LOWER[byte])
    return mix(np.array([total & every], np.uint64)), np.array([tail], np.uint32)


def _long_text(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and tails of the words of a long text, in parts that end at white space."""
    while len(data) > CHUNK:
        gaps = np.flatnonzero(_SPACES[data[:CHUNK]])
        if len(gaps):
            cut = int(gaps[-1]) + 1
            yield _hash_words(data[:cut], np.empty(0, np.int64))[:2]
        else:
            # No part holds the end of this word, so it is hashed by itself.
            cut = CHUNK
            while cut < len(data) and not (gaps := np.flatnonzero(_SPACES[data[cut : cut + CHUNK]])).size:
                cut += CHUNK
            cut = min(cut + int(gaps[0]) if cut < len(data) else cut, len(data))
            yield _hash_long_word(data[:cut])
        data = data[cut:]
    yield _hash_words(data, np.empty(0, np.int64))[:2]


def words_of(texts: pa.Array) -> Iterator[Words]:
    """Words between ASCII white space of all texts, A to Z like a to z. A null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        upto = int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1
        if upto <= at:
            parts = list(_long_text(data[offsets[at] : offsets[at + 1]]))
            hashes, tails = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
            yield Words(at, np.array([0, len(hashes)]), hashes, tails)
            at += 1
            continue
        upto = min(upto, len(texts))
        cuts = offsets[at : upto + 1] - offsets[at]
        hashes, tails, starts = _hash_words(data[offsets[at] : offsets[upto]], cuts)
        yield Words(at, np.searchsorted(starts, cuts), hashes, tails)
        at = upto


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words in order; fewer words are one run, no words none."""
    if not len(words):
        return words
    if len(words) < size:
        size = len(words)
    h = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k]
        h ^= h >> np.uint64(31)
    return mix(h + np.uint64(size))
