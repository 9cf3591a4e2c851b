"""Words of whole texts as NumPy arrays, for use inside tasks.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D in the UTF-8 text. Hashes depend on nothing
but the bytes, so every task and every run gets the same ones. Those of words are mixed after every
eight bytes; those of runs of words are polynomials of the words' hashes, from prefix sums, then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text for which arrays are held at once; one longer text is taken alone.
BLOCK = 1 << 18

_U = np.uint64
_WORD_BASE = 0xC2B2AE3D27D4EB4F
#: Bytes of a word beyond which the library hashes it.
LONG_WORD = 64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which all bits depend on all."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i up to n, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        up, down = (np.full(n + 1, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if n <= 4 * BLOCK:
            _powers[base] = have
    return have


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span. Up to eight bytes, different words of a length have different ones."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = ends - starts
    out = mix(left.astype(np.uint64) + _U(_WORD_BASE))
    large = np.flatnonzero(left > LONG_WORD)
    for i in large.tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    live = np.flatnonzero(left <= LONG_WORD) if len(large) else np.arange(len(left))
    at, left = starts[live], left[live]
    while len(live):
        out[live] = mix(out[live] ^ (eight[at] & _FIRST_BYTES[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    up, down = powers(base, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


@dataclass
class Words:
    """The words of consecutive texts. ``first[i]`` to ``first[i + 1]`` are those of text i."""

    buffer: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Start (as a word's index) and hash of every run of ``length`` words within one text."""
        n = len(self.hashes)
        last = np.repeat(self.first[1:], self.counts) - length
        at = np.flatnonzero(np.arange(n) <= last)
        return at, mix(_spans(self.hashes, at, at + length, _WORD_BASE))

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all words with one space after each, and where each word begins there."""
        sizes = self.ends - self.starts
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        out = np.full(int(begins[-1]), 0x20, np.uint8)
        body = self.buffer[~SPACE[self.buffer]]
        out[np.arange(len(body)) + np.repeat(np.arange(len(sizes)), sizes)] = body
        return out, begins


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and where each text begins and ends; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``; no word crosses a bound."""
    filled = np.zeros(len(data) + 2, bool)
    np.logical_not(SPACE[data], out=filled[1:-1])
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    begins, stops = filled[1:-1] & ~filled[:-2], filled[1:-1] & ~filled[2:]
    begins[inner] |= filled[1:-1][inner]
    stops[inner - 1] |= filled[1:-1][inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def blocks(bounds: np.ndarray, size: int = BLOCK):
    """Ranges of consecutive texts of about ``size`` bytes."""
    n, i = len(bounds) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_of(texts: pa.Array, lower: bool = False, hashed: bool = True):
    """(index of the first text, Words) for one block of texts after the other."""
    data, bounds = buffers(texts)
    for i, j in blocks(bounds):
        own = bounds[i : j + 1] - bounds[i]
        part = data[bounds[i] : bounds[j]]
        part = _LOWER[part] if lower else part
        starts, ends = word_bounds(part, own)
        yield i, Words(part, own, starts, ends, np.searchsorted(starts, own), word_hashes(part, starts, ends) if hashed else None)
