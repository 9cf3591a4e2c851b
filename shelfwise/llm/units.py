"""Token ids of whole texts from those of their distinct units, as NumPy arrays, for use inside tasks.

A unit is a word with the white space (0x20, 0x09 to 0x0D) before it; what follows the last word of a
text is a unit of its own. Units cover a text, so where a tokenizer joins nothing over the end of a word
followed by such white space, the ids of a text are those of its units in turn. Units may also end
between an ASCII letter and some marks, where a tokenizer joins nothing there either: words then keep one
unit, whatever mark follows them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from shelfwise.llm.words import blocks, buffers, word_bounds

#: Bytes of text whose units are told apart at once.
BLOCK = 1 << 21

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def unit_codes(texts: pa.Array, marks: bytes = b"") -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """For one block of texts after the other: the first text's index, where each text's units begin,
    each unit's code, and the distinct units. Units also end between an ASCII letter and one of ``marks``."""
    mark = np.zeros(256, bool)
    mark[list(marks)] = True
    data, bounds = buffers(texts)
    for i, j in blocks(bounds, BLOCK):
        own = bounds[i : j + 1] - bounds[i]
        part = data[bounds[i] : bounds[j]]
        _, ends = word_bounds(part, own)
        edge = np.zeros(len(part) + 1, bool)
        edge[own] = edge[ends] = True
        if marks:
            edge[1:-1] |= _LETTER[part[:-1]] & mark[part[1:]]
        edges = np.flatnonzero(edge)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(part))])
        coded = units.dictionary_encode()
        yield i, np.searchsorted(edges, own), coded.indices.to_numpy(), coded.dictionary.to_pylist()


def ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of begin to begin + size, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


class UnitStore:
    """The ids of units that a worker has met; beyond its bounds it starts again.

    ``encode`` gives the ids of each of some units, and for each whether texts that hold it anywhere
    but at their end must be encoded whole. ``marks`` are those of ``unit_codes``.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[list[list[int]], list[bool]]], units: int, size: int = 1 << 25, marks: bytes = b""):
        self.encode, self.units, self.size, self.marks = encode, units, size, marks
        self._clear()

    def _clear(self) -> None:
        self._slots: dict[bytes, int] = {}
        self._held = 0
        self._ids, self._begins, self._risky = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool)

    def slots(self, distinct: list[bytes]) -> np.ndarray:
        if len(self._slots) > self.units or self._held > self.size:
            self._clear()
        found = list(map(self._slots.get, distinct))
        new = [u for u, slot in zip(distinct, found) if slot is None]
        if new:
            ids, risky = self.encode(new)
            first = len(self._slots)
            self._slots.update(zip(new, range(first, first + len(new))))
            self._held += sum(map(len, new))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for part in ids for x in part), np.uint32, int(sizes.sum()))
            self._ids, self._risky = np.concatenate([self._ids, flat]), np.concatenate([self._risky, np.array(risky, bool)])
            self._begins = np.concatenate([self._begins, self._begins[-1] + np.cumsum(sizes)])
            found = list(map(self._slots.get, distinct))
        return np.array(found, np.int64)

    def texts(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For one block of texts after the other: the first text's index, all ids, where those of each
        text begin, and which texts must be encoded whole."""
        for i, first, codes, distinct in unit_codes(texts, self.marks):
            slots = self.slots(distinct)[codes]
            begins, sizes = self._begins[slots], self._begins[slots + 1] - self._begins[slots]
            ids = self._ids[ranges(begins, sizes)]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            whole = np.zeros(len(first) - 1, bool)
            inner = np.flatnonzero(self._risky[slots])
            if len(inner):
                owner = np.searchsorted(first, inner, "right") - 1
                whole[owner[inner + 1 < first[owner + 1]]] = True
            yield i, ids, ends[first], whole
