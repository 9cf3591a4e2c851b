"""Byte-level BPE by dynamic programming over prefixes.

For a byte string b and a vocabulary of ranked tokens, the encoding of every prefix b[:i] ends with
exactly one token. ``last[i]`` holds it: the only token t that is a suffix of b[:i] and that may
follow ``last[i - len(t)]``, where u may be followed by t if the merges turn the bytes of u and t
into just [u, t]. The encoding of b is read backwards from the end. An append only adds entries;
an edit keeps those before it and, once the tokens beyond it line up again, those after it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.shared import map_batches
from shelfwise.llm.units import UnitStore

#: Entries that a worker keeps; beyond them it starts again, so its memory is bounded.
PIECES, PAIRS, UNITS = 150_000, 600_000, 300_000
#: Pieces that are encoded at once, and bytes beyond which a piece is encoded alone.
AT_ONCE, LONG_PIECE = 20_000, 64


class Vocabulary:
    """Ranked byte tokens, with the checks that the dynamic program needs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        lengths: dict[bytes, set[int]] = {}
        for token in ranks:
            lengths.setdefault(token[-2:], set()).add(len(token))
        self._lengths = {end: tuple(sorted(found, reverse=True)) for end, found in lengths.items()}
        self._pairs: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int]] = {}

    def lengths(self, text: bytes, stop: int) -> tuple[int, ...]:
        """The lengths, longest first, of tokens whose last bytes are those before ``stop``; one byte is one."""
        return self._lengths.get(text[stop - 2 : stop], ()) if stop > 1 else ()

    def merge(self, text: bytes) -> list[int]:
        """The encoding by its definition: of all adjacent pairs, the lowest-ranked merges first."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def may_start(self, token: int) -> bool:
        known = self._alone.get(token)
        if known is None:
            known = self._alone[token] = self.merge(self.tokens[token]) == [token]
        return known

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``; a token of one byte is both of its own."""
        known = self._halves.get(token)
        if known is None:
            text, known = self.tokens[token], (token, token)
            for cut in range(1, len(text)):
                pair = self.ranks.get(text[:cut]), self.ranks.get(text[cut:])
                if None not in pair and max(pair) < token and all(map(self.may_start, pair)) and self._stays(*pair, token):
                    known = pair
                    break
            self._halves[token] = known
        return known

    def _stays(self, left: int, right: int, below: int = 1 << 60) -> bool:
        """Whether no merge of a rank under ``below`` ever joins what lies on both sides of the seam.

        Seen backwards in time: at the seam lie the last piece of the left and the first piece of the
        right token. Had their merge a rank under that of the merge undone last, it came first.
        """
        ranks, tokens = self.ranks, self.tokens
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < below:
                return False
            l_end, r_end = self.halves(left)[1], self.halves(right)[0]
            if left > right and l_end != left or r_end == right:
                if l_end == left:
                    return True
                below, left = left, l_end
            else:
                below, right = right + 1, r_end

    def may_follow(self, before: int, token: int) -> bool:
        key = before << 32 | token
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS // 4:
                self._pairs.clear()
            known = self._pairs[key] = self._stays(before, token)
        return known


class PrefixTable:
    """The last tokens of all prefixes of one byte string, open to appends and edits."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary = vocabulary
        self.text = b""
        self.last: list[int] = [-1]
        self.append(text)

    def _extend(self, stop: int, agreed=None) -> int:
        """Fill entries up to ``stop``; ends early where ``agreed(i)`` holds. Returns the last filled."""
        text, last, v = self.text, self.last, self.vocabulary
        ranks = v.ranks
        while len(last) <= stop:
            i = len(last)
            for n in (*v.lengths(text, i), 1):
                token = ranks.get(text[i - n : i]) if n <= i else None
                if token is not None and (v.may_follow(last[i - n], token) if i > n else v.may_start(token)):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token for byte {text[i - 1]}")
            if agreed and agreed(i):
                return i
        return stop

    def append(self, more: bytes) -> None:
        self.text += more
        self._extend(len(self.text))

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace text[start:stop]. Returns how many entries were computed anew."""
        old, tail = self.last, self.text[stop:]
        self.text = self.text[:start] + new + tail
        self.last = old[: start + 1]
        longest, shift, same = self.vocabulary.longest, stop - start - len(new), 0

        def agreed(i: int) -> bool:  # as many equal entries in a row, past the edit, as a token can reach back
            nonlocal same
            same = same + 1 if i > start + len(new) + longest and self.last[i] == old[i + shift] else 0
            return same >= 2 * longest

        done = self._extend(len(self.text), agreed)
        self.last += old[done + shift + 1 :]
        return done - start

    def ids(self) -> list[int]:
        out, i = [], len(self.text)
        while i:
            out.append(self.last[i])
            i -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


def encode_piece(v: Vocabulary, piece: bytes) -> list[int]:
    """As ``PrefixTable(v, piece).ids()``, in one loop without the table."""
    whole = v.ranks.get(piece)
    if whole is not None:
        return [whole]
    n, ranks = len(piece), v.ranks
    pairs, follow = v._pairs.get, v.may_follow
    last = [-1] * (n + 1)
    for i in range(1, n + 1):
        for size in (*v.lengths(piece, i), 1):
            start = i - size
            token = ranks.get(piece[start:i]) if start >= 0 else None
            if token is None:
                continue
            if start:
                known = pairs(last[start] << 32 | token)
                if known is None:
                    known = follow(last[start], token)
            else:
                known = v.may_start(token)
            if known:
                last[i] = token
                break
        else:
            raise ValueError(f"no token for byte {piece[i - 1]}")
    out, i = [], n
    while i:
        out.append(last[i])
        i -= len(v.tokens[last[i]])
    return out[::-1]


class Trie:
    """All tokens as paths of bytes, in arrays. Node 0 is no node, node 1 the root."""

    def __init__(self, tokens: dict[int, bytes]):
        nodes: dict[bytes, int] = {b"": 1}
        steps = []
        for text in sorted(tokens.values()):
            for n in range(1, len(text) + 1):
                if text[:n] not in nodes:
                    nodes[text[:n]] = len(nodes) + 1
                    steps.append((nodes[text[: n - 1]], text[n - 1], len(nodes)))
        above, byte, node = np.array(steps, np.int64).reshape(-1, 3).T
        inner = np.unique(np.append(above, 1))
        self._row = np.zeros(len(nodes) + 1, np.int32)  # of nodes that go on
        self._row[inner] = np.arange(1, len(inner) + 1)
        self._next = np.zeros((len(inner) + 1, 256), np.int32)
        self._next[self._row[above], byte] = node
        self.token = np.full(len(nodes) + 1, -1, np.int64)
        self.token[[nodes[x] for x in tokens.values()]] = list(tokens)

    def matches(self, data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every token in the data that ends by its start's stop: starts, sizes and tokens."""
        at, node, size, found = np.arange(len(data)), np.ones(len(data), np.int32), 0, []
        while len(at):
            node, size = self._next[self._row[node], data[at + size]], size + 1
            hit = np.flatnonzero(self.token[node] >= 0)
            found.append((at[hit], np.full(len(hit), size), self.token[node[hit]]))
            more = np.flatnonzero((self._row[node] > 0) & (at + size < stops[at]))
            at, node = at[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*found))


class Follows:
    """Which tokens may follow which, for whole arrays of pairs; -1 before a token is a text's beginning."""

    def __init__(self, vocabulary: Vocabulary):
        self._vocabulary, self._new = vocabulary, {}
        self._keys, self._values = np.full(1, -1), np.zeros(1, bool)

    def of(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        keys = (before + 1) << 32 | tokens
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        out = self._values[at]
        for i in np.flatnonzero(self._keys[at] != keys).tolist():
            key = int(keys[i])
            known = self._new.get(key)
            if known is None:
                first, token = (key >> 32) - 1, key & 0xFFFFFFFF
                known = self._new[key] = self._vocabulary._stays(first, token) if first >= 0 else self._vocabulary.may_start(token)
            out[i] = known
        return out

    def settle(self) -> None:
        """Take the pairs that were new into the arrays; beyond ``PAIRS`` start again."""
        if len(self._keys) + len(self._new) > PAIRS:
            self._keys, self._values, self._new = np.full(1, -1), np.zeros(1, bool), {}
        if self._new:
            keys = np.concatenate([self._keys, np.fromiter(self._new.keys(), np.int64, len(self._new))])
            values = np.concatenate([self._values, np.fromiter(self._new.values(), bool, len(self._new))])
            order = np.argsort(keys)
            self._keys, self._values, self._new = keys[order], values[order], {}


class BatchEncoder:
    """The dynamic program over the prefixes of many pieces at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.trie, self.follows = vocabulary, Trie(vocabulary.tokens), Follows(vocabulary)
        self._sizes = np.zeros(max(vocabulary.tokens, default=0) + 1, np.int64)
        for token, text in vocabulary.tokens.items():
            self._sizes[token] = len(text)

    def last_tokens(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The last token of each prefix of each piece, at the place of the prefix's end (from 1)."""
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        starts, sizes, tokens = self.trie.matches(data, bounds[1:][owner])
        ends = starts + sizes
        first = bounds[:-1][owner[starts]]
        order = np.lexsort((-sizes, ends, ends - first))  # by length of prefix, then piece, then longest first
        starts, ends, first, tokens = starts[order], ends[order], first[order], tokens[order]
        length = ends - first
        edges = np.searchsorted(length, np.arange(1, int(np.diff(bounds).max(initial=0)) + 2))
        last = np.full(len(data) + 1, -1)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            todo = np.arange(a, b)
            while len(todo):  # the longest candidate that is left of each prefix
                one = todo[np.append(True, ends[todo[1:]] != ends[todo[:-1]])]
                before = np.where(starts[one] > first[one], last[starts[one]], -1)
                fits = self.follows.of(before, tokens[one])
                last[ends[one[fits]]] = tokens[one[fits]]
                rest = np.ones(b - a, bool)
                rest[one - a] = False
                todo = todo[rest[todo - a] & (last[ends[todo]] < 0)]
        return last

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece; none is empty."""
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), np.uint8)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
        last = self.last_tokens(data, bounds)
        self.follows.settle()
        if (missing := np.flatnonzero(last[1:] < 0)).size:
            raise ValueError(f"no token for byte {data[missing[0]]}")
        own, at, found = np.arange(len(pieces)), bounds[1:].copy(), []
        while len(own):
            tokens = last[at]
            found.append((own, tokens))
            at = at - self._sizes[tokens]
            more = at > bounds[own]
            own, at = own[more], at[more]
        own, tokens = (np.concatenate(x[::-1]) for x in zip(*found))
        order = np.argsort(own, kind="stable")
        tokens, cuts = tokens[order].tolist(), np.cumsum(np.bincount(own, minlength=len(pieces))).tolist()
        return [tokens[a:b] for a, b in zip([0, *cuts], cuts)]


def load_ranks(path: str) -> dict[bytes, int]:
    """Token and rank from each line of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: Patterns whose pieces hold white space only before other characters, one space at most, so that none
#: goes on over the end of a word followed by a space.
BY_UNITS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)


class Codec:
    """Encodes whole texts piece by piece; known pieces and units come from bounded stores."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(load_ranks(path))
        self.pattern = regex.compile(pattern)
        self._known: dict[str, list[int]] = {}
        self._tokens, self._batch = self.vocabulary.tokens, BatchEncoder(self.vocabulary)
        self._units = UnitStore(self._encode_units, UNITS) if pattern in BY_UNITS else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Pieces that are tokens, or known, are looked up; all others are encoded at once."""
        known, ranks = self._known, self.vocabulary.ranks
        if len(known) >= PIECES:
            known.clear()
        pieces = [self.pattern.findall(x) for x in texts]
        new = []
        for piece in {x for part in pieces for x in part if x not in known}:
            raw = piece.encode()
            token = ranks.get(raw)
            if token is not None:
                known[piece] = [token]
            elif len(raw) > LONG_PIECE:
                known[piece] = encode_piece(self.vocabulary, raw)
            else:
                new.append((piece, raw))
        for i in range(0, len(new), AT_ONCE):
            part = new[i : i + AT_ONCE]
            known.update(zip((x for x, _ in part), self._batch.encode([raw for _, raw in part])))
        return [[i for x in part for i in known[x]] for part in pieces]

    def _encode_units(self, units: list[bytes]) -> tuple[list[list[int]], list[bool]]:
        texts = [u.decode() for u in units]
        # white space of other kinds at the end is one piece with what follows
        return self.encode(texts), [u[-1] > 0x20 and x[-1].isspace() for u, x in zip(units, texts)]

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null is empty."""
        if self._units is None:
            yield from (np.array(self.encode([x.as_py() or ""])[0], np.uint32) for x in texts)
            return
        for i, ids, first, whole in self._units.texts(texts):
            for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                yield np.array(self.encode([texts[i + k].as_py()])[0], np.uint32) if whole[k] else ids[a:b]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self._tokens.__getitem__, ids.tolist()))


@cache
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process: its stores serve all tasks that run there."""
    return Codec(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's token ids as packed little-endian 32-bit integers, and their number.

    Returns ``id_col``, ``n_tokens`` and ``ids`` (binary). Null and empty texts have no tokens; texts of
    any length are encoded whole; repeated rows are encoded each; no rows give none; other columns are
    not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            ids = [x.astype("<u4").tobytes() for x in c.encode_all(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [id_col, "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).transform(map_batches, encode, f"`{id_col}` {kind}, n_tokens long, ids binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's number of tokens, SHA-256 of its ids and SHA-256 of what they decode to.

    Null and empty texts give no tokens and the digests of nothing; texts of any length are encoded
    whole; repeated rows are encoded each; no rows give none.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            out = ([], [], [])
            for ids in c.encode_all(batch.column(1)):
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                out[2].append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).transform(map_batches, check, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
