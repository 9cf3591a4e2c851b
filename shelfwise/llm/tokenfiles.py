"""Token ids in seekable files: independent Zstandard frames and a trailing seek table.

A file holds, one after the other,

* frames: each the ids of some whole consecutive documents, little-endian, ``width`` bytes each;
* a skippable frame (magic 0x184D2A50) with the directory: ``width`` (u8), number of documents (u64),
  then each document's id (i64), its number of ids (u64), its frame (u32) and a flag byte that is 1
  where the document id is null;
* a skippable frame (magic 0x184D2A5E) with the seek table of the public seekable format: for each
  frame its compressed size, its own size and the lower half of the XXH64 of what it holds (u32
  each), then the number of frames (u32), the descriptor 0x80 (u8) and the magic 0x8F92EAB1.

Any Zstandard decoder can read such a file whole; readers of single documents take the table and the
directory from its end and decompress only the frames they need, each checked against its sum.
"""

from __future__ import annotations

import json
import os
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.shared import map_batches, materialize, tasks, work_dir
from shelfwise.llm.units import UnitStore

#: Ids after which a frame is closed, with the document that it is in.
FRAME_IDS = 1 << 16
DIRECTORY_MAGIC, TABLE_MAGIC, END_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Ids after which a file is closed, with the document that it is in.
FILE_IDS = 1 << 28
#: Distinct units whose ids a worker keeps; beyond them it starts again.
UNITS = 700_000

_ENTRY = np.dtype([("doc_id", "<i8"), ("n_ids", "<u8"), ("frame", "<u4"), ("null", "u1")])
_PACKED = struct.Struct("<qQI?")


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FileWriter:
    """Writes one file under another name and renames it when whole, so that a rerun replaces it."""

    def __init__(self, uri: str, width: int):
        import zstandard

        self.uri, (self._fs, self.path) = uri, _place(uri)
        self._fs.create_dir(os.path.dirname(self.path), recursive=True)
        self._temporary = f"{self.path}.{uuid.uuid4().hex}"
        self._out, self.width = self._fs.open_output_stream(self._temporary), width
        self._zstd = zstandard.ZstdCompressor(level=1)
        self._frames: list[tuple[int, int, int]] = []
        self._entries = bytearray()
        self._open: list[bytes] = []
        self._held = self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.width
        self._entries += _PACKED.pack(doc_id or 0, n, len(self._frames), doc_id is None)
        self._open.append(ids)
        self._held += n
        self.n_ids += n
        if self._held >= FRAME_IDS:
            self._close_frame()

    def _close_frame(self) -> None:
        data = b"".join(self._open)
        packed = self._zstd.compress(data)
        self._out.write(packed)
        self._frames.append((len(packed), len(data), _checksum(data)))
        self._open, self._held = [], 0

    def close(self) -> None:
        if self._open:
            self._close_frame()
        directory = struct.pack("<BQ", self.width, len(self._entries) // _PACKED.size) + self._entries
        table = np.array(self._frames, "<u4").tobytes() + struct.pack("<IBI", len(self._frames), 0x80, END_MAGIC)
        for magic, body in ((DIRECTORY_MAGIC, directory), (TABLE_MAGIC, table)):
            self._out.write(struct.pack("<II", magic, len(body)) + body)
        self._out.close()
        self._fs.move(self._temporary, self.path)


class TokenFile:
    """Reads documents from one file, frame by frame."""

    def __init__(self, uri: str):
        import zstandard

        self._zstd = zstandard.ZstdDecompressor()
        filesystem, path = _place(uri)
        self._in = filesystem.open_input_file(path)
        size = self._in.size()
        n_frames, descriptor, magic = struct.unpack("<IBI", self._in.read_at(9, size - 9))
        if magic != END_MAGIC or descriptor != 0x80:
            raise ValueError(f"{uri} has no seek table")
        at = size - 9 - 12 * n_frames
        self.frames = np.frombuffer(self._in.read_at(12 * n_frames, at), "<u4").reshape(-1, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        at = int(self.offsets[-1])
        magic, length = struct.unpack("<II", self._in.read_at(8, at))
        body = self._in.read_at(length, at + 8)
        self.width, n = struct.unpack("<BQ", body[:9])
        self.entries = np.frombuffer(body[9:], _ENTRY, n)

    def frame(self, k: int) -> np.ndarray:
        size, whole, checksum = map(int, self.frames[k])
        data = self._zstd.decompress(self._in.read_at(size, int(self.offsets[k])), max_output_size=max(whole, 1)) if whole else b""
        if len(data) != whole or _checksum(data) != checksum:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(data, f"<u{self.width}")

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents, with one frame in memory at a time."""
        k, at, ids = -1, 0, np.zeros(0)
        for doc_id, n, frame, null in self.entries.tolist():
            if frame != k:
                k, at, ids = frame, 0, self.frame(frame)
            yield (None if null else doc_id), ids[at : at + n]
            at += n

    def get(self, doc_id: int) -> np.ndarray:
        """The ids of one document: only its frame is decompressed."""
        found = np.flatnonzero((self.entries["doc_id"] == doc_id) & (self.entries["null"] == 0))
        if not len(found):
            raise KeyError(doc_id)
        k = self.entries["frame"][found[0]]
        before = self.entries["n_ids"][np.searchsorted(self.entries["frame"], k) : found[0]].sum()
        return self.frame(int(k))[int(before) : int(before + self.entries["n_ids"][found[0]])]


#: Splits of a text into pieces, all else dropped, that never take white space into a piece.
BY_WORDS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)


def by_units(path: str) -> bool:
    """Whether a tokenizer's file says that it drops white space and joins nothing over it: the ids of a
    text are then those of its units in turn. Files of other kinds are used on whole texts."""
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    steps = parts["normalizer"]["normalizers"] if (parts["normalizer"] or {}).get("type") == "Sequence" else [parts["normalizer"]]
    plain = all(x is None or x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and (x["pattern"], x["content"]) == ({"Regex": r"\s+"}, " ") for x in steps)
    first = parts["pre_tokenizer"] or {}
    rest = first.get("pretokenizers", [first])
    drops = bool(rest) and rest[0].get("type") == "Split" and rest[0]["behavior"] == "Removed" and rest[0]["invert"] and rest[0]["pattern"].get("Regex") in BY_WORDS
    level = all(x.get("type") == "ByteLevel" and not x["add_prefix_space"] for x in rest[1:])
    alone = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or any(c.isspace() for c in x["content"]) for x in parts["added_tokens"])
    return plain and drops and level and alone and parts["truncation"] is None and parts["padding"] is None


def word_marks(path: str) -> bytes:
    """ASCII marks that, after an ASCII letter, always begin a new piece of such a split: no piece holds a
    letter and then a mark, nothing composes with a mark after it, and no added token holds these."""
    with open(path, encoding="utf-8") as f:
        held = "".join(x["content"] for x in json.load(f)["added_tokens"])
    return bytes(ord(c) for c in string.punctuation if c not in held)


class TextEncoder:
    """The tokenizers library, asked once for each distinct unit where the vocabulary allows it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self._tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._units = UnitStore(self._ask, UNITS, marks=word_marks(path)) if by_units(path) else None

    def _ask(self, units: list[bytes]) -> tuple[list[list[int]], list[bool]]:
        ids = []
        for i in range(0, len(units), 50_000):
            ids += [x.ids for x in self._tokenizer.encode_batch_fast([u.decode() for u in units[i : i + 50_000]], add_special_tokens=False)]
        return ids, [False] * len(units)

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, little-endian, ``width`` bytes each; null is empty."""
        kind = f"<u{self.width}"
        if self._units is None:
            for x in texts:
                yield np.array(self._tokenizer.encode(x.as_py() or "", add_special_tokens=False).ids, kind).tobytes()
            return
        for _, ids, first, _ in self._units.texts(texts):
            packed = memoryview(ids.astype(kind)).cast("B")
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                yield packed[a * self.width : b * self.width]


@cache
def encoder(path: str) -> TextEncoder:
    """One encoder for each worker process: its units serve all tasks that run there."""
    return TextEncoder(path)


def write_token_files(docs: DataFrame, folder: str, path: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all documents and write them below ``folder`` in ascending order of their ids.

    One file for each range of ids, or more of ``FILE_IDS`` ids each; returns the manifest: ``part``,
    ``nth`` (the file's place in its range), ``file``, ``n_docs`` and ``n_ids`` (ids of documents, ``end``
    ids counted). The library is used as it is: texts of its special tokens become these. Null texts are
    empty, so they hold ``end`` alone; texts of any length are encoded whole; repeated rows are all
    written, in the order of their texts; null ids come first. No rows: no files. Other columns are not
    read. Ids have 2 bytes each in vocabularies of up to 65,536, else 4.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, tail, nth, n = TaskContext.get().partitionId(), None, b"", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((part, pa.int64()), (nth, pa.int64()), (out.uri, pa.string()), (n, pa.int64()), (out.n_ids, pa.int64()))], ["part", "nth", "file", "n_docs", "n_ids"])

        for batch in batches:
            enc = encoder(path)
            tail = tail or np.array([end], f"<u{enc.width}").tobytes()
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
                out = out or FileWriter(f"{folder}/part-{part:06d}-{nth:04d}.zst", enc.width)
                out.add(doc_id, b"".join((ids, tail)))
                n += 1
                if out.n_ids >= FILE_IDS:
                    yield done()
                    out, nth, n = None, nth + 1, 0
        if out:
            yield done()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(tasks(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    written = ordered.transform(map_batches, write, "part long, nth long, file string, n_docs long, n_ids long")
    return materialize(written, f"{folder}-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Each written document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and
    ``ids_crc32``, the CRC-32 of its ids as little-endian unsigned 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                rows = []
                for doc_id, ids in TokenFile(file).documents():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _as_batch(rows)
                        rows = []
                if rows:
                    yield _as_batch(rows)

    before = F.sum("n_ids").over(Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("start", F.coalesce(before, F.lit(0))).select("file", "start")  # a row for each file
    return files.repartition(tasks(manifest.sparkSession)).transform(map_batches, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_files_round_trip(docs: DataFrame, path: str, end: int, **options) -> DataFrame:
    """Write all documents as files in the shared folder and read them back."""
    return read_token_files(write_token_files(docs, work_dir(docs.sparkSession), path, end, **options))
