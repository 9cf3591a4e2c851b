"""Media columns: byte payloads as 8-bit audio, and features of the audio.

Samples are resampled by a polyphase filter, cut into overlapped frames, and turned into log-mel
bands; frames whose energy passes a high threshold open a segment that lasts until the energy falls
under a low one. Features are held as tensors of one fixed shape, each with its span of time.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shelfwise.llm.shared import map_batches, materialize, work_dir

RATE, UP, DOWN, TAPS = 8000, 5, 8, 16
FRAME, HOP, BANDS = 256, 128, 16
#: Shape of one tensor: frames by bands; the last of a document is filled up with zeros. Two decimals
#: are all that its 16-bit values hold.
SHAPE, VALUES = (64, BANDS), np.float16
#: Frames that are worked on at once.
AT_ONCE = 2048


def payload(text: str | None) -> bytes:
    """UTF-8, filled with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def to_wav(data: bytes) -> bytes:
    """A mono WAV file of unsigned 8-bit samples; ``data`` has even length."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(data))
    return head + data


def from_wav(media: bytes) -> bytes:
    """The samples of such a file, found by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, bits = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            bits = struct.unpack_from("<H", media, at + 22)[0]
        elif name == b"data":
            if bits != 8 or at + 8 + size > len(media):
                raise ValueError("not 8-bit samples, or cut short")
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _phases() -> list[np.ndarray]:
    """The low-pass filter's taps for each of the ``UP`` phases, each summing to 1."""
    n = np.arange(TAPS * UP) - (TAPS * UP - 1) / 2
    taps = np.sinc(n / max(UP, DOWN)) * np.hamming(TAPS * UP)
    return [(taps[p::UP] / taps[p::UP].sum()).astype(np.float32)[::-1].copy() for p in range(UP)]


def _mel_filters() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(RATE * UP / DOWN / 2), BANDS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, DOWN / (RATE * UP))
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid))).T.astype(np.float32)


PHASES, MEL, WINDOW = _phases(), _mel_filters(), np.hanning(FRAME).astype(np.float32)


def resample(samples: np.ndarray) -> np.ndarray:
    """``UP`` / ``DOWN`` times as many samples. Only the taps that meet a sample are computed."""
    n = -(-len(samples) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS // 2, np.float32), samples, np.zeros(TAPS + DOWN, np.float32)])
    out = np.empty(n, np.float32)
    step = padded.strides[0]
    for r in range(min(UP, n)):
        first, count = r * DOWN // UP, -(-(n - r) // UP)
        windows = as_strided(padded[first:], (count, TAPS), (DOWN * step, step))
        out[r::UP] = windows @ PHASES[r * DOWN % UP]
    return out


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel bands and energy in dB of each frame; the last frame is filled up with zeros."""
    n = 1 + max(0, -(-(len(samples) - FRAME) // HOP))
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(samples)] = samples
    bands, energy = np.empty((n, BANDS), np.float32), np.empty(n, np.float32)
    for i in range(0, n, AT_ONCE):
        frames = as_strided(padded[i * HOP :], (min(AT_ONCE, n - i), FRAME), (HOP * 4, 4))
        power = np.abs(np.fft.rfft(frames * WINDOW)).astype(np.float32) ** 2
        bands[i : i + len(frames)] = np.log(power @ MEL + 1e-6)
        energy[i : i + len(frames)] = 10 * np.log10(np.mean(frames * frames, axis=1) + 1e-9)
    return bands, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frames [start, stop) of each segment, by hysteresis around the mean energy."""
    high, low = energy.mean() + 0.5 * energy.std(), energy.mean() - 0.5 * energy.std()
    mark = np.where(energy > high, 1, np.where(energy < low, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def features(data: bytes) -> tuple[str, np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """A summary, the tensors (any number of ``SHAPE``), their spans and those of the segments, in seconds."""
    samples = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    bands, energy = log_mel(resample(samples))
    found, n = segments(energy), len(bands)
    second = HOP * DOWN / (RATE * UP)
    tensors = np.zeros((-(-n // SHAPE[0]) * SHAPE[0], BANDS), VALUES)
    tensors[:n] = bands
    spans = [(i * second, min(i + SHAPE[0], n) * second) for i in range(0, n, SHAPE[0])]
    mean = ",".join(f"{x:.2f}" for x in tensors[:n].mean(axis=0, dtype=np.float64).tolist())  # of what is stored
    summary = f"frames={n};segments={len(found)};active={sum(b - a for a, b in found)};mel={mean}"
    return summary, tensors.reshape(-1, *SHAPE), spans, [(a * second, b * second) for a, b in found]


def store_audio(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``doc_id``, ``n_bytes`` and ``media``, a WAV file for each row, below ``folder``; read it back.

    A null text is empty; an empty one is 64 zero bytes.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                texts = part.column(1).to_pylist()
                sizes = pa.array([len((x or "").encode()) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array([to_wav(payload(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return materialize(docs.select(id_col, text_col).transform(map_batches, store, f"doc_id {kind}, n_bytes long, media binary"), folder)


_DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_SPAN = pa.list_(pa.struct([("start", pa.float64()), ("stop", pa.float64())]))


def tensor_schema(id_type: pa.DataType) -> pa.Schema:
    """What a tensor file holds: a row for each tensor, with its span and the document's segments in it."""
    return pa.schema([("doc_id", id_type), ("start", pa.float64()), ("stop", pa.float64()), ("segments", _SPAN), ("tensor", pa.fixed_shape_tensor(pa.from_numpy_dtype(VALUES), SHAPE))])


class TensorFile:
    """Writes one Arrow file under another name and renames it when whole, so that a rerun replaces it."""

    def __init__(self, uri: str):
        self._fs, self._path = fs.FileSystem.from_uri(uri)
        self._fs.create_dir(os.path.dirname(self._path), recursive=True)
        self._temporary, self._out = f"{self._path}.{uuid.uuid4().hex}", None

    def write(self, ids: pa.Array, found: list[tuple[np.ndarray, list, list]]) -> None:
        """Documents' tensors, spans and segments."""
        schema = tensor_schema(ids.type)
        if self._out is None:
            self._out = pa.ipc.new_file(self._fs.open_output_stream(self._temporary), schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        values = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([t.ravel() for t, _, _ in found])), SHAPE[0] * SHAPE[1])
        rows = [(i, a, b, [{"start": x, "stop": y} for x, y in parts if x < b and y > a]) for i, (_, spans, parts) in zip(ids.to_pylist(), found) for a, b in spans]
        columns = [pa.array(x, f.type) for x, f in zip(zip(*rows), schema)]
        self._out.write_batch(pa.RecordBatch.from_arrays([*columns, pa.ExtensionArray.from_storage(schema.field("tensor").type, values)], schema=schema))

    def close(self) -> None:
        if self._out:
            self._out.close()
            self._fs.move(self._temporary, self._path)


def audio_features(stored: DataFrame, folder: str) -> DataFrame:
    """Of each stored file: digests of it and of its payload, and ``feature``. The tensors are written below
    ``folder`` as Arrow files of ``tensor_schema``, one for each task."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = TensorFile(f"{folder}/part-{TaskContext.get().partitionId():06d}.arrow")
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                rows, found = [], []
                for size, media in zip(part.column(1).to_pylist(), part.column(2)):
                    media = media.as_py()
                    data = from_wav(media)
                    summary, *tensors = features(data)
                    rows.append((size, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), summary))
                    found.append(tensors)
                out.write(part.column(0), found)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, zip(*rows), kinds)], ["doc_id", *(x.split()[0] for x in _DIGESTS.split(", "))])
        out.close()

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n_bytes", "media").transform(map_batches, compute, f"doc_id {kind}, {_DIGESTS}")


def audio_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Store each text as audio in the shared folder, read it back, store its features (``tensors`` below
    ``folder``) and return the digests of ``audio_features``.

    Equal texts give equal values; repeated rows are stored each; no rows give none; texts of any length
    are taken whole, in as many tensors as they need.
    """
    folder = folder or work_dir(docs.sparkSession)
    return audio_features(store_audio(docs, f"{folder}/media", id_col, text_col), f"{folder}/tensors")
