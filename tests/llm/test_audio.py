import glob
import hashlib
import zlib

import numpy as np
import pyarrow as pa

from shelfwise.llm import audio
from shelfwise.llm.shared import work_dir


def test_payload_and_file_are_lossless():
    for text in (None, "", "a", "x" * 64, "é" * 100, "q" * 100_001):
        data = audio.payload(text)
        assert len(data) % 64 == 0 and len(data) >= 64 and data.rstrip(b"\0") == (text or "").encode()
        assert audio.from_wav(audio.to_wav(data)) == data


def test_resampling_against_its_definition():
    x = np.random.default_rng(1).normal(size=400).astype(np.float32)
    taps = np.zeros(audio.TAPS * audio.UP)
    for p, phase in enumerate(audio.PHASES):
        taps[p :: audio.UP] = phase[::-1]
    got = audio.resample(x)
    for m in (0, 1, 7, 33, 100, 248):
        place, want = m * audio.DOWN, 0.0
        for k in range(len(taps)):  # filter the signal with zeros put in, then keep each DOWN-th
            at = place - k
            if at % audio.UP == 0 and 0 <= at // audio.UP + audio.TAPS // 2 - 1 < len(x):
                want += taps[k] * x[at // audio.UP + audio.TAPS // 2 - 1]
        assert abs(got[m] - want) < 1e-4


def test_bands_follow_pitch_and_segments_follow_energy():
    t = np.arange(5000) / 5000
    low, _ = audio.log_mel(np.sin(2 * np.pi * 200 * t).astype(np.float32))
    high, _ = audio.log_mel(np.sin(2 * np.pi * 2000 * t).astype(np.float32))
    assert low.mean(axis=0).argmax() < high.mean(axis=0).argmax()
    assert audio.segments(np.array([0, 0, 10, 5, 5, 10, 0, 0, 5, 0], float)) == [(2, 6)]


def test_query_on_odd_rows_and_tensors(spark):
    texts = [None, "", "same", "same", "z" * 300_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "n", None)], "doc_id long, text string, feature string")
    rows = {r.doc_id: r for r in audio.audio_digests(docs).collect()}
    for i, text in enumerate(texts):
        data = audio.payload(text)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((text or "").encode()), len(data), hashlib.sha256(data).hexdigest())
        assert r.tail_crc32 == zlib.crc32(data[-64:]) and r.media_sha256 == hashlib.sha256(audio.to_wav(data)).hexdigest()
    assert rows[2][1:] == rows[3][1:] and rows[0][1:] == rows[1][1:]
    assert audio.audio_digests(docs.limit(0)).count() == 0
    folder = work_dir(spark)
    audio.audio_digests(docs, folder=folder).count()
    held = {}
    for path in sorted(glob.glob(folder.removeprefix("file://") + "/tensors/*.arrow")):
        table = pa.ipc.open_file(path).read_all()
        assert table.schema.equals(audio.tensor_schema(pa.int64()))
        values = table["tensor"].combine_chunks().to_numpy_ndarray()
        assert values.shape == (len(table), *audio.SHAPE)
        for i, tensor, start in zip(table["doc_id"].to_pylist(), values, table["start"].to_pylist()):
            held.setdefault(i, []).append((start, tensor))
    for i, text in [*enumerate(texts), (None, "n")]:
        _, tensors, spans, _ = audio.features(audio.payload(text))
        assert [s for s, _ in held[i]] == [a for a, _ in spans] and np.array_equal(np.stack([t for _, t in held[i]]), tensors)


def test_features_equal_their_definition():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 1536, dtype=np.uint8).tobytes()
    x = audio.resample((np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128).astype(float)
    n = 1 + -(-(len(x) - audio.FRAME) // audio.HOP)
    x = np.concatenate([x, np.zeros(n * audio.HOP + audio.FRAME)])
    bands, energy = [], []
    for i in range(n):
        frame = x[i * audio.HOP : i * audio.HOP + audio.FRAME]
        at = np.arange(audio.FRAME)
        power = [abs(np.sum(frame * audio.WINDOW * np.exp(-2j * np.pi * k * at / audio.FRAME))) ** 2 for k in range(audio.FRAME // 2 + 1)]
        bands.append(np.log(np.array(power) @ audio.MEL + 1e-6))
        energy.append(10 * np.log10(np.mean(frame**2) + 1e-9))
    summary, tensors, _, _ = audio.features(data)
    assert np.allclose(tensors.reshape(-1, audio.BANDS)[:n], bands, atol=0.02)
    on, marks = False, []
    high, low = np.mean(energy) + 0.5 * np.std(energy), np.mean(energy) - 0.5 * np.std(energy)
    for e in energy:
        on = e > high or on and e >= low
        marks.append(on)
    starts = sum(b and not a for a, b in zip([False, *marks], marks))
    assert summary.startswith(f"frames={n};segments={starts};active={sum(marks)};")
