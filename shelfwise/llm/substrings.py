"""Removal of passages that occur in an earlier document, by level-wise doubling.

A window is a run of ``window`` words. The first level looks at runs of about half its length, and
only at one in each window: the run whose hash is least (the window's anchor; equal windows have
equal anchors). Windows whose anchor occurs once in the corpus are done with. For the others, the run
around the anchor is doubled in length and looked up again, until it is the whole window or no window
is left. Whole windows are looked up by a cryptographic digest of their words, so only equal ones meet. So each level hashes and shuffles only what was repeated on the level before.

Texts are packed into units of consecutive documents, written once to the shared folder. On each
level every unit asks about its distinct hashes, in buckets by hash; a bucket's task compares what
all units ask and answers with one bit for each hash. A passage that a third of all documents share
is therefore one entry for each unit, never a row for each document, and texts aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from numpy.lib.stride_tricks import sliding_window_view
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.shared import map_batches, materialize, tasks, work_dir
from shelfwise.llm.words import Words, blocks, buffers, word_bounds, word_hashes

WINDOW = 13
#: Bytes of text in a unit; a longer document is a unit of its own.
UNIT = 1 << 20

_U = np.uint64
_NONE = _U(2**64 - 1)


def lengths(window: int) -> list[int]:
    """Lengths of the levels: the last is the window, each other at least half of the next; at least
    seven words, where the window allows."""
    out = [window]
    while out[0] > 7:
        out.insert(0, -(-out[0] // 2))
    return out if len(out) > 1 or window < 2 else [-(-window // 2), window]


@dataclass
class Unit:
    """A unit's words and its windows that may be repeated: their starts and anchors, as word numbers."""

    words: Words
    docs: np.ndarray
    starts: np.ndarray
    anchors: np.ndarray
    window: int

    @staticmethod
    def of(text: bytes, bounds: np.ndarray, docs: np.ndarray, known: np.ndarray, window: int) -> Unit:
        """``docs``: each text's document id; ``known``: whether it has one."""
        data = np.frombuffer(text, np.uint8)
        starts, ends = word_bounds(data, bounds)
        hashes = np.empty(len(starts), np.uint64)
        for i, j in blocks(bounds):  # by blocks, so that the arrays over bytes stay small
            lo, hi = np.searchsorted(starts, bounds[[i, j]])
            part = data[bounds[i] : bounds[j]]
            hashes[lo:hi] = word_hashes(part, starts[lo:hi] - bounds[i], ends[lo:hi] - bounds[i])
        words = Words(data, bounds, starts, ends, np.searchsorted(starts, bounds), hashes)
        owner = np.repeat(np.arange(len(docs)), words.counts)
        unit = Unit(words, docs[owner], np.zeros(0, np.int64), np.zeros(0, np.int64), window)
        last = np.repeat(words.first[1:], words.counts) - window
        at = np.flatnonzero((np.arange(len(hashes)) <= last) & known[owner])
        if len(at):
            short = lengths(window)[0]
            grams = unit.hashes(short, np.arange(len(hashes)))
            unit.starts, unit.anchors = at, sliding_window_view(np.append(grams, np.full(window, _NONE)), window - short + 1)[at].argmin(axis=1) + at
        return unit

    def hashes(self, length: int, at: np.ndarray) -> np.ndarray:
        """Hash of the run of ``length`` words from each of ``at``; of runs past a text's end, the greatest."""
        if self.__dict__.get("runs", (0,))[0] != length:
            full = np.full(len(self.words.hashes), _NONE)
            begin, found = self.words.windows(length)
            full[begin] = found
            self.runs = length, full
        return self.runs[1][at]

    def digests(self, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of a cryptographic digest of the words of each run: it stands for them."""
        text, begins = self.words.joined()
        text = memoryview(text)
        ends = begins[at + length].tolist()
        both = b"".join([blake2b(text[a:b], digest_size=16).digest() for a, b in zip(begins[at].tolist(), ends)])
        halves = np.frombuffer(both, "<u8").reshape(-1, 2)
        return halves[:, 0], halves[:, 1]

    def asked(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the run that a level looks up begins, for each window: around the anchor, within the window."""
        sizes = lengths(self.window)
        grown = self.anchors - (sizes[level] - sizes[0]) // 2
        return np.clip(grown, self.starts, self.starts + self.window - sizes[level]) if level else self.anchors

    def question(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The level's distinct hashes in order, each one's least document, and each window's place among
        them. On the last level, which decides, they are digests of the words themselves."""
        at, length = self.asked(level), lengths(self.window)[level]
        docs = self.docs[at]
        if level == len(lengths(self.window)) - 1:
            keys, more = self.digests(length, at)
        else:
            keys = self.hashes(length, at)
            more = np.zeros(len(keys), np.uint64)
        order = np.lexsort((docs, more, keys))
        k, m, d = keys[order], more[order], docs[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
        place = np.empty(len(k), np.int64)
        place[order] = np.cumsum(fresh) - 1
        table = np.empty(int(fresh.sum()), _KEY)
        table["key"], table["more"] = k[fresh], m[fresh]
        return table, d[fresh], place

    def keep(self, level: int, bits: np.ndarray) -> None:
        """Go on with the windows whose run another unit has, or another document of this one."""
        table, least, place = self.question(level)
        docs = self.docs[self.asked(level)]
        several = np.zeros(len(table), bool)
        several[place[docs > least[place]]] = True
        stay = (bits[: len(table)] | several)[place] if len(place) else np.zeros(0, bool)
        self.starts, self.anchors = self.starts[stay], self.anchors[stay]

    def removed(self, bits: np.ndarray) -> np.ndarray:
        """Of each word, whether a window over it also starts in a document before its own."""
        table, least, place = self.question(len(lengths(self.window)) - 1)
        covered = bits[: len(table)][place] | (self.docs[self.starts] > least[place]) if len(place) else np.zeros(0, bool)
        change = np.zeros(len(self.words.starts) + 1, np.int64)
        np.add.at(change, self.starts[covered], 1)
        np.add.at(change, self.starts[covered] + self.window, -1)
        return np.cumsum(change)[:-1] > 0


_KEY = np.dtype([("key", "<u8"), ("more", "<u8")])


def _pack(id_at: int, text_at: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, bounds = buffers(batch.column(text_at))
            others = pa.StructArray.from_arrays([c for i, c in enumerate(batch.columns) if i != text_at], fields=[f for i, f in enumerate(batch.schema) if i != text_at])
            nulls = batch.column(text_at).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(id_at)
            for i, j in blocks(bounds, UNIT):
                rows = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), others.slice(i, j - i))
                docs = ids.slice(i, j - i)
                binary = [data[bounds[i] : bounds[j]].tobytes(), (bounds[i : j + 1] - bounds[i]).astype("<i8").tobytes(), docs.fill_null(0).to_numpy().astype("<i8").tobytes(), docs.is_valid().to_numpy(zero_copy_only=False).tobytes(), nulls[i:j].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), *(pa.array([b], pa.binary()) for b in binary), rows], ["part", "unit", *_UNIT, "rows"])
                number += 1

    return pack


_UNIT = ("text", "bounds", "docs", "known", "nulls")
_QUESTION = "bucket int, part int, unit int, keys binary, base long, least binary"


def _open(row: dict, window: int) -> Unit:
    return Unit.of(row["text"], np.frombuffer(row["bounds"], "<i8"), np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["known"], bool), window)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(len(batch)):
        yield {name: batch.column(name)[i].as_py() for name in ("part", "unit", *_UNIT)}


class Answers:
    """The bits for the units of one part, read from where a level has put them."""

    def __init__(self, folders: list[str]):
        self.folders, self.part, self.found = folders, None, []

    def of(self, part: int, unit: int, level: int) -> np.ndarray:
        if part != self.part:
            self.part, self.found = part, [self._read(f"{x}/part={part}") for x in self.folders]
        pieces = self.found[level].get(unit, [])
        return np.concatenate([np.unpackbits(np.frombuffer(bits, np.uint8), count=n) for _, n, bits in sorted(pieces)]).astype(bool) if pieces else np.zeros(0, bool)

    @staticmethod
    def _read(uri: str) -> dict[int, list[tuple[int, int, bytes]]]:
        filesystem, path = fs.FileSystem.from_uri(uri)
        out: dict[int, list[tuple[int, int, bytes]]] = {}
        if filesystem.get_file_info(path).type == fs.FileType.Directory:
            for info in filesystem.get_file_info(fs.FileSelector(path)):
                if info.path.endswith(".parquet"):
                    with filesystem.open_input_file(info.path) as f:
                        for unit, bucket, n, bits in zip(*(c.to_pylist() for c in pq.read_table(f, columns=["unit", "bucket", "n", "bits"]).columns)):
                            out.setdefault(unit, []).append((bucket, n, bits))
        return out


def _ask(level: int, window: int, folders: list[str], bits: int):
    final = level == len(lengths(window)) - 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Answers(folders)
        for batch in batches:
            for row in _rows(batch):
                unit = _open(row, window)
                for k in range(level):
                    unit.keep(k, answers.of(row["part"], row["unit"], k))
                table, least, _ = unit.question(level)
                if not len(table):
                    continue
                bucket = (table["key"] >> _U(64 - bits)).astype(np.int64)
                edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() + [len(table)]
                base = int(least.min()) if final else 0
                away = least - base if final else least
                kind = "<u4" if final and int(away.max()) < 1 << 32 else "<u8"
                pieces = [(a, b) for a, b in zip(edges, edges[1:])]
                n = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(bucket[a]) for a, _ in pieces], pa.int32()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["unit"]] * n, pa.int32()),
                        pa.array([(table[a:b] if final else table["key"][a:b]).tobytes() for a, b in pieces], pa.binary()), pa.array([base] * n, pa.int64()),
                        pa.array([away[a:b].astype(kind).tobytes() if final else b"" for a, b in pieces], pa.binary()),
                    ],
                    [x.split()[0] for x in _QUESTION.split(", ")],
                )

    return ask


def answer_bucket(rows: list[tuple[bytes, int, bytes]], final: bool) -> list[np.ndarray]:
    """For each unit's hashes of one bucket: whether another unit has the hash too; on the last level,
    whether one with an earlier document has it."""
    tables = [np.frombuffer(k, _KEY if final else "<u8") for k, _, _ in rows]
    sizes = [len(t) for t in tables]
    both = np.concatenate(tables)
    if final:
        docs = np.concatenate([np.frombuffer(d, f"<u{len(d) // n}").astype(np.int64) + base for (_, base, d), n in zip(rows, sizes)])
        order = np.lexsort((docs, both["more"], both["key"]))
        k, m = both["key"][order], both["more"][order]
        fresh = np.append(True, (k[1:] != k[:-1]) | (m[1:] != m[:-1]))
        least = docs[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        yes = least < docs[order]
    else:
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        yes = np.append(same, False) | np.append(False, same)
    out = np.empty(len(both), bool)
    out[order] = yes
    return np.split(out, np.cumsum(sizes)[:-1])


def _answer(final: bool):
    """Over rows sorted by bucket."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                found = answer_bucket([r[2:] for r in rows], final)
                columns = [[r[0] for r in rows], [r[1] for r in rows], [bucket] * len(rows), [len(x) for x in found], [np.packbits(x).tobytes() for x in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["part", "unit", "bucket", "n", "bits"])

        for batch in batches:
            for at, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "unit", "keys", "base", "least"))):
                if at != bucket:
                    yield from flush()
                    bucket, rows = at, []
                rows.append(tuple(row))
        yield from flush()

    return answer


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", layout: bool = True) -> DataFrame:
    """For each row: ``row``, a struct of its columns with the removed words cut out of the text;
    ``n_words``; ``n_removed``; ``spans``, the removed runs of words as [start, stop).

    With ``layout`` the kept words stand in the white space that they had, each removed run taking
    along what follows it; else they are joined by one space.

    A word goes if a window over it also starts in a document of a smaller id. Windows are those of the
    input, words are compared as they are. A null text has no words (and stays null); rows without id
    neither lose words nor take any from others; rows of one id take nothing from each other. A table
    without rows gives none. A text longer than a unit is a unit of its own, read whole. Other columns stay in
    ``row``, whatever their names.
    """
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession)
    columns = docs.columns
    docs = docs.withColumn(id_col, F.col(id_col).cast("long"))
    id_at, text_at = columns.index(id_col), columns.index(text_col)
    others = T.StructType([f for f in docs.schema.fields if f.name != text_col])
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("unit", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in _UNIT], T.StructField("rows", T.ArrayType(others))])
    units = materialize(docs.transform(map_batches, _pack(id_at, text_at), schema), f"{folder}/units")

    bits = max(4, (2 * tasks(spark) - 1).bit_length())
    size = units.agg(F.sum(F.length("text"))).first()[0] or 0
    while (size >> bits) > (64 << 20):  # a bucket holds the hashes of so much text
        bits += 1
    levels, folders = lengths(window), []
    asking = units.select("part", "unit", *_UNIT)
    for level in range(len(levels)):
        questions = asking.transform(map_batches, _ask(level, window, folders, bits), _QUESTION)
        dealt = questions.repartition(tasks(spark), "bucket").sortWithinPartitions("bucket")
        answers = dealt.transform(map_batches, _answer(level == len(levels) - 1), "part int, unit int, bucket int, n int, bits binary")
        answers.repartition(tasks(spark), "part").write.partitionBy("part").parquet(f"{folder}/level{level}")
        folders.append(f"{folder}/level{level}")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Answers(folders)
        for batch in batches:
            for i, row in enumerate(_rows(batch)):
                unit = _open(row, window)
                for k in range(len(levels) - 1):
                    unit.keep(k, answers.of(row["part"], row["unit"], k))
                gone = unit.removed(answers.of(row["part"], row["unit"], len(levels) - 1))
                first, bounds = unit.words.first, np.frombuffer(row["bounds"], "<i8")
                nulls = np.frombuffer(row["nulls"], bool)
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[first[1:]] - total[first[:-1]]
                texts, spans = [], []
                for d in range(len(first) - 1):
                    text, own = row["text"][bounds[d] : bounds[d + 1]], []
                    words = [] if layout else text.split()
                    if removed[d]:
                        lost = gone[first[d] : first[d + 1]]
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], lost, [0]]))).tolist()
                        own = [{"start": a, "stop": b} for a, b in zip(edge[::2], edge[1::2])]
                        if layout:
                            begins = np.append(unit.words.starts[first[d] : first[d + 1]] - bounds[d], len(text)).tolist()
                            at, pieces = 0, []
                            for span in own:
                                pieces.append(text[at : begins[span["start"]]])
                                at = begins[span["stop"]]
                            text = b"".join([*pieces, text[at:]])
                        else:
                            words = compress(words, (~lost).tolist())
                    texts.append(None if nulls[d] else text if layout else b" ".join(words))
                    spans.append(own)
                values = batch.column("rows")[i].values
                parts = {f.name: values.field(k) for k, f in enumerate(others.fields)} | {text_col: pa.array(texts, pa.binary()).cast(pa.string())}
                struct = pa.StructArray.from_arrays([parts[c] for c in columns], names=columns)
                span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays([struct, pa.array(unit.words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span)], ["row", "n_words", "n_removed", "spans"])

    result = T.StructType([T.StructField("row", docs.schema), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])))])
    return units.transform(map_batches, finish, result)


def repeat_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, the SHA-256 of the kept words joined by one space."""
    found = remove_repeats(docs.select("doc_id", "text"), window, layout=False)
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2(F.coalesce("row.text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
