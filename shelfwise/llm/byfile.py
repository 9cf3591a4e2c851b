"""Rows chosen by id without a shuffle of the rows: each file of the table has a list of ids in the shared
folder, and the task that reads a file reads its list. Only ids are ever shuffled, at any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.shared import map_batches, materialize, tasks


def scanned(docs: DataFrame, folder: str) -> tuple[DataFrame, Column]:
    """A table whose rows know the file they are read from, and that file's number: ``docs`` itself if it
    is read from files, else a copy below ``folder``."""
    number = lambda df: F.xxhash64(df.metadataColumn("_metadata")["file_path"])
    try:
        docs.select(number(docs)).schema  # noqa: B018
    except AnalysisException:
        docs = materialize(docs, folder)
    return docs, number(docs)


def write_lists(ids: DataFrame, folder: str) -> str:
    """Write the ids (columns ``file`` and ``doc_id``) of each file apart."""
    ids.select("file", "doc_id").repartition(tasks(ids.sparkSession), "file").write.partitionBy("file").parquet(folder)
    return folder


class Lists:
    """The ids that are listed for a file, of which one list is held at a time."""

    def __init__(self, folder: str):
        self._fs, self._path = fs.FileSystem.from_uri(folder)
        self._file, self._ids = None, np.zeros(0, np.int64)

    def of(self, file: int) -> np.ndarray:
        if file != self._file:
            place, parts = f"{self._path}/file={file}", [np.zeros(0, np.int64)]
            if self._fs.get_file_info(place).type == fs.FileType.Directory:
                for info in self._fs.get_file_info(fs.FileSelector(place)):
                    if info.path.endswith(".parquet"):
                        with self._fs.open_input_file(info.path) as f:
                            parts.append(pq.read_table(f, columns=["doc_id"]).column(0).to_numpy())
            self._file, self._ids = file, np.unique(np.concatenate(parts))
        return self._ids

    def has(self, files: pa.Array, ids: pa.Array) -> np.ndarray:
        """Which rows are listed; null ids never are."""
        files, known, ids = files.to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        out = np.zeros(len(ids), bool)
        for file in np.unique(files).tolist():
            own, listed = np.flatnonzero((files == file) & known), self.of(file)
            if len(listed):
                out[own] = listed[np.minimum(np.searchsorted(listed, ids[own]), len(listed) - 1)] == ids[own]
        return out


def listed_rows(docs: DataFrame, file: Column, id_col: str, folder: str, wanted: bool, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema=None) -> DataFrame:
    """The rows of ``docs`` whose id is listed for their file (or, not ``wanted``, is not); ``f`` maps them
    to rows of ``schema`` in the same pass."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(folder)
        for batch in batches:
            keep = lists.has(batch.column(0), batch.column(1)) == wanted
            if keep.any():
                yield pa.RecordBatch.from_arrays(batch.columns[2:], batch.schema.names[2:]).filter(pa.array(keep))

    taken, names = {c.lower() for c in docs.columns}, ["_file", "_id"]
    while taken & set(names):  # names that the table has itself
        names = [f"_{name}" for name in names]
    rows = docs.select(file.alias(names[0]), F.col(f"`{id_col}`").cast("long").alias(names[1]), *[F.col(f"`{c}`") for c in docs.columns])
    return rows.transform(map_batches, (lambda batches: f(choose(batches))) if f else choose, schema or docs.schema)
