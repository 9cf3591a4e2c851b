"""Exact top-k by inner product, with a pivot table for elimination.

The distances of every vector to some pivots are computed once. For a query q and a vector x, the
triangle inequality gives |x - q| >= |d(q, p) - d(x, p)| for every pivot p; the largest of these, m,
bounds the inner product by (|q|^2 + |x|^2 - m^2) / 2. Only vectors whose bound reaches the query's k-th best
score so far are evaluated. The pivots are chosen in a sample of the table's
vectors, and the k-th best score within that sample is where each query starts.

A task holds some queries and reads the blocks of vectors from the shared folder, one after the other, so a
query's k-th best score rises as it goes, and neither queries nor vectors nor candidates are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.shared import map_batches, materialize, tasks, work_dir

#: Pivots, and the vectors (those whose ids hash lowest) among which they are chosen.
PIVOTS, SAMPLE = 24, 1024
#: Vectors and queries that meet in one step, and queries that a task holds at most (and, where tasks are idle, at least).
BLOCK, QUERY_BLOCK = 2048, 64
QUERIES, FEW_QUERIES = 2048, 32


def quantized(vector: Column) -> Column:
    """floor(256 * x) of each component x as double; null if there is a null or non-finite component."""
    whole = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(F.coalesce(whole, F.lit(False)), F.transform(vector, lambda x: F.floor(256 * x.cast("double"))))


def spread_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Indexes of ``n`` vectors, each the farthest from those before it."""
    if not len(vectors):
        return np.zeros(0, int)
    chosen, nearest = [0], np.full(len(vectors), np.inf)
    while len(chosen) < min(n, len(vectors)):
        nearest = np.minimum(nearest, np.linalg.norm(vectors - vectors[chosen[-1]], axis=1))
        nearest[chosen] = -1
        chosen.append(int(nearest.argmax()))
    return np.array(chosen)


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(vectors - p, axis=1) for p in pivots], axis=1)


def _matrix(vectors: list[list[int]], width: int) -> np.ndarray:
    """Rows of one width; shorter vectors are filled with zeros."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def inner_products(vectors: np.ndarray, query: np.ndarray) -> list:
    """Exact ones of integer vectors, also beyond what sums of floats hold exactly."""
    if np.abs(vectors).max(initial=0) * np.abs(query).max(initial=0) * max(1, len(query)) >= 2**53:
        return [sum(int(a) * int(b) for a, b in zip(v, query)) for v in vectors]
    return (vectors @ query).tolist()


def starting_scores(queries: np.ndarray, query_ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """For each query its ``k``-th best score within the sample, rows of its own id left out; least of all where there are fewer."""
    known = np.where(query_ids[:, None] == sample_ids, -np.inf, queries @ sample.T)
    known = np.pad(known, ((0, 0), (k, 0)), constant_values=-np.inf)
    return np.maximum(np.partition(known, -k, axis=1)[:, -k], -1e300)


def bounds(norms: np.ndarray, table: np.ndarray, queries: np.ndarray, q_table: np.ndarray) -> np.ndarray:
    """By query and vector: a number that the inner product doesn't pass."""
    apart, step = np.zeros((len(queries), len(norms))), np.empty((len(queries), len(norms)))
    for own, at in zip(table.T, q_table.T):
        np.subtract(own[None], at[:, None], out=step)
        np.maximum(apart, np.abs(step, out=step), out=apart)
    both = norms[None] + (queries * queries).sum(axis=1)[:, None]
    return (both - apart * apart) / 2 + 1e-9 * both + 1e-3  # more than rounding can take away


class Best:
    """The ``k`` best (-score, id) of each of some queries, of the blocks seen so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, table: np.ndarray, start: np.ndarray, k: int):
        self.ids, self.queries, self.table, self.k, self.floor = ids, queries, table, k, start.copy()
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]

    def meet(self, ids: np.ndarray, vectors: np.ndarray, table: np.ndarray) -> None:
        norms, most = (vectors * vectors).sum(axis=1), np.abs(vectors).max(initial=0)
        for at in range(0, len(self.ids), QUERY_BLOCK):
            own = slice(at, at + QUERY_BLOCK)
            queries, floor = self.queries[own], self.floor[own, None]
            alive = (bounds(norms, table, queries, self.table[own]) >= floor) & (self.ids[own, None] != ids)
            some = np.flatnonzero(alive.any(axis=0))
            if most * np.abs(queries).max(initial=0) * max(1, queries.shape[1]) >= 2**53:
                for i in np.flatnonzero(alive.any(axis=1)):
                    js = np.flatnonzero(alive[i])
                    self._add(at + i, inner_products(vectors[js], queries[i]), ids[js])
            elif len(some):
                scores = queries @ vectors[some].T
                good = alive[:, some] & (scores >= floor)
                for i in np.flatnonzero(good.any(axis=1)):
                    self._add(at + i, scores[i, good[i]].tolist(), ids[some[good[i]]])

    def _add(self, i: int, scores: list, ids: np.ndarray) -> None:
        self.best[i] = sorted([*self.best[i], *zip((-int(x) for x in scores), ids.tolist())])[: self.k]
        if len(self.best[i]) == self.k:
            last = float(-self.best[i][-1][0])
            self.floor[i] = max(self.floor[i], last if abs(last) < 2**53 else np.nextafter(last, -np.inf))


def _pack(rows: DataFrame, size: int, pivots: np.ndarray, width: int) -> DataFrame:
    """Rows of (id, vector) packed into blocks with their pivot table."""

    names = ["ids", "vectors", "table"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []

        def block() -> pa.RecordBatch:
            m = _matrix(vectors[:size], width)
            columns = [np.array(ids[:size], "<i8"), m.astype("<f8"), distances(m, pivots).astype("<f8")]
            del ids[:size], vectors[:size]
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names)

        for batch in batches:
            ids += batch.column(0).to_pylist()
            vectors += batch.column(1).to_pylist()
            while len(ids) >= size:
                yield block()
        if ids:
            yield block()

    return rows.transform(map_batches, pack, ", ".join(f"{n} binary" for n in names))


def _blocks(folder: str, width: int, pivots: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, vectors and pivot table of each block that ``_pack`` made, one at a time."""
    filesystem, path = fs.FileSystem.from_uri(folder)
    for info in sorted(filesystem.get_file_info(fs.FileSelector(path)), key=lambda x: x.path):
        if info.path.endswith(".parquet"):
            with filesystem.open_input_file(info.path) as f:
                for batch in pq.ParquetFile(f, buffer_size=1 << 20).iter_batches(1):
                    ids, vectors, table = (np.frombuffer(batch.column(c)[0].as_buffer(), t) for c, t in (("ids", "<i8"), ("vectors", "<f8"), ("table", "<f8")))
                    yield ids, vectors.reshape(-1, width), table.reshape(-1, pivots)


def _sample(valid: DataFrame, n: int, at: str) -> list:
    """The ``SAMPLE`` rows, of ``n``, whose ids hash lowest. However many tasks there are, the driver and the task that sorts
    get little more than these."""
    share = min(1.0, 4 * SAMPLE / max(1, n))
    while True:
        low = valid if share == 1 else valid.where(F.xxhash64("id") < int((share - 0.5) * 2**64))
        rows = materialize(low.orderBy(F.xxhash64("id"), "id", "vector").limit(SAMPLE), at).collect()
        if len(rows) == SAMPLE or share == 1:
            return rows
        share = min(1.0, 8 * share)


def top_k(rows: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query, a row whose id is divisible by ``every``, its ``k`` best of all other rows.

    Returns query_id, rank from 1, vec_id and score, the inner product of the quantized vectors; ties
    go to the smaller id; all rows if there are fewer. Rows without id, or with a null or non-finite
    vector, take no part. Rows of the query's own id are no candidates; other repeated rows are
    candidates each; of several query rows of one id the least vector asks. Vectors shorter than the
    longest are filled with zeros. Scores are exact integers, whatever their size within a long.
    """
    spark, at = rows.sparkSession, work_dir(rows.sparkSession)
    valid = rows.select(F.col(id_col).alias("id"), quantized(F.col(vector_col)).alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    valid = materialize(valid, f"{at}/vectors")
    n, width = valid.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    sample = _sample(valid, n, f"{at}/sample")
    points = _matrix([r.vector for r in sample], width)
    chosen = spread_pivots(points, PIVOTS)
    pivots, point_ids = points[chosen], np.array([r.id for r in sample], np.int64)
    if not len(pivots):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    packed, schema = f"{at}/packed", "query_id long, rank int, vec_id long, score long"
    materialize(_pack(valid, BLOCK, pivots, width), packed)
    asking = materialize(valid.where(F.col("id") % every == 0).groupBy(F.col("id").cast("long").alias("id")).agg(F.min("vector").alias("vector")), f"{at}/asking")
    asked = asking.count()
    parts = max(1, min(-(-asked // FEW_QUERIES), max(tasks(spark), -(-asked // QUERIES))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        own = pa.Table.from_batches(own) if own else []
        for first in range(0, len(own), QUERIES):
            part = own.slice(first, QUERIES)
            ids, queries = part.column("id").to_numpy(), _matrix(part.column("vector").to_pylist(), width)
            start = starting_scores(queries, ids, points, point_ids, k)
            largest = np.abs(points).max(initial=0) * np.abs(queries).max(initial=0) * max(1, width)
            found = Best(ids, queries, distances(queries, pivots), start if largest < 2**53 else np.maximum(start - 1e-9 * largest, -1e300), k)
            for block in _blocks(packed, width, len(pivots)):
                found.meet(*block)
            out = [(q, rank, own_id, -score) for q, best in zip(ids.tolist(), found.best) for rank, (score, own_id) in enumerate(best, 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["query_id", "rank", "vec_id", "score"])

    return asking.repartition(parts).transform(map_batches, search, schema)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM q JOIN v ON q.vec_id <> v.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
