"""Near-duplicates by an LSH forest over MinHash signatures.

Every tree is a sorted order of all documents by some of their MinHash values. Documents that share a
tree's first value form a region; within it, the candidates of a document are those before it in the
order with the longest common prefixes: it looks back at the least depth of prefix at which no more
than ``LOOK_BACK`` others qualify, so crowded regions are searched deeper than sparse ones.

Documents of equal shingle sets are one node from the start. Candidates whose signatures differ too
much for the threshold are left out. The forest is walked twice: first for the likeliest candidate of
each document, then for all candidates in components other than its own so far, which alone count
towards ``LOOK_BACK``; both are confirmed on the full sets. Where more documents than that share all
values of a tree, every two of them in different components are compared on their full sets, block by
block of at most two chunks. So a large group of copies makes few pairs, and every two documents that
share all values of some tree are in one component or have been compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.byfile import listed_rows, scanned, write_lists
from shelfwise.llm.components import connected_components
from shelfwise.llm.shared import drop, map_batches, materialize, tasks, work_dir
from shelfwise.llm.words import mix, words_of

TREES, DEPTH, LOOK_BACK = 16, 8, 24
SHINGLE = 5
#: Documents that a chunk of a crowded group has on average, and shingles that a block counts at once.
CHUNK, COLUMNS = 1024, 4096
#: Standard errors by which an estimate may lie under the threshold.
SLACK = 4.5

_U = np.uint64
_SEEDS = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | _U(1)


def shingle_sets(texts: pa.Array, size: int = SHINGLE):
    """(index of the first text, sorted hashes, bounds): the distinct shingles of block after block."""
    for i, w in words_of(texts, lower=True):
        n = len(w.counts)
        owner = np.repeat(np.arange(n), w.counts)
        at, hashes = w.windows(size)
        own = owner[at]
        short = np.flatnonzero((w.counts > 0) & (w.counts < size))
        if len(short):  # the whole sequence; hashed with its length, as a shorter one is no shingle
            extra = [mix(np.array([sum(int(h) * pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64) for k, h in enumerate(w.hashes[w.first[x] : w.first[x + 1]])) + int(w.counts[x]) & (1 << 64) - 1], np.uint64)) for x in short]
            hashes, own = np.concatenate([hashes, *extra]), np.concatenate([own, short])
        order = np.lexsort((hashes, own))
        hashes, own = hashes[order], own[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])
        hashes, own = hashes[fresh], own[fresh]
        yield i, hashes, np.searchsorted(own, np.arange(n + 1))


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The minimum of each permutation over each set; rows of empty sets are zeros."""
    out = np.zeros((len(bounds) - 1, len(_SEEDS)), np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        for k, seed in enumerate(_SEEDS):
            x = hashes * seed
            out[some, k] = np.minimum.reduceat(x ^ (x >> _U(32)), bounds[:-1][some])
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, doc_id, n (set size), two halves of the set's digest, the trees' first values, the signature, and
    its sketch of one byte for each value."""
    for batch in batches:
        for i, hashes, bounds in shingle_sets(batch.column(2)):
            n = np.diff(bounds)
            found = signatures(hashes, bounds)
            sums = [np.concatenate([[_U(0)], np.cumsum(mix(hashes ^ _U(s)), dtype=np.uint64)]) for s in (0x51ED270B, 0x7F4A7C15)]
            digests = [mix(s[bounds[1:]] - s[bounds[:-1]] + n.astype(np.uint64)) for s in sums]
            firsts = mix(found[:, ::DEPTH] + np.arange(TREES, dtype=np.uint64))
            short = (found >> _U(32)).astype(">u4")
            sketch = mix(found).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, len(n)), batch.column(1).slice(i, len(n)), pa.array(n), *map(_signed, digests), pa.ListArray.from_arrays(np.arange(0, TREES * len(n) + 1, TREES, dtype=np.int32), _signed(firsts.ravel())), *(pa.array([x.tobytes() for x in part], pa.binary()) for part in (short, sketch))],
                ["file", "doc_id", "n", "k1", "k2", "firsts", "signature", "sketch"],
            )


def least_depth(labels: np.ndarray, i: int) -> tuple[int, int]:
    """Where row i's candidates begin, and their prefix's length: the least depth at which at most
    ``LOOK_BACK`` rows before i qualify; beyond the deepest, the nearest ones."""
    start = 0
    for depth in range(1, labels.shape[1] + 1):
        same = (labels[start:i, depth - 1] == labels[i, depth - 1])[::-1]  # of those that share what is before
        n = len(same) if same.all() else int(same.argmin())
        start = i - n
        if n <= LOOK_BACK:
            return start, depth
    return max(start, i - LOOK_BACK), labels.shape[1]


def _candidates(ids: np.ndarray, sizes: np.ndarray, of: np.ndarray, labels: np.ndarray, sketches: np.ndarray, new_from: int, share: int, likeliest: bool, out: list) -> None:
    """Pairs of a row from ``new_from`` on with candidates before it that lie in another component, if
    sizes and sketches allow; with ``likeliest``, only the likeliest one of each row. However many rows of its
    own component lie between, the nearest others are found."""
    floor = share / 100 - SLACK * math.sqrt(share / 100 * (1 - share / 100) / sketches.shape[1])
    edge = np.flatnonzero(np.append(True, labels[1:, 0] != labels[:-1, 0]))
    region = edge[np.searchsorted(edge, np.arange(len(ids)), "right") - 1]
    for i in np.flatnonzero(region < np.arange(len(ids))):
        if i < new_from:
            continue
        others = region[i] + np.flatnonzero(of[region[i] : i] != of[i])[-LOOK_BACK - 1 :]
        if len(others) > LOOK_BACK:
            others = others[least_depth(labels[np.append(others, i)], len(others))[0] :]
        like = (sketches[others] == sketches[i]).mean(axis=1)
        less, more = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        fit = np.flatnonzero((like >= floor) & (100 * less >= share * more))
        for k in fit[np.argsort(-like[fit], kind="stable")[:1]] if likeliest else fit:
            a, b = ids[i], ids[others[k]]
            out.append((max(a, b), min(a, b), float(like[k])))


_ROW = ("tree", "doc_id", "n", "of", "label", "sketch")
_FOREST = "kind int, part int, place int, tree int, doc_id long, n long, of long, label binary, sketch binary, b long, likeness double"
_NAMES = [x.split()[0] for x in _FOREST.split(", ")]


def _matrices(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    trees, ids, sizes, of, labels, sketches = zip(*rows)
    labels = np.frombuffer(b"".join(labels), ">u4").reshape(len(rows), -1).astype(np.uint64)
    labels[:, 0] += np.array(trees, np.uint64) << _U(32)  # rows of different trees share nothing
    return np.array(ids, np.int64), np.array(sizes, np.int64), np.array(of, np.int64), labels, np.frombuffer(b"".join(sketches), np.uint8).reshape(len(rows), -1)


def thinned(of: list[int]) -> list[int]:
    """Positions, ascending, of the rows that any later row may still need: its nearest ``LOOK_BACK`` + 1 of
    other components are among the last so many of each component, and of those among the last twice so many."""
    times: dict[int, int] = {}
    keep = []
    for i in range(len(of) - 1, -1, -1):
        times[of[i]] = times.get(of[i], 0) + 1
        if times[of[i]] <= LOOK_BACK + 1:
            keep.append(i)
            if len(keep) == 2 * LOOK_BACK + 2:
                break
    return keep[::-1]


class _Head:
    """The head of a partition: its rows up to where every component has more than ``LOOK_BACK`` rows of others
    in it. Only from there on no row looks back across the border."""

    def __init__(self):
        self.total, self.times, self.open = 0, {}, True

    def take(self, of: list[int]) -> int:
        """How many of the next rows, of these components, belong to the head."""
        for i, c in enumerate(of if self.open else ()):
            if self.total - max(self.times.values(), default=0) > LOOK_BACK:
                self.open = False
                return i
            self.total += 1
            self.times[c] = self.times.get(c, 0) + 1
        return len(of) if self.open else 0


def _pairs_batch(pairs: list[tuple[int, int, float]], part: int) -> pa.RecordBatch:
    n = len(pairs)
    a, b, like = (list(x) for x in zip(*pairs))
    nothing = [None] * n
    return _typed([[0] * n, [part] * n, nothing, nothing, a, nothing, nothing, nothing, nothing, b, like])


def _typed(columns: list[list]) -> pa.RecordBatch:
    kinds = [*[pa.int32()] * 4, *[pa.int64()] * 3, pa.binary(), pa.binary(), pa.int64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _NAMES)


def _walk(share: int, likeliest: bool):
    """Over rows in tree order: pairs (kind 0), and the rows at either end (1: heads, 2: tails) for the
    pairs across the border to the next partition. Without ``likeliest`` also the runs of equal labels
    (3) that are crowded, or may be as they touch an end: their length, and their least and greatest component."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, head = TaskContext.get().partitionId(), [], _Head()
        runs: list[list] = []
        for batch in batches:
            for i in range(0, len(batch), 4096):
                piece = batch.slice(i, 4096)
                rows = list(zip(*(piece.column(c).to_pylist() for c in _ROW)))
                first = head.take([r[3] for r in rows])
                if first:
                    yield _ends(1, part, rows[:first])
                for key, members in () if likeliest else groupby(rows, itemgetter(0, 4)):
                    of = [r[3] for r in members]
                    if runs and runs[-1][0] == key:
                        last = runs[-1]
                        last[1:] = last[1] + len(of), min(last[2], *of), max(last[3], *of)
                    else:
                        if len(runs) > 1 and runs[-1][1] <= LOOK_BACK:
                            runs.pop()
                        runs.append([key, len(of), min(of), max(of)])
                pairs: list = []
                keep = len(held) + first
                held += rows
                _candidates(*_matrices(held), keep, share, likeliest, pairs)
                if pairs:
                    yield _pairs_batch(pairs, part)
                held = [held[k] for k in thinned([r[3] for r in held])]
        for i in range(0, len(runs), 4096):
            keys, times, low, high = zip(*runs[i : i + 4096])
            trees, labels = zip(*keys)
            nothing = [None] * len(keys)
            yield _typed([[3] * len(keys), [part] * len(keys), nothing, trees, nothing, times, low, labels, nothing, high, nothing])
        if held:
            yield _ends(2, part, held)

    return walk


def _ends(kind: int, part: int, rows: list[tuple]) -> pa.RecordBatch:
    n = len(rows)
    return _typed([[kind] * n, [part] * n, list(range(n)), *map(list, zip(*rows)), [None] * n, [None] * n])


def _tails(walked: DataFrame) -> DataFrame:
    """The rows (kind 2) that each border needs from the partitions before it: those of the last one, and
    where these are not enough for every component, of those before, back to one that has enough. The
    driver gets a number for each partition."""
    counts = dict(walked.where("kind = 2").groupBy("part").agg(F.count("*").alias("n")).collect())
    parts = sorted(counts)
    needed = []
    for k, part in enumerate(parts[1:], 1):
        for before in reversed(parts[:k]):
            needed.append((before, part))
            if counts[before] > 2 * LOOK_BACK + 1:
                break
    spark = walked.sparkSession
    borders = spark.createDataFrame(needed, "part int, border int") if needed else spark.createDataFrame([], "part int, border int")
    return walked.where("kind = 2").join(F.broadcast(borders), "part")


def _borders(share: int, likeliest: bool):
    """Over the rows at each border (sorted by border, side and order in the trees): the pairs of the head's."""

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        border, held, rows = None, [], []

        def pairs() -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            found: list = []
            if rows:
                _candidates(*_matrices(held + rows), len(held), share, likeliest, found)
            held = held + rows
            held, rows = [held[k] for k in thinned([r[3] for r in held])], []
            if found:
                yield _pairs_batch(found, border)

        for batch in batches:
            for at, kind, *row in zip(*(batch.column(c).to_pylist() for c in ("border", "kind", *_ROW))):
                if at != border:
                    yield from pairs()
                    border, held = at, []
                if kind == 2:
                    held.append(tuple(row))
                else:
                    rows.append(tuple(row))
                    if len(rows) == 4096:
                        yield from pairs()
        yield from pairs()

    return cross


def tree_rows(known: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each of the ``nodes`` (doc_id) a row for each tree in which it shares the first value with another
    one; ``known`` has their signatures."""
    firsts = known.select("doc_id", "firsts").join(nodes, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", F.posexplode("firsts").alias("tree", "first"))
    shared = firsts.groupBy("tree", "first").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("tree", "first")
    members = firsts.join(shared, ["tree", "first"]).groupBy("doc_id").agg(F.collect_set("tree").alias("trees"))
    rows = known.join(members, "doc_id").select(F.explode("trees").alias("tree"), "doc_id", "n", "signature", "sketch")
    return rows.select("tree", "doc_id", "n", F.expr(f"substring(signature, tree * {4 * DEPTH} + 1, {4 * DEPTH})").alias("label"), "sketch")


def candidate_pairs(rows: DataFrame, share: int, folder: str, likeliest: bool) -> tuple[DataFrame, DataFrame]:
    """``a`` > ``b`` and the likeness of their sketches, each pair once, from all trees; ``rows``: those of
    ``tree_rows`` with ``of``, the component that each document is known to be in. And, without
    ``likeliest``, the crowded groups (tree, label): those in several components that share a whole
    label and are more than a row looks back at, or lie in more than one partition."""
    n = tasks(rows.sparkSession)
    ordered = rows.repartitionByRange(n, "tree", "label", "doc_id").sortWithinPartitions("tree", "label", "doc_id")
    walked = materialize(ordered.select(*_ROW).transform(map_batches, _walk(share, likeliest), _FOREST), f"{folder}/forest")
    heads = walked.where("kind = 1").withColumn("border", F.col("part"))
    sides = heads.select("border", "kind", "part", "place", *_ROW).unionByName(_tails(walked).select("border", "kind", "part", "place", *_ROW))
    across = sides.repartition(n, "border").sortWithinPartitions("border", F.desc("kind"), "part", "tree", "label", "doc_id")
    across = across.select("border", "kind", *_ROW).transform(map_batches, _borders(share, likeliest), _FOREST)
    pairs = walked.where("kind = 0").select("doc_id", "b", "likeness").unionByName(across.select("doc_id", "b", "likeness"))
    pairs = materialize(pairs.groupBy(F.col("doc_id").alias("a"), "b").agg(F.max("likeness").alias("likeness")), f"{folder}/pairs")
    runs = walked.where("kind = 3").groupBy("tree", "label").agg(F.sum("n").alias("n"), F.min("of").alias("low"), F.max("b").alias("high"), F.count("*").alias("parts"))
    return pairs, runs.where(((F.col("n") > LOOK_BACK) | (F.col("parts") > 1)) & (F.col("low") < F.col("high"))).select("tree", "label")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, hashes, bounds in shingle_sets(batch.column(1)):
            sets = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(sets)), pa.array(sets, pa.binary())], ["doc_id", "shingles"])


def confirm(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold; ``sets``: doc_id and shingles."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= share * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, other = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "x", "y").transform(map_batches, check, "a long, b long")


def _incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """A row for each set: which of the sorted hashes it has."""
    out = np.zeros((len(sets), len(columns)), np.float32)
    for i, x in enumerate(sets):
        x = x[np.searchsorted(x, columns[0]) : np.searchsorted(x, columns[-1], "right")]
        at = np.searchsorted(columns, x)
        out[i, at[columns[at] == x]] = 1
    return out


def block_links(one: list[tuple], other: list[tuple], share: int) -> list[tuple[int, int]]:
    """Links between documents (doc_id, of, sorted shingles) of two chunks, or within one if ``other`` is
    empty: one for each two components that have any."""
    sides = [one, other or one]
    ids, of = ([np.array([r[k] for r in side], np.int64) for side in sides] for k in (0, 1))
    sets = [[r[2] for r in side] for side in sides]
    both = np.zeros((len(sets[0]), len(sets[1])), np.float32)
    common = np.intersect1d(*(np.unique(np.concatenate(x)) for x in sets), assume_unique=True)
    for i in range(0, len(common), COLUMNS):
        columns = common[i : i + COLUMNS]
        x = _incidence(sets[0], columns)
        both += x @ (_incidence(sets[1], columns) if other else x).T
    both = both.astype(np.int64)
    sizes = [np.array([len(x) for x in side]) for side in sets]
    x, y = np.nonzero((both > 0) & (100 * both >= share * (sizes[0][:, None] + sizes[1] - both)) & (of[0][:, None] != of[1]))
    found = {(min(p), max(p)): (max(l), min(l)) for p, l in zip(zip(of[0][x].tolist(), of[1][y].tolist()), zip(ids[0][x].tolist(), ids[1][y].tolist()))}
    return list(found.values())


def crowded_links(rows: DataFrame, groups: DataFrame, sets: DataFrame, share: int, folder: str) -> DataFrame:
    """Links (a, b) of different components in the ``groups`` (tree, label) of ``rows``, on full sets.

    A component that has many of a group gets chunks of its own, which are never compared to one
    another; the others are dealt over common chunks. Every two chunks are a block, and blocks are dealt
    over tasks, so a large group is never one task.
    """
    spark, n = rows.sparkSession, tasks(rows.sparkSession)
    groups = materialize(groups, f"{folder}/groups")
    if groups.isEmpty():
        return sets.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).where("false")
    members = rows.join(groups, ["tree", "label"]).select(F.xxhash64("tree", "label").alias("group"), "doc_id", "of")
    members = materialize(members, f"{folder}/members")
    per = materialize(members.groupBy("group", "of").agg(F.count("*").alias("n")), f"{folder}/per")
    own = materialize(per.where(F.col("n") >= CHUNK).select("group", "of", F.ceil(F.col("n") / CHUNK).alias("own")), f"{folder}/own")
    common = materialize(per.where(F.col("n") < CHUNK).groupBy("group").agg(F.ceil(F.sum("n") / CHUNK).alias("common")), f"{folder}/common")
    alone, salt = F.col("own").isNotNull(), F.xxhash64("doc_id")
    chunk = F.struct(alone.alias("alone"), F.when(alone, F.col("of")).otherwise(0).alias("of"), F.pmod(salt, F.coalesce("own", "common")).alias("nth"))
    placed = members.join(own, ["group", "of"], "left").join(common, "group", "left").select("group", chunk.alias("chunk"), "doc_id", "of")
    placed = materialize(placed, f"{folder}/placed")
    chunks = materialize(placed.select("group", "chunk").distinct(), f"{folder}/chunks")
    blocks = chunks.withColumnRenamed("chunk", "x").join(chunks.withColumnRenamed("chunk", "y"), "group").where("x <= y AND NOT (x.alone AND y.alone AND x.of = y.of)")
    blocks = blocks.select(F.xxhash64("group", "x", "y").alias("block"), "group", "x", "y")
    sides = blocks.select("block", "group", F.col("x").alias("chunk"), F.lit(0).alias("side")).unionByName(blocks.where("x <> y").select("block", "group", F.col("y").alias("chunk"), F.lit(1).alias("side")))
    dealt = placed.join(sides, ["group", "chunk"]).select("block", "side", "doc_id", "of").join(sets, "doc_id")
    dealt = dealt.repartition(n, "block").sortWithinPartitions("block", "side").select("block", "side", "doc_id", "of", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [])

        def links() -> Iterator[pa.RecordBatch]:
            found = block_links(*held, share) if held[0] else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

        for batch in batches:
            for block, side, doc, of, shingles in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                if block != at:
                    yield from links()
                    at, held = block, ([], [])
                held[side].append((doc, of, np.frombuffer(shingles.as_buffer(), np.uint64).copy()))
        yield from links()

    return materialize(dealt.transform(map_batches, compare, "a long, b long").distinct(), f"{folder}/links")


def near_duplicates(docs: DataFrame, share: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's doc_id, n_shingles, component_id and kept, for links of Jaccard >= ``share`` %.

    Sets: distinct shingles of five words, A-Z lower-cased; with fewer words the whole sequence is the
    one shingle; null and empty texts have none and link to nothing. The component's name is its
    smallest doc_id, and ``kept`` tells whether the row has it. Rows that repeat a doc_id are one
    document where their texts are equal; otherwise the document has the links of the texts compared.
    A row without id is a component of its own, kept, without name. A table without rows gives none. Texts
    of any length are shingled whole, in blocks. Columns other than the two named are not read.
    """
    judged, _ = _judge(docs, share, id_col, text_col, work_dir(docs.sparkSession))
    return judged.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def _judge(docs: DataFrame, share: int, id_col: str, text_col: str, folder: str) -> tuple[DataFrame, tuple]:
    """Each row's file, doc_id, n, component and kept; and the table read, with its file's number."""
    spark = docs.sparkSession
    docs, file = scanned(docs, f"{folder}/copy")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prepared = docs.select(file.alias("file"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(map_batches, _prepare, "file long, doc_id long, n long, k1 long, k2 long, firsts array<long>, signature binary, sketch binary")
    prepared = materialize(prepared, f"{folder}/prepared")
    known = prepared.where("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("node")), f"{folder}/classes")
    nodes = known.select("k1", "k2", "doc_id").join(classes.withColumnRenamed("node", "doc_id"), ["k1", "k2", "doc_id"]).select("doc_id")

    rows = materialize(tree_rows(known, nodes), f"{folder}/rows")
    compared = known.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("file").alias("file"))
    lists = write_lists(compared, f"{folder}/compared")
    sets = listed_rows(texts, file, "doc_id", lists, True, _sets, "doc_id long, shingles binary").dropDuplicates(["doc_id"])
    sets = materialize(sets, f"{folder}/sets")

    pairs, _ = candidate_pairs(rows.withColumn("of", F.col("doc_id")), share, f"{folder}/one", likeliest=True)
    best = pairs.groupBy("a").agg(F.max_by(F.col("b"), F.struct("likeness", -F.col("b"))).alias("b"))
    first = materialize(confirm(best, sets, share), f"{folder}/first")
    parts = connected_components(first, f"{folder}/parts").select(F.col("node").alias("doc_id"), F.col("component").alias("of"))
    rest = rows.join(parts, "doc_id", "left").withColumn("of", F.coalesce("of", "doc_id"))
    pairs, crowded = candidate_pairs(rest, share, f"{folder}/two", likeliest=False)
    second = materialize(confirm(pairs.join(best, ["a", "b"], "left_anti"), sets, share), f"{folder}/second")
    third = crowded_links(rest, crowded, sets, share, f"{folder}/crowded")
    # rows of one id but different texts are one document
    same = known.select("doc_id", "k1", "k2").distinct().join(classes, ["k1", "k2"]).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    repeated = known.groupBy("doc_id").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low < high").select(F.col("doc_id").alias("a"))
    links = first.unionByName(second).unionByName(third).unionByName(same.join(repeated, "a", "left_semi"))
    components = materialize(connected_components(links, f"{folder}/components"), f"{folder}/named")
    drop(spark, *[f"{folder}/{x}" for x in ("rows", "compared", "sets", "one", "first", "parts", "two", "second", "crowded", "components")])

    named = classes.join(components, classes["node"] == components["node"], "left").select("k1", "k2", F.coalesce("component", classes["node"]).alias("component"))
    rows = prepared.select("file", "doc_id", "n", "k1", "k2").withColumn("linked", F.expr("n > 0 AND doc_id IS NOT NULL"))
    out = rows.where("linked").join(named, ["k1", "k2"]).unionByName(rows.where("NOT linked OR linked IS NULL").withColumn("component", F.col("doc_id")))
    return out.select("file", "doc_id", "n", "component", F.col("doc_id").eqNullSafe(F.col("component")).alias("kept")), (docs, file)


def drop_near_duplicates(docs: DataFrame, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that keep their component's name; of rows that repeat
    an id one stays, the one of the least text. Rows without id stay; so do those of null and empty
    texts, but for repeated ids. No row is shuffled unless its id is repeated."""
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession)
    judged, (docs, file) = _judge(docs, share, id_col, text_col, f"{folder}/links")
    judged = materialize(judged.where("doc_id IS NOT NULL").select("file", "doc_id", "kept"), f"{folder}/judged")
    drop(spark, f"{folder}/links/prepared")
    per_id = judged.groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("rows"))
    per_id = materialize(per_id.where("NOT kept OR rows > 1"), f"{folder}/ids")
    files = judged.select("file", "doc_id").distinct()
    gone = write_lists(files.join(per_id, "doc_id"), f"{folder}/gone")
    out = listed_rows(docs, file, id_col, gone, False)
    repeated = per_id.where("kept")
    if repeated.isEmpty():
        return out
    several = listed_rows(docs, file, id_col, write_lists(files.join(repeated, "doc_id"), f"{folder}/repeated"), True)
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(text_col))
    one = several.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), first.alias("nth")).where("nth = 1").select("row.*")
    return out.unionByName(one)
