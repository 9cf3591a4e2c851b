"""Ranked lexical search in which documents that no item can tell apart are scored once.

Each text is cut into terms and restricted to the vocabulary of the items. What a score reads of a document
is then its vector of term frequencies and one number m for its length; documents with both the same are
a class. Classes are found by grouping on a hash of the vector and verified by the vector itself, scored
once against all items, and expanded into their members by ascending doc_id. As no item returns more than
its k best, a class never needs more than its k smallest members; of a class of any size each task keeps
those before rows are shuffled.

A task of the search holds the items as posting lists of terms and keeps, for each item, its k best
documents so far; those of all tasks are merged at the end. Vocabulary and weights lie in the shared
folder, in blocks of items of a bounded number of terms; every block of items meets every class.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.shared import map_batches, materialize, work_dir
from shelfwise.llm.words import blocks, buffers, word_hashes

#: A term: neither ASCII punctuation nor white space nor a control character.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct terms of the items that one pass over the corpus looks up, and scores that a task holds at once.
TERMS, CELLS = 1 << 20, 1 << 21

#: Bytes that are in terms, and what they are lower-cased to. All of a character beyond ASCII are.
IN_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_EIGHT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, term). Rows of one id are one item; null ids take no part."""
    terms = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), F.lit(TERM), 0)
    return items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.explode(F.array_distinct(terms)).alias("term")).distinct()


def read_columns(folder: str, *names: str) -> list:
    """Columns of a small Parquet table in the shared folder, as one array each."""
    filesystem, path = fs.FileSystem.from_uri(folder)
    parts = []
    for info in filesystem.get_file_info(fs.FileSelector(path)):
        if info.path.endswith(".parquet"):
            with filesystem.open_input_file(info.path) as f:
                parts.append(pq.read_table(io.BytesIO(f.read()), columns=list(names)))
    table = pa.concat_tables(parts)
    return [table.column(n).combine_chunks() for n in names]


class Vocabulary:
    """Term numbers by the terms' bytes: looked up by a 64-bit hash, then compared whole."""

    def __init__(self, folder: str):
        numbers, terms = read_columns(folder, "term_no", "term")
        data, bounds = buffers(terms)
        self.starts, self.ends, self.data = bounds[:-1], bounds[1:], np.concatenate([data, np.zeros(8, np.uint8)])
        hashes, self.numbers = word_hashes(data, self.starts, self.ends), numbers.to_numpy()
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.clash = bool((self.sorted[1:] == self.sorted[:-1]).any())

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the spans are in the vocabulary, and their numbers."""
        if not len(self.sorted) or not len(starts):
            return np.zeros(0, int), np.zeros(0, np.int64)
        if self.clash:  # two terms of one hash: by bytes alone
            known = {self.data[s:e].tobytes(): n for s, e, n in zip(self.starts.tolist(), self.ends.tolist(), self.numbers.tolist())}
            found = [(i, known[w]) for i, w in enumerate(data[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist())) if w in known]
            return np.array([f[0] for f in found], int), np.array([f[1] for f in found], np.int64)
        hashes = word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        rows = np.flatnonzero(self.sorted[at] == hashes)
        own = self.order[at[rows]]
        same = (self.ends[own] - self.starts[own]) == (ends[rows] - starts[rows])
        rows, own = rows[same], own[same]
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eights, mine = (np.ndarray((len(d) - 7,), "<u8", d, strides=(1,)) for d in (padded, self.data))
        equal, left, step, live = np.ones(len(rows), bool), ends[rows] - starts[rows], 0, np.arange(len(rows))
        while len(live):
            mask = _EIGHT[np.minimum(left[live] - step, 8)]
            equal[live] &= (eights[starts[rows[live]] + step] & mask) == (mine[self.starts[own[live]] + step] & mask)
            step += 8
            live = live[left[live] > step]
        return rows[equal], self.numbers[own[equal]]


def term_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms in ``data``; none crosses a bound."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IN_TERM[data]
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    begins[inner] |= inside[1:-1][inner]
    stops[inner - 1] |= inside[1:-1][inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def bags(docs: DataFrame, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, number of terms ``n``, and ``bag``: numbers and frequencies of the vocabulary's terms, as
    little-endian 32-bit integers by ascending number. Documents without any term are left out."""

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(vocabulary)
        for batch in batches:
            data, bounds = buffers(batch.column(1))
            for i, j in blocks(bounds):
                part, own = _FOLDED[data[bounds[i] : bounds[j]]], bounds[i : j + 1] - bounds[i]
                starts, ends = term_bounds(part, own)
                first = np.searchsorted(starts, own)
                rows, numbers = known.look_up(part, starts, ends)
                doc = np.searchsorted(first, rows, "right") - 1
                pairs, times = np.unique((doc.astype(np.int64) << 32) | numbers, return_counts=True)
                cells = np.stack([pairs & 0xFFFFFFFF, times], axis=1).astype("<u4")
                cut = np.searchsorted(pairs >> 32, np.arange(j - i + 1))
                n = np.diff(first)
                some = np.flatnonzero(n)
                packed = [cells[cut[d] : cut[d + 1]].tobytes() for d in some.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(some)), pa.array(n[some].astype(np.int64)), pa.array(packed, pa.binary())], ["doc_id", "n", "bag"])

    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).transform(map_batches, restrict, "doc_id long, n long, bag binary")


def document_frequencies(found: DataFrame) -> DataFrame:
    """``term_no`` and ``df``; a task adds up its documents before rows are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            cells = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4").reshape(-1, 2)
            now = np.bincount(cells[:, 0]) if len(cells) else np.zeros(0, np.int64)
            total, now = (now, total) if len(total) < len(now) else (total, now)
            total[: len(now)] += now
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term_no", "df"])

    return map_batches(found.select("bag"), count, "term_no long, df long").groupBy("term_no").agg(F.sum("df").alias("df"))


class Items:
    """The items as postings of terms, with each term's weight."""

    def __init__(self, postings: str):
        items, terms, weights = (c.to_numpy() for c in read_columns(postings, "item_id", "term_no", "weight"))
        self.ids, item = np.unique(items, return_inverse=True)
        order = np.lexsort((item, terms))
        self.items, terms = item[order], terms[order]
        self.terms, self.first, self.degree = np.unique(terms, return_index=True, return_counts=True)
        self.weights = weights[order][self.first]

    def scores(self, bags: list[bytes], m: np.ndarray) -> np.ndarray:
        """Scores of classes (rows) for items (columns)."""
        sizes = np.array([len(b) for b in bags]) // 8
        cells = np.frombuffer(b"".join(bags), "<u4").reshape(-1, 2).astype(np.int64)
        row = np.repeat(np.arange(len(bags)), sizes)
        at = np.minimum(np.searchsorted(self.terms, cells[:, 0]), len(self.terms) - 1)
        mine = np.flatnonzero(self.terms[at] == cells[:, 0])
        at, row, tf = at[mine], row[mine], cells[mine, 1]
        gain = self.weights[at] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
        degree = self.degree[at]
        offset = np.arange(degree.sum()) - np.repeat(np.cumsum(degree) - degree, degree)
        target = np.repeat(row * len(self.ids), degree) + self.items[np.repeat(self.first[at], degree) + offset]
        out = np.zeros(len(bags) * len(self.ids), np.int64)
        if np.bincount(row, gain, len(bags)).max(initial=0) < 2**53:  # no sum then exceeds what a float holds exactly
            out += np.bincount(target, np.repeat(gain, degree), len(out)).astype(np.int64)
        else:
            np.add.at(out, target, np.repeat(gain, degree))
        return out.reshape(len(bags), len(self.ids))


def best_members(scores: np.ndarray, members: list[list[int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best (score, doc_id) of one item: members of the classes that reach its k-th best class."""
    hits = np.flatnonzero(scores > 0)
    if len(hits) > k:
        hits = hits[scores[hits] >= np.partition(scores[hits], -k)[-k]]
    ids = np.array([d for c in hits.tolist() for d in members[c]], np.int64)
    own = np.repeat(scores[hits], [len(members[c]) for c in hits.tolist()])
    order = np.lexsort((ids, -own))[:k]
    return own[order], ids[order]


def search_classes(classes: DataFrame, postings: str, k: int) -> DataFrame:
    """Each task's ``k`` best documents of every item, from rows (bag, m, members)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(postings)
        width = len(items.ids)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(width)]
        floor = np.zeros(width, np.int64)
        step = max(1, CELLS // max(1, width))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                members = part.column(2).to_pylist()
                scores = items.scores(part.column(0).to_pylist(), part.column(1).to_numpy())
                for j in np.flatnonzero(scores.max(axis=0, initial=0) >= np.maximum(floor, 1)).tolist():
                    now = best_members(scores[:, j], members, k)
                    own, ids = (np.concatenate(x) for x in zip(best[j], now))
                    order = np.lexsort((ids, -own))[:k]
                    best[j] = own[order], ids[order]
                    floor[j] = best[j][0][k - 1] if len(order) == k else 0
        columns = [np.repeat(items.ids, [len(b[0]) for b in best]), np.concatenate([b[1] for b in best]) if best else [], np.concatenate([b[0] for b in best]) if best else []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    return map_batches(classes.select("bag", "m", "members"), search, "item_id long, doc_id long, score long")


def bag_classes(found: DataFrame, m: Column, k: int) -> DataFrame:
    """Classes of equal vector and m, with their ``k`` smallest doc_ids, ascending. Rows are dealt out and
    ordered by a hash of the vector; the vector itself is compared too, so a clash of hashes joins nothing."""
    keyed = found.where(F.length("bag") > 0).select(F.xxhash64("bag").alias("bag_hash"), m.alias("m"), "bag", "doc_id")
    nth = F.row_number().over(Window.partitionBy("bag_hash", "m", "bag").orderBy("doc_id"))
    least = keyed.withColumn("nth", nth).where(F.col("nth") <= k)
    return least.groupBy("bag_hash", "m", "bag").agg(F.sort_array(F.collect_list("doc_id")).alias("members"))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id``, ``rank`` from 1, ``doc_id`` and ``score`` of each item's ``k`` best documents with a score
    above 0 (all, if fewer); equal scores by ascending doc_id.

    Null texts have no term; documents and items without id take no part, not even in the statistics.
    Repeated documents are ranked each; items of one id are one. An item without a term that occurs, and
    an empty table on either side, have no rows. Other columns are not read.
    """
    spark, at = docs.sparkSession, work_dir(docs.sparkSession)
    asked = materialize(item_terms(items, item_col, item_text_col), f"{at}/items")
    parts = -(-asked.select("term").distinct().count() // TERMS)  # each item is in one block, with all its terms
    out = None
    for part in range(parts):
        own = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        number = F.row_number().over(Window.orderBy("term")) - 1  # of the items' terms only: TERMS at most, about
        vocabulary = materialize(own.select("term").distinct().withColumn("term_no", number.cast("long")).coalesce(1), f"{at}/terms-{part}")
        found = materialize(bags(docs, f"{at}/terms-{part}", doc_col, text_col), f"{at}/bags-{part}")
        total = found.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
        if not total.N:
            continue
        weight = F.floor(1000 * F.log((2 * total.N + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long").alias("weight")
        weighed = own.join(vocabulary, "term").join(document_frequencies(found), "term_no").select(F.col("item_id").cast("long").alias("item_id"), "term_no", weight)
        materialize(weighed.coalesce(8), f"{at}/postings-{part}")
        m = F.lit(50) + F.expr(f"(50 * n * {total.N}L) div {total.L}L")
        rows = search_classes(bag_classes(found, m, k), f"{at}/postings-{part}", k)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH asked AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
docs AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS line, {_TERMS} AS ts FROM documents WHERE doc_id IS NOT NULL),
n AS MATERIALIZED (SELECT count(*) AS docs, sum(len(ts))::BIGINT AS terms FROM docs WHERE len(ts) > 0),
tf AS MATERIALIZED (
  SELECT doc_id, line, n, term, count(*) AS tf FROM (SELECT doc_id, line, len(ts) AS n, unnest(ts) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, line, n, term),
w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY term),
gain AS MATERIALIZED (
  SELECT doc_id, line, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * tf.n * n.docs) // n.terms))) AS gain
  FROM tf JOIN w USING (term) CROSS JOIN n),
scores AS (SELECT item_id, doc_id, line, sum(gain)::BIGINT AS score FROM asked JOIN gain USING (term) GROUP BY item_id, doc_id, line)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
