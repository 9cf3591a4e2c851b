"""A quality classifier made of rules over text statistics.

Paths of a small forest become conjunctive rules over statistics of a text; a lasso logistic model
gives each rule a weight, mostly zero; what is left compiles into one Spark column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.shared import map_batches, materialize, work_dir
from shelfwise.llm.words import BLOCK, blocks, buffers, words_of

#: Labelled rows to learn from, at most: those whose ids hash lowest.
TRAIN_ROWS = 20_000
#: Held-out share: rows whose CRC-32 of the id, modulo this, is 0.
FOLDS = 5

STATISTICS = ("log_bytes", "log_words", "word_bytes", "upper", "symbols", "shouts", "bars", "digits", "stops", "lines", "stutter", "distinct", "longest")

_CLASS = np.full(256, 0, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in "#$%&*~^<>{}[]\\=+_@"]] = 4
_CLASS[ord("!")], _CLASS[ord("|")], _CLASS[10], _CLASS[[ord(c) for c in ".,;:"]] = 5, 6, 7, 8
_CLASS[128:] = 9


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def statistics_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each whole text; a null text counts as an empty one."""
    data, bounds = buffers(texts)
    n, out = len(bounds) - 1, {}
    kinds, words, stutter, distinct, longest = np.zeros((n, 10)), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i, j in blocks(bounds, BLOCK):
        owner = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))
        kinds[i:j] = np.bincount(_CLASS[data[bounds[i] : bounds[j]]] + 10 * owner, minlength=10 * (j - i)).reshape(-1, 10)
    for i, w in words_of(texts, lower=True):
        m, counts = len(w.counts), w.counts
        words[i : i + m] = counts
        if len(w.hashes):
            owner = np.repeat(np.arange(m), counts)
            same = (w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1])
            stutter[i : i + m] = np.bincount(owner[1:][same], minlength=m)
            order = np.lexsort((w.hashes, owner))
            fresh = np.append(True, (w.hashes[order][1:] != w.hashes[order][:-1]) | (owner[1:] != owner[:-1]))
            distinct[i : i + m] = np.bincount(owner[fresh], minlength=m)
            some = np.flatnonzero(counts)
            longest[i + some] = np.maximum.reduceat(w.ends - w.starts, w.first[:-1][some])
    size, each = np.diff(bounds).astype(float), np.maximum(words, 1)
    letters, filled = np.maximum(kinds[:, 1] + kinds[:, 2], 1), np.maximum(size, 1)
    out["log_bytes"], out["log_words"], out["word_bytes"] = np.log1p(size), np.log1p(words), size / each
    out["upper"], out["symbols"], out["digits"] = kinds[:, 2] / letters, kinds[:, 4] / each, kinds[:, 3] / filled
    out["shouts"], out["bars"], out["stops"] = kinds[:, 5] / each, kinds[:, 6] / each, kinds[:, 8] / each
    out["lines"], out["stutter"], out["distinct"], out["longest"] = kinds[:, 7] / each, stutter / each, distinct / each, np.log1p(longest)
    return {name: np.round(out[name], 9) for name in STATISTICS}


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the statistics of each text, one row for each row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values())], ["doc_id", *found])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).transform(map_batches, compute, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """``low < statistic <= high`` for some statistics."""

    bounds: tuple[tuple[str, float, float], ...]

    def holds(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low > -np.inf:
                out = out & (F.col(name) > low)
            if high < np.inf:
                out = out & (F.col(name) <= high)
        return out

    @staticmethod
    def of(path: list[tuple[str, str, float]]) -> Rule:
        found: dict[str, list[float]] = {}
        for name, sign, threshold in path:
            own = found.setdefault(name, [-np.inf, np.inf])
            if sign == ">":
                own[0] = max(own[0], threshold)
            else:
                own[1] = min(own[1], threshold)
        return Rule(tuple((name, low, high) for name, (low, high) in sorted(found.items())))


def tree_rules(description: str, names: tuple[str, ...]) -> list[Rule]:
    """A rule for each node below the root, from the indented form in which Spark describes a tree."""
    path: list[tuple[int, tuple[str, str, float]]] = []
    rules = []
    for line in description.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            depth = len(m[1])
            path = [x for x in path if x[0] < depth] + [(depth, (names[int(m[2])], m[3], float(m[4])))]
            rules.append(Rule.of([x for _, x in path]))
    return rules


@dataclass(frozen=True)
class RuleModel:
    """A logistic model over rules; ``score`` reads the columns of ``text_statistics``."""

    intercept: float
    weights: tuple[tuple[Rule, float], ...] = field(default=())

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.weights:
            total = total + F.when(rule.holds(), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def fit_rules(rows: DataFrame, label: str = "quality", trees: int = 20, depth: int = 3, strength: float = 5e-4, seed: int = 7) -> RuleModel:
    """Learn from rows with the statistics and a 0/1 label. One class alone, or no rows: its share."""
    rows = rows.withColumn("label", F.col(label).cast("double")).withColumn("features", array_to_vector(F.array(*STATISTICS)))
    n, share = rows.agg(F.count("label"), F.avg("label")).first()
    if not n or share in (0.0, 1.0):
        odds = ((share or 0.0) * n + 0.5) / (n + 1)
        return RuleModel(float(np.log(odds / (1 - odds))))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="0.5", seed=seed).fit(rows)
    rules = sorted({r for tree in forest.trees for r in tree_rules(tree.toDebugString, STATISTICS)}, key=lambda r: r.bounds)
    held = rows.select("label", array_to_vector(F.array(*[r.holds().cast("double") for r in rules])).alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=strength, maxIter=60).fit(held)
    return RuleModel(float(model.intercept), tuple((r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if w))


def score_quality(docs: DataFrame, labels: DataFrame, cut: float = 0.3, limit: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's doc_id, held_out, score and predicted (1 if the score is ``cut`` or more).

    Learns from at most ``limit`` labelled rows outside the held-out share; only statistics of the
    text enter a score. Null and empty texts are scored by their statistics, which are zeros. Rows of
    one text get one score. Labels that are null or not 0 or 1 don't count; of several the least does.
    """
    at = work_dir(docs.sparkSession)
    stats = materialize(text_statistics(docs, id_col, text_col), f"{at}/statistics")
    model = _fit_on_sample(stats, _chosen(labels, limit), at)
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def _chosen(labels: DataFrame, limit: int) -> DataFrame:
    """The labelled rows to learn from: so few that they may be broadcast."""
    known = labels.where("quality IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _fit_on_sample(stats: DataFrame, chosen: DataFrame, at: str) -> RuleModel:
    rows = stats.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", *STATISTICS).coalesce(4)
    return fit_rules(materialize(rows, f"{at}/labelled"))


def keep_quality(docs: DataFrame, labels: DataFrame, cut: float = 0.3, limit: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is ``cut`` or more; as ``score_quality``
    otherwise, but in one pass over the texts after the model is fitted."""
    chosen = _chosen(labels, limit)
    sample = docs.join(F.broadcast(chosen.select(F.col("doc_id").alias(id_col))), id_col, "left_semi")
    model = _fit_on_sample(text_statistics(sample, id_col, text_col), chosen, work_dir(docs.sparkSession))
    text_at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            yield pa.RecordBatch.from_arrays([row, *map(pa.array, statistics_of(batch.column(text_at)).values())], ["row", *STATISTICS])

    schema = T.StructType([T.StructField("row", docs.schema), *[T.StructField(s, T.DoubleType()) for s in STATISTICS]])
    return docs.transform(map_batches, add, schema).where(model.score() >= cut).select("row.*")
