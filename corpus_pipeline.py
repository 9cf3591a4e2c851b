"""A corpus pipeline of the operators in ``shelfwise.llm``.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of
``documents``; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import bpe, mixing, neardup, quality, substrings
from shelfwise.llm.queries import piece_pattern, vocabulary
from shelfwise.llm.shared import table, work_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules take for bad go."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.drop_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of an earlier document are cut out; what has nothing left goes."""
    found = substrings.remove_repeats(docs).where("n_removed = 0 OR n_removed < n_words")
    changed = F.when(F.col("n_removed") > 0, F.length("row.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[changed.alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of the mix."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, little-endian unsigned 32-bit integers, of each document of the mix."""
    return bpe.encode_texts(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), piece_pattern())


STAGES = [
    ("quality classifier", quality_stage),
    ("near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", token_stage),
]
#: A learned model, similarity links and token ids can't be put in SQL; the stages are tested against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = work_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
