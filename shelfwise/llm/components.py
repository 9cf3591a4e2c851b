"""Connected components of links, each named by its smallest member."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.shared import materialize


def connected_components(links: DataFrame, folder: str) -> DataFrame:
    """``node`` and ``component`` for every node in ``links`` (columns a and b, of one type).

    Alternates two steps that keep the components and draw every node to its smallest neighbour: each
    node hands its larger neighbours (large star), then its smaller ones (small star), to the smallest.
    When nothing changes, all links point at the smallest node. Minima are taken before rows are
    shuffled, and each round is written to ``folder``, so neither a large component nor a lost executor
    is a difficulty.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, f"{folder}/0")
    mark = None
    for i in count(1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.distinct(), f"{folder}/{i}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
