"""Mixing sources to target weights by weighted fair queueing.

Each source serves its documents in shuffled order, over and over, at most ``copies`` times. A copy's
virtual finish time is the source's tokens up to its end, divided by the source's target; all copies
in order of finish time, cut where the budget is spent, are the mix.

Running sums, those of the sources as well as that of the global order, are taken in two steps: over
ranges of the order and within each range, so no source and no order meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.shared import WORD, materialize, work_dir

#: Ranges of the shuffled order for each source, and the rows of a range beyond which there are more.
RANGES, RANGE_ROWS = 1024, 4096
SHUFFLED_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffled(doc_id: Column) -> Column:
    """A place in an order that follows nothing but the id (without one, the text), of ``SHUFFLED_BITS`` bits."""
    digest = F.md5(doc_id.cast("string").cast("binary"))
    return F.conv(F.substring(digest, 1, SHUFFLED_BITS // 4), 16, 10).cast("long")


def _cycle(rank: Column) -> Column:
    return ((rank - 1) % 3 + 1).cast("long")


def source_targets(sizes: DataFrame, copies: int = 3, weight=_cycle) -> DataFrame:
    """Each source's weight and target, from a row with ``source`` and ``source_size`` for each.

    The budget is the sum of all sizes. Targets follow the weights but stop at ``copies`` times the
    source's size; the level at which the others share the rest is found from prefix sums over the
    sources in the order in which they reach their stop. ``weight`` maps a source's rank by code
    point, from 1 and null last, to its weight.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("weight", weight(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    stop, by_stop = F.col("source_size") * copies, Window.orderBy(F.col("source_size") * copies / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(stop).over(before), F.lit(0))) / F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("level", level).withColumn("fits", F.col("level") <= stop / F.col("weight"))
    found = levels.withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("source_size") * copies / F.col("weight"), "level"))).over(everything)["level"])
    target = F.least(stop.cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return found.select("source", "source_size", "weight", target.alias("target"))


def plan_mix(docs: DataFrame, copies: int = 3, weight=_cycle, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, taken, and ``finish``,
    the virtual finish time of its first copy (null if it has no words).

    Sizes are words; null texts have none, and what has no words is not taken. A null source is a
    source of its own. Repeated rows are documents of their own; ties in the shuffled order go by id,
    then size; ties in finish time by source, id and size. A text of any length is one document, however
    much of the budget it takes. Without rows, or without words, nothing is taken. Rows without id take
    their place from their text, so equal ones follow each other.
    """
    spark, at = docs.sparkSession, work_dir(docs.sparkSession)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), shuffled(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("null"))).alias("place"))
    sized = materialize(sized, f"{at}/sizes")
    ranges, n = RANGES, sized.count()
    while ranges * RANGE_ROWS < n and ranges < 1 << 24:
        ranges *= 2
    sized = sized.withColumn("range", F.shiftright("place", SHUFFLED_BITS - (ranges.bit_length() - 1)))

    by_range = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    sources = materialize(source_targets(by_range.groupBy("source").agg(F.sum("range_size").alias("source_size")), copies, weight), f"{at}/sources")
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.withColumn("start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    starts = _join(starts, sources, "source").select("source", "range", "start", "source_size", "target")

    own = Window.partitionBy("source", "range").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = _join(sized, starts, "source", "range").withColumn("end", F.col("start") + F.sum("size").over(own)).drop("start", "place")
    placed = materialize(placed, f"{at}/placed")

    ends = F.array(*[F.col("end") + k * F.col("source_size") for k in range(copies)])
    each = placed.where("size > 0").select("doc_id", "source", "size", "range", "end", F.posexplode(F.transform(ends, lambda x: x / F.col("target"))).alias("copy", "finish"))
    # the global order by finish time: in ranges of time, each as long as a range of documents on average
    last = F.least(F.floor(F.col("finish") * ranges), F.lit((1 << 40))).alias("slot")
    each = materialize(each.withColumn("slot", last), f"{at}/copies")
    by_slot = each.groupBy("slot").agg(F.sum("size").alias("slot_size"))
    before = F.sum("slot_size").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    by_slot = by_slot.withColumn("before", F.coalesce(before, F.lit(0))).drop("slot_size")
    turn = Window.partitionBy("slot").orderBy("finish", F.col("source").asc_nulls_last(), "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, 0)
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    served = each.join(by_slot, "slot").withColumn("served", F.col("before") + F.sum("size").over(turn)).where(F.col("served") <= budget)
    # copies of one document follow each other in its source, so a document's are its first ones
    counts = served.groupBy("source", "range", "end").agg(F.count("*").alias("copies"))
    mix = _join(placed, counts, "source", "range", "end", how="left").withColumn("taken", (F.when(F.col("size") > 0, F.coalesce("copies", F.lit(0))).otherwise(0) * F.col("size")).cast("long"))
    return mix.select("doc_id", "source", "size", "source_size", "target", "taken", F.when(F.col("size") > 0, F.col("end") / F.col("target")).alias("finish"), "range")


def _join(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """An equi-join in which null equals null."""
    other = right.select(*[F.col(k).alias(f"other_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"other_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"other_{k}" for k in keys])


def mix(docs: DataFrame, copies: int = 3, weight=_cycle, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it is taken, sorted
    globally by virtual finish time."""
    plan = plan_mix(docs, copies, weight, id_col, text_col, source_col)
    turn = F.struct("finish", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).cast("int").alias("copies"), F.try_divide("source_size", "target").alias("round"))
    turns = plan.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size")).agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    turns = turns.where(F.exists("_turns", lambda t: t["copies"] > 0))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size"))
    joined = _join(rows, turns, "_id", "_source", "_size")
    once = joined.where(F.size("_turns") == 1).withColumn("_nth", F.lit(1))  # others repeat an id, source and size
    nth = F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy(F.col(f"_row.`{text_col}`")))
    turned = once.unionByName(joined.where(F.size("_turns") > 1).withColumn("_nth", nth)).withColumn("_turn", F.get("_turns", F.col("_nth") - 1)).where("_turn.copies > 0")
    copied = turned.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_turn.copies") - 1)))
    return copied.orderBy(F.col("_turn.finish") + F.col("_copy") * F.col("_turn.round"), "_id").select("_row.*")


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, 'null')), 1, 15))::BIGINT AS place
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM totals),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM ranked),
targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE,
    coalesce((SELECT level FROM levels WHERE level <= 3 * source_size / weight ORDER BY 3 * source_size / weight, level LIMIT 1), 0) * weight) AS target
  FROM ranked),
placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS stop
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT *, (stop + k * source_size) / target AS finish FROM placed, range(3) r(k) WHERE size > 0),
queue AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, doc_id, size, k ROWS UNBOUNDED PRECEDING) AS served FROM copies),
served AS (SELECT source, stop, count(*) AS n FROM queue WHERE served <= (SELECT sum(size) FROM placed) GROUP BY source, stop)
SELECT p.doc_id, p.size, p.source_size, p.target, CASE WHEN p.size > 0 THEN p.size * coalesce(s.n, 0) ELSE 0 END::BIGINT AS taken
FROM placed p LEFT JOIN served s ON p.source IS NOT DISTINCT FROM s.source AND p.stop = s.stop
"""
