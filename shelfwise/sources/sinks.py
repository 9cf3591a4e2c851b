"""Sinks: exports, reports and snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.values import to_cell
from shelfwise.operators.catalogue import canonical_order
from shelfwise.schema import HISTORY_KEY, PRODUCT_COLUMNS
from shelfwise.sources.readers import exists
from shelfwise.sources.versions import VersionedTable, drop, stored


def csv_cells(products: DataFrame) -> DataFrame:
    """Product columns in their order as text cells, nested values as JSON."""
    return products.select(*[to_cell(F.col(c), products.schema[c].dataType).alias(c) for c in PRODUCT_COLUMNS if c in products.columns])


def export_products(products: DataFrame, folder: str, by_site: bool = False) -> DataFrame:
    """Write the sorted catalogue as CSV; nothing to export is an error. Returns the rows of each site. The
    products are computed once: their cells are stored, and counted, put in ranges and sorted from there."""
    ready = stored(csv_cells(products))
    counts = stored(ready.groupBy("site").agg(F.count("*").alias("products")))
    if counts.isEmpty():
        raise ValueError("no products to export")
    cells = canonical_order(ready)
    writer = cells.withColumn("part_site", F.col("site")).write.partitionBy("part_site") if by_site else cells.write
    writer.mode("errorifexists").options(header=True, escape='"', quoteAll=True).csv(folder)
    drop(ready)
    return counts


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """Replace the partitions of the snapshot's sites in a table partitioned by site; others stay."""
    snapshot.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site").parquet(path)


#: Parts of a site by a hash of the product's id, in tables that are rewritten part by part.
BUCKETS = 64


def with_bucket(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``bucket``, the part of its site that a product is in."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("product_id"), F.lit(buckets)).cast("int"))


def touched_parts(stored: DataFrame, new: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``stored``, a table partitioned by site and bucket, in the parts that ``new`` has keys of.
    The scan reads no other files. At most ``buckets`` parts a site come to the driver."""
    parts: dict[str, list[int]] = {}
    for r in with_bucket(new, buckets).select("site", "bucket").distinct().collect():
        parts.setdefault(r.site, []).append(r.bucket)
    wanted = F.lit(False)
    for site, own in parts.items():
        wanted = wanted | ((F.col("site") == site) & (F.col("bucket").isin(own) if len(own) < buckets else F.lit(True)))
    return stored.where(wanted)


def write_parts(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Put the rows, which are whole parts, in place of what the table at ``path`` has there; other parts stay.
    Each part is written by one task. The rows are computed before a part is replaced, so they may come
    from the table itself; a write that failed may be done again."""
    ready = stored(with_bucket(rows, buckets))
    ready.repartition("site", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site", "bucket").parquet(path)
    drop(ready)


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that ``write_parts`` wrote, with ``bucket``; empty where there is none yet."""
    kinds = [*T._parse_datatype_string(schema).fields, T.StructField("bucket", T.IntegerType())]
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType(kinds))
    return spark.read.schema(T.StructType(kinds)).parquet(path)


def upsert_parts(spark: SparkSession, path: str, new: DataFrame, schema: str, buckets: int = BUCKETS) -> None:
    """Merge rows into a current table by key: only the parts that they fall in are read and written. Empty rich
    fields keep what is stored. The same rows again change nothing."""
    from shelfwise.operators import catalogue

    new = stored(new)
    table = touched_parts(read_parts(spark, path, schema), new, buckets).drop("bucket")
    write_parts(catalogue.upsert(table, catalogue.preserve_rich_fields(new, table)), path, buckets)
    drop(new)


#: Points of a day, about, that one task writes.
POINTS = 1_000_000


def append_days(spark: SparkSession, path: str, points: DataFrame, schema: str, order: Sequence[str] = (), period: str = "day") -> None:
    """Add price points to a history partitioned by ``day``, the date of ``scraped_at`` (or the first of its
    ``period``, such as month): those whose key it lacks. Points without a time have no day and are left out. A point's day follows from its key, so only the
    days of the batch are read; at most one date for each of them comes to the driver. A day of more than ``POINTS``
    points is written by several tasks."""
    from shelfwise.operators import catalogue

    dated = stored(points.withColumn("day", F.to_date(F.date_trunc(period, "scraped_at"))))
    kinds = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("day", T.DateType())])
    history = spark.read.schema(kinds).parquet(path) if exists(spark, path) else spark.createDataFrame([], kinds)
    sizes = {r.day: r.points for r in dated.groupBy("day").agg(F.count("*").alias("points")).collect()}
    own = history.where(F.col("day").isin([d for d in sizes if d is not None]))
    fresh = catalogue.append_history(own, dated.where("day IS NOT NULL").select(history.columns), ("day", *HISTORY_KEY), order)
    pieces = F.lit(1)
    for day, n in sizes.items():
        if day is not None and n > POINTS:
            pieces = F.when(F.col("day") == day, -(-n // POINTS)).otherwise(pieces)
    # the history's files are listed already, and new ones are there after the last row has been read
    fresh.repartition("day", F.pmod(F.xxhash64(*HISTORY_KEY), pieces)).write.mode("append").partitionBy("day").parquet(path)
    drop(dated)


class DayHistory:
    """A price history at ``path``, in parts by day (or another ``period``). Rows are only ever added, by
    ``append_days``, so no rewrite can lose any, and adding the same points again changes nothing; one writer
    at a time."""

    def __init__(self, spark: SparkSession, path: str, period: str = "day"):
        self.spark, self.path, self.period = spark, path, period

    def read(self, schema: str) -> DataFrame:
        """All points, or none of ``schema``; a filter on ``scraped_at`` alone doesn't prune days."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        kinds = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("day", T.DateType())])
        return self.spark.read.schema(kinds).parquet(self.path).drop("day")

    def add(self, points: DataFrame, schema: str, order: Sequence[str] = ()) -> None:
        """Add the points whose key the history lacks; columns that they lack are null."""
        kinds = T._parse_datatype_string(schema)
        whole = points.select(*[(F.col(f.name) if f.name in points.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields])
        append_days(self.spark, self.path, whole, schema, order, self.period)


def write_outputs(outputs: Mapping[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Each named DataFrame in a folder of its own."""
    for name, df in outputs.items():
        if kind == "csv":
            df = df.select(*[to_cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
            df.write.options(header=True, escape='"').csv(f"{folder}/{name}")
        else:
            df.write.format(kind).save(f"{folder}/{name}")


def sync(table: VersionedTable, history: DayHistory, products: DataFrame, now) -> None:
    """Merge all rows into the current table and add one history point for each."""
    from shelfwise.operators import catalogue
    from shelfwise.schema import CATALOGUE_DDL, HISTORY_DDL

    stored = table.read(CATALOGUE_DDL)
    table.write(catalogue.upsert(stored, catalogue.preserve_rich_fields(products, stored)))
    history.add(catalogue.history_rows(products, now), HISTORY_DDL)
