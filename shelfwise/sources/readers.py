"""Sources: files and tables as typed product rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.values import from_cell
from shelfwise.schema import CATALOGUE_DDL, PRODUCT_COLUMNS


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, all columns as text; a byte-order mark on the first header is dropped."""
    df = spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8").csv(path)
    return df.toDF(*[c.lstrip("﻿").strip('"') if i == 0 else c for i, c in enumerate(df.columns)])


def read_sheet(spark: SparkSession, path: str, first_line: int = 2) -> DataFrame:
    """As ``read_csv_text``, with ``file``, ``line``, the row's number in its file (files are read by one task
    each), and ``ordinal``, which goes on over the files in the order of their paths: the line, if there is one."""
    df = read_csv_text(spark, path).withColumns({"file": F.col("_metadata.file_path"), "_at": F.monotonically_increasing_id()})
    nth = F.row_number().over(Window.partitionBy("file").orderBy("_at")).cast("long")
    numbered = df.withColumn("line", nth + (first_line - 1)).drop("_at")
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    offsets = df.groupBy("file").agg(F.count("*").alias("n")).select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    return numbered.join(offsets, "file").withColumn("ordinal", F.col("line") + F.col("_before")).select(*numbered.columns, "ordinal")


def read_products_csv(spark: SparkSession, path: str) -> DataFrame:
    """The combined export as product rows: unreadable cells are null or empty; a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in PRODUCT_COLUMNS.items()))
    return typed(read_csv_text(spark, path))


def typed(text: DataFrame) -> DataFrame:
    """Text cells as typed product columns; absent columns get their defaults."""
    return text.select(*[from_cell(F.col(f"`{c}`") if c in text.columns else F.lit(None).cast("string"), kind).alias(c) for c, kind in PRODUCT_COLUMNS.items()])


DISPLAY_COLUMNS = tuple(c for c in PRODUCT_COLUMNS if c != "description_html")
_STOCK = {"true": True, "false": False, "1": True, "0": False}


def display_frame(text: DataFrame) -> DataFrame:
    """An export's text cells as a frame to show: the display columns that are there, numbers (null where a
    cell is none), stock as a boolean for the few texts that mean one, and JSON collections, empty where
    a cell does not hold one."""
    out = []
    for c in (c for c in DISPLAY_COLUMNS if c in text.columns):
        kind, cell = PRODUCT_COLUMNS[c], F.trim(F.col(f"`{c}`"))
        if kind in ("double", "bigint"):
            value = cell.try_cast("double")
        elif kind == "boolean":
            value = F.create_map(*[F.lit(x) for pair in _STOCK.items() for x in pair])[F.lower(cell)]
        elif kind.startswith(("array", "map")):
            value = F.coalesce(F.from_json(F.when(cell.rlike(r"^[\[{]"), cell), kind), F.from_json(F.lit("{}" if kind.startswith("map") else "[]"), kind))
        else:
            value = F.coalesce(F.col(f"`{c}`"), F.lit(""))
        out.append(value.alias(c))
    return text.select(*out)


def read_allowed(spark: SparkSession, path: str, sites: Sequence[str], brands: DataFrame | None = None, schema: str = CATALOGUE_DDL) -> DataFrame:
    """The stored rows of the sites, of allowed brands if a list is given; rows without a key or a name, from
    which no product can be made, are left out."""
    from shelfwise.operators.barcodes import allow_brands

    rows = read_catalogue(spark, path, sites=sites, schema=schema).where("coalesce(trim(product_id), '') <> '' AND coalesce(trim(product_name), '') <> ''")
    return rows if brands is None else allow_brands(rows, brands)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_catalogue(spark: SparkSession, path: str, site: str | None = None, sites: Sequence[str] = (), columns: Sequence[str] = (), schema: str = CATALOGUE_DDL) -> DataFrame:
    """The stored table; a site is a partition filter and columns prune the scan."""
    df = spark.read.schema(schema).parquet(path)
    if site is not None:
        df = df.where(F.col("site") == site)
    if sites:
        df = df.where(F.col("site").isin(*sites))
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, site: str, lower: int, upper: int, parts: int, **options) -> DataFrame:
    """A site's rows of a database, read in parallel over ranges of its numeric id."""
    query = f"(SELECT * FROM {table} WHERE site = '{site.replace(chr(39), chr(39) * 2)}') AS t"
    return spark.read.format("jdbc").options(url=url, dbtable=query, partitionColumn="id", lowerBound=lower, upperBound=upper, numPartitions=parts, fetchsize=1000, **options).load()


def read_with_fallback(spark: SparkSession, table: str, csv: str, sites: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """(rows, where from): the table if it has rows, else the export."""
    if exists(spark, table):
        rows = read_catalogue(spark, table, sites=sites)
        if not rows.isEmpty():
            return rows, "table"
    rows = read_products_csv(spark, csv)
    if sites:
        rows = rows.where(F.col("site").isin(*sites))
    return rows, "csv" if not rows.isEmpty() else "none"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, damaged lines): lines that aren't JSON of the schema are kept apart, not fatal."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    plain = T._parse_datatype_string(schema)
    parsed = lines.select("value", F.from_json("value", T.StructType([*plain.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r._bad").isNotNull() | F.col("r").isNull()
    return parsed.where(~bad).select("r.*").drop("_bad"), parsed.where(bad).select("value")


def read_processed_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids, one a line; blank lines and those with control characters are left out."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where(r"id rlike '^[^\\x00-\\x1f]+$'").distinct()


def sitemap_urls(pages: DataFrame, pattern: str, body: str = "body") -> DataFrame:
    """Product addresses of sitemap bodies: those whose path matches, without query, each once."""
    urls = pages.select(F.explode(F.regexp_extract_all(F.col(body), F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url"))
    return urls.where(~F.contains(F.col("url"), F.lit("?")) & F.col("url").rlike(pattern)).distinct()
