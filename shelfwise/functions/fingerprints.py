"""Fingerprints of a product's listing and detail fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.schema import RICH_FIELDS, SOURCE_FIELDS


def stable(value: Column, kind: T.DataType) -> Column:
    """A form in which equal contents are equal texts: text lists are sets, sorted by fold and then by
    text; maps are sorted entries; numbers that are no integers have five decimals."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.transform(F.array_sort(F.transform(F.array_distinct(value), lambda x: F.struct(F.lower(x).alias("fold"), x.alias("text")))), lambda x: x["text"])
    if isinstance(kind, T.MapType):
        return F.array_sort(F.map_entries(value))
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.round(value.cast("double"), 5)
    return value


def fingerprint(df: DataFrame, fields: Sequence[str]) -> Column:
    """SHA-256 over the stable JSON form of those ``fields`` that ``df`` has."""
    known = [stable(F.col(f), df.schema[f].dataType).alias(f) for f in sorted(fields) if f in df.columns]
    return F.sha2(F.to_json(F.struct(*known), {"ignoreNullFields": "false"}), 256)


def source_fingerprint(df: DataFrame) -> Column:
    return fingerprint(df, SOURCE_FIELDS)


def detail_fingerprint(df: DataFrame) -> Column:
    return fingerprint(df, RICH_FIELDS)
