"""Sheets of hand-made rows: headers by alias, good and rejected rows, and what is new."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import keys, values
from shelfwise.sources.versions import scratch

# What storefront and marketplace sheets call our fields.
ALIASES: dict[str, tuple[str, ...]] = {
    "product_id": ("product_id", "id", "handle", "product handle", "item id"),
    "sku": ("sku", "variant sku", "sku code", "item code"),
    "gtin": ("gtin", "ean", "upc", "barcode", "variant barcode"),
    "brand": ("brand", "vendor", "brand name", "manufacturer"),
    "product_name": ("product_name", "title", "name", "product title", "product"),
    "variant": ("variant", "variant title", "size", "weight", "pack size", "option1 value"),
    "mrp": ("mrp", "compare at price", "compare_at_price", "list price", "variant compare at price"),
    "selling_price": ("selling_price", "price", "sale price", "variant price", "offer price", "discounted price"),
    "in_stock": ("in_stock", "available", "stock", "inventory", "status"),
    "product_url": ("product_url", "url", "link", "product link"),
    "image_url": ("image_url", "image", "image src", "images"),
    "categories": ("categories", "category", "collection", "type", "product type"),
}
SITE_ALIASES = {"site": ("site", "platform", "retailer", "source", "marketplace")}
REQUIRED = ("brand", "product_name", "selling_price")
#: Where a row stands: its file, its line there, and its number over all files.
PLACE = ("file", "line", "ordinal")


def _fold(header: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", header.lower()).strip("_")


def header_map(headers: Sequence[str], aliases: Mapping[str, Sequence[str]] = ALIASES) -> dict[str, str]:
    """Our field to the sheet's header; the first alias that is there wins."""
    there = {_fold(h): h for h in headers if h and h.strip()}
    out = {}
    for field, names in aliases.items():
        header = next((there[_fold(n)] for n in names if _fold(n) in there), None)
        if header is not None:
            out[field] = header
    return out


def canonical(sheet: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES, required: Sequence[str] = REQUIRED) -> DataFrame:
    """The sheet's text columns under our names, null where it has none; missing required ones are an error."""
    found = header_map(sheet.columns, aliases)
    missing = [f for f in required if f not in found]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}; recognized: {', '.join(sorted(found)) or 'none'}")
    return sheet.select(*[(F.trim(keys.text(F.col(f"`{found[f]}`"))) if f in found else F.lit("")).alias(f) for f in aliases], *[c for c in PLACE if c in sheet.columns])


def own_catalogue(sheet: DataFrame, site: str) -> DataFrame:
    """Products of one's own sheet (with a column ``line``); rows without name are left out, and the id is
    the sheet's, else the SKU, else the row's number (over all files, where the sheet has several)."""
    t = canonical(sheet)
    mrp, price = values.sheet_number(F.col("mrp")), values.sheet_number(F.col("selling_price"))
    t = t.where("product_name <> ''").withColumns({"n_mrp": mrp, "n_price": price})
    pid = F.coalesce(F.nullif("product_id", F.lit("")), F.nullif("sku", F.lit("")), F.col("ordinal" if "ordinal" in sheet.columns else "line").cast("string"))
    return t.select(F.lit(site).alias("site"), pid.alias("product_id"), "brand", "product_name", F.filter(F.array("categories"), lambda x: x != "").alias("categories"), "sku", keys.normalize_gtin(F.col("gtin")).alias("gtin"), "variant", F.col("n_mrp").alias("mrp"), F.col("n_price").alias("selling_price"), values.discount_pct(F.col("n_mrp"), F.col("n_price")).alias("discount_pct"), values.boolean_word(F.col("in_stock")).alias("in_stock"), "product_url", "image_url")


def manual_rows(sheet: DataFrame, default_site: str, sites: Sequence[str] = ()) -> DataFrame:
    """Rows of a hand-made sheet with ``line`` and ``reject_reason`` (null for good ones)."""
    found = header_map(sheet.columns, ALIASES | SITE_ALIASES)
    t = canonical(sheet, ALIASES | SITE_ALIASES, ("brand", "product_name")) if "site" in found else canonical(sheet, ALIASES, ("brand", "product_name")).withColumn("site", F.lit(""))
    site = F.lower(F.when(F.col("site") == "", F.lit(default_site)).otherwise(F.col("site")))
    reason = F.when(F.col("brand") == "", "brand is blank").when(F.col("product_name") == "", "product name is blank")
    if sites:
        reason = reason.when(~site.isin(*sites), "unknown site")
    mrp, price = values.sheet_number(F.col("mrp")), values.sheet_number(F.col("selling_price"))
    pid = F.when(F.col("product_id") != "", F.col("product_id")).otherwise(keys.manual_id(F.col("sku"), F.col("brand"), F.col("product_name")))
    return t.select(site.alias("site"), pid.alias("product_id"), "brand", "product_name", "variant", "sku", keys.normalize_gtin(F.col("gtin")).alias("gtin"), mrp.alias("mrp"), price.alias("selling_price"), values.discount_pct(mrp, price).alias("discount_pct"), values.boolean_word(F.col("in_stock")).alias("in_stock"), F.filter(F.transform(F.split("categories", r"[|;,]"), lambda x: F.trim(x)), lambda x: x != "").alias("categories"), "product_url", "image_url", *[c for c in PLACE if c in sheet.columns], reason.alias("reject_reason"))


def select_new(sheet: DataFrame, stored: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """The sheet's rows with ``outcome``: null for rows to insert, else why not. Rows are in the order of
    ``order``, by default of file (if there is one) and line; two rows of one place are an error.

    A row is known by its id or by its brand and name. Within the sheet a row loses to an earlier
    *accepted* row of its id or identity; acceptance is settled in rounds, the earliest open row of both
    its id and its identity first, so chains come out as in a walk over the sheet.
    """
    spark, order = sheet.sparkSession, order or [c for c in ("file", "line") if c in sheet.columns]
    named = lambda df: df.withColumns({"ident": keys.text_identity(F.col("site"), F.col("brand"), F.col("product_name"))})
    known = named(stored)
    ids = known.select("site", "product_id").distinct().withColumn("has_id", F.lit(True))
    idents = known.where("brand <> '' OR product_name <> ''").select("ident").distinct().withColumn("has_ident", F.lit(True))
    judged = named(sheet).join(ids, ["site", "product_id"], "left").join(idents, "ident", "left")
    outcome = F.when(F.col("has_id"), "product_id already stored").when(F.col("has_ident"), "brand and name already stored")
    folder = scratch(spark)
    judged.withColumn("outcome", outcome).withColumn("at", F.struct(*order)).write.parquet(f"{folder}/judged")
    judged = spark.read.parquet(f"{folder}/judged")
    if not judged.groupBy("at").count().where("count > 1").isEmpty():
        raise ValueError(f"several rows have the same {', '.join(order)}")
    judged.where("outcome IS NULL").select("site", "product_id", "ident", "at").write.parquet(f"{folder}/open0")
    decided, i = [], 0
    while not (rest := spark.read.parquet(f"{folder}/open{i}")).isEmpty():
        first_id = F.min("at").over(Window.partitionBy("site", "product_id"))
        first_ident = F.min("at").over(Window.partitionBy("ident"))
        rest = rest.withColumn("take", (F.col("at") == first_id) & (F.col("at") == first_ident))
        take = rest.where("take")
        lost = rest.where("NOT take").join(take.select("site", "product_id").distinct().withColumn("by_id", F.lit(True)), ["site", "product_id"], "left").join(take.select("ident").distinct().withColumn("by_ident", F.lit(True)), "ident", "left")
        why = F.when(F.col("by_id"), "duplicate product_id in the sheet").when(F.col("by_ident"), "duplicate brand and name in the sheet")
        lost.select("at", "site", "product_id", "ident", why.alias("why")).write.parquet(f"{folder}/lost{i}")
        lost = spark.read.parquet(f"{folder}/lost{i}")
        decided.append(lost.where("why IS NOT NULL").select("at", "why"))
        lost.where("why IS NULL").select("site", "product_id", "ident", "at").write.parquet(f"{folder}/open{i + 1}")
        i += 1
    out = judged
    if decided:
        reasons = decided[0]
        for d in decided[1:]:
            reasons = reasons.unionByName(d)
        out = judged.join(reasons, "at", "left").withColumn("outcome", F.coalesce("outcome", "why"))
    return out.select(*sheet.columns, "outcome")


def import_sheet(sheet: DataFrame, stored: DataFrame, default_site: str, sites: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, all rows with their outcome): a plan; the caller appends the first to the table."""
    rows = manual_rows(sheet, default_site, sites)
    bad = rows.where("reject_reason IS NOT NULL").withColumn("outcome", F.col("reject_reason"))
    judged = select_new(rows.where("reject_reason IS NULL"), stored)
    return judged.where("outcome IS NULL").drop("outcome", "reject_reason", *PLACE), judged.unionByName(bad)


def import_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy(F.coalesce("outcome", F.lit("inserted")).alias("outcome")).agg(F.count("*").alias("rows"), F.array_sort(F.collect_set("site")).alias("sites"))
