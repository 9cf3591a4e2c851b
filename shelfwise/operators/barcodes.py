"""Barcodes: found offline, passed on between matched products, and reported."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.keys import attribute_gtin, text
from shelfwise.functions.titles import size_label
from shelfwise.operators import catalogue, matching
from shelfwise.schema import KEY

PROPAGATE_AT = 0.90


def backfill(products: DataFrame) -> DataFrame:
    """site, product_id, gtin: barcodes that blank rows' own attributes hold."""
    found = attribute_gtin(F.col("product_attributes"))
    return products.where(F.trim(text(F.col("gtin"))) == "").select(*KEY, found.alias("gtin")).where("gtin <> ''")


def sweep_targets(products: DataFrame, refresh_all: bool = False, recheck: bool = False) -> tuple[DataFrame, DataFrame]:
    """(found offline, pages still to open): blank barcodes, those found in attributes first; a page is
    opened only where no attributes are stored, unless ``recheck``. Keys are unique, so each row tells by
    itself which it is."""
    blank = products if refresh_all else products.where(F.trim(text(F.col("gtin"))) == "")
    offline = backfill(blank.withColumn("gtin", F.lit("")))
    return offline, blank.where(attribute_gtin(F.col("product_attributes")) == "" if recheck else F.coalesce(F.size("product_attributes"), F.lit(0)) <= 0)


def _donor_rank(site: Column, order: Sequence[str]) -> Column:
    return matching.site_rank(site, order)


def plan_propagation(groups: DataFrame, donor_order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(fills, conflicts) of matched groups: with one barcode in a match, its blank members get it from the
    first donor; with several, the match is reported with its first two sites."""
    coded = F.col("gtin") != ""
    per = groups.groupBy("match").agg(
        F.size(F.collect_set(F.when(coded, F.col("gtin")))).alias("codes"),
        F.min_by(F.when(coded, F.struct("site", "product_id", "gtin")), F.when(coded, _donor_rank(F.col("site"), donor_order))).alias("donor"),
        F.slice(F.array_sort(F.collect_list(F.when(coded, F.struct("site", "gtin")))), 1, 2).alias("two"),
        F.first(F.when(F.col("is_anchor"), F.struct("brand", "product_name")), ignorenulls=True).alias("anchor"),
        F.round(F.first("confidence"), 3).alias("sure"),
    )
    fills = groups.where(~coded).join(per.where("codes = 1").select("match", "donor", "sure"), "match")
    fills = fills.select("site", "product_id", "brand", "product_name", F.col("donor.gtin").alias("gtin"), F.col("donor.site").alias("donor_site"), F.col("donor.product_id").alias("donor_product_id"), F.col("sure").alias("confidence"), size_label(F.col("size")).alias("size"))
    bad = per.where("codes > 1").select("anchor.*", F.col("two")[0]["site"].alias("left_site"), F.col("two")[0]["gtin"].alias("left_gtin"), F.col("two")[1]["site"].alias("right_site"), F.col("two")[1]["gtin"].alias("right_gtin"), F.col("sure").alias("confidence"))
    return fills, bad


def propagate(products: DataFrame, threshold: float = PROPAGATE_AT, site_order: Sequence[str] = (), donor_order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    _, groups, _ = matching.match_products(products.select(*matching.TITLED), threshold, site_order)
    return plan_propagation(groups, donor_order)


def apply_fills(stored: DataFrame, fills: DataFrame) -> DataFrame:
    """Only the barcode of blank rows changes."""
    return catalogue.patch(stored, fills.select(*KEY, "gtin"), "gtin")


def cross_fill(products: DataFrame, site: str, threshold: float = PROPAGATE_AT, brands: DataFrame | None = None) -> DataFrame:
    """Barcodes for one site's blank rows from matched rows of others, donors by name."""
    if brands is not None:
        products = allow_brands(products, brands)
    fills, _ = propagate(products, threshold, (site,))
    return fills.where(F.col("site") == site)


def allow_brands(products: DataFrame, brands: DataFrame, column: str = "brand") -> DataFrame:
    """Rows of allowed brands; an empty list allows all. The list is joined, not broadcast by force."""
    from shelfwise.functions.keys import brand_key

    listed = brands.select(brand_key(F.col(column)).alias("allowed")).where("allowed <> ''").distinct()
    return products if listed.isEmpty() else products.join(listed, brand_key(products[column]) == listed["allowed"], "left_semi")


def propagation_summary(products: DataFrame, fills: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row of counts for each site, and one for all."""
    per = products.groupBy("site").agg(F.count("*").alias("considered"), F.count_if(text(F.col("gtin")) != "").alias("had_gtin"))
    filled = fills.groupBy("site").agg(F.count("*").alias("filled"))
    clashes = conflicts.select(F.explode(F.array("left_site", "right_site")).alias("site")).groupBy("site").agg(F.count("*").alias("conflicts"))
    return per.join(filled, "site", "left").join(clashes, "site", "left").fillna(0)


def coverage(products: DataFrame) -> DataFrame:
    """By site: stored, with barcode, without, and the share in per cent."""
    has = F.count_if(F.trim(text(F.col("gtin"))) != "")
    return products.groupBy("site").agg(F.count("*").alias("stored"), has.alias("with_gtin"), (F.count("*") - has).alias("targeted"), F.round(has * 100 / F.count("*"), 2).alias("coverage_pct"))


def gtin_report(groups: DataFrame, sites: Sequence[str], refreshed: DataFrame | None = None, source_order: Sequence[str] = ()) -> DataFrame:
    """Matches on all ``sites`` with the resolved barcode and its source: a refreshed value first, then the
    sites in order; one block of columns for each site."""
    own = matching.matches_on(groups, sites)
    if refreshed is not None:
        own = own.join(refreshed.select(F.col("site").alias("f_site"), F.col("product_id").alias("f_id"), F.col("gtin").alias("fresh")), (F.col("site") == F.col("f_site")) & (F.col("product_id") == F.col("f_id")), "left")
    else:
        own = own.withColumn("fresh", F.lit(None).cast("string"))
    fresh, coded = F.coalesce("fresh", F.lit("")) != "", F.col("gtin") != ""
    rank = _donor_rank(F.col("site"), source_order)
    found = F.coalesce(F.min_by(F.when(fresh, F.struct(F.col("fresh").alias("gtin"), "site")), F.when(fresh, rank)), F.min_by(F.when(coded, F.struct("gtin", "site")), F.when(coded, rank)))
    anchor = lambda c: F.first(F.when(F.col("is_anchor"), F.col(c)), ignorenulls=True)
    blocks = [F.first(F.when(F.col("site") == s, F.col(c)), ignorenulls=True).alias(f"{s}_{c}") for s in sites for c in ("product_id", "product_name", "selling_price") if c in groups.columns]
    out = own.groupBy("match").agg(anchor("brand").alias("brand"), anchor("product_name").alias("product"), found.alias("found"), F.round(F.first("confidence"), 3).alias("confidence"), *blocks)
    out = out.withColumns({"gtin": F.coalesce("found.gtin", F.lit("")), "gtin_source": F.coalesce("found.site", F.lit(""))}).drop("found", "match")
    return out.orderBy(F.col("gtin") == "", F.lower("brand"), F.lower("product"))


def report_counts(report: DataFrame) -> DataFrame:
    """Rows with a barcode by source."""
    return report.where("gtin <> ''").groupBy("gtin_source").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "gtin_source")
