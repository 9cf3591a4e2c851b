"""Price comparison of matched products: one row a match, a block of columns a platform."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.keys import text
from shelfwise.functions.titles import size_label

PLATFORM_COLUMNS = {"selling_price": "selling_price", "mrp": "mrp", "discount_pct": "discount_pct", "in_stock": "in_stock", "name": "product_name", "url": "product_url"}


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.round(part / whole * 100, 2))


def price_summary(prices: DataFrame, group: Sequence[str], platforms: Sequence[str], own_site: str = "") -> DataFrame:
    """For each group of (site, selling_price) rows: least and greatest price, the gap, its per cent, the
    cheapest site (ties by the order of ``platforms``), and the own price against the cheapest rival."""
    rank = F.array_position(F.array(*map(F.lit, platforms)), F.col("site"))
    priced = F.col("selling_price").isNotNull()
    mine = F.max(F.when(F.col("site") == own_site, F.col("selling_price")))
    rival = F.min(F.when(F.col("site") != own_site, F.col("selling_price")))
    out = prices.where(rank > 0).groupBy(*group).agg(
        F.min("selling_price").alias("min_price"), F.max("selling_price").alias("max_price"),
        F.min_by(F.when(priced, F.col("site")), F.when(priced, F.struct("selling_price", rank.alias("rank")))).alias("cheapest_platform"),
        mine.alias("own"), rival.alias("rival"),
    )
    out = out.withColumns({"price_gap": F.round(F.col("max_price") - F.col("min_price"), 2), "price_gap_pct": _percent(F.col("max_price") - F.col("min_price"), F.col("min_price"))})
    if own_site and own_site in platforms:
        out = out.withColumns({f"{own_site}_vs_cheapest": F.round(F.col("own") - F.col("rival"), 2), f"{own_site}_vs_cheapest_pct": _percent(F.col("own") - F.col("rival"), F.col("rival"))})
    return out.drop("own", "rival")


def comparison_rows(groups: DataFrame, platforms: Sequence[str], own_site: str = "") -> DataFrame:
    """One row for each match: identity, six columns for each platform, and the price summary."""
    def of(p: str, c: str) -> Column:
        return F.first(F.when(F.col("site") == p, F.col(c)), ignorenulls=True)

    anchor = lambda c: F.first(F.when(F.col("is_anchor"), c), ignorenulls=True)
    blocks = [(F.coalesce(of(p, c), F.lit("")) if name in ("name", "url") else of(p, c)).alias(f"{p}_{name}") for p in platforms for name, c in PLATFORM_COLUMNS.items() if c in groups.columns]
    wide = groups.groupBy("match").agg(
        anchor(F.col("brand")).alias("brand"), anchor(F.col("product_name")).alias("product"), anchor(F.col("form")).alias("form"),
        anchor(size_label(F.col("size"))).alias("size"), F.coalesce(anchor(F.col("size.pack")), F.lit(1)).alias("pack"),
        *([F.array_join(anchor(F.col("categories")), ", ").alias("categories")] if "categories" in groups.columns else []),
        F.array_join(F.array_sort(F.collect_set("site")), ", ").alias("platforms"), F.count("*").alias("platform_count"),
        F.first("method").alias("match_method"), F.round(F.first("confidence"), 3).alias("confidence"), F.array_join(F.first("notes"), "; ").alias("notes"), *blocks,
    )
    return wide.join(price_summary(groups, ["match"], platforms, own_site), "match", "left")


def needs_review(rows: DataFrame, below: float = 0.80) -> DataFrame:
    return rows.where((F.col("confidence") < below) | (F.col("notes") != ""))


def by_platforms(rows: DataFrame) -> DataFrame:
    return rows.groupBy("platforms").agg(F.count("*").alias("matches")).orderBy(F.desc("matches"), "platforms")


def single_site_rows(unmatched: DataFrame) -> DataFrame:
    """Products that one site alone has."""
    return unmatched.select("site", "brand", "product_name", "variant", size_label(F.col("size")).alias("size"), "form", *[c for c in ("mrp", "selling_price", "in_stock", "product_url") if c in unmatched.columns])


def sorted_rows(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.orderBy(*[F.lower(text(F.col(c))) for c in columns])
