"""Run health, data freshness, sweep audit, and the dashboard's numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sites(df: DataFrame, sites: Sequence[str]) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, sites))).alias("site"))


def _hours(moment: Column, now: Column) -> Column:
    return (now.cast("double") - moment.cast("double")) / 3600


def run_health(runs: DataFrame, sites: Sequence[str], now: Column, stuck_hours: float = 8, max_age_hours: float = 30) -> DataFrame:
    """site, level, finding of each site's latest run: never ran, stuck, failed, late (no run started
    lately) or ok. The latest is taken for each site, however many runs others have."""
    latest = runs.groupBy("site").agg(F.max_by(F.struct("status", "started_at", "products_seen", "message"), F.struct("started_at", "id")).alias("run"))
    age = _hours(F.col("run.started_at"), now)
    finding = F.when(F.col("run").isNull(), "never ran").when((F.col("run.status") == "running") & (age > stuck_hours), "stuck").when(F.col("run.status") == "failed", "failed").when(age > max_age_hours, "late").otherwise("ok")
    out = _sites(runs, sites).join(latest, "site", "left").withColumn("finding", finding)
    return out.select("site", F.when(F.col("finding") == "ok", "ok").otherwise("alert").alias("level"), "finding", F.round(age, 1).alias("hours"), F.col("run.status").alias("status"), F.col("run.products_seen").alias("products_seen"))


def data_freshness(catalogue: DataFrame, sites: Sequence[str], now: Column, max_age_hours: float = 30) -> DataFrame:
    """site, level, newest, hours: no products, or the newest one older than the limit, is an alert."""
    newest = catalogue.groupBy("site").agg(F.max("scraped_at").alias("newest"))
    age = _hours(F.col("newest"), now)
    level = F.when(F.col("newest").isNull() | (age > max_age_hours), "alert").otherwise("ok")
    return _sites(catalogue, sites).join(newest, "site", "left").select("site", level.alias("level"), "newest", F.round(age, 1).alias("hours"))


def latest_runs(runs: DataFrame, n: int = 40) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "id").limit(n)


def sweep_audit(pages: DataFrame, by: Sequence[str] = ("site", "category"), repeats: int = 2, page_limit: int | None = None) -> DataFrame:
    """From a log of pages (page_no, ids array, reported_end, failed): pages read, next page, whether the
    sweep is complete and why it stopped.

    The first reason in page order ends it: request_failed, empty_page, end_of_results, or
    repeated_pages, where a page lists the same ids as ``repeats`` before it; else page_limit or open.
    """
    at = Window.partitionBy(*by).orderBy("page_no")
    new = (~F.col("ids").eqNullSafe(F.lag("ids").over(at))).cast("int")
    marked = pages.withColumn("change", new).withColumn("run", F.sum("change").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.row_number().over(Window.partitionBy(*by, "run").orderBy("page_no")) - 1
    reason = F.when(F.coalesce("failed", F.lit(False)), "request_failed").when(F.coalesce(F.size("ids"), F.lit(0)) <= 0, "empty_page").when(F.coalesce("reported_end", F.lit(False)), "end_of_results").when(streak >= repeats, "repeated_pages")
    marked = marked.withColumn("reason", reason)
    out = marked.groupBy(*by).agg(F.count("*").alias("pages"), F.max("page_no").alias("last_page"), F.min(F.when(F.col("reason").isNotNull(), F.struct("page_no", "reason"))).alias("stop"))
    limit = (F.col("last_page") >= page_limit) if page_limit is not None else F.lit(False)
    out = out.withColumn("stop_reason", F.coalesce("stop.reason", F.when(limit, F.lit("page_limit")).otherwise(F.lit("open"))))
    complete = F.col("stop_reason").isin("empty_page", "end_of_results", "repeated_pages")
    failed = F.col("stop_reason") == "request_failed"
    return out.select(*by, "pages", F.when(failed, F.col("stop.page_no")).otherwise(F.coalesce("stop.page_no", "last_page") + 1).alias("next_page"), complete.alias("completed"), "stop_reason")


def duplicate_pages(pages: DataFrame, by: Sequence[str] = ("site", "category")) -> DataFrame:
    """Pages that list no id which an earlier page of the sweep doesn't."""
    each = pages.select(*by, "page_no", F.explode("ids").alias("id")).distinct()
    first = each.groupBy(*by, "id").agg(F.min("page_no").alias("page_no")).select(*by, "page_no").distinct()
    return pages.join(first, [*by, "page_no"], "left_anti").where(F.size("ids") > 0)


def kpis(products: DataFrame) -> DataFrame:
    """products, brands, mean discount, share in stock among those where it is known."""
    return products.agg(F.count("*").alias("products"), F.count_distinct(F.nullif("brand", F.lit(""))).alias("brands"), F.round(F.avg("discount_pct"), 2).alias("mean_discount"), F.round(F.avg(F.col("in_stock").cast("int")) * 100, 2).alias("in_stock_pct"))


def options(products: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column (of an array: of its elements), sorted."""
    value = F.explode(column) if products.schema[column].dataType.typeName() == "array" else F.col(column)
    return products.select(value.alias(column)).where(F.coalesce(column, F.lit("")) != "").distinct().orderBy(column)


def filtered_view(products: DataFrame, categories: Sequence[str], brands: Sequence[str]) -> DataFrame:
    """Products of a chosen brand with a chosen category; an empty choice shows nothing."""
    if not categories or not brands:
        return products.where("false")
    return products.where(F.arrays_overlap("categories", F.array(*map(F.lit, categories))) & F.col("brand").isin(*brands))


def brand_counts(products: DataFrame) -> DataFrame:
    return products.groupBy("brand").agg(F.count("*").alias("products")).orderBy(F.desc("products"), "brand")


def storefront_totals(products: DataFrame) -> DataFrame:
    return products.groupBy("site").agg(F.count("*").alias("collected"), F.count_if(F.coalesce("gtin", F.lit("")) != "").alias("with_gtin"))
