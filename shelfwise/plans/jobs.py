"""The jobs a user runs: each takes DataFrames and parameters and returns DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shelfwise.operators import barcodes, catalogue, changes, comparison, health, imports, matching
from shelfwise.schema import KEY
from shelfwise.sources import sinks
from shelfwise.sources.sinks import DayHistory
from shelfwise.sources.versions import VersionedTable
from shelfwise.streaming import micro_batches


def compare_catalogues(products: DataFrame, own: DataFrame | None = None, own_site: str = "", platforms: Sequence[str] = (), threshold: float = matching.THRESHOLD, review_below: float = matching.REVIEW_BELOW, brands: DataFrame | None = None) -> dict[str, DataFrame]:
    """Cross-site comparison: ``comparison``, ``review``, ``single_site``, ``by_platforms``."""
    rows = products if own is None else own.unionByName(products, allowMissingColumns=True)
    if brands is not None:
        rows = barcodes.allow_brands(rows, brands)
    order = ([own_site] if own_site else []) + [p for p in platforms if p != own_site]
    items, groups, rest = matching.match_products(rows, threshold, order)
    sites = [r[0] for r in items.select("site").distinct().collect()]  # a dimension: as many rows as sites
    order = [s for s in order if s in sites] + sorted(s for s in sites if s not in order)
    table = comparison.comparison_rows(groups, order, own_site)
    return {"comparison": comparison.sorted_rows(table.drop("match"), "brand", "product"), "review": comparison.needs_review(table, review_below).drop("match"), "single_site": comparison.sorted_rows(comparison.single_site_rows(rest), "site", "brand", "product_name"), "by_platforms": comparison.by_platforms(table)}


def write_comparison(outputs: dict[str, DataFrame], folder: str, kind: str = "csv") -> None:
    sinks.write_outputs(outputs, folder, kind)


def gtin_report(products: DataFrame, sites: Sequence[str], threshold: float = matching.THRESHOLD, refreshed: DataFrame | None = None, source_order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(report, rows by barcode source) of products on all ``sites``; barcodes in stored attributes count."""
    filled = catalogue.patch(products, barcodes.backfill(products), "gtin") if "product_attributes" in products.columns else products
    _, groups, _ = matching.match_products(filled, threshold, sites)
    report = barcodes.gtin_report(groups, sites, refreshed, source_order or sites)
    return report, barcodes.report_counts(report)


def propagate_gtins(products: DataFrame, threshold: float = barcodes.PROPAGATE_AT, sites: Sequence[str] = (), brands: DataFrame | None = None, donor_order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fills, conflicts, summary): a plan; ``apply`` with ``barcodes.apply_fills``."""
    rows = products.where(F.col("site").isin(*sites)) if sites else products
    rows = barcodes.allow_brands(rows, brands) if brands is not None else rows
    fills, conflicts = barcodes.propagate(rows, threshold, donor_order, donor_order)
    return fills, conflicts, barcodes.propagation_summary(rows, fills, conflicts)


def fill_gtins(products: DataFrame, site: str, captured: DataFrame | None = None, threshold: float = barcodes.PROPAGATE_AT, refresh_all: bool = False, brands: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(catalogue with barcodes, what was found with its origin) for one site: from attributes, then the last
    captured payload of each product, then matched products of other sites."""
    own = products.where(F.col("site") == site)
    offline, _ = barcodes.sweep_targets(own, refresh_all)
    found = offline.withColumn("origin", F.lit("attributes"))
    if captured is not None:
        last = captured.where("gtin <> ''").groupBy(*KEY).agg(F.max_by("gtin", "ord").alias("gtin"))
        last = last.join(own.where(F.lit(refresh_all) | (F.coalesce("gtin", F.lit("")) == "")).select(*KEY), list(KEY), "left_semi")
        found = found.unionByName(last.join(offline.select(*KEY), list(KEY), "left_anti").withColumn("origin", F.lit("page")))
    patched = catalogue.patch(products, found.select(*KEY, "gtin"), "gtin", only_missing=not refresh_all)
    borrowed = barcodes.cross_fill(patched, site, threshold, brands).select(*KEY, "gtin", F.lit("borrowed").alias("origin"))
    return catalogue.patch(patched, borrowed, "gtin"), found.unionByName(borrowed)


def found_by_origin(found: DataFrame) -> DataFrame:
    return found.groupBy("origin").agg(F.count("*").alias("found"))


def incremental_run(site: str, run_id: str, listing: DataFrame, details: DataFrame, table: VersionedTable, history: DayHistory, now: Column, schema: str, history_schema: str, listing_complete: bool = True, brand_filter: bool = False, refresh_days: int = 30, limit: int | None = None, ratio: float = 0.5, missing_runs: int = 3) -> DataFrame:
    """One incremental run of a site over normalised rows; returns its counters."""
    stored = table.read(schema)
    own = stored.where(F.col("site") == site)
    complete = changes.sweep_is_complete(listing, stored, site, listing_complete, ratio, brand_filter)
    flags = changes.detail_candidates(listing, own, now, refresh_days, limit)
    current = changes.merge_details(listing, details)
    rows, points = changes.incremental_state(current, details, own, flags, now, run_id)
    following = changes.incremental_table(stored, rows, listing, site, run_id, now, complete, missing_runs)
    counters = changes.run_counters(flags)
    history.add(points, history_schema)  # first: its points are of what the table was before
    table.write(following)
    return counters


def storefront_run(source: DataFrame, merge: Callable[[DataFrame, int], None], table: VersionedTable, schema: str, runs: DataFrame, site: str, run_id: str, checkpoint: str, now: Column, complete: bool, quarantine: str, missing_runs: int = 3) -> DataFrame:
    """One sweep of a storefront as one job: opens the run, merges the stream's batches, and closes the run;
    returns the run log.

    What a batch holds is counted by the pass that writes it. A batch that fails is set aside in
    ``quarantine`` and the stream goes on; the run is then partial, and no missing product is aged, as after
    a listing that was not whole. ``micro_batches.merge_quarantine`` merges such batches later. A run that
    starts again goes on from its checkpoint.
    """
    seen = {"products_seen": 0, "failures": 0}

    def counted(batch: DataFrame, batch_id: int) -> None:
        watched = Observation(f"{run_id}-{batch_id}")
        rows = F.count_if(F.coalesce("product_id", F.lit("")) != "")
        try:
            merge(batch.observe(watched, rows.alias("rows")), batch_id)
            seen["products_seen"] += watched.get["rows"]
        except Exception:
            seen["failures"] += 1
            batch.write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")

    opened = catalogue.open_run(runs, site, run_id, now)
    micro_batches.run_to_end(source, counted, checkpoint)
    closed = micro_batches.close_stream(table, schema, opened, site, run_id, now, seen["failures"], complete, missing_runs)
    return catalogue.close_run(closed, run_id, "partial" if seen["failures"] or not complete else "success", now, **seen)


def refresh_site(site: str, listing: DataFrame, details: DataFrame, stored: DataFrame, plan: DataFrame, order: Sequence[str] = ("scraped_at", "ord")) -> DataFrame:
    """A site's new snapshot: detail rows, reused stored rows of quiet parents, listing rows for the rest."""
    reused = changes.stored_versions(plan, listing, stored)
    return changes.assemble_snapshot(listing, details, reused, order).where(F.col("site") == site)


def import_sheet(sheet: DataFrame, stored: DataFrame, default_site: str, sites: Sequence[str] = (), dry_run: bool = True, table: VersionedTable | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, outcome of every row); unless ``dry_run`` the rows are added to the table."""
    rows, outcomes = imports.import_sheet(sheet, stored, default_site, sites)
    if not dry_run:
        new = stored.limit(0).unionByName(rows.select([c for c in rows.columns if c in stored.columns]), allowMissingColumns=True)
        table.write((table.read() if table.versions() else stored).unionByName(new, allowMissingColumns=True))
    return rows, imports.import_counts(outcomes) if dry_run else outcomes


def health_report(runs: DataFrame, products: DataFrame, sites: Sequence[str], now: Column) -> DataFrame:
    """Run health and data freshness of each site, one finding a row."""
    run = health.run_health(runs, sites, now).select("site", F.lit("run").alias("check"), "level", "finding", "hours")
    data = health.data_freshness(products, sites, now).select("site", F.lit("data").alias("check"), "level", F.when(F.col("newest").isNull(), "no products").otherwise("newest").alias("finding"), "hours")
    return run.unionByName(data)
