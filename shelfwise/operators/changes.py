"""What has changed, what needs a detail request, and the next state of an incremental run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.fingerprints import detail_fingerprint, source_fingerprint
from shelfwise.functions.keys import parent_id
from shelfwise.functions.values import is_empty, older_than
from shelfwise.operators import catalogue
from shelfwise.schema import KEY, PRICE_FIELDS

REQUIRED_FIELDS = ("description", "image_urls")
CONTENT_FIELDS = ("description", "ingredients", "how_to_use", "image_urls")


def _as_old(stored: DataFrame, listed: Sequence[str]) -> DataFrame:
    """Stored rows with ``old_fp``, their fingerprint, computed of the ``listed`` columns where it isn't stored."""
    known = F.nullif(F.col("source_fingerprint"), F.lit("")) if "source_fingerprint" in stored.columns else F.lit(None).cast("string")
    comparable = stored.select([c for c in stored.columns if c in listed])
    return stored.withColumn("old_fp", F.coalesce(known, source_fingerprint(comparable)))


def with_stored(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """The listing with ``fp`` and, of the stored row, ``old`` (a struct, null for a new product) and
    ``old_fp``, computed where it isn't stored."""
    old = _as_old(stored, listing.columns).select(*KEY, "old_fp", F.struct(*stored.columns).alias("old"))
    return listing.withColumn("fp", source_fingerprint(listing)).join(old, list(KEY), "left")


def refresh_plan(listing: DataFrame, stored: DataFrame, now: Column, refresh_days: int = 30, required: Sequence[str] = REQUIRED_FIELDS, enabled: bool = True) -> DataFrame:
    """site, product_id, needed, reason for each listed product: new, changed, incomplete, stale or fresh,
    the first that holds. With 0 days age doesn't count; disabled, everything is new."""
    both = with_stored(listing, stored)
    reason = _reason(stored, now, refresh_days, required, enabled)
    return both.select(*KEY, reason.alias("reason")).select(*KEY, (F.col("reason") != "fresh").alias("needed"), "reason")


def _reason(stored: DataFrame, now: Column, refresh_days: int, required: Sequence[str], enabled: bool) -> Column:
    """``refresh_plan``'s reason over ``fp``, ``old_fp`` and ``old``, a row of ``stored``."""
    kinds = stored.schema
    empty = F.lit(False)
    for c in required:
        empty = empty | is_empty(F.col(f"old.{c}"), kinds[c].dataType)
    detail = F.col("old.last_detail_scraped_at") if "last_detail_scraped_at" in stored.columns else F.lit(None).cast("timestamp")
    moment = F.coalesce(detail, F.col("old.scraped_at"))
    stale = (moment.isNull() | older_than(moment, now, days=refresh_days)) if refresh_days else F.lit(False)
    return F.when(F.lit(not enabled) | F.col("old").isNull(), "new").when(F.col("fp") != F.col("old_fp"), "changed").when(empty, "incomplete").when(stale, "stale").otherwise("fresh")


@dataclass(frozen=True)
class RefreshPolicy:
    """When a listed product needs a detail request; ``plan`` is ``refresh_plan`` by it."""

    enabled: bool = True
    refresh_days: int = 30
    required: tuple[str, ...] = REQUIRED_FIELDS

    @staticmethod
    def of(config: Mapping, enabled: bool | None = None) -> RefreshPolicy:
        """From sections of settings: days of ``refresh``, else of ``automation``; where sites can be told not
        to collect content and none does, no content field is required, as none could ever be filled."""
        section = lambda name: config.get(name) if isinstance(config.get(name), Mapping) else {}
        refresh = section("refresh")
        days = refresh.get("refresh_days", section("automation").get("detail_refresh_days", 30))
        named = refresh.get("required_fields")
        required = tuple(str(f).strip() for f in named if str(f).strip()) if isinstance(named, (list, tuple)) and named else REQUIRED_FIELDS
        collects = [bool(s["collect_content"]) for s in config.values() if isinstance(s, Mapping) and "collect_content" in s]
        if collects and not any(collects):
            required = tuple(f for f in required if f not in CONTENT_FIELDS)
        return RefreshPolicy(bool(refresh.get("enabled", True)) if enabled is None else enabled, max(0, int(days)), required)

    def plan(self, listing: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
        return refresh_plan(listing, stored, now, self.refresh_days, self.required, self.enabled)


def plan_counts(plan: DataFrame) -> DataFrame:
    """Products and requests of each reason, most first."""
    counts = plan.groupBy("reason").agg(F.count("*").alias("products"), F.count_if("needed").alias("to_request"))
    return counts.orderBy(F.desc("products"), "reason")


def complete_recent(stored: DataFrame, now: Column, refresh_days: int = 30, required: Sequence[str] = REQUIRED_FIELDS, enabled: bool = True) -> DataFrame:
    """Stored rows that are complete and recent, so that they may be used again without a request: those of
    which ``refresh_plan`` of the table by itself says fresh. Keys are unique, so each row is judged where
    it lies."""
    rows = _as_old(stored.withColumn("fp", source_fingerprint(stored)), stored.columns)
    rows = rows.withColumn("old", F.struct(*stored.columns)).where(" AND ".join(f"{c} IS NOT NULL" for c in KEY))
    return rows.where(_reason(stored, now, refresh_days, required, enabled) == "fresh").select(stored.columns)


def detail_price_candidates(listing: DataFrame) -> DataFrame:
    """Listed products that need a detail request for a price or a SKU."""
    return listing.where("mrp IS NULL OR selling_price IS NULL OR coalesce(trim(sku), '') = ''")


def stored_versions(plan: DataFrame, listing: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored rows, whole, that stand in for listed products of parents of which nothing needs a request."""
    parent = parent_id(F.col("parent_product_id"), F.col("product_url"), F.col("product_id"))
    judged = listing.withColumn("parent", parent).join(plan, list(KEY))
    quiet = judged.groupBy("site", "parent").agg(F.bool_or("needed").alias("any")).where("NOT any").select("site", "parent")
    keys = judged.join(quiet, ["site", "parent"], "left_semi").select(*KEY)
    return stored.join(keys, list(KEY), "left_semi")


def detail_candidates(listing: DataFrame, stored: DataFrame, now: Column, refresh_days: int = 30, limit: int | None = None, order: Sequence[str] = ("product_id",)) -> DataFrame:
    """Listed products with is_new, changed, needs_detail, urgent, and their place in the queue: urgent
    ones (new, changed or pending) first; ``requested`` holds for the first ``limit``."""
    both = with_stored(listing, stored)

    def old(name: str, kind: str) -> Column:
        return F.col(f"old.{name}") if name in stored.columns else F.lit(None).cast(kind)

    changed = F.col("old").isNotNull() & (F.col("fp") != F.col("old_fp"))
    pending = F.coalesce(old("detail_refresh_pending", "boolean"), F.lit(False))
    gone = F.coalesce(old("detail_unavailable", "boolean"), F.lit(False))
    moment = F.coalesce(old("last_detail_scraped_at", "timestamp"), old("scraped_at", "timestamp"))
    nothing = F.lit(True)
    for c in CONTENT_FIELDS:
        if c in stored.columns:
            nothing = nothing & is_empty(F.col(f"old.{c}"), stored.schema[c].dataType)
    needs = F.when(F.col("old").isNull() | changed | pending, True).when(gone, False).otherwise(moment.isNull() | older_than(moment, now, days=refresh_days) | nothing)
    out = both.select(*listing.columns, F.col("old").isNull().alias("is_new"), changed.alias("changed"), needs.alias("needs_detail"), (F.col("old").isNull() | changed | pending).alias("urgent"))
    queue = F.row_number().over(Window.partitionBy("site", "needs_detail").orderBy(F.desc("urgent"), *order))
    out = out.withColumn("queue", F.when(F.col("needs_detail"), queue))
    return out.withColumn("requested", F.col("needs_detail") & (F.col("queue") <= (limit if limit is not None else F.lit(2**62))))


def run_counters(candidates: DataFrame, content_changed: DataFrame | None = None) -> DataFrame:
    """products_seen, new, changed (listing or content), unchanged, details_refreshed, deferred, by site."""
    marked = candidates
    if content_changed is not None:
        marked = candidates.join(content_changed.select(*KEY).distinct().withColumn("content", F.lit(True)), list(KEY), "left")
        marked = marked.withColumn("changed", F.col("changed") | (F.coalesce("content", F.lit(False)) & ~F.col("is_new")))
    out = marked.groupBy("site").agg(F.count("*").alias("products_seen"), F.count_if("is_new").alias("products_new"), F.count_if("changed").alias("products_changed"), F.count_if("requested").alias("details_refreshed"), F.count_if(F.col("needs_detail") & ~F.col("requested")).alias("deferred"))
    return out.withColumn("products_unchanged", F.greatest(F.lit(0), F.col("products_seen") - F.col("products_new") - F.col("products_changed")))


def sweep_gates(listing: DataFrame, stored: DataFrame, ratio: float = 0.5, reported: bool = True, brand_filter: bool = False) -> DataFrame:
    """For each site of the listing: rows seen, active rows stored, and ``complete``, whether missing products
    may be aged: the sweep said so, it had no brand filter, and it is not much smaller than the active
    catalogue. All sites are counted in one pass."""
    seen = listing.groupBy("site").agg(F.count("*").alias("seen"))
    active = stored.where(F.coalesce("is_active", F.lit(True))).groupBy("site").agg(F.count("*").alias("active"))
    gate = F.lit(reported and not brand_filter) & (F.col("seen") >= ratio * F.col("active"))
    return seen.join(active, "site", "left").fillna(0, ["active"]).withColumn("complete", gate)


def sweep_is_complete(listing: DataFrame, stored: DataFrame, site: str, reported: bool = True, ratio: float = 0.5, brand_filter: bool = False) -> bool:
    """The gate of one site; an empty listing is an error."""
    own = F.col("site") == site
    found = sweep_gates(listing.where(own), stored.where(own), ratio, reported, brand_filter).first()
    if found is None:
        raise ValueError(f"the listing of {site} is empty")
    return found.complete


def needs_final_sync(exported: DataFrame, stored: DataFrame) -> DataFrame:
    """Exported products that the table lacks."""
    return exported.join(stored.select(*KEY), list(KEY), "left_anti")


def merge_details(listing: DataFrame, details: DataFrame) -> DataFrame:
    """Detail rows in place of listing rows; those of products that weren't listed are added."""
    return listing.join(details.select(*KEY), list(KEY), "left_anti").unionByName(details, allowMissingColumns=True)


def incremental_state(current: DataFrame, details: DataFrame, stored: DataFrame, candidates: DataFrame, now: Column, run_id: str, gone: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to upsert, price points to append) of one run.

    ``current``: listing with details merged in; ``details``: what was fetched; ``candidates``: from
    ``detail_candidates``. Untouched products aren't among the rows; empty rich fields keep what is
    stored; first_seen_at is set once; last_changed_at only where listing or content changed. ``gone``:
    keys whose details are gone for good; their listing rows stay, and they are not asked for again.
    """
    rows = catalogue.preserve_rich_fields(current, stored)
    fetched = details.select(*KEY).distinct().withColumn("fetched", F.lit(True))
    flags = candidates.select(*KEY, "is_new", "changed", "needs_detail")
    rows = rows.withColumns({"fp": source_fingerprint(rows), "dfp": detail_fingerprint(rows)}).join(flags, list(KEY), "left").join(fetched, list(KEY), "left")
    kept = ("source_fingerprint", "detail_fingerprint", "first_seen_at", "last_changed_at", "last_detail_scraped_at", *[p for p in PRICE_FIELDS])
    lost = gone.select(*KEY).distinct().withColumn("lost", F.lit(True)) if gone is not None else None
    rows = rows.join(lost, list(KEY), "left") if lost is not None else rows.withColumn("lost", F.lit(None).cast("boolean"))
    old = stored.select(*KEY, F.lit(True).alias("known"), *[F.col(c).alias(f"was_{c}") for c in kept])
    rows = rows.join(old, list(KEY), "left")
    is_new, got = F.col("known").isNull(), F.coalesce("fetched", F.lit(False))
    content = got & ~F.col("dfp").eqNullSafe(F.col("was_detail_fingerprint"))
    changed = is_new | F.coalesce("changed", F.lit(False)) | content
    rows = rows.where(changed | got | F.coalesce("needs_detail", F.lit(False)))
    state = {
        "source_fingerprint": F.col("fp"),
        "detail_fingerprint": F.when(got, F.col("dfp")).otherwise(F.col("was_detail_fingerprint")),
        "first_seen_at": F.coalesce("was_first_seen_at", now),
        "last_seen_at": now,
        "last_checked_at": now,
        "last_changed_at": F.when(changed, now).otherwise(F.col("was_last_changed_at")),
        "last_detail_scraped_at": F.when(got, now).otherwise(F.col("was_last_detail_scraped_at")),
        "detail_refresh_pending": F.coalesce("needs_detail", F.lit(False)) & ~got & F.col("lost").isNull(),
        "detail_unavailable": F.col("lost").isNotNull() & ~got,
        "is_active": F.lit(True),
        "last_seen_run_id": F.lit(run_id),
        "missing_run_count": F.lit(0),
        "updated_at": now,
    }
    moved = is_new
    for p in PRICE_FIELDS:
        a, b = F.col(p), F.col(f"was_{p}")
        moved = moved | ~(F.round(a.cast("double"), 5).eqNullSafe(F.round(b.cast("double"), 5)) if p != "in_stock" else a.eqNullSafe(b))
    rows = rows.withColumns(state | {"moved": moved})
    upserts = rows.select(*current.columns, *[c for c in state if c not in current.columns])
    return upserts, catalogue.history_rows(rows.where("moved"), fallback=now)


def incremental_sync(stored: DataFrame, history: DataFrame, rows: DataFrame, points: DataFrame, seen: DataFrame, site: str, run_id: str, now: Column, complete: bool, threshold: int = 3) -> tuple[DataFrame, DataFrame]:
    """(next catalogue, points to append), for a history that is a plain table."""
    return incremental_table(stored, rows, seen, site, run_id, now, complete, threshold), catalogue.append_history(history, points)


def incremental_table(stored: DataFrame, rows: DataFrame, seen: DataFrame, site: str, run_id: str, now: Column, complete: bool, threshold: int = 3) -> DataFrame:
    """The next catalogue: upsert the rows, touch all seen, age the rest of a whole sweep."""
    table = catalogue.touch(catalogue.upsert(stored, rows), seen, now, run_id)
    return catalogue.age_missing(table, site, run_id, threshold, now) if complete else table


def representatives(listing: DataFrame, order: Sequence[str] = ("product_id",)) -> DataFrame:
    """The first listed product of each parent."""
    parent = parent_id(F.col("parent_product_id"), F.col("product_url"), F.col("product_id"))
    nth = F.row_number().over(Window.partitionBy("site", "parent").orderBy(*order))
    return listing.withColumn("parent", parent).withColumn("nth", nth).where("nth = 1").drop("nth")


def assemble_snapshot(listing: DataFrame, details: DataFrame, reused: DataFrame, order: Sequence[str] = ("scraped_at", "ord")) -> DataFrame:
    """A site's snapshot: of each product its detail row, else its reused stored row, else its listing row,
    duplicates merged. All have the columns ``order``."""
    best = merge_details(merge_details(listing, reused), details)
    return catalogue.dedup_merge(best, order)


def stop_reasons(stops: DataFrame) -> DataFrame:
    """site, ``stop_reasons``: each reason of (site, ord, reason) once, in the order of its first appearance."""
    first = stops.where("coalesce(trim(reason), '') <> ''").groupBy("site", "reason").agg(F.min("ord").alias("ord"))
    return first.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "reason"))), lambda x: x["reason"]).alias("stop_reasons"))


def run_outcome(processed: DataFrame, parents: DataFrame, listing_complete: bool) -> DataFrame:
    """completed, unprocessed: whole only if the listing is and no parent is left."""
    left = parents.select("site", "parent").distinct().join(processed.select("site", "parent").distinct(), ["site", "parent"], "left_anti")
    return left.agg(F.count("*").alias("unprocessed")).select((F.lit(listing_complete) & (F.col("unprocessed") == 0)).alias("completed"), "unprocessed")
