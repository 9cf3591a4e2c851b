"""The current catalogue, its price history and its run log, as DataFrame rewrites.

Every operator takes stored and new rows and returns the next version of the table; ``sinks`` writes
versions. Where the order of rows matters it is a column, never the order of a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.keys import text
from shelfwise.functions.values import is_empty
from shelfwise.schema import HISTORY_KEY, KEY, PRICE_FIELDS, RICH_FIELDS, RUN_STATUSES

#: Columns that a merge unites instead of taking the newest: sorted, or in order of the newest first.
SORTED_UNIONS = ("categories", "source_categories")
ORDERED_UNIONS = ("image_urls", "key_features", "special_features")


def latest_per_key(df: DataFrame, key: Sequence[str] = KEY, order: Sequence[str] = ("scraped_at", "ord")) -> DataFrame:
    """One row for each key: the greatest by ``order``, nulls least. Every task keeps the greatest of its own
    rows, so no more are shuffled, and columns that nobody reads are not read."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc_nulls_last(c) for c in order]))
    return df.withColumn("_nth", nth).where("_nth = 1").select(df.columns)


def dedup_merge(df: DataFrame, order: Sequence[str] = ("scraped_at", "ord"), fold_site: bool = True) -> DataFrame:
    """Merge the rows of each product: the newest row's values, except that the columns named above are
    united over all rows and attributes are merged, the newest value of a name winning.

    ``order`` ranks rows; of equal ones any wins, so it should end with a unique column. United values are
    grouped by (product, column, value) first, so a product's rows are never listed in one place, only its
    distinct values; of each, tasks pass on one row.
    """
    site = F.lower("site") if fold_site else F.col("site")
    ranked = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    united = [c for c in (*SORTED_UNIONS, *ORDERED_UNIONS) if c in df.columns]
    entry = lambda c: lambda v, i: F.struct(F.lit(c).alias("column"), v.alias("item"), i.alias("pos"), F.lit(None).cast("string").alias("value"))
    lists = [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), entry(c)) for c in united]
    if "product_attributes" in df.columns:
        entries = F.coalesce(F.map_entries("product_attributes"), F.array().cast("array<struct<key:string,value:string>>"))
        lists.append(F.transform(entries, lambda e, i: F.struct(F.lit("product_attributes").alias("column"), e["key"].alias("item"), i.alias("pos"), e["value"].alias("value"))))
    newest = df.withColumn("_site", site)
    nth = F.row_number().over(Window.partitionBy("_site", "product_id").orderBy(*[F.desc_nulls_last(c) for c in order]))
    newest = newest.withColumn("_nth", nth).where("_nth = 1").drop("_nth", *united, "product_attributes")
    if not lists:
        return newest.select(df.columns)
    each = df.select(site.alias("_site"), "product_id", ranked.alias("at"), F.explode(F.concat(*lists)).alias("x")).select("_site", "product_id", "at", "x.*")
    ordered, attribute = F.col("column").isin(*ORDERED_UNIONS), F.col("column") == "product_attributes"  # others need neither rank nor place
    last, first = F.when(ordered, F.struct("at", (-F.col("pos")).alias("back"))), F.when(attribute, F.struct("at", "pos"))
    once = each.groupBy("_site", "product_id", "column", "item").agg(F.max(last).alias("last"), F.min(first).alias("first"), F.max_by("value", F.when(attribute, F.col("at"))).alias("value"))
    of = lambda c, *fields: F.collect_list(F.when(F.col("column") == c, F.struct(*fields)))
    lists = [of(c, "item").alias(c) if c in SORTED_UNIONS else of(c, "last", "item").alias(c) for c in united]
    if "product_attributes" in df.columns:
        lists.append(of("product_attributes", "first", "item", "value").alias("product_attributes"))
    merged = once.groupBy("_site", "product_id").agg(*lists).withColumnsRenamed({"_site": "m_site", "product_id": "m_id"})
    both = newest.join(merged, F.col("_site").eqNullSafe(F.col("m_site")) & F.col("product_id").eqNullSafe(F.col("m_id")), "left")
    out = []
    for c in df.columns:
        if c in SORTED_UNIONS:
            out.append(F.coalesce(F.array_sort(F.transform(c, lambda x: x["item"])), F.array().cast("array<string>")).alias(c))
        elif c in ORDERED_UNIONS:
            out.append(F.coalesce(F.transform(F.sort_array(c, asc=False), lambda x: x["item"]), F.array().cast("array<string>")).alias(c))
        elif c == "product_attributes":
            out.append(F.coalesce(F.map_from_entries(F.transform(F.sort_array(c), lambda x: F.struct(x["item"], x["value"]))), F.create_map().cast("map<string,string>")).alias(c))
        else:
            out.append(F.col(c))
    return both.select(*out)


def canonical_order(df: DataFrame) -> DataFrame:
    """Sorted by site, brand, name and variant, without regard to case."""
    return df.orderBy(*[F.lower(text(F.col(c))) for c in ("site", "brand", "product_name", "variant")], "product_id")


def upsert(stored: DataFrame, new: DataFrame, key: Sequence[str] = KEY, present: str | None = None, now: Column | None = None) -> DataFrame:
    """The stored rows with the new ones merged in by key.

    Columns that ``new`` lacks keep their stored values. Where rows carry different subsets of columns,
    ``present`` names an array column of ``new`` that lists those a row has. New keys are inserted, with
    null for what is absent. Keys are unique on either side. With ``now`` every row that is merged gets it as
    ``updated_at``.
    """
    n = new.select(*[F.col(k).alias(f"n_{k}") for k in key], F.lit(True).alias("n_found"), *[F.col(c).alias(f"n_{c}") for c in new.columns if c not in key])
    both = stored.withColumn("s_found", F.lit(True)).join(n, [stored[k] == n[f"n_{k}"] for k in key], "full_outer")
    out = []
    for field in stored.schema.fields:
        c = field.name
        if c in key:
            out.append(F.coalesce(stored[c], F.col(f"n_{c}")).alias(c))
        elif c == "updated_at" and now is not None:
            out.append(F.when(F.col("n_found").isNotNull(), now).otherwise(stored[c]).alias(c))
        elif c in new.columns:
            has = F.col("n_found").isNotNull()
            if present:
                has = has & F.array_contains(F.col(f"n_{present}"), c)
            out.append(F.when(has, F.col(f"n_{c}").cast(field.dataType)).otherwise(stored[c]).alias(c))
        else:
            out.append(stored[c])
    return both.select(*out)


def preserve_rich_fields(new: DataFrame, stored: DataFrame, fields: Sequence[str] = RICH_FIELDS, key: Sequence[str] = KEY) -> DataFrame:
    """New rows in which an empty rich field takes the stored value, so that a listing never blanks it."""
    kept = [f for f in fields if f in new.columns and f in stored.columns]
    old = stored.select(*key, *[F.col(f).alias(f"old_{f}") for f in kept])
    joined = new.join(old, list(key), "left")
    return joined.select(*[F.when(is_empty(F.col(c), new.schema[c].dataType), F.coalesce(F.col(f"old_{c}"), F.col(c))).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in new.columns])


def touch(stored: DataFrame, seen: DataFrame, now: Column, run_id: str) -> DataFrame:
    """Stored rows whose key is in ``seen`` get new check and seen times and the run's id, and count as
    not missing."""
    marks = seen.select(*KEY).distinct().withColumn("touched", F.lit(True))
    changes = {"last_checked_at": now, "last_seen_at": now, "last_seen_run_id": F.lit(run_id), "missing_run_count": F.lit(0), "is_active": F.lit(True), "updated_at": now}
    hit = F.col("touched").isNotNull()
    joined = stored.join(marks, list(KEY), "left")
    return joined.select(*[F.when(hit, changes[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in changes else F.col(f.name) for f in stored.schema.fields])


def age_missing(stored: DataFrame, site: str, run_id: str, threshold: int = 3, now: Column | None = None) -> DataFrame:
    """Rows of ``site`` that the run has not seen are missing once more; they stay active while the count
    is below the threshold (at least 1). To be applied once for a run, and only after a whole sweep."""
    missed = (F.col("site") == site) & ~F.col("last_seen_run_id").eqNullSafe(F.lit(run_id))
    count = F.coalesce(F.col("missing_run_count"), F.lit(0)) + 1
    out = stored.withColumns({
        "is_active": F.when(missed, count < max(1, threshold)).otherwise(F.col("is_active")),
        "missing_run_count": F.when(missed, count).otherwise(F.col("missing_run_count")).cast("int"),
    })
    if now is not None and "updated_at" in stored.columns:
        out = out.withColumn("updated_at", F.when(missed, now).otherwise(F.col("updated_at")))
    return out.select(stored.columns)


def age_missing_once(stored: DataFrame, runs: DataFrame, site: str, run_id: str, threshold: int = 3) -> DataFrame:
    """As ``age_missing``, unless the run log says that the run is finished already or was not whole."""
    open_run = runs.where((F.col("id") == run_id) & (F.col("status") == "running")).select(F.lit(True).alias("open")).limit(1)
    return age_missing(stored, site, run_id, threshold) if not open_run.isEmpty() else stored


def patch(stored: DataFrame, found: DataFrame, column: str, only_missing: bool = True, key: Sequence[str] = KEY, now: Column | None = None) -> DataFrame:
    """Set one column of the rows whose keys are in ``found``; with ``only_missing``, where it is blank. With
    ``now`` rows that are set get it as ``updated_at``."""
    n = found.select(*key, F.col(column).alias("found_value")).where(F.coalesce("found_value", F.lit("")) != "")
    old, new = F.col(column), F.col("found_value")
    value = F.coalesce(F.nullif(old, F.lit("")), new, old) if only_missing else F.coalesce(new, old)
    joined = stored.join(n, list(key), "left").withColumn("_set", ~value.eqNullSafe(old))
    touched = lambda c: F.when(F.col("_set"), now).otherwise(F.col(c)) if c == "updated_at" and now is not None else F.col(c)
    return joined.select(*[value.alias(c) if c == column else touched(c).alias(c) for c in stored.columns])


def history_rows(products: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Price points in the shape and exact types of the history."""
    at = F.coalesce("scraped_at", fallback) if fallback is not None else F.col("scraped_at")
    kinds = {"mrp": "decimal(12,2)", "selling_price": "decimal(12,2)", "discount_pct": "decimal(7,2)"}
    columns = ("site", "product_id", "parent_product_id", "sku", "variant", *PRICE_FIELDS)
    return products.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in columns if c in products.columns], at.alias("scraped_at"))


def append_history(history: DataFrame, points: DataFrame, key: Sequence[str] = HISTORY_KEY, order: Sequence[str] = ()) -> DataFrame:
    """The points whose key the history lacks, one for each key (the greatest by ``order``, then by all other
    columns): what is to be appended. Appending again changes nothing."""
    rest = [c for c in history.columns if c not in key and c not in order]
    ranked = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in (*order, *rest)] or [F.lit(0)]))
    one = points.withColumn("nth", ranked).where("nth = 1").select(history.columns)
    return one.join(history.select(*key), list(key), "left_anti").select(history.columns)


def price_changes(observations: DataFrame, order: Sequence[str] = ("scraped_at", "ord"), fields: Sequence[str] = PRICE_FIELDS) -> DataFrame:
    """Observations whose prices or stock differ from the product's one before, and first ones."""
    at = Window.partitionBy(*KEY).orderBy(*order)
    state = F.struct(*[F.round(F.col(f).cast("double"), 5).alias(f) if not isinstance(observations.schema[f].dataType, (T.BooleanType, T.StringType)) else F.col(f) for f in fields if f in observations.columns])
    marked = observations.withColumn("state", state).withColumn("before", F.lag("state").over(at)).withColumn("nth", F.row_number().over(at))
    return marked.where((F.col("nth") == 1) | ~F.col("state").eqNullSafe(F.col("before"))).select(observations.columns)


def replace_site(stored: DataFrame, snapshot: DataFrame, site: str) -> DataFrame:
    """The catalogue with one site's rows replaced and all others kept."""
    return stored.where(F.lower("site") != site.lower()).unionByName(snapshot, allowMissingColumns=True)


def open_run(runs: DataFrame, site: str, run_id: str, now: Column, metadata: str = "{}", abandoned_hours: int = 12) -> DataFrame:
    """The log with a new running row; the site's runs that are running for longer are failed."""
    dead = (F.col("site") == site) & (F.col("status") == "running") & (F.col("started_at") < now - F.make_dt_interval(F.lit(0), F.lit(abandoned_hours)))
    closed = runs.withColumns({
        "finished_at": F.when(dead, now).otherwise(F.col("finished_at")),
        "message": F.when(dead, F.lit("abandoned")).otherwise(F.col("message")),
        "status": F.when(dead, F.lit("failed")).otherwise(F.col("status")),
    })
    values = {"id": F.lit(run_id), "site": F.lit(site), "status": F.lit("running"), "started_at": now, "metadata": F.lit(metadata)}
    row = runs.sparkSession.range(1).select(*[values.get(f.name, F.lit(0 if isinstance(f.dataType, T.IntegerType) else None)).cast(f.dataType).alias(f.name) for f in runs.schema.fields])
    return closed.select(runs.columns).unionByName(row)


RUN_COUNTERS = ("products_seen", "products_new", "products_changed", "products_unchanged", "details_refreshed", "failures", "blocks", "requests", "message")


def close_run(runs: DataFrame, run_id: str, status: str, now: Column, **summary) -> DataFrame:
    """The log with a run's outcome; only known counters are taken."""
    if status not in RUN_STATUSES:
        raise ValueError(f"unknown status {status}")
    own = F.col("id") == run_id
    changes = {"status": F.lit(status), "finished_at": now} | {k: F.lit(v) for k, v in summary.items() if k in RUN_COUNTERS}
    return runs.select(*[F.when(own, changes[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in changes else F.col(f.name) for f in runs.schema.fields])


def images(products: DataFrame) -> DataFrame:
    """One row for each distinct image with its position from 1; the main image stands in for none."""
    urls = F.array_distinct(F.filter(F.transform(F.coalesce("image_urls", F.array().cast("array<string>")), lambda u: F.trim(text(u))), lambda u: u != ""))
    main = F.filter(F.array(F.trim(text(F.col("image_url")))), lambda u: u != "")
    listed = products.select(*KEY, F.posexplode(F.when(F.size(urls) > 0, urls).otherwise(main)).alias("position", "url"))
    return listed.select(*KEY, (F.col("position") + 1).alias("position"), "url")


def reviews(products: DataFrame, order: Sequence[str] = ("product_id",)) -> DataFrame:
    """One row for each distinct review of a site and parent: by its id, else by what it says."""
    said = F.concat_ws("|", *[text(F.col(f"r.{c}")) for c in ("created_at", "reviewer", "title", "review")])
    key = F.coalesce(F.nullif(F.trim(text(F.col("r.review_id"))), F.lit("")), said)
    parent = F.coalesce(F.nullif(F.trim(text(F.col("parent_product_id"))), F.lit("")), F.col("product_id"))
    each = products.withColumn("parent", parent).select("site", "parent", "product_id", *[c for c in order if c not in ("site", "product_id")], F.posexplode("top_reviews").alias("pos", "r")).where("r IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("site", "parent", "review_key").orderBy(*order, "pos"))
    return each.withColumn("review_key", key).withColumn("nth", nth).where("nth = 1").select("site", "parent", "product_id", "review_key", "r.*")


def schema_violations(catalogue: DataFrame, sites: Sequence[str], runs: DataFrame | None = None) -> DataFrame:
    """rule, key, count: unknown sites, repeated keys, unknown run statuses."""
    out = catalogue.where(~F.coalesce("site", F.lit("")).isin(*sites)).groupBy(F.lit("site").alias("rule"), F.col("site").alias("key")).count()
    twice = catalogue.groupBy(F.lit("unique").alias("rule"), F.concat_ws("/", *KEY).alias("key")).count().where("count > 1")
    out = out.unionByName(twice)
    if runs is not None:
        out = out.unionByName(runs.where(~F.coalesce("status", F.lit("")).isin(*RUN_STATUSES)).groupBy(F.lit("status").alias("rule"), F.col("status").alias("key")).count())
    return out
