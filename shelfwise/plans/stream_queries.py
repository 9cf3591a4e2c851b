"""Registered streaming queries: file streams that run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import catalogue
from shelfwise.plans import jobs
from shelfwise.plans.catalogue_queries import query
from shelfwise.schema import RUN_DDL
from shelfwise.session import configure
from shelfwise.sources import sinks
from shelfwise.sources.versions import VersionedTable, scratch
from shelfwise.streaming import micro_batches

_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
_ROWS = "site string, product_id string, ord long, scraped_at timestamp, selling_price double, in_stock boolean"


def _observations(spark, folder, names="events.parquet", below="", files=1000):
    configure(spark)
    events = micro_batches.landing(spark, f"{folder}/{below}", _EVENTS, files, pathGlobFilter=names)
    return events.select(
        F.concat(F.lit("site_"), (F.col("user_id") % 5).cast("string")).alias("site"), F.col("user_id").cast("string").alias("product_id"), F.col("event_id").alias("ord"),
        F.col("ts").cast("timestamp").alias("scraped_at"), F.floor("value").cast("double").alias("selling_price"), (F.col("event_type") != "error").alias("in_stock"),
    )


_SQL = "WITH o AS (SELECT 'site_' || (user_id % 5) AS site, user_id::VARCHAR AS product_id, event_id AS ord, ts, floor(value)::DOUBLE AS selling_price, event_type <> 'error' AS in_stock FROM events) "


@query(_SQL + "SELECT site, product_id, selling_price, in_stock, 1::BIGINT AS versions FROM o QUALIFY row_number() OVER (PARTITION BY site, product_id ORDER BY ts DESC, ord DESC) = 1", with_obs=False)
def stream_upsert(spark, sf_dir):
    folder = scratch(spark)
    table, history = VersionedTable(spark, f"{folder}/table"), sinks.DayHistory(spark, f"{folder}/history", "year")
    merge = micro_batches.merge_batch(table, history, "site string, product_id string, scraped_at timestamp, selling_price double, in_stock boolean", "site string, product_id string, selling_price decimal(12,2), in_stock boolean, scraped_at timestamp")
    micro_batches.run_to_end(_observations(spark, sf_dir), merge, f"{folder}/checkpoint")
    return table.read().select("site", "product_id", "selling_price", "in_stock", F.lit(1).cast("long").alias("versions"))


@query(_SQL + "SELECT site, product_id, ord, selling_price, in_stock FROM (SELECT *, lag(struct_pack(selling_price, in_stock)) OVER w AS before, row_number() OVER w AS nth FROM o WINDOW w AS (PARTITION BY site, product_id ORDER BY ts, ord)) WHERE nth = 1 OR struct_pack(selling_price, in_stock) IS DISTINCT FROM before", with_obs=False)
def stream_price_changes(spark, sf_dir):
    """Two runs over the same checkpoint, so the second starts from the state of the first; rows of the
    first half that land again with it are late, and no changes."""
    folder = scratch(spark)
    events = spark.read.schema(_EVENTS).parquet(f"{sf_dir}/events.parquet")
    middle = events.agg(F.expr("percentile_approx(cast(ts AS timestamp), 0.5)")).first()[0]
    early = F.col("ts").cast("timestamp") <= F.lit(middle)
    for part in (events.where(early), events.where(~early | (F.col("event_id") % 10 == 0))):
        part.coalesce(2).write.mode("append").parquet(f"{folder}/land/events.parquet")
        changes = micro_batches.price_change_stream(_observations(spark, f"{folder}/land", "*.parquet", "events.parquet"))
        micro_batches.run_to_end(changes, lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={i}"), f"{folder}/checkpoint")
    return spark.read.schema(_ROWS).parquet(f"{folder}/out").select("site", "product_id", "ord", "selling_price", "in_stock")


_TABLE = "product_id string, scraped_at timestamp, selling_price double, in_stock boolean, site string"


@query(_SQL + "SELECT site, product_id, selling_price, in_stock, (SELECT count(DISTINCT (h.ts)) FROM o h WHERE h.site = l.site AND h.product_id = l.product_id) AS points FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY site, product_id ORDER BY ts DESC, ord DESC) = 1) l", with_obs=False)
def stream_parts(spark, sf_dir):
    """Keyed parts, in several micro-batches of one file each, the newest rows first."""
    folder = scratch(spark)
    events = spark.read.schema(_EVENTS).parquet(f"{sf_dir}/events.parquet")
    events.repartitionByRange(3, F.desc("ts")).write.parquet(f"{folder}/land/events.parquet")
    merge = micro_batches.merge_parts(f"{folder}/table", f"{folder}/history", _TABLE, "site string, product_id string, selling_price decimal(12,2), in_stock boolean, scraped_at timestamp", 4, "year")
    micro_batches.run_to_end(_observations(spark, f"{folder}/land", "*.parquet", "events.parquet", 1), merge, f"{folder}/checkpoint")
    points = spark.read.parquet(f"{folder}/history").groupBy("site", "product_id").agg(F.count("*").alias("points"))
    return sinks.read_parts(spark, f"{folder}/table", _TABLE).join(points, ["site", "product_id"]).select("site", "product_id", "selling_price", "in_stock", "points")


@query(_SQL.rstrip() + """, l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY site, product_id ORDER BY ts DESC, ord DESC) = 1)
SELECT site, product_id, selling_price, in_stock, 'partial' AS status, (SELECT count(*) FROM o WHERE ord % 2 = 0) AS products_seen, 1 AS failures, 1 AS reconciled FROM l""", with_obs=False)
def storefront_sweep(spark, sf_dir):
    """A sweep whose second batch fails: it is set aside, the run closes partial without ageing, and the
    batch is merged afterwards."""
    folder = scratch(spark)
    events = spark.read.schema(_EVENTS).parquet(f"{sf_dir}/events.parquet")
    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).coalesce(1).write.mode("append").parquet(f"{folder}/land/{part}/events.parquet")
    table, history = VersionedTable(spark, f"{folder}/table"), sinks.DayHistory(spark, f"{folder}/history", "year")
    schema = "site string, product_id string, scraped_at timestamp, selling_price double, in_stock boolean"
    merge = micro_batches.merge_batch(table, history, schema, "site string, product_id string, selling_price decimal(12,2), in_stock boolean, scraped_at timestamp")

    def failing(batch, batch_id):
        if batch.where("ord % 2 = 1").isEmpty():
            return merge(batch, batch_id)
        raise RuntimeError("the store is away")

    runs = spark.createDataFrame([], RUN_DDL)
    now = F.lit("2030-01-01").cast("timestamp")
    source = _observations(spark, f"{folder}/land", "*.parquet", "*/events.parquet", 1)
    log = jobs.storefront_run(source, failing, table, schema, runs, "site_0", "r1", f"{folder}/checkpoint", now, True, f"{folder}/aside")
    reconciled = micro_batches.merge_quarantine(spark, merge, f"{folder}/aside")
    run = log.select("status", "products_seen", "failures", F.lit(reconciled).alias("reconciled"))
    [r] = run.collect()  # one run
    return table.read().select("site", "product_id", "selling_price", "in_stock", *[F.lit(v).alias(c) for c, v in r.asDict().items()])


@query(_SQL.rstrip() + """, l AS (SELECT *, ord % 2 = 1 AS seen FROM o QUALIFY row_number() OVER (PARTITION BY site, product_id ORDER BY ts DESC, ord DESC) = 1)
SELECT site, product_id, selling_price, CASE WHEN seen OR site <> 'site_1' THEN 0 ELSE 1 END AS missing_run_count, seen OR site <> 'site_1' AS is_active,
  (SELECT count(DISTINCT h.ts) FROM o h WHERE h.site = l.site AND h.product_id = l.product_id) AS points,
  CASE site WHEN 'site_1' THEN 'success' WHEN 'site_2' THEN 'partial' WHEN 'site_3' THEN 'partial' ELSE 'none' END AS status FROM l""", with_obs=False)
def sweeps_closed(spark, sf_dir):
    """A stream that is started twice over one checkpoint, whose second half lands in between and with a part of
    the first again, and three runs closed after it: a whole one, one of a listing that was not whole, and one
    with a failure. Only the first counts what it has not seen as missing."""
    folder = scratch(spark)
    events = spark.read.schema(_EVENTS).parquet(f"{sf_dir}/events.parquet")
    table, history = VersionedTable(spark, f"{folder}/table"), sinks.DayHistory(spark, f"{folder}/history", "year")
    schema = "site string, product_id string, scraped_at timestamp, selling_price double, last_seen_run_id string, missing_run_count int, is_active boolean"
    past = "site string, product_id string, selling_price decimal(12,2), scraped_at timestamp"
    merge = micro_batches.merge_batch(table, history, schema, past)
    half = F.col("event_id") % 3 == 0
    for part in (events.where(half), events.where(~half | (F.col("event_id") % 5 == 0))):
        part.coalesce(2).write.mode("append").parquet(f"{folder}/land/events.parquet")
        seen = F.when(F.col("ord") % 2 == 1, F.concat(F.lit("run_"), F.col("site"))).otherwise("before")
        rows = _observations(spark, f"{folder}/land", "*.parquet", "events.parquet", 1).withColumns({"last_seen_run_id": seen, "missing_run_count": F.lit(0), "is_active": F.lit(True)})
        micro_batches.run_to_end(rows, merge, f"{folder}/checkpoint")
    runs, now = spark.createDataFrame([], RUN_DDL), F.lit("2030-01-01").cast("timestamp")
    for site, failures, complete in (("site_1", 0, True), ("site_2", 0, False), ("site_3", 1, True)):
        runs = catalogue.open_run(runs, site, f"run_{site}", now)
        runs = micro_batches.close_stream(table, schema, runs, site, f"run_{site}", now, failures, complete, 1)
    points = history.read(past).groupBy("site", "product_id").agg(F.count("*").alias("points"))
    closed = table.read(schema).join(points, ["site", "product_id"]).join(runs.select("site", "status"), "site", "left")
    return closed.select("site", "product_id", "selling_price", "missing_run_count", "is_active", "points", F.coalesce("status", F.lit("none")).alias("status"))
