"""Registered queries over sources, sinks and jobs: files that Spark writes from the tables and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import fingerprints, markup
from shelfwise.normalize.payloads import as_products
from shelfwise.operators import barcodes, catalogue, changes, dims, health, imports
from shelfwise.plans import jobs
from shelfwise.plans.catalogue_queries import _FLAGS, _REASON, _RUN_SITES, _SPLIT, CUT, SITES, _runs, _split, _state, _table, latest, obs, query
from shelfwise.schema import CATALOGUE_DDL, HISTORY_DDL, KEY, RUN_DDL
from shelfwise.sources import readers, sinks
from shelfwise.sources.versions import VersionedTable, scratch

def _now():
    return F.lit(CUT).cast("timestamp")
_DROP = ("ord", "image_url", "image_urls", "product_attributes")


def _products(rows):
    """Rows of ``obs`` with all product columns."""
    names = [c for c in ("site", "product_id", "parent_product_id", "brand", "product_name", "categories", "variant", "mrp", "selling_price", "discount_pct", "in_stock", "gtin", "description", "image_urls", "product_attributes", "scraped_at")]
    return as_products(rows, **{c: F.col(c) for c in names})


# --- sources and sinks -------------------------------------------------------------------------


@query("SELECT site, product_id, brand, product_name, mrp, selling_price, in_stock, strftime(scraped_at, '%Y-%m-%d') AS seen, category AS categories, CASE WHEN l_partkey % 2 = 0 THEN ean ELSE 'none' END AS upc, 2 AS images FROM latest")
def export_and_import(spark, sf_dir):
    folder = scratch(spark)
    sinks.export_products(_products(latest(spark, sf_dir)), folder)
    back = readers.read_products_csv(spark, folder)
    return back.select("site", "product_id", "brand", "product_name", "mrp", "selling_price", "in_stock", F.date_format("scraped_at", "yyyy-MM-dd").alias("seen"), F.array_join("categories", ",").alias("categories"), F.element_at("product_attributes", "UPC").alias("upc"), F.size("image_urls").alias("images"))


@query("SELECT site, count(*) AS products, count(*) AS written FROM latest GROUP BY site")
def export_by_site(spark, sf_dir):
    folder = scratch(spark)
    counts = sinks.export_products(_products(latest(spark, sf_dir)), folder, by_site=True)
    written = spark.read.options(header=True, multiLine=True, escape='"').csv(folder).groupBy("site").agg(F.count("*").alias("written"))
    return counts.join(written, "site")


@query("SELECT product_id, brand, selling_price FROM latest WHERE site = 'site_1'")
def catalogue_scan(spark, sf_dir):
    folder = scratch(spark)
    _products(latest(spark, sf_dir)).write.partitionBy("site").parquet(folder)
    return readers.read_catalogue(spark, folder, site="site_1", columns=("product_id", "brand", "selling_price"))


@query("SELECT site, product_id, brand, product_name FROM latest WHERE site IN ('site_1', 'site_4') AND l_partkey % 11 > 1 AND regexp_replace(lower(brand), '[^a-z0-9]+', '', 'g') IN ('brand1', 'brand2', 'brand11')")
def allowed_catalogue(spark, sf_dir):
    """One scan of several sites for allowed brands, over a stored table in which some names are blank or null."""
    folder, rest = scratch(spark), F.col("product_id") % 11
    rows = _products(latest(spark, sf_dir)).withColumn("product_name", F.when(rest == 0, F.lit(" ")).when(rest > 1, F.col("product_name")))
    rows.write.partitionBy("site").parquet(folder)
    brands = spark.range(1).select(F.explode(F.array(F.lit("BRAND 1"), F.lit("brand-2"), F.lit("Brand#11"))).alias("brand"))
    return readers.read_allowed(spark, folder, ("site_1", "site_4"), brands).select("site", "product_id", "brand", "product_name")


@query("SELECT site, product_id, selling_price, 'csv' AS source FROM latest WHERE site IN ('site_1', 'site_4')")
def source_fallback(spark, sf_dir):
    folder = scratch(spark)
    sinks.export_products(_products(latest(spark, sf_dir)), f"{folder}/export")
    rows, source = readers.read_with_fallback(spark, f"{folder}/no-table", f"{folder}/export", ("site_1", "site_4"))
    return rows.select("site", "product_id", "selling_price", F.lit(source).alias("source"))


@query("SELECT site, product_id, selling_price FROM latest WHERE site <> 'site_3' UNION ALL SELECT site, product_id, selling_price + 1 FROM latest WHERE site = 'site_3' AND l_partkey % 2 = 0")
def snapshot_sink(spark, sf_dir):
    folder, rows = scratch(spark), latest(spark, sf_dir).select("site", "product_id", "selling_price")
    sinks.write_snapshot(rows, folder)
    sinks.write_snapshot(rows.where("site = 'site_3' AND product_id % 2 = 0").withColumn("selling_price", F.col("selling_price") + 1), folder)
    return spark.read.schema("product_id string, selling_price double, site string").parquet(folder).select("site", "product_id", "selling_price")


@query("SELECT p_partkey AS id, p_name AS name, 'good' AS kind FROM part WHERE p_partkey % 9 <> 0 UNION ALL SELECT -1, '', 'damaged' FROM part WHERE p_partkey % 9 = 0", with_obs=False)
def jsonl_lines(spark, sf_dir):
    folder, p = scratch(spark), _table(spark, sf_dir, "part")
    line = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    p.select(F.when(F.col("p_partkey") % 9 == 0, F.concat(F.substring(line, 1, 12), F.lit("\x00"))).otherwise(line)).write.text(folder)
    good, bad = readers.read_jsonl(spark, folder, "id long, name string")
    return good.withColumn("kind", F.lit("good")).unionByName(bad.select(F.lit(-1).cast("long").alias("id"), F.lit("").alias("name"), F.lit("damaged").alias("kind")))


@query("SELECT DISTINCT (p_partkey // 2)::VARCHAR AS id FROM part WHERE p_partkey % 5 NOT IN (0, 1)", with_obs=False)
def processed_ids(spark, sf_dir):
    folder, k = scratch(spark), F.col("p_partkey")
    _table(spark, sf_dir, "part").select(F.when(k % 5 == 0, F.lit("  ")).when(k % 5 == 1, F.concat(k.cast("string"), F.lit("\x00\x01"))).otherwise(F.concat(F.floor(k / 2).cast("string"), F.lit(" ")))).write.text(folder)
    return readers.read_processed_ids(spark, folder)


def _sheet(spark, sf_dir):
    folder, key = scratch(spark), F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(
        F.when(key % 11 == 0, " ").otherwise(F.concat(F.lit("Brand "), (key % 50).cast("string"))).alias("Vendor"), F.when(key % 13 == 0, "").otherwise(F.col("c_name")).alias("Title"), F.when(key % 3 == 0, F.concat(F.lit("S"), key.cast("string"))).otherwise("").alias("Variant SKU"),
        F.concat(F.lit("₹ "), key.cast("string"), F.lit(".50")).alias("Price"), F.when(key % 2 == 0, "Sold out").otherwise("yes").alias("Available"), F.lit("Skin | Care;Face").alias("Type"), F.when(key % 17 == 0, "Nowhere").when(key % 2 == 0, "Site_1").otherwise("").alias("Marketplace"), key.alias("k"), (key % 3).alias("part"),
    )
    rows.repartition("part").sortWithinPartitions("part", "k").drop("k").write.partitionBy("part").options(header=True, escape='"').csv(folder)  # three files, read in the order of their paths
    return readers.read_sheet(spark, folder)


_SHEET = """WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_custkey % 3 ORDER BY c_custkey) + 1 AS line, row_number() OVER (ORDER BY c_custkey % 3, c_custkey) + 1 AS ordinal, c_custkey AS k FROM customer),
s AS (SELECT line, ordinal, k, CASE WHEN k % 11 = 0 THEN '' ELSE 'Brand ' || (k % 50) END AS brand, CASE WHEN k % 13 = 0 THEN '' ELSE c_name END AS product_name, CASE WHEN k % 3 = 0 THEN 'S' || k ELSE '' END AS sku,
  CASE WHEN k % 17 = 0 THEN 'nowhere' WHEN k % 2 = 0 THEN 'site_1' ELSE 'manual' END AS site FROM c)
"""


@query(_SHEET + """SELECT line, site, brand, product_name, CASE WHEN sku <> '' THEN sku ELSE substr('manual-' || regexp_replace(lower(brand), '[^a-z0-9]+', '', 'g') || '-' || replace(trim(regexp_replace(lower(product_name), '[^a-z0-9]+', ' ', 'g')), ' ', '-'), 1, 120) END AS product_id,
  k + 0.5::DOUBLE AS selling_price, k % 2 <> 0 AS in_stock, 'Skin,Care,Face' AS categories, CASE WHEN brand = '' THEN 'brand is blank' WHEN product_name = '' THEN 'product name is blank' WHEN site = 'nowhere' THEN 'unknown site' END AS reject_reason FROM s""", with_obs=False)
def manual_sheet(spark, sf_dir):
    rows = imports.manual_rows(_sheet(spark, sf_dir), "manual", ("manual", *SITES))
    return rows.select("line", "site", "brand", "product_name", "product_id", "selling_price", "in_stock", F.array_join("categories", ",").alias("categories"), "reject_reason")


@query(_SHEET + "SELECT CASE WHEN sku <> '' THEN sku ELSE ordinal::VARCHAR END AS product_id, 'own' AS site, brand, product_name, k + 0.5::DOUBLE AS selling_price, k % 2 <> 0 AS in_stock FROM s WHERE product_name <> ''", with_obs=False)
def own_sheet(spark, sf_dir):
    return imports.own_catalogue(_sheet(spark, sf_dir), "own").select("product_id", "site", "brand", "product_name", "selling_price", "in_stock")


@query(_SHEET + """, good AS (SELECT *, CASE WHEN sku <> '' THEN sku ELSE 'x' || k END AS id FROM s WHERE brand <> '' AND product_name <> '' AND site <> 'nowhere')
SELECT CASE WHEN k IN (SELECT 3 * s_suppkey FROM supplier) AND sku <> '' AND site = 'manual' THEN 'product_id already stored' ELSE 'inserted' END AS outcome, count(*) AS rows FROM good GROUP BY 1
UNION ALL SELECT CASE WHEN brand = '' THEN 'brand is blank' WHEN product_name = '' THEN 'product name is blank' ELSE 'unknown site' END, count(*) FROM s WHERE brand = '' OR product_name = '' OR site = 'nowhere' GROUP BY 1""", with_obs=False)
def sheet_import_counts(spark, sf_dir):
    stored = _table(spark, sf_dir, "supplier").select(F.lit("manual").alias("site"), F.concat(F.lit("S"), (3 * F.col("s_suppkey")).cast("string")).alias("product_id"), F.lit("Other").alias("brand"), F.col("s_name").alias("product_name"))
    _, counts = jobs.import_sheet(_sheet(spark, sf_dir), stored, "manual", ("manual", *SITES))
    return counts.select("outcome", "rows")


# --- runs and pages ----------------------------------------------------------------------------


@query("""WITH r AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS id, 'site_' || (o_custkey % 7) AS site, o_orderdate FROM orders) SELECT id, site FROM r ORDER BY o_orderdate DESC, id LIMIT 40""", with_obs=False)
def newest_runs(spark, sf_dir):
    return health.latest_runs(_runs(spark, sf_dir)).select("id", "site")


@query("""WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page_no, event_type FROM events), f AS (SELECT user_id, event_type, min(page_no) AS first FROM p GROUP BY ALL)
SELECT p.user_id, p.page_no FROM p JOIN f USING (user_id, event_type) WHERE p.page_no > f.first""", with_obs=False)
def repeated_listing_pages(spark, sf_dir):
    from pyspark.sql import Window

    pages = _table(spark, sf_dir, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("page_no"), F.array("event_type").alias("ids"))
    return health.duplicate_pages(pages, ["user_id"]).select("user_id", "page_no")


def _log(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    names = {f.split()[0]: f.split()[1] for f in RUN_DDL.split(", ")}
    return runs.select(*[(F.col(c) if c in runs.columns else F.lit(None)).cast(k).alias(c) for c, k in names.items()])


_LOG = """WITH r AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS id, 'site_' || (o_custkey % 7) AS site, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'failed' ELSE 'success' END AS status, o_orderdate AS moment, o_totalprice::INT AS seen FROM orders)
"""


@query(_LOG + """, o AS (SELECT id, site, CASE WHEN site = 'site_2' AND status = 'running' AND moment < TIMESTAMP '2000-06-01' - INTERVAL 12 HOUR THEN 'failed' ELSE status END AS status,
  CASE WHEN site = 'site_2' AND status = 'running' AND moment < TIMESTAMP '2000-06-01' - INTERVAL 12 HOUR THEN 'abandoned' ELSE '' END AS message FROM r)
SELECT * FROM o UNION ALL SELECT 'new-run', 'site_2', 'partial', 'x'""", with_obs=False)
def run_log(spark, sf_dir):
    log = catalogue.open_run(_log(spark, sf_dir), "site_2", "new-run", _now())
    return catalogue.close_run(log, "new-run", "partial", _now(), products_seen=5, message="x", unknown=1).select("id", "site", "status", "message")


@query(_LOG + """, newest AS (SELECT 'site_' || (user_id % 7) AS site, max(ts) AS newest FROM events GROUP BY 1), now AS (SELECT max(ts) AS t FROM events), last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY site ORDER BY moment DESC, id DESC) = 1),
s AS (SELECT 'site_' || i AS site FROM range(9) x(i))
SELECT site, 'run' AS "check", CASE WHEN last.id IS NULL OR status = 'failed' OR date_diff('hour', moment, t) > 8 AND status = 'running' OR date_diff('hour', moment, t) > 30 THEN 'alert' ELSE 'ok' END AS level FROM s LEFT JOIN last USING (site), now
UNION ALL SELECT site, 'data', CASE WHEN newest IS NULL OR epoch(t) - epoch(newest) > 30 * 3600 THEN 'alert' ELSE 'ok' END FROM s LEFT JOIN newest USING (site), now""", with_obs=False)
def health_findings(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.concat(F.lit("site_"), (F.col("user_id") % 7).cast("string")).alias("site"), F.col("ts").cast("timestamp").alias("scraped_at"))
    now = F.lit(e.agg(F.max("scraped_at")).first()[0])
    return jobs.health_report(_runs(spark, sf_dir), e, _RUN_SITES, now).select("site", "check", "level")


# --- refresh -----------------------------------------------------------------------------------

_QUIET = _SPLIT + f""", plan AS (SELECT a.site, a.product_id, a.parent_product_id, {_REASON} <> 'fresh' AS needed FROM after a LEFT JOIN before b ON a.site = b.site AND a.product_id = b.product_id),
quiet AS (SELECT site, parent_product_id FROM plan GROUP BY ALL HAVING NOT bool_or(needed)), reused AS (SELECT b.* FROM before b JOIN plan USING (site, product_id) JOIN quiet q ON q.site = plan.site AND q.parent_product_id = plan.parent_product_id)
"""


def _reuse(spark, sf_dir):
    before, after = _split(spark, sf_dir)
    plan = changes.refresh_plan(after.drop(*_DROP), before.drop(*_DROP), _now(), 300, required=("description",))
    return before, after, plan


@query(_QUIET + "SELECT site, product_id, selling_price, description FROM reused")
def reused_rows(spark, sf_dir):
    before, after, plan = _reuse(spark, sf_dir)
    return changes.stored_versions(plan, after, before).select("site", "product_id", "selling_price", "description")


@query(_QUIET + """, rows AS (SELECT a.product_id, CASE WHEN a.l_partkey % 3 = 0 THEN a.selling_price + 1 WHEN r.product_id IS NOT NULL THEN r.selling_price ELSE a.selling_price END AS selling_price
  FROM after a LEFT JOIN reused r ON r.site = a.site AND r.product_id = a.product_id WHERE a.site = 'site_1') SELECT product_id, selling_price FROM rows""")
def site_snapshot(spark, sf_dir):
    before, after, plan = _reuse(spark, sf_dir)
    listing = after.where("site = 'site_1'")
    details = listing.where("product_id % 3 = 0").withColumn("selling_price", F.col("selling_price") + 1)
    return jobs.refresh_site("site_1", listing, details, before, plan).select("product_id", "selling_price")


@query(_SPLIT + "SELECT site, parent_product_id AS parent, min(product_id) AS product_id FROM after GROUP BY ALL")
def parent_representatives(spark, sf_dir):
    _, after = _split(spark, sf_dir)
    return changes.representatives(after).select("site", "parent", "product_id")


@query(_SPLIT + "SELECT count(*) = 0 AS completed, count(*) AS unprocessed FROM (SELECT DISTINCT site, parent_product_id FROM after EXCEPT SELECT DISTINCT site, parent_product_id FROM before)")
def sweep_outcome(spark, sf_dir):
    before, after = _split(spark, sf_dir)
    parents = lambda df: df.select("site", F.col("parent_product_id").alias("parent"))
    return changes.run_outcome(parents(before), parents(after), True)


@query(_SPLIT + "SELECT a.site, a.product_id FROM after a WHERE (a.site, a.product_id) NOT IN (SELECT (site, product_id) FROM before)")
def final_sync_need(spark, sf_dir):
    before, after = _split(spark, sf_dir)
    return changes.needs_final_sync(after, before).select(*KEY)


@query(_SPLIT + """, b AS (SELECT site, count(*) FILTER (l_partkey % 3 <> 0) AS n FROM before GROUP BY site), a AS (SELECT site, count(*) AS n FROM after GROUP BY site) SELECT a.site, a.n >= 1.4 * b.n AS complete, FALSE AS filtered FROM a JOIN b USING (site)""")
def sweep_gate(spark, sf_dir):
    before, after = _split(spark, sf_dir)
    stored = before.withColumn("is_active", F.when(F.col("product_id") % 3 == 0, False))
    return changes.sweep_gates(after, stored, 1.4).select("site", "complete", F.lit(False).alias("filtered"))


@query(_SPLIT + "SELECT a.site, a.product_id, CASE WHEN a.l_partkey % 2 = 0 THEN coalesce(b.description, '') ELSE a.description END AS description, a.selling_price FROM after a LEFT JOIN before b ON a.site = b.site AND a.product_id = b.product_id")
def rich_fields_kept(spark, sf_dir):
    before, after = _split(spark, sf_dir)
    new = after.withColumn("description", F.when(F.col("product_id") % 2 == 0, "").otherwise(F.col("description")))
    return catalogue.preserve_rich_fields(new, before).select("site", "product_id", "description", "selling_price")


@query(f"SELECT site, product_id FROM latest WHERE description <> '' AND scraped_at >= TIMESTAMP '{CUT}' - INTERVAL 300 DAY")
def recent_rows_reused(spark, sf_dir):
    return changes.complete_recent(latest(spark, sf_dir).drop("ord"), _now(), 300, ("description",)).select(*KEY)


@query("SELECT site, product_id FROM latest WHERE l_partkey % 3 <> 1")
def detail_price_queue(spark, sf_dir):
    k = F.col("product_id") % 3
    listing = latest(spark, sf_dir).withColumns({"mrp": F.when(k != 0, F.col("mrp")), "sku": F.when(k == 1, "S1").otherwise(" ")})
    return changes.detail_price_candidates(listing).select(*KEY)


@query(_FLAGS + """, t AS (SELECT *, CAST(product_id AS BIGINT) % 5 = 0 AS lost, CAST(product_id AS BIGINT) % 5 = 1 AS got FROM placed)
SELECT site, product_id, needs AND NOT lost AND NOT got AS pending, lost AND NOT got AS gone, got AS fetched FROM t WHERE is_new OR changed OR needs OR got""")
def detail_tombstones(spark, sf_dir):
    before, after = _split(spark, sf_dir)
    rich = {"description_html": "string", "ingredients": "string", "how_to_use": "string", "key_ingredients": "array<string>"}
    blank = {c: F.lit(None).cast(k) for c, k in rich.items()}
    listing, stored = after.drop(*_DROP).withColumns(blank), _state(before.drop(*_DROP).withColumns(blank))
    flags = changes.detail_candidates(listing, stored, _now(), 300)
    details = listing.where("product_id % 5 = 1").withColumn("ingredients", F.lit("Water"))
    rows, _ = changes.incremental_state(changes.merge_details(listing, details), details, stored, flags, _now(), "run-1", listing.where("product_id % 5 = 0"))
    return rows.select("site", "product_id", F.col("detail_refresh_pending").alias("pending"), F.col("detail_unavailable").alias("gone"), (F.coalesce("ingredients", F.lit("")) == "Water").alias("fetched"))


@query("SELECT site, product_id, count(DISTINCT (description, gtin, l_suppkey)) AS versions FROM obs GROUP BY ALL")
def detail_fingerprints(spark, sf_dir):
    rows = obs(spark, sf_dir)
    return rows.withColumn("fp", fingerprints.detail_fingerprint(rows)).groupBy("site", "product_id").agg(F.count_distinct("fp").alias("versions"))


@query("SELECT site, product_id, ord, mrp::DECIMAL(12,2)::DOUBLE AS mrp, selling_price::DECIMAL(12,2)::DOUBLE AS selling_price, discount_pct::DECIMAL(7,2)::DOUBLE AS discount_pct FROM obs")
def history_shape(spark, sf_dir):
    rows = obs(spark, sf_dir)
    points = catalogue.history_rows(rows.withColumn("variant", F.col("ord").cast("string")))
    return points.select("site", "product_id", F.col("variant").cast("long").alias("ord"), *[F.col(c).cast("double").alias(c) for c in ("mrp", "selling_price", "discount_pct")])


@query(_SPLIT + """SELECT coalesce(a.site, b.site) AS site, coalesce(a.product_id, b.product_id) AS product_id, coalesce(a.selling_price, b.selling_price) AS selling_price,
  (SELECT count(*) FROM before) + (SELECT count(*) FROM after) AS points FROM before b FULL JOIN after a ON a.site = b.site AND a.product_id = b.product_id""")
def catalogue_sync(spark, sf_dir):
    folder = scratch(spark)
    table, history = VersionedTable(spark, f"{folder}/table"), sinks.DayHistory(spark, f"{folder}/history", "year")
    for rows in _split(spark, sf_dir):
        sinks.sync(table, history, _products(rows), _now())
    points = history.read(HISTORY_DDL).agg(F.count("*").alias("points"))
    return table.read(CATALOGUE_DDL).select("site", "product_id", "selling_price").crossJoin(F.broadcast(points))  # of one row


@query(_FLAGS + """SELECT site, count(*) AS products_seen, count(*) FILTER (is_new) AS products_new, count(*) FILTER (changed) AS products_changed, (SELECT count(*) FROM before b WHERE b.site = 'site_1' AND b.product_id NOT IN (SELECT product_id FROM after WHERE site = 'site_1')) AS missing
FROM placed WHERE site = 'site_1' GROUP BY site""")
def incremental_site_run(spark, sf_dir):
    folder = scratch(spark)
    table, history = VersionedTable(spark, f"{folder}/table"), sinks.DayHistory(spark, f"{folder}/history", "year")
    before, after = _split(spark, sf_dir)
    stored = _state(_products(before)).withColumn("created_at", F.lit(None).cast("timestamp"))
    table.write(stored)
    listing = _products(after.where("site = 'site_1'"))
    counters = jobs.incremental_run("site_1", "run-1", listing, listing.limit(0), table, history, _now(), CATALOGUE_DDL, HISTORY_DDL, refresh_days=300)
    missing = table.read(CATALOGUE_DDL).where("site = 'site_1' AND missing_run_count = 1").agg(F.count("*").alias("missing"))
    return counters.select("site", "products_seen", "products_new", "products_changed").crossJoin(F.broadcast(missing))  # of one row


# --- choices -----------------------------------------------------------------------------------


@query("SELECT site, product_id, CASE WHEN l_partkey % 5 <> 0 THEN 'offline' ELSE 'page' END AS kind FROM latest WHERE gtin = ''")
def gtin_targets(spark, sf_dir):
    rows = latest(spark, sf_dir).withColumn("product_attributes", F.when(F.col("product_id") % 5 != 0, F.col("product_attributes")))
    offline, pages = barcodes.sweep_targets(rows)
    return offline.select(*KEY, F.lit("offline").alias("kind")).unionByName(pages.select(*KEY, F.lit("page").alias("kind")))


@query("SELECT site, product_id FROM latest WHERE regexp_replace(lower(brand), '[^a-z0-9]+', '', 'g') IN ('brand1', 'brand2', 'brand11')")
def brand_allow_list(spark, sf_dir):
    brands = spark.range(1).select(F.explode(F.array(F.lit("BRAND 1"), F.lit("brand-2"), F.lit("Brand#11"), F.lit(" "))).alias("brand"))
    return barcodes.allow_brands(latest(spark, sf_dir), brands).select(*KEY)


_STATE_DDL = "product_id string, brand string, product_name string, mrp double, selling_price double, in_stock boolean, description string, site string"


@query(_SPLIT + """SELECT coalesce(a.site, b.site) AS site, coalesce(a.product_id, b.product_id) AS product_id, coalesce(a.selling_price, b.selling_price) AS selling_price, CASE WHEN a.site IS NOT NULL THEN a.in_stock ELSE b.in_stock END AS in_stock, b.description AS description
FROM before b FULL JOIN (SELECT * FROM after WHERE site = 'site_2' OR l_partkey % 7 = 0) a ON a.site = b.site AND a.product_id = b.product_id""")
def upsert_parts(spark, sf_dir):
    folder, (before, after) = scratch(spark), _split(spark, sf_dir)
    sinks.upsert_parts(spark, folder, before.select("product_id", "brand", "product_name", "mrp", "selling_price", "in_stock", "description", "site"), _STATE_DDL, 4)
    for batch in (after.where("site = 'site_2'"), after.where("product_id % 7 = 0"), after.where("product_id % 7 = 0")):
        sinks.upsert_parts(spark, folder, batch.select("site", "product_id", "selling_price", "in_stock"), _STATE_DDL, 4)
    return sinks.read_parts(spark, folder, _STATE_DDL).select("site", "product_id", "selling_price", "in_stock", "description")


@query(f"SELECT site, product_id, strftime(scraped_at, '%Y-%m-%d') AS seen, max(CASE WHEN scraped_at < TIMESTAMP '{CUT}' THEN 0 ELSE ord END) AS ord, count(*) FILTER (ord < 0) AS again FROM obs GROUP BY site, product_id, scraped_at")
def history_by_day(spark, sf_dir):
    folder, rows = scratch(spark), obs(spark, sf_dir)
    kinds = "site string, product_id string, scraped_at timestamp, ord long"
    old = rows.where(f"scraped_at < '{CUT}'").withColumn("ord", F.lit(0).cast("long"))
    for batch in (old, rows, rows):
        sinks.append_days(spark, folder, batch.select("site", "product_id", "scraped_at", F.col("ord").cast("long").alias("ord")), kinds, period="year")
    return spark.read.parquet(folder).select("site", "product_id", F.date_format("scraped_at", "yyyy-MM-dd").alias("seen"), "ord", F.lit(0).cast("long").alias("again"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name || '|' || p_type), 'small') OR contains(lower(p_name || '|' || p_type), 'red')", with_obs=False)
def keyword_rows(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_name", F.struct("p_type").alias("kinds"), "p_partkey")
    return dims.keyword_filter(p, ["SMALL", "red", "p_name", "kinds", "p_type"]).select("p_partkey")  # names of columns are no values


@query("""WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(p_name), '[^a-z]+')) AS word FROM part) WHERE length(word) >= 3)
SELECT d.doc_id, list_sort(list(w.word)) AS words FROM documents d JOIN w ON contains(lower(d.text), w.word) GROUP BY d.doc_id""", with_obs=False)
def words_in_documents(spark, sf_dir):
    names = _table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), "[^a-z]+")).alias("word")).where("length(word) >= 3")
    return dims.find_words(_table(spark, sf_dir, "documents").select("doc_id", "text"), F.lower("text"), names, "words").where("size(words) > 0").select("doc_id", "words")


@query("SELECT DISTINCT p_type AS name FROM part WHERE p_type NOT IN ('SMALL', 'LARGE') AND p_type <> 'PROMO'", with_obs=False)
def category_selection(spark, sf_dir):
    names = _table(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct()
    return dims.select_categories(names.select("name", (F.col("name") != "PROMO").alias("enabled"), F.when(F.col("name") == "ECONOMY", F.array(F.lit("SMALL"), F.lit("LARGE"))).alias("covers"))).select("name")


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3", with_obs=False)
def first_of_each_brand(spark, sf_dir):
    return dims.first_per_group(_table(spark, sf_dir, "part"), ["p_brand"], 3, [F.desc("p_retailprice"), "p_partkey"]).select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT site, brand, product_name, selling_price, gtin FROM latest ORDER BY lower(site), lower(brand), lower(product_name), lower(variant), product_id")
def sorted_catalogue(spark, sf_dir):
    return catalogue.canonical_order(latest(spark, sf_dir)).select("site", "brand", "product_name", "selling_price", "gtin")


# --- policy, outcome, scopes, frames -----------------------------------------------------------


@query(_SPLIT + f"""SELECT a.site, a.product_id, CASE WHEN b.site IS NULL THEN 'new' WHEN a.l_partkey % 2 = 0 THEN 'changed' WHEN date_diff('second', b.scraped_at, TIMESTAMP '{CUT}') > 400 * 86400 THEN 'stale' ELSE 'fresh' END AS reason
FROM after a LEFT JOIN before b ON a.site = b.site AND a.product_id = b.product_id""")
def policy_plan(spark, sf_dir):
    """No site collects content, so descriptions and images that are missing make nothing incomplete."""
    before, after = _split(spark, sf_dir)
    policy = changes.RefreshPolicy.of({"refresh": {"required_fields": ["description", "image_urls"]}, "automation": {"detail_refresh_days": 400}, "site_1": {"collect_content": False}, "site_2": {"collect_content": False}})
    same = ["site", "product_id", "brand", "product_name", "selling_price", "image_urls"]
    stored = before.select(*same, "scraped_at", F.lit("").alias("description"))
    listing = stored.select(*same).join(after.select("site", "product_id"), ["site", "product_id"]).withColumn("selling_price", F.when(F.col("product_id") % 2 == 0, F.col("selling_price") + 1).otherwise(F.col("selling_price")))
    fresh = after.select(*same).join(before.select("site", "product_id"), ["site", "product_id"], "left_anti")
    return policy.plan(listing.unionByName(fresh), stored, _now()).select("site", "product_id", "reason")


@query("""WITH r AS (SELECT 'site_' || (o_custkey % 7) AS site, o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'stopped: ' || o_orderpriority END AS reason FROM orders)
SELECT site, string_agg(reason, '; ' ORDER BY first) AS stop_reasons FROM (SELECT site, reason, min(ord) AS first FROM r WHERE trim(reason) <> '' GROUP BY ALL) GROUP BY site""", with_obs=False)
def sweep_stop_reasons(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    stops = o.select(F.concat(F.lit("site_"), (F.col("o_custkey") % 7).cast("string")).alias("site"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.concat(F.lit("stopped: "), "o_orderpriority")).alias("reason"))
    return changes.stop_reasons(stops).select("site", F.array_join("stop_reasons", "; ").alias("stop_reasons"))


_BANDS = (("low", "", None, 999.99), ("mid", "Middle", 1000.0, 1499.99), (" ", "no key", 0.0, 1.0), ("high", "Dear", 1500.0, None))


@query("""SELECT CASE WHEN p_type = 'ECONOMY' THEN p_type || '_' || CASE WHEN p_retailprice <= 999.99 THEN 'low' WHEN p_retailprice < 1500 THEN 'mid' ELSE 'high' END ELSE p_type END AS scope,
  CASE WHEN p_type = 'ECONOMY' THEN 'All ECONOMY — ' || CASE WHEN p_retailprice <= 999.99 THEN 'low' WHEN p_retailprice < 1500 THEN 'Middle' ELSE 'Dear' END ELSE 'All ' || p_type END AS name, count(*) AS products
FROM part WHERE p_type <> 'ECONOMY' OR p_retailprice <= 999.99 OR p_retailprice BETWEEN 1000 AND 1499.99 OR p_retailprice >= 1500 GROUP BY ALL""", with_obs=False)
def scope_partitions(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.col("p_type").alias("id"), F.col("p_retailprice").alias("selling_price"))
    bands = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for (n, t), v in zip((("key", "string"), ("name", "string"), ("low", "double"), ("high", "double")), b)]) for b in _BANDS])
    categories = part.select("id").distinct().select("id", F.concat(F.lit("All "), "id").alias("name"), (F.col("id") == "ECONOMY").alias("covers_all"), bands.alias("partitions"))
    scopes = dims.expand_scopes(categories)
    return dims.in_scopes(part, scopes).groupBy("scope").agg(F.count("*").alias("products")).join(scopes.select("scope", "name"), "scope")


@query("""SELECT p_partkey::VARCHAR AS product_id, p_name AS product_name, CASE WHEN p_partkey % 3 <> 0 THEN round(p_retailprice, 2) END AS mrp, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS in_stock,
  CASE WHEN p_partkey % 2 = 0 THEN 'a,' || p_type ELSE '' END AS categories, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS attributes FROM part""", with_obs=False)
def display_rows(spark, sf_dir):
    k = F.col("p_partkey")
    cells = _table(spark, sf_dir, "part").select(
        k.cast("string").alias("product_id"), F.col("p_name").alias("product_name"), F.when(k % 3 == 0, "n/a").otherwise(F.format_string("%.2f", F.col("p_retailprice").cast("double"))).alias("mrp"),
        F.element_at(F.array(*map(F.lit, ("TRUE", "0", "maybe", ""))), (k % 4 + 1).cast("int")).alias("in_stock"), F.when(k % 2 == 0, F.to_json(F.array(F.lit("a"), F.col("p_type")))).otherwise("a, b").alias("categories"),
        F.when(k % 5 == 0, F.to_json(F.create_map(F.lit("k"), F.col("p_type")))).otherwise("{broken").alias("product_attributes"), F.lit("x").alias("other"),
    )
    return readers.display_frame(cells).select("product_id", "product_name", "mrp", "in_stock", F.array_join("categories", ",").alias("categories"), F.size("product_attributes").alias("attributes"))


@query("SELECT p_partkey, 'é ' || p_name AS body FROM part", with_obs=False)
def charset_bodies(spark, sf_dir):
    p, text = _table(spark, sf_dir, "part"), F.concat(F.lit("é "), "p_name")
    latin = F.col("p_partkey") % 2 == 0
    pages = p.select("p_partkey", F.when(latin, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8")).alias("bytes"), F.when(latin, "text/html; Charset=\"latin1\"").when(F.col("p_partkey") % 3 == 0, "text/html").alias("kind"))
    return pages.select("p_partkey", markup.decode_body(F.col("bytes"), F.col("kind")).alias("body"))


@query(_SPLIT + f"SELECT coalesce(a.site, b.site) AS site, coalesce(a.product_id, b.product_id) AS product_id, coalesce(b.gtin, '') <> '' OR a.site IS NULL OR a.l_partkey % 3 <> 0 AS kept, CASE WHEN a.site IS NOT NULL THEN '{CUT}' ELSE '1999-01-01' END AS updated FROM before b FULL JOIN after a ON a.site = b.site AND a.product_id = b.product_id")
def updated_rows(spark, sf_dir):
    before, after = _split(spark, sf_dir)
    stored = before.select("site", "product_id", "gtin", "selling_price", F.lit("1999-01-01").cast("timestamp").alias("updated_at"))
    merged = catalogue.upsert(stored, after.select("site", "product_id", "selling_price"), now=_now())
    codes = after.where("product_id % 3 = 0").select("site", "product_id", F.lit("found").alias("gtin"))
    return catalogue.patch(merged, codes, "gtin", now=_now()).select("site", "product_id", (F.coalesce("gtin", F.lit("")) != "found").alias("kept"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))
