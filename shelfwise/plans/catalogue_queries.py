"""Registered catalogue queries over the driver's tables, with their SQL.

Most queries see one projection, ``obs``: an order line is an observation of a part (the product) on a
site (by supplier), at its ship date. SQL and Spark build the same projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import fingerprints, keys, titles, values
from shelfwise.operators import barcodes, catalogue, changes, comparison, dims, health, imports, matching
from shelfwise.session import configure
from shelfwise.sources.versions import stored

SITES = tuple(f"site_{i}" for i in range(6))
CUT, NOW = "2000-06-01", "2001-12-31"

OBS_SQL = """
WITH lines AS (
  SELECT l.*, p.*, l_suppkey % 6 AS s, '890' || lpad(l_partkey::VARCHAR, 9, '0') AS body
  FROM lineitem l JOIN part p ON l_partkey = p_partkey),
coded AS (
  SELECT *, body || ((10 - (SELECT sum(substr(body, i::INT, 1)::INT * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END) FROM range(1, 13) r(i)) % 10) % 10)::BIGINT::VARCHAR AS ean
  FROM (SELECT * FROM lines)),
obs AS (
  SELECT 'site_' || s AS site, l_partkey::VARCHAR AS product_id, (l_partkey // 4)::VARCHAR AS parent_product_id,
    CASE WHEN s = 0 THEN upper(p_brand) WHEN s = 1 THEN replace(p_brand, '#', ' ') ELSE p_brand END AS brand,
    p_name || ' ' || p_type || CASE WHEN l_partkey % 5 = 0 THEN ' SPF 50 sunscreen' WHEN l_partkey % 5 = 1 THEN ' 10% serum' WHEN l_partkey % 5 = 2 THEN ' face wash combo' ELSE '' END AS product_name,
    p_type AS category, p_size || ' ml' AS variant, p_retailprice AS mrp,
    (p_retailprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)))::DECIMAL(12,2)::DOUBLE AS selling_price,
    round(l_discount * 100)::DOUBLE AS discount_pct, l_linestatus = 'O' AS in_stock, l_shipdate AS scraped_at, l_orderkey * 10 + l_linenumber AS ord,
    CASE WHEN s IN (2, 3) OR l_partkey % 3 = 0 THEN '' ELSE ean END AS gtin, ean,
    CASE WHEN l_partkey % 7 = 0 THEN '' ELSE p_name END AS description, l_suppkey, l_partkey
  FROM coded),
latest AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY site, product_id ORDER BY scraped_at DESC, ord DESC) = 1)
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _placed(lines: DataFrame) -> DataFrame:
    """Order lines with their site's number as ``place``, and their ``ord``."""
    return lines.withColumns({"place": F.col("l_suppkey") % 6, "ord": F.col("l_orderkey") * 10 + F.col("l_linenumber")})


def _seen(lines: DataFrame, parts: DataFrame, *more: str) -> DataFrame:
    """The observations that order lines (of ``_placed``) are, with the lines' columns ``more``."""
    lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    s, brand, part = F.col("place"), F.col("p_brand"), F.col("l_partkey")
    body = F.concat(F.lit("890"), F.lpad(part.cast("string"), 9, "0"))
    total = lambda b: sum((F.substring(b, i, 1).cast("int") * (3 if i % 2 == 0 else 1) for i in range(1, 13)), F.lit(0))
    ean = keys.once(body, lambda b: F.concat(b, ((10 - total(b) % 10) % 10).cast("string")))
    tail = F.when(part % 5 == 0, " SPF 50 sunscreen").when(part % 5 == 1, " 10% serum").when(part % 5 == 2, " face wash combo").otherwise("")
    price = (F.col("p_retailprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(12,2)").cast("double")
    picture = lambda name: F.concat(F.lit("https://img.example.com/"), name, F.lit(".jpg"))
    return lines.select(
        F.concat(F.lit("site_"), s.cast("string")).alias("site"), part.cast("string").alias("product_id"), F.floor(part / 4).cast("string").alias("parent_product_id"),
        F.when(s == 0, F.upper(brand)).when(s == 1, F.replace(brand, F.lit("#"), F.lit(" "))).otherwise(brand).alias("brand"),
        F.concat("p_name", F.lit(" "), "p_type", tail).alias("product_name"), F.array("p_type").alias("categories"), F.concat(F.col("p_size").cast("string"), F.lit(" ml")).alias("variant"),
        F.col("p_retailprice").alias("mrp"), price.alias("selling_price"), F.round(F.col("l_discount") * 100).alias("discount_pct"), (F.col("l_linestatus") == "O").alias("in_stock"),
        F.col("l_shipdate").cast("timestamp").alias("scraped_at"), "ord",
        F.when(s.isin(2, 3) | (part % 3 == 0), "").otherwise(ean).alias("gtin"), F.when(part % 7 == 0, "").otherwise(F.col("p_name")).alias("description"),
        F.array(picture(part.cast("string")), picture(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))).alias("image_urls"), picture(part.cast("string")).alias("image_url"),
        F.create_map(F.lit("UPC"), F.when(part % 2 == 0, ean).otherwise("none"), F.lit("Item model number"), ean).alias("product_attributes"), F.lit("").alias("product_url"), *more,
    )


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(_placed(_table(spark, sf_dir, "lineitem")), _table(spark, sf_dir, "part"))


def latest(spark: SparkSession, sf_dir: str, lines: Column | None = None) -> DataFrame:
    """The latest observation of each product, of the order lines that ``lines`` picks. Lines are narrow, so most that
    are not the latest are dropped before they meet their parts: then one for each site and part is left. They lie
    by their part then, so the observations, which are chosen once more (without that Spark repeats the texts'
    expressions in what reads them), are chosen where they are, and no text is shuffled."""
    rows = _table(spark, sf_dir, "lineitem")
    where = ("l_partkey", "place")
    newest = catalogue.latest_per_key(_placed(rows if lines is None else rows.where(lines)), where, ("l_shipdate", "ord"))
    return catalogue.latest_per_key(_seen(newest, _table(spark, sf_dir, "part"), *where), (*where, "site", "product_id")).drop(*where)


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, with_obs: bool = True):
    """Register a function as a query, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = (OBS_SQL + sql) if with_obs else sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from shelfwise.plans import job_queries, match_queries, payload_queries, stream_queries  # noqa: F401  (they register theirs)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


# --- catalogue ---------------------------------------------------------------------------------


@query("SELECT site, product_id, brand, selling_price, strftime(scraped_at, '%Y-%m-%d') AS seen FROM latest")
def latest_per_product(spark, sf_dir):
    return latest(spark, sf_dir).select("site", "product_id", "brand", "selling_price", F.date_format("scraped_at", "yyyy-MM-dd").alias("seen"))


@query(""", per AS (
  SELECT site, product_id, list(DISTINCT category ORDER BY category) AS cats, count(*) AS n FROM obs GROUP BY ALL),
urls AS (
  SELECT site, product_id, u.url, min(struct_pack(a := -epoch_us(scraped_at), b := -ord, c := u.pos)) AS first FROM obs,
    LATERAL (SELECT unnest(['https://img.example.com/' || l_partkey || '.jpg', 'https://img.example.com/s' || l_suppkey || '.jpg']) AS url, unnest([0, 1]) AS pos) u
  GROUP BY site, product_id, u.url),
pics AS (SELECT site, product_id, string_agg(url, ' ' ORDER BY first) AS images FROM urls GROUP BY ALL)
SELECT l.site, l.product_id, l.selling_price, array_to_string(p.cats, ',') AS categories, pics.images, 2 AS attributes
FROM latest l JOIN per p USING (site, product_id) JOIN pics USING (site, product_id)""")
def catalogue_dedup_merge(spark, sf_dir):
    merged = catalogue.dedup_merge(obs(spark, sf_dir))
    return merged.select("site", "product_id", "selling_price", F.array_join("categories", ",").alias("categories"), F.array_join("image_urls", " ").alias("images"), F.size("product_attributes").alias("attributes"))


@query(""", g AS (SELECT product_id, min(selling_price) AS min_price, max(selling_price) AS max_price,
    min(struct_pack(p := selling_price, s := site)).s AS cheapest_platform,
    max(selling_price) FILTER (site = 'site_0') AS own, min(selling_price) FILTER (site <> 'site_0') AS rival FROM latest GROUP BY product_id)
SELECT product_id, min_price, max_price, cheapest_platform, round(max_price - min_price, 2) AS price_gap,
  CASE WHEN min_price <> 0 THEN round((max_price - min_price) / min_price * 100, 2) END AS price_gap_pct,
  round(own - rival, 2) AS site_0_vs_cheapest, CASE WHEN rival <> 0 THEN round((own - rival) / rival * 100, 2) END AS site_0_vs_cheapest_pct FROM g""")
def cheapest_platform(spark, sf_dir):
    return comparison.price_summary(latest(spark, sf_dir), ["product_id"], SITES, "site_0")


@query("SELECT product_id, " + ", ".join(f"max(selling_price) FILTER (site = '{s}') AS {s}" for s in SITES) + " FROM latest GROUP BY product_id")
def price_comparison_pivot(spark, sf_dir):
    return latest(spark, sf_dir).groupBy("product_id").pivot("site", list(SITES)).agg(F.max("selling_price"))


@query("""SELECT site, product_id, ord, selling_price FROM (
  SELECT *, lag(struct_pack(selling_price, discount_pct, in_stock, mrp)) OVER w AS before, row_number() OVER w AS nth FROM obs
  WINDOW w AS (PARTITION BY site, product_id ORDER BY scraped_at, ord))
WHERE nth = 1 OR struct_pack(selling_price, discount_pct, in_stock, mrp) IS DISTINCT FROM before""")
def price_history_changes(spark, sf_dir):
    return catalogue.price_changes(obs(spark, sf_dir)).select("site", "product_id", "ord", "selling_price")


@query(f"""SELECT site, product_id, strftime(scraped_at, '%Y-%m-%d') AS seen, max(ord) AS ord FROM obs
WHERE (site, product_id, scraped_at) NOT IN (SELECT (site, product_id, scraped_at) FROM obs WHERE scraped_at < TIMESTAMP '{CUT}') GROUP BY ALL""")
def history_append(spark, sf_dir):
    rows = obs(spark, sf_dir)
    history = rows.where(f"scraped_at < '{CUT}'").select("site", "product_id", "scraped_at", "ord")
    return catalogue.append_history(history, rows, order=["ord"]).select("site", "product_id", F.date_format("scraped_at", "yyyy-MM-dd").alias("seen"), "ord")


_SPLIT = f""", before AS (SELECT * FROM obs WHERE scraped_at < TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY site, product_id ORDER BY scraped_at DESC, ord DESC) = 1),
after AS (SELECT * FROM obs WHERE scraped_at >= TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY site, product_id ORDER BY scraped_at DESC, ord DESC) = 1)
"""


def _split(spark, sf_dir):
    before = F.col("l_shipdate").cast("timestamp") < CUT
    return latest(spark, sf_dir, before), latest(spark, sf_dir, ~before)


def _state(stored: DataFrame) -> DataFrame:
    empty = {"source_fingerprint": "string", "detail_fingerprint": "string", "first_seen_at": "timestamp", "last_seen_at": "timestamp", "last_checked_at": "timestamp", "last_changed_at": "timestamp", "last_detail_scraped_at": "timestamp", "detail_refresh_pending": "boolean", "detail_unavailable": "boolean", "updated_at": "timestamp"}
    return stored.withColumns({c: F.lit(None).cast(k) for c, k in empty.items()} | {"is_active": F.lit(True), "missing_run_count": F.lit(0), "last_seen_run_id": F.lit("run-0")})


@query(_SPLIT + """SELECT coalesce(a.site, b.site) AS site, coalesce(a.product_id, b.product_id) AS product_id, coalesce(a.selling_price, b.selling_price) AS selling_price,
  CASE WHEN a.site IS NOT NULL THEN a.in_stock ELSE b.in_stock END AS in_stock, b.description AS description
FROM before b FULL JOIN after a ON a.site = b.site AND a.product_id = b.product_id""")
def upsert_merge(spark, sf_dir):
    before, after = _split(spark, sf_dir)
    return catalogue.upsert(before, after.select("site", "product_id", "selling_price", "in_stock")).select("site", "product_id", "selling_price", "in_stock", "description")


@query(_SPLIT + """SELECT coalesce(a.site, b.site) AS site, coalesce(a.product_id, b.product_id) AS product_id,
  CASE WHEN a.site IS NULL THEN b.selling_price WHEN a.l_partkey % 2 = 0 THEN a.selling_price ELSE b.selling_price END AS selling_price,
  CASE WHEN a.site IS NULL THEN b.in_stock WHEN a.l_partkey % 2 = 1 THEN a.in_stock ELSE b.in_stock END AS in_stock
FROM before b FULL JOIN after a ON a.site = b.site AND a.product_id = b.product_id""")
def upsert_by_shape(spark, sf_dir):
    before, after = _split(spark, sf_dir)
    even = F.col("product_id").cast("long") % 2 == 0
    new = after.select("site", "product_id", "selling_price", "in_stock", F.when(even, F.array(F.lit("selling_price"))).otherwise(F.array(F.lit("in_stock"))).alias("present"))
    return catalogue.upsert(before.select("site", "product_id", "selling_price", "in_stock"), new, present="present")


@query(_SPLIT + """SELECT b.site, b.product_id, CASE WHEN a.site IS NULL AND b.site = 'site_1' THEN 1 ELSE 0 END AS missing_run_count,
  CASE WHEN a.site IS NULL THEN 'run-0' ELSE 'run-1' END AS last_seen_run_id, NOT (a.site IS NULL AND b.site = 'site_1') AS is_active
FROM before b LEFT JOIN (SELECT DISTINCT site, product_id FROM after) a ON a.site = b.site AND a.product_id = b.product_id""")
def age_missing(spark, sf_dir):
    before, after = _split(spark, sf_dir)
    touched = catalogue.touch(_state(before), after, F.lit(NOW).cast("timestamp"), "run-1")
    return catalogue.age_missing(touched, "site_1", "run-1", 1).select("site", "product_id", "missing_run_count", "last_seen_run_id", "is_active")


@query(_SPLIT + f"""SELECT b.site, b.product_id, CASE WHEN a.site IS NOT NULL THEN '{NOW}' END AS last_seen FROM before b LEFT JOIN after a ON a.site = b.site AND a.product_id = b.product_id""")
def touch_seen(spark, sf_dir):
    before, after = _split(spark, sf_dir)
    return catalogue.touch(_state(before), after, F.lit(NOW).cast("timestamp"), "run-1").select("site", "product_id", F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"))


@query(_SPLIT + """SELECT site, product_id, selling_price FROM before WHERE site <> 'site_2' UNION ALL SELECT site, product_id, selling_price FROM after WHERE site = 'site_2'""")
def snapshot_replace(spark, sf_dir):
    before, after = _split(spark, sf_dir)
    return catalogue.replace_site(before, after.where("site = 'site_2'"), "site_2").select("site", "product_id", "selling_price")


@query("SELECT site, product_id, row_number() OVER (PARTITION BY site, product_id ORDER BY pos)::INT AS position, url FROM (SELECT site, product_id, unnest(['https://img.example.com/' || l_partkey || '.jpg', 'https://img.example.com/s' || l_suppkey || '.jpg']) AS url, unnest([0, 1]) AS pos FROM latest)")
def gallery_explode(spark, sf_dir):
    return catalogue.images(latest(spark, sf_dir)).select("site", "product_id", "position", "url")


@query("""WITH r AS (SELECT 'site_' || conv_id % 3 AS site, (conv_id // 5)::VARCHAR AS parent, conv_id, turn, role AS reviewer, text FROM conversations)
SELECT site, parent, reviewer, turn::VARCHAR AS review_id, conv_id::VARCHAR AS product_id FROM r QUALIFY row_number() OVER (PARTITION BY site, parent, turn ORDER BY conv_id::VARCHAR) = 1""", with_obs=False)
def review_dedup(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    r = F.struct(F.col("turn").cast("string").alias("review_id"), F.lit("").alias("title"), F.col("text").alias("review"), F.col("role").alias("reviewer"), F.lit("").alias("created_at"))
    products = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(r)).alias("top_reviews"))
    products = products.select(F.concat(F.lit("site_"), (F.col("conv_id") % 3).cast("string")).alias("site"), F.floor(F.col("conv_id") / 5).cast("string").alias("parent_product_id"), F.col("conv_id").cast("string").alias("product_id"), "top_reviews")
    return catalogue.reviews(products).select("site", "parent", "reviewer", "review_id", "product_id")


@query("SELECT 'unique' AS rule, site || '/' || product_id AS key, count(*) AS count FROM obs GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'site', site, count(*) FROM obs WHERE site = 'site_5' GROUP BY ALL")
def schema_violations(spark, sf_dir):
    return catalogue.schema_violations(obs(spark, sf_dir), SITES[:5])


@query("SELECT site, count(*) AS products FROM latest GROUP BY site")
def products_per_site(spark, sf_dir):
    return latest(spark, sf_dir).groupBy("site").agg(F.count("*").alias("products"))


# --- functions ---------------------------------------------------------------------------------


@query("SELECT DISTINCT brand, regexp_replace(lower(brand), '[^a-z0-9]+', '', 'g') AS bkey, trim(regexp_replace(lower(product_name), '[^a-z0-9]+', ' ', 'g')) AS folded FROM obs")
def brand_key(spark, sf_dir):
    return obs(spark, sf_dir).select("brand", keys.brand_key(F.col("brand")).alias("bkey"), keys.normalize_text(F.col("product_name")).alias("folded")).distinct()


@query(""", c AS (SELECT DISTINCT l_partkey, CASE l_partkey % 4 WHEN 0 THEN ean WHEN 1 THEN ' ' || substr(ean, 1, 3) || '-' || substr(ean, 4) WHEN 2 THEN substr(ean, 1, 12) || ((substr(ean, 13, 1)::INT + 1) % 10)::VARCHAR ELSE 'B0' || l_partkey END AS raw FROM obs),
d AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM c),
v AS (SELECT l_partkey, raw, CASE WHEN len(digits) IN (8, 12, 13, 14)
    AND (10 - (SELECT sum(substr(lpad(digits, 14, '0'), i::INT, 1)::INT * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END) FROM range(1, 14) r(i)) % 10) % 10 = right(digits, 1)::INT THEN digits ELSE '' END AS gtin FROM d)
SELECT l_partkey, raw, gtin, gtin <> '' AND NOT (""" + " OR ".join(f"coalesce(try_cast(left(lpad(right(gtin, 13), 13, '0'), 3) AS INT), 999) BETWEEN {low} AND {high}" for low, high in keys.RESTRICTED_PREFIXES) + """) AS plausible FROM v""")
def gtin_check(spark, sf_dir):
    o = obs(spark, sf_dir).select(F.col("product_id").cast("long").alias("l_partkey"), F.element_at("product_attributes", "Item model number").alias("ean")).distinct()
    k, ean = F.col("l_partkey") % 4, F.col("ean")
    raw = F.when(k == 0, ean).when(k == 1, F.concat(F.lit(" "), F.substring(ean, 1, 3), F.lit("-"), F.substring(ean, 4, 10))).when(k == 2, F.concat(F.substring(ean, 1, 12), ((F.substring(ean, 13, 1).cast("int") + 1) % 10).cast("string"))).otherwise(F.concat(F.lit("B0"), F.col("l_partkey").cast("string")))
    return o.select("l_partkey", raw.alias("raw"), keys.normalize_gtin(raw).alias("gtin"), keys.plausible_barcode(keys.normalize_gtin(raw)).alias("plausible"))


_TITLES = """SELECT p_partkey, p_brand, p_name || CASE p_partkey % 6 WHEN 0 THEN ' serum ' || p_size || ' ml' WHEN 1 THEN ' 2 x ' || p_size || ' g cream' WHEN 2 THEN ' face wash Pack of 3 (' || p_size || 'ml) 5% SPF 30'
  WHEN 3 THEN ' lip balm ' || p_size || ' oz combo' WHEN 4 THEN ' body oil 1.5 l 0.50% 10%' ELSE ' ring' END AS title FROM part"""


def _titles(spark, sf_dir):
    p, size = _table(spark, sf_dir, "part"), F.col("p_size").cast("string")
    k = F.col("p_partkey") % 6
    tail = F.when(k == 0, F.concat(F.lit(" serum "), size, F.lit(" ml"))).when(k == 1, F.concat(F.lit(" 2 x "), size, F.lit(" g cream"))).when(k == 2, F.concat(F.lit(" face wash Pack of 3 ("), size, F.lit("ml) 5% SPF 30"))).when(k == 3, F.concat(F.lit(" lip balm "), size, F.lit(" oz combo"))).when(k == 4, F.lit(" body oil 1.5 l 0.50% 10%")).otherwise(F.lit(" ring"))
    return p.select("p_partkey", "p_brand", "p_size", F.concat("p_name", tail).alias("title"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 1, 2) THEN p_size::DOUBLE WHEN p_partkey % 6 = 3 THEN round(p_size::DECIMAL(12, 4) * 29.5735, 1)::DOUBLE WHEN p_partkey % 6 = 4 THEN 1500.0 END AS amount,
  CASE WHEN p_partkey % 6 IN (0, 2, 3, 4) THEN 'ml' WHEN p_partkey % 6 = 1 THEN 'g' END AS unit, CASE WHEN p_partkey % 6 = 5 THEN 0 WHEN p_partkey % 6 = 1 THEN 2 WHEN p_partkey % 6 = 2 THEN 3 ELSE 1 END AS pack FROM part""", with_obs=False)
def size_parse(spark, sf_dir):
    return _titles(spark, sf_dir).withColumn("size", titles.parse_size(F.col("title"))).select("p_partkey", "size.amount", "size.unit", F.coalesce("size.pack", F.lit(0)).alias("pack"))


@query("WITH t AS (" + _TITLES + ") SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'serum' WHEN 1 THEN 'moisturizer' WHEN 2 THEN 'cleanser' WHEN 3 THEN 'lip' WHEN 4 THEN 'oil' ELSE '' END AS form, p_partkey % 6 = 3 AS bundle FROM t", with_obs=False)
def form_detect(spark, sf_dir):
    return _titles(spark, sf_dir).select("p_partkey", titles.detect_form(F.col("title")).alias("form"), titles.is_bundle(F.col("title")).alias("bundle"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 2 THEN 'pct5 spf30' WHEN 4 THEN 'pct0.5 pct10' ELSE '' END AS strengths FROM part", with_obs=False)
def strengths(spark, sf_dir):
    return _titles(spark, sf_dir).select("p_partkey", F.array_join(titles.strengths(F.col("title")), " ").alias("strengths"))


@query(""", w AS (SELECT DISTINCT product_name, brand, unnest(string_split(trim(regexp_replace(lower(product_name), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM obs)
SELECT product_name, brand, string_agg(DISTINCT word, ' ' ORDER BY word) AS tokens FROM w
WHERE word <> '' AND word NOT IN (""" + ", ".join(f"'{w}'" for w in titles.STOP_WORDS) + """) AND NOT regexp_full_match(word, '[0-9]+')
  AND NOT list_contains(string_split(trim(regexp_replace(lower(brand), '[^a-z0-9]+', ' ', 'g')), ' '), word) GROUP BY product_name, brand""")
def name_tokens(spark, sf_dir):
    rows = obs(spark, sf_dir).select("product_name", "brand").distinct()
    return rows.select("product_name", "brand", F.array_join(titles.name_tokens(F.col("product_name"), F.col("brand")), " ").alias("tokens"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS ord, l_extendedprice AS sheet, l_extendedprice AS payload, CASE WHEN l_quantity > 25 THEN (l_quantity * 100)::BIGINT ELSE l_quantity::BIGINT END AS n,
  CASE l_returnflag WHEN 'A' THEN TRUE WHEN 'N' THEN FALSE END AS word, CASE l_linestatus WHEN 'O' THEN TRUE ELSE FALSE END AS available FROM lineitem""", with_obs=False)
def lenient_values(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem")
    price = F.format_number("l_extendedprice", 2)
    count = F.when(F.col("l_quantity") > 25, F.concat((F.col("l_quantity") / 10).cast("string"), F.lit("K ratings"))).otherwise(F.col("l_quantity").cast("int").cast("string"))
    flag = F.when(F.col("l_returnflag") == "A", " Yes ").when(F.col("l_returnflag") == "N", "out of stock").otherwise("maybe")
    status = F.when(F.col("l_linestatus") == "O", "https://schema.org/InStock").otherwise("Currently unavailable")
    return t.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), values.sheet_number(F.concat(F.lit("₹ "), price)).alias("sheet"), values.payload_number(F.concat(F.lit("Rs "), price, F.lit(" only 1"))).alias("payload"),
        values.short_count(count).alias("n"), values.boolean_word(flag).alias("word"), values.availability(status).alias("available"),
    )


@query("SELECT site, product_id, count(DISTINCT (mrp, selling_price, discount_pct, in_stock, brand, product_name, variant, category, parent_product_id)) AS versions FROM obs GROUP BY ALL")
def changed_fingerprint(spark, sf_dir):
    rows = obs(spark, sf_dir)
    return rows.withColumn("fp", fingerprints.source_fingerprint(rows)).groupBy("site", "product_id").agg(F.count_distinct("fp").alias("versions"))


# --- changes -----------------------------------------------------------------------------------

_REASON = f"""CASE WHEN b.site IS NULL THEN 'new'
  WHEN (a.mrp, a.selling_price, a.discount_pct, a.in_stock) IS DISTINCT FROM (b.mrp, b.selling_price, b.discount_pct, b.in_stock) THEN 'changed'
  WHEN b.description = '' THEN 'incomplete' WHEN b.scraped_at < TIMESTAMP '{CUT}' - INTERVAL 300 DAY THEN 'stale' ELSE 'fresh' END"""


def _plan(spark, sf_dir):
    before, after = _split(spark, sf_dir)
    drop = ("ord", "image_url", "image_urls", "product_attributes")
    return changes.refresh_plan(after.drop(*drop), before.drop(*drop), F.lit(CUT).cast("timestamp"), 300, required=("description",))


@query(_SPLIT + f"SELECT a.site, a.product_id, {_REASON} AS reason, {_REASON} <> 'fresh' AS needed FROM after a LEFT JOIN before b ON a.site = b.site AND a.product_id = b.product_id")
def refresh_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(_SPLIT + f"SELECT reason, count(*) AS products, count(*) FILTER (reason <> 'fresh') AS to_request FROM (SELECT {_REASON} AS reason FROM after a LEFT JOIN before b ON a.site = b.site AND a.product_id = b.product_id) GROUP BY reason")
def refresh_counts(spark, sf_dir):
    return changes.plan_counts(_plan(spark, sf_dir))


def _candidates(spark, sf_dir, limit):
    before, after = _split(spark, sf_dir)
    drop = ("ord", "image_url", "image_urls", "product_attributes")
    return changes.detail_candidates(after.drop(*drop), _state(before.drop(*drop)), F.lit(CUT).cast("timestamp"), 300, limit)


_FLAGS = _SPLIT + f""", flags AS (SELECT a.site, a.product_id, b.site IS NULL AS is_new, b.site IS NOT NULL AND (a.mrp, a.selling_price, a.discount_pct, a.in_stock) IS DISTINCT FROM (b.mrp, b.selling_price, b.discount_pct, b.in_stock) AS changed,
    coalesce(b.scraped_at < TIMESTAMP '{CUT}' - INTERVAL 300 DAY, FALSE) OR b.description = '' AS old FROM after a LEFT JOIN before b ON a.site = b.site AND a.product_id = b.product_id),
queue AS (SELECT *, is_new OR changed OR old AS needs, is_new OR changed AS urgent FROM flags),
placed AS (SELECT *, CASE WHEN needs THEN row_number() OVER (PARTITION BY site, needs ORDER BY urgent DESC, product_id) END AS nth FROM queue)
"""


@query(_FLAGS + "SELECT site, product_id, is_new, changed, needs AS needs_detail, urgent, coalesce(nth <= 100, FALSE) AS requested FROM placed")
def detail_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir, 100).select("site", "product_id", "is_new", "changed", "needs_detail", "urgent", F.coalesce("requested", F.lit(False)).alias("requested"))


@query(_FLAGS + """SELECT site, count(*) AS products_seen, count(*) FILTER (is_new) AS products_new, count(*) FILTER (changed) AS products_changed, count(*) FILTER (nth <= 100) AS details_refreshed,
  count(*) FILTER (needs AND nth > 100) AS deferred, greatest(0, count(*) - count(*) FILTER (is_new) - count(*) FILTER (changed)) AS products_unchanged FROM placed GROUP BY site""")
def run_counters(spark, sf_dir):
    return changes.run_counters(_candidates(spark, sf_dir, 100))


@query(_FLAGS + """, b AS (SELECT DISTINCT site, product_id FROM before), a AS (SELECT * FROM placed)
SELECT coalesce(a.site, b.site) AS site, coalesce(a.product_id, b.product_id) AS product_id, CASE WHEN a.site IS NULL AND b.site = 'site_1' THEN 1 ELSE 0 END AS missing_run_count,
  CASE WHEN a.site IS NULL THEN 'run-0' ELSE 'run-1' END AS last_seen_run_id, a.is_new IS TRUE AS first_seen_now, a.is_new IS TRUE OR a.changed IS TRUE AS changed_now
FROM a FULL JOIN b ON a.site = b.site AND a.product_id = b.product_id""")
def incremental_state(spark, sf_dir):
    before, after = _split(spark, sf_dir)
    rich = {"description_html": "string", "ingredients": "string", "how_to_use": "string", "key_ingredients": "array<string>"}
    blank = {c: F.lit(None).cast(k) for c, k in rich.items()}
    drop = ("ord", "image_url", "image_urls", "product_attributes")
    listing, stored = after.drop(*drop).withColumns(blank), _state(before.drop(*drop).withColumns(blank)).withColumn("first_seen_at", F.lit("1999-01-01").cast("timestamp"))
    now = F.lit(CUT).cast("timestamp")
    flags = changes.detail_candidates(listing, stored, now, 300)
    rows, points = changes.incremental_state(listing, listing.limit(0), stored, flags, now, "run-1")
    history = points.limit(0)
    table, _ = changes.incremental_sync(stored, history, rows, points, listing, "site_1", "run-1", now, True, 3)
    return table.select("site", "product_id", "missing_run_count", "last_seen_run_id", (F.col("first_seen_at") == now).alias("first_seen_now"), F.coalesce(F.col("last_changed_at") == now, F.lit(False)).alias("changed_now"))


# --- matching ----------------------------------------------------------------------------------


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What matching reads of the latest observations; what is only sold of a product isn't read with it."""
    return latest(spark, sf_dir).select(*matching.TITLED)


_ITEMS = """, it AS (SELECT site, product_id, regexp_replace(lower(brand), '[^a-z0-9]+', '', 'g') AS bkey, gtin, variant,
    CASE l_partkey % 5 WHEN 0 THEN 'sunscreen' WHEN 1 THEN 'serum' WHEN 2 THEN 'cleanser' ELSE '' END AS form,
    CASE l_partkey % 5 WHEN 0 THEN 'spf50' WHEN 1 THEN 'pct10' ELSE '' END AS strength, l_partkey % 5 = 2 AS bundle,
    list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(product_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ("""  + ", ".join(f"'{w}'" for w in titles.STOP_WORDS) + """)
      AND NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains(string_split(trim(regexp_replace(lower(brand), '[^a-z0-9]+', ' ', 'g')), ' '), w)))) AS tokens FROM latest),
pairs AS (SELECT l.site AS l_site, l.product_id AS l_id, r.site AS r_site, r.product_id AS r_id, l.gtin <> '' AND l.gtin = r.gtin AS sure, l.gtin <> '' AND r.gtin <> '' AND l.gtin <> r.gtin AS apart,
    len(list_intersect(l.tokens, r.tokens)) AS c, len(l.tokens) AS nl, len(r.tokens) AS nr, l.form AS lf, r.form AS rf, l.strength AS ls, r.strength AS rs, l.bundle AS lb, r.bundle AS rb, l.variant = r.variant AS same_size,
    abs(split_part(l.variant, ' ', 1)::DOUBLE - split_part(r.variant, ' ', 1)::DOUBLE) <= greatest(0.5, 0.02 * greatest(split_part(l.variant, ' ', 1)::DOUBLE, split_part(r.variant, ' ', 1)::DOUBLE)) AS close
  FROM it l JOIN it r ON l.bkey = r.bkey AND l.site < r.site),
edges AS (SELECT l_site, l_id, r_site, r_id, 'gtin' AS method, 1.0::DOUBLE AS confidence FROM pairs WHERE sure UNION ALL
  SELECT l_site, l_id, r_site, r_id, 'name', least(1.0, 0.65 * (c::DOUBLE / least(nl, nr)) + 0.35 * (c::DOUBLE / (nl + nr - c)) + 0.10 + CASE WHEN lf <> '' AND rf <> '' THEN 0.05 ELSE 0.0 END)
  FROM pairs WHERE NOT sure AND NOT apart AND c >= 2 AND NOT (lf <> '' AND rf <> '' AND lf <> rf) AND NOT (ls <> '' AND rs <> '' AND ls <> rs) AND lb = rb AND close)
"""


@query(_ITEMS + "SELECT l_site, l_id, r_site, r_id, method, round(confidence, 6) AS confidence FROM edges WHERE confidence >= 0.7")
def match_edges(spark, sf_dir):
    edges = matching.score_edges(stored(matching.prepare(titled(spark, sf_dir), SITES)), orders=False)
    return edges.select("l_site", F.col("left.product_id").alias("l_id"), "r_site", F.col("right.product_id").alias("r_id"), "method", F.round("confidence", 6).alias("confidence"))


@query(_ITEMS + "SELECT l_site, l_id, r_site, max(round(confidence, 6)) AS confidence, count(*) AS one FROM (SELECT * FROM edges WHERE confidence >= 0.7 QUALIFY row_number() OVER (PARTITION BY l_site, l_id, r_site ORDER BY confidence DESC) = 1) GROUP BY ALL")
def match_best_per_site(spark, sf_dir):
    best = matching.best_edges(stored(matching.prepare(titled(spark, sf_dir), SITES)))
    return best.select("l_site", F.col("left.product_id").alias("l_id"), "r_site", F.round("confidence", 6).alias("confidence"), F.lit(1).cast("long").alias("one"))


# --- barcodes ----------------------------------------------------------------------------------


@query("SELECT site, product_id, ean AS gtin FROM latest WHERE gtin = ''")
def gtin_backfill(spark, sf_dir):
    return barcodes.backfill(latest(spark, sf_dir))


@query("SELECT site, count(*) AS stored, count(*) FILTER (gtin <> '') AS with_gtin, count(*) FILTER (gtin = '') AS targeted, round((count(*) FILTER (gtin <> ''))::DECIMAL(18, 4) * 100 / count(*), 2)::DOUBLE AS coverage_pct FROM latest GROUP BY site")
def gtin_coverage(spark, sf_dir):
    return barcodes.coverage(latest(spark, sf_dir))


@query("SELECT site, product_id, CASE WHEN gtin = '' THEN ean ELSE gtin END AS gtin FROM latest")
def gtin_patch(spark, sf_dir):
    rows = latest(spark, sf_dir)
    return catalogue.patch(rows, barcodes.backfill(rows), "gtin").select("site", "product_id", "gtin")


# --- dimensions --------------------------------------------------------------------------------

_BRANDS = "('Small'), ('Small Ring'), ('Red'), ('Large-Box'), ('blue')"


def _brands(spark):
    return spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in ("Small", "Small Ring", "Red", "Large-Box", "blue")])).alias("brand"))


@query(f"""WITH b AS (SELECT brand, regexp_replace(lower(brand), '[^a-z0-9]+', '', 'g') AS key FROM (VALUES {_BRANDS}) t(brand)),
h AS (SELECT p_partkey, n, array_to_string(string_split(p_name || ' x' || p_size, ' ')[1:n], '') AS key FROM part, range(1, 7) r(n) WHERE n <= len(string_split(p_name || ' x' || p_size, ' ')))
SELECT p.p_partkey AS id, coalesce((SELECT max(struct_pack(n := h.n, brand := b.brand)).brand FROM h JOIN b USING (key) WHERE h.p_partkey = p.p_partkey), '') AS brand FROM part p""", with_obs=False)
def brand_prefix_match(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.replace(F.concat("p_name", F.lit(" x"), F.col("p_size").cast("string")), F.lit(" "), F.lit("-")).alias("slug"))
    return dims.brand_by_slug(rows, _brands(spark)).select("id", "brand")


@query(f"""WITH b AS (SELECT brand, regexp_replace(lower(brand), '[^a-z0-9]+', '', 'g') AS key FROM (VALUES {_BRANDS}) t(brand))
SELECT p_partkey AS id, coalesce((SELECT max(struct_pack(n := length(key), brand := brand)).brand FROM b WHERE starts_with(regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g'), key)), '') AS brand FROM part""", with_obs=False)
def brand_title_match(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return dims.brand_by_title(rows, _brands(spark)).select("id", "brand")


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower(text), 'license') THEN 'Licensed' END, CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'clown') THEN 'Rude' END, CASE WHEN contains(lower(text), 'ation') THEN 'Nouns' END], lambda x: x IS NOT NULL), ',') AS categories FROM documents""", with_obs=False)
def category_infer(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    dim = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("name"), F.lit(q).alias("query")) for i, (n, q) in enumerate((("Licensed", "face license"), ("Rude", "idiot clown skin"), ("Nouns", "ation of")))])).alias("c")).select("c.*")
    return dims.infer_categories(docs, dim, ["text"]).select("doc_id", F.array_join("categories", ",").alias("categories"))


@query("SELECT p_partkey, CASE WHEN p_retailprice < 950 THEN 0 WHEN p_retailprice < 1000 THEN 1 WHEN p_retailprice < 1050 THEN 2 ELSE 3 END AS band FROM part", with_obs=False)
def price_bands(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", dims.price_band(F.col("p_retailprice"), [950, 1000, 1050]).alias("band"))


@query("""WITH RECURSIVE edges AS (SELECT p_partkey AS id, p_partkey + p_size AS variant FROM part WHERE p_size % 5 = 1 AND p_partkey + p_size IN (SELECT p_partkey FROM part)),
reach(id, parent) AS (SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 10 = 0 UNION SELECT e.variant, r.parent FROM reach r JOIN edges e ON e.id = r.id)
SELECT id, min(parent) AS parent, string_agg(DISTINCT 'b' || (parent % 3)::VARCHAR, ',' ORDER BY 'b' || (parent % 3)::VARCHAR) AS labels FROM reach GROUP BY id""", with_obs=False)
def variant_families(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    edges = p.where("p_size % 5 = 1").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") + F.col("p_size")).alias("variant"))
    edges = edges.join(p.select(F.col("p_partkey").alias("variant")), "variant", "left_semi").select("id", "variant")
    roots = p.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.array(F.concat(F.lit("b"), (F.col("p_partkey") % 3).cast("string"))).alias("labels"))
    return dims.variant_families(edges, roots).select("id", "parent", F.array_join("labels", ",").alias("labels"))


# --- health ------------------------------------------------------------------------------------


@query("SELECT count(*) AS products, count(DISTINCT brand) AS brands, round(avg(discount_pct)::DECIMAL(18, 6), 2)::DOUBLE AS mean_discount, round((avg(in_stock::INT) * 100)::DECIMAL(18, 6), 2)::DOUBLE AS in_stock_pct FROM latest")
def kpi_summary(spark, sf_dir):
    return health.kpis(latest(spark, sf_dir))


@query("SELECT brand, count(*) AS products FROM latest GROUP BY brand")
def brand_counts(spark, sf_dir):
    return health.brand_counts(latest(spark, sf_dir))


@query("SELECT DISTINCT category AS categories FROM latest")
def category_options(spark, sf_dir):
    return health.options(latest(spark, sf_dir), "categories")


@query("SELECT site, product_id FROM latest WHERE category IN ('ECONOMY', 'SMALL') AND brand IN ('Brand#1', 'Brand#2', 'BRAND#3')")
def overlap_filter(spark, sf_dir):
    return health.filtered_view(latest(spark, sf_dir), ["ECONOMY", "SMALL"], ["Brand#1", "Brand#2", "BRAND#3"]).select("site", "product_id")


@query("SELECT site, count(*) AS collected, count(*) FILTER (gtin <> '') AS with_gtin FROM latest GROUP BY site")
def storefront_totals(spark, sf_dir):
    return health.storefront_totals(latest(spark, sf_dir))


_RUN_SITES = tuple(f"site_{i}" for i in range(9))


def _runs(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "failed").otherwise("success")
    return o.select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("id"), F.concat(F.lit("site_"), (F.col("o_custkey") % 7).cast("string")).alias("site"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.col("o_totalprice").cast("int").alias("products_seen"), F.lit("").alias("message"))


@query("""WITH now AS (SELECT max(o_orderdate) AS t FROM orders), runs AS (SELECT o_orderkey, 'site_' || (o_custkey % 7) AS site, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'failed' ELSE 'success' END AS status, o_orderdate FROM orders),
last AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY site ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
f AS (SELECT s.site, CASE WHEN l.site IS NULL THEN 'never ran' WHEN status = 'running' AND date_diff('hour', o_orderdate, t) > 8 THEN 'stuck' WHEN status = 'failed' THEN 'failed' WHEN date_diff('hour', o_orderdate, t) > 30 THEN 'late' ELSE 'ok' END AS finding, status
  FROM (SELECT 'site_' || i AS site FROM range(9) r(i)) s LEFT JOIN last l USING (site), now)
SELECT site, CASE WHEN finding = 'ok' THEN 'ok' ELSE 'alert' END AS level, finding, status FROM f""", with_obs=False)
def run_health(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    now = F.lit(runs.agg(F.max("started_at")).first()[0])
    return health.run_health(runs, _RUN_SITES, now).select("site", "level", "finding", "status")


@query("""WITH e AS (SELECT 'site_' || (user_id % 7) AS site, ts FROM events), now AS (SELECT max(ts) AS t FROM events), n AS (SELECT site, max(ts) AS newest FROM e GROUP BY site)
SELECT s.site, CASE WHEN newest IS NULL OR epoch(t) - epoch(newest) > 30 * 3600 THEN 'alert' ELSE 'ok' END AS level, strftime(newest, '%Y-%m-%d') AS newest FROM (SELECT 'site_' || i AS site FROM range(9) r(i)) s LEFT JOIN n USING (site), now""", with_obs=False)
def data_freshness(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    now = F.lit(_table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0])
    rows = e.select(F.concat(F.lit("site_"), (F.col("user_id") % 7).cast("string")).alias("site"), F.col("ts").cast("timestamp").alias("scraped_at"))
    return health.data_freshness(rows, _RUN_SITES, now).select("site", "level", F.date_format("newest", "yyyy-MM-dd").alias("newest"))


@query("""WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page_no, event_type AS ids, event_type = 'error' AND value > 60 AS failed FROM events),
c AS (SELECT *, ids IS DISTINCT FROM lag(ids) OVER w AS change FROM p WINDOW w AS (PARTITION BY user_id ORDER BY page_no)),
r AS (SELECT *, sum(change::INT) OVER (PARTITION BY user_id ORDER BY page_no) AS run FROM c),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY page_no) - 1 AS streak FROM r),
f AS (SELECT *, CASE WHEN failed THEN 'request_failed' WHEN streak >= 2 THEN 'repeated_pages' END AS reason FROM s),
g AS (SELECT user_id, count(*) AS pages, max(page_no) AS last_page, min(struct_pack(page_no, reason)) FILTER (reason IS NOT NULL) AS stop FROM f GROUP BY user_id)
SELECT user_id, pages, CASE WHEN stop.reason = 'request_failed' THEN stop.page_no ELSE coalesce(stop.page_no, last_page) + 1 END AS next_page, coalesce(stop.reason = 'repeated_pages', FALSE) AS completed, coalesce(stop.reason, 'open') AS stop_reason FROM g""", with_obs=False)
def sweep_audit(spark, sf_dir):
    from pyspark.sql import Window

    e = _table(spark, sf_dir, "events")
    pages = e.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("page_no"), F.array("event_type").alias("ids"), ((F.col("event_type") == "error") & (F.col("value") > 60)).alias("failed"), F.lit(False).alias("reported_end"))
    return health.sweep_audit(pages, ["user_id"])


# --- imports -----------------------------------------------------------------------------------


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey // 2 AS line, c_custkey % 2 AS file, CASE WHEN c_custkey % 10 = 7 THEN c_custkey - 1 ELSE c_custkey END AS named FROM customer),
s AS (SELECT k, line, file, 'Brand ' || (named % 50) AS brand, n.c_name AS product_name, CASE WHEN k % 10 IN (4, 5) THEN 'D' || (k - k % 2) WHEN k % 10 = 7 THEN 'E' || k WHEN k % 3 = 0 THEN 'S' || k ELSE '' END AS sku FROM c JOIN customer n ON n.c_custkey = c.named),
i AS (SELECT *, CASE WHEN sku <> '' THEN sku ELSE substr('manual-' || regexp_replace(lower(brand), '[^a-z0-9]+', '', 'g') || '-' || replace(trim(regexp_replace(lower(product_name), '[^a-z0-9]+', ' ', 'g')), ' ', '-'), 1, 120) END AS product_id,
  sku LIKE 'S%' AND k IN (SELECT s_suppkey FROM supplier) AS known FROM s)
SELECT a.file::INTEGER AS file, a.line, a.product_id, CASE WHEN a.known THEN 'product_id already stored' WHEN a.k % 10 = 5 THEN 'duplicate product_id in the sheet' WHEN a.k % 10 = 7 AND NOT b.known THEN 'duplicate brand and name in the sheet' END AS outcome
FROM i a LEFT JOIN i b ON b.k = a.k - 1""", with_obs=False)
def import_select_new(spark, sf_dir):
    c, s = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "supplier")
    names, key = c.select(F.col("c_custkey").alias("named"), F.col("c_name").alias("Title")), F.col("c_custkey")
    sku = F.when((key % 10).isin(4, 5), F.concat(F.lit("D"), (key - key % 2).cast("string"))).when(key % 10 == 7, F.concat(F.lit("E"), key.cast("string"))).when(key % 3 == 0, F.concat(F.lit("S"), key.cast("string"))).otherwise("")
    rows = c.select(F.floor(key / 2).alias("line"), (key % 2).cast("int").alias("file"), F.when(key % 10 == 7, key - 1).otherwise(key).alias("named"), sku.alias("Variant SKU")).join(names, "named")
    sheet = rows.select("file", "line", F.concat(F.lit("Brand "), (F.col("named") % 50).cast("string")).alias("Vendor"), "Title", "Variant SKU")
    stored = s.select(F.lit("manual").alias("site"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("product_id"), F.lit("Other").alias("brand"), F.col("s_name").alias("product_name"))
    _, outcomes = imports.import_sheet(sheet, stored, "manual")
    return outcomes.select("file", "line", "product_id", "outcome")
