"""Registered queries over payloads: pages, and feeds that Spark builds from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions import markup, titles, values
from shelfwise.normalize import payloads
from shelfwise.plans.catalogue_queries import _table, query


@query("""WITH t AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<![a-z][^>]*>', '', 'g') AS m FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(m, '(?i)</?(address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)(\\s[^>]*)?/?>', chr(1), 'g'), '</?[A-Za-z][^>]*>', '', 'g') AS m FROM t),
d AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g') AS m FROM b)
SELECT page_id, array_to_string(list_filter(list_transform(string_split(m, chr(1)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM d""", with_obs=False)
def page_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", markup.html_to_text("html").alias("text"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages", with_obs=False)
def page_title(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", markup.page_title(F.col("html")).alias("title"))


@query("""SELECT page_id, array_to_string(l, ' ') AS links, len(l)::INT AS n FROM (SELECT page_id, list_distinct(regexp_extract_all(html, '<a\\b[^>]*?\\bhref="([^"\\s>]+)', 1)) AS l0, regexp_extract_all(html, '<a\\b[^>]*?\\bhref="([^"\\s>]+)', 1) AS a,
  list_filter(a, lambda x, i: list_position(a, x) = i) AS l FROM pages)""", with_obs=False)
def page_links(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", markup.page_links(F.col("html")).alias("l")).select("page_id", F.array_join("l", " ").alias("links"), F.size("l").alias("n"))


@query("""SELECT p_partkey::VARCHAR || '-' || k AS product_id, p_partkey::VARCHAR AS parent_product_id, p_brand AS brand, p_name AS product_name, CASE k WHEN 0 THEN '' ELSE p_size || ' ml' END AS variant,
  CASE WHEN k = 0 AND p_partkey % 2 = 0 THEN p_retailprice + 100 END AS mrp, p_retailprice AS selling_price, CASE WHEN k = 0 AND p_partkey % 2 = 0 THEN round(100 / (p_retailprice + 100) * 100, 2) END AS discount_pct,
  k = 0 AS in_stock, p_name || E'\\n' || p_type || ' & co' AS description FROM part, range(2) r(k)""", with_obs=False)
def normalize_feed(spark, sf_dir):
    p, key = _table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    variant = lambda k, title, compare, available: F.struct(F.concat(key, F.lit(f"-{k}")).alias("id"), title.alias("title"), F.lit("NOT-A-CODE").alias("sku"), F.col("p_retailprice").cast("string").alias("price"), compare.cast("string").alias("compare_at_price"), F.lit(available).alias("available"))
    compare = F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice") + 100).otherwise(F.col("p_retailprice") - 100)
    product = F.struct(key.alias("id"), F.concat(F.lit("h"), key).alias("handle"), F.col("p_name").alias("title"), F.col("p_brand").alias("vendor"), F.lit("").alias("product_type"), F.concat(F.lit("<p>"), "p_name", F.lit("</p><p> <b>"), "p_type", F.lit("</b> &amp;  co</p>")).alias("body_html"), F.array(variant(0, F.lit("Default Title"), compare, True), variant(1, F.concat(F.col("p_size").cast("string"), F.lit(" ml")), F.lit(None).cast("double"), False)).alias("variants"))
    bronze = p.select(F.lit("shop").alias("site"), F.lit("").alias("url"), F.lit(None).cast("timestamp").alias("fetched_at"), F.lit(1).alias("page_no"), F.lit("").alias("category"), F.to_json(F.struct(F.array(product).alias("products"))).alias("body"))
    return payloads.shop_feed(bronze, "https://shop.example.com").select("product_id", "parent_product_id", "brand", "product_name", "variant", "mrp", "selling_price", "discount_pct", "in_stock", "description")


@query("""SELECT l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_discount >= 0.05 THEN l_extendedprice END AS mrp, l_extendedprice - 100 AS price, l_discount < 0.05 AS unit FROM lineitem""", with_obs=False)
def price_cleanup(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem")
    mrp = F.when(F.col("l_discount") < 0.05, F.col("l_extendedprice") - 150).otherwise(F.col("l_extendedprice"))
    note = F.when(F.col("l_discount") < 0.05, "₹12 / 100 ml").otherwise("₹12")
    p = values.clean_prices(mrp, F.col("l_extendedprice") - 100)
    return t.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), p["mrp"].alias("mrp"), p["selling_price"].alias("price"), values.is_unit_price(note).alias("unit"))


# --- payloads that Spark builds from the tables ------------------------------------------------

SHOP = "https://shop.example.com"


def _bronze(rows, body, url=None, category=None):
    return rows.select(F.lit("shop").alias("site"), (url if url is not None else F.lit("")).alias("url"), F.lit(None).cast("timestamp").alias("fetched_at"), F.lit(1).alias("page_no"), (category if category is not None else F.lit("")).alias("category"), body.alias("body"))


def _parts(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    body = F.concat(F.lit("890"), F.lpad(key.cast("string"), 9, "0"))
    total = sum((F.substring(body, i, 1).cast("int") * (3 if i % 2 == 0 else 1) for i in range(1, 13)), F.lit(0))
    return p.withColumns({"key": key.cast("string"), "k": key, "r": F.col("p_retailprice"), "ean": F.concat(body, ((10 - total % 10) % 10).cast("string"))})


def _spread(parts):
    """Parts in as many tasks as shuffles have: a page of one is many times as costly as its row, and the rows of a small file
    are few tasks, if not one."""
    spark = parts.sparkSession
    return parts.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "p_partkey")


_PARTS = """WITH b AS (SELECT *, '890' || lpad(p_partkey::VARCHAR, 9, '0') AS body FROM part),
p AS (SELECT *, p_partkey::VARCHAR AS key, p_partkey AS k, p_retailprice AS r,
  body || ((10 - (SELECT sum(substr(body, i::INT, 1)::INT * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END) FROM range(1, 13) r(i)) % 10) % 10)::BIGINT::VARCHAR AS ean FROM b)
"""


def _listing_pages(spark, sf_dir):
    p = _parts(spark, sf_dir)
    one = F.struct(F.concat("key", F.lit("-a")).alias("skuId"), F.concat(F.col("p_size").cast("string"), F.lit(" ml")).alias("size"), F.concat(F.lit("Rs "), (F.col("r") + 100).cast("string")).alias("mrp"), F.col("r").cast("string").alias("sellingPrice"), F.lit("yes").alias("inStock"), F.lit(None).cast("string").alias("outOfStock"))
    two = F.struct(F.concat("key", F.lit("-b")).alias("skuId"), F.lit("").alias("size"), F.lit(None).cast("string").alias("mrp"), F.col("r").cast("string").alias("sellingPrice"), F.lit(None).cast("string").alias("inStock"), F.lit("true").alias("outOfStock"))
    record = F.struct(F.col("key").alias("productId"), F.when(F.col("k") % 7 != 0, F.col("p_name")).alias("productName"), F.col("p_brand").alias("brandName"), F.concat(F.lit("p/"), "key").alias("dynamicUrl"), F.concat(F.lit("//img.example.com/"), "key", F.lit(".jpg")).alias("imageUrl"), F.lit("4.5 stars").alias("rating"), F.lit("1,234").alias("ratingCount"), F.when(F.col("k") % 5 == 0, "banner").otherwise("product").alias("objectType"), F.array(one, two).alias("variants"))
    pages = p.groupBy((F.col("k") / 20).cast("int").alias("page")).agg(F.collect_list(record).alias("products"))
    return _bronze(pages, F.to_json(F.struct(F.struct("products").alias("response"))), category=F.lit("Care"))


@query(_PARTS + """SELECT key || v AS product_id, key AS parent_product_id, p_brand AS brand, p_name AS product_name, CASE v WHEN '-a' THEN p_size || ' ml' ELSE '' END AS variant, 'Care' AS categories,
  CASE v WHEN '-a' THEN r + 100 END AS mrp, r AS selling_price, CASE v WHEN '-a' THEN round(((r + 100) - r) / (r + 100) * 100, 2) END AS discount_pct, 4.5::DOUBLE AS rating, 1234::BIGINT AS rating_count, v = '-a' AS in_stock,
  'https://shop.example.com/p/' || key AS product_url, 'https://img.example.com/' || key || '.jpg' AS image_url
FROM p, (VALUES ('-a'), ('-b')) t(v) WHERE k % 7 <> 0 AND k % 5 <> 0 AND regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') IN ('brand1', 'brand2', 'brand11', 'brand12', 'brand3')""", with_obs=False)
def listing_pages(spark, sf_dir):
    rows, _ = payloads.json_listing(_listing_pages(spark, sf_dir), SHOP, ("BRAND 1", "Brand#2", "brand-11", "Brand 12", "brand3"))
    return rows.select("product_id", "parent_product_id", "brand", "product_name", "variant", F.array_join("categories", ",").alias("categories"), "mrp", "selling_price", "discount_pct", "rating", "rating_count", "in_stock", "product_url", "image_url")


@query(_PARTS + "SELECT key AS id, 'no id or no name' AS reason FROM p WHERE k % 7 = 0 AND k % 5 <> 0", with_obs=False)
def listing_rejects(spark, sf_dir):
    _, rejected = payloads.json_listing(_listing_pages(spark, sf_dir), SHOP)
    return rejected.select(F.get_json_object("r", "$.productId").alias("id"), "reason")


@query(_PARTS + """SELECT CASE WHEN n = 1 THEN key WHEN i = 0 THEN key || '-1' ELSE key || '-2' END AS product_id, key AS parent_product_id, CASE WHEN n = 1 THEN 'S' || key WHEN i = 0 THEN 'O1' ELSE 'S' || key END AS sku,
  CASE WHEN n = 1 THEN ean WHEN i = 0 THEN ean ELSE '' END AS gtin, p_brand AS brand, p_name AS product_name, CASE WHEN n = 1 THEN '' WHEN i = 0 THEN '10 ml' ELSE '20 ml' END AS variant,
  CASE WHEN n = 2 AND i = 0 THEN r + 50 ELSE NULL END AS mrp, r AS selling_price, CASE WHEN n = 1 THEN 'unknown' WHEN i = 0 THEN 'true' ELSE 'false' END AS in_stock, 'Name ' || p_name || E'\\nType & co' AS description, '4.1' AS rating, 3 AS breakdown, 5 AS first_stars,
  2 AS reviews, 'fine' AS review, TRUE AS bought, 'Zinc, Aloe' AS key_ingredients, CASE WHEN n = 2 AND i = 0 THEN 'https://img.example.com/o.jpg' ELSE 'https://img.example.com/r.jpg' END AS image
FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS n FROM p) q, range(2) t(i) WHERE i < n""", with_obs=False)
def detail_pages(spark, sf_dir):
    p = _spread(_parts(spark, sf_dir))
    null = F.lit(None).cast("string")
    pictures = lambda name: F.array(F.struct(F.lit(f"https://img.example.com/{name}.jpg").alias("url"), F.lit("image").alias("type")))
    one = F.struct(F.concat("key", F.lit("-1")).alias("id"), F.lit("O1").alias("sku"), F.col("ean").alias("gtin"), F.lit("10 ml").alias("pack_size"), (F.col("r") + 50).cast("string").alias("price"), F.col("r").cast("string").alias("final_price"), F.lit("true").alias("gludo_stock"), pictures("o").alias("carousel"))
    two = F.struct(F.concat("key", F.lit("-2")).alias("id"), null.alias("sku"), F.lit("123").alias("gtin"), F.lit("20 ml").alias("pack_size"), null.alias("price"), F.col("r").cast("string").alias("final_price"), F.lit("no").alias("gludo_stock"), F.lit(None).cast(p.select(pictures("o")).schema[0].dataType).alias("carousel"))
    review = lambda i: F.struct(F.lit(f"r{i}").alias("review_id"), F.lit("t").alias("title"), F.lit("fine").alias("detail"), F.lit("ann").alias("nickname"), F.lit("yes").alias("is_buyer"), F.lit("3").alias("likes"), F.lit("4").alias("rating"))
    stars = F.array(*[F.struct(F.lit(str(i)).alias("id"), F.lit("1,0").alias("count"), F.lit("20").alias("per")) for i in (5, 4, 3)])
    body = F.struct(F.col("key").alias("id"), F.concat(F.lit("S"), "key").alias("sku"), F.col("ean").alias("gtin"), F.col("p_brand").alias("brand_name"), F.col("p_name").alias("name"), F.col("r").cast("string").alias("final_price"), F.lit("4.1 of 5").alias("rating"), F.concat(F.lit("<p>Name <b>"), "p_name", F.lit("</b></p><script>x</script><p>Type &amp;  co</p>")).alias("description"),
                    F.lit("<h3>Key ingredients</h3><ul><li><b>Zinc</b>: calms</li><li><b>Aloe</b>: cools</li></ul>").alias("ingredients"), stars.alias("review_splitup"), F.array(review(1), review(2)).alias("top_review"), pictures("r").alias("carousel"), F.when(F.col("k") % 2 == 0, F.array(one, two)).alias("options"))
    out = payloads.json_detail(_bronze(p, F.to_json(body)), SHOP)
    return out.select("product_id", "parent_product_id", "sku", "gtin", "brand", "product_name", "variant", "mrp", "selling_price", F.coalesce(F.col("in_stock").cast("string"), F.lit("unknown")).alias("in_stock"), "description", F.col("rating").cast("string").alias("rating"), F.size("rating_breakdown").alias("breakdown"), F.get("rating_breakdown", F.lit(0))["stars"].alias("first_stars"),
                      F.size("top_reviews").alias("reviews"), F.get("top_reviews", F.lit(1))["review"].alias("review"), F.get("top_reviews", F.lit(0))["verified_buyer"].alias("bought"), F.array_join("key_ingredients", ", ").alias("key_ingredients"), F.col("image_url").alias("image"))


def _variant_pages(spark, sf_dir):
    p = _spread(_parts(spark, sf_dir))
    uid = F.col("k") * 10 + 5
    item = lambda i: F.struct((uid + i).cast("string").alias("uid"), F.concat("p_name", F.lit(f" {i}")).alias("name"), F.concat(F.lit("s"), "key", F.lit(f"v{i}")).alias("slug"), F.lit(f"{10 + i} g").alias("value"))
    attributes = F.struct(F.struct(F.array("ean").alias("ean"), F.array(F.concat(F.lit("K"), "key")).alias("sku_code")).alias("identifier"), F.lit("10 g").alias("pack-size"), F.array(F.lit("Zinc"), F.lit("Aloe"), F.lit("Zinc")).alias("super-ingredients"), F.lit("Vegan").alias("preference"), F.lit("<p>Text</p><h2>Ingredients</h2><p>Water</p><h2>How to use</h2><p>Rub</p>").alias("description"))
    amount = lambda c: F.struct(F.struct(c.cast("string").alias("min")).alias("marked"), F.struct(F.col("r").cast("string").alias("min")).alias("effective"))
    record = F.struct(uid.cast("string").alias("uid"), F.col("p_name").alias("name"), F.concat(F.lit("s"), "key").alias("slug"), F.struct(F.col("p_brand").alias("name")).alias("brand"), amount(F.col("r") + 50).alias("price"), F.lit("true").alias("sellable"), attributes.alias("attributes"), F.array(F.struct(F.array(item(-1), item(1), item(1)).alias("items"))).alias("variants"))
    return _bronze(p, F.to_json(F.struct(F.array(record).alias("items"))), category=F.lit("Care"))


@query(_PARTS + """SELECT (k * 10 + 5 + i)::VARCHAR AS product_id, (k * 10 + 4)::VARCHAR AS parent_product_id, CASE i WHEN 0 THEN 'K' || key ELSE '' END AS sku, CASE i WHEN 0 THEN ean ELSE '' END AS gtin, p_brand AS brand, p_name || CASE i WHEN 0 THEN '' ELSE ' ' || i END AS product_name,
  (10 + i) || ' g' AS variant, CASE i WHEN 0 THEN r + 50 END AS mrp, CASE i WHEN 0 THEN r END AS selling_price, CASE i WHEN 0 THEN 'true' ELSE 'unknown' END AS in_stock, 'https://shop.example.com/product/s' || key || CASE i WHEN 0 THEN '' ELSE 'v' || i END AS product_url, 'Water' AS ingredients, 'Rub' AS how_to_use, 'Zinc,Aloe' AS key_ingredients, 'Vegan' AS special_features
FROM p, (VALUES (-1), (0), (1)) t(i)""", with_obs=False)
def variant_pages(spark, sf_dir):
    rows = payloads.variant_listing(_variant_pages(spark, sf_dir), SHOP)
    return rows.select("product_id", "parent_product_id", "sku", "gtin", "brand", "product_name", "variant", "mrp", "selling_price", F.coalesce(F.col("in_stock").cast("string"), F.lit("unknown")).alias("in_stock"), "product_url", "ingredients", "how_to_use", F.array_join("key_ingredients", ",").alias("key_ingredients"), F.array_join("special_features", ",").alias("special_features"))


@query(_PARTS + """SELECT (k * 10 + 5 + i)::VARCHAR AS product_id, CASE WHEN i = 0 THEN r + 50 WHEN i = 1 THEN r + 9 END AS mrp, CASE WHEN i = 0 THEN r WHEN i = 1 THEN r + 8 END AS selling_price FROM p, (VALUES (-1), (0), (1)) t(i)""", with_obs=False)
def variant_prices(spark, sf_dir):
    p = _parts(spark, sf_dir)
    size = lambda on, a, b: F.struct(F.lit(on).alias("is_available"), F.struct(a.cast("string").alias("marked"), b.cast("string").alias("effective")).alias("price"))
    found = p.select(F.concat(F.lit("s"), "key", F.lit("v1")).alias("slug"), F.to_json(F.struct(F.array(size("false", F.col("r"), F.col("r")), size("true", F.col("r") + 9, F.col("r") + 8)).alias("sizes"))).alias("body"))
    rows = payloads.variant_listing(_variant_pages(spark, sf_dir), SHOP)
    return payloads.merge_variant_prices(rows, found, markup.last_segment(F.col("product_url"))).select("product_id", "mrp", "selling_price")


def _product_pages(spark, sf_dir):
    p = _spread(_parts(spark, sf_dir))
    node = F.struct(F.when(F.col("k") % 3 == 0, "https://schema.org/Product").otherwise("Product").alias("@type"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("name")).alias("brand"), F.concat(F.lit("<p>"), "p_type", F.lit("</p>")).alias("description"), F.concat(F.lit("PPLB"), "ean").alias("sku"), F.array(F.concat(F.lit("https://img.example.com/"), "ean", F.lit("_1.jpg"))).alias("image"),
                    F.array(F.struct(F.when(F.col("k") % 2 == 0, "0").otherwise(F.col("r").cast("string")).alias("price"), F.lit("https://schema.org/InStock").alias("availability"))).alias("offers"), F.struct(F.lit("4.2").alias("ratingValue"), F.lit("17").alias("ratingCount")).alias("aggregateRating"))
    graph = F.when(F.col("k") % 4 == 0, F.to_json(F.struct(F.array(node).alias("@graph")))).otherwise(F.to_json(node))
    body = F.concat(F.lit('<script type="application/ld+json">{bad</script><script type="application/ld+json">'), graph, F.lit('</script><script>var s = {mrp: "'), (F.col("r") + 200).cast("string"), F.lit('", our_price: '), (F.col("r") + 1).cast("string"), F.lit(', mrp: 1, l1_category_name: "Care", l2_category_name: "Skin"}</script>'))
    return _bronze(p, body, F.concat(F.lit("https://shop.example.com/product/"), "key", F.lit("?x=1")))


@query(_PARTS + """SELECT key AS product_id, p_brand AS brand, p_name AS product_name, r + 200 AS mrp, CASE WHEN k % 2 = 0 THEN r + 1 ELSE r END AS selling_price, ean AS gtin, 'Care,Skin' AS categories, TRUE AS in_stock, 4.2::DOUBLE AS rating, 17::BIGINT AS rating_count, p_type AS description FROM p""", with_obs=False)
def product_pages(spark, sf_dir):
    rows = payloads.linked_data_pages(_product_pages(spark, sf_dir))
    return rows.select("product_id", "brand", "product_name", "mrp", "selling_price", "gtin", F.array_join("categories", ",").alias("categories"), "in_stock", "rating", "rating_count", "description")


@query(_PARTS + "SELECT key AS product_id, CASE WHEN k % 2 = 1 THEN r END AS selling_price, ean AS gtin, 0 AS categories FROM p", with_obs=False)
def image_coded_pages(spark, sf_dir):
    rows = payloads.linked_data_pages(_product_pages(spark, sf_dir), page_state=False)
    return rows.select("product_id", "selling_price", "gtin", F.size("categories").alias("categories"))


@query(_PARTS + """SELECT key AS product_id, p_brand AS brand, 'Name ' || p_name AS product_name, 599.0::DOUBLE AS mrp, 420.0::DOUBLE AS selling_price, 30.0::DOUBLE AS discount_pct, 4.1::DOUBLE AS rating, 14900::BIGINT AS rating_count, k % 2 = 0 AS in_stock,
  'Water, zinc' AS ingredients, 'Rub in.' AS how_to_use, 'Zinc,Aloe vera' AS key_ingredients, 'soft,mild' AS key_features, CASE WHEN k % 3 = 0 THEN '' ELSE ean END AS gtin, 'https://img.example.com/' || key || '.jpg' AS image_url FROM p""", with_obs=False)
def attribute_records(spark, sf_dir):
    p = _parts(spark, sf_dir)
    details = F.concat(F.when(F.col("k") % 3 == 0, "EAN: 123").when(F.col("k") % 3 == 1, F.concat(F.lit("UPC\t"), "ean")).otherwise(F.concat(F.lit("Item model number: "), "ean")), F.lit("\nActive Ingredients: Zinc; Aloe vera, x"))
    texts = {"title": F.concat(F.lit("Name \n "), "p_name"), "brand": F.concat(F.lit("Visit the "), "p_brand", F.lit(" Store")), "price": F.lit("-30% ₹42000 M.R.P.: ₹59900"), "details": details, "important": F.lit("Ingredients: Water, zinc Directions: Rub in. Legal disclaimer none"), "rating": F.lit("4.1 out of 5"),
             "rating_count": F.lit("14.9K ratings"), "about": F.lit("soft\n mild \nsoft"), "availability": F.when(F.col("k") % 2 == 0, "In stock").otherwise("Currently unavailable"), "image": F.concat(F.lit("https://img.example.com/"), "key", F.lit("._SX38_.jpg"))}
    rows = p.select(F.lit("market").alias("site"), F.col("key").alias("code"), F.lit(None).cast("timestamp").alias("fetched_at"), F.create_map(*[x for name, value in texts.items() for x in (F.lit(name), value)]).alias("sections"))
    out = payloads.attribute_pages(rows)
    return out.select("product_id", "brand", "product_name", "mrp", "selling_price", "discount_pct", "rating", "rating_count", "in_stock", "ingredients", "how_to_use", F.array_join("key_ingredients", ",").alias("key_ingredients"), F.array_join("key_features", ",").alias("key_features"), "gtin", "image_url")


@query(_PARTS + "SELECT DISTINCT 'https://shop.example.com/product/' || (k // 2) AS url FROM p", with_obs=False)
def sitemap_pages(spark, sf_dir):
    from shelfwise.sources.readers import sitemap_urls

    at = F.concat(F.lit("https://shop.example.com/product/"), F.floor(F.col("k") / 2).cast("string"))
    pages = _parts(spark, sf_dir).select(F.concat(F.lit("<urlset><url><loc> "), at, F.lit(" </loc></url><url><loc>"), at, F.lit("?a=1</loc></url><url><loc>"), at, F.lit("/reviews</loc></url><loc>https://shop.example.com/about</loc></urlset>")).alias("body"))
    return sitemap_urls(pages, r"^https://shop\.example\.com/product/[^/?#]+$")


# --- functions over parts ----------------------------------------------------------------------


@query(_PARTS + """SELECT key, ean AS padded, CASE WHEN k % 2 = 0 THEN ean ELSE '' END AS by_image, CASE WHEN k % 3 = 0 THEN 'P' || key WHEN k % 3 = 1 THEN key ELSE 'own' END AS parent, CASE WHEN k % 2 = 0 THEN 'B0' || lpad(key, 8, '0') ELSE '' END AS code, CASE WHEN k % 4 = 0 THEN '' ELSE ean END AS candidate, 'second' AS first FROM p""", with_obs=False)
def key_values(spark, sf_dir):
    from shelfwise.functions import keys

    p, k = _parts(spark, sf_dir), F.col("k")
    images = F.array(F.lit("https://img.example.com/a.jpg"), F.when(k % 2 == 0, F.concat(F.lit("https://img.example.com/"), "ean", F.lit("-2.png"))))
    parent = keys.parent_id(F.when(k % 3 == 0, F.concat(F.lit("P"), "key")).otherwise(" "), F.when(k % 3 == 1, F.concat(F.lit("https://x.example.com/n/p/"), "key", F.lit("?s=1"))), F.lit("own"))
    url = F.concat(F.lit("https://x.example.com/"), F.when(k % 2 == 0, F.concat(F.lit("dp/b0"), F.lpad("key", 8, "0"))).otherwise("dp/abcdefghij"), F.lit("/ref"))
    candidates = F.array(F.lit("12"), F.when(k % 4 != 0, F.col("ean")), F.lit("x"))
    return p.select("key", keys.gtin_from_sku(F.concat(F.lit(" "), "ean")).alias("padded"), keys.gtin_from_images(images).alias("by_image"), parent.alias("parent"), keys.listing_code(url).alias("code"), keys.gtin_from_candidates(candidates).alias("candidate"), keys.first_non_blank(F.array(F.lit(None).cast("string"), F.lit(""), F.lit("second"))).alias("first"))


@query(_PARTS + """SELECT key, r AS plain, floor(r)::BIGINT AS whole, CASE WHEN k % 2 = 0 THEN 420.0 ELSE 1299.5 END::DOUBLE AS glued, CASE k % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN p_size > 25 ELSE FALSE END AS stock, 'a,b' AS listed,
  CASE WHEN k % 5 = 0 THEN NULL ELSE '2026-08-0' || (1 + k % 5) || ' 10:00:00' END AS seen, CASE WHEN k % 2 = 0 THEN 'Concern=' || p_type ELSE '' END || ';Benefits=b' AS chosen, '2' AS meta, greatest(k % 3, k % 2) AS best, 10 + k AS total, '{"a":1}' AS cell FROM p""", with_obs=False)
def value_panel(spark, sf_dir):
    p, k = _parts(spark, sf_dir), F.col("k")
    flag = lambda i, v: F.when(k % 4 == i, v)
    pair = lambda a, b: F.struct(F.lit(a).alias("key"), F.lit(b).alias("value"))
    chosen = values.chosen_attributes(F.create_map(F.lit("benefits"), F.lit("b"), F.lit("concern"), F.when(k % 2 == 0, F.col("p_type")).otherwise(""), F.lit("other"), F.lit("x")), {"concern": "Concern", "gender": "Gender", "benefits": "Benefits"})
    first = lambda name: F.try_element_at(chosen, F.lit(name))
    return p.select(
        "key", values.plain_number(F.format_number("r", 2)).alias("plain"), values.payload_integer(F.concat(F.lit("n "), F.col("r").cast("string"))).alias("whole"), values.glued_price(F.when(k % 2 == 0, "₹42000").otherwise("₹1,299.50")).alias("glued"),
        values.stock(flag(0, F.lit("yes")), flag(1, F.lit("true")), flag(2, (F.col("p_size") - 25).cast("string")), flag(3, F.lit("Sold out"))).alias("stock"), F.array_join(values.text_list(F.array(F.lit(" a "), F.lit(None).cast("string"), F.lit("b"), F.lit("a"), F.lit(" "))), ",").alias("listed"),
        F.date_format(values.instant(F.when(k % 5 == 0, "no time").when(k % 2 == 0, F.concat(F.lit("2026-08-0"), (1 + k % 5).cast("string"), F.lit("T10:00:00Z"))).otherwise(F.concat(F.lit("2026-08-0"), (1 + k % 5).cast("string"), F.lit("T10:00:00")))), "yyyy-MM-dd HH:mm:ss").alias("seen"),
        F.concat(F.coalesce(F.concat(F.lit("Concern="), first("Concern")), F.lit("")), F.lit(";Benefits="), first("Benefits")).alias("chosen"), F.element_at(values.meta_map(F.array(pair("m", "1"), pair(" ", "x"), pair("m", "2"))), "m").alias("meta"),
        F.coalesce(values.positive_max(k % 3, k % 2), F.lit(0)).alias("best"), values.breakdown_total(F.array(F.struct(F.lit(5).alias("stars"), k.cast("bigint").alias("count")), F.struct(F.lit(4).alias("stars"), F.lit(10).cast("bigint").alias("count")), F.struct(F.lit(3).alias("stars"), F.lit(None).cast("bigint").alias("count")))).alias("total"),
        values.to_cell(values.from_cell(F.lit('{"a":1}'), "map<string,bigint>"), p.select(F.create_map(F.lit("a"), F.lit(1).cast("bigint"))).schema[0].dataType).alias("cell"),
    )


# --- titles and texts put together from parts that vary on their own ----------------------------

_WORDS = [(k, titles.FORM_ALIASES.get(form, form)) for _, _, form, k in sorted((-len(k), rank, form, k) for rank, (form, words) in enumerate(titles.FORMS.items()) for k in words)]
_UNITS = [("ml", "ml", 1), ("L", "ml", 1000), ("gm", "g", 1), ("kg", "g", 1000), ("oz", "ml", None), ("g", "g", 1), ("litre", "ml", 1000), ("GRAMS", "g", 1), ("tablets", "pc", 1), ("Sheets", "pc", 1)]
_BUNDLES = ("", "combo", "kits", "DUO", "Hamper", "", "trio")
_LINE_PARTS = """WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS ord, l_orderkey AS o, l_quantity::INT AS q, l_linenumber::INT AS c, l_partkey AS k, l_suppkey AS s FROM lineitem),
"""


def _line_titles(spark, sf_dir):
    """Of each order line a title: a form's keyword, strengths, a bundle's word and a size in one of five layouts."""
    line = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_orderkey").alias("o"), F.col("l_quantity").cast("int").alias("q"), F.col("l_linenumber").cast("int").alias("c"), F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"))
    pick = lambda options, at: F.element_at(F.array(*map(F.lit, options)), (at % len(options) + 1).cast("int"))
    q, c, o, k = F.col("q").cast("string"), F.col("c").cast("string"), F.col("o"), F.col("k")
    amount, unit = F.concat(q, pick(("", ".5", ",5"), F.col("s"))), pick([u for u, _, _ in _UNITS], k)
    sizes = (F.concat(amount, unit), F.concat(c, pick((" x ", "×", "* "), F.col("q")), amount, F.lit(" "), unit), F.concat(F.lit("Pack of "), c, F.lit(" "), amount, F.lit(" "), unit), F.concat(amount, F.lit(" "), unit, F.lit(" ("), c, F.lit("-pack)")))
    size = F.coalesce(*[F.when(o % 5 == i, x) for i, x in enumerate(sizes)], F.lit("no size"))
    strong = F.concat(((k % 21) / 2).cast("string"), pick(("%", " %"), o), F.lit(" + "), (F.col("q") % 4).cast("string"), F.lit("%"), F.when(o % 3 == 0, F.concat(F.lit(" SPF "), q)).when(o % 3 == 1, F.concat(F.lit(" spf0"), q)).otherwise(""))
    return line.select("ord", F.concat_ws(" ", pick([w for w, _ in _WORDS], o + F.col("c")), strong, pick(_BUNDLES, F.col("s") + F.col("c")), F.lit("daily"), size).alias("title"))


@query(_LINE_PARTS + """u AS (SELECT *, o % 5 AS layout, k % 10 AS n, q + CASE WHEN s % 3 = 0 THEN 0 ELSE 0.5 END AS number FROM l)
SELECT ord, CASE WHEN layout = 4 THEN NULL WHEN n = 4 THEN round(number::DECIMAL(12,2) * 29.5735, 1)::DOUBLE ELSE number::DOUBLE * CASE WHEN n IN (1, 3, 6) THEN 1000 ELSE 1 END END AS amount,
  CASE WHEN layout = 4 THEN NULL ELSE (['ml', 'ml', 'g', 'g', 'ml', 'g', 'ml', 'g', 'pc', 'pc'])[n + 1] END AS unit, CASE WHEN layout = 4 THEN 0 WHEN layout IN (2, 3) OR layout = 1 AND n IN (0, 1, 2, 3, 5) THEN c ELSE 1 END::INT AS pack,
  CASE WHEN layout = 4 THEN '' ELSE 'x' END AS labelled FROM u""", with_obs=False)
def line_sizes(spark, sf_dir):
    rows = _line_titles(spark, sf_dir).withColumn("size", titles.parse_size(F.col("title")))
    return rows.select("ord", "size.amount", "size.unit", F.coalesce("size.pack", F.lit(0)).alias("pack"), F.when(titles.size_label(F.col("size")) == "", "").otherwise("x").alias("labelled"))


@query(_LINE_PARTS + "t AS (SELECT *, ([" + ", ".join(f"'{w}'" for w, _ in _WORDS) + f"])[(o + c) % {len(_WORDS)} + 1] AS word, ([" + ", ".join(f"'{b}'" for b in _BUNDLES) + f"""])[(s + c) % {len(_BUNDLES)} + 1] AS bundle,
  ([{", ".join(f"'{u}'" for u, _, _ in _UNITS)}])[k % {len(_UNITS)} + 1] AS unit FROM l),
h AS (SELECT *, trim(regexp_replace(lower(concat_ws(' ', word, CASE WHEN o % 3 < 2 THEN 'spf' ELSE '' END, bundle, 'daily', CASE WHEN o % 5 = 2 THEN 'pack of' WHEN o % 5 = 4 THEN 'no size' ELSE '' END,
  CASE WHEN o % 5 < 4 THEN unit ELSE '' END, CASE WHEN o % 5 = 3 THEN 'pack' ELSE '' END)), '[^a-z0-9]+', ' ', 'g')) AS hay FROM t)
SELECT ord, CASE """ + " ".join(f"WHEN contains(hay, '{w}') THEN '{form}'" for w, form in _WORDS) + """ ELSE '' END AS form, bundle NOT IN ('', 'kits') AS bundle,
  array_to_string(list_sort(list_distinct(list_filter(['pct' || CASE WHEN k % 21 % 2 = 0 THEN (k % 21 // 2)::VARCHAR ELSE (k % 21 // 2)::VARCHAR || '.5' END, 'pct' || (q % 4), CASE WHEN o % 3 < 2 THEN 'spf' || q END, CASE WHEN word = 'spf' THEN 'spf' || (k % 21 // 2) END], lambda x: x IS NOT NULL))), ' ') AS strengths FROM h""", with_obs=False)
def line_forms(spark, sf_dir):
    rows = _line_titles(spark, sf_dir)
    return rows.select("ord", titles.detect_form(F.col("title")).alias("form"), titles.is_bundle(F.col("title")).alias("bundle"), F.array_join(titles.strengths(F.col("title")), " ").alias("strengths"))


@query(_LINE_PARTS + """v AS (SELECT *, 100 + k % 900 AS rupees FROM l)
SELECT ord, rupees + CASE WHEN o % 3 = 1 THEN 0.5 ELSE 0 END::DOUBLE AS selling_price, (rupees * c + q)::DOUBLE AS mrp, CASE WHEN o % 4 = 3 THEN NULL ELSE q + CASE WHEN o % 4 = 1 THEN 0.5 ELSE 0 END END::DOUBLE AS discount_pct,
  CASE WHEN o % 6 = 5 THEN '{}' ELSE '{"p' || (k % 7) || '":' || q || '}' END AS cell, CASE WHEN s % 2 = 0 THEN 'b' || q ELSE 'a' || c END AS meta FROM v WHERE o % 4 <> 3
UNION ALL SELECT ord, NULL, (rupees * c + q)::DOUBLE, NULL, CASE WHEN o % 6 = 5 THEN '{}' ELSE '{"p' || (k % 7) || '":' || q || '}' END, CASE WHEN s % 2 = 0 THEN 'b' || q ELSE 'a' || c END FROM v WHERE o % 4 = 3""", with_obs=False)
def line_texts(spark, sf_dir):
    """Price texts in several forms, cells of maps (some broken) and lists of pairs, of each order line."""
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_orderkey").alias("o"), F.col("l_quantity").cast("int").alias("q"), F.col("l_linenumber").cast("int").alias("c"), (100 + F.col("l_partkey") % 900).alias("rupees"), F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"))
    o, q, rupees = F.col("o"), F.col("q").cast("string"), F.col("rupees").cast("string")
    cut = F.when(o % 4 == 0, F.concat(F.lit("-"), q, F.lit("%"))).when(o % 4 == 1, F.concat(F.lit("− "), q, F.lit(".5 %"))).when(o % 4 == 2, F.concat(F.lit("-"), q, F.lit(".0%"))).otherwise("now")
    selling = F.when(o % 3 == 0, F.concat(rupees, F.lit("00"))).when(o % 3 == 1, F.concat(rupees, F.lit(".50"))).otherwise(rupees)
    mrp = F.format_number(F.col("rupees") * F.col("c") + F.col("q"), 2)
    price = values.price_triple(F.concat(cut, F.lit(" ₹"), selling, F.when(o % 2 == 0, " M.R.P.: ₹").otherwise(" mrp ₹"), mrp))
    kind = "map<string,bigint>"
    cell = F.when(o % 6 == 5, F.concat(F.lit("{p"), q)).otherwise(F.concat(F.lit(' {"p'), (F.col("k") % 7).cast("string"), F.lit('" : '), q, F.lit("} ")))
    pair = lambda a, b: F.struct(F.lit(a).alias("key"), b.alias("value"))
    pairs = F.array(pair("m", F.lit("first")), pair(" ", q), pair(" m", F.concat(F.lit("a"), F.col("c").cast("string"))), F.struct(F.when(F.col("s") % 2 == 0, "m ").otherwise("other").alias("key"), F.concat(F.lit("b"), q).alias("value")))
    return rows.select("ord", "o", price.alias("p"), values.from_cell(cell, kind).alias("cell"), values.meta_map(pairs).alias("meta")).select("ord", "p.selling_price", "p.mrp", "p.discount_pct", values.to_cell(F.col("cell"), T._parse_datatype_string(kind)).alias("cell"), F.element_at("meta", "m").alias("meta"))
