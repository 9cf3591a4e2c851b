"""Registered queries over one-to-one matches. Their SQL walks over the items of each brand in order, one
item a step, as the assignment is defined; Spark settles many in a round."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import barcodes, comparison, matching
from shelfwise.plans import jobs
from shelfwise.plans.catalogue_queries import _ITEMS, SITES, latest, query, titled
from shelfwise.sources.versions import stored


def _walk(threshold: float, gtin: str = "gtin") -> str:
    """SQL up to ``assigned``: l_site, l_id, r_site, r_id, method, confidence. ``gtin``: the barcode of a row of ``latest``."""
    return _ITEMS.replace("AS bkey, gtin, variant,", f"AS bkey, {gtin} AS gtin, variant,") + f""", placed AS (
  SELECT i.site, i.product_id, i.bkey, row_number() OVER (PARTITION BY bkey ORDER BY i.site, lower(l.brand), lower(l.product_name), lower(l.variant), i.product_id) AS i FROM it i JOIN latest l USING (site, product_id)),
numbered AS (SELECT DISTINCT a.bkey, a.i AS li, e.r_site AS s, b.i AS ri, e.confidence AS conf, e.method AS m
  FROM edges e JOIN placed a ON a.site = e.l_site AND a.product_id = e.l_id JOIN placed b ON b.site = e.r_site AND b.product_id = e.r_id WHERE e.confidence >= {threshold}),
listed AS (SELECT bkey, li, row_number() OVER (PARTITION BY bkey ORDER BY li) AS j, list(struct_pack(s := s, ri := ri, conf := conf, m := m) ORDER BY s, conf DESC, ri) AS c FROM numbered GROUP BY bkey, li),
walk(bkey, k, used, picks) AS (
  SELECT DISTINCT bkey, 0::BIGINT, []::BIGINT[], []::STRUCT(li BIGINT, ri BIGINT, conf DOUBLE, m VARCHAR)[] FROM listed
  UNION ALL
  SELECT bkey, k + 1, CASE WHEN len(chosen) = 0 THEN used ELSE used || [li] || list_transform(chosen, lambda x: x.ri) END,
    list_transform(chosen, lambda x: struct_pack(li := li, ri := x.ri, conf := x.conf, m := x.m))
  FROM (SELECT bkey, k, used, li, list_filter(free, lambda x, n: n = 1 OR free[n - 1].s <> x.s) AS chosen
    FROM (SELECT w.bkey, w.k, w.used, d.li, list_filter(d.c, lambda x: NOT list_contains(w.used, x.ri) AND NOT list_contains(w.used, d.li)) AS free FROM walk w JOIN listed d ON d.bkey = w.bkey AND d.j = w.k + 1))),
picked AS (SELECT bkey, unnest(picks) AS p FROM walk),
assigned AS (SELECT a.site AS l_site, a.product_id AS l_id, b.site AS r_site, b.product_id AS r_id, p.m AS method, p.conf AS confidence
  FROM picked JOIN placed a ON a.bkey = picked.bkey AND a.i = p.li JOIN placed b ON b.bkey = picked.bkey AND b.i = p.ri),
members AS (SELECT l_site AS a_site, l_id AS a_id, r_site AS site, r_id AS product_id, FALSE AS anchor FROM assigned UNION ALL SELECT DISTINCT l_site, l_id, l_site, l_id, TRUE FROM assigned),
per AS (SELECT l_site AS a_site, l_id AS a_id, min(confidence) AS confidence, CASE WHEN bool_and(method = 'gtin') THEN 'gtin' ELSE 'name' END AS method,
  coalesce(string_agg(r_site || ': product form not recognized', '; ' ORDER BY r_site) FILTER (method = 'name' AND lf.form = '' AND rf.form = ''), '') AS notes
  FROM assigned JOIN it lf ON lf.site = l_site AND lf.product_id = l_id JOIN it rf ON rf.site = r_site AND rf.product_id = r_id GROUP BY l_site, l_id),
rows AS (SELECT m.*, p.confidence, p.method, p.notes, l.brand, l.product_name, l.category, l.variant, l.mrp, l.selling_price, l.discount_pct, l.in_stock, i.gtin, i.form, replace(l.variant, ' ', '') AS size
  FROM members m JOIN per p USING (a_site, a_id) JOIN latest l USING (site, product_id) JOIN it i USING (site, product_id))
"""


def _recursive(sql: str):
    """Register with SQL whose common tables may be recursive."""
    from shelfwise.plans import catalogue_queries

    def add(f):
        query(sql)(f)
        catalogue_queries._SQL[f.__name__] = catalogue_queries._SQL[f.__name__].replace("WITH lines AS", "WITH RECURSIVE lines AS", 1)
        return f

    return add


@_recursive(_walk(0.7) + "SELECT l_site, l_id, r_site, r_id, method, round(confidence, 6) AS confidence FROM assigned")
def match_assign(spark, sf_dir):
    items = stored(matching.prepare(titled(spark, sf_dir), SITES))
    edges = matching.assign_titles(items, matching.title_pairs(matching.with_class(items.where("bkey <> ''"))))
    return edges.select("l_site", F.col("left.product_id").alias("l_id"), "r_site", F.col("right.product_id").alias("r_id"), "method", F.round("confidence", 6).alias("confidence"))


_BLOCKS = ", ".join(f"max(selling_price) FILTER (site = '{s}') AS {s}_selling_price, max(mrp) FILTER (site = '{s}') AS {s}_mrp, max(discount_pct) FILTER (site = '{s}') AS {s}_discount_pct, coalesce(max(CASE WHEN in_stock THEN 'true' ELSE 'false' END) FILTER (site = '{s}'), '') AS {s}_in_stock, coalesce(max(product_name) FILTER (site = '{s}'), '') AS {s}_name, '' AS {s}_url" for s in SITES)


@_recursive(_walk(0.7) + f""", w AS (SELECT max(brand) FILTER (anchor) AS brand, max(product_name) FILTER (anchor) AS product, max(form) FILTER (anchor) AS form, max(size) FILTER (anchor) AS size, 1 AS pack, max(category) FILTER (anchor) AS categories, string_agg(DISTINCT site, ', ' ORDER BY site) AS platforms,
  count(*) AS platform_count, any_value(method) AS match_method, round(any_value(confidence), 3) AS confidence, any_value(notes) AS notes, {_BLOCKS}, min(selling_price) AS min_price, max(selling_price) AS max_price, min(struct_pack(p := selling_price, s := site)).s AS cheapest_platform,
  max(selling_price) FILTER (site = 'site_0') AS own, min(selling_price) FILTER (site <> 'site_0') AS rival FROM rows GROUP BY a_site, a_id)
SELECT * EXCLUDE (own, rival), round(max_price - min_price, 2) AS price_gap, CASE WHEN min_price <> 0 THEN round((max_price - min_price) / min_price * 100, 2) END AS price_gap_pct,
  round(own - rival, 2) AS site_0_vs_cheapest, CASE WHEN rival <> 0 THEN round((own - rival) / rival * 100, 2) END AS site_0_vs_cheapest_pct FROM w""")
def comparison_rows(spark, sf_dir):
    _, groups, _ = matching.match_products(latest(spark, sf_dir), order=SITES)
    rows = comparison.comparison_rows(groups, SITES, "site_0").drop("match")
    return rows.withColumns({f"{s}_in_stock": F.coalesce(F.col(f"{s}_in_stock").cast("string"), F.lit("")) for s in SITES})


#: Products of which no two sites have a word in common.
_ALONE = """, renamed AS (SELECT * REPLACE (CASE WHEN l_partkey % 5 = 3 AND gtin = '' THEN 'zz' || right(site, 1) || 'x' || product_id || ' yy' || right(site, 1) || 'x' || product_id ELSE product_name END AS product_name) FROM latest)"""


@_recursive(_ALONE + _walk(0.7).replace("FROM latest", "FROM renamed").replace("JOIN latest", "JOIN renamed") + """SELECT l.site, l.brand, l.product_name, l.variant, replace(l.variant, ' ', '') AS size, i.form, l.mrp, l.selling_price, l.in_stock, '' AS product_url
FROM renamed l JOIN it i USING (site, product_id) WHERE (l.site, l.product_id) NOT IN (SELECT (site, product_id) FROM members)""")
def single_site_rows(spark, sf_dir):
    rows, own = latest(spark, sf_dir), F.concat(F.substring("site", -1, 1), F.lit("x"), "product_id")
    alone = F.concat(F.lit("zz"), own, F.lit(" yy"), own)
    rows = rows.withColumn("product_name", F.when((F.col("product_id") % 5 == 3) & (F.col("gtin") == ""), alone).otherwise(F.col("product_name")))
    _, _, rest = matching.match_products(rows, order=SITES)
    return comparison.single_site_rows(rest)


@_recursive(_walk(0.7) + "SELECT platforms, count(*) AS matches FROM (SELECT string_agg(DISTINCT site, ', ' ORDER BY site) AS platforms FROM rows GROUP BY a_site, a_id) GROUP BY platforms")
def platform_sets(spark, sf_dir):
    return jobs.compare_catalogues(latest(spark, sf_dir), own_site="site_0", platforms=SITES[1:])["by_platforms"]


@_recursive(_walk(0.7) + "SELECT max(brand) FILTER (anchor) AS brand, max(product_name) FILTER (anchor) AS product, count(*) AS platform_count, round(any_value(confidence), 3) AS confidence, any_value(notes) AS notes FROM rows GROUP BY a_site, a_id HAVING round(any_value(confidence), 3) < 0.8 OR any_value(notes) <> ''")
def review_rows(spark, sf_dir):
    review = jobs.compare_catalogues(latest(spark, sf_dir), own_site="site_0", platforms=SITES[1:])["review"]
    return review.select("brand", "product", "platform_count", "confidence", "notes")


_CODES = """, g AS (SELECT a_site, a_id, count(DISTINCT gtin) FILTER (gtin <> '') AS codes, min(struct_pack(s := site, p := product_id, g := gtin)) FILTER (gtin <> '') AS donor, list(struct_pack(s := site, g := gtin) ORDER BY site, gtin) FILTER (gtin <> '') AS two,
  max(brand) FILTER (anchor) AS brand, max(product_name) FILTER (anchor) AS product_name, round(any_value(confidence), 3) AS sure FROM rows GROUP BY a_site, a_id)
"""
_FILLS = "SELECT r.site, r.product_id, r.brand, r.product_name, donor.g AS gtin, donor.s AS donor_site, donor.p AS donor_product_id, sure AS confidence, r.size FROM rows r JOIN g USING (a_site, a_id) WHERE r.gtin = '' AND codes = 1"


@_recursive(_walk(0.9) + _CODES + _FILLS)
def gtin_propagation(spark, sf_dir):
    return barcodes.propagate(titled(spark, sf_dir), 0.9, SITES, SITES)[0]


#: Barcodes in which two sites disagree, and the others have none.
_CLASH = "CASE site WHEN 'site_4' THEN ean WHEN 'site_5' THEN '0' || ean ELSE '' END"


def _clashing(spark, sf_dir):
    ean = F.element_at("product_attributes", "Item model number")
    return latest(spark, sf_dir).withColumn("gtin", F.when(F.col("site") == "site_4", ean).when(F.col("site") == "site_5", F.concat(F.lit("0"), ean)).otherwise("")).select(*matching.TITLED)


@_recursive(_walk(0.7, _CLASH) + _CODES + "SELECT brand, product_name, two[1].s AS left_site, two[1].g AS left_gtin, two[2].s AS right_site, two[2].g AS right_gtin, sure AS confidence FROM g WHERE codes > 1")
def gtin_conflicts(spark, sf_dir):
    return barcodes.propagate(_clashing(spark, sf_dir), 0.7, SITES, SITES)[1]


@_recursive(_walk(0.7, _CLASH) + _CODES + """, fills AS (""" + _FILLS + """), clash AS (SELECT unnest([two[1].s, two[2].s]) AS site FROM g WHERE codes > 1)
SELECT l.site, count(*) AS considered, count(*) FILTER (""" + _CLASH.replace("site WHEN", "l.site WHEN") + """ <> '') AS had_gtin, (SELECT count(*) FROM fills f WHERE f.site = l.site) AS filled, (SELECT count(*) FROM clash c WHERE c.site = l.site) AS conflicts FROM latest l GROUP BY l.site""")
def propagation_summary(spark, sf_dir):
    return jobs.propagate_gtins(stored(_clashing(spark, sf_dir)), 0.7, SITES, donor_order=SITES)[2]


@_recursive(_walk(0.9) + _CODES + ", fills AS MATERIALIZED (" + _FILLS + ") SELECT i.site, i.product_id, coalesce(nullif(i.gtin, ''), f.gtin, '') AS gtin FROM it i LEFT JOIN fills f ON f.site = i.site AND f.product_id = i.product_id")
def gtins_applied(spark, sf_dir):
    rows = stored(titled(spark, sf_dir))
    fills = jobs.propagate_gtins(rows, 0.9, SITES, donor_order=SITES)[0]
    return barcodes.apply_fills(rows, fills).select("site", "product_id", "gtin")


@_recursive(_walk(0.7) + """, pair AS (SELECT a_site, a_id FROM rows WHERE site IN ('site_1', 'site_2') GROUP BY ALL HAVING count(DISTINCT site) = 2)
SELECT max(brand) FILTER (anchor) AS brand, max(product_name) FILTER (anchor) AS product, coalesce(min(struct_pack(s := site <> 'site_1', x := site <> 'site_2', y := site, g := gtin)) FILTER (gtin <> ''), NULL).g AS gtin FROM rows JOIN pair USING (a_site, a_id) GROUP BY a_site, a_id""")
def gtin_match_report(spark, sf_dir):
    _, groups, _ = matching.match_products(titled(spark, sf_dir), 0.7, SITES)
    report = barcodes.gtin_report(groups, ("site_1", "site_2"), None, ("site_1", "site_2"))
    return report.select("brand", "product", F.nullif("gtin", F.lit("")).alias("gtin"))


@_recursive(_walk(0.7) + """, pair AS (SELECT a_site, a_id FROM rows WHERE site IN ('site_1', 'site_2') GROUP BY ALL HAVING count(DISTINCT site) = 2),
found AS (SELECT min(struct_pack(s := site <> 'site_1', x := site <> 'site_2', y := site)) FILTER (gtin <> '') AS f FROM rows JOIN pair USING (a_site, a_id) GROUP BY a_site, a_id)
SELECT f.y AS gtin_source, count(*) AS rows FROM found WHERE f IS NOT NULL GROUP BY 1""")
def gtin_sources(spark, sf_dir):
    _, groups, _ = matching.match_products(titled(spark, sf_dir), 0.7, SITES)
    return barcodes.report_counts(barcodes.gtin_report(groups, ("site_1", "site_2"), None, ("site_1", "site_2")))


#: A site without barcodes, of which a fifth is found in attributes and a fifth on captured pages.
_SWEPT = "CASE WHEN site <> 'site_0' THEN gtin WHEN l_partkey % 5 IN (0, 1) THEN ean ELSE '' END"


@_recursive(_walk(0.9, _SWEPT) + _CODES + ", borrowed AS MATERIALIZED (" + _FILLS + """), found AS (
  SELECT site, product_id, ean AS gtin, CASE l_partkey % 5 WHEN 0 THEN 'attributes' ELSE 'page' END AS origin FROM latest WHERE site = 'site_0' AND l_partkey % 5 IN (0, 1)
  UNION ALL SELECT site, product_id, gtin, 'borrowed' FROM borrowed WHERE site = 'site_0')
SELECT site, product_id, gtin, origin, count(*) OVER (PARTITION BY origin) AS found FROM found""")
def gtins_found(spark, sf_dir):
    """A sweep for one site's barcodes: from attributes, then from the last of two captured pages of a
    product, then from matched products of other sites; with the number found for each origin."""
    rows, fifth = stored(latest(spark, sf_dir).select(*matching.TITLED, "product_attributes")), F.col("product_id") % 5
    pages = rows.where((F.col("site") == "site_0") & fifth.isin(0, 1)).select("site", "product_id", F.element_at("product_attributes", "Item model number").alias("ean"))
    pages = pages.select("site", "product_id", F.explode(F.array(F.struct(F.concat(F.lit("0"), "ean").alias("gtin"), F.lit(0).alias("ord")), F.struct(F.col("ean").alias("gtin"), F.lit(1).alias("ord")))).alias("page"))
    swept = rows.withColumn("gtin", F.when(F.col("site") == "site_0", "").otherwise(F.col("gtin"))).withColumn("product_attributes", F.when(fifth == 0, F.col("product_attributes")))
    found = stored(jobs.fill_gtins(swept, "site_0", pages.select("site", "product_id", "page.*"))[1])
    return found.join(jobs.found_by_origin(found), "origin").select("site", "product_id", "gtin", "origin", "found")
