import datetime as dt
import decimal
import json
import os

import pytest
from pyspark.sql import functions as F

from shelfwise.normalize import payloads
from shelfwise.operators import catalogue
from shelfwise.schema import BRONZE_DDL, CATALOGUE_DDL, HISTORY_DDL, PRODUCT_COLUMNS, RUN_DDL
from shelfwise.sources import readers, sinks
from shelfwise.sources.versions import VersionedTable
from shelfwise.streaming import micro_batches
from tests.helpers import product, products

GTIN = "8901030974090"


def bronze(spark, body, url="https://s.test/product/cosrx-toner"):
    return spark.createDataFrame([("s", url, None, 1, "skincare", body if isinstance(body, str) else json.dumps(body))], BRONZE_DDL)


def test_csv_round_trip(spark, tmp_path):
    rows = products(spark, [product("a", "1", product_name='With "quotes", commas\nand lines', categories=["x", "y"], product_attributes={"k": "v"}, selling_price=5.5, rating_count=3, in_stock=False), product("b", "2", scraped_at=None)])
    counts = sinks.export_products(rows, str(tmp_path / "out"))
    assert {r.site: r.products for r in counts.collect()} == {"a": 1, "b": 1}
    back = readers.read_products_csv(spark, str(tmp_path / "out"))
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert readers.read_products_csv(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        sinks.export_products(rows.limit(0), str(tmp_path / "empty"))


def test_lenient_cells(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿site,product_id,rating_count,mrp,in_stock,categories\ns,1,12.7,bad,yes,not json\n", encoding="utf-8")
    [r] = readers.read_products_csv(spark, str(tmp_path / "p.csv")).collect()
    assert (r.site, r.rating_count, r.mrp, r.in_stock, r.categories, r.brand) == ("s", 12, None, True, [], "")


def test_damaged_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "p.jsonl").write_bytes(b'{"site":"a","product_id":"1"}\n{"site":"a","pro\x00\x00\n\n')
    good, bad = readers.read_jsonl(spark, str(tmp_path / "p.jsonl"), "site string, product_id string")
    assert [tuple(r) for r in good.collect()] == [("a", "1")] and bad.count() == 1
    (tmp_path / "ids").write_bytes(b"a\nb\x01\n\na\n")
    assert [r.id for r in readers.read_processed_ids(spark, str(tmp_path / "ids")).collect()] == ["a"]


def test_snapshot_replaces_its_sites_only(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.write_snapshot(products(spark, [product("shop1", "1"), product("shop2", "1")]), path)
    sinks.write_snapshot(products(spark, [product("shop2", "2")]), path)
    assert sorted((r.site, r.product_id) for r in spark.read.parquet(path).collect()) == [("shop1", "1"), ("shop2", "2")]
    rows, source = readers.read_with_fallback(spark, str(tmp_path / "no"), str(tmp_path / "no.csv"))
    assert source == "none" and rows.count() == 0


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "v"))
    assert table.read("site string, x int").count() == 0
    table.write(spark.createDataFrame([("a", 1)], "site string, x int"))
    table.write(table.read().withColumn("x", F.col("x") + 1))  # reads what it replaces
    assert [r.x for r in table.read("site string, x int").collect()] == [2] and table.versions() == [1, 2]


def test_sync_twice_is_sync_once(spark, tmp_path):
    table, history = VersionedTable(spark, str(tmp_path / "t")), sinks.DayHistory(spark, str(tmp_path / "h"))
    rows = products(spark, [product("a", "1", selling_price=5.0)])
    for _ in range(2):
        sinks.sync(table, history, rows, F.current_timestamp())
    assert table.read(CATALOGUE_DDL).count() == 1 and history.read(HISTORY_DDL).count() == 1


def test_shop_feed(spark):
    entry = {"id": 900, "handle": "tea", "title": "Tea Milk", "vendor": "Innisfree", "product_type": "Toner", "body_html": "<p>Hydrating <b>milk</b></p>", "images": [{"src": "https://c.test/a.jpg"}], "variants": [{"id": 11, "title": "Default Title", "sku": "8800294993574", "price": "1450.00", "compare_at_price": "1600.00", "available": True}, {"id": 12, "title": "Big", "sku": "N", "price": "10", "compare_at_price": "5"}]}
    page = bronze(spark, {"products": [entry, entry | {"vendor": "Other"}, {"id": 1}]})
    got = payloads.shop_feed(page, "https://b.test", ["innisfree"], spark.createDataFrame([("tea", GTIN)], "handle string, gtin string")).orderBy("product_id").collect()
    a, b = got
    assert (a.product_id, a.gtin, a.discount_pct, a.variant, a.description, a.in_stock, a.image_urls) == ("11", "8800294993574", 9.38, "", "Hydrating milk", True, ["https://c.test/a.jpg"])
    assert (b.gtin, b.mrp, b.discount_pct, b.in_stock, b.variant) == (GTIN, None, None, False, "Big")


def page(ld_price="0", master=GTIN, our_price="299"):
    return (
        '<script type="application/ld+json">{"@type":"Product","name":"COSRX Toner","brand":{"name":"COSRX"},"description":"<p>A toner</p>","image":["https://i.test/1.jpg"],"sku":"PPLB8901030764622NM3",'
        f'"aggregateRating":{{"ratingValue":"4.3","ratingCount":"120"}},"offers":{{"price":"{ld_price}","availability":"http://schema.org/InStock"}}}}</script>'
        f'<script>window.state={{master_product_id:"{master}",mrp:"350",our_price:{our_price},l1_category_name:"Skincare",l2_category_name:"Toner"}}</script>'
    )


@pytest.mark.parametrize("values, price, gtin", [({"ld_price": "280"}, 280.0, GTIN), ({}, 299.0, GTIN), ({"our_price": "0"}, None, GTIN), ({"master": "9991308610002"}, 299.0, "8901030764622")])
def test_pages_with_state(spark, values, price, gtin):
    [r] = payloads.linked_data_pages(bronze(spark, page(**values))).collect()
    assert (r.product_id, r.brand, r.selling_price, r.mrp, r.rating_count, r.categories, r.gtin, r.in_stock, r.description) == ("cosrx-toner", "COSRX", price, 350.0, 120, ["Skincare", "Toner"], gtin, True, "A toner")


def test_pages_without_state(spark):
    body = '<script type="application/ld+json">{"@type":"http://schema.org/Product","name":"Oil","brand":"Anua","image":"https://c/8906034883836_5.jpg","offers":[{"price":1720,"availability":"InStock"}]}</script>'
    [r] = payloads.linked_data_pages(bronze(spark, body, "https://k.test/heartleaf-oil/"), page_state=False).collect()
    assert (r.product_id, r.brand, r.selling_price, r.gtin) == ("heartleaf-oil", "Anua", 1720.0, "8906034883836")
    assert payloads.linked_data_pages(bronze(spark, "<html>nothing</html>")).count() == 0


def test_listing_with_variants(spark):
    records = [
        {"productId": "p", "productName": "Face Serum", "brandName": "Minimalist", "dynamicUrl": "/s/p/1", "rating": "4.4", "ratingCount": "1,234", "variants": [{"skuId": "s30", "size": "30 ml", "mrp": "₹599", "sellingPrice": "₹539", "inStock": True}, {"skuId": "s60", "size": "", "mrp": 999, "sellingPrice": 899, "inStock": False}]},
        {"productId": "x", "productName": "Cream", "brandName": "Other"}, {"unexpected": "malformed"}, {"objectType": "banner", "id": 5},
    ]
    good, bad = payloads.json_listing(bronze(spark, {"response": {"products": records}}), "https://s.test", [" minimalist. "])
    a, b = good.orderBy("product_id").collect()
    assert (a.product_id, a.variant, a.mrp, a.selling_price, a.discount_pct, a.rating_count, a.product_url) == ("s30", "30 ml", 599.0, 539.0, 10.02, 1234, "https://s.test/s/p/1")
    assert (b.variant, b.in_stock) == ("", False) and bad.count() == 1


def test_attribute_pages(spark):
    sections = {"title": "Serum  30 ml", "brand": "Visit the COSRX Store", "price": "-30% ₹42000 M.R.P.: ₹59900", "details": "UPC\t" + GTIN + "\nBrand\tCOSRX", "important": "Ingredients: Water Directions: Rub", "rating_count": "14.9K ratings", "availability": "Only 2 left"}
    rows = spark.createDataFrame([("a", "B0", dt.datetime(2026, 1, 1), sections)], "site string, code string, fetched_at timestamp, sections map<string,string>")
    [r] = payloads.attribute_pages(rows).collect()
    assert (r.gtin, r.brand, r.selling_price, r.mrp, r.discount_pct, r.ingredients, r.how_to_use, r.rating_count, r.in_stock) == (GTIN, "COSRX", 420.0, 599.0, 30.0, "Water", "Rub", 14900, True)


def test_sitemap(spark):
    body = "<urlset><url><loc>https://p.test/product/a/reviews</loc></url><url><loc>https://p.test/product/a/reviews</loc></url><url><loc>https://p.test/product/b?x=1</loc></url><url><loc>https://p.test/skin</loc></url></urlset>"
    assert [r.url for r in readers.sitemap_urls(bronze(spark, body), r"/product/[^/]+/reviews$").collect()] == ["https://p.test/product/a/reviews"]


STREAM = "site string, product_id string, ord long, scraped_at timestamp, selling_price double, in_stock boolean"
TABLE = "site string, product_id string, scraped_at timestamp, selling_price double, in_stock boolean"
POINTS = "site string, product_id string, selling_price decimal(12,2), in_stock boolean, scraped_at timestamp"


def land(spark, folder, rows):
    spark.createDataFrame([("a", p, i, dt.datetime(2026, 1, d), price, True) for i, (p, d, price) in enumerate(rows)], STREAM).coalesce(1).write.mode("append").parquet(folder)


def test_stream_merges_batches_resumes_and_takes_late_rows(spark, tmp_path):
    land_dir, (table, history) = str(tmp_path / "land"), (VersionedTable(spark, str(tmp_path / "t")), sinks.DayHistory(spark, str(tmp_path / "h")))
    merge = micro_batches.merge_batch(table, history, TABLE, POINTS)

    def run():
        micro_batches.run_to_end(micro_batches.landing(spark, land_dir, STREAM, 1), merge, str(tmp_path / "c"))

    land(spark, land_dir, [("1", 1, 5.0), ("1", 3, 6.0), ("2", 1, 7.0), ("", 1, 1.0)])
    run()
    land(spark, land_dir, [("1", 2, 4.0), ("3", 4, 9.0)])  # the first row is late
    run()
    run()
    assert {r.product_id: r.selling_price for r in table.read().collect()} == {"1": 6.0, "2": 7.0, "3": 9.0}
    assert history.read(POINTS).count() == 5
    merge(spark.read.parquet(land_dir), 99)  # replayed rows change nothing
    assert history.read(POINTS).count() == 5 and table.read().count() == 3


def test_a_failing_batch_is_kept_and_the_stream_goes_on(spark, tmp_path):
    table, history = VersionedTable(spark, str(tmp_path / "t")), sinks.DayHistory(spark, str(tmp_path / "h"))
    merge = micro_batches.merge_batch(table, history, "nonsense int, site string, product_id string, scraped_at timestamp", "missing int", quarantine=str(tmp_path / "q"))
    merge(spark.createDataFrame([("a", "1", 0, dt.datetime(2026, 1, 1), 5.0, True)], STREAM), 3)
    assert spark.read.parquet(str(tmp_path / "q")).count() == 1


def test_price_changes_keep_state_between_batches(spark, tmp_path):
    land_dir, out = str(tmp_path / "land"), str(tmp_path / "out")

    def run():
        changes = micro_batches.price_change_stream(micro_batches.landing(spark, land_dir, STREAM, 1))
        micro_batches.run_to_end(changes, lambda b, i: b.write.mode("append").parquet(out), str(tmp_path / "c"))

    land(spark, land_dir, [("1", 1, 5.0), ("1", 2, 5.0), ("1", 3, 6.0)])
    run()
    land(spark, land_dir, [("1", 4, 6.0), ("1", 5, 7.0), ("1", 2, 1.0)])
    run()
    assert sorted(r.selling_price for r in spark.read.parquet(out).collect()) == [5.0, 6.0, 7.0]


def test_columns_of_the_record():
    assert len(PRODUCT_COLUMNS) == 31


def test_failed_writes_hinder_no_other_and_old_versions_go(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", keep=2)
    good = spark.createDataFrame([("a", 1)], "site string, n int")
    table.write(good)
    bad = good.withColumn("n", F.raise_error(F.lit("no")).cast("int"))
    for _ in range(2):
        with pytest.raises(Exception):
            table.write(bad)
    assert table.versions() == [1] and not [x for x in os.listdir(tmp_path / "t") if x.startswith(".next")]
    for n in (2, 3, 4):
        table.write(table.read().withColumn("n", F.lit(n)))
    assert table.versions() == [3, 4]


def test_a_write_after_another_writers_is_an_error(spark, tmp_path):
    one, other = (VersionedTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    add = lambda table, n: table.write(table.read("site string, n int").unionByName(spark.createDataFrame([("a", n)], "site string, n int")))
    add(one, 1)
    mine = one.read("site string, n int")
    add(other, 2)
    with pytest.raises(OSError, match="has changed"):
        one.write(mine.where("n > 5"))
    assert add(one, 3) == 3 and sorted(r.n for r in one.read().collect()) == [1, 2, 3]
    assert not [x for x in os.listdir(tmp_path / "t") if x.startswith(".next")]


def test_history_by_day_adds_each_point_once(spark, tmp_path):
    history = sinks.DayHistory(spark, str(tmp_path / "h"))
    assert history.read(POINTS).count() == 0
    rows = spark.createDataFrame([("a", "1", dt.datetime(2026, 1, 1), "9.5"), ("a", "1", dt.datetime(2026, 1, 2), None), ("a", "2", None, "1")], "site string, product_id string, scraped_at timestamp, selling_price string")
    for _ in range(2):
        history.add(rows, POINTS)
    history.add(rows.limit(0), POINTS)
    got = sorted(history.read(POINTS).collect(), key=lambda r: r.scraped_at)
    assert [(r.scraped_at.day, r.selling_price, r.in_stock) for r in got] == [(1, decimal.Decimal("9.50"), None), (2, None, None)]
    assert sorted(x for x in os.listdir(tmp_path / "h") if x.startswith("day=")) == ["day=2026-01-01", "day=2026-01-02"]


def test_batches_set_aside_are_merged_later(spark, tmp_path):
    from shelfwise.streaming.micro_batches import merge_batch, merge_quarantine

    schema, points = "site string, product_id string, scraped_at timestamp, selling_price double", "site string, product_id string, selling_price decimal(12,2), scraped_at timestamp"
    table, history = VersionedTable(spark, f"file://{tmp_path}/table"), sinks.DayHistory(spark, f"file://{tmp_path}/history")
    batch = spark.sql("SELECT 'a' AS site, '1' AS product_id, timestamp '2026-01-01' AS scraped_at, 5.0D AS selling_price")
    broken = merge_batch(table, history, "site string, wrong string", points, f"file://{tmp_path}/aside")
    broken(batch, 7)
    assert table.versions() == []
    merge = merge_batch(table, history, schema, points)
    assert merge_quarantine(spark, merge, f"file://{tmp_path}/aside") == 1
    assert merge_quarantine(spark, merge, f"file://{tmp_path}/aside") == 0
    assert table.read().count() == 1 and history.read(points).count() == 1


def test_lines_of_sheets(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Vendor,Title\nA,x\nB,\"y\nz\"\nC,w\n")
    got = readers.read_sheet(spark, str(tmp_path / "a.csv")).repartition(3)
    assert sorted((r.line, r.Vendor) for r in got.collect()) == [(2, "A"), (3, "B"), (4, "C")]


def test_allowed_rows_of_several_sites(spark, tmp_path):
    rows = [product("a", "1", product_name="Serum"), product("a", "2", product_name=" "), product("b", "3", product_name="Toner", brand="Other"), product("c", "4", product_name="Balm"), product("b", "", product_name="Mist"), product("b", "5", product_name="Mask", brand="MINI-malist")]
    path = str(tmp_path / "table")
    sinks.write_snapshot(products(spark, rows), path)
    brands = spark.createDataFrame([("minimalist",), (None,)], "brand string")
    read = lambda brands: sorted(r.product_id for r in readers.read_allowed(spark, path, ("a", "b"), brands).collect())
    assert read(brands) == ["1", "5"] and read(None) == ["1", "3", "5"] and read(brands.limit(0)) == ["1", "3", "5"]


@pytest.mark.parametrize(("failures", "complete", "status", "missing"), [(0, True, "success", 1), (0, False, "partial", 0), (2, True, "partial", 0)])
def test_only_whole_and_clean_sweeps_age(spark, tmp_path, failures, complete, status, missing):
    schema, now = "site string, product_id string, last_seen_run_id string, missing_run_count int, is_active boolean", F.lit("2026-01-02").cast("timestamp")
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.createDataFrame([("a", "1", "r1", 0, True), ("a", "2", None, 0, True), ("b", "3", None, 0, True)], schema))
    runs = catalogue.open_run(spark.createDataFrame([], RUN_DDL), "a", "r1", now)
    runs = micro_batches.close_stream(table, schema, runs, "a", "r1", now, failures, complete, 1)
    again = micro_batches.close_stream(table, schema, runs, "a", "r1", now, failures, complete, 1)  # a run that is closed ages nothing
    assert [r.status for r in again.collect()] == [status]
    assert {r.product_id: (r.missing_run_count, r.is_active) for r in table.read().collect()} == {"1": (0, True), "2": (missing, not missing), "3": (0, True)}


def test_texts_of_a_payload_are_read_before_its_variants_are_listed(spark):
    detail = payloads.json_detail(bronze(spark, '{"id": "1", "description": "<p>a</p>", "options": [{"id": "1-1"}, {"id": "1-2"}]}'), "https://x.test")
    listing = payloads.variant_listing(bronze(spark, '{"items": [{"uid": "1", "name": "n", "attributes": {"description": "<p>a</p>"}, "variants": [{"items": [{"uid": "2"}]}]}]}'), "https://x.test")
    assert [(r.product_id, r.description) for r in detail.orderBy("product_id").collect()] == [("1-1", "a"), ("1-2", "a")]
    assert [(r.product_id, r.parent_product_id, r.description) for r in listing.orderBy("product_id").collect()] == [("1", "1", "a"), ("2", "1", "a")]
    for rows in (detail, listing):
        plan = rows.select("product_id", "description")._jdf.queryExecution().optimizedPlan().toString()
        assert 0 <= plan.index("Generate") < plan.index("content_sections(")  # from the last step to the first


def test_pages_made_of_a_small_table_are_more_than_one_task(spark):
    from shelfwise.plans import payload_queries

    for pages in (payload_queries._variant_pages, payload_queries._product_pages):
        assert pages(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_an_export_computes_its_products_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def watched(x):
        read.add(1)
        return x

    rows = products(spark, [product("a", str(i)) for i in range(20)]).withColumn("product_name", watched("product_id"))
    counts = sinks.export_products(rows, str(tmp_path / "out"))
    assert [(r.site, r.products) for r in counts.collect()] == [("a", 20)] and read.value == 20
    assert readers.read_products_csv(spark, str(tmp_path / "out")).count() == 20


def test_a_large_day_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "POINTS", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a few rows would be one task again
    history = sinks.DayHistory(spark, str(tmp_path / "h"))
    rows = spark.range(40).selectExpr("'a' AS site", "cast(id AS string) AS product_id", "timestamp'2026-01-01' + make_interval(0, 0, 0, 0, id div 38 * 24) AS scraped_at", "1.5 AS selling_price")
    try:
        for _ in range(2):
            history.add(rows, POINTS)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {d: len([f for f in os.listdir(tmp_path / "h" / d) if f.endswith(".parquet")]) for d in os.listdir(tmp_path / "h") if d.startswith("day=")}
    assert files["day=2026-01-01"] > 1 and files["day=2026-01-02"] == 1
    assert history.read(POINTS).count() == history.read(POINTS).select("product_id").distinct().count() == 40
