import datetime as dt

from pyspark.sql import functions as F

from shelfwise.operators import changes
from shelfwise.plans import jobs
from shelfwise.schema import CATALOGUE_DDL, HISTORY_DDL, RUN_DDL
from shelfwise.sources.sinks import DayHistory
from shelfwise.sources.versions import VersionedTable
from tests.helpers import product, products, stored

GTIN = "8901030865275"
SERUM = "Niacinamide Face Serum 30 ml"
NOW = dt.datetime(2026, 8, 12)


def test_comparison_report(spark, tmp_path):
    own = products(spark, [product("own", "1", product_name=SERUM, selling_price=560.0)])
    others = products(spark, [product("x", "2", product_name=SERUM, selling_price=530.0), product("x", "3", product_name="Other Thing Entirely"), product("z", "4", brand="Else", product_name=SERUM)])
    out = jobs.compare_catalogues(others, own, "own", ["x"], brands=spark.createDataFrame([("minimalist",)], "brand string"))
    [row] = out["comparison"].collect()
    assert (row.brand, row.cheapest_platform, row.own_vs_cheapest) == ("Minimalist", "x", 30.0)
    assert out["review"].count() == 0 and [r.product_name for r in out["single_site"].collect()] == ["Other Thing Entirely"]
    assert [tuple(r) for r in out["by_platforms"].collect()] == [("own, x", 1)]
    jobs.write_comparison(out, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/comparison"), header=True).count() == 1


def test_barcode_jobs(spark):
    rows = products(spark, [product("a", "1", product_name=SERUM, product_attributes={"UPC": GTIN}), product("b", "2", product_name=SERUM), product("b", "3", product_name="Alone Here")])
    report, counts = jobs.gtin_report(rows, ["a", "b"])
    [r] = report.collect()
    assert (r.gtin, r.gtin_source, r.b_product_id) == (GTIN, "a", "2") and [tuple(c) for c in counts.collect()] == [("a", 1)]
    coded = rows.withColumn("gtin", F.when(F.col("site") == "a", GTIN).otherwise(""))
    fills, conflicts, summary = jobs.propagate_gtins(coded, donor_order=["a"])
    assert [(f.site, f.product_id) for f in fills.collect()] == [("b", "2")] and conflicts.count() == 0
    assert {s.site: (s.considered, s.filled) for s in summary.collect()} == {"a": (1, 0), "b": (2, 1)}
    captured = spark.createDataFrame([("b", "3", "8809416470009", 1), ("b", "3", GTIN, 0), ("b", "9", GTIN, 0)], "site string, product_id string, gtin string, ord int")
    table, found = jobs.fill_gtins(coded, "b", captured)
    assert {r.product_id: r.gtin for r in table.collect()} == {"1": GTIN, "2": GTIN, "3": "8809416470009"}
    assert {r.origin: r.found for r in jobs.found_by_origin(found).collect()} == {"page": 1, "borrowed": 1}


def test_incremental_run(spark, tmp_path):
    table, history = VersionedTable(spark, str(tmp_path / "t")), DayHistory(spark, str(tmp_path / "h"))
    table.write(stored(spark, [product("a", str(i), selling_price=5.0, description="d", image_urls=["u"]) | {"last_seen_run_id": "r0"} for i in range(3)]))
    listing = products(spark, [product("a", "0", selling_price=5.0), product("a", "1", selling_price=6.0), product("a", "new", selling_price=1.0)])
    details = products(spark, [product("a", "new", selling_price=1.0, description="fresh")])
    [c] = jobs.incremental_run("a", "r1", listing, details, table, history, F.lit(NOW), CATALOGUE_DDL, HISTORY_DDL).collect()
    assert (c.products_seen, c.products_new, c.products_changed, c.products_unchanged) == (3, 1, 1, 1)
    got = {r.product_id: r for r in table.read(CATALOGUE_DDL).collect()}
    assert got["1"].selling_price == 6.0 and got["1"].description == "d" and got["1"].last_changed_at == NOW and got["1"].detail_refresh_pending
    assert got["0"].last_seen_run_id == "r1" and got["0"].last_changed_at is None and got["2"].missing_run_count == 1
    assert got["new"].description == "fresh" and not got["new"].detail_refresh_pending and got["new"].first_seen_at == NOW
    assert sorted(r.product_id for r in history.read(HISTORY_DDL).collect()) == ["1", "new"]


def test_refresh_of_one_site(spark):
    known = stored(spark, [product("a", "1", product_name="N", description="d", image_urls=["u"])])
    listing = products(spark, [product("a", "1", product_name="N"), product("a", "2", product_name="M")])
    plan = changes.refresh_plan(listing, known, F.lit(NOW))
    old = known.select(listing.columns)
    snapshot = jobs.refresh_site("a", listing.withColumn("ord", F.lit(0)), listing.limit(0).withColumn("ord", F.lit(0)), old.withColumn("ord", F.lit(0)), plan)
    assert {r.product_id: r.description for r in snapshot.collect()} == {"1": "d", "2": ""}


def test_import_and_health(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    known = products(spark, [product("manual", "S1", product_name="Known")])
    sheet = spark.createDataFrame([(2, "S1", "B", "x"), (3, "S2", "B", "New"), (4, "", "", "y")], "line long, sku string, Vendor string, Title string")
    rows, counts = jobs.import_sheet(sheet, known, "manual")
    assert [r.product_id for r in rows.collect()] == ["S2"] and table.versions() == []
    assert {r.outcome: r.rows for r in counts.collect()} == {"inserted": 1, "product_id already stored": 1, "brand is blank": 1}
    jobs.import_sheet(sheet, known, "manual", dry_run=False, table=table)
    again, _ = jobs.import_sheet(sheet, table.read(), "manual")
    assert table.read().count() == 2 and again.count() == 0
    runs = spark.createDataFrame([("r", "manual", "success", NOW, None, 5, 0, 0, 0, 0, 0, 0, 0, "", "{}")], RUN_DDL)
    report = jobs.health_report(runs, known, ["manual", "other"], F.lit(NOW)).collect()
    assert {(r.site, r.check): r.level for r in report} == {("manual", "run"): "ok", ("manual", "data"): "ok", ("other", "run"): "alert", ("other", "data"): "alert"}
