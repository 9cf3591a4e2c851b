import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import catalogue, changes, dims, health, imports
from shelfwise.schema import HISTORY_DDL, RUN_DDL
from tests.helpers import product, products, stored

NOW = dt.datetime(2026, 8, 12)


def day(n):
    return NOW - dt.timedelta(days=n)


def test_dedup_merge(spark):
    rows = [
        product("A", "1", selling_price=800.0, categories=["B"], image_urls=["x", "y"], product_attributes={"k": "old", "o": "1"}, scraped_at=day(2)),
        product("a", "1", selling_price=700.0, categories=["A"], image_urls=["z", "x"], product_attributes={"k": "new"}, scraped_at=day(1)),
        product("a", "2", categories=None, image_urls=None, product_attributes=None),
    ]
    df = products(spark, [r | {"ord": i} for i, r in enumerate(rows)], ", ord int")
    for some in (df, df.orderBy(F.desc("ord"))):
        got = {r.product_id: r for r in catalogue.dedup_merge(some).collect()}
        assert got["1"].selling_price == 700.0 and got["1"].categories == ["A", "B"] and got["1"].image_urls == ["z", "x", "y"] and got["1"].product_attributes == {"k": "new", "o": "1"}
        assert got["2"].categories == [] and len(got) == 2


def test_upsert_keeps_absent_columns_and_is_idempotent(spark):
    table = stored(spark, [product("a", "1", description="text", selling_price=5.0)])
    new = spark.createDataFrame([("a", "1", 6.0), ("b", "1", 7.0)], "site string, product_id string, selling_price double")
    once = catalogue.upsert(table, new)
    got = {(r.site, r.product_id): (r.selling_price, r.description) for r in once.collect()}
    assert got == {("a", "1"): (6.0, "text"), ("b", "1"): (7.0, None)}
    assert sorted(map(str, catalogue.upsert(once, new).collect())) == sorted(map(str, once.collect()))


def test_rich_fields_are_never_blanked(spark):
    table = stored(spark, [product("a", "1", description="text", image_urls=["u"])])
    [r] = catalogue.preserve_rich_fields(products(spark, [product("a", "1", how_to_use="rub")]), table).collect()
    assert (r.description, r.image_urls, r.how_to_use) == ("text", ["u"], "rub")


def test_missing_products_age_only_in_whole_sweeps_and_once_a_run(spark):
    table = stored(spark, [product("a", str(i)) | {"last_seen_run_id": "old"} for i in range(3)] + [product("b", "9")])
    seen = products(spark, [product("a", "0")])
    rows, points = table.limit(0), spark.createDataFrame([], HISTORY_DDL)
    whole, _ = changes.incremental_sync(table, points, rows, points, seen, "a", "new", F.lit(NOW), True, 1)
    got = {(r.site, r.product_id): (r.missing_run_count, r.is_active) for r in whole.collect()}
    assert got == {("a", "0"): (0, True), ("a", "1"): (1, False), ("a", "2"): (1, False), ("b", "9"): (0, True)}
    part, _ = changes.incremental_sync(table, points, rows, points, seen, "a", "new", F.lit(NOW), False, 1)
    assert {r.missing_run_count for r in part.collect()} == {0}
    runs = catalogue.open_run(spark.createDataFrame([], RUN_DDL), "a", "new", F.lit(NOW))
    done = catalogue.close_run(runs, "new", "success", F.lit(NOW), products_seen=5, unknown=1)
    assert {r.missing_run_count for r in catalogue.age_missing_once(table, done, "a", "new").collect()} == {0}
    assert {r.missing_run_count for r in catalogue.age_missing_once(table, runs, "a", "new").where("site = 'a'").collect()} == {1}


def test_run_log(spark):
    old = spark.createDataFrame([("r0", "a", "running", day(1), None, 0, 0, 0, 0, 0, 0, 0, 0, "", "{}")], RUN_DDL)
    runs = {r.id: r for r in catalogue.close_run(catalogue.open_run(old, "a", "r1", F.lit(NOW)), "r1", "partial", F.lit(NOW), failures=2).collect()}
    assert runs["r0"].status == "failed" and runs["r1"].status == "partial" and runs["r1"].failures == 2
    with pytest.raises(ValueError):
        catalogue.close_run(old, "r0", "odd", F.lit(NOW))


def test_history_is_idempotent(spark):
    points = catalogue.history_rows(products(spark, [product("a", "1", selling_price=1.005), product("a", "1", selling_price=1.005)]))
    empty = points.limit(0)
    first = catalogue.append_history(empty, points)
    assert first.count() == 1 and catalogue.append_history(first, points).count() == 0


def test_images_and_reviews(spark):
    review = {"review_id": "r1", "title": "", "review": "good", "rating": 5.0, "reviewer": "x", "verified_buyer": True, "created_at": "", "likes": 0, "images": []}
    rows = products(spark, [product("a", "1", image_urls=["u", " ", "u", "v"], parent_product_id="P", top_reviews=[review, review | {"review_id": ""}]), product("a", "2", image_url="w", parent_product_id="P", top_reviews=[review]), product("a", "3")])
    assert sorted((r.product_id, r.position, r.url) for r in catalogue.images(rows).collect()) == [("1", 1, "u"), ("1", 2, "v"), ("2", 1, "w")]
    assert sorted((r.product_id, r.review_id) for r in catalogue.reviews(rows).collect()) == [("1", ""), ("1", "r1")]


def test_snapshot_and_patch(spark):
    table = products(spark, [product("shop1", "1"), product("shop2", "1")])
    got = catalogue.replace_site(table, products(spark, [product("shop2", "2")]), "shop2")
    assert sorted((r.site, r.product_id) for r in got.collect()) == [("shop1", "1"), ("shop2", "2")]
    assert {(r.rule, r.key) for r in catalogue.schema_violations(got.unionByName(got.limit(1)), ["shop1"]).collect()} >= {("site", "shop2")}


def test_refresh_reasons(spark):
    base = {"product_name": "N", "selling_price": 5.0, "description": "d", "image_urls": ["u"]}
    known = [
        product("a", "fresh", **base), product("a", "changed", **base), product("a", "blank", **(base | {"description": " "})), product("a", "gallery", **(base | {"image_urls": []})),
        product("a", "old", **(base | {"scraped_at": day(45)})), product("a", "recent", **(base | {"scraped_at": day(29)})), product("a", "no time", **(base | {"scraped_at": None})),
    ]
    listing = [product("a", r["product_id"], product_name="N", selling_price=6.0 if r["product_id"] == "changed" else 5.0) for r in known] + [product("a", "new")]
    plan = changes.refresh_plan(products(spark, listing), stored(spark, known), F.lit(NOW))
    want = {"fresh": "fresh", "changed": "changed", "blank": "incomplete", "gallery": "incomplete", "old": "stale", "recent": "fresh", "no time": "stale", "new": "new"}
    assert {r.product_id: r.reason for r in plan.collect()} == want
    assert {r.reason: r.products for r in changes.plan_counts(plan).collect()} == {"fresh": 2, "changed": 1, "incomplete": 2, "stale": 2, "new": 1}
    never = changes.refresh_plan(products(spark, listing), stored(spark, known), F.lit(NOW), refresh_days=0)
    assert {r.reason for r in never.where("product_id = 'old'").collect()} == {"fresh"}
    assert {r.reason for r in changes.refresh_plan(products(spark, listing), stored(spark, known), F.lit(NOW), enabled=False).collect()} == {"new"}
    versions = changes.stored_versions(plan, products(spark, listing), stored(spark, known))
    assert sorted(r.product_id for r in versions.collect()) == ["fresh", "recent"] and versions.first().description == "d"


def test_safety_gate(spark):
    table = stored(spark, [product("a", str(i)) for i in range(10)])
    some = products(spark, [product("a", str(i)) for i in range(4)])
    assert not changes.sweep_is_complete(some, table, "a") and changes.sweep_is_complete(some, table, "a", ratio=0.4)
    assert not changes.sweep_is_complete(some, table, "a", ratio=0.1, brand_filter=True)
    with pytest.raises(ValueError):
        changes.sweep_is_complete(some, table, "b")


RUN_NOW = dt.datetime(2026, 8, 18, 12)


@pytest.mark.parametrize("status, hours, finding", [("running", 19, "stuck"), ("success", 2, "ok"), ("failed", 1, "failed"), ("success", 40, "late"), (None, 0, "never ran")])
def test_run_health(spark, status, hours, finding):
    rows = [("r", "a", status, RUN_NOW - dt.timedelta(hours=hours), None, 5, 0, 0, 0, 0, 0, 0, 0, "", "{}")] if status else []
    [r] = health.run_health(spark.createDataFrame(rows, RUN_DDL), ["a"], F.lit(RUN_NOW)).collect()
    assert r.finding == finding and r.level == ("ok" if finding == "ok" else "alert")


def test_freshness(spark):
    table = products(spark, [product("a", "1", scraped_at=RUN_NOW - dt.timedelta(hours=2)), product("b", "1", scraped_at=RUN_NOW - dt.timedelta(hours=72))])
    assert {r.site: r.level for r in health.data_freshness(table, ["a", "b", "c"], F.lit(RUN_NOW)).collect()} == {"a": "ok", "b": "alert", "c": "alert"}


def test_sweep_audit(spark):
    pages = [("end", 1, ["1"], False, False), ("end", 2, ["2"], True, False), ("empty", 1, ["1"], False, False), ("empty", 2, [], False, False), ("fail", 1, ["1"], False, False), ("fail", 2, None, False, True), ("open", 1, ["1"], False, False), *[("rep", i, ["7"], False, False) for i in (1, 2, 3)]]
    df = spark.createDataFrame([("s", *p) for p in pages], "site string, category string, page_no int, ids array<string>, reported_end boolean, failed boolean")
    got = {r.category: (r.stop_reason, r.completed, r.next_page) for r in health.sweep_audit(df).collect()}
    assert got == {"end": ("end_of_results", True, 3), "empty": ("empty_page", True, 3), "fail": ("request_failed", False, 2), "open": ("open", False, 2), "rep": ("repeated_pages", True, 4)}
    assert sorted((r.category, r.page_no) for r in health.duplicate_pages(df).collect()) == [("rep", 2), ("rep", 3)]


def test_dashboard(spark):
    table = products(spark, [product("a", "1", discount_pct=10.0, in_stock=True, categories=["X"]), product("a", "2", discount_pct=None, in_stock=None, brand="B", categories=["Y"])])
    [r] = health.kpis(table).collect()
    assert tuple(r) == (2, 2, 10.0, 100.0)
    assert [x.categories for x in health.options(table, "categories").collect()] == ["X", "Y"]
    assert health.filtered_view(table, ["X"], ["Minimalist"]).count() == 1 and health.filtered_view(table, [], ["B"]).count() == 0


def test_sheets(spark):
    sheet = spark.createDataFrame([(2, "H", "Serum", "V", "30 ml", "₹499", "699", "TRUE"), (3, "", "  ", "V", "", "5", "", "")], "line long, Handle string, Title string, Vendor string, `Option1 Value` string, `Variant Price` string, `Variant Compare At Price` string, Available string")
    [r] = imports.own_catalogue(sheet, "own").collect()
    assert (r.product_id, r.mrp, r.selling_price, r.discount_pct, r.in_stock, r.variant) == ("H", 699.0, 499.0, 28.61, True, "30 ml")
    with pytest.raises(ValueError, match="selling_price"):
        imports.own_catalogue(sheet.drop("Variant Price"), "own")
    manual = spark.createDataFrame([(2, "", "N"), (3, "B", " "), (4, "B", "N")], "line long, Vendor string, Title string")
    assert [r.reject_reason for r in imports.manual_rows(manual, "m").orderBy("line").collect()] == ["brand is blank", "product name is blank", None]


def test_chains_of_duplicates_in_a_sheet(spark):
    rows = [(1, "x", "A", "n1"), (2, "x", "A", "n2"), (3, "y", "A", "n2"), (4, "y", "A", "n3"), (5, "z", "A", "n1"), (6, "s", "Q", "q"), (7, "t", "St", "ored")]
    sheet = spark.createDataFrame([(i, "m", p, b, n) for i, p, b, n in rows], "line long, site string, product_id string, brand string, product_name string")
    known = spark.createDataFrame([("m", "s", "", ""), ("m", "other", "ST", "Ored!")], "site string, product_id string, brand string, product_name string")
    got = {r.line: r.outcome for r in imports.select_new(sheet, known).collect()}
    assert got == {1: None, 2: "duplicate product_id in the sheet", 3: None, 4: "duplicate product_id in the sheet", 5: "duplicate brand and name in the sheet", 6: "product_id already stored", 7: "brand and name already stored"}


def test_dimensions(spark):
    brands = spark.createDataFrame([("COSRX",), ("The Derma",), ("The Derma Co",)], "brand string")
    slugs = spark.createDataFrame([(1, "cosrx-snail-100-ml"), (2, "the-derma-co-serum"), (3, "cosrxian-cream"), (4, "")], "id long, slug string")
    assert {r.id: r.brand for r in dims.brand_by_slug(slugs, brands).collect()} == {1: "COSRX", 2: "The Derma Co", 3: "", 4: ""}
    title = spark.createDataFrame([(1, "The Derma Co 1% Serum"), (2, "None of them")], "id long, title string")
    assert {r.id: r.brand for r in dims.brand_by_title(title, brands).collect()} == {1: "The Derma Co", 2: ""}
    categories = spark.createDataFrame([(0, "Serums", "face serum skincare"), (1, "Toners", "toner mist"), (2, "Vague", "skin care face")], "place int, name string, query string")
    rows = products(spark, [product("a", "1", product_name="Glow Serum Mist"), product("a", "2", product_name="Skin care")]).drop("categories")
    assert {r.product_id: r.categories for r in dims.infer_categories(rows, categories).collect()} == {"1": ["Serums", "Toners"], "2": []}
    dim = spark.createDataFrame([("All", True, ["A", "B"]), ("A", True, None), ("B", False, None), ("C", True, None)], "name string, enabled boolean, covers array<string>")
    assert sorted(r.name for r in dims.select_categories(dim).collect()) == ["All", "C"] and [r.name for r in dims.select_categories(dim, ["a"]).collect()] == ["A"]
    with pytest.raises(ValueError, match="zzz"):
        dims.select_categories(dim, ["zzz"])


def test_files_of_a_sheet_and_equal_lines(spark, tmp_path):
    from shelfwise.sources import readers

    folder = tmp_path / "sheet"
    folder.mkdir()
    (folder / "a.csv").write_text("Vendor,Title,Id,Price\nV,One,a,1\nV,Two,c,1\n")
    (folder / "b.csv").write_text("Vendor,Title,Id,Price\nV,Three,a,1\nV,Four,d,1\nV,Two,e,1\n,,,\n")
    sheet = readers.read_sheet(spark, str(folder)).repartition(5)
    assert sorted((r.file[-5:], r.line, r.ordinal) for r in sheet.collect()) == [("a.csv", 2, 2), ("a.csv", 3, 3), ("b.csv", 2, 4), ("b.csv", 3, 5), ("b.csv", 4, 6), ("b.csv", 5, 7)]
    known = spark.createDataFrame([], "site string, product_id string, brand string, product_name string")
    new, outcomes = imports.import_sheet(sheet, known, "m")
    assert sorted(r.product_id for r in new.collect()) == ["a", "c", "d"]
    why = {(r.file[-5:], r.line): r.outcome for r in outcomes.collect() if r.outcome}
    assert why == {("b.csv", 2): "duplicate product_id in the sheet", ("b.csv", 4): "duplicate brand and name in the sheet", ("b.csv", 5): "brand is blank"}
    with pytest.raises(ValueError, match="line"):
        imports.import_sheet(sheet.drop("file"), known, "m")
    own = imports.own_catalogue(sheet.drop("Id"), "own")
    assert sorted(r.product_id for r in own.collect()) == ["2", "3", "4", "5", "6"]


def test_keywords_are_looked_for_in_values_only(spark):
    rows = spark.createDataFrame([(1, "Red Apple", ["x", "Deep"], {"kind": "Soft"}, ("inner",)), (2, None, [], {}, (None,))], "id int, type string, tags array<string>, attrs map<string,string>, s struct<field:string>")
    ids = lambda *words: [r.id for r in dims.keyword_filter(rows, words).collect()]
    assert ids("type") == ids("tags", "kind", "field") == [] and ids(" RED a") == ids("deep") == ids("soft") == ids("INNER") == [1]
    assert ids() == ids("", " ") == [1, 2] and ids(*[f"none{i}" for i in range(40)]) == [] and ids(*[f"none{i}" for i in range(40)], "apple") == [1]


def test_many_words(spark, monkeypatch):
    words = spark.range(50_000).select(F.concat(F.lit("w"), "id", F.lit("x")).alias("word"))
    rows = spark.createDataFrame([(1, "a w7x b w49999xw7x"), (2, None), (3, "w50000x")], "id int, t string")
    for size in (1 << 26, 1 << 20):
        monkeypatch.setattr(dims, "WORD_BYTES", size)
        assert {r.id: r.found for r in dims.find_words(rows, F.col("t"), words, "found").collect()} == {1: ["w49999x", "w7x"], 2: [], 3: []}
    assert dims.find_words(rows, F.col("t"), words.where("false"), "found").where("size(found) > 0").count() == 0


def test_families_through_cycles_and_better_roots(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("r", "c"), ("x", "y")], "id string, variant string")
    roots = spark.createDataFrame([("a", 2, ["A"]), ("r", 1, ["R"]), ("x", 3, [])], "id string, ord int, labels array<string>")
    got = {r.id: (r.parent, r.labels) for r in dims.variant_families(edges, roots).collect()}
    assert got == {"a": ("r", ["A", "R"]), "b": ("r", ["A", "R"]), "c": ("r", ["A", "R"]), "r": ("r", ["R"]), "x": ("x", []), "y": ("x", [])}
    assert dims.variant_families(edges, roots.limit(0)).count() == 0


def test_only_touched_parts_are_read_and_written(spark, tmp_path):
    from shelfwise.sources import sinks

    ddl, path = "product_id string, selling_price double, description string, site string", f"file://{tmp_path}/table"
    rows = spark.range(400).select(F.col("id").cast("string").alias("product_id"), F.lit(1.0).alias("selling_price"), F.lit("d").alias("description"), F.when(F.col("id") < 200, "a").otherwise("b").alias("site"))
    sinks.upsert_parts(spark, path, rows, ddl, 8)
    before = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    new = spark.createDataFrame([("5", 2.0, "a"), ("new", 3.0, "a")], "product_id string, selling_price double, site string")
    plan = sinks.touched_parts(sinks.read_parts(spark, path, ddl), new, 8)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    for _ in range(2):  # again: nothing changes
        sinks.upsert_parts(spark, path, new, ddl, 8)
    after = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    parts = {f"bucket={r.bucket}" for r in sinks.with_bucket(new, 8).collect()}
    assert {f for f in before if after.get(f) != before[f]} == {f for f in before if "site=a" in str(f) and f.parent.name in parts}
    table = {r.product_id: r for r in sinks.read_parts(spark, path, ddl).collect()}
    assert len(table) == 401 and table["5"].selling_price == 2.0 and table["5"].description == "d" and table["new"].description is None


def test_a_history_by_day_reads_the_days_of_the_batch(spark, tmp_path):
    from shelfwise.sources import sinks

    path, ddl = f"file://{tmp_path}/history", "site string, product_id string, scraped_at timestamp, selling_price double"
    point = lambda day, price: ("a", "1", dt.datetime(2024, 1, day), price)
    batch = lambda *rows: spark.createDataFrame(rows, ddl)
    sinks.append_days(spark, path, batch(point(1, 1.0), point(2, 2.0)), ddl)
    files = set(tmp_path.rglob("*.parquet"))
    sinks.append_days(spark, path, batch(point(2, 9.0), point(3, 3.0), point(3, 4.0)), ddl)
    assert sorted((r.day.day, r.selling_price) for r in spark.read.parquet(path).collect()) == [(1, 1.0), (2, 2.0), (3, 4.0)]
    assert {f.parent.name for f in set(tmp_path.rglob("*.parquet")) - files} == {"day=2024-01-03"}


def test_merged_values_of_a_product(spark):
    rows = products(spark, [
        product("A", "1", categories=["b", "a"], image_urls=["x", "y"], product_attributes={"k": "old", "z": "1"}, selling_price=1.0, scraped_at=dt.datetime(2024, 1, 1)),
        product("a", "1", categories=["c", "a"], image_urls=["z", "y"], product_attributes={"k": "new"}, selling_price=2.0, scraped_at=dt.datetime(2024, 1, 2)),
        product("a", "1", categories=None, image_urls=None, product_attributes=None, selling_price=3.0, scraped_at=dt.datetime(2024, 1, 3)), product("b", "2", categories=None, image_urls=[], product_attributes=None),
    ])
    got = {r.product_id: r for r in catalogue.dedup_merge(rows, order=["scraped_at"]).collect()}
    assert (got["1"].selling_price, got["1"].categories, got["1"].image_urls, got["1"].product_attributes) == (3.0, ["a", "b", "c"], ["z", "y", "x"], {"k": "new", "z": "1"})
    assert (got["2"].categories, got["2"].image_urls, got["2"].product_attributes) == ([], [], {})


def test_complete_recent_judges_each_row_where_it_lies(spark):
    table = stored(spark, [product("a", "1", description="text", scraped_at=day(1)), product("a", "2", description="", scraped_at=day(1)), product("a", "3", description="text", scraped_at=day(40)), product("a", None, description="text", scraped_at=day(1))])
    now = F.lit(NOW)
    kept = changes.complete_recent(table, now, 30, ("description",))
    plan = changes.refresh_plan(table, table, now, 30, ("description",)).where("NOT needed")
    assert [r.product_id for r in kept.collect()] == [r.product_id for r in plan.collect()] == ["1"] and kept.columns == table.columns
    assert "Join" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert changes.complete_recent(table, now, 30, ("description",), enabled=False).count() == 0
