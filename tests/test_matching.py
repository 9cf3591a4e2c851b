import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import barcodes, comparison, matching
from tests.helpers import product, products

GTIN, OTHER = "8901030865275", "8809416470009"


def edge(spark, left, right, threshold=0.0):
    rows = products(spark, [product("a", "1", **left), product("b", "2", **right)])
    found = matching.score_edges(matching.prepare(rows, ["a", "b"]), threshold).collect()
    return found[0] if found else None


@pytest.mark.parametrize("left, right, low, high, method", [
    ({"product_name": "Vitamin C Serum", "gtin": GTIN}, {"product_name": "Entirely Other Words", "gtin": GTIN}, 1.0, 1.0, "gtin"),
    ({"product_name": "Vitamin C Serum", "gtin": GTIN}, {"product_name": "Vitamin C Serum", "gtin": OTHER}, None, None, None),
    ({"product_name": "Vitamin C Serum"}, {"product_name": "Vitamin C Serum", "brand": "Other"}, None, None, None),
    ({"product_name": "Light Fluid Sunscreen SPF 50 50 g"}, {"product_name": "Light Fluid Cream 50 g"}, None, None, None),
    ({"product_name": "Retinol Night Serum 0.3% 30 ml"}, {"product_name": "Retinol Night Serum 0.6% 30 ml"}, None, None, None),
    ({"product_name": "Retinol Night Serum 30 ml"}, {"product_name": "Retinol Night Serum 10 ml"}, None, None, None),
    ({"product_name": "Barrier Repair Cream 50 g"}, {"product_name": "Barrier Repair Cream 50.0 g"}, 0.9, 1.0, "name"),
    ({"product_name": "Niacinamide Face Serum 30 ml"}, {"product_name": "Niacinamide Face Serum for oily acne marks 30 ml"}, 0.7, 1.0, "name"),
    ({"product_name": "Retinol Night Serum Combo"}, {"product_name": "Retinol Night Serum"}, None, None, None),
])
def test_scores(spark, left, right, low, high, method):
    got = edge(spark, left, right)
    assert (got is None) == (low is None)
    if got:
        assert low <= got.confidence <= high and got.method == method


def test_a_missing_size_lowers_the_score_and_is_noted(spark):
    whole = edge(spark, {"product_name": "Retinol Night Serum 30 ml"}, {"product_name": "Retinol Night Serum 30 ml"})
    part = edge(spark, {"product_name": "Retinol Night Serum 30 ml"}, {"product_name": "Retinol Night Serum"})
    assert part.confidence < whole.confidence and part.notes == ["size missing on one side"] and whole.notes == []


def greedy(edges, order):
    """The walk: items in order, best free partner on each later site, ties to the first."""
    used, out = set(), set()
    for a in order:
        if a in used:
            continue
        best = {}
        for (x, y), conf in edges.items():
            if x == a and y not in used:
                now = best.get(y[0])
                if now is None or (-conf, order.index(y)) < now[:2]:
                    best[y[0]] = (-conf, order.index(y), y)
        for _, _, y in best.values():
            used.add(y)
            out.add((a, y))
        if best:
            used.add(a)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_assignment_equals_the_walk(spark, seed):
    rng = random.Random(seed)
    order = [(s, str(i)) for s in "abcd" for i in range(rng.randrange(3, 8))]
    edges = {(x, y): rng.choice([0.7, 0.8, 0.8, 0.9, 1.0]) for x in order for y in order if x[0] < y[0] and rng.random() < 0.4}
    rows = [(x, y, x[0], y[0], (order.index(x),), (order.index(y),), c, "name", []) for (x, y), c in edges.items()]
    item = "struct<site:string,product_id:string>"
    df = spark.createDataFrame(rows, f"left {item}, right {item}, l_site string, r_site string, l_ord struct<o:int>, r_ord struct<o:int>, confidence double, method string, notes array<string>")
    got = [(tuple(r.left), tuple(r.right)) for r in matching.assign(df).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(edges, order)


def test_assignment_of_more_equal_rows_than_1000(spark):
    n = 1100
    side = lambda p, site: spark.range(n).select(F.struct(F.lit(site).alias("site"), F.col("id").cast("string").alias("product_id")).alias(p[0]), F.lit(site).alias(f"{p[1]}_site"), F.struct(F.col("id")).alias(f"{p[1]}_ord"))
    df = side(("left", "l"), "a").crossJoin(side(("right", "r"), "b")).select("left", "right", "l_site", "r_site", F.struct(F.struct(F.lit(0)), "l_ord").alias("l_ord"), F.struct(F.struct(F.lit(1)), "r_ord").alias("r_ord"), F.lit(0.9).alias("confidence"), F.lit("name").alias("method"), F.array().cast("array<string>").alias("notes"))
    got = [(r.left.product_id, r.right.product_id) for r in matching.assign(df).collect()]
    assert sorted(got) == sorted((str(i), str(i)) for i in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_assignment_of_groups_of_equal_rows_equals_the_walk(spark, seed):
    rng = random.Random(seed)
    order = [(s, str(i)) for s in "abc" for i in range(12)]
    kind = {x: rng.randrange(3) for x in order}
    edges = {(x, y): 0.7 + 0.1 * (kind[x] == kind[y]) for x in order for y in order if x[0] < y[0] and (kind[x] + kind[y]) % 3 and rng.random() < [1, 0.97, 0.9][seed]}
    rows = [(x, y, x[0], y[0], (order.index(x),), (order.index(y),), c, "name", []) for (x, y), c in edges.items()]
    item = "struct<site:string,product_id:string>"
    df = spark.createDataFrame(rows, f"left {item}, right {item}, l_site string, r_site string, l_ord struct<o:int>, r_ord struct<o:int>, confidence double, method string, notes array<string>")
    got = [(tuple(r.left), tuple(r.right)) for r in matching.assign(df).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(edges, order)


def test_assignment_of_classes_equals_the_walk(spark):
    rng = random.Random(1)
    words = ["Retinol Night Serum", "Retinol Night Cream Rich", "Night Serum Retinol Plus", "Barrier Repair Balm", "Barrier Repair Balm Soft"]
    rows = [product(s, f"{s}{i:03}", product_name=f"{rng.choice(words)} {rng.choice(['', '30 ml', '50 ml'])}", brand=rng.choice(["One", "Two"]), gtin=rng.choice(["", "", "", GTIN, OTHER])) for s in "abc" for i in range(25)]
    items = matching.stored(matching.prepare(products(spark, rows), ["a", "b", "c"]))
    classes = matching.stored(matching.item_classes(items))
    assert classes.agg(F.sum("members")).first()[0] == len(rows) > classes.count()
    found = matching.class_edges(classes, 0.5)
    edges = {(tuple(r.left), tuple(r.right)): r.confidence for r in matching.score_edges(items, 0.5).collect()}
    assert len(edges) == found.agg(F.sum("links")).first()[0] > 200
    order = [tuple(r.item) for r in items.orderBy("ord").select("item").collect()]
    want = greedy(edges, order)
    for group in (1_000, 20, 2):  # whole brands, components, and rounds for all but the smallest
        got = [(tuple(r.left), tuple(r.right)) for r in matching.assign_classes(items, found, group).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_many_equal_titles_are_one_edge(spark):
    n = 100_000
    one = products(spark, [product("x", "x", product_name="Retinol Night Serum 30 ml")])
    rows = spark.range(n).crossJoin(spark.createDataFrame([("a",), ("b",)], "at string")).crossJoin(F.broadcast(one)).withColumns({"site": F.col("at"), "product_id": F.format_string("%06d", "id")}).select(one.columns)
    items = matching.stored(matching.prepare(rows, ["a", "b"]))
    edges = matching.stored(matching.class_edges(matching.item_classes(items)))
    assert [r.links for r in edges.collect()] == [n * n]
    found = matching.assign_classes(items, edges)
    assert found.count() == n and found.where("left.product_id <> right.product_id").count() == 0


def test_barcodes_of_their_own_make_no_more_edges(spark):
    n = 300
    rows = [product(s, f"{i:03}", product_name=SERUM, gtin=f"{i:07}{(10 - sum(int(c) * (3 if j % 2 == 0 else 1) for j, c in enumerate(f'{i:07}')) % 10) % 10}" if s == "a" else "") for s in "ab" for i in range(1, n + 1)]
    items = matching.stored(matching.prepare(products(spark, rows), ["a", "b"]))
    edges = matching.stored(matching.title_edges(matching.title_classes(items)))
    assert items.where("gtin <> ''").count() == n and [r.links for r in edges.collect()] == [n * n]
    got = [(r.left.product_id, r.right.product_id) for r in matching.assign_classes(items, edges).collect()]
    assert sorted(got) == [(f"{i:03}", f"{i:03}") for i in range(1, n + 1)]


def test_best_edges_are_the_best_of_all_edges(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 2)
    rng = random.Random(5)
    words = ["Retinol Night Serum", "Retinol Night Serum Plus", "Night Serum Retinol Rich"]
    rows = [product(s, f"{s}{i:02}", product_name=rng.choice(words), gtin=rng.choice(["", "", GTIN, OTHER])) for s in "abc" for i in range(12)]
    items = matching.stored(matching.prepare(products(spark, rows), ["a", "b", "c"]))
    all_edges = matching.score_edges(items).collect()
    classes = matching.class_edges(matching.item_classes(items))
    assert len(all_edges) == len({(r.left, r.right) for r in all_edges}) == classes.agg(F.sum("links")).first()[0]
    want = {}
    for r in sorted(all_edges, key=lambda r: (-r.confidence, r.r_ord)):
        want.setdefault((r.left, r.r_site), (r.right, r.confidence, r.method))
    assert {(r.left, r.r_site): (r.right, r.confidence, r.method) for r in matching.best_edges(items).collect()} == want


def test_no_edges(spark):
    items, groups, rest = matching.match_products(products(spark, [product("a", "1", product_name="One Thing"), product("", "3", product_name="No Site")]))
    assert groups.count() == 0 and rest.count() == 1 and items.count() == 1
    assert matching.match_products(products(spark, []))[1].count() == 0


SERUM = "Niacinamide Face Serum 30 ml"


def test_comparison(spark):
    rows = [product("own", "1", product_name=SERUM, selling_price=560.0), product("x", "2", product_name=SERUM, selling_price=530.0), product("y", "3", product_name=SERUM, selling_price=610.0), product("y", "4", product_name="Something Else Altogether", selling_price=1.0)]
    _, groups, rest = matching.match_products(products(spark, rows), order=["own", "x", "y"])
    [row] = comparison.comparison_rows(groups, ["own", "x", "y"], "own").collect()
    assert (row.min_price, row.price_gap, row.cheapest_platform, row.own_vs_cheapest, row.platforms) == (530.0, 80.0, "x", 30.0, "own, x, y")
    assert row.x_name == SERUM and row.platform_count == 3 and row.size == "30ml"
    assert [r.product_name for r in comparison.single_site_rows(rest).collect()] == ["Something Else Altogether"]
    assert {r.site for r in matching.matches_on(groups, ["own", "y"]).collect()} == {"own", "x", "y"}
    assert matching.matches_on(groups, ["own", "z"]).count() == 0


def test_a_row_is_used_once(spark):
    rows = [product("a", "1", product_name=SERUM), product("a", "2", product_name=SERUM + " new"), product("b", "3", product_name=SERUM)]
    _, groups, rest = matching.match_products(products(spark, rows), order=["a", "b"])
    assert groups.count() == 2 and rest.count() == 1


def test_propagation(spark):
    rows = [product("a", "1", product_name=SERUM, gtin=GTIN), product("b", "2", product_name=SERUM), product("c", "3", product_name=SERUM)]
    fills, conflicts = barcodes.propagate(products(spark, rows), 0.9, ["a", "b", "c"], ["a"])
    assert {(r.site, r.gtin, r.donor_site) for r in fills.collect()} == {("b", GTIN, "a"), ("c", GTIN, "a")} and conflicts.count() == 0
    patched = barcodes.apply_fills(products(spark, rows), fills)
    assert [r.gtin for r in patched.orderBy("site").collect()] == [GTIN] * 3


def test_different_barcodes_around_a_blank_are_a_conflict(spark):
    rows = [product("a", "1", product_name=SERUM), product("b", "2", product_name=SERUM, gtin=GTIN), product("c", "3", product_name=SERUM, gtin=OTHER)]
    fills, conflicts = barcodes.propagate(products(spark, rows), 0.9, ["a", "b", "c"])
    [c] = conflicts.collect()
    assert fills.count() == 0 and (c.left_site, c.left_gtin, c.right_site, c.right_gtin) == ("b", GTIN, "c", OTHER)


def test_backfill_targets_and_cross_fill(spark):
    rows = products(spark, [product("a", "1", product_attributes={"UPC": GTIN}), product("a", "2", product_name=SERUM), product("a", "3", gtin=GTIN), product("a", "4", product_attributes={"x": "y"}), product("b", "5", product_name=SERUM, gtin=OTHER)])
    offline, pages = barcodes.sweep_targets(rows.where("site = 'a'"))
    assert [r.product_id for r in offline.collect()] == ["1"] and [r.product_id for r in pages.collect()] == ["2"]
    assert [(r.product_id, r.gtin) for r in barcodes.cross_fill(rows, "a").collect()] == [("2", OTHER)]
    brands = spark.createDataFrame([(" minimalist. ",)], "brand string")
    assert barcodes.allow_brands(rows, brands).count() == 5 and barcodes.allow_brands(rows, brands.where("false")).count() == 5
    assert barcodes.allow_brands(rows.withColumn("brand", F.lit("Other")), brands).count() == 0


def test_agreeing_sizes_share_or_neighbour_a_bucket(spark):
    rng = random.Random(3)
    rows = [(x, x + rng.uniform(-1, 1) * max(0.5, 0.02 * x)) for x in [rng.uniform(0.6, 400) for _ in range(3000)] + [24.6, 24.9, 25.0, 25.1]]
    df = spark.createDataFrame(rows, "a double, b double").where(matching.titles.amounts_agree(F.col("a"), F.col("b")))
    assert df.count() > 2500 and df.where(F.abs(matching.size_bucket(F.col("a")) - matching.size_bucket(F.col("b"))) > 1).count() == 0


def test_sweep_targets_are_told_row_by_row(spark):
    rows = products(spark, [product("a", "1", product_attributes={"UPC": GTIN}), product("a", "2"), product("a", "3", gtin=GTIN), product("a", "4", product_attributes={"x": "y"})])
    for recheck, want in ((False, ["2"]), (True, ["2", "4"])):
        offline, pages = barcodes.sweep_targets(rows, recheck=recheck)
        assert [r.product_id for r in offline.collect()] == ["1"] and sorted(r.product_id for r in pages.collect()) == want
        assert "Join" not in pages._jdf.queryExecution().optimizedPlan().toString()


def test_a_class_is_named_in_16_bytes_and_a_title_is_one_on_all_sites(spark):
    rows = [product(s, f"{s}{i}", product_name=SERUM, gtin=GTIN if s == "a" else "") for s in "abc" for i in range(2)]
    classes = matching.with_class(matching.prepare(products(spark, rows), ["a", "b", "c"])).select(F.length(F.col("cls").cast("binary")).alias("n"), "cls", "title").collect()
    assert {r.n for r in classes} == {16} and len({bytes(r.cls) for r in classes}) == 3 and len({bytes(r.title) for r in classes}) == 1


def test_groups_leave_out_what_only_edges_read(spark):
    rows = [product("a", "1", product_name=SERUM), product("b", "2", product_name=SERUM)]
    _, groups, _ = matching.match_products(products(spark, rows), order=["a", "b"])
    assert groups.count() == 2 and not {"tokens", "ord", "strengths"} & set(groups.columns)


def test_the_walk_by_titles_equals_the_walk_over_edges():
    for seed in range(60):
        rng = random.Random(seed)
        n, titles = rng.randrange(0, 40), rng.randrange(1, 7)
        at = sorted(rng.randrange(4) for _ in range(n))
        sites = [sorted(set(at)).index(s) for s in at]
        titled, codes = [rng.randrange(titles) for _ in range(n)], [rng.choice([-1, -1, 0, 1, 2]) for _ in range(n)]
        pairs = {(a, b): c for a in range(titles) for b in range(a, titles) if (c := rng.choice([0, 0.7, 0.8, 0.8, 1.0]))}
        pairs |= {(b, a): c for (a, b), c in pairs.items()}
        edges = {}
        for i, j in ((i, j) for i in range(n) for j in range(n) if sites[i] < sites[j]):
            both = codes[i] >= 0 and codes[j] >= 0
            if both and codes[i] == codes[j] or not both and (titled[i], titled[j]) in pairs:
                edges[(sites[i], i), (sites[j], j)] = 1.0 if both else pairs[titled[i], titled[j]]
        names = rng.sample(list(pairs), len(pairs)) + [(-1, 0), (0, titles)]  # titles without items too
        left, right = (np.array([p[k] for p in names], "i4") for k in (0, 1))
        got = list(matching.walk(np.array(titled, "i4"), np.array(sites, "i4"), np.array(codes, "i4"), left, right, np.array([pairs.get(p, 0.9) for p in names])))
        want = greedy(edges, [(s, i) for i, s in enumerate(sites)])
        assert len(got) == len(want) and {((sites[a], a), (sites[b], b)) for a, b, _ in got} == want
        assert all(codes[a] == codes[b] >= 0 if e < 0 else names[e] == (titled[a], titled[b]) for a, b, e in got)


def test_the_walk_holds_numbers_alone():
    rng, n = np.random.default_rng(1), 40_000
    sites, titled = np.repeat(np.arange(5), n // 5).astype("i4"), np.tile(np.sort(rng.integers(0, 400, n // 5)), 5).astype("i4")
    left, right = (rng.integers(0, 400, 8_000).astype("i4") for _ in "lr")
    tracemalloc.start()
    assert sum(1 for _ in matching.walk(titled, sites, np.where(rng.random(n) < 0.5, -1, rng.integers(0, 9_000, n)).astype("i4"), left, right, rng.choice([0.7, 0.8], 8_000))) > n / 2
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 * n  # bytes


def test_titles_are_paired_once_however_many_sites_and_barcodes(spark):
    rows = [product(s, f"{s}{i}", product_name=SERUM + extra, gtin=gtin) for s in "abcd" for i, (extra, gtin) in enumerate([("", ""), ("", GTIN if s == "a" else OTHER), (" plus", "")])]
    items = matching.stored(matching.prepare(products(spark, rows), list("abcd")))
    named = matching.with_class(items.where("bkey <> ''"))
    pairs = matching.stored(matching.title_pairs(named, 0.5))
    assert pairs.count() == 4 and matching.title_edges(matching.title_classes(items), 0.5).count() > 40
    want = greedy({(tuple(r.left), tuple(r.right)): r.confidence for r in matching.score_edges(items, 0.5).collect()}, [tuple(r.item) for r in items.orderBy("ord").select("item").collect()])
    for group in (1_000, 2):
        assert {(tuple(r.left), tuple(r.right)) for r in matching.assign_titles(items, pairs, group).collect()} == want


def test_best_edges_need_no_edges_of_classes(spark, monkeypatch):
    rng = random.Random(8)
    words = ["Retinol Night Serum", "Retinol Night Serum Plus", "Night Serum Retinol Rich"]
    rows = [product(s, f"{s}{i:02}", product_name=rng.choice(words), gtin=rng.choice(["", "", GTIN, OTHER]), brand=rng.choice(["One", "Two"])) for s in "abcd" for i in range(8)]
    rows += [product(r["site"], r["product_id"], product_name=words[1], brand="One") for r in rows[:5]]  # ids that two rows have
    items = matching.stored(matching.prepare(products(spark, rows), list("dbca")))
    want = {}
    for r in sorted(matching.score_edges(items).collect(), key=lambda r: (-r.confidence, r.r_ord)):
        want.setdefault((r.left, r.r_site), (r.right, r.confidence, r.method, r.notes, r.r_ord))
    monkeypatch.setattr(matching, "title_edges", None)
    monkeypatch.setattr(matching, "_same_codes", None)
    got = matching.best_edges(items).collect()
    assert len(got) == len(want) > 40 and {(r.left, r.r_site): (r.right, r.confidence, r.method, r.notes, r.r_ord) for r in got} == want
    assert all(r.l_site == r.left.site for r in got)
