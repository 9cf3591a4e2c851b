import duckdb

import __spark_entry__


def test_gtin_check_equals_its_sql_for_keys_of_seven_digits(spark, tmp_path):
    """'B0' and a key of seven digits are eight digits, of which a tenth has a right check digit."""
    n, first = 200, 1_000_000
    con = duckdb.connect()
    con.sql(f"SELECT {first} + i AS p_partkey, 'large ring' AS p_name, 'Brand#7' AS p_brand, 'LARGE' AS p_type, 1 AS p_size, 900.0 AS p_retailprice FROM range({n}) r(i)").write_parquet(str(tmp_path / "part.parquet"))
    con.sql(f"SELECT i AS l_orderkey, {first} + i AS l_partkey, i AS l_suppkey, 1 AS l_linenumber, 0.05 AS l_discount, 'O' AS l_linestatus, DATE '2000-01-01' AS l_shipdate FROM range({n}) r(i)").write_parquet(str(tmp_path / "lineitem.parquet"))
    for t in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    got = sorted(tuple(r) for r in __spark_entry__.queries()["gtin_check"](spark, str(tmp_path)).collect())
    want = sorted(con.sql(__spark_entry__.oracle_sql()["gtin_check"]).fetchall())
    assert got == want and any(raw.startswith("B0") and gtin for _, raw, gtin, _ in got)


def test_the_latest_lines_are_chosen_before_they_meet_their_parts(spark):
    """The same rows as choosing among all observations, and the join comes after a choice among the lines."""
    from shelfwise.operators import catalogue
    from shelfwise.plans import catalogue_queries as q

    folder = "/root/testdata/sf0.001"
    rows = q.obs(spark, folder)
    early, late = q._split(spark, folder)
    pairs = ((q.latest(spark, folder), rows), (early, rows.where(f"scraped_at < '{q.CUT}'")), (late, rows.where(f"scraped_at >= '{q.CUT}'")))
    for got, seen in pairs:
        key = ["site", "product_id", "ord", "selling_price", "gtin", "brand"]
        want = catalogue.latest_per_key(seen)
        assert got.columns == want.columns and sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join") < plan.rindex("Window [")  # from the last step to the first


def test_latest_observations_are_chosen_where_they_met_their_parts(spark):
    from shelfwise.plans.catalogue_queries import latest

    plan = latest(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_partkey" in plan and "hashpartitioning(site" not in plan


def test_shuffle_files_of_a_stored_table_go(spark):
    import time

    from shelfwise.sources.versions import stored

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before, table = names(), stored(spark.range(1000).repartition(3, "id"))
    for _ in range(50):
        if not names() - before:
            break
        time.sleep(0.2)
    assert not names() - before and table.count() == 1000
