from pyspark.sql import functions as F

from shelfwise.llm import urlfilter
from tests.llm.helpers import against_sql, frame

URLS = [
    None, "", "no scheme", "http://", "://net/", "http://a.net", "http://a.net/", "http://net/x", "http://anet/x", "HTTP://WWW.Example.NET/en/1",
    "https://example.net/en", "https://example.net/en/", "http://x.example.net/de/?q=/en/", "http://example.com/de/x#y", "http://EXAMPLE.com/De/x",
    "http://sub.example.com/de/", "http://notexample.com/de/", "http://a.org/fr/1", "http://a.org/en/", "http://org/fr/", "http://a.org?x=/fr/",
    "http://é.net/ü", "http://u:p@a.net:80/x", "http://a.net/x://b.org/fr/", "http://" + "a." * 3000 + "net/" + "x" * 5000, "http://a.net.#/x",
]


def test_judgement_equals_sql(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(3, "http://a.net/", "x", "y")] * 2 + [(None, "http://a.net/", None, None)]
    pages, twin = frame(spark, "page_id long, url string, host string, rule string", rows)
    got, want = against_sql(urlfilter.judge_urls(pages, urlfilter.BLOCK, urlfilter.ALLOW), urlfilter.ORACLE, pages=twin)
    assert got == want
    assert urlfilter.judge_urls(pages.limit(0), urlfilter.BLOCK, urlfilter.ALLOW).count() == 0
    assert {r.verdict for r in urlfilter.judge_urls(pages, [], []).collect()} == {"allow"}


def test_a_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(60_000).select(F.concat(F.lit("key"), "id").alias("key"))
    listed = [f"key{i}" for i in range(0, 60_000, 97)]
    cascade = urlfilter.build_cascade(universe, listed)
    assert len(cascade.levels) > 2
    found = universe.where(cascade.contains(F.col("key"))).collect()
    assert sorted(r.key for r in found) == sorted(listed)
    assert sum(level.bits for level in cascade.levels) < 40 * len(listed)
