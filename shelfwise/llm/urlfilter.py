"""URL rules by a cascade of Bloom filters, probed inside column expressions.

A key is a host suffix and a path prefix, such as ``example.com/de/``. Of all keys that occur in the
corpus some are listed. Level 1 encodes the listed keys; level 2 encodes those unlisted keys of the
corpus that level 1 wrongly accepts; level 3 those listed keys that level 2 accepts, and so on until
a level accepts nothing wrongly. A key's first level to reject it then tells exactly whether it is
listed, with no join: the filters are literals whose size follows the list, not the corpus, as level
1 is sized so that about as many unlisted keys pass as there are listed ones.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.bloom import BloomFilter, build_filter
from shelfwise.llm.shared import materialize, work_dir

#: Rate of false positives of all levels but the first.
LATER_RATE = 1 / 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://``: up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased, and
    from there up to ``?``, ``#`` or the end. Null or without ``://``: both empty."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[BloomFilter, ...]

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].accepts(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def _listed(spark: SparkSession, keys: Iterable[str]) -> DataFrame:
    keys = sorted(set(keys))
    frame = spark.range(1).select(F.explode(F.split(F.lit("\n".join(keys)), "\n")).alias("key"))
    return frame if keys else frame.where("false")


def build_cascade(universe: DataFrame, listed: Iterable[str], distinct: int | None = None) -> Cascade:
    """A cascade that separates ``listed`` from all other values of the column ``key`` of ``universe``.

    ``distinct``: about how many keys there are (counted if not given). Null keys count as unlisted.
    """
    spark, listed = universe.sparkSession, sorted(set(listed))
    if not listed:
        return Cascade(())
    folder, inside = work_dir(spark), _listed(spark, listed)
    if distinct is None:
        distinct = universe.agg(F.approx_count_distinct("key")).first()[0]
    levels = [build_filter(inside, len(listed), min(0.5, len(listed) / max(distinct, 1)), 1)]
    outside = universe.where(F.col("key").isNotNull() & levels[0].accepts(F.col("key"))).join(inside, "key", "left_anti").distinct()
    sides = [materialize(outside, f"{folder}/1"), inside]
    while n := sides[0].count():
        levels.append(build_filter(sides[0], n, LATER_RATE, len(levels) + 1))
        wrong = sides[1].where(levels[-1].accepts(F.col("key")))
        sides = [materialize(wrong, f"{folder}/{len(levels)}"), sides[0]]
    return Cascade(tuple(levels))


def rule_keys(host: Column, path: Column, rules: Iterable[str]) -> Column:
    """The keys of one URL that could equal a rule: suffixes of whole labels by prefixes of the path, of
    the numbers of labels and characters that the rules have."""
    shapes = sorted({(r.partition("/")[0].count(".") + 1, len(r) - r.index("/")) for r in rules})
    keys = [F.when((F.size(F.split(host, r"\.")) >= labels) & (F.length(path) >= chars), F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, chars))) for labels, chars in shapes]
    return F.array_distinct(F.filter(F.array(*keys), lambda k: k.isNotNull())) if keys else F.array().cast("array<string>")


def judge_urls(pages: DataFrame, block: Iterable[str], allow: Iterable[str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Each row's id, host, path, the longest rule that fits (else null) and the verdict.

    Rules are written ``host/path``. Among rules of one length the greater text wins. Without a rule
    the URL is on no list, so it is allowed. Null URLs and those without ``://`` have empty host and
    path; repeated rows are judged each; other columns are not read. A table without rows gives none. URLs of
    any length are read whole, and those of many labels or long paths have keys only of the shapes of the rules.
    """
    block, allow = list(block), list(allow)
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    keyed = rows.withColumn("keys", rule_keys(F.col("host"), F.col("path"), block + allow))
    universe = keyed.select(F.explode("keys").alias("key"))
    distinct = universe.agg(F.approx_count_distinct("key")).first()[0]
    blocked, allowed = build_cascade(universe, block, distinct), build_cascade(universe, allow, distinct)
    fitting = F.filter("keys", lambda k: blocked.contains(k) | allowed.contains(k))
    best = F.array_max(F.transform(fitting, lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"))))["rule"]
    verdict = F.when(blocked.contains(F.col("rule")) & F.col("rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return keyed.withColumn("rule", best).select("page_id", "host", "path", "rule", verdict.alias("verdict"))


BLOCK, ALLOW = ("net/", "example.com/de/"), ("example.net/en/", "org/fr/")

ORACLE = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
judged AS (
  SELECT h.*, (SELECT max(struct_pack(n := length(r.host || r.path), rule := r.host || r.path, verdict := r.verdict)) FROM rules r
    WHERE (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)) AS best
  FROM hosts h)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
"""
