"""Joins with small dimensions: brands by prefix, categories by words, variant families, price bands."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.keys import brand_key, text
from shelfwise.sources.versions import delete, scratch, stored

IGNORED_WORDS = ("skincare", "skin", "care", "face", "beauty", "recommended")


def brand_by_slug(rows: DataFrame, brands: DataFrame, slug: str = "slug", most: int = 6, id_col: str = "id") -> DataFrame:
    """``rows`` with ``brand``: the brand whose key equals the longest run of leading words of a hyphenated
    slug, whole words only; empty if none does. Prefixes are exploded and joined by equality."""
    words = F.filter(F.split(F.col(slug), "-"), lambda w: w != "")
    keyed = brands.select(F.col("brand"), brand_key(F.col("brand")).alias("key")).where("key <> ''").groupBy("key").agg(F.min("brand").alias("brand"))
    heads = rows.select(F.col(id_col), words.alias("w")).select(id_col, "w", F.explode(F.expr(f"sequence(1, greatest(1, least({most}, size(w))))")).alias("n"))
    heads = heads.select(id_col, "n", brand_key(F.array_join(F.slice("w", F.lit(1), F.col("n")), "")).alias("key"))
    best = heads.join(keyed, "key").groupBy(id_col).agg(F.max_by("brand", "n").alias("brand"))
    return rows.join(best, id_col, "left").withColumn("brand", F.coalesce("brand", F.lit("")))


def brand_by_title(rows: DataFrame, brands: DataFrame, title: str = "title", id_col: str = "id") -> DataFrame:
    """``rows`` with ``brand``: the one with the longest key that begins the folded title. Only prefixes of
    lengths that a brand's key has are tried, by equality."""
    keyed = brands.select(F.col("brand"), brand_key(F.col("brand")).alias("key")).where("key <> ''").groupBy("key").agg(F.min("brand").alias("brand"))
    lengths = [r[0] for r in keyed.select(F.length("key")).distinct().collect()]  # as many as there are lengths
    if not lengths:
        return rows.withColumn("brand", F.lit(""))
    folded = brand_key(F.col(title))
    heads = rows.select(F.col(id_col), F.explode(F.array(*[F.when(F.length(folded) >= n, F.substring(folded, 1, n)) for n in sorted(lengths)])).alias("key")).where("key IS NOT NULL")
    best = heads.join(keyed, "key").groupBy(id_col).agg(F.max_by("brand", F.length("key")).alias("brand"))
    return rows.join(best, id_col, "left").withColumn("brand", F.coalesce("brand", F.lit("")))


def category_words(categories: DataFrame, ignored: Sequence[str] = IGNORED_WORDS, least: int = 3) -> DataFrame:
    """place, name, words: the words of a category's query that tell it from others."""
    words = F.filter(F.split(F.lower(text(F.col("query"))), r"\s+"), lambda w: (F.length(w) >= least) & ~w.isin(*ignored))
    return categories.select("place", "name", words.alias("words"))


def infer_categories(rows: DataFrame, categories: DataFrame, columns: Sequence[str] = ("product_name", "variant")) -> DataFrame:
    """``rows`` with ``categories``, the names (by place) of those of which a word occurs in the text of the
    columns. Words are found as by ``find_words``, so the dimension may have very many."""
    dim = category_words(categories)
    hay = F.lower(F.concat_ws(" ", *[text(F.col(c)) for c in columns]))
    listed = dim.select(F.explode("words").alias("word"), F.struct("place", "name").alias("category"))
    marked = listed.groupBy("word").agg(F.array_sort(F.collect_set("category")).alias("marks"))
    found = find_words(rows, hay, marked, "_marks", "marks")
    return found.withColumn("categories", F.transform(F.array_sort(F.array_distinct(F.flatten("_marks"))), lambda c: c["name"])).drop("_marks")


def select_categories(categories: DataFrame, wanted: Sequence[str] = ()) -> DataFrame:
    """Enabled categories: the named ones whatever their case (an unknown name is an error), or, if none is
    named, all except those that a covering one stands for."""
    on = categories.where(F.coalesce("enabled", F.lit(True)))
    if wanted:
        names = [w.lower() for w in wanted]
        known = {r[0] for r in on.where(F.lower("name").isin(*names)).select(F.lower("name")).collect()}
        missing = sorted(set(names) - known)
        if missing:
            raise ValueError(f"unknown categories: {', '.join(missing)}")
        return on.where(F.lower("name").isin(*names))
    covered = on.where("covers IS NOT NULL").select(F.explode("covers").alias("name"))
    return on.join(covered, "name", "left_anti")


def variant_families(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """id, parent, labels: every id reached from a root over (id, variant) edges keeps the first root (by
    ``ord``) that reaches it; labels of all ways are united. Breadth first, to a fixpoint.

    Only what a round has found new is joined with the edges in the next: better roots and labels not seen
    at an id yet. Each fact is written once, and rounds that nothing reads any more are deleted.
    """
    spark, folder = edges.sparkSession, scratch(edges.sparkSession)
    edges = stored(edges.select("id", "variant").where("id IS NOT NULL AND variant IS NOT NULL").distinct())
    root = F.struct("ord", F.col("id").alias("parent"))
    facts = roots.select("id", root.alias("root"), F.lit(None).cast("string").alias("label")).unionByName(roots.select("id", F.lit(None).alias("root"), F.explode("labels").alias("label")).select("id", F.lit(None).cast(roots.select(root.alias("r")).schema["r"].dataType).alias("root"), "label"))
    new, known, i = facts.groupBy("id", "label").agg(F.min("root").alias("root")), [], 0
    while True:
        new.write.parquet(f"{folder}/{i}")
        new = spark.read.parquet(f"{folder}/{i}")
        if new.isEmpty():
            break
        known.append(f"{folder}/{i}")
        have = spark.read.parquet(*known).groupBy("id", "label").agg(F.min("root").alias("had"))
        reached = new.join(edges, "id").groupBy(F.col("variant").alias("id"), "label").agg(F.min("root").alias("root"))
        fresh = reached.join(have.select(F.col("id").alias("h_id"), F.col("label").alias("h_label"), "had"), (F.col("id") == F.col("h_id")) & F.col("label").eqNullSafe(F.col("h_label")), "left")
        new, i = fresh.where("h_id IS NULL OR root < had").select("id", "label", "root"), i + 1
    delete(spark, f"{folder}/{i}")
    if not known:
        return roots.select("id", F.col("id").alias("parent"), "labels").where("false")
    best = spark.read.parquet(*known).groupBy("id").agg(F.min("root").alias("root"), F.array_sort(F.collect_set("label")).alias("labels"))
    return best.select("id", F.col("root.parent").alias("parent"), "labels")


def price_band(price: Column, edges: Sequence[float]) -> Column:
    """Number of the band [edge, next edge) that a price is in, from 0 below the first; null for null."""
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(price < edges[i], i).otherwise(out)
    return F.when(price.isNotNull(), out)


def expand_scopes(categories: DataFrame) -> DataFrame:
    """One row for each scope to capture: a covering category with ``partitions`` (an array of key, name, low,
    high) becomes its parts, which don't overlap; parts without key are left out, and every other category
    stays itself. ``scope`` tells them apart, ``low`` and ``high`` bound a part's prices (null: open)."""
    part = "array<struct<key:string,name:string,low:double,high:double>>"
    good = F.filter(F.coalesce("partitions", F.array().cast(part)), lambda p: F.trim(F.coalesce(p["key"], F.lit(""))) != "")
    none = F.array(F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("key", "string"), ("name", "string"), ("low", "double"), ("high", "double"))]))
    each = categories.withColumn("p", F.explode(F.when(F.coalesce("covers_all", F.lit(False)) & F.col("partitions").isNotNull(), good).otherwise(none)))
    key = F.trim("p.key")
    name = F.when(key.isNull(), F.col("name")).otherwise(F.concat("name", F.lit(" — "), F.coalesce(F.nullif("p.name", F.lit("")), key)))
    return each.select("id", name.alias("name"), F.when(key.isNull(), F.col("id")).otherwise(F.concat_ws("_", "id", key)).alias("scope"), "p.low", "p.high")


def in_scopes(rows: DataFrame, scopes: DataFrame, price: str = "selling_price") -> DataFrame:
    """Rows of (id, price) with the ``scope`` that each falls in: all of a category of one scope, else the part
    whose bounds hold its price. Each scope's rows lie in partitions of their own."""
    p = F.col(price)
    fits = (F.col("low").isNull() | (p >= F.col("low"))) & (F.col("high").isNull() | (p <= F.col("high")))
    found = rows.join(scopes.select("id", "scope", "low", "high"), "id").where((F.col("low").isNull() & F.col("high").isNull()) | fits)
    return found.drop("low", "high").repartition("scope")


#: Bytes of words up to which each task holds them all; beyond it they are looked for in parts.
WORD_BYTES = 64 << 20


def find_words(rows: DataFrame, hay: Column, words: DataFrame, column: str, value: str = "word") -> DataFrame:
    """``rows`` with ``column``: the values, distinct and sorted, of the ``words`` (column ``word``) that occur
    anywhere in ``hay``.

    One automaton over all words reads each text once, however many there are. The words lie in the
    shared folder and each task loads them; more than ``WORD_BYTES`` of them are cut into parts by their
    hash, one pass over the rows each. Null and empty words are never found.
    """
    spark, kind = rows.sparkSession, words.schema[value].dataType
    listed = stored(words.where("word <> ''").groupBy("word").agg(F.first(value).alias("value")) if value != "word" else words.where("word <> ''").select("word", F.col("word").alias("value")).distinct())
    parts = max(1, -(-(listed.agg(F.sum(F.octet_length("word") + 32)).first()[0] or 0) // WORD_BYTES))
    out = rows.withColumn(column, F.array().cast(T.ArrayType(kind)))
    for part in range(parts):
        own = stored(listed.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == part).withColumn("nth", F.monotonically_increasing_id())) if parts > 1 else listed
        out = _find_part(out, hay, own, column)
    return out.withColumn(column, F.array_sort(F.array_distinct(column)))


def _find_part(rows: DataFrame, hay: Column, words: DataFrame, column: str) -> DataFrame:
    folder, at = words.inputFiles(), len(rows.columns) - 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, values = ahocorasick.Automaton(), []
        for path in folder:
            filesystem, name = fs.FileSystem.from_uri(path)
            table = pq.read_table(name, filesystem=filesystem, columns=["word", "value"])
            for word in table.column("word").to_pylist():
                automaton.add_word(word, len(values))
                values.append(None)
            values[len(values) - len(table) :] = table.column("value").to_pylist()
        automaton.make_automaton()
        for batch in batches:
            texts, before = batch.column(len(batch.schema) - 1).to_pylist(), batch.column(at).to_pylist()
            found = [[*old, *(values[i] for i in dict.fromkeys(n for _, n in automaton.iter(t)))] if t and values else old for t, old in zip(texts, before)]
            columns = [*batch.columns[:at], pa.array(found, batch.schema.field(at).type)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[: at + 1]))

    return rows.withColumn("_hay", hay).mapInArrow(search, rows.schema)


def value_text(value: Column, kind: T.DataType) -> Column:
    """All values within a column, at any depth, as one text; names of fields and keys of maps are no values."""
    if isinstance(kind, T.StructType):
        return F.concat_ws(" ", *[value_text(value[f.name], f.dataType) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(value, lambda x: value_text(x, kind.elementType)), " ")
    if isinstance(kind, T.MapType):
        return F.array_join(F.transform(F.map_values(value), lambda x: value_text(x, kind.valueType)), " ")
    return value.cast("string")


def keyword_filter(rows: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Rows in which any of the keywords occurs in any value, whatever their case; blank keywords don't
    count, and without any all rows stay."""
    wanted = sorted({w.strip().lower() for w in keywords if w and w.strip()})
    if not wanted:
        return rows
    hay = F.lower(F.concat_ws(" ", *[value_text(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema.fields]))
    if len(wanted) <= 32:
        hit = F.lit(False)
        for word in wanted:
            hit = hit | F.contains(hay, F.lit(word))
        return rows.where(hit)
    listed = rows.sparkSession.createDataFrame([(w,) for w in wanted], "word string")
    return find_words(rows, hay, listed, "_found").where("size(_found) > 0").drop("_found")


def first_per_group(rows: DataFrame, by: Sequence[str], n: int, order: Sequence[Column | str]) -> DataFrame:
    """At most n rows of each group, in order; without groups, of all."""
    if not by:
        return rows.orderBy(*order).limit(n)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")
