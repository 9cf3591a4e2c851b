"""The same product on several sites: a scored join within brands, and a one-to-one assignment.

Items of one site that are equal in all that a title's score reads, and that all have a barcode or all have
none, are one class, however many they are; classes are joined and scored, and their members paired by order
afterwards. A barcode itself is never part of a class, so barcodes of their own make no more classes. Edges
are found through shared title words: classes exploded by word are joined on (brand, word), except on each
one's most frequent word, which a pair of two shared words can do without. So no pair without a shared word
is ever made, and the commonest word of a brand pairs nobody.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import keys, titles
from shelfwise.sources.versions import delete, drop, scratch, stored

THRESHOLD, REVIEW_BELOW = 0.70, 0.80
#: The columns of products that matching itself reads.
TITLED = ("site", "product_id", "brand", "product_name", "variant", "gtin")


def site_rank(site: Column, order: Sequence[str]) -> Column:
    """A site's place: those of ``order`` first, then all others by name."""
    out = F.lit(len(order))
    for i, s in reversed(list(enumerate(order))):
        out = F.when(site == s, i).otherwise(out)
    return F.struct(out.alias("rank"), site.alias("site"))


def prepare(products: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Items: the product's columns that matching needs, its keys, and ``item`` (an id), ``place`` (the
    site's rank) and ``ord`` (the order within all). Rows without site are left out."""
    site = F.lower(F.trim(keys.text(F.col("site"))))
    name, variant = F.col("product_name"), F.col("variant")
    items = products.where(site != "").select(
        site.alias("site"), "product_id", "brand", "product_name", "variant", *[c for c in ("mrp", "selling_price", "discount_pct", "in_stock", "product_url", "categories") if c in products.columns],
        keys.brand_key(F.col("brand")).alias("bkey"), titles.name_tokens(name, F.col("brand")).alias("tokens"), titles.parse_size(variant, name).alias("size"),
        titles.detect_form(name, variant).alias("form"), keys.normalize_gtin(F.col("gtin")).alias("gtin"), titles.strengths(name, variant).alias("strengths"), titles.is_bundle(name, variant).alias("bundle"),
    )
    items = items.withColumn("place", site_rank(F.col("site"), order))
    return items.withColumns({"item": F.struct("site", "product_id"), "ord": F.struct("place", F.lower("brand").alias("brand"), F.lower("product_name").alias("name"), F.lower(keys.text(F.col("variant"))).alias("variant"), "product_id")})


_TITLE = ("bkey", "tokens", "form", "strengths", "bundle", "size")
#: Items of a brand, or of one component of a brand's edges, that one task walks over.
GROUP = 2_000_000
#: Members of a class, about, that one row holds while edges of items are listed.
BLOCK = 1_000


def size_bucket(amount: Column) -> Column:
    """A number that differs by 1 at most between amounts that agree: half units up to 25, then steps of 2 %."""
    return F.when(amount < 25, F.floor(amount / 0.5)).otherwise(50 + F.floor(F.log(amount / 25) / math.log(1 / 0.98)))


def with_class(items: DataFrame) -> DataFrame:
    """Adds ``coded`` (has a barcode), ``title``: equal for items of one brand that no title's score can tell apart,
    and ``cls``: equal for those of one title, one site and one ``coded``. Both are 16 bytes."""
    size = F.coalesce(F.concat_ws("x", F.col("size.amount").cast("string"), F.col("size.unit"), F.col("size.pack").cast("string")), F.lit(""))
    short = lambda value: F.unhex(F.substring(F.sha2(value, 256), 1, 32))
    parts = F.array(F.col("bkey"), F.col("form"), F.col("bundle").cast("string"), F.when(F.col("size").isNull(), "").otherwise(size))
    named = items.withColumns({"coded": F.col("gtin") != "", "title": short(F.to_json(F.struct(parts.alias("p"), "tokens", "strengths")))})
    return named.withColumn("cls", short(F.concat_ws(":", F.hex("title"), F.col("coded").cast("string"), "site")))


def _grouped(rows: DataFrame, by: list[str], members: Column) -> DataFrame:
    """Rows of ``with_class`` by their ``cls`` and the columns ``by``. What scores read is the same for all of a title, so
    it is taken once a title, not once a class."""
    first = lambda columns: [F.first(c).alias(c) for c in columns]
    titled = rows.groupBy("title").agg(*first(_TITLE))
    return rows.groupBy("title", "site", "place", "coded", "cls", *by).agg(F.min("ord").alias("ord"), members.alias("members")).join(titled, "title")


def item_classes(items: DataFrame) -> DataFrame:
    """One row for each barcode of a class, and one for each class without: an id as ``item``, the class as
    ``cls``, the first order as ``ord``, what scores read, and ``members``."""
    found = _grouped(with_class(items.where("bkey <> ''")), ["gtin"], F.count("*"))
    return found.withColumn("item", F.concat_ws(":", F.hex("cls"), "gtin"))


def title_classes(items: DataFrame) -> DataFrame:
    """One row for each class of alike items: its id as ``item``, the first order as ``ord``, what titles'
    scores read, and ``members``. However many equal titles a site has, they are one row or two."""
    return _grouped(with_class(items.where("bkey <> ''")), [], F.count("*")).withColumnRenamed("cls", "item")


_EDGE = ("bkey", "left", "right", "l_site", "r_site", "l_ord", "r_ord", "l_place", "r_place", "confidence", "method", "notes", "links")


def _same_codes(rows: DataFrame) -> DataFrame:
    """Edges between rows with one barcode on different sites of a brand, as ``title_edges`` has them."""
    members = F.col("members") if "members" in rows.columns else F.lit(1).cast("long")
    side = rows.where("bkey <> '' AND gtin <> ''").select("bkey", "gtin", "item", "site", "ord", "place", members.alias("members"))
    left, right = (side.select("bkey", "gtin", *[F.col(c).alias(f"{p}_{c}") for c in ("item", "site", "ord", "place", "members")]) for p in "lr")
    both = left.join(right, ["bkey", "gtin"]).where("l_place < r_place")
    return both.withColumns({"left": F.col("l_item"), "right": F.col("r_item"), "confidence": F.lit(1.0), "method": F.lit("gtin"), "notes": F.array().cast("array<string>"), "links": F.col("l_members") * F.col("r_members")}).select(*_EDGE)


def class_edges(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Edges between rows of ``item_classes`` of different sites: those of equal barcodes between its rows,
    and ``title_edges`` between their classes."""
    titled = _grouped(classes.drop("item"), [], F.sum("members")).withColumnRenamed("cls", "item")
    codes = _same_codes(classes).where(F.col("confidence") >= threshold)
    return codes.withColumns({c: F.col(c).cast("binary") for c in ("left", "right")}).unionByName(title_edges(titled, threshold))


def title_pairs(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """bkey, l_title, r_title, confidence, method, notes of the titles of ``classes`` (which may have many rows a
    title) that are alike: each pair in both orders, and each title with itself.

    Two words must be shared, and known forms, strengths, kits and sizes must agree. All of that is the same on every
    site, so titles are scored, however many sites and barcodes they have.
    Where both have a size it is part of the join's key. Word rows carry what the gates and the score read, and a pair
    counts at the least of the words that it meets at, so pairs are neither made distinct nor joined again.
    """
    alike = classes.groupBy("title").agg(*[F.first(c).alias(c) for c in _TITLE]).withColumn("n", F.size("tokens")).where("n >= 2")
    alike = stored(alike.withColumn("bucket", size_bucket(F.col("size.amount"))))

    # Pairs share two words, so they share one that is not the most frequent word of the left title and not
    # that of the right one, if frequency orders words alike for both: that word is left out of the join.
    words = alike.select("bkey", "title", F.explode("tokens").alias("word"))
    frequency = words.groupBy("bkey", "word").agg(F.count("*").alias("times"))
    commonest = words.join(frequency, ["bkey", "word"]).groupBy("title").agg(F.max_by("word", F.struct("times", "word")).alias("common"))
    met = alike.join(commonest, "title").withColumn("met", F.array_remove("tokens", F.col("common"))).drop("common")
    met = stored(met.withColumn("word", F.explode("met")))
    carried = [c for c in met.columns if c not in ("bkey", "word")]
    lw, rw = (met.select("bkey", "word", *[F.col(c).alias(f"{p}_{c}") for c in carried]) for p in "lr")
    near = lw.where("l_bucket IS NOT NULL").withColumn("r_bucket", F.explode(F.array(F.col("l_bucket") - 1, F.col("l_bucket"), F.col("l_bucket") + 1)))
    order = [*lw.columns, *[c for c in rw.columns if c not in ("bkey", "word")]]
    meetings = near.join(rw, ["bkey", "word", "r_bucket"]).select(order)
    meetings = meetings.unionByName(lw.where("l_bucket IS NULL").join(rw, ["bkey", "word"]).select(order))
    meetings = meetings.unionByName(lw.where("l_bucket IS NOT NULL").join(rw.where("r_bucket IS NULL"), ["bkey", "word"]).select(order))

    differ = lambda c, empty: (F.col(f"l_{c}") != empty) & (F.col(f"r_{c}") != empty) & (F.col(f"l_{c}") != F.col(f"r_{c}"))
    no_strength = F.array().cast("array<string>")
    sized = F.col("l_size").isNotNull() & F.col("r_size").isNotNull()
    same_size = (F.col("l_size.pack") == F.col("r_size.pack")) & (F.col("l_size.unit") == F.col("r_size.unit")) & titles.amounts_agree(F.col("l_size.amount"), F.col("r_size.amount"))
    gates = ~differ("form", "") & ~differ("strengths", no_strength) & (F.col("l_bundle") == F.col("r_bundle")) & (~sized | F.coalesce(same_size, F.lit(False)))
    pairs = meetings.where(gates).where(F.col("word") == F.array_min(F.array_intersect("l_met", "r_met")))
    pairs = pairs.withColumn("c", F.size(F.array_intersect("l_tokens", "r_tokens"))).where("c >= 2")
    containment = F.col("c") / F.least("l_n", "r_n")
    jaccard = F.col("c") / (F.col("l_n") + F.col("r_n") - F.col("c"))
    both_forms, no_forms = (F.col("l_form") != "") & (F.col("r_form") != ""), (F.col("l_form") == "") & (F.col("r_form") == "")
    confidence = F.when(sized, 0.65 * containment + 0.35 * jaccard + 0.10).otherwise((0.65 * containment + 0.35 * jaccard) * 0.85) + F.when(both_forms, 0.05).otherwise(0.0)
    notes = F.filter(F.array(F.when(~sized, F.lit("size missing on one side")), F.when(no_forms, F.lit("product form not recognized"))), lambda x: x.isNotNull())
    return pairs.select("bkey", "l_title", "r_title", F.least(F.lit(1.0), confidence).alias("confidence"), F.lit("name").alias("method"), notes.alias("notes")).where(F.col("confidence") >= threshold)


def title_edges(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Edges between rows of ``title_classes`` of different sites, from the earlier to the later site: bkey,
    left, right, sites, orders, places, confidence, method, notes and ``links``, the pairs of items it stands for.

    Two items with barcodes are told by these alone; otherwise ``title_pairs`` tells, and classes meet by titles' pairs.
    """
    base = stored(classes.select("title", "item", "site", "ord", "place", "coded", "members", *_TITLE))
    side = lambda p, *more: base.select(*more, *[F.col(c).alias(f"{p}_{c}") for c in ("title", "item", "site", "ord", "place", "coded", "members")])
    found = stored(title_pairs(base, threshold).drop("bkey")).join(side("l", "bkey"), "l_title").join(side("r"), "r_title").where("l_place < r_place AND NOT (l_coded AND r_coded)")
    return found.withColumns({"left": F.col("l_item"), "right": F.col("r_item"), "links": F.col("l_members") * F.col("r_members")}).select(*_EDGE)


_PAIR = ("left", "right", "l_site", "r_site", "l_ord", "r_ord", "confidence", "method", "notes")


def _blocks(members: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``cls`` and ``block``: its members as arrays of about ``BLOCK``."""
    sizes = members.groupBy("cls").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = members.join(sizes, "cls").withColumn("nth", F.expr("pmod(xxhash64(item), blocks)"))
    return dealt.groupBy("cls", "nth").agg(F.collect_list(F.struct(*columns)).alias("block")).drop("nth")


def score_edges(items: DataFrame, threshold: float = THRESHOLD, orders: bool = True) -> DataFrame:
    """Edges from an item to one of a later site: left, right, sites, orders, confidence, method, notes, as
    ``class_edges`` scores them. Every pair of members has its row: for reports; the assignment needs none.
    Classes' edges meet members in blocks, and pairs are listed where these met, so no pair is shuffled.
    Without ``orders`` blocks and pairs leave these out."""
    found, members = title_edges(title_classes(items), threshold).select("left", "right", "l_site", "r_site", "confidence", "method", "notes"), with_class(items.where("bkey <> ''"))
    blocks = _blocks(members, ("item", "ord") if orders else ("item",))
    side = lambda p, name: blocks.select(F.col("cls").alias(name), F.col("block").alias(f"{p}_block"))
    pairs = found.join(side("l", "left"), "left").join(side("r", "right"), "right")
    pairs = pairs.withColumn("l", F.explode("l_block")).drop("l_block").withColumn("r", F.explode("r_block"))
    kept = [c for c in _PAIR if orders or c not in ("l_ord", "r_ord")]
    named = pairs.withColumns({"left": F.col("l.item"), "right": F.col("r.item")} | ({"l_ord": F.col("l.ord"), "r_ord": F.col("r.ord")} if orders else {}))
    return _same_codes(items).where(F.col("confidence") >= threshold).select(*kept).unionByName(named.select(*kept))


def best_per_site(edges: DataFrame) -> DataFrame:
    """Each left end's best edge to each later site, ties to the first in order."""
    nth = F.row_number().over(Window.partitionBy("left", "r_site").orderBy(F.desc("confidence"), "r_ord"))
    return edges.withColumn("nth", nth).where("nth = 1").drop("nth")


def best_edges(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``best_per_site`` of ``score_edges``, without listing these, nor edges of classes: of a class of the other site only the
    first item can be best, and it is so for all items of a title, but that those with a barcode see only classes
    without. So bests are found for titles, and for barcodes, and an item chooses among these in its own row."""
    rows = with_class(items.where("bkey <> ''"))
    base = stored(title_classes(items).select("title", F.col("site").alias("r_site"), "coded", "ord", *_TITLE))
    met = stored(title_pairs(base, threshold)).join(base.select(F.col("title").alias("r_title"), "r_site", "coded", "ord"), "r_title")
    worth = F.struct((-F.col("confidence")).alias("less"), "ord", "method", "notes")  # the least is the best
    best = met.groupBy("l_title", "r_site").agg(F.min(worth).alias("any"), F.min(F.when(~F.col("coded"), worth)).alias("blank"))
    best = best.groupBy(F.col("l_title").alias("title")).agg(F.collect_list(F.struct("r_site", "any", "blank")).alias("titled"))
    same = rows.where("coded").where(F.lit(threshold <= 1)).groupBy("bkey", "gtin", "site").agg(F.min("ord").alias("ord"))
    same = same.groupBy("bkey", "gtin").agg(F.collect_list(F.struct("site", "ord")).alias("same")).where(F.size("same") > 1)

    members = rows.select("bkey", "gtin", "title", "coded", "place", "site", F.col("item").alias("left"), F.col("ord").alias("l_ord"))
    members = members.where("coded").join(same, ["bkey", "gtin"], "left").drop("bkey", "gtin").unionByName(members.where("NOT coded").drop("bkey", "gtin"), allowMissingColumns=True)
    coded = lambda x: F.struct(F.lit(-1.0).alias("less"), x["ord"].alias("ord"), F.lit("gtin").alias("method"), F.array().cast("array<string>").alias("notes"))
    by_code = F.transform("same", lambda x: F.struct(x["site"].alias("r_site"), coded(x).alias("best")))
    by_title = F.transform("titled", lambda x: F.struct(x["r_site"].alias("r_site"), F.when(F.col("coded"), x["blank"]).otherwise(x["any"]).alias("best")))
    offers = F.flatten(F.filter(F.array(by_title, by_code), lambda x: x.isNotNull()))
    found = members.join(best, "title", "left").withColumn("offers", F.filter(offers, lambda x: x["best"].isNotNull() & (x["best"]["ord"]["place"] > F.col("place"))))
    chosen = F.transform(F.array_distinct(F.transform("offers", lambda x: x["r_site"])), lambda s: F.array_min(F.filter("offers", lambda x: x["r_site"] == s)))
    found = found.withColumn("one", F.explode(chosen)).withColumns({"r_site": F.col("one.r_site"), "r_ord": F.col("one.best.ord"), "confidence": -F.col("one.best.less"), "method": F.col("one.best.method"), "notes": F.col("one.best.notes")})
    right = F.struct(F.col("r_ord.place.site").alias("site"), F.col("r_ord.product_id").alias("product_id"))
    found = found.withColumns({"right": right, "l_site": F.col("site")}).select(*_PAIR)
    again = stored(rows.groupBy(F.col("item").alias("left")).count().where("count > 1").select("left"))
    if again.isEmpty():
        return found
    return found.join(again, "left", "left_anti").unionByName(best_per_site(found.join(again, "left", "left_semi")))


def assign(edges: DataFrame) -> DataFrame:
    """The edges that a walk over all items in order would take: an item that is still free takes its
    best free partner on every other site, and each item is used once.

    Done in rounds over all brands at once, until no edge is open: an edge is settled if no earlier item
    can still take its left end, the left end likes it best of that site, and no earlier item can still
    take its right end. Left items whose edges to a site are alike are settled together: the nth of them
    takes its nth best partner, if that one and those before it can only be taken earlier by the n - 1
    before it, and these are settled too. A settled edge removes those that it rules out. The first free
    item can always settle, so each round makes progress. Left items that are alike are ranked in one
    task; where classes are known, ``assign_classes`` needs neither their edges nor rounds.
    """
    folder = scratch(edges.sparkSession)
    left = edges.select("left", "right", "l_site", "r_site", "l_ord", "r_ord", "confidence", "method", "notes")
    nth = F.row_number().over(Window.partitionBy("left", "right").orderBy(F.desc("confidence"), "r_ord", "l_ord"))
    once = left.withColumn("nth", nth).where("nth = 1").withColumn("l_ord", F.min("l_ord").over(Window.partitionBy("left")))
    once.select(left.columns).write.parquet(f"{folder}/edges0")
    settled, alike = [], ["r_site", "same", "n"]
    for i in count():
        rest = edges.sparkSession.read.parquet(f"{folder}/edges{i}")
        if rest.isEmpty():
            break
        liked = F.row_number().over(Window.partitionBy("left", "r_site").orderBy(F.desc("confidence"), "r_ord"))
        turn = F.row_number().over(Window.partitionBy("right").orderBy("l_ord"))
        lefts = rest.groupBy("left", "r_site", "l_ord").agg(F.sum(F.xxhash64("right", "confidence").cast("decimal(38,0)")).alias("same"), F.count("*").alias("n"))
        lefts = lefts.withColumn("nth", F.row_number().over(Window.partitionBy(*alike).orderBy("l_ord"))).drop("l_ord")
        awaited = rest.select(F.col("right").alias("left")).distinct().withColumn("awaited", F.lit(True))
        ranked = rest.withColumns({"liked": liked, "turn": turn}).join(lefts.join(awaited, "left", "left"), ["left", "r_site"])
        fails = ranked.where("awaited OR liked <= nth AND turn <> nth").groupBy(*alike).agg(F.min("nth").alias("fails"))
        done = ranked.where("liked = nth").join(fails, alike, "left").where("fails IS NULL OR nth < fails")
        done.select(left.columns).write.parquet(f"{folder}/done{i}")
        done = edges.sparkSession.read.parquet(f"{folder}/done{i}")
        if done.isEmpty():
            raise RuntimeError(f"no edge settled in round {i}: orders of items are not distinct")
        settled.append(f"{folder}/done{i}")
        used = done.select(F.col("right").alias("item")).distinct()
        taken = done.select("left", "r_site").distinct()
        rest = rest.join(used.select(F.col("item").alias("right")), "right", "left_anti").join(used.select(F.col("item").alias("left")), "left", "left_anti")
        rest.join(taken, ["left", "r_site"], "left_anti").select(left.columns).write.parquet(f"{folder}/edges{i + 1}")
        delete(edges.sparkSession, f"{folder}/edges{i}")
    return edges.sparkSession.read.schema(left.schema).parquet(*settled) if settled else left.where("false")


def _numbers(kind: str, values: np.ndarray) -> array:
    return array(kind, values.astype(kind).tobytes())


def _runs(keys: np.ndarray, names: np.ndarray | None = None) -> tuple[array, np.ndarray, array, array]:
    """Positions (or their ``names``) by their keys, in order within a key; the distinct keys; where each one's run starts,
    and the last ends; and the starts again, to be moved."""
    at = np.argsort(keys, kind="stable")
    own, starts = np.unique(keys[at], return_index=True)
    return _numbers("i", at if names is None else names[at]), own, _numbers("q", np.append(starts, len(keys))), _numbers("q", starts)


def walk(titled: np.ndarray, sites: np.ndarray, codes: np.ndarray, left: np.ndarray, right: np.ndarray, confidence: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(left, right, pair) positions of the assignment within one group. ``titled``, ``sites`` and ``codes``
    have the title, site and barcode (-1: none) of each item in order, in which sites' numbers rise; ``left``, ``right``
    and ``confidence`` the pairs of titles. The pair of two equal barcodes is -1.

    Partners are on later sites, so they come later in the order, and of a class (title, site, with a barcode or
    without) or of a barcode's items on a site the first free one is always taken: runs of positions are passed from their
    starts on. All that grows with the items or pairs is an array of numbers; the classes that a class has pairs with are
    listed from its first item on until its last has passed.
    """
    count, n_sites, n_titles = len(titled), max(1, int(sites.max(initial=-1)) + 1), int(titled.max(initial=-1)) + 1
    coded = codes >= 0
    by_class, classes, start, head = _runs((titled.astype("<i8") * n_sites + sites) * 2 + coded)
    class_of, title_start = _numbers("i", np.zeros(count)), _numbers("q", np.searchsorted(classes, np.arange(n_titles + 1) * n_sites * 2))
    np.frombuffer(class_of, "<i4")[np.frombuffer(by_class, "<i4")] = np.repeat(np.arange(len(classes)), np.diff(np.frombuffer(start, "<i8")))
    class_site, class_coded = _numbers("i", classes // 2 % n_sites), bytes((classes % 2).astype("u1"))
    kept = np.flatnonzero((np.minimum(left, right) >= 0) & (np.maximum(left, right) < n_titles))  # those whose titles have items
    kept = kept[np.lexsort((-confidence[kept], left[kept]))]
    first, rights, worths = _numbers("q", np.searchsorted(left[kept], np.arange(n_titles + 1))), _numbers("i", right[kept]), _numbers("d", confidence[kept])
    # a barcode's items lie together, by site
    held = np.flatnonzero(coded)
    by_code, runs, code_start, code_head = _runs(codes[held].astype("<i8") * n_sites + sites[held], held)
    run_site, first_run = _numbers("i", runs % n_sites), _numbers("q", np.searchsorted(runs, np.arange(int(codes.max(initial=-1)) + 2) * n_sites))
    titled, sites, codes = (_numbers("i", x) for x in (titled, sites, codes))
    used = bytearray(count)

    def free(order: array, heads: array, ends: array, run: int) -> int:
        """The first free position of a run, or -1."""
        at, end = heads[run], ends[run + 1]
        while at < end and used[order[at]]:
            at += 1
        heads[run] = at
        return order[at] if at < end else -1

    def partners(own: int, title: int) -> dict[int, list]:
        """By site: where the next level of confidence starts, the pairs and classes, and of the present level the classes
        that may have free items, with their pairs."""
        out: dict[int, list] = {}
        for i in range(first[title], first[title + 1]):
            for run in range(title_start[rights[i]], title_start[rights[i] + 1]):
                if class_site[run] > class_site[own] and not (class_coded[own] and class_coded[run]):
                    found = out.get(class_site[run]) or out.setdefault(class_site[run], [0, array("q"), array("i"), {}])
                    found[1].append(i), found[2].append(run)
        return out

    listed: dict[int, dict[int, list]] = {}
    for at in range(count):
        own, title, code = class_of[at], titled[at], codes[at]
        best: dict[int, tuple[float, int, int]] = {}
        if not used[at] and first[title] < first[title + 1]:
            if own not in listed:
                listed[own] = partners(own, title)
            for other, level in list(listed[own].items()):
                _, its, others, live = level
                while other not in best:
                    for run in list(live):
                        found, i = free(by_class, head, start, run), live[run]
                        if found < 0:
                            del live[run]
                        elif other not in best or found < best[other][1]:
                            best[other] = (-worths[i], found, i)
                    if not live:
                        if level[0] == len(its):
                            del listed[own][other]
                            break
                        worth = worths[its[level[0]]]
                        while level[0] < len(its) and worths[its[level[0]]] == worth:
                            live[others[level[0]]] = its[level[0]]
                            level[0] += 1
        if not used[at] and code >= 0:
            for run in range(first_run[code], first_run[code + 1]):
                same = free(by_code, code_head, code_start, run) if run_site[run] > sites[at] else -1
                if same >= 0:
                    best[run_site[run]] = min(best.get(run_site[run], (0.0, 0, 0)), (-1.0, same, -1))
        for _, partner, i in best.values():
            yield at, partner, int(kept[i]) if i >= 0 else -1
            used[partner] = 1
        if at == by_class[start[own + 1] - 1]:
            listed.pop(own, None)


ASSIGNED = "left struct<site:string,product_id:string>, right struct<site:string,product_id:string>, l_site string, r_site string, confidence double, method string, notes array<string>"


def _numbered(values: pa.ChunkedArray, order: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The values in ``order`` as numbers, and the values by number."""
    coded = values.combine_chunks().dictionary_encode()
    return coded.indices.to_numpy()[order], coded.dictionary


def _walk_group(items: pa.Table, pairs: pa.Table) -> pa.Table:
    """``walk`` over the Arrow tables of one group."""
    order = np.argsort(items.column("rank").to_numpy())
    titled, names = _numbered(items.column("title"), order)
    sites, _ = _numbered(items.column("site"), order)
    first, inverse = np.unique(sites, return_index=True)[1], np.unique(sites, return_inverse=True)[1]
    sites = np.argsort(np.argsort(first))[inverse]  # numbered as they come in the order
    codes, own_codes = _numbered(items.column("gtin"), order)
    blank = pc.index(own_codes, "").as_py()
    codes = np.where(codes == blank, -1, codes)
    left, right = (pc.fill_null(pc.index_in(pairs.column(c).combine_chunks(), value_set=names), -1).to_numpy() for c in ("l_title", "r_title"))
    confidence = pairs.column("confidence").to_numpy()
    l, r, e = array("i"), array("i"), array("i")
    for at, partner, pair in walk(titled, sites, codes, left, right, confidence):
        l.append(at), r.append(partner), e.append(pair + 1)
    own = pairs.select(["confidence", "method", "notes"])
    same = pa.table([pa.array([v], own.schema.field(i).type) for i, v in enumerate((1.0, "gtin", []))], own.column_names)
    own = pa.concat_tables([same, own.cast(same.schema)]).combine_chunks().take(pa.array(np.frombuffer(e, "<i4")))
    places = [pa.array(order[np.frombuffer(x, "<i4")]) for x in (l, r)]
    site, product = items.column("site").combine_chunks(), items.column("product_id").combine_chunks()
    sides = [(site.take(at), product.take(at)) for at in places]
    named = [pa.StructArray.from_arrays(side, ["site", "product_id"]) for side in sides]
    return pa.table([*named, *[side[0] for side in sides], *own.columns], ["left", "right", "l_site", "r_site", *own.column_names])


def _components(edges: DataFrame) -> DataFrame:
    """``cls`` and ``component`` of the classes that ``edges`` link: every class takes the least name among
    its neighbours and their names, until none changes; only changed names are joined in the next round."""
    both = edges.select(F.col("left").alias("a"), F.col("right").alias("b"))
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    names = stored(both.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    changed = names
    while True:
        offered = both.join(changed, both["b"] == changed["cls"]).groupBy(F.col("a").alias("of")).agg(F.min("component").alias("offer"))
        jumped = names.select(F.col("cls").alias("at"), F.col("component").alias("further"))
        new = names.join(offered, names["cls"] == offered["of"], "left").join(jumped, names["component"] == jumped["at"], "left")
        new = stored(new.select("cls", F.col("component").alias("before"), F.least("component", "offer", "further").alias("component")))
        drop(names)
        names, changed = new.select("cls", "component"), new.where("component < before").select("cls", "component")
        if changed.isEmpty():
            return names


def assign_classes(items: DataFrame, edges: DataFrame, group: int = GROUP) -> DataFrame:
    """``assign_titles`` by the pairs of titles that ``edges``, all of ``title_edges`` or ``class_edges``, stand for. Equal
    barcodes are read from the items (such rows of ``edges`` are passed over)."""
    named = with_class(items.where("bkey <> ''")).select("cls", "title").distinct()
    side = lambda p, name: named.select(F.col("cls").alias(name), F.col("title").alias(f"{p}_title"))
    found = edges.where("method = 'name'").join(side("l", "left"), "left").join(side("r", "right"), "right")
    return assign_titles(items, found.select(*_TITLES).dropDuplicates(["l_title", "r_title"]), group)


_TITLES = ("bkey", "l_title", "r_title", "confidence", "method", "notes")


def assign_titles(items: DataFrame, pairs: DataFrame, group: int = GROUP) -> DataFrame:
    """The assignment of ``assign`` from ``title_pairs``, without edges of items or of classes: left, right, l_site, r_site,
    confidence, method, notes.

    No pair leaves its brand, so a task walks over a brand's items, in order, with its titles' pairs. A
    brand of more than ``group`` items is cut into the components of its pairs first. A component beyond
    that (of more items than a task should hold) is settled in rounds over its items' edges instead.
    """
    pairs = stored(pairs.select(*_TITLES))
    members = with_class(items.where("bkey <> ''")).select("bkey", "title", "coded", "gtin", "site", "place", "item", "ord")
    own = {"site": F.col("ord.place.site"), "product_id": F.col("ord.product_id")}  # so ``ord`` alone is shuffled
    large = [r[0] for r in items.where("bkey <> ''").groupBy("bkey").count().where(F.col("count") > group).select("bkey").collect()]  # at most a brand for each ``group`` items

    def settled(rows: DataFrame, links: DataFrame) -> DataFrame:
        ranked = rows.select("bkey", "title", "gtin", "ord").withColumn("rank", F.row_number().over(Window.partitionBy("bkey").orderBy("ord")))
        ranked = ranked.withColumns(own).select("bkey", "rank", "title", "gtin", "site", "product_id")
        return ranked.groupBy("bkey").cogroup(links.select(*_TITLES).groupBy("bkey")).applyInArrow(_walk_group, ASSIGNED)

    if not large:
        return settled(members, pairs)
    is_large = F.col("bkey").isin(large)
    out = settled(members.where(~is_large), pairs.where(~is_large))
    wide = pairs.where(is_large)
    linked = wide.select("l_title").unionByName(wide.select(F.col("r_title").alias("l_title"))).distinct().select(F.col("l_title").alias("title"), F.lit(True).alias("linked"))
    # an item is at its title, if that has pairs, and at its barcode: these are the points that components join
    code = F.when(F.col("gtin") != "", F.concat_ws(":", F.lit("gtin"), "bkey", "gtin").cast("binary"))
    rows = members.where(is_large).join(linked, "title", "left").withColumn("code", code).where("linked OR code IS NOT NULL")
    rows = stored(rows.withColumn("at", F.when(F.col("linked"), F.col("title")).otherwise(F.col("code"))))
    both = wide.select(F.col("l_title").alias("left"), F.col("r_title").alias("right")).unionByName(rows.where("linked AND code IS NOT NULL").select(F.col("title").alias("left"), F.col("code").alias("right")))
    split = _components(both)
    rows = rows.join(split.withColumnRenamed("cls", "at"), "at", "left").withColumn("bkey", F.coalesce("component", "at")).drop("component", "at", "linked", "code")
    rows = stored(rows)
    links = wide.drop("bkey").join(split.withColumnRenamed("cls", "l_title"), "l_title").withColumnRenamed("component", "bkey")
    sizes = rows.groupBy("bkey").agg((F.count("*") > group).alias("huge"))
    rows, links = stored(rows.join(sizes, "bkey")), stored(links.join(sizes, "bkey"))
    out = out.unionByName(settled(rows.where("NOT huge"), links.where("NOT huge")))
    huge = rows.where("huge")
    if huge.isEmpty():
        return out
    side = lambda p, name: huge.select(F.col("item").alias(name), *[F.col(c).alias(f"{p}_{c}") for c in ("title", "coded", "site", "ord")])
    listed = links.where("huge").join(side("l", "left"), "l_title").join(side("r", "right"), "r_title").where("l_ord.place < r_ord.place AND NOT (l_coded AND r_coded)")
    return out.unionByName(assign(listed.select(*_PAIR).unionByName(_same_codes(huge).select(*_PAIR))).select(out.columns))


def match_groups(items: DataFrame, assigned: DataFrame) -> DataFrame:
    """Long form: match (the anchor's item), confidence, method, notes of the whole match, and each member's
    columns of ``items``. Confidence is the least of the members; the method is gtin if all are."""
    per = assigned.groupBy("left").agg(
        F.min("confidence").alias("confidence"),
        F.when(F.bool_and(F.col("method") == "gtin"), "gtin").otherwise("name").alias("method"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("r_site", "notes"))), lambda x: F.transform(x["notes"], lambda n: F.concat(x["r_site"], F.lit(": "), n)))).alias("notes"),
    )
    members = assigned.select("left", F.col("right").alias("item")).unionByName(assigned.select("left", F.col("left").alias("item")).distinct())
    return members.join(per, "left").join(items, "item").withColumnRenamed("left", "match").withColumn("is_anchor", F.col("match") == F.col("item"))


def match_products(products: DataFrame, threshold: float = THRESHOLD, order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, groups in long form, items without match)."""
    items = stored(prepare(products, order))
    assigned = stored(assign_titles(items, title_pairs(with_class(items.where("bkey <> ''")), threshold)))
    read = items.drop("bkey", "tokens", "strengths", "bundle", "place", "ord")  # what only edges and the walk read
    groups = stored(match_groups(read, assigned))
    return items, groups, items.join(groups.select("item"), "item", "left_anti")


def matches_on(groups: DataFrame, sites: Sequence[str]) -> DataFrame:
    """The groups that have a member on every one of the sites."""
    whole = groups.groupBy("match").agg(F.collect_set("site").alias("sites")).where(F.size(F.array_intersect("sites", F.array(*map(F.lit, sites)))) == len(set(sites)))
    return groups.join(whole.select("match"), "match", "left_semi")
