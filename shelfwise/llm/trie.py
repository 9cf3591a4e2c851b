"""Prefix trie of conversations, from vertical bitmaps.

Conversations are cut into shards by ranges of their id and into bands of ``BAND`` turns. Each shard and
band has an index from (position, turn) to the bitset of its conversations that have the turn there. A
walk in depth meets a node's bitset with the postings of the next position: what is left of it are the
children, the bits in it their members, and the conversations without a next turn are its end list. The
nodes of all shards are then merged by path: numbers add up, the smallest member is the smallest of all.

Sums over a subtree need no walk over the whole trie. Every node belongs to its smallest member, and a
member that has a node of its path has all below it. So what a subtree holds is the sum, over the
members of its top, of what each has: one grouping of the turns by path.

Turns are told apart by SHA-256 cut to 128 bits, paths by 128 bits over the turns and their positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.shared import map_batches, materialize, work_dir

#: Turns of a conversation that one unit of work holds, and turns that a shard has in its first band, about.
BAND, SHARD = 64, 20_000
#: At most so many turns are taken from another conversation, and conversations of so many ids share one.
HEAD, SHARED = 5, 100

NODE = ["depth", "hi", "lo"]
PARTIAL = "depth long, hi long, lo long, up_hi long, up_lo long, first long, members long, chars long, path_chars long, ends array<bigint>"


def crc32_of(id_col: Column) -> Column:
    """Unsigned CRC32 of an id in decimal."""
    return F.crc32(id_col.cast("string").cast("binary"))


def ordered_turns(rows: DataFrame, at: str) -> DataFrame:
    """``conv_id``, ``pos`` from 0, ``turn_key``, ``chars`` and ``shard``, which never falls as ids grow.

    Rows are dealt into ranges of (id, turn), so that one long conversation is in many tasks; a position is
    that within the task and the number of the conversation's rows in tasks before.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    turns = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)).alias("turn_key"),
        F.length(text).cast("long").alias("chars"),
    )
    turns = materialize(turns, f"{at}/keys")
    ranges = max(1, -(-turns.count() // SHARD))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("turn_key")]
    placed = materialize(turns.repartitionByRange(ranges, *order).withColumn("shard", F.spark_partition_id()), f"{at}/ranges")
    own = F.row_number().over(Window.partitionBy("shard", "conv_id").orderBy(*order[1:]))
    counts = placed.groupBy("conv_id", "shard").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv_id", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.min("shard").over(Window.partitionBy("conv_id")).alias("home"))
    return placed.withColumn("own", own).join(starts, ["conv_id", "shard"]).select("conv_id", (F.col("before") + F.col("own") - 1).alias("pos"), "turn_key", "chars", F.col("home").alias("shard"))


def rebuilt(turns: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Turns with the heads of other conversations in place of their own, and all conversations.

    Conversation c has the first h turns of c - c % 100, then its own but the first h; h is the CRC32 of c
    in decimal, modulo 6. A conversation may be left without turns.
    """
    base = F.col("conv_id") - F.col("conv_id") % SHARED
    convs = turns.groupBy("conv_id").agg(F.min("shard").alias("shard")).select("conv_id", "shard", base.alias("base"), (crc32_of(F.col("conv_id")) % (HEAD + 1)).alias("h"))
    heads = turns.where((F.col("conv_id") % SHARED == 0) & (F.col("pos") < HEAD)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "turn_key", "chars"))).alias("head"))  # at most HEAD of them
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,turn_key:binary,chars:bigint>>")), 1, F.col("h").cast("int")))
    convs = materialize(convs.select("conv_id", "shard", "h", F.size("head").cast("long").alias("taken"), "head"), f"{at}/conversations")
    taken = convs.select("conv_id", "shard", F.posexplode("head").alias("pos", "t")).select("conv_id", F.col("pos").cast("long").alias("pos"), "t.turn_key", "t.chars", "shard")
    h = crc32_of(F.col("conv_id")) % (HEAD + 1)
    kept = turns.where(F.col("pos") >= h).join(convs.select("conv_id", F.col("taken")), "conv_id")
    kept = kept.select("conv_id", (F.col("pos") - h + F.col("taken")).alias("pos"), "turn_key", "chars", "shard")
    return taken.unionByName(kept), convs.select("conv_id", "shard")


def with_paths(turns: DataFrame) -> DataFrame:
    """Adds to each turn the path that ends with it (``hi``, ``lo``, ``path_chars``, the last without the turn
    itself), by bands: running values within a band start from those of the bands before."""
    tagged = turns.withColumn("band", F.floor(F.col("pos") / BAND)).withColumns({"a": F.xxhash64(F.lit(1), "pos", "turn_key"), "b": F.xxhash64(F.lit(2), "turn_key", "pos")})
    bands = tagged.groupBy("conv_id", "band").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("chars").alias("chars"))
    earlier = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = bands.select(
        "conv_id", "band", F.coalesce(F.bit_xor("a").over(earlier), zero).alias("from_hi"), F.coalesce(F.bit_xor("b").over(earlier), zero).alias("from_lo"),
        F.coalesce(F.sum("chars").over(earlier), zero).alias("from_chars"), F.sum("chars").over(Window.partitionBy("conv_id")).alias("total"),
        (F.max("band").over(Window.partitionBy("conv_id")) == F.col("band")).alias("last"),
    )
    within = Window.partitionBy("conv_id", "band").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = tagged.select("conv_id", "band", "shard", "pos", "turn_key", "chars", F.bit_xor("a").over(within).alias("in_hi"), F.bit_xor("b").over(within).alias("in_lo"), (F.sum("chars").over(within) - F.col("chars")).alias("in_chars"))
    return running.join(starts, ["conv_id", "band"]).select(
        "shard", "band", "conv_id", "pos", "turn_key", "chars", F.col("in_hi").bitwiseXOR(F.col("from_hi")).alias("hi"), F.col("in_lo").bitwiseXOR(F.col("from_lo")).alias("lo"),
        (F.col("in_chars") + F.col("from_chars")).alias("path_chars"), "total", "last", "from_hi", "from_lo",
    )


def bits_of(members: np.ndarray, size: int) -> int:
    flags = np.zeros(size, bool)
    flags[members] = True
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


class VerticalIndex:
    """Bitsets of the conversations of one shard and band, by (position, turn). Units are numbered in the
    order of their ids, so a bitset's lowest bit is its smallest member."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("conv_id", "ascending"), ("pos", "ascending")])
        self.t = {c: table.column(c).to_numpy() for c in ("conv_id", "pos", "chars", "hi", "lo", "path_chars", "from_hi", "from_lo")}
        keys = table.column("turn_key").to_pylist()
        conv = self.t["conv_id"]
        self.first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        self.size, self.after = len(self.first), np.r_[self.first[1:], len(conv)]
        unit, depth = np.repeat(np.arange(self.size), self.after - self.first), self.t["pos"].tolist()
        groups: dict[tuple[int, bytes], list[int]] = {}
        for u, d, k in zip(unit.tolist(), depth, keys):
            groups.setdefault((d, k), []).append(u)
        self.postings = {at: bits_of(np.array(g), self.size) if len(g) > 1 else 1 << g[0] for at, g in groups.items()}
        self.keys, self.last = keys, table.column("last").to_pylist()

    def row(self, unit: int, depth: int) -> int | None:
        """The row of a unit's turn at a position, if it has one."""
        at = self.first[unit] + depth - self.t["pos"][self.first[unit]]
        return int(at) if at < self.after[unit] else None

    def starts(self) -> Iterator[tuple[int, int]]:
        """Position and bitset of the units that come to this band by one path."""
        t, found = self.t, {}
        for u, r in enumerate(self.first.tolist()):
            found.setdefault((int(t["pos"][r]), int(t["from_hi"][r]), int(t["from_lo"][r])), []).append(u)
        for (depth, _, _), units in found.items():
            yield depth, bits_of(np.array(units), self.size)

    def children(self, depth: int, members: int) -> Iterator[tuple[int, int]]:
        """A row and the bitset of each child of a node, by its members' turns at position ``depth``."""
        while members:
            low = (members & -members).bit_length() - 1
            row = self.row(low, depth)
            if row is None:
                members &= members - 1
                continue
            child = members & self.postings[depth, self.keys[row]]
            yield row, child
            members &= ~child

    def nodes(self) -> Iterator[tuple]:
        """All nodes in depth-first order, with the ends that lie in this band."""
        t, stack = self.t, list(self.starts())
        while stack:
            depth, members = stack.pop()
            for row, child in self.children(depth, members):
                unit = (child & -child).bit_length() - 1
                ends, left = [], child
                while left:
                    u = (left & -left).bit_length() - 1
                    left &= left - 1
                    if self.row(u, depth + 1) is None and self.last[self.first[u]]:
                        ends.append(int(t["conv_id"][self.first[u]]))
                above = row - 1 if row > self.first[unit] else None
                up = (t["hi"][above], t["lo"][above]) if above is not None else (t["from_hi"][row], t["from_lo"][row])
                yield depth + 1, t["hi"][row], t["lo"][row], *up, t["conv_id"][row], child.bit_count(), t["chars"][row], t["path_chars"][row], ends
                stack.append((depth + 1, child))


def shard_nodes(table: pa.Table) -> pa.Table:
    """The nodes of one shard and band."""
    names = [f.split()[0] for f in PARTIAL.split(", ")]
    columns = list(zip(*VerticalIndex(table).nodes())) or [[]] * len(names)
    kinds = [pa.int64()] * (len(names) - 1) + [pa.list_(pa.int64())]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's end list; the shards' pieces come in the order of their ids, one at a time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for *node, piece in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if node != now:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, piece)).encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*NODE, "ends_sha256"])
                out = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, state.hexdigest())], [*NODE, "ends_sha256"])

    pieces = ends.repartition(*NODE).sortWithinPartitions(*NODE, F.col("ends")[0]).select(*NODE, "ends")
    return map_batches(pieces, digest, "depth long, hi long, lo long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations (see ``rebuilt``), with its smallest member
    ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    (over its subtree, characters of each node's last text times the members but one) and ``ends_sha256``.

    Rows are in the order of ``turn``, null first; equal turns in that of the SHA-256 of role and text, so
    repeated rows are turns each. Null roles and texts are empty. Rows without id take no part, and other
    columns are not read. The root, the textless node of depth 0, has all conversations, also those that
    are left without turns; an empty table has no root. Turns and conversations may be as long as they like.
    """
    at = work_dir(conversations.sparkSession)
    turns, convs = rebuilt(materialize(ordered_turns(conversations, at), f"{at}/turns"), at)
    paths = materialize(with_paths(turns), f"{at}/paths")
    bitmaps = paths.select("shard", "band", "conv_id", "pos", "turn_key", "chars", "hi", "lo", "path_chars", "last", "from_hi", "from_lo")
    partial = materialize(bitmaps.groupBy("shard", "band").applyInArrow(shard_nodes, PARTIAL), f"{at}/partial")

    zero = F.lit(0).cast("long")
    totals = paths.groupBy("conv_id").agg(F.max("total").alias("total"))
    members = materialize(convs.join(totals, "conv_id", "left").select("conv_id", "shard", F.coalesce("total", zero).alias("total")), f"{at}/members")
    turnless = convs.join(totals, "conv_id", "left_anti").groupBy("shard").agg(F.sort_array(F.collect_list("conv_id")).alias("ends"))  # of one shard's range of ids
    ends = partial.where("size(ends) > 0").select(*NODE, "ends").unionByName(turnless.select(zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), "ends"))
    root = members.groupBy(*[zero.alias(c) for c in NODE]).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), zero.alias("chars"), zero.alias("path_chars"), zero.alias("up_hi"), zero.alias("up_lo"))
    nodes = partial.groupBy(*NODE).agg(F.min("first").alias("conv_id"), F.sum("members").alias("n_convs"), F.max("chars").alias("chars"), F.max("path_chars").alias("path_chars"), F.max("up_hi").alias("up_hi"), F.max("up_lo").alias("up_lo"))
    nodes = materialize(nodes.unionByName(root), f"{at}/merged")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)), f"{at}/nodes")

    # What each conversation has: the nodes from the first of which it is the smallest member on.
    owners = nodes.groupBy("conv_id").agg(F.min_by("path_chars", "depth").alias("before"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    held = members.join(owners, "conv_id", "left").select("conv_id", "total", F.coalesce(F.col("total") - F.col("before"), zero).alias("tail"), F.coalesce("leaf", zero).alias("leaf"))
    held = materialize(held, f"{at}/held")
    on_path = paths.select("conv_id", (F.col("pos") + 1).alias("depth"), "hi", "lo").join(held, "conv_id")
    on_path = on_path.unionByName(held.select("conv_id", *[zero.alias(c) for c in NODE], "total", "tail", "leaf"))
    sums = on_path.groupBy(*NODE).agg(F.sum("total").alias("all_chars"), F.sum("tail").alias("own_chars"), F.sum("leaf").alias("n_leaves"))
    top = held.select("conv_id", F.col("total").alias("top_total"), F.col("tail").alias("top_tail"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(sums, NODE).join(top, "conv_id").join(parents, ["depth", "up_hi", "up_lo"], "left").join(end_digests(ends), NODE, "left")
    texts = F.col("all_chars") - F.col("n_convs") * F.col("path_chars")
    distinct = F.col("own_chars") - F.col("top_tail") + F.col("top_total") - F.col("path_chars")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (texts - distinct).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


ORACLE = """
WITH RECURSIVE bits(k, c, i) AS (
  SELECT range, range, 0 FROM range(256) UNION ALL
  SELECT k, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i + 1 FROM bits WHERE i < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY k) AS t FROM bits WHERE i = 8),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      substr(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS MATERIALIZED (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY pos) AS ts FROM turns GROUP BY conv_id),
heads AS (
  SELECT l.conv_id, l.ts, b.ts AS bs, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(l.conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: xor(c // 256, crc.t[xor(c, x) % 256 + 1]))) % 6 AS h
  FROM lists l CROSS JOIN crc LEFT JOIN lists b ON b.conv_id = l.conv_id - l.conv_id % 100),
built AS MATERIALIZED (
  SELECT conv_id, list_concat(coalesce(list_slice(bs, 1, h), []), coalesce(list_slice(ts, h + 1, len(ts)), [])) AS p FROM heads),
steps AS MATERIALIZED (SELECT conv_id, p, unnest(range(len(p) + 1)) AS d FROM built),
nodes AS MATERIALIZED (
  SELECT d, list_slice(p, 1, d) AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(p) = d), '')) AS ends_sha256
  FROM steps GROUP BY ALL),
kids AS MATERIALIZED (SELECT d - 1 AS d, list_slice(path, 1, d - 1) AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
own AS MATERIALIZED (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * length(n.path[n.d].t) END AS saved
  FROM nodes n LEFT JOIN kids k ON k.d = n.d AND k.path = n.path),
under AS (SELECT list_slice(path, 1, u) AS path, saved, (n_children = 0)::BIGINT AS leaf FROM (SELECT *, unnest(range(d + 1)) AS u FROM own)),
sums AS (SELECT path, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM under GROUP BY path)
SELECT o.conv_id, o.d AS depth, CASE WHEN o.d > 0 THEN u.conv_id END AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens, o.ends_sha256
FROM own o JOIN sums s ON s.path = o.path LEFT JOIN own u ON u.d = o.d - 1 AND u.path = list_slice(o.path, 1, o.d - 1)
"""
