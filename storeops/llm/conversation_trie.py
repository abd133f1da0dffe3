"""Operator 11: a prefix trie of conversations by vertical bitmaps.

A node is a sequence of first turns. Conversations are dealt to shards by id
and their turns to stretches of positions, so a group holds a bounded number
of conversations and positions, however long or common one may be. A group's
index takes each (position, turn) to the bitset of its conversations; from the
bitset of a node, intersections with the postings of the next position give
its children depth first, and their popcounts, smallest ids and ends. What
shards find is added up by the key of the node: two 64-bit hashes of each
(position, turn), combined by exclusive or over the turns of the sequence, so
that a stretch begins with the keys of the stretches before it without
waiting for them.

Sums over subtrees need no step for each level: every node belongs to its
smallest conversation, which owns all nodes from some depth of its path on. A
second walk adds up, over a node's members, what they own in all, and what the
smallest member owns above the node is taken off again.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storeops.llm.shared import Scratch, table
from storeops.sources.pages import running_sum

#: Ids of a shard are 2 ** SHARD; positions of a group; turn numbers and depths that share a window.
SHARD, STRETCH, NUMBERS = 9, 64, 10_000
FOUND = "depth bigint, a bigint, b bigint, parent_a bigint, parent_b bigint, n_convs bigint, first bigint, n_points bigint, shard bigint, ends string"
SUMS = "a bigint, b bigint, weight bigint, leaves bigint"


def marked_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, n_points) by row: SHA-256 of role and text, code points of the text; null role or text counts as empty, rows without conv_id go."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    held = conversations.filter("conv_id is not null")
    return held.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.unhex(F.sha2(told.cast("binary"), 256)).alias("digest"), F.length(text).cast("bigint").alias("n_points"))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, position, digest, n_points): turns in order, from 1 on; null turns first, equal ones by digest.

    A conversation is numbered by stretches of turn numbers, so a long one
    needn't come whole into one task.
    """
    rows = turns.withColumn("_part", F.coalesce(F.floor(F.col("turn") / NUMBERS), F.lit(-(1 << 62)).cast("bigint")))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("_n"))
    later = counts.select("conv_id", "_part", F.sum("_n").over(before).alias("_before")).filter("_before is not null")
    within = Window.partitionBy("conv_id", "_part").orderBy(F.asc_nulls_first("turn"), "digest")
    rows = rows.withColumn("_k", F.row_number().over(within)).join(later, ["conv_id", "_part"], "left")
    return rows.select("conv_id", (F.col("_k") + F.coalesce("_before", F.lit(0))).cast("bigint").alias("position"), "digest", "n_points")


def _lanes(position: Column, digest: Column) -> tuple[Column, Column]:
    return F.xxhash64(position, digest), F.xxhash64(digest, position)


def stretches(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each conversation of ``ids`` and stretch of its positions: the turns in order, the key of all before, and whether it ends there."""
    a, b = _lanes(F.col("position"), F.col("digest"))
    rows = turns.select("conv_id", "position", a.alias("a"), b.alias("b"), "n_points")
    none = ids.select("conv_id", F.lit(0).cast("bigint").alias("position"), *(F.lit(None).cast("bigint").alias(c) for c in ("a", "b", "n_points")))
    rows = rows.unionByName(none).withColumn("stretch", F.floor(F.greatest(F.col("position") - 1, F.lit(0)) / STRETCH))
    held = F.array_sort(F.collect_list(F.when(F.col("position") > 0, F.struct("position", "a", "b", "n_points"))))  # STRETCH at most
    rows = rows.groupBy("conv_id", "stretch").agg(held.alias("held"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    order = Window.partitionBy("conv_id").orderBy("stretch")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        F.shiftright("conv_id", SHARD).alias("shard"),
        "stretch",
        "conv_id",
        *(F.coalesce(F.bit_xor(c).over(before), F.lit(0).cast("bigint")).alias(c) for c in ("a", "b")),
        *(F.col(f"held.{c}").alias(f"turns_{c}") for c in ("a", "b", "n_points")),
        F.lead("stretch").over(order).isNull().alias("ends"),
    )


def places(bits: int) -> Iterator[int]:
    """The places of the set bits, lowest first."""
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def walk(keys: list[tuple[int, int]], turns: list[list[tuple[int, int, int]]], ends: list[bool]) -> Iterator[tuple[int, tuple[int, int], tuple[int, int] | None, int, int, int]]:
    """(level, key, parent's key, bits, bits that end here, code points of the last turn) of the nodes of a group, depth first.

    Conversations are places in the lists: the key of what comes before, the
    turns (two lanes of the hash, code points), whether it ends with them.
    Level 0 are the nodes that the conversations come in with, without parent.
    """
    postings: dict[tuple[int, int, int], int] = defaultdict(int)
    alive, ended, frontier = defaultdict(int), defaultdict(int), defaultdict(int)
    for place, own in enumerate(turns):
        bit = 1 << place
        frontier[keys[place]] |= bit
        for level, (a, b, _) in enumerate(own):
            postings[level, a, b] |= bit
            alive[level] |= bit
        if ends[place]:
            ended[len(own)] |= bit
    stack = []
    for key, bits in frontier.items():
        yield 0, key, None, bits, bits & ended[0], 0
        stack.append((0, key, bits))
    while stack:
        level, key, bits = stack.pop()
        rest = bits & alive[level]
        while rest:
            a, b, n_points = turns[(rest & -rest).bit_length() - 1][level]
            child = rest & postings[level, a, b]
            rest ^= child
            under = key[0] ^ a, key[1] ^ b
            yield level + 1, under, key, child, child & ended[level + 1], n_points
            stack.append((level + 1, under, child))


def _group(rows: pa.Table) -> tuple[list[int], list, list, list, pa.Table]:
    rows = rows.sort_by("conv_id")
    lanes = (rows[f"turns_{c}"].to_pylist() for c in ("a", "b", "n_points"))
    return rows["conv_id"].to_pylist(), list(zip(rows["a"].to_pylist(), rows["b"].to_pylist(), strict=True)), [list(zip(*x, strict=True)) for x in zip(*lanes, strict=True)], rows["ends"].to_pylist(), rows


def _arrow(rows: list[tuple], ddl: str) -> pa.Table:
    names = [c.split()[0] for c in ddl.split(", ")]
    kinds = [pa.string() if c.split()[1] == "string" else pa.int64() for c in ddl.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.table({n: pa.array(c, k) for n, k, c in zip(names, kinds, columns, strict=True)})


def _find(key: tuple, rows: pa.Table) -> pa.Table:
    """The nodes that begin in a group; the root only in the first stretch."""
    shard, stretch = (int(k.as_py()) for k in key)
    ids, keys, turns, ends, _ = _group(rows)
    out = []
    for level, at, parent, bits, ended, n_points in walk(keys, turns, ends):
        if level or not stretch:
            first = ids[(bits & -bits).bit_length() - 1]
            told = ",".join(str(ids[k]) for k in places(ended)) if ended else None
            out.append((stretch * STRETCH + level, *at, *(parent or (None, None)), bits.bit_count(), first, n_points, shard, told))
    return _arrow(out, FOUND)


def _sum(key: tuple, rows: pa.Table) -> pa.Table:
    """The sums of the members' weights and leaves by node."""
    ids, keys, turns, ends, rows = _group(rows)
    weights, leaves = rows["weight"].to_pylist(), rows["leaves"].to_pylist()
    some = sum(1 << k for k in range(len(ids)) if weights[k] or leaves[k])
    out = []
    for level, at, _, bits, _, _ in walk(keys, turns, ends):
        if (level or not key[1].as_py()) and bits & some:
            members = list(places(bits & some))
            out.append((*at, sum(weights[k] for k in members), sum(leaves[k] for k in members)))
    return _arrow(out, SUMS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined texts of each key, row after row; rows come sorted."""
    at, digest, out = None, None, []
    for batch in batches:
        for a, b, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if (a, b) != at:
                if digest:
                    out.append((*at, digest.hexdigest()))
                at, digest = (a, b), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        yield from _arrow(out, "a bigint, b bigint, ends_sha256 string").to_batches()
        out = []
    if digest:
        yield from _arrow([(*at, digest.hexdigest())], "a bigint, b bigint, ends_sha256 string").to_batches()


def prefix_trie(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row for each node of the trie of all conversations, by (conv_id, position, digest, n_points) as :func:`numbered` gives them.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256 as the contract of operator 11 has
    them, and the node's key (a, b). Positions of a conversation are 1, 2, ...
    without gaps; ``ids`` (conv_id) are all conversations, also those without
    turns. Ids are whole numbers, not null; repeated ones are one conversation.
    Texts of any length are digests here; conversations may have any number
    of turns and members of a node any number. An empty table gives an empty
    result, not even a root, since that has no smallest member.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "trie")
    ids = (turns if ids is None else ids).select("conv_id").distinct()
    rows = scratch.write(stretches(turns, ids), "stretches")
    found = scratch.write(rows.groupBy("shard", "stretch").applyInArrow(_find, FOUND), "found")
    parents = [F.max(c).alias(c) for c in ("parent_a", "parent_b")]
    merged = found.groupBy("a", "b").agg(F.max("depth").alias("depth"), *parents, F.sum("n_convs").alias("n_convs"), F.min("first").alias("conv_id"), F.max("n_points").alias("n_points"))
    merged = scratch.write(merged, "merged")
    children = merged.filter("depth > 0").groupBy(F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = merged.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    nodes = nodes.withColumn("weight", (F.col("n_convs") - 1) * F.col("n_points"))
    nodes = scratch.write(running_sum(nodes, "conv_id", "depth", F.col("weight"), "down_to", NUMBERS), "nodes")
    owned = nodes.groupBy("conv_id").agg(F.sum("weight").alias("weight"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    zero = F.lit(0).cast("bigint")
    weighed = rows.join(owned, "conv_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("weight", "leaves")})
    sums = weighed.groupBy("shard", "stretch").applyInArrow(_sum, SUMS).groupBy("a", "b").agg(F.sum("weight").alias("all_weight"), F.sum("leaves").alias("n_leaves"))
    ends = found.filter("ends is not null").select("a", "b", "ends", "shard").repartition("a", "b").sortWithinPartitions("a", "b", "shard")
    ends = ends.mapInArrow(_digests, "a bigint, b bigint, ends_sha256 string")
    # A plain join: the children of a very common parent are split by adaptive execution.
    above = merged.select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(above, ["parent_a", "parent_b"], "left").join(sums, ["a", "b"], "left").join(ends, ["a", "b"], "left")
    return whole.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", zero).alias("n_leaves"),
        (F.coalesce("all_weight", zero) - F.col("down_to") + F.col("weight")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        "a",
        "b",
    )


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, ids) of the conversations that operator 11 speaks of, from numbered turns.

    Conversation c begins with the first h turns of conversation c - c % group,
    h = crc32(c as text) % most, and goes on with its own turns after its
    first h. Where that other one is shorter or absent, it begins with fewer.
    """
    ids = turns.select("conv_id").distinct()
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    ids = ids.select("conv_id", h, (F.col("conv_id") - F.col("conv_id") % group).alias("head"))
    heads = turns.filter((F.col("conv_id") % group == 0) & (F.col("position") < most)).withColumnRenamed("conv_id", "head")
    begun = ids.join(heads, "head").filter("position <= h").select("conv_id", "position", "digest", "n_points")
    lengths = heads.groupBy("head").agg(F.max("position").alias("length"))
    short = ids.join(lengths, "head", "left").select("conv_id", (F.col("h") - F.coalesce("length", F.lit(0))).alias("missing")).filter("missing > 0")
    own = turns.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).filter("position > h").join(short, "conv_id", "left")
    own = own.select("conv_id", (F.col("position") - F.coalesce("missing", F.lit(0))).cast("bigint").alias("position"), "digest", "n_points")
    return begun.unionByName(own), ids.select("conv_id")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "turns")
    turns = scratch.write(numbered(marked_turns(table(spark, sf_dir, "conversations"))), "numbered")
    return prefix_trie(*rebuilt(turns)).drop("a", "b")


ORACLE = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ord(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
           lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS own, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND p <= h
  UNION ALL SELECT conv_id, 1, p, role, text FROM c JOIN t USING (conv_id) WHERE p > h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS d, role, text FROM r),
m AS (
  SELECT conv_id, 0 AS d, '' AS k, 0 AS n FROM c
  UNION ALL SELECT conv_id, d, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d), length(text) FROM s),
node AS (SELECT k, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM m GROUP BY k),
up AS (SELECT node.k, p.k AS parent FROM node JOIN m p ON p.conv_id = node.conv_id AND p.d = node.d - 1),
kids AS (SELECT parent AS k, count(*) AS n_children FROM up GROUP BY parent),
under AS (
  SELECT top.k, sum((u.n_convs - 1) * u.n) AS saved, count(*) FILTER (kids.k IS NULL) AS leaves
  FROM node u LEFT JOIN kids ON kids.k = u.k JOIN m top ON top.conv_id = u.conv_id AND top.d <= u.d GROUP BY top.k),
last AS (SELECT conv_id, max_by(k, d) AS k FROM m GROUP BY conv_id),
ends AS (SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM last GROUP BY k)
SELECT node.conv_id, node.d::BIGINT AS depth, p.conv_id AS parent_conv_id, node.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node LEFT JOIN up USING (k) LEFT JOIN node p ON p.k = up.parent LEFT JOIN kids ON kids.k = node.k JOIN under ON under.k = node.k LEFT JOIN ends ON ends.k = node.k
"""
