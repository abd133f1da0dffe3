"""Operator 1: near-duplicates by SuperMinHash, banding, verification and union-find.

1. One pass over the texts gives each document its set of word shingles, a
   SuperMinHash signature (every element visits the slots in the order of a
   permutation of its own, so the slots' minima are correlated in a way that
   lowers their variance, and a document stops as soon as no further rank can
   lower a slot), and one key for each band of the signature.
2. Documents with equal sets form a class; from here on a class is one node,
   named by its smallest id (or by its hash, where that id stands on texts of
   several classes), so a group of copies of any size costs one.
3. Nodes that share a band key are candidates. They are confirmed on their
   full sets in three steps, each skipping nodes that are linked already:
   with the smallest node of all their bands, with the smallest node of each
   band, and at last all pairs across the components of a band, compared in
   blocks of bounded size: first their signatures, then, for nodes that have a
   close pair, the full sets. No step emits pairs, but for each node its
   partners of the first two steps, and in the third only links that join
   components.
4. Connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeops.llm import arrays as A
from storeops.llm.components import components
from storeops.llm.shared import Scratch, table

BANDS, ROWS = 40, 6
#: Nodes of a band that are compared with as many others in one block, at most.
BLOCK = 4096
#: Shingles that the nodes of a part of a block may have between them, about.
ELEMENTS = 2_000_000
#: Nodes of a band that are looked up in one task, about.
SPLIT = 512
#: Elements whose permutations are held at once.
SLICE = 1 << 16
#: In the third step, pairs whose signatures agree by this much less than the threshold aren't candidates, unless told otherwise: 5 standard deviations of the estimate.
MARGIN = 0.13
U = np.uint64
SPACED = A.word_table("space")


def shingles(offsets: np.ndarray, raw: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row of each): the distinct shingles of each text, sorted within it.

    A text of fewer words than a shingle has its whole sequence as one; a text without words has none.
    """
    data = A.LOWER[raw]
    starts, ends, row = A.runs(SPACED[data], offsets)
    w = A.span_hashes(data, starts, ends)
    n = len(offsets) - 1
    counts = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)])
    shift = lambda i: A.mix(w + U(A.mix_int(i + 1)))
    out = np.zeros(max(0, len(w) - words + 1), U)
    for i in range(words):
        out = out * U(A.MULTIPLIER) + shift(i)[i : i + len(out)]
    whole = (row[: len(out)] == row[words - 1 :][: len(out)]) if len(out) else np.zeros(0, bool)
    h, d = A.mix(out[whole]), row[: len(out)][whole]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        tail = np.zeros(len(short), U)
        for i in range(words - 1):
            has = counts[short] > i
            at = first[short[has]] + i
            tail[has] = A.mix(tail[has] * U(A.MULTIPLIER) + w[at] + U(A.mix_int(-1 - i)))
        h, d = np.concatenate([h, tail]), np.concatenate([d, short])
    order = np.argsort(h)
    order = order[np.argsort(d[order].astype(np.uint16), kind="stable")]
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def sets_of(column: pa.Array, words: int, most: int = A.CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashes, row of each) of the sets of runs of rows, sorted within each row.

    A long text comes in pieces. Each takes over the last ``words - 1`` words
    of those before it, so no shingle is lost and none is torn.
    """
    for at, to, pieces in A.text_runs(column, SPACED, most):
        if to - at > 1:
            yield (at, to, *shingles(*next(pieces), words))
            continue
        whole, short, tail = [np.zeros(0, U)], np.zeros(0, U), np.zeros(0, np.uint8)
        for _, data in pieces:
            data = np.concatenate([tail, data])
            bounds = np.array([0, len(data)])
            starts, _, _ = A.runs(SPACED[data], bounds)
            # With fewer words than a shingle, they are the whole text so far, or they stand in a shingle before.
            if len(starts) < words:
                short = shingles(bounds, data, words)[0]
            else:
                whole.append(shingles(bounds, data, words)[0])
            keep = min(words - 1, len(starts))
            tail = data[starts[-keep] :] if keep else data[:0]
        h = np.unique(np.concatenate(whole)) if len(whole) > 1 else short
        yield at, to, h, np.zeros(len(h), np.int64)


def superminhash(h: np.ndarray, row: np.ndarray, n: int, m: int) -> np.ndarray:
    """(n, m) signatures; the upper half of a slot is the least rank that met it, the lower half a random part."""
    sig = np.full(n * m, np.iinfo(np.uint64).max, U)
    for at in range(0, len(h), SLICE):
        e, d = h[at : at + SLICE], row[at : at + SLICE]
        first, last = int(d[0]), int(d[-1]) + 1
        perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(e), 1))
        i = np.arange(len(e))
        for j in range(m):
            r = A.mix(e + U((j + 1) * A.MULTIPLIER & (1 << 64) - 1))
            k = j + ((r & U(0xFFFFFFFF)) * U(m - j) >> U(32)).astype(np.int64)
            slot = perm[i, k]
            perm[i, k] = perm[:, j]
            np.minimum.at(sig, d * m + slot, U(j << 32) | (r >> U(32)))
            open_ = sig[first * m : last * m].reshape(-1, m).max(axis=1) >= U((j + 1) << 32)
            keep = open_[d - first]
            left = int(keep.sum())
            if not left:
                break
            if left < 0.7 * len(e):
                e, d, perm = e[keep], d[keep], perm[keep]
                i = np.arange(left)
    return sig.reshape(n, m)


def _signatures(words: int, bands: int, rows: int):
    names = ["id", "tie", "n", "hi", "lo", "bands", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = batch.column(0), batch.column(2)
            for at, to, h, row in sets_of(batch.column(1), words):
                n = to - at
                counts = np.bincount(row, minlength=n)
                full = np.flatnonzero(counts)
                place = np.cumsum(counts > 0) - 1
                sums = []
                for salt in (1, 2):
                    s = np.zeros(n, U)
                    if len(full):
                        s[full] = np.add.reduceat(A.mix(h ^ U(A.mix_int(salt))), np.concatenate([[0], np.cumsum(counts[full])[:-1]]))
                    sums.append(pa.array(A.signed(s)))
                sig = superminhash(h, place[row], len(full), bands * rows)
                parts = sig.reshape(len(full), bands, rows)
                keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) + U(1), (len(full), bands)).copy()
                for i in range(rows):
                    keys = A.mix(keys * U(A.MULTIPLIER) + parts[:, :, i])
                short = np.ascontiguousarray((A.mix(sig) & U(0xFF)).astype(np.uint8))
                lines = iter(short)
                yield pa.record_batch(
                    [
                        ids.slice(at, n),
                        ties.slice(at, n),
                        pa.array(counts.astype(np.int64)),
                        *sums,
                        A.long_list(A.signed(keys.reshape(-1)), np.where(counts > 0, bands, 0), pa.int64()),
                        pa.array([next(lines).tobytes() if c else b"" for c in counts], pa.binary()),
                    ],
                    names=names,
                )

    return run


def alike(mine: np.ndarray, hub: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets, neither empty, are linked."""
    small, large = sorted((mine, hub), key=len)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
    same = int((large[place] == small).sum())
    return 100 * same >= percent * (len(mine) + len(hub) - same)


def _confirm(words: int, percent: int):
    """Links of the rows that follow a hub with it; rows come as (b, salt, role, id, text), hubs with role 0 first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hub = None, np.zeros(0, U)
        for batch in batches:
            b, salt, role, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            links: list[tuple[int, int]] = []
            for at, to, h, row in sets_of(batch.column(4), words):
                first = np.searchsorted(row, np.arange(to - at + 1))
                for k in range(to - at):
                    mine, own = h[first[k] : first[k + 1]], (b[at + k], salt[at + k])
                    if role[at + k] == 0:
                        key, hub = own, mine
                    elif own == key and alike(mine, hub, percent):
                        links.append((int(ids[at + k]), int(own[0])))
            if links:
                yield pa.record_batch([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets. Each b comes once for a few hundred of its partners, so none is hot."""
    counts = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    salted = pairs.join(counts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / 256)).cast("int"))
    members = salted.select("b", "salt", F.lit(1).alias("role"), F.col("a").alias("id"))
    hubs = salted.select("b", "salt").distinct().select("b", "salt", F.lit(0).alias("role"), F.col("b").alias("id"))
    rows = members.unionByName(hubs).join(texts, "id").select("b", "salt", "role", "id", "text")
    dealt = rows.repartition("b", "salt").sortWithinPartitions("b", "salt", "role")
    return dealt.mapInArrow(_confirm(words, percent), "a bigint, b bigint")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows that agree in their first ``keys`` columns, which are integers; such rows come in a row."""
    key, held = None, []
    for batch in batches:
        values = np.stack([batch.column(k).to_numpy() for k in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(values)]
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            if at == to:
                continue
            now = tuple(values[at].tolist())
            if now != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(at, to - at))
    if held:
        yield key, pa.Table.from_batches(held)


def across(ids: np.ndarray, comp: np.ndarray, part: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) of the pairs of a block that lie in different components."""
    left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
    for x in left.tolist():
        others = right[comp[right] != comp[x]]
        if lo == hi:
            others = others[ids[others] > ids[x]]
        if len(others):
            yield x, others


def _close(least: float):
    """Rows (key, lo, hi, id) that have a pair across components of close signatures, of which this is the first common band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in grouped(batches, 3):
            ids, comp, part = (t.column(k).to_numpy() for k in (3, 4, 5))
            sig = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint8).reshape(len(ids), -1)
            bands = t.column(7).combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            active = np.zeros(len(ids), bool)
            for x, others in across(ids, comp, part, key[1], key[2]):
                near = others[(sig[others] == sig[x]).mean(axis=1) >= least]
                if len(near):
                    first = bands[x][(bands[near] == bands[x]).argmax(axis=1)]
                    near = near[first == key[0]]
                    active[near] = True
                    active[x] |= len(near) > 0
            if active.any():
                n = int(active.sum())
                yield pa.record_batch([*(pa.array(np.full(n, k)) for k in key), pa.array(ids[active])], names=["key", "lo", "hi", "id"])

    return run


def _link(words: int, percent: int):
    """Links of a block that join components, confirmed on full sets; rows are (key, lo, hi, id, comp, part, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in grouped(batches, 3):
            ids, comp, part = (t.column(k).to_numpy() for k in (3, 4, 5))
            comp = comp.copy()
            sets = []
            for at, to, h, row in sets_of(t.column(6).combine_chunks(), words):
                sets += np.split(h, np.searchsorted(row, np.arange(1, to - at)))
            sizes = np.array([len(x) for x in sets])
            _, flat = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            mine = np.zeros(int(flat.max(initial=-1)) + 1, np.int64)
            a, b = [], []
            for x, others in across(ids, comp, part, key[1], key[2]):
                own = flat[starts[x] : starts[x + 1]]
                mine[own] = 1
                same = np.add.reduceat(mine[flat], starts[:-1])[others]
                mine[own] = 0
                for y in others[100 * same >= percent * (sizes[x] + sizes[others] - same)].tolist():
                    if comp[x] != comp[y]:
                        a.append(int(ids[x]))
                        b.append(int(ids[y]))
                        comp[comp == max(comp[x], comp[y])] = min(comp[x], comp[y])
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, margin: float | None = MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept, text_hash (xxhash64 of the text).

    Words are runs of ``[^\\x20\\x09-\\x0D]`` after A-Z are lower-cased, the set of
    a document is its distinct shingles of ``words`` words (or its whole
    sequence, if shorter), and two documents are linked when
    ``100 * intersection >= percent * union``. At 80 percent two linked
    documents share no band, and so are missed, with probability
    (1 - 0.8**6)**40 = 5e-6, less where they are more alike. In the third step
    a pair must also agree in its signature, to ``margin`` below the
    threshold; with None every pair of a band is compared on its sets.

    Documents without words (null and blank texts) are linked with nothing.
    A very long text is worked on in pieces. A row without id has component_id
    null and is kept. Rows that share an id are judged apart, each by its own
    text; equal ones get equal results. An empty table gives an empty result;
    other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    sig = texts.mapInArrow(_signatures(words, bands, rows), "id bigint, tie bigint, n bigint, hi bigint, lo bigint, bands array<bigint>, sig binary")
    sig = scratch.write(sig.withColumn("row", F.monotonically_increasing_id()), "sig")
    full = sig.filter("n > 0 and id is not null")
    classes = full.groupBy("hi", "lo").agg(F.min(F.struct("id", "tie", "row")).alias("rep"))
    classes = scratch.write(classes.select("hi", "lo", F.col("rep.id").alias("rep"), F.col("rep.tie").alias("tie"), F.col("rep.row").alias("row")), "reps")
    several = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("rep", F.lit(True).alias("several"))
    node = F.when(F.col("several"), F.xxhash64("hi", "lo")).otherwise(F.col("rep"))
    classes = scratch.write(classes.join(several, "rep", "left").withColumn("node", node).drop("several"), "classes")
    nodes = full.drop("id").join(classes.select("row", F.col("node").alias("id")), "row")

    keyed = nodes.select("id", "n", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).filter("size > 1")
    # Written, so that both sides of the join are exchanged as they are and Spark can split a band key of many nodes.
    buckets = scratch.write(buckets, "buckets")
    members = scratch.write(keyed.drop("n").join(buckets, "key").select("key", "id", "b", "size", "total"), "members")
    scratch.drop("buckets")
    candidates = members.filter("id <> b").select(F.col("id").alias("a"), "b").distinct()
    # Only texts of nodes that share a band are looked at again.
    named = members.select("id").distinct().join(classes.select(F.col("node").alias("id"), F.col("rep"), "tie"), "id")
    held = texts.join(named.select(F.col("id").alias("node"), F.col("rep").alias("id"), "tie"), ["id", "tie"])
    held = scratch.write(held.groupBy("id", "tie").agg(F.first("node").alias("node"), F.first("text").alias("text")).select(F.col("node").alias("id"), "text"), "texts")

    scratch.release()
    first = candidates.groupBy("a").agg(F.min("b").alias("b"))
    links = scratch.write(confirm(first, held, words, percent), "links1")
    labels = scratch.write(components(links, scratch, "c1"), "labels1")
    scratch.release()

    def component(df: DataFrame, node: str, name: str) -> DataFrame:
        of = labels.select(F.col("node").alias(node), F.col("component").alias(name))
        return df.join(of, node, "left").withColumn(name, F.coalesce(name, node))

    apart = component(component(candidates.join(first, ["a", "b"], "left_anti"), "a", "ca"), "b", "cb").filter("ca <> cb")
    links2 = scratch.write(confirm(apart.select("a", "b"), held, words, percent), "links2")
    labels = scratch.write(components(links.unionByName(links2), scratch, "c2"), "labels2")
    scratch.release()

    # In a band of two, the one pair has been looked at.
    named = scratch.write(component(members.filter("size > 2"), "id", "comp"), "named")
    ends = named.filter("id <> b").groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("size").alias("size"))
    # A band of many nodes is looked up in several tasks.
    salts = F.ceil(F.col("size") / SPLIT)
    mixed = ends.filter("c0 <> c1").select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"))
    parts = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("total") / ELEMENTS)).cast("int")
    rest = named.withColumn("salt", F.pmod(F.xxhash64("id"), salts)).join(mixed, ["key", "salt"], "left_semi")
    rest = rest.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    block = ["key", "lo", "hi"]
    rest = scratch.write(rest.select("key", F.least("part", "other").cast("bigint").alias("lo"), F.greatest("part", "other").cast("bigint").alias("hi"), "id", "comp", "part"), "rest")
    scratch.release("members", "named", "labels1", "links1")
    looked = rest
    if margin is not None:
        drawn = rest.join(nodes.select("id", "sig", "bands"), "id").select(*block, "id", "comp", "part", "sig", "bands")
        drawn = drawn.repartition(*block).sortWithinPartitions(*block)
        active = scratch.write(drawn.mapInArrow(_close(percent / 100 - margin), "key bigint, lo bigint, hi bigint, id bigint").distinct(), "active")
        scratch.release()
        looked = rest.join(active, [*block, "id"], "left_semi")
    looked = looked.distinct().join(held, "id").select(*block, "id", "comp", "part", "text")
    looked = looked.repartition(*block).sortWithinPartitions(*block)
    links3 = scratch.write(looked.mapInArrow(_link(words, percent), "a bigint, b bigint"), "links3")
    # Components of the former step stand for their nodes.
    joined = component(component(links3, "a", "ca"), "b", "cb").select("ca", "cb")
    more = scratch.write(components(joined, scratch, "c3"), "labels3").select(F.col("node").alias("component_id"), F.col("component").alias("joined"))

    final = component(classes, "node", "component_id").join(more, "component_id", "left")
    final = scratch.write(final.select("hi", "lo", "node", "rep", F.coalesce("joined", "component_id").alias("component_id")), "final")
    # Names that aren't ids say nothing about the smallest id of their components.
    odd = final.filter("node <> rep").select("component_id").distinct()
    least = final.join(odd, "component_id", "left_semi").groupBy("component_id").agg(F.min("rep").alias("least"))
    final = final.join(scratch.write(least, "least"), "component_id", "left")
    final = final.select("hi", "lo", F.coalesce("least", "component_id").alias("component_id"))
    scratch.release("texts", "links2", "links3", "labels2", "labels3", "rest", "active", "classes", "reps")
    out = sig.select("id", "tie", "n", "hi", "lo").join(final, ["hi", "lo"], "left")
    component_id = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component_id.alias("component_id"),
        F.coalesce(component_id == F.col("id"), F.lit(True)).alias("kept"),
        F.col("tie").alias("text_hash"),
    )


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), words=2).drop("text_hash")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
         ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM documents d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""
