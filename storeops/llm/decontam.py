"""Operator 4: benchmark decontamination by a generalised suffix automaton.

An automaton holds the words of test items, an item after the other; the
items are dealt to shards of bounded size, each built by one task and packed
into flat arrays. Texts are tokenised in whole batches; word pairs that no
item has cut them into runs, and only runs that are long enough to hold a
window are streamed through the automata, many runs abreast, tracking the
longest match that ends at each word. No text is shuffled.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeops.llm import arrays as A
from storeops.llm.shared import Scratch, ascii_lower, importable, passed, table

WINDOW = 10
#: Bytes of item texts in one automaton, about (some 14 MB of it), and automata that a pass over the texts holds; a larger benchmark takes several passes.
SHARD_BYTES, SHARDS = 1_000_000, 6
#: Words of a run that are streamed in a row; longer runs come in pieces that share what a window needs.
PIECE = 256
FILTER_BITS = 20
U = np.uint64


WORD = A.word_table("alnum")


def words(column: pa.Array, most: int = A.CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hash, start, end, row) of the words of runs of rows; places are in the bytes of the run.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A long text is tokenised piece by piece.
    """
    for at, to, pieces in A.text_runs(column, WORD, most):
        found, base = [], 0
        for offsets, data in pieces:
            starts, ends, row = A.runs(WORD[data], offsets)
            found.append((A.span_hashes(data, starts, ends), starts + base, ends + base, row))
            base += len(data)
        yield (at, to, *(found[0] if len(found) == 1 else map(np.concatenate, zip(*found, strict=True))))


def lookup(sorted_keys: np.ndarray, maybe: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in ``sorted_keys``, -1 where absent; ``maybe`` tells most absent ones at once."""
    out = np.full(len(keys), -1, np.int64)
    held = np.flatnonzero(maybe[(keys & U(len(maybe) - 1)).astype(np.int64)])
    if len(held) and len(sorted_keys):
        place = np.minimum(np.searchsorted(sorted_keys, keys[held]), len(sorted_keys) - 1)
        same = sorted_keys[place] == keys[held]
        out[held[same]] = place[same]
    return out


def filter_of(keys: np.ndarray) -> np.ndarray:
    maybe = np.zeros(1 << FILTER_BITS, bool)
    maybe[(keys & U(len(maybe) - 1)).astype(np.int64)] = True
    return maybe


class Builder:
    """Suffix automaton of several word sequences as it grows: transitions, suffix link and length of each state."""

    def __init__(self) -> None:
        self.after: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def extend(self, last: int, w: int) -> int:
        after, link, length = self.after, self.link, self.length
        if w in after[last]:  # a prefix that an earlier item has brought in
            q = after[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, q, w)
        now = len(after)
        after.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in after[p]:
            after[p][w] = now
            p = link[p]
        if p != -1:
            q = after[p][w]
            link[now] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return now

    def _clone(self, p: int, q: int, w: int) -> int:
        copy = len(self.after)
        self.after.append(dict(self.after[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p != -1 and self.after[p].get(w) == q:
            self.after[p][w] = copy
            p = self.link[p]
        return copy


@dataclass
class Automaton:
    """A packed suffix automaton, with what a match of each length stands for.

    A window is ``window`` words of an item in a row, or a shorter item as a whole.
    """

    window: int
    #: Words of the shortest window.
    least: int
    vocabulary: np.ndarray
    pairs: np.ndarray
    #: Transitions by state * words + word.
    keys: np.ndarray
    to: np.ndarray
    link: np.ndarray
    length: np.ndarray
    #: For a state at least as long as the window, the state of its last ``window`` words.
    gram: np.ndarray
    #: The first state on the way of links that stands for a short item, itself included; 0 is none.
    near: np.ndarray
    #: Names of the items in order, and (state, item) of the windows and (state, words, item) of the short items by state; an item without name is -1.
    names: list[str]
    gram_items: tuple[np.ndarray, np.ndarray]
    short_items: tuple[np.ndarray, np.ndarray, np.ndarray]

    @classmethod
    def of(cls, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Automaton:
        sequences: list[np.ndarray] = [np.zeros(0, U)] * len(items)
        for at, to, h, _, _, row in words(pa.array([t for _, t in items], pa.large_string())):
            sequences[at:to] = np.split(h, np.searchsorted(row, np.arange(1, to - at)))
        vocabulary = np.unique(np.concatenate([np.zeros(0, U), *sequences]))
        ids = [np.searchsorted(vocabulary, x) for x in sequences]
        grown = Builder()
        for seq in ids:
            last = 0
            for w in seq.tolist():
                last = grown.extend(last, w)
        v = len(vocabulary)
        sizes = np.array([len(x) for x in grown.after])
        state = np.repeat(np.arange(len(sizes)), sizes)
        word = np.fromiter((w for x in grown.after for w in x), np.int64, len(state))
        to_ = np.fromiter((q for x in grown.after for q in x.values()), np.int64, len(state))
        link, length = np.array(grown.link), np.array(grown.length)
        del grown
        by = np.argsort(state * v + word)
        order = np.argsort(length, kind="stable")[1:].tolist()
        gram, near = np.zeros(len(link), np.int64), np.zeros(len(link), np.int64)
        for s in order:
            if length[s] >= window:
                gram[s] = gram[link[s]] if length[link[s]] >= window else s
        names = sorted({n for n, _ in items if n is not None})
        place = {n: k for k, n in enumerate(names)}
        mine = np.array([-1 if n is None else place[n] for n, _ in items], np.int64)
        self = cls(
            window, min((min(window, len(x)) for x in ids if len(x)), default=window), vocabulary,
            np.unique(np.concatenate([np.zeros(0, U), *(pair_keys(x, v) for x in ids)])),
            (state * v + word)[by], to_[by].astype(np.int32), link, length, gram, near, names, (near, near), (near, near, near),
        )
        bounds = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int64)
        states, matched = self.walk(np.concatenate([np.zeros(0, np.int64), *ids]), bounds[:-1], bounds[1:])
        item = np.repeat(mine, np.diff(bounds))
        long = matched >= window
        pairs = np.unique(np.stack([self.gram[states[long]], item[long]]), axis=1)
        self.gram_items = pairs[0], pairs[1]
        short: set[tuple[int, int, int]] = set()
        for k, seq in enumerate(ids):
            if 0 < len(seq) < window:
                s = int(states[bounds[k + 1] - 1])
                while length[link[s]] >= len(seq):
                    s = int(link[s])
                short.add((s, len(seq), int(mine[k])))
        table_ = np.array(sorted(short), np.int64).reshape(-1, 3).T
        self.short_items = table_[0], table_[1], table_[2]
        held = np.zeros(len(link), bool)
        held[table_[0]] = True
        for s in order:
            near[s] = s if held[s] else near[link[s]]
        return self

    def walk(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, length of the longest match that ends there) at each place of ``ids``, for runs that are walked abreast."""
        states, matched = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        by = np.argsort(starts - ends, kind="stable")
        starts, sizes = starts[by], (ends - starts)[by]
        s, n, v = np.zeros(len(by), np.int64), np.zeros(len(by), np.int64), len(self.vocabulary)
        for t in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-sizes, -t, side="left"))
            s, n, at = s[:live], n[:live], starts[:live] + t
            w, open_ = ids[at], np.arange(live)
            while len(open_):
                key = s[open_] * v + w[open_]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[place] == key
                s[open_[found]] = self.to[place[found]]
                n[open_[found]] += 1
                lost = open_[~found]
                # At the root there is no shorter match to try.
                n[lost[s[lost] == 0]] = 0
                open_ = lost[s[lost] > 0]
                s[open_] = self.link[s[open_]]
                n[open_] = self.length[s[open_]]
            states[at], matched[at] = s, n
        return states, matched

    def hits(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of windows in runs of words, (first place, place after the last), and (place, item) of the items they are of."""
        # A long run in pieces: each begins with the words that a window across the cut would have before it.
        count = np.maximum(1, -(-(ends - starts) // PIECE))
        piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        lo = np.repeat(starts, count) + piece * PIECE
        hi = np.minimum(lo + PIECE, np.repeat(ends, count))
        lo = np.where(piece > 0, lo - self.window + 1, lo)
        flat = np.append(0, np.cumsum(hi - lo))
        at = np.repeat(lo - flat[:-1], hi - lo) + np.arange(flat[-1])
        states, matched = self.walk(ids[at], flat[:-1], flat[1:])
        long = matched >= self.window
        firsts, lasts = [at[long] - self.window + 1], [at[long] + 1]
        places, items = [], []
        seen = np.unique(np.stack([at[long], self.gram[states[long]]]), axis=1)
        a, b = (np.searchsorted(self.gram_items[0], seen[1], side=x) for x in ("left", "right"))
        places.append(np.repeat(seen[0], b - a))
        items.append(self.gram_items[1][np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange((b - a).sum())])
        t = self.near[states]
        open_ = np.flatnonzero(t)
        while len(open_):
            a, b = (np.searchsorted(self.short_items[0], t[open_], side=x) for x in ("left", "right"))
            k = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange((b - a).sum())
            of = np.repeat(open_, b - a)
            fits = self.short_items[1][k] <= matched[of]
            of, k = of[fits], k[fits]
            firsts.append(at[of] + 1 - self.short_items[1][k])
            lasts.append(at[of] + 1)
            places.append(at[of])
            items.append(self.short_items[2][k])
            t[open_] = self.near[self.link[t[open_]]]
            open_ = open_[t[open_] > 0]
        return tuple(map(np.concatenate, (firsts, lasts, places, items)))


def pair_keys(ids: np.ndarray, v: int) -> np.ndarray:
    return A.mix(ids[:-1].astype(U) * U(v + 1) + ids[1:].astype(U) + U(1))


def runs_of(auto: Automaton, maybe: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word ids, starts, ends) of the runs of words that may hold a window."""
    ids = lookup(auto.vocabulary, maybe[0], hashes)
    if auto.least > 1:
        # Runs of words of which each and the next stand together in some item.
        both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (row[:-1] == row[1:])) if len(ids) else np.zeros(0, np.int64)
        keys = A.mix(ids[both].astype(U) * U(len(auto.vocabulary) + 1) + ids[both + 1].astype(U) + U(1))
        inside = np.zeros(len(ids), bool)
        inside[both[lookup(auto.pairs, maybe[1], keys) >= 0]] = True
        first, last, _ = A.runs(inside, np.array([0, len(ids)]))
        last = last + 1
    else:
        first, last, _ = A.runs(ids >= 0, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]))
    long = last - first >= auto.least
    return ids, first[long], last[long]


def point_spans(raw: np.ndarray, edges: list[int]) -> list[int]:
    """Code points before each of some byte places of a text, which come in order."""
    out, at, points = [], 0, 0
    for x in edges:
        points += int(((raw[at:x] & 0xC0) != 0x80).sum())
        out.append(points)
        at = x
    return out


def _scan(automata_):
    names = ["id", "text", "n_words", "spans", "items", "hit_words"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: list[Automaton] = automata_.value
        maybe = [(filter_of(x.vocabulary), filter_of(x.pairs)) for x in shards]
        for batch in batches:
            column = batch.column(1)
            for at, to, hashes, starts, ends, row in words(column):
                n = to - at
                first_of = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
                hit = np.zeros(len(hashes) + 1, np.int32)
                items: dict[int, set[str]] = {}
                if batch.num_columns > 2:
                    for k, (old, of) in enumerate(zip(batch.column("hit_words").slice(at, n), batch.column("items").slice(at, n).to_pylist(), strict=True)):
                        place = first_of[k] + old.values.to_numpy()
                        np.add.at(hit, place, 1)
                        np.add.at(hit, place + 1, -1)
                        if of:
                            items[k] = set(of)
                for auto, some in zip(shards, maybe, strict=True):
                    ids, first, last = runs_of(auto, some, hashes, row, n)
                    if not len(first):
                        continue
                    x, y, place, item = auto.hits(ids, first, last)
                    np.add.at(hit, x, 1)
                    np.add.at(hit, y, -1)
                    told = np.unique(np.stack([row[place], item])[:, item >= 0], axis=1)
                    for k, i in zip(*told.tolist(), strict=True):
                        items.setdefault(k, set()).add(auto.names[i])
                marked = np.cumsum(hit[:-1]) > 0
                s, e, _ = A.runs(marked, first_of)
                spans: list[list[dict]] = [[] for _ in range(n)]
                if len(s):
                    offsets, raw = A.texts(column.slice(at, n))
                    for k in np.unique(row[s]).tolist():
                        mine = np.flatnonzero(row[s] == k)
                        base = offsets[k]
                        edges = point_spans(raw[base : offsets[k + 1]], [int(v - base) for j in mine for v in (starts[s[j]], ends[e[j] - 1])])
                        spans[k] = [{"start": a, "end": b, "n_words": int(e[j] - s[j])} for a, b, j in zip(edges[::2], edges[1::2], mine, strict=True)]
                per_row = np.add.reduceat(np.append(marked, False), first_of[:-1]) * (np.diff(first_of) > 0) if n else np.zeros(0, np.int64)
                where = np.flatnonzero(marked)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(at, n),
                        column.slice(at, n),
                        pa.array(np.diff(first_of)),
                        pa.array(spans, span),
                        pa.array([sorted(items.get(k, ())) for k in range(n)], pa.list_(pa.string())),
                        A.long_list(where - first_of[row[where]], per_row, pa.int64()),
                    ],
                    names=names,
                )

    return run


SPANS = "array<struct<start:bigint,end:bigint,n_words:bigint>>"


def _build(window: int):
    """The packed automata of shards, of rows (shard, id, text) sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        packed = lambda: pa.record_batch([pa.array([pickle.dumps(Automaton.of(held, window))], pa.large_binary())], names=["automaton"])
        for batch in batches:
            for k, name, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != shard and held:
                    yield packed()
                    held = []
                shard = k
                held.append((name, text))
        if held:
            yield packed()

    return run


def pieces(items: DataFrame, window: int, most: int) -> DataFrame:
    """Different items (id, text); one of over ``most`` bytes comes in pieces of about that size that share ``window`` - 1 words, so no window is torn or made."""
    items = items.filter("text is not null").distinct()
    long = F.octet_length("text") > most
    words = F.filter(F.split(ascii_lower(F.col("text")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    cut = items.filter(long).select("id", words.alias("words"), F.greatest(F.floor(F.size(words) * F.lit(float(most)) / F.octet_length("text")), F.lit(window)).cast("int").alias("step"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)), F.col("step"))
    cut = cut.select("id", F.explode(F.transform(starts, lambda at: F.array_join(F.slice("words", at, F.col("step") + (window - 1)), " "))).alias("text"))
    return items.filter(~long).unionByName(cut)


def automata(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[Automaton]]:
    """The automata of each pass; tasks build them, and no more than those of one pass are on the driver at a time."""
    importable(benchmark.sparkSession)
    items = pieces(benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")), window, SHARD_BYTES)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    dealt = items.select(F.pmod(F.xxhash64("id", "text"), F.lit(shards)).alias("shard"), "id", "text")
    for k in range(0, shards, SHARDS):
        some = dealt.filter(F.col("shard").between(k, k + SHARDS - 1)).repartition(min(SHARDS, shards), "shard").sortWithinPartitions("shard")
        yield [pickle.loads(r["automaton"]) for r in some.mapInArrow(_build(window), "automaton binary").toLocalIterator()]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items (sorted), spans, and with ``with_text`` the text.

    A word inside any occurrence of a window is hit; spans are maximal runs of
    hit words in code points, end exclusive. A null text has no words; items
    without words (null or blank) have no windows; an item without id makes
    hits but is in no list. Repeated rows stay repeated, repeated items count
    once by id, an empty benchmark hits nothing, an empty table gives an empty
    result, and other columns are not looked at. A very long text is tokenised
    in pieces and streamed in pieces that share what a window needs; so is a
    very long item.
    """
    spark = docs.sparkSession
    importable(spark)
    schema = passed(docs.schema[id_col].dataType, f"text string, n_words bigint, spans {SPANS}, items array<string>, hit_words array<bigint>")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for k, some in enumerate(automata(benchmark, window)):
        if k:
            # Each pass adds its hits to those of the passes before, which are done then and hold no automata any more.
            rows = Scratch(spark, "hits").write(rows, "hits")
        rows = rows.mapInArrow(_scan(spark.sparkContext.broadcast(some)), schema)
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("hit_words").cast("bigint").alias("n_hit"),
        "items",
        "spans",
        *(["text"] if with_text else []),
    )


def cut(text: Column, spans: Column) -> Column:
    """The text without its spans, a line break in the place of each so that no new window arises."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    put = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("\n")).alias("out"))
    done = F.aggregate(spans, start, put)
    return F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_words: int = WINDOW, most_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contamination, with the same columns.

    Spans of ``least_words`` hit words or more are cut from the text (shorter
    ones come from short items). A document of whose words more than
    ``most_share`` are hit goes altogether, and so does one that has no words
    left. Clean rows stay as they are. Rows are matched by place, not by id, so
    null and repeated ids are safe.
    """
    names = docs.columns
    # The rest of the row goes beside the text, so that workers get each text once.
    rest = [F.col(f"`{c}`") for c in names if c != text_col] or [F.lit(0).alias("nothing")]
    row = docs.select(F.struct(*rest).alias("row"), F.col(text_col).alias("text"))
    found = scan(row, benchmark, window, id_col="row", text_col="text", with_text=True)
    spans = F.filter("spans", lambda s: s["n_words"] >= least_words)
    found = found.withColumn("cut_spans", spans).filter((F.size("cut_spans") == 0) | ((F.col("n_hit") <= most_share * F.col("n_words")) & (F.col("n_hit") < F.col("n_words"))))
    text = F.when(F.size("cut_spans") == 0, F.col("text")).otherwise(cut(F.col("text"), F.col("cut_spans")))
    return found.select(*(text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM t),
i AS (SELECT id, ws, least(10, len(ws)) AS n FROM w WHERE kind = 'i' AND len(ws) > 0),
win AS (SELECT DISTINCT id AS item, n, array_to_string(ws[p + 1 : p + n], ' ') AS g FROM (SELECT id, ws, n, unnest(range(0, len(ws) - n + 1)) AS p FROM i)),
d AS (SELECT id, ws, n, unnest(range(0, len(ws) - n + 1)) AS p FROM w, (SELECT DISTINCT n FROM i) WHERE kind = 'd' AND len(ws) >= n),
h AS (SELECT d.id, d.p, d.n, item FROM d JOIN win ON win.n = d.n AND win.g = array_to_string(ws[p + 1 : p + d.n], ' ')),
c AS (SELECT id, count(DISTINCT x) AS n_hit FROM (SELECT id, unnest(range(p, p + n)) AS x FROM h) GROUP BY id),
m AS (SELECT id, count(*) AS n_items, string_agg(item::VARCHAR, ',' ORDER BY item::VARCHAR) AS l FROM (SELECT DISTINCT id, item FROM h) GROUP BY id)
SELECT w.id AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (id) LEFT JOIN m USING (id) WHERE kind = 'd'
"""
