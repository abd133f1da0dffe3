"""Operator 10: removal of repeated passages with run-length Burrows-Wheeler indexes.

A byte goes when a string of ``window`` bytes around it also starts earlier
in the corpus. Windows meet by their anchor, the k-mer of least hash within
them, which equal windows have at the same place; all neighbouring windows of
one anchor make a context.

1. Contexts are counted by anchor; those with an anchor of their own are done.
2. Of contexts that are equal (by two hashes of different kinds), all but the
   first go altogether, so a group of copies costs one context.
3. The different contexts of an anchor are parted by longer anchors (those of
   windows with half of their other bytes before it, and with more behind it).
   The parts that share one are halved in the order of the corpus:
   the earlier half is indexed and the later half is streamed through the
   index, then each half is halved in turn. An index is a run-length BWT with
   text places sampled at both ends of each run; a context is streamed from
   right to left with one place of the index under its longest match, kept up
   by steps within runs and by jumps to the run ends that thresholds name. A
   window whose match reaches ``window`` bytes in the text at that place goes.
4. A longer anchor with very many contexts (a frequent passage) is not
   held in one task. Hashes of its windows, aggregated over the cluster, tell
   which of its contexts may hold a window first; each of those is indexed,
   and the contexts that may repeat it are streamed through it, in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeops.llm import arrays as A
from storeops.llm.shared import Scratch, table

WINDOW, KMER = 100, 32
#: Bytes of text that are worked on at once, and bytes of contexts in one index.
CHUNK, INDEX = 1 << 18, 1 << 19
#: Contexts of an anchor from which on step 4 takes over, and contexts that are streamed through one copy of an index there, about.
HOT, STREAMED = 1_000, 256
#: Parts that the contexts of one place to stream through are dealt to before they are counted.
SALTS = 64
U = np.uint64
PRIMES = ((2**31 - 1, 48_271), (2**31 - 19, 1_103_515_245))
_modular: list[np.ndarray] = []
CONTEXT = "h bigint, ctx bigint, id bigint, tie bigint, start bigint, off int, n int"
#: Bytes are the symbols from 1 on, since 0 ends a text; then come one that follows each string of an index, and those of groups.
END, GROUPS = 257, 258
#: Symbols in a word of the comparison of texts.
PACK = 4


def modular_powers(n: int) -> list[np.ndarray]:
    """For each of PRIMES, powers of its base and of the base's inverse, n of each at least."""
    if not _modular or len(_modular[0]) < n:
        n = max(n, 4 * CHUNK + 2 * WINDOW)
        _modular.clear()
        for p, base in PRIMES:
            for b in (base, pow(base, -1, p)):
                out = np.ones(1, U)
                while len(out) < n:
                    out = np.concatenate([out, out * U(pow(b, len(out), p)) % U(p)])
                _modular.append(out[:n])
    return _modular


def second_sums(raw: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(running sums, inverse powers, prime): polynomial hashes modulo primes, which share nothing with those modulo 2**64."""
    powers, out = modular_powers(len(raw) + 1), []
    for k, (p, _) in enumerate(PRIMES):
        sums = np.zeros(len(raw) + 1, U)
        np.cumsum((raw.astype(U) + U(1 + k)) * powers[2 * k][: len(raw)] % U(p), out=sums[1:])
        out.append((sums, powers[2 * k + 1], p))
    return out


def contexts(offsets: np.ndarray, raw: np.ndarray, window: int, kmer: int, named: bool = True) -> tuple[np.ndarray, ...] | None:
    """(row, start, place of the anchor in the context, windows, hash of the anchor, and if ``named`` the hash of the context)."""
    n, width = len(raw), window - kmer + 1
    full = np.diff(offsets) >= window
    if not full.any():
        return None
    power, inverse = A.powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(A._codes[raw] * power[:n], out=sums[1:])
    h = sums[kmer:] - sums[:-kmer]
    h *= inverse[: n - kmer + 1]
    # Upper 40 bits for the order, the place below: of equal k-mers in a window the first is its anchor.
    key = h * U(0xD6E8FEB86659FD93)
    key &= U(0xFFFFFFFFFF000000)
    key |= np.arange(len(h), dtype=U) & U(0xFFFFFF)
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, U)
    padded[: len(key)] = key
    grid = padded.reshape(blocks, width)
    before = np.minimum.accumulate(grid, axis=1).reshape(-1)
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    count = n - window + 1
    anchor = (np.minimum(after[:count], before[width - 1 : width - 1 + count]) & U(0xFFFFFF)).astype(np.int64)
    firsts, lasts = offsets[:-1][full], offsets[1:][full] - window
    inside = np.zeros(n + 1, np.int8)
    inside[firsts] += 1
    inside[lasts + 1] -= 1
    begins = np.ones(count, bool)
    np.not_equal(anchor[1:], anchor[:-1], out=begins[1:])
    begins[firsts] = True
    begins &= np.cumsum(inside, dtype=np.int8)[:count].astype(bool)
    a = np.flatnonzero(begins)
    row = np.searchsorted(offsets, a, side="right") - 1
    z = np.minimum(np.append(a[1:], count), offsets[row + 1] - window + 1) - 1
    at = anchor[a]
    if not named:
        return row, a - offsets[row], at - a, z - a + 1, A.mix(h[at])
    low, high = ((second[z + window] - second[a]) % U(p) * back[a] % U(p) for second, back, p in second_sums(raw))
    ctx = A.mix((high << U(31) | low) + (at - a).astype(U) * U(A.MULTIPLIER) + (z - a).astype(U))
    return row, a - offsets[row], at - a, z - a + 1, A.mix(h[at]), ctx


def pieces(column: pa.Array, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(offsets, bytes, row, start in the row) of runs of texts; a long text comes in pieces that share window - 1 bytes."""
    most = 4 * CHUNK
    for at, to, offsets, raw in A.chunks(column, CHUNK):
        if to - at > 1 or len(raw) <= most:
            yield offsets, raw, np.arange(at, to), np.zeros(to - at, np.int64)
            continue
        for start in range(0, len(raw) - window + 1, most):
            part = raw[start : start + most + window - 1]
            yield np.array([0, len(part)]), part, np.array([at]), np.array([start])


def _anchors(window: int, kmer: int):
    """The hashes of the anchors of all contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for offsets, raw, _, _ in pieces(batch.column(0), window):
                found = contexts(offsets, raw, window, kmer, named=False)
                if found:
                    yield pa.record_batch([pa.array(A.signed(found[4]))], names=["h"])

    return run


def _contexts(window: int, kmer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            for offsets, raw, rows, starts in pieces(batch.column(1), window):
                found = contexts(offsets, raw, window, kmer)
                if found:
                    row, start, off, n, h, ctx = found
                    columns = [A.signed(h), A.signed(ctx), ids[rows[row]].astype(np.int64), ties[rows[row]], start + starts[row], off.astype(np.int32), n.astype(np.int32)]
                    yield pa.record_batch([pa.array(c) for c in columns], names=["h", "ctx", "id", "tie", "start", "off", "n"])

    return run


def _cut_out(window: int, kmer: int):
    """The bytes of contexts, from texts and the lists of their contexts, each in up to two parts with longer anchors.

    Of the bytes of a window beside its anchor, half stand before it or over
    half behind it. Windows of the first kind make one part of their context,
    which is named by the anchor and the half before, the others make another,
    named by the anchor and what they all have behind it. So equal windows
    still meet, and contexts that only share a frequent phrase don't.
    """
    names = ["h", "start", "off", "n"]
    before = (window - kmer) // 2
    behind = window - kmer - before + 1

    def named(kind: bytes, anchor: bytes) -> int:
        return int.from_bytes(blake2b(anchor, digest_size=8, person=kind).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, tie, text, found in zip(*(batch.column(k) for k in range(4)), strict=True):
                raw, lists = (text.as_py() or "").encode(), found.values
                columns = [lists.field(x) for x in names]
                for at in range(0, len(lists), 4096):
                    rows = []
                    for _, start, off, n in zip(*(c.slice(at, 4096).to_numpy().tolist() for c in columns), strict=True):
                        place, first = start + off, min(n, max(0, off - before + 1))
                        if first:
                            rows.append((named(b"before", raw[place - before : place + kmer]), start, off, raw[start : start + first + window - 1]))
                        if first < n:
                            rows.append((named(b"behind", raw[place : place + kmer + behind]), start + first, off - first, raw[start + first : start + n + window - 1]))
                    key, start, off, data = zip(*rows, strict=True)
                    yield pa.record_batch([pa.array(key, pa.int64()), pa.repeat(id_, len(data)), pa.repeat(tie, len(data)), pa.array(start, pa.int64()), pa.array(off, pa.int32()), pa.array(data, pa.binary())], names=["h", "id", "tie", "start", "off", "data"])

    return run


def packed(symbols: np.ndarray) -> np.ndarray:
    """For each place, the PACK symbols from there on as one word; zeros follow the last."""
    out = np.zeros(len(symbols), U)
    for k in range(PACK):
        out[: len(symbols) - k] |= symbols[k:].astype(U) << U(16 * k)
    return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, by doubling; only suffixes that tie are sorted again. The last symbol must be less than all others."""
    n, bits = len(symbols), int(symbols.max()).bit_length()
    k = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(k):
        key <<= bits
        key[: n - i] |= symbols[i:]
    at = np.argsort(key)
    key, rank = key[at], np.empty(n, np.int64)
    low = np.zeros(n, np.int64)  # the first row of the ties that each suffix was among
    while len(at):
        new = np.append(True, key[1:] != key[:-1])
        group = np.append(True, low[1:] != low[:-1])
        j = np.arange(len(at))
        first = np.maximum.accumulate(np.where(new, j, 0))
        rank[at] = low + first - np.maximum.accumulate(np.where(group, j, 0))
        tied = np.diff(np.append(np.flatnonzero(new), len(at)))
        at = at[np.repeat(tied > 1, tied)]
        key = rank[at] * n + rank[np.minimum(at + k, n - 1)]
        by = np.argsort(key)
        at, key = at[by], key[by]
        low, k = key // n, 2 * k
    places = np.empty(n, np.int64)
    places[rank] = np.arange(n)
    return places


class RunLengthIndex:
    """Run-length BWT of a text that ends with its least symbol, with text places sampled at both ends of each run."""

    def __init__(self, symbols: np.ndarray, most: int):
        n = self.n = len(symbols)
        places = suffix_array(symbols)
        before = symbols[places - 1].astype(np.int64)
        head = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        length = np.diff(np.append(head, n))
        # Runs by symbol, then place: the order in which the rows of one more symbol to the left follow.
        by = np.lexsort((head, before[head]))
        self.symbol, self.head, self.end = before[head][by], head[by], (head + length)[by]
        self.first, self.last = places[self.head], places[self.end - 1]
        self.key = self.symbol * n + self.head
        self.target = np.cumsum(length[by]) - length[by]
        self.threshold = np.zeros(len(by), np.int64)
        same = np.flatnonzero(self.symbol[1:] == self.symbol[:-1]) + 1
        self.threshold[same] = least_row(common(packed(symbols), places, most), self.end[same - 1], self.head[same])

    def step(self, row: np.ndarray, place: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, text places) of the longest matches after one more symbol to the left."""
        j = np.searchsorted(self.key, symbol * self.n + row, side="right")
        a, b = np.maximum(j - 1, 0), np.minimum(j, len(self.key) - 1)
        up = (j > 0) & (self.symbol[a] == symbol)
        down = (j < len(self.key)) & (self.symbol[b] == symbol)
        inside = up & (row < self.end[a])
        # The row at which the two nearest runs of the symbol part: above it the end of the upper one agrees longer.
        up &= inside | ~down | (row < self.threshold[b])
        run = np.where(up, a, b)
        at = np.where(inside, row, np.where(up, self.end[a] - 1, self.head[b]))
        place = np.where(inside, place, np.where(up, self.last[a], self.first[b]))
        none = ~(up | down)
        return np.where(none, 0, self.target[run] + at - self.head[run]), np.where(none, self.n, place) - 1


def common(words: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """Symbols that each suffix has in common with the one before, counted up to about ``most``."""
    n, out = len(places), np.zeros(len(places), np.int64)
    rows = np.arange(1, n)
    for k in range(0, most, PACK):
        if not len(rows):
            break
        a, b = places[rows - 1] + k, places[rows] + k
        differ = np.where((a < n) & (b < n), words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)], U(1))
        equal = np.full(len(rows), PACK)
        for i in reversed(range(PACK)):
            equal[(differ >> U(16 * i)) & U(0xFFFF) != 0] = i
        out[rows] += equal
        rows = rows[equal == PACK]
    return out


def least_row(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The first row of least value of each range from lo to hi, both included."""
    key = values << 32 | np.arange(len(values))
    level = np.zeros(len(lo), np.int64)
    size = hi - lo + 1
    while (more := (2 << level) <= size).any():
        level += more
    out = np.empty(len(lo), np.int64)
    for k in range(int(level.max(initial=0)) + 1):
        of = np.flatnonzero(level == k)
        out[of] = np.minimum(key[lo[of]], key[hi[of] - (1 << k) + 1])
        if 1 << k < len(key):
            key = np.minimum(key[: -(1 << k)], key[1 << k :])
    return out & 0xFFFFFFFF


def strings_of(symbols: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of some strings, an END after each and 0 at last; bounds of the strings with their ENDs)."""
    sizes = bounds[which + 1] - bounds[which] + 1
    to = np.append(0, np.cumsum(sizes))
    out = symbols[np.minimum(np.repeat(bounds[which] - to[:-1], sizes) + np.arange(to[-1]), len(symbols) - 1)]
    out[to[1:] - 1] = END
    return np.append(out, np.uint16(0)), to


def matching(symbols: np.ndarray, bounds: np.ndarray, indexed: np.ndarray, streamed: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, place in it) of the windows of the ``streamed`` strings that stand in an ``indexed`` one."""
    text, _ = strings_of(symbols, bounds, indexed)
    lengths = bounds[streamed + 1] - bounds[streamed]
    index = RunLengthIndex(text, int(lengths.max()))
    # Longest first, so that the strings that still have symbols to go are a prefix.
    by = np.argsort(-lengths, kind="stable")
    streamed, lengths = streamed[by], lengths[by]
    row, place = np.zeros(len(by), np.int64), np.full(len(by), index.n - 1)  # the text's end
    strings, windows, found = [], [], []
    for t in range(1, int(lengths[0]) + 1):
        live = int(np.searchsorted(-lengths, -t, side="right"))
        at = lengths[:live] - t
        row, place = index.step(row[:live], place[:live], symbols[bounds[streamed[:live]] + at].astype(np.int64))
        if t >= window:
            strings.append(streamed[:live])
            windows.append(at)
            found.append(place)
    string, at, place = np.concatenate(strings), np.concatenate(windows), np.concatenate(found)
    # The place under a window has its longest match; whether that is as long as the window, the texts themselves tell.
    here, there = packed(symbols), packed(text)
    begin = bounds[string] + at
    fits = np.flatnonzero(place + window < len(text))
    for k in [*range(0, window - PACK + 1, PACK), max(window - PACK, 0)]:
        fits = fits[here[begin[fits] + k] == there[place[fits] + k]]
    return string[fits], at[fits]


def repeated(data: np.ndarray, bounds: np.ndarray, off: np.ndarray, group: np.ndarray, role: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, place in it) of the windows that an earlier string of the group has too.

    Strings come by group and in order; ``off`` is the place of each one's
    anchor, which lies in all its windows. A role of 0 marks strings that are
    only indexed and 1 those that are only streamed; -1 leaves it to halving.
    """
    lengths = np.diff(bounds)
    n = lengths - window + 1
    first = np.append(0, np.cumsum(n))
    gone = np.zeros(first[-1], bool)
    symbols = data.astype(np.uint16) + np.uint16(1)
    part, alive = group.astype(np.int64), np.arange(len(n))
    while True:
        begins = np.flatnonzero(np.append(True, part[alive][1:] != part[alive][:-1])) if len(alive) else alive
        sizes = np.diff(np.append(begins, len(alive)))
        number = np.repeat(np.arange(len(sizes)), sizes)
        right = np.arange(len(alive)) - begins[number] >= (sizes[number] + 1) // 2
        right = np.where(role[alive] < 0, right, role[alive] == 1)
        both = (np.bincount(number, right, len(sizes)) > 0) & (np.bincount(number, ~right, len(sizes)) > 0)
        alive, right, number = (x[both[number]] for x in (alive, right, number))
        if not len(alive):
            break
        # In the place of an anchor's first byte stands its group, so that no match joins two groups.
        symbols[bounds[alive] + off[alive]] = GROUPS + number
        string, at = matching(symbols, bounds, alive[~right], alive[right], window)
        gone[first[string] + at] = True
        # A string whose windows all stand earlier has nothing that a later one could need.
        left = np.add.reduceat(~gone, first[:-1]).astype(bool)
        part[alive] = 2 * number + right
        keep = left[alive] & (role[alive] < 0)
        alive = alive[keep]
        alive = alive[np.argsort(part[alive], kind="stable")]
    found = np.flatnonzero(gone)
    string = np.searchsorted(first, found, side="right") - 1
    return string, found - first[string]


BLOCK = ["k1", "k2", "k3", "k4"]
BLOCK_ROWS = "k1 bigint, k2 bigint, k3 bigint, k4 bigint, role int, id bigint, tie bigint, start bigint, off int, data binary"
SPAN = "id bigint, tie bigint, start bigint, end bigint"


def _index(window: int):
    """Spans to remove, of rows of ``BLOCK_ROWS`` sorted by the keys of their group, role and place."""

    def spans(held: list[pa.RecordBatch], group: list[np.ndarray]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        role, ids, ties, start, off = (t.column(c).to_numpy() for c in ("role", "id", "tie", "start", "off"))
        bounds, data = A.texts(t.column("data").chunk(0))
        string, place = repeated(data, bounds, off, np.concatenate(group), role, window)
        new = np.append(True, (string[1:] != string[:-1]) | (place[1:] != place[:-1] + 1)) if len(string) else np.zeros(0, bool)
        last = np.append(new[1:], True) if len(string) else new
        s = string[new]
        return pa.record_batch([pa.array(ids[s]), pa.array(ties[s]), pa.array(start[s] + place[new]), pa.array(start[s] + place[last] + window)], names=["id", "tie", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group: list[np.ndarray] = []
        size, number, key = 0, 0, None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1)
            lengths = np.diff(A.texts(batch.column("data"))[0])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for at, to in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(keys[at].tolist())
                if now != key:
                    if size > INDEX:
                        yield spans(held, group)
                        held, group, size = [], [], 0
                    key, number = now, number + 1
                held.append(batch.slice(at, to - at))
                group.append(np.full(to - at, number))
                size += int(lengths[at:to].sum())
        if held:
            yield spans(held, group)

    return run


def _windows(window: int):
    """(two hashes, place, context) of every window of the contexts of frequent anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties, start = (batch.column(k).to_numpy() for k in range(3))
            for at, to, offsets, raw in A.chunks(batch.column(3), CHUNK):
                power, inverse = A.powers(len(raw) + 1)
                sums = np.zeros(len(raw) + 1, U)
                np.cumsum(A._codes[raw] * power[: len(raw)], out=sums[1:])
                n = np.diff(offsets) - window + 1
                place = np.concatenate([np.arange(k) for k in n])
                row = np.repeat(np.arange(to - at), n)
                a = offsets[:-1][row] + place
                low, high = ((second[a + window] - second[a]) % U(p) * back[a] % U(p) for second, back, p in second_sums(raw))
                hashes = A.mix((sums[a + window] - sums[a]) * inverse[a]), A.mix(high << U(31) | low)
                columns = [*map(A.signed, hashes), ids[at + row], ties[at + row], start[at + row] + place, start[at + row]]
                yield pa.record_batch([pa.array(c) for c in columns], names=["h1", "h2", "id", "tie", "start", "context"])

    return run


def halved(few: DataFrame) -> DataFrame:
    """Groups of the contexts of each anchor, all roles open."""
    none = F.lit(0).cast("bigint")
    return few.select(F.col("h").alias("k1"), none.alias("k2"), none.alias("k3"), none.alias("k4"), F.lit(-1).alias("role"), "id", "tie", "start", "off", "data")


def routed(many: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    """Groups of contexts that may hold windows first, and of those that may repeat them, dealt to parts of bounded size."""
    windows = many.select("id", "tie", "start", "data").mapInArrow(_windows(window), "h1 bigint, h2 bigint, id bigint, tie bigint, start bigint, context bigint")
    place = F.struct("id", "tie", "start", "context")
    least = windows.groupBy("h1", "h2").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    # Written, so that both sides of the join are exchanged as they are and Spark can split a frequent window.
    least = scratch.write(least.select("h1", "h2", "least"), "least")
    late = windows.join(least.hint("shuffle_hash"), ["h1", "h2"]).filter(place != F.col("least"))
    pairs = late.select("id", "tie", "context", F.col("least.id").alias("k1"), F.col("least.tie").alias("k2"), F.col("least.context").alias("k3")).distinct()
    spot = F.xxhash64("id", "tie", "context")
    pairs = scratch.write(pairs.withColumn("salt", F.pmod(spot, F.lit(SALTS))), "pairs")
    counts = pairs.groupBy("k1", "k2", "k3", "salt").agg(F.count(F.lit(1)).alias("times"))
    parts = F.ceil(F.col("times") / STREAMED).cast("bigint")
    number = F.col("salt") + SALTS * F.pmod(F.shiftright(spot, 8), parts)
    streamed = pairs.join(counts, ["k1", "k2", "k3", "salt"]).withColumn("k4", number).withColumn("role", F.lit(1)).drop("times")
    indexed = counts.withColumn("k4", F.explode(F.sequence("salt", (parts - 1) * SALTS + F.col("salt"), F.lit(SALTS).cast("bigint"))))
    indexed = indexed.select(F.col("k1").alias("id"), F.col("k2").alias("tie"), F.col("k3").alias("context"), *BLOCK, F.lit(0).alias("role"))
    rows = streamed.select(indexed.columns).unionByName(indexed).withColumnRenamed("context", "start")
    return rows.join(many.select("id", "tie", "start", "off", "data"), ["id", "tie", "start"]).select(*BLOCK, "role", "id", "tie", "start", "off", "data")


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n_bytes, merged spans, kept bytes) from texts and their lists of spans."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for at, to, offsets, raw in A.chunks(batch.column(1)):
            merged, kept = [], []
            for k, spans in enumerate(batch.column(2).slice(at, to - at)):
                text = raw[offsets[k] : offsets[k + 1]]
                out: list[list[int]] = []
                for s in sorted((x["start"], x["end"]) for x in spans.as_py() or ()):
                    if out and s[0] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], s[1])
                    else:
                        out.append(list(s))
                edges = [0, *(x for s in out for x in s), len(text)]
                kept.append(b"".join(text[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)))
                merged.append([{"start": a, "end": b} for a, b in out])
            yield pa.record_batch([batch.column(0).slice(at, to - at), pa.array(np.diff(offsets)), pa.array(merged, span), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, spans (merged, in bytes of the UTF-8 text, end exclusive), kept (the bytes left).

    A byte is removed when it lies in a string of ``window`` bytes that also
    starts earlier: in a document of smaller id, or before in the same one.
    Strings are judged on the input, not on what is left, and never cross
    documents. Null counts as empty, texts shorter than ``window`` keep all,
    and a very long text is looked at in pieces. Ids must be integers; rows
    without id are left whole. Of different texts that share an id, the one
    of smaller hash is the earlier; equal texts that share an id are one
    document, and each row of it gets the same result. An empty table gives an
    empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    known = texts.filter("id is not null")
    found = known.mapInArrow(_contexts(window, kmer), CONTEXT)
    shared = known.select("text").mapInArrow(_anchors(window, kmer), "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("h")
    # Written, so that both sides of the join are exchanged as they are and Spark can split a frequent anchor.
    shared = scratch.write(shared, "shared")
    scratch.release()
    cand = scratch.write(found.join(shared.hint("shuffle_hash"), "h"), "contexts")
    scratch.release("shared")

    place = F.struct("id", "tie", "start", "off", "n")
    first = cand.groupBy("h", "ctx").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
    first = scratch.write(first.select("h", "ctx", "first.*", "times"), "first")
    again = first.filter("times > 1").select("h", "ctx", F.struct("id", "tie", "start").alias("first"))
    rest = cand.join(again.hint("shuffle_hash"), ["h", "ctx"]).filter(F.struct("id", "tie", "start") != F.col("first"))
    marks = scratch.write(rest.select("id", "tie", "start", (F.col("start") + F.col("n") - 1 + window).alias("end")), "marks")
    scratch.release("contexts")

    sizes = scratch.write(first.groupBy("h").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    several = first.join(sizes, "h").groupBy("id", "tie").agg(F.collect_list(F.struct("h", "start", "off", "n")).alias("found"))
    # Equal texts that share an id are cut once.
    once = texts.join(several, ["id", "tie"]).groupBy("id", "tie").agg(F.first("text").alias("text"), F.first("found").alias("found"))
    cut = once.select("id", "tie", "text", "found").mapInArrow(_cut_out(window, kmer), "h bigint, id bigint, tie bigint, start bigint, off int, data binary")
    cut = scratch.write(cut, "cut")
    scratch.release("first", "sizes")
    frequent = scratch.write(cut.groupBy("h").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > hot).select("h"), "frequent")
    groups = halved(cut.join(frequent, "h", "left_anti")).unionByName(routed(cut.join(frequent, "h", "left_semi"), scratch, window))
    dealt = groups.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "role", "id", "tie", "start")
    marks2 = scratch.write(dealt.mapInArrow(_index(window), SPAN), "marks2")
    scratch.release("cut", "frequent", "least", "pairs")

    spans = marks.unionByName(marks2).groupBy("id", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = scratch.write(spans, "spans")
    scratch.release("marks", "marks2")
    out = texts.join(spans, ["id", "tie"], "left").select("id", "text", "spans")
    return out.mapInArrow(_remove, "id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary").withColumnRenamed("id", id_col)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
