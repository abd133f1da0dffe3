"""Numpy work on whole Arrow batches of texts, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once. One longer text is one chunk of its own.
CHUNK = 1 << 20
U = np.uint64
MULTIPLIER = 0x9E3779B97F4A7C15
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_codes = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a permutation of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & ((1 << 64) - 1)], dtype=U))[0])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of MULTIPLIER and of its inverse modulo 2**64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, b, dtype=U)]), dtype=U) for b in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64))]
    return _powers[0], _powers[1]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offs - offs[0], raw[offs[0] : offs[-1]]


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, offsets, bytes) for runs of rows of about ``most`` bytes."""
    if not len(column):
        return
    offs, raw = texts(column)
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
        to = min(to, n, at + 60_000)
        yield at, to, offs[at : to + 1] - offs[at], raw[offs[at] : offs[to]]
        at = to


def text_runs(column: pa.Array, inside: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, row after the last, pieces) for runs of rows of about ``most`` bytes, in lower case.

    A piece is (offsets, bytes) of the rows. A text of more than ``most`` bytes
    is a run of its own and comes in several pieces of that size, cut before a
    byte that isn't ``inside`` a word, so that no word is torn.
    """
    for at, to, offsets, raw in chunks(column, most):
        yield at, to, _cut(offsets, raw, inside, most)


def _cut(offsets: np.ndarray, raw: np.ndarray, inside: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if len(raw) <= most or len(offsets) > 2:
        yield offsets, LOWER[raw]
        return
    at = 0
    while at < len(raw):
        to = at + most
        while to < len(raw) and (gap := inside[LOWER[raw[to : to + most]]]).all():
            to += len(gap)
        to = min(len(raw), to + int(np.argmin(gap)) if to < len(raw) else to)
        yield np.array([0, to - at]), LOWER[raw[at:to]]
        at = to


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross texts: (starts, ends, row of each)."""
    if not len(inside):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    full = offsets[:-1] < offsets[1:]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][full]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, in order of start; equal bytes give equal hashes wherever they stand."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK, side="right"))) if ends[at] - base < CHUNK else at + 1
        to = min(to, len(starts))
        block = data[base : ends[at:to].max()]
        power, inverse = powers(len(block) + 1)
        sums = np.zeros(len(block) + 1, U)
        np.cumsum(_codes[block] * power[: len(block)], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U))
        at = to
    return out


def word_table(pattern: str) -> np.ndarray:
    """Which bytes belong to words: ``space`` for all but white space, ``alnum`` for 0-9, a-z and all beyond ASCII."""
    table = np.zeros(256, bool)
    if pattern == "space":
        table[:] = True
        table[[0x20, *range(0x09, 0x0E)]] = False
    elif pattern == "alnum":
        table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    elif pattern == "letters":
        table[0x61:0x7B] = table[0x80:] = True
    else:
        raise ValueError(pattern)
    return table


def long_list(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list column from its flattened values and the size of each list."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
