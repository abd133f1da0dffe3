"""Operator 9: language identification by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample in the tasks and adds them up by
language, as one packed array for each. The log-probability matrix (buckets x
languages) goes to the executors as a broadcast of bounded size, and batches
of texts are scored in numpy. A long text comes in pieces; more languages than
one matrix holds take several passes, each of which adds its languages to the
best and the sum of those before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeops.llm import arrays as A
from storeops.llm.shared import Scratch, id_crc, importable, passed, table

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
#: Labelled documents that training takes of each language, about; picked by the hash of their ids.
SAMPLE = 2_000
#: Bytes of the matrix of one pass, at most; languages whose counts a task holds at once.
MATRIX_BYTES, HELD = 256_000_000, 200
SMOOTHING = 0.5
#: Log-probabilities that are looked up, and sums that are held, at once.
LOOKED_UP = 4_000_000
#: Bytes that continue a character.
CONTINUED = (np.arange(256) & 0xC0) == 0x80


@lru_cache(maxsize=1)
def characters() -> tuple[np.ndarray, np.ndarray]:
    """(folded, letter) by code point: letters in lower case, all else a space."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    folded = np.full(0x110000, 32, np.uint32)
    for c in np.flatnonzero(letter).tolist():
        low = chr(c).lower()
        folded[c] = ord(low) if len(low) == 1 else c
    return folded, letter


def points(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, code points) of UTF-8 texts."""
    whole = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    if begins[-1] != len(whole):  # not UTF-8: text by text
        each = [np.frombuffer(raw[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.concatenate([[0], np.cumsum([len(x) for x in each])]), np.concatenate(each) if each else whole
    return begins[offsets], whole


def ngrams(offsets: np.ndarray, chars: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, offsets) of the n-grams of each size; none crosses texts or is blank."""
    h = np.zeros(len(chars), np.uint32)
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(n), lengths)
    left = np.repeat(offsets[1:], lengths) - np.arange(len(chars))  # characters from here to the end of the text
    for size in range(1, max(SIZES) + 1):
        shifted = np.zeros(len(chars), np.uint32)
        shifted[: len(chars) - size + 1] = chars[size - 1 :]
        h = (h + shifted) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if size in SIZES:
            fits = (left >= size) & ((chars != 32) | (size > 1))
            yield (h[fits] * np.uint32(0x85EBCA77) >> np.uint32(16)) % np.uint32(buckets), np.concatenate([[0], np.cumsum(np.bincount(row[fits], minlength=n))])


def grams(column: pa.Array, buckets: int, most: int = A.CHUNK) -> Iterator[tuple[int, int, np.ndarray, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, row after the last, letters of each row, sign, n-grams of each size) of runs of rows.

    A long text comes in pieces, each with the last characters of the one
    before it; what they would count twice comes once more with sign -1.
    """
    folded, letter = characters()
    for at, to, pieces in A.text_runs(column, CONTINUED, most):
        tail = np.zeros(0, np.uint32)
        for offsets, data in pieces:
            offs, chars = points(offsets, data)
            seen = np.concatenate([[0], np.cumsum(letter[chars])])
            text = folded[chars]
            if len(tail):
                text, offs = np.concatenate([tail, text]), np.array([0, len(tail) + len(text)])
                yield at, to, np.zeros(1, np.int64), -1, list(ngrams(np.array([0, len(tail)]), tail, buckets))
            yield at, to, np.diff(seen[offs - len(tail) * (np.arange(len(offs)) > 0)]), 1, list(ngrams(offs, text, buckets))
            tail = text[max(0, len(text) - max(SIZES) + 1) :] if to - at == 1 else tail


COUNTS = "lang string, bucket array<int>, n array<bigint>"


def _count(buckets: int):
    """The counts that aren't 0 of each language, in packed rows; of a language, one for each time that HELD others have come."""

    def told(totals: dict[str, np.ndarray]) -> pa.RecordBatch:
        places = [np.flatnonzero(t) for t in totals.values()]
        columns = [pa.array(list(totals), pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array([t[p] for t, p in zip(totals.values(), places, strict=True)], pa.list_(pa.int64()))]
        return pa.record_batch(columns, names=["lang", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for at, to, _, sign, found in grams(batch.column(1), buckets):
                for lang in sorted(set(langs[at:to])):
                    if len(totals) >= HELD and lang not in totals:
                        yield told(totals)
                        totals = {}
                    total = totals.setdefault(lang, np.zeros(buckets, np.int64))
                    for bucket, bounds in found:
                        mine = np.repeat(langs[at:to] == lang, np.diff(bounds))
                        total += sign * np.bincount(bucket[mine], minlength=buckets)
        if totals:
            yield told(totals)

    return run


def _add(buckets: int):
    """The log-probabilities of a language, of all its rows of counts."""

    def run(rows: pa.Table) -> pa.Table:
        total = np.full(buckets, SMOOTHING)
        for bucket, n in zip(rows["bucket"], rows["n"], strict=True):
            total[bucket.values.to_numpy()] += n.values.to_numpy()
        return pa.table({"lang": rows["lang"][:1], "logs": pa.array([np.log(total / total.sum()).astype(np.float32).tobytes()], pa.binary())})

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, buckets: int = BUCKETS, matrix_bytes: int = MATRIX_BYTES) -> list[tuple[list[str], np.ndarray]]:
    """Blocks (languages, log-probabilities of shape (buckets, languages)), languages in order; none has more than ``matrix_bytes``, but for a single language.

    Rows without language or text are left out. Of a language with more than
    ``sample`` documents, those with the smallest hashes of their ids are
    taken, by a share that makes about ``sample``. Every language with a
    labelled text is learned, in as many buckets however many there are.
    Without any labelled text there are no languages.
    """
    importable(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toPandas()  # a row for each language
    if not len(sizes):
        return []
    shares = docs.sparkSession.createDataFrame(list(zip(sizes["lang"], (sample / sizes["n"]).tolist(), strict=True)), "lang string, share double")
    picked = known.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    counts = picked.select("lang", "text").mapInArrow(_count(buckets), COUNTS)
    logs = counts.groupBy("lang").applyInArrow(_add(buckets), "lang string, logs binary").orderBy("lang")
    step, blocks = max(1, matrix_bytes // (4 * buckets)), []
    for k, r in enumerate(logs.toLocalIterator()):
        if k % step == 0:
            blocks.append(([], []))
        blocks[-1][0].append(r["lang"])
        blocks[-1][1].append(np.frombuffer(r["logs"], np.float32))
    # By code points, as Python orders names.
    return [(langs, np.ascontiguousarray(np.array(rows).T)) for langs, rows in blocks]


SCORED = "text string, lang_pred string, top double, mass double, letters bigint"


def _score(model):
    """Adds a block of languages to what earlier blocks have found: the best language, its log-likelihood, and the sum of all likelihoods in units of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = model.value
        names = np.array(langs, object)
        for whole in batches:
            # As many rows at a time as there may be sums.
            step = max(1, LOOKED_UP // len(langs))
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                sums, letters = np.zeros((batch.num_rows, len(langs))), np.zeros(batch.num_rows, np.int64)
                for at, to, some, sign, found in grams(batch.column(1), len(matrix)):
                    letters[at:to] += some
                    for bucket, bounds in found:
                        full = np.flatnonzero(np.diff(bounds))
                        wide = max(1, LOOKED_UP // max(1, len(bucket)))
                        for a in range(0, len(langs), wide) if len(full) else ():
                            sums[at + full, a : a + wide] += sign * np.add.reduceat(matrix[bucket, a : a + wide], bounds[:-1][full], axis=0, dtype=np.float64)
                best = sums.argmax(axis=1)
                top = sums.max(axis=1)
                mass = np.exp(sums - top[:, None]).sum(axis=1)
                pred = names[best]
                if batch.num_columns > 2:
                    before, old_top, old_mass = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
                    high = np.maximum(top, old_top)
                    mass = mass * np.exp(top - high) + old_mass * np.exp(old_top - high)
                    pred, top = np.where(top > old_top, pred, before), high
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(pred.tolist(), pa.string()), pa.array(top), pa.array(mass), pa.array(letters)], names=["id", "text", "lang_pred", "top", "mass", "letters"])

    return run


def identify(docs: DataFrame, model: list[tuple[list[str], np.ndarray]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score (the posterior under equal priors).

    ``und`` with score 0 where the text is null or has no letter, and where
    the model knows no language. Ties go to the first language by name.
    Repeated rows stay repeated, an empty table gives an empty result, and
    other columns are not looked at. A very long text is scored in pieces, and
    so many texts at a time as their sums may have room for.
    """
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not model:
        return rows.select(F.col("id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    for k, block in enumerate(model):
        if k:
            rows = Scratch(spark, "languages").write(rows, "scored")
        rows = rows.mapInArrow(_score(spark.sparkContext.broadcast(block)), passed(docs.schema[id_col].dataType, SCORED))
    known = F.col("letters") > 0
    return rows.select(F.col("id").alias(id_col), F.when(known, F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(known, 1 / F.col("mass")).otherwise(0.0).alias("score"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc(F.col("doc_id"), 4) == 2
    found = identify(docs, train(docs.filter(~held_out)))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
