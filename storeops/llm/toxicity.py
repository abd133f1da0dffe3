"""Operator 6: toxicity by the nearest labelled examples.

Texts are vectors of all their words. A word's weight is its TF-IDF, with
document frequencies of the whole corpus, times its strength: how many
standard deviations its share of toxic examples lies from the share of all
examples, and 1 for the many words that lie within one. (By TF-IDF alone the
neighbours of a text are those that share its rare words, whatever their
label.) No word is left out, and norms are those of whole texts.

The examples lie in a block-max inverted index: they are dealt to blocks of
like examples, and each word keeps the largest weight that it has in each
block beside its postings. A text's words give an upper bound of its cosine
with any example of a block; the blocks of largest bounds are opened first,
and then all that could still hold one of the k nearest, so the k nearest are
exact. The neighbours' votes, weighted by squared cosine, are calibrated on
the examples themselves, fold by fold: strengths and neighbours of a fold come
from the other folds alone, so no example's label is in its own votes. The
nearest are the evidence.

The index is built from a bounded sample of labelled rows, so what is
broadcast is bounded too; texts are scored where they are read.
"""

from __future__ import annotations

import pickle
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeops.llm import arrays as A
from storeops.llm.shared import Scratch, id_crc, importable, passed, table

#: Labelled rows that the index is built from, those with the smallest hashes of their ids, different words of theirs in all, and of one of them, at most.
SAMPLE, POSTINGS, LONGEST = 2_500, 8_000_000, 100_000
#: Parts of the examples that are voted on by the others for the calibration.
FOLDS = 5
NEIGHBOURS, EVIDENCE = 15, 3
#: Examples of a block, and blocks that are opened before the bounds of the others are looked at.
BLOCK, FIRST = 32, 4
#: Words of most examples, whose postings lie in a matrix.
DENSE = 1_024
#: Texts, and words of theirs, that are searched for at once.
ROWS, TERMS = 128, 200_000
U = np.uint64
LETTERS = A.word_table("letters")


def counted(h: np.ndarray, row: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, count) of the different words of each row, by row and hash."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    if n is None:
        return h[at], row[at], np.diff(np.append(at, len(h)))
    return h[at], row[at], np.add.reduceat(n[order], at) if len(at) else n


def words(column: pa.Array, most: int = A.CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hash, row, count) of runs of rows; a long text is counted piece by piece."""
    for at, to, pieces in A.text_runs(column, LETTERS, most):
        parts = []
        for offsets, data in pieces:
            starts, ends, row = A.runs(LETTERS[data], offsets)
            parts.append(counted(A.span_hashes(data, starts, ends), row))
        yield (at, to, *(parts[0] if len(parts) == 1 else counted(*map(np.concatenate, zip(*parts, strict=True)))))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, toxic, words, counts) of the examples."""
    for batch in batches:
        for at, to, h, row, count in words(batch.column(2)):
            sizes = np.bincount(row, minlength=to - at)
            yield pa.record_batch([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), A.long_list(A.signed(h), sizes, pa.int64()), A.long_list(count, sizes, pa.int64())], names=["id", "toxic", "words", "counts"])


def _document_counts(shared):
    """(place in the vocabulary, documents with the word), summed over the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, _, h, _, _ in words(batch.column(0)):
                total += np.bincount(held(vocabulary, h)[1], minlength=len(vocabulary))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["place", "n"])

    return run


def held(vocabulary: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which hashes the vocabulary has, their places)."""
    if not len(vocabulary):
        return np.zeros(len(h), bool), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    inside = vocabulary[place] == h
    return inside, place[inside]


def idf_of(documents: int, n: np.ndarray) -> np.ndarray:
    return np.log((1 + documents) / (1 + n)) + 1


def strength_of(n: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """How far words are from the share of toxic examples, by examples with them and toxic ones of these; 1 at least."""
    return np.maximum(1, np.abs(toxic - n * share) / np.sqrt(n * share * (1 - share) + 1))


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all items of ranges, one range after the other."""
    return np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


@dataclass
class Index:
    """Block-max inverted index of vectors of norm 1."""

    vocabulary: np.ndarray
    #: Weight of one occurrence of each word, and of a word that no example has.
    weight: np.ndarray
    unknown: float
    #: Ids and labels of the examples, in the order of their blocks.
    ids: np.ndarray
    toxic: np.ndarray
    #: Row of each word in the matrices of frequent words, or -1; weights by word and example, and their largest by word and block.
    slot: np.ndarray
    dense: np.ndarray
    dense_most: np.ndarray
    #: Of the other words: ranges of (word, block) pairs by word; block, largest weight and range of postings by pair; example and weight by posting.
    pairs: np.ndarray
    pair_block: np.ndarray
    pair_most: np.ndarray
    postings: np.ndarray
    posting_example: np.ndarray
    posting_weight: np.ndarray
    #: Slope and shift of the calibration.
    theta: tuple[float, float] = (4.0, 0.0)
    #: Blocks that there are, examples of each, and how many are opened first.
    blocks: int = 0
    block: int = BLOCK
    first: int = FIRST
    #: Blocks that searches have opened, of how many.
    opened: list[int] = field(default_factory=lambda: [0, 0])

    def __getstate__(self) -> dict:
        # The matrix is mostly zeros, and every task's executor keeps the bytes on its disk.
        return {"packed": zlib.compress(pickle.dumps(self.__dict__, protocol=5), 1)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(pickle.loads(zlib.decompress(state["packed"])))

    @classmethod
    def of(cls, vocabulary: np.ndarray, weight: np.ndarray, unknown: float, ids: np.ndarray, toxic: np.ndarray, example: np.ndarray, place: np.ndarray, w: np.ndarray) -> Index:
        """From the weights ``w`` of the words at ``place`` in each example, by example."""
        n, v = len(ids), len(vocabulary)
        # Examples whose heaviest word (of those that could fill a block) is the same lie side by side, so that a block's largest weights are near those of its examples.
        count = np.bincount(place, minlength=v)
        common = count[place] >= BLOCK
        at, of, by = example[common], place[common], np.lexsort((w[common], example[common]))
        last = by[np.append(at[by][1:] != at[by][:-1], True)] if len(by) else by
        top = np.zeros(n, np.int64)
        top[at[last]] = of[last] + 1
        order = np.argsort(top, kind="stable")
        moved = np.empty(n, np.int64)
        moved[order] = np.arange(n)
        example = moved[example]
        by = np.lexsort((example, place))
        example, place, w = example[by], place[by], w[by]
        blocks = -(-n // BLOCK)
        slot = np.full(v, -1)
        most = np.argsort(-count, kind="stable")[: min(DENSE, v)]
        slot[most] = np.arange(len(most))
        dense = np.zeros((len(most), blocks * BLOCK))
        some = slot[place] >= 0
        dense[slot[place[some]], example[some]] = w[some]
        example, place, w = example[~some], place[~some], w[~some]
        key = place * blocks + example // BLOCK
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        pairs = np.searchsorted(place[first], np.arange(v + 1))
        return cls(
            vocabulary, weight, unknown, ids[order], toxic[order], slot, dense, dense.reshape(len(most), blocks, BLOCK).max(axis=2), pairs,
            example[first] // BLOCK, np.maximum.reduceat(w, first) if len(first) else w, np.append(first, len(w)), example, w, blocks=blocks, block=BLOCK, first=FIRST,
        )

    def vectors(self, h: np.ndarray, row: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, weight) of the known words of texts, so that each whole text has norm 1."""
        inside, place = held(self.vocabulary, h)
        tf = 1 + np.log(count)
        w = tf * self.unknown
        w[inside] = tf[inside] * self.weight[place]
        norm = np.sqrt(np.bincount(row, w * w, n))
        return row[inside], place, w[inside] / norm[row[inside]]

    def search(self, row: np.ndarray, place: np.ndarray, weight: np.ndarray, n: int, k: int = NEIGHBOURS, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, example, cosine) of the k examples of largest cosine above 0 with each of n texts, nearest first; ties by place in the index.

        ``but`` names an example for each text that isn't looked at.
        """
        slot, width = self.slot[place], self.blocks * self.block
        q = np.zeros((n, len(self.dense)))
        q[row[slot >= 0], slot[slot >= 0]] = weight[slot >= 0]
        row, place, weight = (x[slot < 0] for x in (row, place, weight))
        sizes = self.pairs[place + 1] - self.pairs[place]
        pair, row, weight = spread(self.pairs[place], sizes), np.repeat(row, sizes), np.repeat(weight, sizes)
        block = self.pair_block[pair]
        bound = q @ self.dense_most + np.bincount(row * self.blocks + block, weight * self.pair_most[pair], n * self.blocks).reshape(n, self.blocks)
        bound *= 1 + 1e-9
        cosines = np.full((n, width), -1.0)

        def visit(chosen: np.ndarray) -> np.ndarray:
            """Opens blocks of texts; returns the k-th largest cosine of each text so far."""
            for b in np.flatnonzero(chosen.any(axis=0)).tolist():
                of, at = np.flatnonzero(chosen[:, b]), slice(b * self.block, (b + 1) * self.block)
                cosines[of, at] = q[of] @ self.dense[:, at]
            some = chosen[row, block]
            p = pair[some]
            z = self.postings[p + 1] - self.postings[p]
            at = spread(self.postings[p], z)
            to = np.repeat(row[some] * width, z) + self.posting_example[at]
            cosines.reshape(-1)[:] += np.bincount(to, np.repeat(weight[some], z) * self.posting_weight[at], n * width)
            if but is not None:
                cosines[np.arange(n), but] = -1.0
            self.opened[0] += int(chosen.sum())
            return np.partition(cosines, width - k, axis=1)[:, width - k] if width > k else np.full(n, -1.0)

        first = np.zeros((n, self.blocks), bool)
        if self.blocks > self.first:
            np.put_along_axis(first, np.argpartition(-bound, self.first, axis=1)[:, : self.first], True, axis=1)
        else:
            first[:] = True
        first &= bound > 0
        least = visit(first)
        # Blocks whose bound is below what k examples have already can't hold a nearer one.
        least = visit((bound >= least[:, None]) & (bound > 0) & ~first)
        self.opened[1] += n * self.blocks
        text, example = np.nonzero((cosines >= least[:, None]) & (cosines > 0))
        found = cosines[text, example]
        order = np.lexsort((example, -found, text))
        text, example, found = text[order], example[order], found[order]
        keep = np.arange(len(text)) - np.searchsorted(text, text) < k
        return text[keep], example[keep], found[keep]

    def votes(self, text: np.ndarray, example: np.ndarray, cosine: np.ndarray, n: int) -> np.ndarray:
        """Toxic share of the neighbours' votes, weighted by squared cosine; 0 without neighbours."""
        w = cosine * cosine
        total = np.bincount(text, w, n)
        return np.bincount(text, w * self.toxic[example], n) / np.where(total > 0, total, 1)

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        a, b = self.theta
        return 1 / (1 + np.exp(-(a * (2 * votes - 1) + b)))


def batches_of(h: np.ndarray, row: np.ndarray, count: np.ndarray, n: int) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray, np.ndarray, int]]]:
    """(first text, text after the last, (word, row, count, texts)) of so many texts as are searched for at once."""
    bounds, at = np.searchsorted(row, np.arange(n + 1)), 0
    while at < n:
        to = min(n, at + ROWS, max(at + 1, int(np.searchsorted(bounds, bounds[at] + TERMS, side="right")) - 1))
        p = slice(bounds[at], bounds[to])
        yield at, to, (h[p], row[p] - at, count[p], to - at)
        at = to


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, postings: int = POSTINGS, longest: int = LONGEST) -> Index | None:
    """The index of a bounded sample of labelled rows, or None without examples of both kinds or without any word in them.

    Rows without id, label (0 or 1) or text are left out, and so are ids with
    both labels. Of an id that stands on several rows, one text is taken, the
    one of smallest hash. Texts of any length are counted where they lie; one
    of over ``longest`` different words is left out by itself, and those of the
    largest hashes where all would have more than ``postings``. What is left
    out for that, and that nothing can be learned, is told in a warning.
    """

    def none() -> None:
        warnings.warn("there is no index of toxic texts: no labelled texts of both kinds have words", stacklevel=3)

    spark = docs.sparkSession
    importable(spark)
    scratch = Scratch(spark, "toxicity")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)")
    known = known.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other")
    some = known.select("id", "toxic", F.xxhash64("id").alias("rank")).orderBy("rank", "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    # At most ``sample`` narrow rows are broadcast.
    rows = texts.join(F.broadcast(some), "id").groupBy("id", "toxic", "rank").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    # Texts are counted where they lie; from here on an example is its words.
    rows = scratch.write(rows.select("id", "toxic", "text").mapInArrow(_vectors, passed(docs.schema[id_col].dataType, "toxic int, words array<bigint>, counts array<bigint>")), "sample")
    sizes = rows.select(F.xxhash64("id").alias("rank"), F.size("words").alias("n")).toPandas().sort_values("rank")  # a row for each example
    within = sizes[sizes["n"] <= longest]
    taken = within[within["n"].cumsum() <= postings]
    if len(taken) < len(sizes):
        warnings.warn(f"{len(sizes) - len(taken)} of {len(sizes)} labelled texts are left out, since they have too many words", stacklevel=2)
    if not len(taken):
        return none()
    found = rows.filter((F.size("words") <= longest) & (F.xxhash64("id") <= int(taken["rank"].iloc[-1]))).toArrow().combine_chunks()
    toxic = found["toxic"].to_numpy().astype(float)
    lists = found["words"].combine_chunks()
    h, sizes = lists.flatten().to_numpy().view(U), lists.value_lengths().to_numpy()
    if not 0 < toxic.sum() < len(toxic) or not len(h):
        return none()
    example = np.repeat(np.arange(len(toxic)), sizes)
    vocabulary, place = np.unique(h, return_inverse=True)
    given = spark.sparkContext.broadcast(vocabulary)
    counts = texts.select("text").mapInArrow(_document_counts(given), "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    given.unpersist()
    df = np.zeros(len(vocabulary), np.int64)
    df[counts["place"].to_numpy()] = counts["n"].to_numpy()
    documents = texts.count()
    frequent, ids = idf_of(documents, df), np.array(found["id"].to_pylist(), object)
    tf = 1 + np.log(found["counts"].combine_chunks().flatten().to_numpy())
    unknown = float(idf_of(documents, np.zeros(1))[0])
    index = learned(vocabulary, frequent, unknown, ids, toxic, example, place, tf)
    index.theta = calibrate(spark, frequent, ids, toxic, example, place, tf)
    return index


def learned(vocabulary: np.ndarray, frequent: np.ndarray, unknown: float, ids: np.ndarray, toxic: np.ndarray, example: np.ndarray, place: np.ndarray, tf: np.ndarray) -> Index:
    """The index of examples, with the strengths of words that these have."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    v = len(vocabulary)
    weight = frequent * strength_of(np.bincount(place, minlength=v), np.bincount(place, toxic[example], v), share)
    w = tf * weight[place]
    norm = np.sqrt(np.bincount(example, w * w, len(toxic)))
    return Index.of(vocabulary, weight, unknown, ids, toxic, example, place, w / norm[example])


def fold_of(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(f"fold {i}".encode()) % FOLDS for i in ids.tolist()], int)


def _votes(shared):
    """(example, votes of the other folds on it) of folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, toxic, fold, example, place, tf = shared.value
        names = np.zeros(len(frequent), U)  # searches go by place, not by hash
        for batch in batches:
            for f in batch.column(0).to_pylist():
                for_it, others = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
                mine = fold[example] == f
                if not len(for_it) or not len(others) or mine.all():
                    continue
                moved = np.empty(len(fold), np.int64)
                moved[others], moved[for_it] = np.arange(len(others)), np.arange(len(for_it))
                index = learned(names, frequent, 0.0, others, toxic[others], moved[example[~mine]], place[~mine], tf[~mine])
                w, row = tf[mine] * index.weight[place[mine]], moved[example[mine]]
                norm = np.sqrt(np.bincount(row, w * w, len(for_it)))
                order = np.argsort(row, kind="stable")
                row, p, w = row[order], place[mine][order], (w / norm[row])[order]
                votes = np.zeros(len(for_it))
                for at, to, (x, r, y, m) in batches_of(p, row, w, len(for_it)):
                    votes[at:to] = index.votes(*index.search(r, x, y, m), m)
                del index  # before the next fold has one
                yield pa.record_batch([pa.array(for_it), pa.array(votes)], names=["example", "votes"])

    return run


def calibrate(spark: SparkSession, frequent: np.ndarray, ids: np.ndarray, toxic: np.ndarray, example: np.ndarray, place: np.ndarray, tf: np.ndarray) -> tuple[float, float]:
    """The logistic curve from the votes of the other folds on each fold's examples to their labels.

    One task takes the folds one after the other, as each needs the memory of
    an index and the sample is of bounded size.
    """
    shared = spark.sparkContext.broadcast((frequent, toxic, fold_of(ids), example, place, tf))
    found = spark.range(0, FOLDS, 1, 1).mapInArrow(_votes(shared), "example bigint, votes double").toPandas()  # a row for each example
    shared.unpersist()
    votes = np.zeros(len(ids))
    votes[found["example"].to_numpy()] = found["votes"].to_numpy()
    # An example that is alone of its kind says nothing once it is left out.
    tells = np.where(toxic == 1, toxic.sum() > 1, (1 - toxic).sum() > 1)
    return platt(votes[tells], toxic[tells] == 1)


def platt(votes: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from votes (as 2 v - 1) to shares of toxic rows, with smoothed targets."""
    x = np.stack([2 * votes - 1, np.ones(len(votes))], axis=1)
    n = toxic.sum()
    y = np.where(toxic, (n + 1) / (n + 2), 1 / (len(toxic) - n + 2))
    prior = np.array([4.0, 0.0])
    theta = prior
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(2), x.T @ (p - y) + 1e-1 * (theta - prior))
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def _score(shared, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        kind = pa.list_(pa.struct([("example", pa.string()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for batch in batches:
            for start, end, *found in words(batch.column(1)):
                for at, to, (h, row, count, n) in batches_of(*found, end - start):
                    text, example, cosine = index.search(*index.vectors(h, row, count, n), n)
                    votes = index.votes(text, example, cosine, n)
                    some = np.bincount(text, minlength=n) > 0
                    near = np.arange(len(text)) - np.searchsorted(text, text) < EVIDENCE
                    told: list[list[dict]] = [[] for _ in range(n)]
                    for t, e, c in zip(text[near].tolist(), example[near].tolist(), cosine[near].tolist(), strict=True):
                        told[t].append({"example": str(index.ids[e]), "cosine": c, "toxic": int(index.toxic[e])})
                    columns = [batch.column(0).slice(start + at, n), pa.array(np.where(some, index.calibrated(votes), 0.0)), pa.array(told, kind)]
                    names = ["id", "score", "evidence"]
                    if keep:
                        columns, names = [*columns, batch.column(1).slice(start + at, n)], [*names, "text"]
                    yield pa.record_batch(columns, names=names)

    return run


def score(docs: DataFrame, index: Index | None, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, score, predicted, evidence (the nearest examples), and with ``keep_text`` the text.

    A text that shares no word with any example, a null or an empty one
    included, has no neighbours and score 0, as all have without an index. A
    very long text is counted in pieces. Repeated rows stay repeated, equal
    cosines go by the examples' places in the index, an empty table gives an
    empty result, and other columns are not looked at.
    """
    spark = docs.sparkSession
    importable(spark)
    evidence = "array<struct<example:string,cosine:double,toxic:int>>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if index is None:
        found = rows.select("id", F.lit(0.0).alias("score"), F.array().cast(evidence).alias("evidence"), *(["text"] if keep_text else []))
    else:
        found = rows.mapInArrow(_score(spark.sparkContext.broadcast(index), keep_text), passed(docs.schema[id_col].dataType, f"score double, evidence {evidence}" + ", text string" * keep_text))
    return found.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", *([F.col("text").alias(text_col)] if keep_text else []))


def held_out(id_: Column) -> Column:
    return F.coalesce(id_crc(id_, 5) == 0, F.lit(False))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score(docs, index).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
