"""Operator 13: whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Vectors are packed into blocks of whole numbers once, so that counts and sums
are exact. Then each step is one pass over the blocks: every task multiplies
its centred rows with a vector (Xw), takes the product of its rows with that
(X'u) and adds both up; Spark sums the tasks' results by place, and as many
numbers as a vector has entries reach the driver. A left vector has an entry
for each row and is never stored: it is X times a short vector that the driver
keeps, which also gives its products with all left vectors before it. Both
sides are reorthogonalised in full. The small bidiagonal matrix's singular
values are the deviations, and its right vectors give the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeops.llm.shared import Scratch, importable, passed, table

#: An entry c counts as the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Vectors of a block at most, and the size from which on an entry can't be summed exactly any more.
BLOCK, MOST = 1024, 1 << 52
#: Share of the largest deviation under which a direction counts as constant.
FLAT = 1e-9


def whole(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (places of the rows, whole numbers) of the vectors that are neither null nor empty and have finite entries only."""
    bounds, values = column.offsets.to_numpy(), column.values
    entries = values.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE
    with np.errstate(invalid="ignore"):
        bad = ~(np.abs(entries) < MOST)  # null and NaN too
    before = np.concatenate([[0], np.cumsum(bad)])
    lengths = np.diff(bounds)
    good = np.asarray(column.is_valid()) & (before[bounds[1:]] == before[bounds[:-1]]) & (lengths > 0)
    out = {}
    for d in np.unique(lengths[good]).tolist():
        rows = np.flatnonzero(good & (lengths == d))
        out[d] = rows, np.floor(entries[bounds[rows][:, None] + np.arange(d)]).astype(np.int64) + SHIFT
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, (_, x) in whole(batch.column(0)).items():
            for at in range(0, len(x), BLOCK):
                some = x[at : at + BLOCK]
                row = [[d], [len(some)], [some.sum(axis=0).tolist()], [some.tobytes()]]
                yield pa.record_batch([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["d", "n", "sums", "x"])


@dataclass
class Whitening:
    """What was fitted: the number of vectors, the sums of their entries, components (rows) with their eigenvalues, and the trace of the covariance."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trace: float = 0.0
    identity_error: float = 0.0

    def differences(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: as Python's numbers where 64 bits don't hold them."""
        big = max(int(np.abs(x).max(initial=0)) * self.n, *map(abs, self.sums)) >= 1 << 62
        return x.astype(object) * self.n - np.array(self.sums, dtype=object) if big else x * self.n - np.array(self.sums, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.differences(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sums of the squares of n * x - sums by row, null where 64 bits don't hold one."""
        t = self.differences(x)
        if t.dtype != object and int(np.abs(t).max(initial=0)) ** 2 * t.shape[1] < 1 << 63:
            return (t * t).sum(axis=1).tolist()
        found = [sum(v * v for v in row) for row in t.tolist()]
        return [v if v < 1 << 63 else None for v in found]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values)[:, None]).T


def summed(blocks: DataFrame, d: int, of) -> np.ndarray:
    """The sum over all blocks of the numbers that ``of`` makes of a block's matrix; they are added up in the tasks and by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0):
                one = of(np.frombuffer(raw.as_py(), np.int64).reshape(-1, d))
                total = one if total is None else total + one
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "value"])

    found = blocks.select("x").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    return found.sort_values("place")["value"].to_numpy()


def bidiagonal(product, d: int, steps: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """(right vectors as rows, upper bidiagonal matrix) of a matrix X that is only met in ``product(w)``: X'Xw and the square of |Xw|, in one array.

    Where the vectors found so far span all that X reaches from the first one,
    a new direction is begun, so equal singular values are all found; it ends
    when such a direction is one that X takes to nothing.
    """
    rng = np.random.default_rng(seed)
    right, short, back = np.zeros((0, d)), np.zeros((0, d)), np.zeros((0, d))  # v_j; w_j of u_j = X w_j; X'u_j
    matrix, beta, size, fresh = np.zeros((steps, steps)), 0.0, 0.0, True

    def against(r: np.ndarray) -> np.ndarray:
        for _ in range(2):
            r = r - right.T @ (right @ r)
        return r

    v = rng.standard_normal(d)
    v /= np.linalg.norm(v)
    for j in range(steps):
        right = np.vstack([right, v])
        w = v - beta * short[-1] if beta else v
        out = product(w)
        z, square = out[:d], out[d]
        over = short @ z  # u_i * Xw for all left vectors before
        w, z, square = w - over @ short, z - over @ back, square - over @ over
        size = max(size, float(np.sqrt(max(out[d], 0.0))))
        alpha = float(np.sqrt(max(square, 0.0)))
        if alpha <= 1e-13 * size or not size:
            if fresh:
                return right[:-1], matrix[:j, :j]
            alpha, w, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, z = w / alpha, z / alpha
        short, back = np.vstack([short, w]), np.vstack([back, z])
        matrix[j, j] = alpha
        if j + 1 == steps:
            break
        r = against(z - alpha * v)
        beta = float(np.linalg.norm(r))
        fresh = beta <= 1e-12 * size
        if fresh:
            beta, r = 0.0, against(rng.standard_normal(d))
        matrix[j, j + 1] = beta
        v = r / np.linalg.norm(r)
    return right, matrix


def fit(vectors: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding", steps: int | None = None) -> Whitening:
    """Fits on all vectors of the length that most have.

    Rows are left out whose vector is null or empty, holds null, NaN or
    infinite entries, or such as reach 2**52 when scaled; so are vectors of
    another length than most (of equally many, the longer). Repeated rows
    count as often as they come. Directions in which the vectors don't differ
    make no component, so equal vectors, a single one or none give none.
    ``steps`` are the passes over the vectors; None takes one for each
    dimension, which finds equal eigenvalues too.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    blocks = scratch.write(vectors.select(F.col(f"`{vector_col}`").cast("array<double>").alias("v")).mapInArrow(_pack, "d int, n bigint, sums array<bigint>, x binary"), "blocks")
    most = blocks.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return Whitening()
    d, n = most["d"], most["n"]
    blocks = blocks.filter(F.col("d") == d)
    sums = blocks.select(F.posexplode("sums").alias("place", "s")).groupBy("place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row for each dimension
    model = Whitening(n, [int(r["s"]) for r in sorted(sums)])

    def step(w: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            z = model.centred(x)
            u = z @ w
            return np.append(u @ z, u @ u)

        return summed(blocks, d, of)

    model.trace = float(summed(blocks, d, lambda x: np.array([(model.centred(x) ** 2).sum()]))[0]) / n
    right, matrix = bidiagonal(step, d, min(d, steps or d))
    if not len(matrix):
        return model
    _, deviations, turned = np.linalg.svd(matrix)
    found = (turned @ right)[: min(components, int((deviations > FLAT * deviations[0]).sum()))]
    # Either sign is right; the largest entry is positive, so that fits agree.
    found *= np.sign(found[np.arange(len(found)), np.abs(found).argmax(axis=1)])[:, None]
    model.components, model.values = found, deviations[: len(found)] ** 2 / n
    k = len(found)
    if k:
        def spread(x: np.ndarray) -> np.ndarray:
            y = model.whiten(x)
            return np.append(y.sum(axis=0), y.T @ y)

        got = summed(blocks, d, spread) / n
        model.identity_error = float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())
    scratch.drop("blocks")
    return model


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector that :func:`fit` would take and each component: id, component, n, deviation, whitened, explained, identity_error.

    Ids of any type, null or repeated, pass through; other columns are not
    looked at; an empty table, or a model without components, gives no rows.
    ``deviation`` is null where 64 bits don't hold it. A vector meets the
    model where it is read: nothing is shuffled.
    """
    importable(vectors.sparkSession)
    k, d = len(model.values), len(model.sums)
    kind = vectors.schema[id_col].dataType
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole(batch.column(1)).get(d, (np.zeros(0, int), np.zeros((0, d), np.int64)))
            for at in range(0, len(rows) if k else 0, BLOCK):
                some, each = x[at : at + BLOCK], np.repeat(rows[at : at + BLOCK], k)
                m = len(some)
                columns = [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, np.int64)),
                    pa.array([v for v in model.deviations(some) for _ in range(k)], pa.int64()),
                    pa.array(model.whiten(some).ravel()),
                    pa.array(np.tile(model.values / model.trace, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ]
                yield pa.record_batch(columns, names=names)

    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    schema = passed(kind, "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whiten(vectors, fit(vectors))
