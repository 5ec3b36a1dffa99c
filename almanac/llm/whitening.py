"""Whitening of embeddings with exact covariances from bit-sliced scatter.

An entry c is the whole number floor(64 * c) + 1,000,000. Of each Arrow batch
the numbers of a dimension are shifted by the batch's least one, and each of
their bits becomes a plane: one bit a row, 64 rows a machine word. The product
sum of two dimensions is the sum over pairs of their planes of
2^(plane + plane) times the set bits of the planes' AND, so a task multiplies
nothing, rounds nothing, and holds one batch's planes beside one sum for each
pair of dimensions. The shifts are taken out again exactly, tasks' sums are
added in 32-bit parts (``vectors.parts``), and the driver centres them as whole
numbers, n * P - S * S', before the only division and ``eigh``. What reaches
the driver is a row for each pair of dimensions, whatever the number of rows.

Defined results: vectors that are null or hold null or non-finite entries are
dropped; shorter vectors than the longest count as having zeros at their end
(an empty one is all zeros); entries beyond 2^62 in size after scaling count as
that; a component without variance (an eigenvalue of rounding size) has null
``whitened`` and stands out of ``identity_error`` (0 if there is no other);
``deviation`` is null where it does not fit a long (some 10^7 rows and more),
``deviation_exact`` is always there as a decimal of 38 digits. Equal rows each
count and each come out; a null vec_id is kept. A component's largest entry is
positive (of equal ones the first). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import table
from almanac.llm.vectors import LONG, PARTS, numbers, parts, totals, whole, width

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Scaled entries beyond this size count as it.
FARTHEST = 1 << 62


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as longs; the offset is added where sums are made."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * x).clip(-float(FARTHEST), float(FARTHEST)).astype(np.int64)


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes, dimension, place) of unsigned numbers (rows x dimensions): a plane a row, 64 numbers a word, zero planes left out."""
    rows, dims = y.shape
    words = -(-rows // 64)
    columns = np.zeros((dims, 64 * words), np.uint64)
    columns[:, :rows] = y.T
    planes, dimension, place = [], [], []
    for bit in range(int(y.max(initial=0)).bit_length()):
        packed = np.packbits((columns >> np.uint64(bit) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64)
        used = np.flatnonzero(packed.any(axis=1))
        planes.append(packed[used])
        dimension.append(used)
        place.append(np.full(len(used), bit))
    if not planes:
        return np.zeros((0, words), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    dimension, place = np.concatenate(dimension), np.concatenate(place)
    order = np.lexsort((place, dimension))
    return np.concatenate(planes)[order], dimension[order], place[order]


def scatter(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, product sums of each pair i <= j) of the columns of z, as Python's whole numbers."""
    rows, dims = z.shape
    least = z.min(axis=0)
    y = z.view(np.uint64) - least.view(np.uint64)  # right modulo 2^64, so right
    planes, dimension, place = bit_planes(y)
    small = 2 * int(place.max(initial=0)) + rows.bit_length() + 8 < 63
    kind = np.int64 if small else object
    product, total = np.zeros((dims, dims), kind), np.zeros(dims, object)
    for k in range(len(planes)):
        both = np.bitwise_count(planes[k:] & planes[k]).sum(axis=1, dtype=np.int64)
        total[dimension[k]] += int(both[0]) << int(place[k])
        both[1:][dimension[k + 1 :] == dimension[k]] *= 2  # of one dimension's planes each pair is met once
        weighted = both.astype(kind) << (place[k:] + place[k]).astype(kind)
        np.add.at(product[dimension[k]], dimension[k:], weighted)
    # the shifts: x = y + least
    least = least.astype(object)
    product = product.astype(object) + np.outer(least, total) + np.outer(total, least) + rows * np.outer(least, least)
    return total + rows * least, product


@dataclass
class Fit:
    """What whitens: n, the sums (with the offset), eigenvalues and eigenvectors by falling eigenvalue, the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def used(self) -> np.ndarray:
        """Which components have variance beyond rounding."""
        return self.values > self.values.max(initial=0) * len(self.sums) * 2.0**-50

    @property
    def projection(self) -> np.ndarray:
        """Columns that whiten a centred vector; NaN where there is no variance."""
        root = np.sqrt(np.where(self.used, self.values, np.nan))
        return (self.vectors / root)[:, :COMPONENTS]


def _scattered(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            _, x = whole(batch.column("vector"), dims)
            if len(x):
                s, p = scatter(scaled(x))
                n, sums, products = n + len(x), sums + s, products + p
        pairs = ((i, j, products[i, j]) for i in range(dims) for j in range(i, dims))
        yield parts([(-1, -1, n), *((-1, i, v) for i, v in enumerate(sums)), *pairs])

    return run


def _vectors(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id"), numbers(F.col("embedding")).alias("vector"))


def fit(embeddings: DataFrame) -> Fit | None:
    """Sums and eigenvectors of all vectors; None without any."""
    dims = width(embeddings, "embedding")
    found = totals(_vectors(embeddings).mapInArrow(_scattered(dims), PARTS))
    n = found.get((-1, -1), 0)
    if not n:
        return None
    s = [found.get((-1, i), 0) for i in range(dims)]
    v = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            v[i, j] = v[j, i] = (n * found.get((i, j), 0) - s[i] * s[j]) / n**2  # whole numbers up to here
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1].clip(0), vectors[:, ::-1]
    largest = np.abs(vectors).argmax(axis=0) if dims else np.zeros(0, int)
    vectors = vectors * np.sign(vectors[largest, np.arange(dims)])
    return Fit(n, [a + n * OFFSET for a in s], values, vectors, float(np.trace(v)))


def centred(z: np.ndarray, model: Fit) -> np.ndarray:
    """n * x - S, exactly: longs where they and their products fit."""
    s = [a - model.n * OFFSET for a in model.sums]
    bound = model.n * int(np.abs(z).max(initial=0)) + max(map(abs, s), default=0)
    if bound * bound * max(len(s), 1) < LONG:
        return model.n * z - np.array(s, np.int64)
    return model.n * z.astype(object) - np.array(s, object)


def _whitened(d: np.ndarray, model: Fit) -> np.ndarray:
    # object arrays divide as whole numbers, rounded once; longs below 2^53 do as well
    return (d / model.n).astype(np.float64) @ model.projection


def identity_error(embeddings: DataFrame, model: Fit) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, from the vectors themselves."""
    used, dims = np.flatnonzero(model.used[:COMPONENTS]), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, product = np.zeros(len(used)), np.zeros((len(used), len(used)))
        for batch in batches:
            _, x = whole(batch.column("vector"), dims)
            if len(x):
                w = _whitened(centred(scaled(x), model), model)[:, used]
                total += w.sum(axis=0)
                product += w.T @ w
        a, b = np.triu_indices(len(used))
        yield pa.RecordBatch.from_pydict({"a": np.append(a, np.full(len(used), -1)), "b": np.append(b, np.arange(len(used))), "value": np.append(product[a, b], total)}, schema=pa.schema([("a", pa.int32()), ("b", pa.int32()), ("value", pa.float64())]))

    sums = {(r.a, r.b): r.value for r in _vectors(embeddings).mapInArrow(run, "a int, b int, value double").groupBy("a", "b").agg(F.sum("value").alias("value")).collect()}  # a row for each pair of components
    error = 0.0
    for (a, b), value in sums.items():
        if a >= 0:
            error = max(error, abs(value / model.n - sums[-1, a] * sums[-1, b] / model.n**2 - (a == b)))
    return error


def whiten(embeddings: DataFrame, model: Fit) -> DataFrame:
    """(vec_id, deviation_exact, whitened) of each vector, ``whitened`` an array with an entry for each component."""
    dims = len(model.sums)
    kind = embeddings.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = whole(batch.column("vector"), dims)
            d = centred(scaled(x), model)
            w = _whitened(d, model)
            squares = (d * d).sum(axis=1) if dims else np.zeros(len(kept), np.int64)
            exact = pa.array(squares, pa.int64()).cast(pa.decimal128(38, 0)) if squares.dtype == np.int64 else pa.array([Decimal(int(v)) if v < 10**38 else None for v in squares], pa.decimal128(38, 0))
            flat = pa.array(w.ravel(), from_pandas=True)  # NaN is null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * w.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(kept)), exact, lists], names=["vec_id", "deviation_exact", "whitened"])

    return _vectors(embeddings).mapInArrow(run, f"vec_id {kind}, deviation_exact decimal(38,0), whitened array<double>")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component."""
    embeddings = table(spark, sf_dir, "embeddings")
    model = fit(embeddings)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
    share = [float(e / model.trace) if model.trace else 0.0 for e in model.values[:COMPONENTS]]
    return (
        whiten(embeddings, model)
        .select("vec_id", "deviation_exact", F.posexplode("whitened").alias("k", "whitened"))
        .select(
            "vec_id",
            (F.col("k") + 1).cast("int").alias("component"),
            F.lit(model.n).cast("long").alias("n"),
            F.expr("try_cast(deviation_exact AS bigint)").alias("deviation"),
            "whitened",
            F.get(F.array(*map(F.lit, share)).cast("array<double>"), F.col("k")).alias("explained"),
            F.lit(identity_error(embeddings, model)).alias("identity_error"),
            "deviation_exact",
        )
    )
