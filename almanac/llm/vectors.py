"""Vectors out of Arrow columns, and whole numbers of any size in sums of longs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = 1 << 63
_LIMB = 32

#: Rows that carry parts of whole numbers: (a, b) names the number.
PARTS = "a int, b int, limb int, value long"
_PARTS = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])


def parts(numbers: Iterable[tuple[int, int, int]]) -> pa.RecordBatch:
    """(a, b, number) as rows of 32 bits each, so that Spark's sums of longs stay exact for numbers of any size."""
    rows: list[tuple[int, int, int, int]] = []
    for a, b, number in numbers:
        sign, rest, limb = (1, int(number), 0) if number >= 0 else (-1, -int(number), 0)
        while rest:
            if low := rest & ((1 << _LIMB) - 1):
                rows.append((a, b, limb, sign * low))
            rest >>= _LIMB
            limb += 1
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, _PARTS.types, strict=True)], schema=_PARTS)


def totals(rows: DataFrame) -> dict[tuple[int, int], int]:
    """The sum of each number's parts over all tasks; a row for each number and limb comes to the driver."""
    out: dict[tuple[int, int], int] = {}
    for a, b, limb, value in rows.groupBy("a", "b", "limb").agg(F.sum("value")).collect():
        out[a, b] = out.get((a, b), 0) + (value << (_LIMB * limb))
    return out


def numbers(embedding: Column) -> Column:
    """The vector's entries as doubles."""
    return embedding.cast("array<double>")


def whole(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the vectors without null or non-finite entries.

    The matrix has ``dims`` columns: shorter vectors are filled up with zeros, longer ones are not there.
    """
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()  # entries of null vectors are left out
    good = np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False)) if len(flat) else np.zeros(0, bool)
    row = np.repeat(np.arange(len(size)), size.clip(0))
    bad = np.bincount(row[~good], minlength=len(size)) > 0
    kept = np.flatnonzero((size >= 0) & ~bad & (size <= dims))
    place = np.cumsum(size.clip(0)) - size.clip(0)
    out = np.zeros((len(kept), dims))
    mine = np.isin(row, kept) if len(kept) < len(size) else np.ones(len(row), bool)
    line = np.full(len(size), -1)
    line[kept] = np.arange(len(kept))
    out[line[row[mine]], (np.arange(len(row)) - place[row])[mine]] = flat.to_numpy(zero_copy_only=False)[mine] if len(flat) else 0
    return kept, out


def floors(x: np.ndarray, scale: int, bits: int) -> np.ndarray:
    """floor(scale * x), exactly: longs where all are within ``bits`` bits, else Python's whole numbers."""
    with np.errstate(over="ignore"):
        low = np.floor(scale * x)
    if not low.size or np.abs(low).max() < 2.0**bits:
        return low.astype(np.int64)
    exact = [int(v) * scale if abs(v) >= 2.0**53 else int(w) for v, w in zip(x.ravel().tolist(), low.ravel().tolist(), strict=True)]
    return np.array(exact, object).reshape(x.shape)


def width(df: DataFrame, column: str) -> int:
    """The length of the longest vector without null or non-finite entries (0 without any)."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = 0
        for batch in batches:
            vectors = batch.column(0)
            size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = vectors.flatten()
            bad = ~np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False)) if len(flat) else np.zeros(0, bool)
            size[np.repeat(np.arange(len(size)), size)[bad]] = 0
            longest = max(longest, int(size.max(initial=0)))
        yield pa.RecordBatch.from_pydict({"longest": pa.array([longest], pa.int64())})

    return df.select(numbers(F.col(column)).alias("vector")).mapInArrow(lengths, "longest long").agg(F.max("longest")).first()[0] or 0
