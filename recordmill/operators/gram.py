"""Correlations of many columns, and moments by class, from dense partial sums: one pass over the rows, a plan that doesn't grow with the columns.

A task keeps, for each pair of columns, six sums over the rows where both have values: how many, the sums and squares of
either side, and the products, all about a shift near the column's mean. Tasks' sums are added up by tile of columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of columns that a task keeps sums for in one pass, and columns of a tile.
CELLS, TILE = 2_000_000, 256
#: A variance below this share of the squares about the shift counts as rounding, thus as none.
ROUNDING = 1e-13


def matrix(b: pa.RecordBatch, first: int = 0) -> np.ndarray:
    """A batch's columns from ``first`` on as doubles; null is NaN."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[first:]]) if b.num_columns > first else np.zeros((b.num_rows, 0))


def centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values about their column's mean, 0 where missing; where there are values; the shift taken off). Columns of equal values become exactly 0."""
    held = ~np.isnan(x)
    start = x[held.argmax(axis=0), np.arange(x.shape[1])]
    start = np.where(np.isfinite(start), start, 0.0)
    moved = np.where(held, x - start, 0.0)
    mean = moved.sum(axis=0) / np.maximum(held.sum(axis=0), 1)
    mean = np.where(np.isfinite(mean), mean, 0.0)
    return np.where(held, moved - mean, 0.0), held, start + mean


class Sums:
    """For pairs (row column, column): n, sx, sy, qx, qy, c about the shifts ``a`` of rows and ``b`` of columns."""

    def __init__(self, a: np.ndarray, b: np.ndarray, cells: np.ndarray):
        self.a, self.b, self.cells = a, b, cells

    @classmethod
    def of(cls, x: np.ndarray, rows: slice) -> Sums:
        v, held, shift = centred(x)
        n, p = v.shape
        r = v[:, rows]
        cells = np.empty((6, r.shape[1], p))
        if held.all():
            s, q = v.sum(axis=0), (v * v).sum(axis=0)
            cells[0], cells[1], cells[2], cells[3], cells[4] = n, s[rows][:, None], s, q[rows][:, None], q
        else:
            m = held.astype(float)
            cells[0], cells[1], cells[2], cells[3], cells[4] = m[:, rows].T @ m, r.T @ m, m[:, rows].T @ v, (r * r).T @ m, m[:, rows].T @ (v * v)
        cells[5] = r.T @ v
        return cls(shift[rows], shift, cells)

    def about(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The sums about other shifts."""
        n, sx, sy, qx, qy, c = self.cells
        d, e = (self.a - a)[:, None], (self.b - b)[None, :]
        return np.stack([n, sx + n * d, sy + n * e, qx + d * (2 * sx + n * d), qy + e * (2 * sy + n * e), c + d * sy + e * sx + n * d * e])

    def add(self, other: Sums) -> None:
        """Both sums about the mean of both, so that no digit is lost to a shift that was far off."""

        def mid(mine: np.ndarray, its: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
            return np.where(n + m > 0, mine + (its - mine) * (m / np.maximum(n + m, 1)), mine)

        a, b = mid(self.a, other.a, self.cells[0].max(axis=1), other.cells[0].max(axis=1)), mid(self.b, other.b, self.cells[0].max(axis=0), other.cells[0].max(axis=0))
        self.cells, self.a, self.b = self.about(a, b) + other.about(a, b), a, b

    def correlations(self) -> np.ndarray:
        n, sx, sy, qx, qy, c = self.cells
        with np.errstate(all="ignore"):
            x, y = qx - sx * sx / n, qy - sy * sy / n
            x, y = np.where(x > ROUNDING * qx, x, np.nan), np.where(y > ROUNDING * qy, y, np.nan)
            return np.where(n > 1, np.clip((c - sx * sy / n) / np.sqrt(x * y), -1, 1), np.nan)


_PARTIAL = "strip int, tile int, a binary, b binary, cells binary"


def _partials(strip: int, rows: slice):
    """A task's sums of a strip of row columns with all columns, a row for each tile of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = Sums.of(matrix(b), rows)
                total = own if total is None else (total.add(own), total)[1]
        if total is None:
            return
        for tile, at in enumerate(range(0, len(total.b), TILE)):
            row = (strip, tile, total.a.tobytes(), total.b[at : at + TILE].tobytes(), np.ascontiguousarray(total.cells[:, :, at : at + TILE]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if i < 2 else pa.binary()) for i, x in enumerate(row)], names=["strip", "tile", "a", "b", "cells"])

    return run


def _added(height: int):
    """Sums sorted by (strip, tile) to (i, j, n, r) for columns i before j; one tile is held at a time."""

    def told(strip: int, tile: int, total: Sums) -> pa.RecordBatch:
        r, n = total.correlations(), total.cells[0]
        i, j = np.nonzero((np.arange(r.shape[0])[:, None] + strip * height) < (np.arange(r.shape[1])[None, :] + tile * TILE))
        columns = [pa.array((i + strip * height).astype(np.int32)), pa.array((j + tile * TILE).astype(np.int32)), pa.array(n[i, j].astype(np.int64)), pa.array(r[i, j], mask=~np.isfinite(r[i, j]))]
        return pa.RecordBatch.from_arrays(columns, names=["i", "j", "n", "r"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for b in batches:
            for strip, tile, *raw in zip(*(c.to_pylist() for c in b.columns)):
                a, c, cells = (np.frombuffer(x) for x in raw)
                own = Sums(a, c, cells.reshape(6, len(a), len(c)))
                if (strip, tile) != key:
                    if key is not None:
                        yield told(*key, total)
                    key, total = (strip, tile), own
                else:
                    total.add(own)
        if key is not None:
            yield told(*key, total)

    return run


def correlations(df: DataFrame, cells: int = CELLS) -> DataFrame:
    """(i, j, n, r): the correlation of each pair of columns, i before j by position, over the n rows where both have values; NaN counts as none.

    r is null where it is undefined or a value is infinite. All columns up to about 1,400 take one pass over the rows, more of them a pass for
    each strip of ``cells`` pairs. What moves is six numbers a pair and task.
    """
    p = len(df.columns)
    if p < 2:
        return df.sparkSession.createDataFrame([], "i int, j int, n long, r double")
    height = max(1, min(p, cells // p))
    rows = df.toDF(*[f"c{i}" for i in range(p)]).select(*[F.col(f"c{i}").cast("double") for i in range(p)])
    parts = None
    for strip, at in enumerate(range(0, p, height)):
        one = rows.mapInArrow(_partials(strip, slice(at, min(p, at + height))), _PARTIAL)
        parts = one if parts is None else parts.unionAll(one)
    return parts.repartition("strip", "tile").sortWithinPartitions("strip", "tile").mapInArrow(_added(height), "i int, j int, n long, r double")


def _by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, features..) to (class, n, mean, square): each feature's count, mean, and squares about the mean, in one task."""
    held: dict[str, list[np.ndarray]] = {}
    for b in batches:
        if not b.num_rows:
            continue
        codes, x = b.column(0).dictionary_encode(), matrix(b, 1)
        at = codes.indices.to_numpy(zero_copy_only=False)
        for k, name in enumerate(codes.dictionary.to_pylist()):
            v, has, mean = centred(x[at == k])
            own = [has.sum(axis=0).astype(float), mean, (v * v).sum(axis=0)]
            held[name] = merged(held[name], own) if name in held else own
    if held:
        lists = [pa.array([own[i].tolist() for own in held.values()], pa.list_(pa.float64())) for i in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *lists], names=["class", "n", "mean", "square"])


def merged(one: list[np.ndarray], other: list[np.ndarray]) -> list[np.ndarray]:
    """Count, mean and squares about the mean of both."""
    (n, a, q), (m, b, r) = one, other
    whole = np.maximum(n + m, 1)
    return [n + m, np.where(n == 0, b, np.where(m == 0, a, a + (b - a) * (m / whole))), q + r + np.where((n > 0) & (m > 0), (b - a) ** 2 * (n * m / whole), 0.0)]


def _merged_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partial moments of a class, sorted by class, to (class, i, n, mean, square), a row for each feature."""

    def told(name: str, own: list[np.ndarray]) -> pa.RecordBatch:
        size = len(own[0])
        return pa.RecordBatch.from_arrays([pa.array([name] * size), pa.array(np.arange(size, dtype=np.int32)), *map(pa.array, own)], names=["class", "i", "n", "mean", "square"])

    key, total = None, None
    for b in batches:
        for name, *own in zip(*(c.to_pylist() for c in b.columns)):
            own = [np.array(x, float) for x in own]
            if name != key:
                if key is not None:
                    yield told(key, total)
                key, total = name, own
            else:
                total = merged(total, own)
    if key is not None:
        yield told(key, total)


def class_moments(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(class, i, n, mean, square): count, mean and squares about it of each feature (by position) and class, in one pass; classes must be few."""
    rows = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("class"), *[F.col(f).cast("double").alias(f"c{i}") for i, f in enumerate(features)])
    parts = rows.mapInArrow(_by_class, "class string, n array<double>, mean array<double>, square array<double>")
    return parts.repartition("class").sortWithinPartitions("class").mapInArrow(_merged_classes, "class string, i int, n double, mean double, square double")
