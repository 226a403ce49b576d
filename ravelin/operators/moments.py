"""Sufficient statistics: all that linear solvers need, in one distributed pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.runtime import added, ready


@dataclass
class Moments:
    """n, sums and the cross products of columns, about ``shift``. The last column may be an outcome."""

    n: float
    sums: np.ndarray
    cross: np.ndarray
    shift: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.sums + other.sums, self.cross + other.cross, self.shift)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.sums - other.sums, self.cross - other.cross, self.shift)

    @property
    def mean(self) -> np.ndarray:
        return self.shift + self.sums / max(self.n, 1)

    @property
    def covariance(self) -> np.ndarray:
        """Centred cross products over n."""
        m = self.sums / max(self.n, 1)
        return self.cross / max(self.n, 1) - np.outer(m, m)

    @property
    def raw(self) -> np.ndarray:
        """Uncentred cross products over n."""
        return self.covariance + np.outer(self.mean, self.mean)

    def correlations(self) -> np.ndarray:
        c = self.covariance
        s = np.sqrt(np.clip(np.diag(c), 0, None))
        s[s <= 1e-12 * np.maximum(1, np.abs(self.mean))] = np.nan
        return c / np.outer(s, s)

    def picked(self, columns: list[int] | np.ndarray) -> Moments:
        """Moments of some of the columns, in the given order."""
        at = np.asarray(columns, int)
        return Moments(self.n, self.sums[at], self.cross[np.ix_(at, at)], self.shift[at])

    def mapped(self, w: np.ndarray) -> Moments:
        """Moments of columns multiplied by w (new = w old)."""
        return Moments(self.n, w @ self.sums, w @ self.cross @ w.T, w @ self.shift)


def moment_rows(table: DataFrame, columns: list[str], fold: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """(fold, i, row): row i of each fold's matrix of products of ``columns`` and 1, about the returned shift.

    Rows with a null in any column are left out. Columns are shifted by their mean first, so that products keep their digits. A
    task sends a matrix for each fold it has seen; they add up in Spark.
    """
    ready(table.sparkSession)
    own = table.select(*(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)), (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold")).na.drop()
    names = own.columns[:-1]
    means = own.agg(*(F.avg(c) for c in names)).first()
    shift, d = np.array([m or 0.0 for m in means]), len(columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[:-1]]) - shift
            x = np.column_stack([x, np.ones(len(x))])
            f = b.column(d).to_numpy()
            for k in np.unique(f):
                own_ = x[f == k]
                sums[k] = sums.get(k, 0) + own_.T @ own_
        rows = [(int(k), i, m[i].tobytes()) for k, m in sums.items() for i in range(d + 1)]
        if rows:
            fold_, i, data = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(fold_, pa.int32()), pa.array(i, pa.int32()), pa.array(data, pa.binary())], names=["fold", "i", "row"])

    return added(own.mapInArrow(partial, "fold int, i int, row binary"), ["fold", "i"], "row"), shift


def gathered(rows: list[tuple[int, int, bytes]], shift: np.ndarray) -> dict[int, Moments]:
    """Moments by fold from (fold, i, row)."""
    got: dict[int, np.ndarray] = {}
    d = len(shift)
    for fold, i, row in rows:
        got.setdefault(int(fold), np.zeros((d + 1, d + 1)))[i] = np.frombuffer(row)
    return {k: Moments(m[d, d], m[d, :d], m[:d, :d], shift) for k, m in sorted(got.items())}


def fold_moments(table: DataFrame, columns: list[str], fold: str | None = None) -> dict[int, Moments]:
    """Moments of ``columns`` for each fold; the driver gets as many rows as there are columns and folds."""
    rows, shift = moment_rows(table, columns, fold)
    return gathered([tuple(r) for r in rows.collect()], shift)


def gram(table: DataFrame, columns: list[str]) -> Moments:
    d = len(columns)
    return fold_moments(table, columns).get(0, Moments(0, np.zeros(d), np.zeros((d, d)), np.zeros(d)))


def fold_set_moments(table: DataFrame, columns: list[str], folds: list[Column]) -> list[dict[int, Moments]]:
    """Moments by fold for each of several ways to deal the rows over folds, from one pass over the rows.

    A task adds up a matrix for each fold of each way; rows are not copied. Rows with a null in any column have no part.
    """
    ready(table.sparkSession)
    d = len(columns)
    own = table.select(*(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)), F.array(*(f.cast("int") for f in folds)).alias("folds")).na.drop()
    means = own.agg(*(F.avg(c) for c in own.columns[:-1])).first()
    shift = np.array([m or 0.0 for m in means])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([*(c.to_numpy(zero_copy_only=False) for c in b.columns[:-1]), np.ones(b.num_rows)]) - np.append(shift, 0)
            at = b.column(d).flatten().to_numpy().reshape(b.num_rows, -1)
            for way in range(at.shape[1]):
                order = np.argsort(at[:, way], kind="stable")
                edge = np.append(np.flatnonzero(np.diff(at[order, way], prepend=at[order[0], way] - 1)), len(order))
                for s, e in zip(edge[:-1], edge[1:]):
                    part = x[order[s:e]]
                    key = way, int(at[order[s], way])
                    sums[key] = sums.get(key, 0) + part.T @ part
        rows = [(w, k, i, m[i].tobytes()) for (w, k), m in sums.items() for i in range(d + 1)]
        if rows:
            way, fold, i, data = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(way, pa.int32()), pa.array(fold, pa.int32()), pa.array(i, pa.int32()), pa.array(data, pa.binary())], names=["way", "fold", "i", "row"])

    rows = added(own.mapInArrow(partial, "way int, fold int, i int, row binary"), ["way", "fold", "i"], "row").collect()
    by: dict[int, list] = {w: [] for w in range(len(folds))}
    for r in rows:
        by[r.way].append((r.fold, r.i, r.row))
    return [gathered(by[w], shift) for w in range(len(folds))]
