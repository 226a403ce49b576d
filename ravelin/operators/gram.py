"""Products of very many columns, block by block: what is kept, summed and shuffled is a block of columns times a block, never the whole matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.runtime import added, ready, written

#: Bytes of rows that a task multiplies at a time.
PART = 32 << 20


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of an array column; what is null or not a number is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def _rows(vectors: DataFrame, column: str, d: int) -> DataFrame:
    return vectors.select(F.col(column).cast("array<double>").alias("v")).where(F.size("v") == d)


def column_means(vectors: DataFrame, d: int, column: str = "v", complete: bool = True) -> tuple[float, np.ndarray]:
    """Rows and means of the columns of an array, over complete rows or each over the rows that have it. As long as a row."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * d + 1)
        for b in batches:
            x = _matrix(b.column(0), d)
            there = np.isfinite(x)
            if complete:
                x, there = x[there.all(1)], there[there.all(1)]
            total += np.concatenate([np.where(there, x, 0).sum(0), there.sum(0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "v"])

    got = added(_rows(vectors, column, d).mapInArrow(partial, "k int, v binary"), ["k"], "v").collect()
    total = np.frombuffer(got[0].v) if got else np.zeros(2 * d + 1)
    return float(total[-1]), total[:d] / np.maximum(total[d : 2 * d], 1)


def block_products(vectors: DataFrame, d: int, column: str = "v", block: int = 256, pairwise: bool = False) -> tuple[DataFrame, np.ndarray, float]:
    """(a, b, part) for blocks a <= b of an array's columns, the columns' means, about which products are taken, and the number of rows.

    ``part`` holds doubles: the products of the two blocks over complete rows; or, ``pairwise``, six matrices over the rows that have both columns of
    a pair: their number, the sums of either, the squares of either and the products.
    """
    ready(vectors.sparkSession)
    n, mean = column_means(vectors, d, column, complete=not pairwise)
    edges = [(k, min(k + block, d)) for k in range(0, d, block)]
    each = max(PART // (8 * max(d, 1)), 1024)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, each):
                x = _matrix(batch.column(0).slice(lo, each), d) - mean
                there = np.isfinite(x)
                if not pairwise:
                    x = x[there.all(1)]
                else:
                    x = np.where(there, x, 0.0)
                    there = there.astype(float)
                if not len(x):
                    continue
                for a, (s, e) in enumerate(edges):
                    for b, (t, u) in enumerate(edges[a:], a):
                        p, q = x[:, s:e], x[:, t:u]
                        if pairwise:
                            m, o = there[:, s:e], there[:, t:u]
                            out = np.stack([m.T @ o, p.T @ o, m.T @ q, (p * p).T @ o, m.T @ (q * q), p.T @ q])
                        else:
                            out = p.T @ q
                        yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["a", "b", "part"])

    return added(_rows(vectors, column, d).mapInArrow(multiply, "a int, b int, part binary"), ["a", "b"], "part"), mean, n


def wide_correlations(vectors: DataFrame, names: list[str], column: str = "v", block: int = 256, pairwise: bool = False) -> DataFrame:
    """(i, j, f1, f2, r) for i < j of the columns of an array; r is null where a column is constant (or shares no two rows).

    Rows with a missing value (null, NaN, infinite) are left out, or with ``pairwise`` only from the pairs that miss it. Rows of another length have no part. The
    result is a table: nothing as large as the matrix is on the driver or in one task.
    """
    d = len(names)
    spark = ready(vectors.sparkSession)
    blocks, mean, rows = block_products(vectors, d, column, block, pairwise)
    blocks = written(blocks)
    if not pairwise:
        # Variances stand on the diagonals of the diagonal blocks: as many numbers as columns.
        diagonal = {r.a: np.diag(np.frombuffer(r.part).reshape(min(block, d - r.a * block), -1)) for r in blocks.where("a = b").toLocalIterator()}
        variance = np.concatenate([diagonal.get(a, np.zeros(min(block, d - a * block))) for a in range(-(-d // block))]) if d else np.zeros(0)
    else:
        variance = np.zeros(d)
    tiny = 1e-12 * np.maximum(1, np.abs(mean))
    held = spark.sparkContext.broadcast((variance, tiny, names))

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        var, least, called = held.value
        for batch in batches:
            for a, b, part in zip(*(c.to_pylist() for c in batch.columns)):
                s, t = a * block, b * block
                e, u = min(s + block, d), min(t + block, d)
                with np.errstate(divide="ignore", invalid="ignore"):
                    if pairwise:
                        n, sx, sy, xx, yy, xy = np.frombuffer(part).reshape(6, e - s, u - t)
                        vx, vy = np.clip(xx - sx * sx / n, 0, None), np.clip(yy - sy * sy / n, 0, None)
                        r, ok = (xy - sx * sy / n) / np.sqrt(vx * vy), (np.sqrt(vx / n) > least[s:e, None]) & (np.sqrt(vy / n) > least[None, t:u])
                    else:
                        r = np.frombuffer(part).reshape(e - s, u - t) / np.sqrt(np.outer(var[s:e], var[t:u]))
                        dev = np.sqrt(var / max(rows, 1))
                        ok = (dev[s:e, None] > least[s:e, None]) & (dev[None, t:u] > least[None, t:u])
                i, j = np.nonzero(np.arange(s, e)[:, None] < np.arange(t, u)[None])
                value = np.where(ok & np.isfinite(r), np.clip(r, -1, 1), np.nan)[i, j]
                i, j = i + s, j + t
                names_ = pa.array(called, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), names_.take(pa.array(i)), names_.take(pa.array(j)), pa.array(value, from_pandas=True)], names=["i", "j", "f1", "f2", "r"])

    return blocks.mapInArrow(divide, "i int, j int, f1 string, f2 string, r double")
