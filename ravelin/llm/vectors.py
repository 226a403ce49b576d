"""Usable vectors and exact copies, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, column: str) -> Column:
    """Whether a row's vector is not null or zero, holds no null or non-finite component, and has the commonest length."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(column)
    good = F.coalesce(~F.exists(v, odd) & F.exists(v, lambda x: x != 0), F.lit(False))
    size = df.where(good).groupBy(F.size(v).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    return good & (F.size(v) == F.lit(size["size"] if size else -1))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of doubles; all lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
