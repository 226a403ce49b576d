"""Nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, shifted and put in Hilbert order, several times. Spark range-partitions each
order, so that a vector has a rank on each curve; a query looks at the ranks around its own in blocks, candidates of all
blocks and curves merge, and the best are measured again on the original vectors.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.common import cut, ready
from ravelin.llm.vectors import matrix, usable


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of grid coordinates (rows x dimensions, ``bits`` bits each, 63 at most in all).

    The transform of Skilling (2004): undo the rotations from the top bit down, then Gray-decode across the dimensions.
    """
    x, dims, one = cells.astype(np.uint64).T.copy(), cells.shape[1], np.uint64(1)
    for level in range(bits - 1, 0, -1):
        low = np.uint64((1 << level) - 1)
        for d in range(dims):
            high = (x[d] >> np.uint64(level)) & one == one
            swap = np.where(high, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(high, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(level)) & one == one, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << one) | ((x[d] >> np.uint64(level)) & one)
    return key.astype(np.int64)


def nearest_in_block(data: pd.DataFrame, queries: pd.DataFrame, keep: int, stored: str) -> pd.DataFrame:
    """The ``keep`` nearest rows of a block to each query whose window covers them, and all that are as near as the last of them."""
    none = pd.DataFrame({"query": [], "point": [], "near": []}).astype({"query": np.int64, "point": np.int64, "near": float})
    if not len(data) or not len(queries):
        return none
    data = data.sort_values("rank")
    x, q = (np.stack([np.frombuffer(c, stored) for c in d.code]).astype(np.float64) for d in (data, queries))
    rank, point, size = data["rank"].to_numpy(), data.point.to_numpy(), (x * x).sum(1)
    out = [none]
    step = max(1, 2_000_000 // len(x))
    for s in range(0, len(q), step):
        part, own_size = queries.iloc[s : s + step], (q[s : s + step] ** 2).sum(1)[:, None]
        d = np.maximum(size - 2 * (q[s : s + step] @ x.T) + own_size, 0)
        lo, hi, own = (part[c].to_numpy()[:, None] for c in ("lo", "hi", "query"))
        d[(rank < lo) | (rank > hi) | (point == own)] = np.inf
        k = min(keep, len(x))
        last = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        # Rounding is far below this share of the terms; the exact distances come last.
        row, col = np.nonzero((d <= last + 1e-9 * (own_size + size)) & np.isfinite(d))
        out.append(pd.DataFrame({"query": part["query"].to_numpy()[row], "point": point[col], "near": d[row, col]}))
    return pd.concat(out)


def search(df: DataFrame, k: int = 10, query_every: int = 100, curves: int = 24, share: float = 0.015, least_window: int = 256, dims: int = 8, bits: int = 7, block: int = 4_096, sample_size: int = 16_384, seed: int = 3, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``query_every``, the ``k`` nearest other rows found.

    ``score`` is the Euclidean distance of the original vectors in double precision; ties go to the smaller id. Vectors that are
    null, zero, hold null or non-finite components, or differ in length from most take no part, nor do null ids. Copies of a vector
    are one point of the curves and answer with their smallest ids, so their number costs nothing; an id given twice is two
    candidates, and a query's rows of its own id are left out. Fewer candidates than ``k`` give them all.

    An empty table, or one without usable vectors, gives no rows; other columns, whatever their names, are left out. Coordinates of the curves'
    grid lie between outer quantiles of a bounded sample (``sample_size`` points of least hash); what lies beyond is put at the edge, so
    single far rows do not coarsen it. Blocks measure the vectors themselves and keep all that are as near as the last one wanted.

    A query sees ``share`` of all ranks (``least_window`` at least) on each side on each curve. Vectors without structure need a window
    in proportion to the table for a given recall; for clustered ones a smaller share will do.
    """
    spark = ready(df.sparkSession)
    rows = df.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("vector"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    good = rows.where(F.col("vec_id").isNotNull() & usable(rows, "vector"))
    asks = F.col("vec_id") % query_every == 0
    stored = "<f4" if rows.schema["vector"].dataType.elementType.typeName() == "float" else "<f8"
    points = cut(good.groupBy("vector").agg(F.min("vec_id").cast("long").alias("point"), F.max(asks).alias("asks")))
    n = points.count()
    if not n:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    copies = good.withColumn("at", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    copies = copies.groupBy("vector").agg(F.collect_list("vec_id").alias("ids"))
    size = matrix(points.select("vector").limit(1).toArrow().column("vector")).shape[1]
    rng = np.random.default_rng(seed)
    dims = min(dims, size)
    ways = [np.linalg.qr(rng.standard_normal((size, dims)))[0] for _ in range(curves)]
    sample = matrix(points.select("vector").orderBy(F.xxhash64("vector")).limit(sample_size).toArrow().column("vector"))
    lo, hi = np.quantile(np.stack([sample @ way for way in ways]), [0.003, 0.997], axis=1)
    shift = rng.uniform(0, 0.25, (curves, dims))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("vector"))
            code = pa.array([v.tobytes() for v in x.astype(stored)], pa.binary())
            for c, way in enumerate(ways):
                cells = ((x @ way - lo[c]) / np.maximum(hi[c] - lo[c], 1e-300) / 1.25 + shift[c] / 1.25) * (1 << bits)
                keys = hilbert_keys(np.clip(cells, 0, (1 << bits) - 1).astype(np.int64), bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(keys), b.column("point"), b.column("asks"), code], names=["curve", "key", "point", "asks", "code"])

    keyed = points.select("vector", "point", "asks").mapInArrow(order, "curve int, key long, point long, asks boolean, code binary")
    laid = cut(keyed.repartitionByRange("curve", "key", "point").sortWithinPartitions("curve", "key", "point"))
    counts = {r.part: r.n for r in laid.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()}
    before = dict(zip(sorted(counts), itertools.accumulate((counts[p] for p in sorted(counts)), initial=0)))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = before.get(TaskContext.get().partitionId(), 0)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + b.num_rows)), b.column("point"), b.column("asks"), b.column("code")], names=["rank", "point", "asks", "code"])
            at += b.num_rows

    # Curves follow each other in one row of ranks: curve c has the ranks from c n on.
    ranked = laid.select("point", "asks", "code").mapInArrow(number, "rank long, point long, asks boolean, code binary")
    window, keep = max(least_window, int(np.ceil(share * n))), k + 1
    base = F.floor(F.col("rank") / n) * n
    asked = ranked.where("asks").select(F.col("point").alias("query"), "code", F.greatest(F.col("rank") - window, base).alias("lo"), F.least(F.col("rank") + window, base + n - 1).alias("hi"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))))
    # As many parts of a block's queries as keep each to some thousands, whatever the table.
    parts = max(1, -(-2 * window // query_every // 4_096))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)))
    blocks = ranked.select(F.floor(F.col("rank") / block).alias("block"), "rank", "point", "code", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    seen = blocks.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(lambda d, q: nearest_in_block(d, q, keep, stored), "query long, point long, near double")
    pairs = seen.groupBy("query", "point").agg(F.min("near").alias("near"))
    pairs = pairs.withColumn("at", F.rank().over(Window.partitionBy("query").orderBy("near"))).where(F.col("at") <= keep)
    pairs = cut(pairs.select("query", "point"))

    vectors = points.select("point", "vector").join(copies, "vector")
    own = vectors.join(points.where("asks").select("point"), "point", "left_semi")
    at = own.select(F.col("point").alias("query"), F.col("vector").alias("q"))
    square = lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))
    far = F.sqrt(F.aggregate(F.zip_with("q", "vector", square), F.lit(0.0), lambda s, v: s + v))
    found = pairs.join(at, "query").join(vectors, "point").select("query", far.alias("score"), F.explode("ids").alias("vec_id"))
    found = found.union(own.select("point", F.lit(0.0), F.explode("ids")))
    best = found.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("at") <= k + 1)
    best = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("best"))
    answers = best.join(own.select(F.col("point").alias("query"), "vector"), "query").select("vector", "best")
    queries = good.where(asks).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    ranks = queries.join(answers, "vector").select("query_id", F.slice(F.filter("best", lambda b: b.vec_id != F.col("query_id")), 1, k).alias("best"))
    return ranks.select("query_id", F.posexplode("best")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))
