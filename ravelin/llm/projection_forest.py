"""Embedding near-duplicates by a forest of random-projection trees with spill.

Exact copies are one point. Each tree halves a bounded sample at medians of random projections, node by node; below the nodes that
the sample can resolve it goes on with directions that a level's nodes share and the medians of the last such node, so trees grow as
deep as the table asks. A point near a threshold spills into both halves. Points of one label and leaf are compared in double
precision, a pair only in the first leaf that both ends share, so that links can be counted without listing pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import cut, ready
from ravelin.llm.components import Forest, components
from ravelin.llm.vectors import matrix, usable

#: Least sample of a node that is split by a direction of its own, and levels that directions are kept for.
RESOLVED, LEVELS = 64, 48


class Tree:
    """Directions and thresholds of one tree; nodes in heap order, the root is 1."""

    def __init__(self, sample: np.ndarray, spill: float, seed: tuple[int, ...]):
        rng = np.random.default_rng(seed)
        self.spill, size = spill, sample.shape[1]
        unit = lambda n: (w := rng.standard_normal((n, size))) / np.linalg.norm(w, axis=1)[:, None]
        self.shared = unit(LEVELS)  # directions of all nodes of a level, below those with their own
        self.own: dict[int, tuple[np.ndarray, float]] = {}
        self.rest: dict[int, np.ndarray] = {}  # by last resolved node: thresholds of the levels below it
        todo = [(1, np.arange(len(sample)))]
        while todo:
            node, at = todo.pop()
            way = unit(1)[0]
            p = sample[at] @ way
            t = float(np.median(p))
            low, high = at[p <= t], at[p > t]
            if len(at) >= RESOLVED and min(len(low), len(high)) >= len(at) / 5:  # copies of few vectors part badly
                self.own[node] = (way, t)
                todo += [(2 * node, low), (2 * node + 1, high)]
            else:
                self.rest[node] = np.median(sample[at] @ self.shared.T, axis=0)

    def leaves(self, x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for all leaves of a depth that rows fall in."""
        todo, rows, names = [(1, 0, np.arange(len(x)))], [], []
        while todo:
            node, level, at = todo.pop()
            if not len(at):
                continue
            if level < depth and node in self.own:
                way, t = self.own[node]
                p = x[at] @ way
                todo += [(2 * node, level + 1, at[p <= t + self.spill]), (2 * node + 1, level + 1, at[p > t - self.spill])]
                continue
            name = np.full(len(at), node)
            if level < depth:
                p, t = x @ self.shared[level:depth].T if len(at) == len(x) else x[at] @ self.shared[level:depth].T, self.rest[node][level:depth]
                of = np.arange(len(at))
                for k in range(depth - level):
                    q = p[of, k]
                    low, high = q <= t[k] + self.spill, q > t[k] - self.spill
                    of, name = np.concatenate([of[low], of[high]]), np.concatenate([2 * name[low], 2 * name[high] + 1])
                at = at[of]
            rows.append(at)
            names.append(name)
        return np.concatenate(rows), np.concatenate(names)


def compare(cell: pa.Table, threshold: float) -> pa.Table:
    """Links inside one leaf: by point, the weight of its partners; and a spanning forest.

    A cell holds one block of the leaf (b0 = b1) or two; ``side`` tells them apart. ``before`` holds a point's leaves of smaller
    number: a pair that shares one of them is counted there.
    """
    x = matrix(cell["vector"])
    x /= np.linalg.norm(x, axis=1)[:, None]
    point, weight, n = cell["point"].to_numpy(), cell["weight"].to_numpy(), len(cell)
    one = cell["b0"][0] == cell["b1"][0]
    rows = np.arange(n) if one else np.flatnonzero(cell["side"].to_numpy() == 0)
    cols = rows if one else np.flatnonzero(cell["side"].to_numpy() == 1)
    lists = cell["before"].combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    before = np.full((n, max(1, sizes.max())), -1, np.int64)
    before[np.arange(before.shape[1])[None] < sizes[:, None]] = lists.flatten().to_numpy()
    links, forest = np.zeros(n, np.int64), Forest(n)
    step = max(1, 500_000 // max(1, len(cols)))
    for s in range(0, len(rows), step):
        own = rows[s : s + step]
        i, j = np.nonzero(x[own] @ x[cols].T >= threshold)
        i, j = own[i], cols[j]
        i, j = (i[i < j], j[i < j]) if one else (i, j)
        new = np.ones(len(i), bool)
        for c in range(before.shape[1] if len(i) else 0):
            v = before[i, c]
            new &= (v < 0) | (before[j] != v[:, None]).all(axis=1)
        i, j = i[new], j[new]
        links += np.bincount(i, weights=weight[j], minlength=n).astype(np.int64)
        links += np.bincount(j, weights=weight[i], minlength=n).astype(np.int64)
        forest.join(i, j)
    some = links > 0
    return pa.table({"point": point[some], "links": links[some], "root": point[forest.label[some]]})


def near_duplicates(df: DataFrame, threshold: float = 0.93, trees: int = 8, leaf: int = 128, spill: float = 0.015, sample_size: int = 16_384, block: int = 4_096, seed: int = 11, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Rows link if their labels are equal and not null and the cosine is at least ``threshold`` and the forest brings them into one
    leaf. Vectors that are null, zero, hold null or non-finite components, or differ in length from most, link with nothing: they stand
    alone with no links, as do rows without a label. Exact copies always link. Repeated rows of one id count as vectors each, and an id with
    several vectors is one point; a row with a null id stands alone. Components are named by the smallest id, so ties have no say; an
    empty table gives no rows; other columns, whatever their names, are left out.

    The trees are fitted on at most ``sample_size`` points of least hash; every point is put in leaves, as deep as its label's points
    need for leaves of about ``leaf``. A leaf of more than ``block`` points is compared block by block in several tasks.
    """
    spark = ready(df.sparkSession)
    rows = df.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("vector"), F.col(label_column).alias("label"))
    takes_part = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(rows, "vector")
    good, rest = rows.where(takes_part), rows.where(~takes_part)
    alone = lambda d: d.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    points = cut(good.groupBy("label", "vector").agg(F.min("vec_id").alias("point"), F.count("*").alias("weight")))
    taken = points.select("vector").orderBy(F.xxhash64("vector", "label")).limit(sample_size).toArrow()
    out = alone(rest)
    if taken.num_rows:
        sample = matrix(taken.column("vector"))
        sample /= np.linalg.norm(sample, axis=1)[:, None]
        forest = spark.sparkContext.broadcast([Tree(sample, spill, (seed, k)) for k in range(trees)])
        # A level leaves a node somewhat more than half of its points, those that spill included.
        levels = F.least(F.greatest(F.ceil(F.log(F.count("*") / leaf) / float(np.log(1.8))), F.lit(0)), F.lit(LEVELS)).cast("int")
        sized = points.join(points.groupBy("label").agg(levels.alias("depth")), "label")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x, depths = matrix(b.column("vector")), b.column("depth").to_numpy()
                x /= np.linalg.norm(x, axis=1)[:, None]
                row, name = [], []
                for d in np.unique(depths):
                    at = np.flatnonzero(depths == d)
                    for k, tree in enumerate(forest.value):
                        r, leaves = tree.leaves(x[at], int(d))
                        row.append(at[r])
                        name.append(leaves * trees + k)
                row, name = np.concatenate(row), np.concatenate(name)
                order = np.lexsort((name, row))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(name[order], pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("label"), b.column("vector"), b.column("point"), b.column("weight"), lists], names=["label", "vector", "point", "weight", "leaves"])

        types = {f.name: f.dataType.simpleString() for f in points.schema}
        placed = sized.select("label", "vector", "point", "weight", "depth").mapInArrow(place, ", ".join(f"{c} {types[c]}" for c in ("label", "vector", "point", "weight")) + ", leaves array<long>")
        visits = placed.select("label", "vector", "point", "weight", "leaves", F.posexplode("leaves").alias("k", "leaf")).withColumn("before", F.slice("leaves", F.lit(1), F.col("k"))).drop("leaves", "k")
        big = visits.groupBy("label", "leaf").agg(F.count("*").alias("size")).where(f"size > {block}").select("label", "leaf", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
        dealt = visits.join(big, ["label", "leaf"], "left").fillna(1, ["blocks"]).withColumn("mine", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        cells = dealt.withColumn("other", other).select("label", "leaf", F.least("mine", "other").alias("b0"), F.greatest("mine", "other").alias("b1"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "point", "weight", "vector", "before")
        found = cut(cells.groupBy("label", "leaf", "b0", "b1").applyInArrow(lambda c: compare(c, threshold), "point long, links long, root long"))
        links = found.groupBy("point").agg(F.sum("links").alias("links"))
        joined = components(found.select(F.col("point").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "point")
        named = points.join(links, "point", "left").join(joined, "point", "left").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "point").cast(rows.schema["vec_id"].dataType).alias("component_id"))
        out = out.union(good.join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
