"""Connected components by alternating stars, wholly distributed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import cut


def components(edges: DataFrame, rounds: int = 60, block: int = 0) -> DataFrame:
    """(id, component): the smallest id that each end of an edge (a, b) can reach.

    Each round hangs every node's larger neighbours, then its smaller ones, on the least node it knows, until nothing
    changes. Hubs cost no more than their edges: minima are pre-aggregated and joins on a hub can be split. Edges with a null
    end and loops are ignored; repeated edges count once. Each round is written to the checkpoint folder.

    With ``block``, edges of long ids are first joined in tasks of some ``block`` edges each, as many tasks as that takes: a round has some
    ten stages, which cost more than a few edges do. One such task needs no rounds, more leave them a star a component each. Edges are
    then read twice, and by these tasks, so they should be written.
    """
    if block:
        edges = edges.where("a <> b").select("a", "b")
        tasks = max(1, math.ceil(edges.count() / block))
        joined = edges.coalesce(tasks).mapInArrow(stars(block), "id long, component long")
        if tasks == 1:
            return joined
        edges = joined.toDF("a", "b")
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    was = None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was or not now[0]:
            break
        was = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))


def stars(block: int):
    """For mapInArrow: every node of each ``block`` edges with the least node that they join it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, block):
                part = b.slice(lo, block)
                if held + part.num_rows > block:
                    yield star(rows)
                    rows, held = [], 0
                rows.append(part)
                held += part.num_rows
        if held:
            yield star(rows)

    def star(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([b.column(k).to_numpy() for k in (0, 1) for b in rows]), return_inverse=True)
        forest = Forest(len(nodes))
        forest.join(*np.split(at, 2))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[forest.label])], names=["id", "component"])

    return run


class Forest:
    """Components of n nodes inside one task, joined a batch of pairs at a time."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(self.label, high, low)
            while (self.label != (up := self.label[self.label])).any():
                self.label = up
