"""Gaussian mixtures with full covariances, by expectation-maximization over moments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.runtime import added, ready, written


def _log_parts(x: np.ndarray, w: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    out = []
    for k in range(len(w)):
        low = np.linalg.cholesky(cov[k])
        z = np.linalg.solve(low, (x - mean[k]).T)
        out.append(np.log(w[k]) - 0.5 * (z * z).sum(0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi))
    return np.stack(out, 1)


def _shares(x, w, mean, cov) -> tuple[np.ndarray, float]:
    parts = _log_parts(x, w, mean, cov)
    top = parts.max(1)[:, None]
    whole = top[:, 0] + np.log(np.exp(parts - top).sum(1))
    return np.exp(parts - whole[:, None]), float(whole.sum())


def _nearest(x: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance to, and number of, the nearest of some points; a few thousand rows at a time."""
    best, who = np.full(len(x), np.inf), np.zeros(len(x), int)
    for lo in range(0, len(x), 4096):
        far = ((x[lo : lo + 4096, None] - points[None]) ** 2).sum(-1)
        who[lo : lo + 4096] = far.argmin(1)
        best[lo : lo + 4096] = far.min(1)
    return best, who


def _candidates(own: DataFrame, shift: np.ndarray, spread: np.ndarray, passes: int, drawn: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Standardized rows drawn in passes, each by its squared distance to those of the passes before, and how many rows are nearest to each.

    A row's turn is an exponential variable over its weight, by a hash of the row: the least ``drawn`` turns are a draw without replacement, the same for any partitions.
    """
    spark, names = own.sparkSession, own.columns
    chance = own.select(*names, (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *names), 11).cast("double") * F.lit(2.0**-53)).alias("u"))
    first = chance.orderBy("u", *names).limit(1).toPandas()[names].to_numpy()
    points = (first - shift) / spread
    for turn in range(passes):
        held = spark.sparkContext.broadcast(points)

        def turns(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[:-1]])
                    far = _nearest((x - shift) / spread, held.value)[0]
                    wait = np.where(far > 0, -np.log1p(-b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)) / np.where(far > 0, far, 1), np.inf)
                    some = np.argsort(wait, kind="stable")[: 20 * drawn]  # copies of a row have one turn
                    some = some[np.isfinite(wait[some])]
                    _, alone = np.unique(x[some], axis=0, return_index=True)
                    some = np.sort(some[alone])
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[some, i]) for i in range(x.shape[1])), pa.array(wait[some])], names=[*names, "wait"])

        again = own.select(*names, (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1 + turn), *names), 11).cast("double") * F.lit(2.0**-53)).alias("u"))
        kind = ", ".join(f"{c} double" for c in [*names, "wait"])
        got = again.mapInArrow(turns, kind).groupBy(*names).agg(F.min("wait").alias("wait")).orderBy("wait", *names).limit(drawn).toPandas()
        if not len(got):
            break
        points = np.vstack([points, (got[names].to_numpy() - shift) / spread])
    held = spark.sparkContext.broadcast(points)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value))
        for b in batches:
            if b.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
                total += np.bincount(_nearest((x - shift) / spread, held.value)[1], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "v"])

    weight = np.frombuffer(added(own.mapInArrow(count, "k int, v binary"), ["k"], "v").first().v)
    return points[weight > 0], weight[weight > 0]


def _start(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and round covariances of a clustering of weighted points: spread-out seeds, then a few rounds of means."""
    centers = points[[rng.choice(len(points), p=weight / weight.sum())]]
    while len(centers) < k:
        far = weight * _nearest(points, centers)[0]
        if not far.sum() > 0:
            break
        centers = np.vstack([centers, points[rng.choice(len(points), p=far / far.sum())]])
    for _ in range(20):
        own = _nearest(points, centers)[1]
        centers = np.stack([np.average(points[own == c], axis=0, weights=weight[own == c]) if (own == c).any() else centers[c] for c in range(len(centers))])
    far, own = _nearest(points, centers)
    share = np.maximum(np.bincount(own, weights=weight, minlength=len(centers)), 1e-10)
    d = points.shape[1]
    round_ = max(float((weight * far).sum() / weight.sum() / d), 1e-3) + ridge
    return share / share.sum(), centers, np.stack([np.eye(d) * round_] * len(centers))


def fit(table: DataFrame, features: list[str], k: int = 2, restarts: int = 10, rounds: int = 1_000, tol: float = 1e-3, ridge: float = 1e-6, seed: int = 42, passes: int = 5, drawn: int = 40) -> dict:
    """Weights, means and covariances (components by rising first mean), the mean log-likelihood and whether it settled.

    Every round is one pass over all rows that gathers the weighted moments of all restarts at once. Starts come from a few passes that draw ``drawn`` rows each, with
    weights of their squared distance to the rows drawn before, and count how many rows are nearest to each: so a small cluster far from the others
    is met. Rows with a null have no part. There are as many components as different rows where those are fewer than ``k``, and none for an empty table.
    """
    spark = ready(table.sparkSession)
    own = written(table.select(*(F.col(f).cast("double").alias(f"c{i}") for i, f in enumerate(features))).na.drop())  # read again in each round
    scale = own.agg(F.count("*"), *(F.avg(c) for c in own.columns), *(F.stddev_pop(c) for c in own.columns)).first()
    d, n = len(features), scale[0]
    tasks = own.rdd.getNumPartitions()  # of a written table: its files, read without a shuffle
    if not n:
        return {"weights": np.zeros(0), "means": np.zeros((0, d)), "covariances": np.zeros((0, d, d)), "log_likelihood": float("nan"), "converged": True, "features": features}
    shift, spread = np.array(scale[1 : d + 1], float), np.maximum(np.array(scale[d + 1 :], float), 1e-12)
    points, weight = _candidates(own, shift, spread, passes, max(drawn, 4 * k), seed)
    k = min(k, len(points))
    rng = np.random.default_rng(seed)
    models = [_start(points, weight, k, rng, ridge) for _ in range(restarts)]
    logs, live, settled = np.full(restarts, -np.inf), set(range(restarts)), np.zeros(restarts, bool)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast([(r, models[r]) for r in sorted(live)])

        def moments(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                if b.num_rows:
                    x = (np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) - shift) / spread
                    one = np.column_stack([x, np.ones(len(x))])
                    for r, m in held.value:
                        share, whole = _shares(x, *m)
                        for c in range(k):
                            cross = one.T @ (one * share[:, c : c + 1])
                            total[r, c] = total.get((r, c), 0) + np.append(cross.ravel(), whole if c == 0 else 0.0)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in total], pa.int32()), pa.array([c for _, c in total], pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["r", "c", "v"])

        got = {(x.r, x.c): np.frombuffer(x.v) for x in added(own.mapInArrow(moments, "r int, c int, v binary"), ["r", "c"], "v", tasks).collect()}
        for r in sorted(live):
            crosses = [got[r, c][:-1].reshape(d + 1, d + 1) for c in range(k)]
            weight = np.maximum([x[d, d] for x in crosses], 1e-10)
            mean = np.stack([x[d, :d] / w for x, w in zip(crosses, weight)])
            cov = np.stack([x[:d, :d] / w - np.outer(m, m) + ridge * np.eye(d) for x, w, m in zip(crosses, weight, mean)])
            models[r], was, logs[r] = (weight / n, mean, cov), logs[r], got[r, 0][-1] / n
            if abs(logs[r] - was) < tol:
                settled[r] = True
        live = {r for r in live if not settled[r]}
        if not live:
            break
    best = int(np.argmax(logs))
    w, mean, cov = models[best]
    order = np.argsort(mean[:, 0], kind="stable")
    return {"weights": w[order], "means": mean[order] * spread + shift, "covariances": cov[order] * np.outer(spread, spread), "log_likelihood": float(logs[best] - np.log(spread).sum()), "converged": bool(settled[best]), "features": features}


def label(table: DataFrame, model: dict, name: str = "label") -> DataFrame:
    """The likelier component of each row, from 1; null if a feature is null, or if the model has no components."""
    ready(table.sparkSession)
    features = model["features"]

    @F.pandas_udf("int")
    def likelier(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        ok = np.isfinite(x).all(1)
        out = pd.Series([None] * len(x), dtype="Int32")
        if ok.any() and len(model["weights"]):
            out[ok] = _log_parts(x[ok], model["weights"], model["means"], model["covariances"]).argmax(1) + 1
        return out

    return table.withColumn(name, likelier(*(F.col(f).cast("double") for f in features)))


def save(spark: SparkSession, model: dict, path: str) -> None:
    """A model as a Parquet table, a row for each component."""
    if not len(model["weights"]):
        raise ValueError("a model without components has no rows to be kept")
    rows = [(k, float(w), m.tolist(), c.tolist(), model["log_likelihood"], model["converged"], list(model["features"])) for k, (w, m, c) in enumerate(zip(model["weights"], model["means"], model["covariances"]))]
    spark.createDataFrame(rows, "component int, weight double, mean array<double>, covariance array<array<double>>, log_likelihood double, converged boolean, features array<string>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> dict:
    rows = spark.read.parquet(path).orderBy("component").collect()  # as many as components
    return {"weights": np.array([r.weight for r in rows]), "means": np.array([r["mean"] for r in rows]), "covariances": np.array([r.covariance for r in rows]), "log_likelihood": rows[0].log_likelihood, "converged": rows[0].converged, "features": rows[0].features}
