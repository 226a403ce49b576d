"""Folds, samples, choice of penalties, thresholds and the metrics of a selection."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.noise import noisy
from ravelin.operators.medians import exact_median
from ravelin.operators.moments import Moments
from ravelin.operators.solvers import alternating, coefficients, error, group_lasso, lasso
from ravelin.runtime import cut


def draw(seed: int, *keys: str) -> Column:
    """A number from 0 to 2^31 - 2 that depends on seed and keys alone, whatever the partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(2147483647))


def hash_folds(table: DataFrame, key: str, seed: int = 42, k: int = 5) -> DataFrame:
    return table.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(k)).cast("int"))


def numbered(table: DataFrame, *order: str) -> DataFrame:
    """Rows numbered from 0 in their order, by the sizes of sorted ranges: no task sees them all."""
    laid = cut(table.repartitionByRange(*order).sortWithinPartitions(*order))
    sizes = {r.p: r.n for r in laid.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    before = dict(zip(sorted(sizes), itertools.accumulate((sizes[p] for p in sorted(sizes)), initial=0)))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = before.get(TaskContext.get().partitionId(), 0)
        for b in batches:
            yield b.append_column("place", pa.array(np.arange(at, at + b.num_rows)))
            at += b.num_rows

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema)
    return laid.mapInArrow(number, f"{kinds}, place long")


def section_breaks(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Column ``new_section``: whether a row's keys differ from those of the row before it in the order; the first row begins one. Nulls equal nulls."""
    rows = numbered(table, *order)
    before = rows.select((F.col("place") + 1).alias("place"), F.struct(*keys).alias("_before"))
    same = F.col("_before").isNotNull() & F.struct(*keys).eqNullSafe(F.col("_before"))
    return rows.join(before, "place", "left").withColumn("new_section", ~same).drop("_before")


def block_folds(table: DataFrame, *order: str, k: int = 5) -> DataFrame:
    """Runs of n div k rows in their order; the last fold takes what is over."""
    n = table.count()
    return numbered(table, *order).withColumn("fold", F.least(F.floor(F.col("place") / max(n // k, 1)), F.lit(k - 1)).cast("int"))


def bootstrap(table: DataFrame, key: str, reps: int = 1, seed: int = 42) -> DataFrame:
    """``reps`` samples with replacement, each as large as the table: rep, draw (its number) and the drawn row."""
    rows = numbered(table, key)
    n = table.count()
    draws = table.sparkSession.range(n * reps).select(F.floor(F.col("id") / n).cast("int").alias("rep"), (F.col("id") % n).alias("draw"))
    draws = draws.withColumn("place", F.pmod(F.xxhash64(F.lit(seed), "rep", "draw"), F.lit(max(n, 1))))
    return draws.join(rows, "place").drop("place")


def noisy_bootstrap(table: DataFrame, key: str, x: str, sigma: float, reps: int = 1, seed: int = 42) -> DataFrame:
    """As bootstrap, with normal noise of deviation ``sigma`` on every entry of the array ``x``: another for each draw, the same for any partitions."""
    return bootstrap(table, key, reps, seed).withColumn(x, noisy(F.col(x), sigma, seed + 1, F.col("rep"), F.col("draw")))


def split(table: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Column ``test``: true for max(1, round(n share)) rows of least draw, ties by key. Rows of one key may fall on both sides after a bootstrap; split
    before it to keep them together."""
    n = table.count()
    most = max(1, round(n * share))
    return numbered(table.withColumn("drawn", draw(seed, key)), "drawn", key).withColumn("test", F.col("place") < most).drop("drawn", "place")


Fit = Callable[[Moments, float], np.ndarray]


def cross_validated(folds: dict[int, Moments], grid: np.ndarray, fit: Fit, centred: bool = True) -> np.ndarray:
    """Mean test error of each penalty; a fold trains on the total less its own moments."""
    total = sum(list(folds.values())[1:], list(folds.values())[0])
    return np.array([np.mean([error(m, fit(total - m, lam), centred) for m in folds.values()]) for lam in grid])


def cross_validation(spark: SparkSession, folds: dict[int, Moments] | list[dict[int, Moments]], grid: np.ndarray, fit: Fit, centred: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """As cross_validated, a Spark task for each penalty and fold; and the refit on all folds of each penalty. Moments have the tensor's size.

    A list gives each penalty folds of its own, over the same rows.
    """
    sets = folds if isinstance(folds, list) else [folds] * len(grid)
    totals = [sum(list(f.values())[1:], list(f.values())[0]) for f in sets]
    jobs = [(j, k) for j, f in enumerate(sets) for k in (*f, None)]
    held = spark.sparkContext.broadcast((folds if isinstance(folds, list) else [folds], totals if isinstance(folds, list) else totals[:1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets_, totals_ = held.value
        for b in batches:
            for i in b.column(0).to_pylist():
                j, k = jobs[i]
                own, total = sets_[min(j, len(sets_) - 1)], totals_[min(j, len(totals_) - 1)]
                beta = fit(total if k is None else total - own[k], float(grid[j]))
                e = 0.0 if k is None else error(own[k], beta, centred)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([float(e)]), pa.array([[float(v) for v in beta]], pa.list_(pa.float64()))], names=["id", "e", "beta"])

    tasks = spark.range(0, len(jobs), 1, max(1, min(len(jobs), 4 * spark.sparkContext.defaultParallelism)))
    rows = {r.id: r for r in tasks.mapInArrow(run, "id long, e double, beta array<double>").collect()}
    errors = np.array([np.mean([rows[i].e for i, (own, k) in enumerate(jobs) if own == j and k is not None]) for j in range(len(grid))])
    return errors, [np.array(rows[i].beta) for i, (_, k) in enumerate(jobs) if k is None]


def centred_prediction(design: DataFrame, coefficients: list[float], x: str = "x", y: str = "y") -> DataFrame:
    """Column ``y_hat`` of packed tensors ``x``: (x - mean x) . b + mean y, with the means of all rows of ``design``."""
    means = design.agg(F.avg(y).alias("mean_y"), F.array(*(F.avg(F.get(x, k)) for k in range(len(coefficients)))).alias("mean_x"))  # one row
    b = F.array(*(F.lit(float(c)) for c in coefficients))
    away = F.zip_with(F.zip_with(F.col(x), F.col("mean_x"), lambda u, v: u - v), b, lambda u, v: u * v)
    return design.crossJoin(F.broadcast(means)).withColumn("y_hat", F.col("mean_y") + F.aggregate(away, F.lit(0.0), lambda s, v: s + v)).drop("mean_x", "mean_y")


def fit_group(feature: np.ndarray) -> Fit:
    return lambda m, lam: group_lasso(m, feature, lam)[1]


def fit_lasso() -> Fit:
    return lasso


def fit_alternating(modes: dict[str, np.ndarray], compat: bool = False) -> Fit:
    """From uniform vectors."""
    start = {k: np.full(x.max() + 1, 1 / (x.max() + 1)) for k, x in modes.items()}
    return lambda m, lam: coefficients(alternating(m, modes, lam, start, compat=compat), modes)


def best_restart(m: Moments, modes: dict[str, np.ndarray], lam: float, restarts: int = 3, seed: int = 42, compat: bool = False) -> dict[str, np.ndarray]:
    """Of random starts, the fit of least training error; the first among equals."""
    best, least = None, np.inf
    for start in starts(modes, restarts, seed):
        v = alternating(m, modes, lam, start, compat=compat)
        e = error(m, coefficients(v, modes))
        if best is None or e < least:
            best, least = v, e
    return best


def starts(modes: dict[str, np.ndarray], n: int, seed: int) -> list[dict[str, np.ndarray]]:
    """Random starts: uniform entries for j, weights that add up to 1 for the other modes."""
    rng = np.random.default_rng(seed)
    return [{k: rng.uniform(-1, 1, x.max() + 1) if k == "j" else rng.dirichlet(np.ones(x.max() + 1)) for k, x in modes.items()} for _ in range(n)]


def restarts(spark: SparkSession, m: Moments, modes: dict[str, np.ndarray], lam: float, n: int = 3, seed: int = 42, compat: bool = False) -> dict[str, np.ndarray]:
    """As best_restart, a Spark task for each start."""
    held = spark.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                v = alternating(held.value, modes, lam, starts(modes, n, seed)[i], compat=compat)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([error(held.value, coefficients(v, modes))]), pa.array([[v[k].tolist() for k in modes]], pa.list_(pa.list_(pa.float64())))], names=["id", "e", "v"])

    rows = spark.range(0, n, 1, n).mapInArrow(run, "id long, e double, v array<array<double>>").collect()
    best = min(rows, key=lambda r: (r.e, r.id))
    return {k: np.array(x) for k, x in zip(modes, best.v)}


def least(errors: np.ndarray) -> int:
    return int(np.argmin(errors))


def lambda_spread(grid: np.ndarray, errors: np.ndarray, k: int = 5) -> float:
    """The largest penalty whose error is within the least one plus the errors' deviation over the penalties by root k."""
    return float(grid[errors <= errors.min() + errors.std() / np.sqrt(k)].max())


def at_boundary(grid: np.ndarray, chosen: int) -> bool:
    return chosen in (0, len(grid) - 1)


def lasso_path(m: Moments, n: int = 100, ratio: float = 1e-4) -> np.ndarray:
    """Penalties from the least that empties the lasso downwards."""
    c = m.covariance
    s = np.sqrt(np.clip(np.diag(c)[:-1], 0, None))
    top = 2 * np.abs(c[:-1, -1] / np.where(s > 1e-10, s, 1.0)).max()
    return np.geomspace(max(top, 1e-12), max(top, 1e-12) * ratio, n)


def thresholded(blocks: DataFrame, by: Column, value: str = "beta", size: str | None = None) -> DataFrame:
    """Coefficients with those of size under the threshold set to zero; the size is the magnitude or another column."""
    return blocks.withColumn(value, F.when((F.abs(value) if size is None else F.col(size)) < by, 0.0).otherwise(F.col(value)))


def adaptive_threshold(residuals: DataFrame, by: list[str], q: int, residual: str = "r") -> DataFrame:
    """Sample deviation of the residuals times sqrt(2 ln q / n)."""
    return residuals.groupBy(*by).agg((F.stddev_samp(residual) * F.sqrt(2 * F.log(F.lit(float(q))) / F.count(residual))).alias("tau"))


def selection_metrics(fits: DataFrame, by: list[str], tiny: float = 1e-6) -> DataFrame:
    """tpr, fpr and l1 of (beta, truth) by estimator. A rate over no features is NaN; l1 compares the L1-normalized vectors."""
    hit, real = F.abs("beta") > tiny, F.abs("truth") > tiny
    rate = lambda of: F.coalesce(F.avg(F.when(of, hit.cast("double"))), F.lit(float("nan")))
    sums = fits.groupBy(*by).agg(rate(real).alias("tpr"), rate(~real).alias("fpr"), F.sum(F.abs("beta")).alias("sb"), F.sum(F.abs("truth")).alias("st"))
    unit = lambda v, s: F.when(F.col(s) > 0, F.col(v) / F.col(s)).otherwise(0.0)
    # As many sums as estimators.
    joined = fits.join(sums, by).groupBy(*by).agg(F.first("tpr").alias("tpr"), F.first("fpr").alias("fpr"), F.sum(F.abs(unit("beta", "sb") - unit("truth", "st"))).alias("l1"))
    return joined


def metric_summary(values: DataFrame, by: list[str], value: str = "value", limit: int = 1_000_000) -> DataFrame:
    """Number, mean and median of the values that are numbers; medians are exact for groups of any size."""
    real = F.when(~F.isnan(value), F.col(value))
    means = values.groupBy(*by).agg(F.count(real).alias("_count"), F.avg(real).alias("_mean"))
    middle = exact_median(values, by, value, limit).select(*(F.col(c).alias(f"_{c}_") for c in by), "median")
    joined = means.join(middle, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in by], "left")
    return joined.select(*by, F.col("_count").alias("n"), F.col("_mean").alias("mean"), "median")


def nonzero_features(coefficients: DataFrame, tiny: float = 0.0) -> DataFrame:
    """Features (j) of which any coefficient (g, j, s, coef) is beyond ``tiny``."""
    return coefficients.groupBy("j").agg(F.max(F.abs("coef")).alias("top")).where(F.col("top") > tiny).select("j")


def arithmetic_grid(first: float, last: float, step: float) -> np.ndarray:
    """first, first + step, ... below last."""
    return first + step * np.arange(max(0, int(np.ceil(round((last - first) / step, 9)))))
