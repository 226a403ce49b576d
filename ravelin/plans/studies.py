"""Whole studies: tensors and outcomes to penalties, fits and selections; bootstrap simulations. Results are long tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators import features as screen
from ravelin.operators import mixture, selection, solvers, tensors
from ravelin.operators.moments import Moments, fold_moments, gathered, moment_rows
from ravelin.sources import views

DENSE = list(views.DENSE)


def design(spark: SparkSession, sf: str) -> DataFrame:
    """Subject, packed tensor x and outcome y; standard features, so that penalties mean the same for each."""
    slides = tensors.assemble(views.dense_objects(spark, sf), DENSE)
    return tensors.packed(slides, DENSE).join(views.dense_outcomes(spark, sf), "subject")


def columns(packed: DataFrame, size: int) -> tuple[DataFrame, list[str]]:
    names = [f"x{k}" for k in range(size)]
    return packed.select("*", *(F.get("x", k).alias(n) for k, n in enumerate(names))), names


def moments_of(packed: DataFrame, size: int, fold: str | None = "fold") -> dict[int, Moments]:
    wide, names = columns(packed, size)
    return fold_moments(wide, [*names, "y"], fold)


def summed(folds: dict[int, Moments]) -> Moments:
    parts = list(folds.values())
    return sum(parts[1:], parts[0])


def _curve(spark: SparkSession, folds: dict[int, Moments], grid: np.ndarray, fit: selection.Fit, centred: bool = True) -> DataFrame:
    """lam, cv_mse, chosen, at_boundary and the refit's coefficients: as many rows as penalties."""
    errors, fits = selection.cross_validation(spark, folds, grid, fit, centred)
    best, spread = selection.least(errors), selection.lambda_spread(grid, errors)
    rows = [(float(lam), float(e), k == best, bool(lam == spread), selection.at_boundary(grid, best), [float(v) for v in b]) for k, (lam, e, b) in enumerate(zip(grid, errors, fits))]
    return spark.createDataFrame(rows, "lam double, cv_mse double, chosen boolean, spread_rule boolean, at_boundary boolean, coefficients array<double>")


def group_lasso_cv(spark: SparkSession, sf: str) -> DataFrame:
    modes = solvers.tensor_modes(2, len(DENSE), 2)
    folds = moments_of(selection.hash_folds(design(spark, sf), "subject"), len(modes["j"]))
    grid = solvers.penalty_grid(solvers.largest_penalty(summed(folds), modes["j"]))
    return _curve(spark, folds, grid, selection.fit_group(modes["j"]))


def lasso_cv(spark: SparkSession, sf: str) -> DataFrame:
    """Grand means of the tensor and a plain lasso over a path of penalties."""
    modes = solvers.tensor_modes(2, len(DENSE), 2)
    folds = moments_of(selection.hash_folds(design(spark, sf), "subject"), len(modes["j"]))
    mean = solvers._onto(modes["j"], np.full(len(modes["j"]), 0.25))
    folds = {k: m.mapped(mean) for k, m in folds.items()}
    return _curve(spark, folds, selection.lasso_path(summed(folds)), selection.fit_lasso())


def _alternating(spark: SparkSession, sf: str, modes: dict[str, np.ndarray], restart: bool = True) -> DataFrame:
    folds = moments_of(selection.hash_folds(design(spark, sf), "subject"), len(modes["j"]))
    total = summed(folds)
    grid = np.geomspace(1e-4, 1.0, 15) * total.covariance[-1, -1] ** 0.5
    errors, _ = selection.cross_validation(spark, folds, grid, selection.fit_alternating(modes))
    lam = float(grid[selection.least(errors)])
    v = selection.restarts(spark, total, modes, lam)
    mse = solvers.error(total, solvers.coefficients(v, modes))
    rows = [(m, k, float(x), lam, float(errors.min()), mse) for m, vec in v.items() for k, x in enumerate(vec)]
    return spark.createDataFrame(rows, "mode string, k int, coef double, lam double, cv_mse double, train_mse double")


def rank1_lasso(spark: SparkSession, sf: str) -> DataFrame:
    return _alternating(spark, sf, solvers.tensor_modes(2, len(DENSE), 2))


def joint_lasso(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters and slides as one mode."""
    m = solvers.tensor_modes(2, len(DENSE), 2)
    return _alternating(spark, sf, {"p": m["g"] * 2 + m["s"], "j": m["j"]})


def two_mode_lasso(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters by features, on the mean of the slides."""
    m = solvers.tensor_modes(2, len(DENSE), 2)
    folds = moments_of(selection.hash_folds(design(spark, sf), "subject"), len(m["j"]))
    cell = m["g"] * len(DENSE) + m["j"]
    folds = {k: x.mapped(solvers._onto(cell, np.full(len(cell), 0.5))) for k, x in folds.items()}
    modes = {"g": np.arange(2 * len(DENSE)) // len(DENSE), "j": np.arange(2 * len(DENSE)) % len(DENSE)}
    total = summed(folds)
    grid = np.geomspace(1e-4, 1.0, 15) * total.covariance[-1, -1] ** 0.5
    errors, _ = selection.cross_validation(spark, folds, grid, selection.fit_alternating(modes))
    lam = float(grid[selection.least(errors)])
    v = selection.restarts(spark, total, modes, lam)
    shift = float(total.mean[-1] - solvers.coefficients(v, modes) @ total.mean[:-1])
    rows = [(mode, k, float(x), lam, float(errors.min()), shift) for mode, vec in v.items() for k, x in enumerate(vec)]
    return spark.createDataFrame(rows, "mode string, k int, coef double, lam double, cv_mse double, intercept double")


def oracle_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares on the cells of the true features, price and tax, by subject's tensor."""
    modes = solvers.tensor_modes(2, len(DENSE), 2)
    m = summed(moments_of(design(spark, sf), len(modes["j"]), None))
    keep = [k for k in range(len(modes["j"])) if DENSE[modes["j"][k]] in ("price", "tax")]
    pick = np.eye(len(modes["j"]) + 1)[[*keep, -1]]
    own = m.mapped(pick)
    intercept, b = solvers.least_squares(own)
    rows = [(int(modes["g"][k]), DENSE[modes["j"][k]], int(modes["s"][k]), float(v), intercept, solvers.error(own, b)) for k, v in zip(keep, b)]
    return spark.createDataFrame(rows, "g int, feature string, s int, coef double, intercept double, mse double")


def bootstrap_sample(spark: SparkSession, sf: str) -> DataFrame:
    """One sample of the design's subjects with replacement, and which of its draws are for testing."""
    drawn = selection.bootstrap(design(spark, sf).select("subject", "y"), "subject")
    return selection.split(drawn, "draw").select("draw", "subject", "y", "test")


def mixture_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of all objects that are not excluded, by a mixture of their features; sizes and means by label and slide."""
    objects = views.dense_objects(spark, sf).where("excluded = 0").drop("label")
    model = mixture.fit(objects, DENSE)
    return tensors.slide_statistics(mixture.label(objects, model), DENSE)


def mixture_threshold_search(spark: SparkSession, sf: str) -> DataFrame:
    """Embedding components pruned at falling thresholds until a mixture of what stays settles."""
    wide = views.wide_features(spark, sf)
    names = [c for c in wide.columns if c.startswith(("e", "x")) and c != "embedding"]
    pairs = screen.correlation_pairs(wide, names)
    for above in (0.99, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7):
        stay, gone = screen.prune(pairs, names, above)
        model = mixture.fit(wide, stay)
        if model["converged"]:
            rows = [(above, f, f in stay, model["log_likelihood"]) for f in names]
            return spark.createDataFrame(rows, "threshold double, feature string, kept boolean, log_likelihood double")
    raise RuntimeError("no mixture settled at any threshold")


def simulation_grid(spark: SparkSession, sf: str, reps: int = 4, sigmas: tuple[float, ...] = (0.5, 2.0)) -> DataFrame:
    """Bootstrap studies on the subjects' tensors: known coefficients on price and tax, noise by hash, group lasso, rank-one and plain
    lasso fits, and how well each selects. Draws, outcomes and moments are made in Spark for all settings at once, and repetitions are fitted in parallel from moments.
    """
    q = len(DENSE)
    modes = solvers.tensor_modes(2, q, 2)
    d = len(modes["j"])
    base, names = columns(design(spark, sf), d)
    scale = base.agg(*(F.stddev_pop(c) for c in names)).first()
    scale = [s if s and s > 1e-10 else 1.0 for s in scale]
    truth = np.where(np.isin(modes["j"], [1, 3]), 1.0 + modes["g"] + 2 * modes["s"], 0.0)
    base = base.select("subject", *((F.col(c) / s).alias(c) for c, s in zip(names, scale)))
    settings = len(sigmas)
    drawn = selection.bootstrap(base, "subject", reps * settings)
    uniform = lambda seed: (F.pmod(F.xxhash64(F.lit(seed), "rep", "draw"), F.lit(1_000_003)) + 0.5) / 1_000_003
    noise = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * np.pi * uniform(2))
    sigma = F.element_at(F.array(*map(F.lit, sigmas)), (F.col("rep") % settings + 1).cast("int"))
    signal = sum((F.col(c) * float(t) for c, t in zip(names, truth) if t), F.lit(0.0))
    drawn = drawn.withColumns({"y": signal + sigma * noise, "cell": F.col("rep") * 5 + F.pmod(F.xxhash64("rep", "draw"), F.lit(5))})
    # One task a repetition: it sees the moments of its five folds, whose size is the tensor's.
    rows, shift = moment_rows(drawn, [*names, "y"], "cell")
    results = "sigma double, rep int, estimator string, tpr double, fpr double, l1 double, mse double"

    def run(rep: pd.DataFrame) -> pd.DataFrame:
        number = int(rep["fold"].iloc[0]) // 5
        fits = _fits(gathered(list(zip(rep["fold"], rep["i"], rep["row"])), shift), modes, truth)
        return pd.DataFrame([(float(sigmas[number % settings]), number // settings, *f) for f in fits], columns=["sigma", "rep", "estimator", "tpr", "fpr", "l1", "mse"])

    return rows.groupBy(F.floor(F.col("fold") / 5)).applyInPandas(run, results)


def _fits(folds: dict[int, Moments], modes: dict[str, np.ndarray], truth: np.ndarray) -> list[tuple[str, float, float, float, float]]:
    """(estimator, tpr, fpr, l1, mse) of one repetition's fits."""
    if len(folds) < 2:
        return []
    feature, d = modes["j"], len(truth)
    total = summed(folds)
    grid = solvers.penalty_grid(solvers.largest_penalty(total, feature))
    lam = float(grid[selection.least(selection.cross_validated(folds, grid, selection.fit_group(feature)))])
    group = solvers.group_lasso(total, feature, lam)[1]
    rank_grid = np.geomspace(1e-4, 1.0, 15) * total.covariance[-1, -1] ** 0.5
    rank_lam = float(rank_grid[selection.least(selection.cross_validated(folds, rank_grid, selection.fit_alternating(modes)))])
    rank_one = solvers.coefficients(selection.best_restart(total, modes, rank_lam), modes)
    two = {"p": modes["g"] * 2 + modes["s"], "j": modes["j"]}
    joint_lam = float(rank_grid[selection.least(selection.cross_validated(folds, rank_grid, selection.fit_alternating(two)))])
    joint = solvers.coefficients(selection.best_restart(total, two, joint_lam), two)
    means = {k: m.mapped(solvers._onto(feature, np.full(d, 0.25))) for k, m in folds.items()}
    path = selection.lasso_path(summed(means))
    plain = solvers.lasso(summed(means), float(path[selection.least(selection.cross_validated(means, path, selection.fit_lasso()))]))
    known = truth != 0
    oracle = np.zeros(d)
    oracle[known] = solvers.least_squares(total.mapped(np.eye(d + 1)[[*np.flatnonzero(known), d]]))[1]
    block_mean = lambda b: np.bincount(feature, weights=b) / np.bincount(feature)
    fits = [("tensor", block_mean(group), solvers.error(total, group)), ("rank1", block_mean(rank_one), solvers.error(total, rank_one)), ("joint", block_mean(joint), solvers.error(total, joint)), ("naive", plain, solvers.error(summed(means), plain)), ("oracle", block_mean(oracle), solvers.error(total, oracle))]
    real = np.bincount(feature, weights=np.abs(truth)) > 0
    unit = lambda x: x / np.abs(x).sum() if np.abs(x).sum() > 0 else x
    return [(name, float((np.abs(b[real]) > 1e-6).mean()), float((np.abs(b[~real]) > 1e-6).mean()), float(np.abs(unit(b) - unit(block_mean(truth))).sum()), float(mse)) for name, b, mse in fits]
