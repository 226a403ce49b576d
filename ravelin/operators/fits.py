"""Fits as rows: what a solver has learned, kept as a table, and the prediction of any rows from it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import arrays
from ravelin.operators import solvers
from ravelin.operators.moments import Moments

#: A fit: its predictors in order, their means in the rows it was fitted on, and the coefficients on the predictors as they are.
FIT = "fit string, lam double, cv_mse double, n_train long, train_mse double, mean_y double, features array<string>, means array<double>, coefficients array<double>"


def record(name: str, m: Moments, coefficients: np.ndarray, features: Sequence[str], lam: float | None = None, cv_mse: float | None = None) -> tuple:
    """The row of a fit on rows of moments ``m`` (the outcome is their last column)."""
    mean = m.mean
    real = lambda v: None if v is None or v != v else float(v)
    return name, real(lam), real(cv_mse), int(m.n), real(solvers.error(m, coefficients)), float(mean[-1]), list(features), [float(v) for v in mean[:-1]], [float(v) for v in coefficients]


def table_of(spark: SparkSession, records: list[tuple], more: str = "") -> DataFrame:
    """Fits as a table; ``more`` declares columns that records have after those of FIT."""
    return spark.createDataFrame(records, FIT + (f", {more}" if more else ""))


def save(fits: DataFrame, path: str) -> None:
    """Fits as Parquet, a folder for each name: a fit saved again replaces itself and leaves the others."""
    fits.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fit").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def predict(fits: DataFrame, rows: DataFrame, x: str = "x", on: Sequence[str] = (), most: int = 1_000) -> DataFrame:
    """All rows with the fits that they meet, and ``y_hat`` = mean_y + (x - means) . coefficients, by means of the rows that were fitted.

    A row meets the fits of its own values of ``on``; without any it meets every fit, of which there may be ``most``. A tensor that is null, of another length,
    or holds a null or NaN has a null prediction. Columns of ``rows`` stay as they are; of the fits come fit, lam and y_hat.
    """
    own = fits.select("fit", "lam", *on, F.col("mean_y").alias("_mean_y"), F.col("means").alias("_means"), F.col("coefficients").alias("_b"))
    away = arrays.total(F.zip_with(F.zip_with(F.col(x), F.col("_means"), lambda u, v: u - v), F.col("_b"), lambda u, v: u * v))
    y_hat = F.when(F.size(x) == F.size("_b"), F.nanvl(F.col("_mean_y") + away, F.lit(None).cast("double")))
    if on:
        met = rows.join(own, list(on))
    else:
        if own.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} fits: name the columns by which rows meet theirs")
        met = rows.crossJoin(F.broadcast(own))  # at most ``most`` rows
    return met.withColumn("y_hat", y_hat).drop("_mean_y", "_means", "_b")


def errors(predictions: DataFrame, by: Sequence[str] = ("fit",), y: str = "y") -> DataFrame:
    """Number and mean squared error of predictions by fit; rows without a prediction or an outcome have no part."""
    miss = F.col(y) - F.col("y_hat")
    return predictions.groupBy(*by).agg(F.count(miss).alias("n"), F.avg(miss * miss).alias("mse"))


def selected(fits: DataFrame, tiny: float = 1e-6) -> DataFrame:
    """Coefficients that are not zero, by fit: feature, coefficient, and the coefficient over the selected ones' L1 norm, signed so that the largest is positive."""
    one = fits.select("fit", F.inline(F.arrays_zip(F.col("features").alias("feature"), F.col("coefficients").alias("coefficient")))).where(F.abs("coefficient") > tiny)
    # As many rows as a fit has predictors.
    sums = one.groupBy("fit").agg(F.sum(F.abs("coefficient")).alias("size"), F.max(F.struct(F.abs("coefficient").alias("a"), F.col("coefficient").alias("c"))).alias("top"))
    return one.join(sums, "fit").select("fit", "feature", "coefficient", (F.col("coefficient") / F.col("size") * F.signum("top.c")).alias("normalized"))
