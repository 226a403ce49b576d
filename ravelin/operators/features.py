"""Averages of objects, correlations of features, and screening by them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.operators.gram import wide_correlations


def naive_average(objects: DataFrame, features: list[str], by: str = "subject") -> DataFrame:
    """The mean of each feature over all of a subject's objects, whatever their slide."""
    return objects.groupBy(by).agg(*(F.avg(f).alias(f) for f in features))


def correlation_pairs(table: DataFrame, features: list[str], few: int = 24) -> DataFrame:
    """(i, j, f1, f2, r) for i < j; r is null if a feature is constant. Few features take one aggregate, many one pass of block products."""
    if len(features) <= few:
        flat = lambda a, b: (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
        rows = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.when(flat(a, b), F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))).alias("r")) for (i, a), (j, b) in combinations(enumerate(features), 2)]
        return table.agg(F.array(*rows).alias("p")).select(F.inline("p"))
    return wide_correlations(table.select(F.array(*(F.col(f).cast("double") for f in features)).alias("v")), features)


def both_orders(pairs: DataFrame) -> DataFrame:
    return pairs.select("i", "f1", "f2", "r").union(pairs.select(F.col("j"), F.col("f2"), F.col("f1"), "r"))


def strongest(pairs: DataFrame) -> DataFrame:
    """Each feature's largest magnitude of correlation with another."""
    return both_orders(pairs).groupBy(F.col("i").alias("j"), F.col("f1").alias("feature")).agg(F.max(F.abs("r")).alias("max_abs_corr"))


def ranked(pairs: DataFrame) -> DataFrame:
    """Features by that magnitude, the most independent first. As many rows as features."""
    return strongest(pairs).withColumn("rank", F.row_number().over(Window.orderBy("max_abs_corr", "j")))


def candidates(pairs: DataFrame, below: float = 0.8) -> DataFrame:
    return ranked(pairs).where(F.col("max_abs_corr") < below)


def most_independent(pairs: DataFrame, n: int = 10) -> DataFrame:
    """The n most independent features; the limit is the report's."""
    return ranked(pairs).orderBy("rank").limit(n)


def candidate_matrix(pairs: DataFrame, below: float = 0.8) -> DataFrame:
    """The correlations among the candidates."""
    return sub_matrix(pairs, candidates(pairs, below))


def sub_matrix(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Pairs of which both are among ``features``."""
    own = features.select("feature")
    return pairs.join(own.withColumnRenamed("feature", "f1"), "f1", "left_semi").join(own.withColumnRenamed("feature", "f2"), "f2", "left_semi")


def prune(pairs: DataFrame, features: list[str], above: float = 0.95) -> tuple[list[str], list[str]]:
    """Drop, again and again, the feature in most pairs beyond ``above`` (the first among equals): what stays, what went."""
    beside: dict[int, set[int]] = {}
    for r in pairs.where(F.abs("r") > above).select("i", "j").toLocalIterator():  # pairs beyond the threshold only
        beside.setdefault(r.i, set()).add(r.j)
        beside.setdefault(r.j, set()).add(r.i)
    gone: list[int] = []
    while beside:
        worst = min(beside, key=lambda k: (-len(beside[k]), k))
        gone.append(worst)
        for other in beside.pop(worst):
            beside[other].discard(worst)
            if not beside[other]:
                del beside[other]
    return [f for k, f in enumerate(features) if k not in set(gone)], [features[k] for k in gone]
