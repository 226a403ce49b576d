"""Exact medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.runtime import written


def exact_median(values: DataFrame, by: list[str], value: str = "value", limit: int = 1_000_000) -> DataFrame:
    """(by, median) over the values that are numbers; a group without any has no row.

    Groups of up to ``limit`` values take the built-in median, which holds a group's values in one task. For larger ones a sketch of a hundred quantiles
    narrows the range that holds the middle ranks, some thirtyfold a pass, and counts make it exact; where many values are equal, the values beside one of
    them part the range. Values are sorted only when a range holds ``limit`` at most.
    """
    own = values.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    sizes = own.groupBy(*by).agg(F.count("*").alias("_n"))
    if sizes.where(F.col("_n") > limit).isEmpty():
        return own.groupBy(*by).agg(F.median("_v").alias("median"))
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in by]
    sizes = written(sizes)
    small = own.join(sizes.where(F.col("_n") <= limit), same(own, sizes), "left_semi").groupBy(*by).agg(F.median("_v").alias("median"))
    # Of each large group: the range that holds both middle ranks, how many values lie below it and in it, and the median once it is known.
    keys = [f"_k{i}" for i in range(len(by))]
    fixed = [*keys, "_lo", "_hi", "_below", "_in", "_r1", "_r2", "_val"]
    state = sizes.where(F.col("_n") > limit).select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.lit(float("-inf")).alias("_lo"), F.lit(float("inf")).alias("_hi"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_in"), F.floor((F.col("_n") - 1) / 2).alias("_r1"), F.floor(F.col("_n") / 2).alias("_r2"), F.lit(None).cast("double").alias("_val"))
    met = lambda s: own.join(s, [own[c].eqNullSafe(s[k]) for c, k in zip(by, keys)]).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    open_ = F.col("_val").isNull() & (F.col("_in") > limit)
    grid = [k / 100 for k in range(101)]
    v, m, r1, r2 = (F.col(c) for c in ("_v", "_m", "_r1", "_r2"))
    while True:
        state = written(state)
        if state.where(open_).isEmpty():
            break
        edges = met(state.where(open_)).groupBy(*fixed).agg(F.percentile_approx("_v", grid, 1_000).alias("_e"))
        at = lambda d: F.get("_e", F.least(F.greatest(F.floor((F.col("_r1") - F.col("_below")) * 100 / F.col("_in")) + d, F.lit(0)), F.lit(100)).cast("int"))  # noqa: B023, E731
        edges = written(edges.withColumns({"_a": at(-1), "_m": at(0), "_b": at(2)}).drop("_e"))
        seen = met(edges).groupBy(*fixed, "_a", "_m", "_b").agg(F.count_if(v < F.col("_a")).alias("_less"), F.count_if((v >= F.col("_a")) & (v <= F.col("_b"))).alias("_kept"), F.count_if(v < m).alias("_under"), F.count_if(v == m).alias("_same"), F.max(F.when(v < m, v)).alias("_before"), F.min(F.when(v > m, v)).alias("_after"))
        # The sketch's range, if it holds both ranks and fewer values; else what lies on one side of its middle, or the median itself.
        good = (F.col("_below") + F.col("_less") <= r1) & (F.col("_below") + F.col("_less") + F.col("_kept") > r2) & (F.col("_kept") < F.col("_in"))
        low, high = F.col("_below") + F.col("_under"), F.col("_below") + F.col("_under") + F.col("_same")
        side = lambda a, under, over, other: F.when(good, a).when(r2 < low, under).when(r1 >= high, over).otherwise(other)  # noqa: B023, E731
        state = state.where(~open_).unionByName(seen.select(
            *keys, side(F.col("_a"), F.col("_lo"), F.col("_after"), F.col("_lo")).alias("_lo"), side(F.col("_b"), F.col("_before"), F.col("_hi"), F.col("_hi")).alias("_hi"),
            side(F.col("_below") + F.col("_less"), F.col("_below"), high, F.col("_below")).alias("_below"), side(F.col("_kept"), F.col("_under"), F.col("_in") - F.col("_under") - F.col("_same"), F.col("_in")).alias("_in"), "_r1", "_r2",
            F.when(good | (r2 < low) | (r1 >= high), F.lit(None).cast("double")).when(r1 < low, (F.col("_before") + m) / 2).when(r2 >= high, (m + F.col("_after")) / 2).otherwise(m).alias("_val"),
        ))
    found = state.where("_val is not null").select(*(F.col(k).alias(c) for k, c in zip(keys, by)), F.col("_val").alias("median"))
    placed = met(state.where("_val is null")).withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy("_v")) - 1 + F.col("_below"))
    last = placed.where((F.col("_p") == r1) | (F.col("_p") == r2)).groupBy(*by).agg(F.avg("_v").alias("median"))
    return small.unionByName(last).unionByName(found)
