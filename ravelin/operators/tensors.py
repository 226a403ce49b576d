"""From ragged objects to fixed tensors: (subject, g, j, s, value) rows or packed arrays."""

from __future__ import annotations

from itertools import product
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLUSTERS = (1, 2)
MODES = ("g", "j", "s")


def slide_statistics(objects: DataFrame, features: list[str], clusters: tuple[int, ...] = CLUSTERS) -> DataFrame:
    """One row for each slide: n, the clusters' shares, means and weighted means (share times mean).

    An empty cluster has share 0, no mean, and weighted mean 0.
    """
    mine = [F.col("label") == g for g in clusters]
    out = [F.count("*").alias("n"), *(F.avg(F.when(m, 1.0).otherwise(0.0)).alias(f"w{g}") for g, m in zip(clusters, mine))]
    for f in features:
        for g, m in zip(clusters, mine):
            out += [F.avg(F.when(m, F.col(f))).alias(f"mean{g}_{f}"), (F.sum(F.when(m, F.col(f)).otherwise(0.0)) / F.count(f)).alias(f"weighted{g}_{f}")]
    return objects.groupBy("subject", "slide").agg(*out)


def slide_places(slides: DataFrame, most: int | None = 2) -> DataFrame:
    """Slides numbered from 0 within their subject by name, with the subject's slide count: the first ``most`` of them, or all."""
    w = Window.partitionBy("subject")
    placed = slides.withColumns({"s": F.row_number().over(w.orderBy("slide")) - 1, "n_slides": F.count("*").over(w)})
    return placed if most is None else placed.where(F.col("s") < most)


def padded(slides: DataFrame) -> DataFrame:
    """A subject with one slide gets a copy of it as its second."""
    return slides.withColumn("s", F.explode(F.when(F.col("n_slides") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.col("s"))))).withColumn("copied", (F.col("n_slides") == 1) & (F.col("s") == 1))


def tensor_rows(slides: DataFrame, features: list[str], clusters: tuple[int, ...] = CLUSTERS) -> DataFrame:
    """(subject, g, j, s, value) of padded slides, all counted from 0."""
    cells = [F.struct(F.lit(k).alias("g"), F.lit(j).alias("j"), F.coalesce(F.col(f"weighted{g}_{f}"), F.lit(0.0)).alias("value")) for k, g in enumerate(clusters) for j, f in enumerate(features)]
    return slides.select("subject", "s", F.inline(F.array(*cells))).select("subject", "g", "j", "s", "value")


def packed(slides: DataFrame, features: list[str], clusters: tuple[int, ...] = CLUSTERS, most: int | None = 2) -> DataFrame:
    """(subject, x): the tensor as an array with index (g q + j) S + s.

    S is ``most``, and slides that a subject lacks are zeros; without it S is the subject's own number of slides (a ragged form: n_slides tells it). One
    shuffle by subject brings a subject's slides together, each as one array.
    """
    cells = F.array(*(F.coalesce(F.col(f"weighted{g}_{f}"), F.lit(0.0)) for g in clusters for f in features))
    own = slides if most is None else slides.where(F.col("s") < most)
    by = own.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct(F.col("s").cast("int").alias("s"), cells.alias("v")))).alias("slots"))
    count = F.size("slots") if most is None else F.lit(most)
    # Slides are numbered without gaps, so slide s is slot s.
    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(clusters) * len(features) - 1)), lambda c: F.transform(F.sequence(F.lit(0), count - 1), lambda s: F.coalesce(F.get(F.get("slots", s)["v"], c), F.lit(0.0)))))
    return by.select("subject", whole.alias("x"), *([count.alias("n_slides")] if most is None else []))


def slide_count(slides: DataFrame) -> int:
    """The most slides of any subject: the S with which no slide is dropped."""
    return slides.agg((F.max("s") + 1).alias("n")).first().n or 0


def assemble(objects: DataFrame, features: list[str], clusters: tuple[int, ...] = CLUSTERS, most: int | None = 2) -> DataFrame:
    """Objects that are not excluded, to padded slide statistics of each subject's first ``most`` slides, or of all."""
    return padded(slide_places(slide_statistics(objects.where("excluded = 0"), features, clusters), most))


def pooled_average(objects: DataFrame, features: list[str], clusters: tuple[int, ...] = CLUSTERS) -> DataFrame:
    """Weighted cluster means with all slides of a subject as one: (subject, g, j, value); an empty cluster gives 0."""
    cells = [F.struct(F.lit(k).alias("g"), F.lit(j).alias("j"), (F.sum(F.when(F.col("label") == g, F.col(f)).otherwise(0.0)) / F.count(f)).alias("value")) for k, g in enumerate(clusters) for j, f in enumerate(features)]
    return objects.where("excluded = 0").groupBy("subject").agg(F.array(*cells).alias("c")).select("subject", F.inline("c"))


def contracted(cells: DataFrame, weights: DataFrame, mode: str) -> DataFrame:
    """The tensor times a vector along one mode (g, j or s); ``weights`` holds (mode, w), as short as the mode."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}: one of {', '.join(MODES)}")
    rest = [c for c in MODES if c != mode]
    return cells.join(F.broadcast(weights), mode).groupBy("subject", *rest).agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def contraction(x: Column, sizes: tuple[int, int, int], vectors: dict[str, list[float]]) -> Column:
    """A packed tensor times a vector along one, two or all modes: the packed rest, in the order of its modes (one number if none is left).

    One expression over the array: no cell becomes a row. ``sizes`` are those of g, j and s.
    """
    size = dict(zip(MODES, sizes))
    if not vectors or set(vectors) - set(MODES):
        raise ValueError(f"modes are {', '.join(MODES)}")
    if any(len(v) != size[m] for m, v in vectors.items()):
        raise ValueError("a vector is as long as its mode")
    step = {"g": sizes[1] * sizes[2], "j": sizes[2], "s": 1}
    kept = [m for m in MODES if m not in vectors]
    places = lambda modes: [sum(step[m] * k for m, k in zip(modes, at)) for at in product(*(range(size[m]) for m in modes))]
    weights = [float(prod(v)) for v in product(*(vectors[m] for m in MODES if m in vectors))]
    pairs = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(w).alias("w")) for p, w in zip(places([m for m in MODES if m in vectors]), weights)))
    return F.transform(F.array(*map(F.lit, places(kept))), lambda base: F.aggregate(pairs, F.lit(0.0), lambda acc, o: acc + F.get(x, base + o.p) * o.w))


def inner_products(cells: DataFrame, coefficients: DataFrame) -> DataFrame:
    """<B, X> of each subject; ``coefficients`` holds (g, j, s, coef), as short as a tensor."""
    return cells.join(F.broadcast(coefficients), ["g", "j", "s"]).groupBy("subject").agg(F.sum(F.col("value") * F.col("coef")).alias("y_hat"))


def matched(subjects: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Subjects with the outcome of their key, or of the key with '-' for ' ' where the key itself has none.

    ``outcomes`` (name, y, place) may give several rows to a key: the first that is not null counts.
    """
    from ravelin.functions.keys import outcome_key, repaired_key

    first = outcomes.where(F.col("y").isNotNull()).groupBy(outcome_key(F.col("name")).alias("key")).agg(F.min(F.struct("place", "y")).alias("f")).select("key", F.col("f.y").alias("y"))
    # Both keys of a subject in one join; the key itself ranks before the repaired one.
    asked = subjects.withColumn("row", F.monotonically_increasing_id()).select("*", F.posexplode(F.array_distinct(F.array("subject", repaired_key(F.col("subject"))))).alias("turn", "key"))
    found = asked.join(first, "key").groupBy("row", *subjects.columns).agg(F.min(F.struct("turn", "y")).alias("f"))
    return found.select(*subjects.columns, F.col("f.y").alias("y"))
