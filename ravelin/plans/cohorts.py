"""Queries on cohorts of any shape: wide features, tensors of any slides and clusters, stored fits and their predictions, whole studies with their result tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import arrays
from ravelin.functions.noise import normal, noisy
from ravelin.operators import features as screen
from ravelin.operators import fits, selection, solvers, tensors
from ravelin.operators.gram import wide_correlations as correlations
from ravelin.operators.medians import exact_median
from ravelin.operators.moments import Moments, fold_moments, fold_set_moments
from ravelin.plans import oracles
from ravelin.plans.relational import R, _gradients, _pairs, _residuals, rounded
from ravelin.plans.studies import DENSE, columns, design, moments_of, summed
from ravelin.runtime import table
from ravelin.sources import views

CLUSTERS = (1, 2, 3)
MODES = solvers.tensor_modes(2, len(DENSE), 2)
#: The weights of clusters and slides that oracles know.
ALPHA, GAMMA = (1 / 3, 2 / 3), (2 / 3, 1 / 3)


def wide_correlations(spark: SparkSession, sf: str) -> DataFrame:
    """Correlations of 67 columns in blocks of 16."""
    wide = views.wide_features(spark, sf)
    names = [c for c in wide.columns if c not in ("subject", "label")]
    out = correlations(wide.select(F.array(*names).alias("v")), names, block=16)
    return rounded(out.select("f1", "f2", "r"), "r", n=5)


def candidate_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(screen.candidate_matrix(_pairs(spark, sf), 0.8).select("f1", "f2", "r"), "r")


def _many_slides(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as objects: a customer's slides are the priorities, of which there may be five, and three clusters by status."""
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    objects = o.select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("slide"), F.lit(0).alias("excluded"), status.alias("label"), F.col("o_totalprice").alias("total"))
    return tensors.assemble(objects, ["total"], CLUSTERS, most=None)


def all_slide_tensors(spark: SparkSession, sf: str) -> DataFrame:
    """Dense tensors as long as the subject of most slides asks for; what a subject lacks is zero."""
    slides = _many_slides(spark, sf)
    x = tensors.packed(slides, ["total"], CLUSTERS, most=tensors.slide_count(slides))
    return rounded(x.select("subject", F.posexplode("x").alias("k", "value")), "value")


def ragged_tensors(spark: SparkSession, sf: str) -> DataFrame:
    """Each subject's tensor with its own number of slides."""
    x = tensors.packed(_many_slides(spark, sf), ["total"], CLUSTERS, most=None)
    return rounded(x.select("subject", "n_slides", F.posexplode("x").alias("k", "value")), "value")


def two_mode_contraction(spark: SparkSession, sf: str) -> DataFrame:
    """Tensors times known cluster and slide weights: what is left is a number for each feature."""
    x = tensors.packed(tensors.assemble(views.dense_objects(spark, sf), DENSE), DENSE)
    z = tensors.contraction(F.col("x"), (2, len(DENSE), 2), {"g": list(ALPHA), "s": list(GAMMA)})
    return rounded(x.select("subject", F.posexplode(z).alias("j", "value")), "value", n=5)


def _price_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects with their mean price and tax, their outcome and a fold by their number."""
    a = screen.naive_average(views.dense_objects(spark, sf).where("excluded = 0"), DENSE).join(views.dense_outcomes(spark, sf), "subject")
    return a.select("subject", "price", "y", F.array("price").alias("x"), (F.col("subject") % 5).cast("int").alias("fold"))


def fold_fits(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Least squares on all folds but one, for each fold; the fit carries the fold that it has not seen."""
    folds = fold_moments(rows, ["price", "y"], "fold")
    total = summed(folds)
    records = [(*fits.record(f"without {k}", total - m, solvers.least_squares(total - m)[1], ["price"]), k) for k, m in folds.items()]
    return fits.table_of(spark, records, "fold int")


def fold_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Each subject's prediction by the fit that has not seen it."""
    rows = _price_folds(spark, sf)
    return rounded(fits.predict(fold_fits(spark, rows), rows, on=["fold"]).select("subject", "fold", "y_hat"), "y_hat", n=3)


def fold_errors(spark: SparkSession, sf: str) -> DataFrame:
    rows = _price_folds(spark, sf)
    return rounded(fits.errors(fits.predict(fold_fits(spark, rows), rows, on=["fold"]), ["fold"]), "mse", n=2)


def exact_medians(spark: SparkSession, sf: str) -> DataFrame:
    """Medians of prices by line status, two large groups, by ranges that narrow."""
    li = table(spark, sf, "lineitem").select("l_linestatus", F.col("l_extendedprice").alias("value"))
    return rounded(exact_median(li, ["l_linestatus"], limit=1_000), "median", n=4)


def clustering_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The write-up of a clustering as items and values: subjects, slides, objects, cluster sizes and shares, subjects by slides."""
    o = views.dense_objects(spark, sf).where("excluded = 0")
    n = o.agg(F.count_distinct("subject").alias("subjects"), F.count_distinct("subject", "slide").alias("slides"), F.count("*").alias("objects"), *(F.count_if(F.col("label") == g).alias(f"cluster {g}") for g in (1, 2)))
    share = [F.struct(F.lit(f"share {g}").alias("item"), R(F.col(f"cluster {g}") / F.col("objects")).alias("value")) for g in (1, 2)]
    whole = n.select(F.inline(F.array(*(F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in n.columns), *share)))
    slides = o.groupBy("subject").agg(F.count_distinct("slide").alias("n")).groupBy("n").agg(F.count("*").cast("double").alias("value"))
    return whole.union(slides.select(F.concat(F.lit("subjects of slides "), F.col("n").cast("string")), "value"))


def nonzero_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features of which any cell's first gradient is beyond 20."""
    cells = _gradients(spark, sf).select("g", "j", "s", F.when(F.abs("grad") > 20, F.col("grad")).otherwise(0.0).alias("coef"))
    return selection.nonzero_features(cells)


def tau_on_norms(spark: SparkSession, sf: str) -> DataFrame:
    """Block means of the first gradient, those of a block norm under the adaptive threshold set to zero."""
    tau = selection.adaptive_threshold(_residuals(spark, sf).withColumn("all", F.lit(0)), ["all"], 40)  # one row
    blocks = _gradients(spark, sf).groupBy("j").agg(F.avg("grad").alias("beta"), F.sqrt(F.sum(F.col("grad") * F.col("grad"))).alias("norm"))
    return rounded(selection.thresholded(blocks.crossJoin(F.broadcast(tau)), F.col("tau"), size="norm").select("j", "beta"), "beta", n=4)


def normalized_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    """Selected coefficients over their L1 norm, the largest positive, as a plot shows them."""
    blocks = _gradients(spark, sf).groupBy("j").agg(F.avg("grad").alias("beta"))
    one = blocks.agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "beta"))), lambda c: c.beta).alias("coefficients"), F.transform(F.array_sort(F.collect_list("j")), lambda j: j.cast("string")).alias("features"))  # four rows
    return rounded(fits.selected(one.withColumn("fit", F.lit("gradient"))).select("feature", "normalized"), "normalized", n=5)


def section_breaks(spark: SparkSession, sf: str) -> DataFrame:
    """The table of brands and sizes with their parts, and where a new brand begins."""
    p = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return selection.section_breaks(p, ["p_brand"], ["p_brand", "p_size"]).withColumn("n", F.col("n").cast("long"))


def rounded_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Objects of each slide that a share of an eighth takes, halves to the even number."""
    s = tensors.slide_statistics(views.sparse_objects(spark, sf), ["total"])
    return s.select("subject", "slide", arrays.half_even(F.col("n") / 8.0).cast("int").alias("taken"), arrays.half_even(F.col("n") / 8.0, 2).alias("eighth"))


def group_lasso_uncentred(spark: SparkSession, sf: str) -> DataFrame:
    """Penalties by the error of predictions with the fit's own intercept, neither side centred by the test rows; the spread rule chooses."""
    folds = moments_of(selection.hash_folds(design(spark, sf), "subject"), len(MODES["j"]))
    total = summed(folds)
    grid = solvers.penalty_grid(solvers.largest_penalty(total, MODES["j"]))
    rows = []
    for lam in grid:
        errors = []
        for m in folds.values():
            intercept, b = solvers.group_lasso(total - m, MODES["j"], float(lam))
            errors.append(solvers.error(m, b, centred=False, shift=intercept))
        rows.append(float(np.mean(errors)))
    errors = np.array(rows)
    spread = selection.lambda_spread(grid, errors)
    return spark.createDataFrame([(float(lam), float(e), k == selection.least(errors), bool(lam == spread)) for k, (lam, e) in enumerate(zip(grid, errors))], "lam double, cv_mse double, chosen boolean, spread_rule boolean")


def rank1_redrawn_folds(spark: SparkSession, sf: str) -> DataFrame:
    """The rank-one fit, its folds drawn anew for each penalty; all folds' moments come from one pass."""
    x, names = columns(design(spark, sf), len(MODES["j"]))
    sets = fold_set_moments(x, [*names, "y"], [F.pmod(F.xxhash64(F.lit(42 + k), "subject"), F.lit(5)) for k in range(15)])
    total = summed(sets[0])
    grid = np.geomspace(1e-4, 1.0, 15) * total.covariance[-1, -1] ** 0.5
    errors, _ = selection.cross_validation(spark, sets, grid, selection.fit_alternating(MODES))
    lam = float(grid[selection.least(errors)])
    v = selection.restarts(spark, total, MODES, lam)
    rows = [(mode, k, float(e), lam, float(errors.min())) for mode, vec in v.items() for k, e in enumerate(vec)]
    return spark.createDataFrame(rows, "mode string, k int, coef double, lam double, cv_mse double")


def rank1_oracle(spark: SparkSession, sf: str) -> DataFrame:
    """The lasso of the features' vector where cluster and slide weights are known: tensors are contracted by both, then fitted over the penalties."""
    z = tensors.contraction(F.col("x"), (2, len(DENSE), 2), {"g": list(ALPHA), "s": list(GAMMA)})
    x, names = columns(design(spark, sf).withColumn("x", z), len(DENSE))
    folds = fold_moments(selection.hash_folds(x, "subject"), [*names, "y"], "fold")
    total = summed(folds)
    grid = np.geomspace(1e-4, 1.0, 15) * total.covariance[-1, -1] ** 0.5
    errors, betas = selection.cross_validation(spark, folds, grid, selection.fit_lasso(), centred=False)
    best = selection.least(errors)
    return spark.createDataFrame([(DENSE[j], float(b), float(grid[best]), float(errors[best])) for j, b in enumerate(betas[best])], "feature string, coef double, lam double, cv_mse double")


def paired_design(spark: SparkSession, sf: str, sigma: float = 1.0, reps: int = 1) -> DataFrame:
    """Bootstrap draws of tensors over their deviations: x with noise on every entry, x_true without, and y = <B, x_true> and noise, with B on price and tax."""
    own, names = columns(design(spark, sf), len(MODES["j"]))
    scale = own.agg(*(F.stddev_pop(c) for c in names)).first()
    unit = own.select("subject", F.array(*(F.col(c) / (s if s and s > 1e-10 else 1.0) for c, s in zip(names, scale))).alias("x_true"))
    drawn = selection.bootstrap(unit, "subject", reps)
    b = F.array(*map(F.lit, truth().tolist()))
    return drawn.withColumns({"x": noisy(F.col("x_true"), sigma, 43, F.col("rep"), F.col("draw")), "y": arrays.dot(F.col("x_true"), b) + normal(44, F.col("rep"), F.col("draw"))})


def truth() -> np.ndarray:
    return np.where(np.isin(MODES["j"], [1, 3]), 1.0 + MODES["g"] + 2 * MODES["s"], 0.0)


def paired_moments(rows: DataFrame, size: int) -> Moments:
    """Moments of x, x_true and y side by side: a fit on either tensor can be judged on the other, from one pass."""
    wide = rows.select(*(F.get(c, k).alias(f"{c}{k}") for c in ("x", "x_true") for k in range(size)), "y")
    return fold_moments(wide, wide.columns)[0]


def paired_oracle(spark: SparkSession, sf: str) -> DataFrame:
    """A group lasso of almost no penalty on the noise-free tensors' true features, and its errors on the noise-free and on the noisy tensors."""
    d = len(MODES["j"])
    m = paired_moments(paired_design(spark, sf), d)
    keep = np.flatnonzero(truth())
    clean, noisy_ = m.picked([*(d + keep), 2 * d]), m.picked([*keep, 2 * d])
    feature = np.unique(MODES["j"][keep], return_inverse=True)[1]
    intercept, b = solvers.group_lasso(clean, feature, 1e-6)
    on = [solvers.error(x, b, centred=False, shift=intercept) for x in (clean, noisy_)]
    rows = [(DENSE[MODES["j"][k]], int(MODES["g"][k]), int(MODES["s"][k]), float(v), float(intercept), *map(float, on)) for k, v in zip(keep, b)]
    return spark.createDataFrame(rows, "feature string, g int, s int, coef double, intercept double, mse_true double, mse_noisy double")


def _study(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A study of one cohort: fits, their selected features, and the drawn rows with ``test``.

    Subjects are drawn with replacement and split; on the training rows the tensor's group lasso, the two-mode fit of pooled clusters and the plain lasso of
    grand means choose their penalties over the same folds. Features of the first count as selected by their block's norm against the adaptive threshold.
    """
    q, d = len(DENSE), len(MODES["j"])
    pooled = tensors.pooled_average(views.dense_objects(spark, sf), DENSE).groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "j", "value"))), lambda c: c.value).alias("x_clusters"))
    own = design(spark, sf).join(pooled, "subject").withColumn("x_naive", tensors.contraction(F.col("x"), (2, q, 2), {"g": [0.5, 0.5], "s": [0.5, 0.5]})).withColumnRenamed("x", "x_tensor")
    drawn = selection.hash_folds(selection.split(selection.bootstrap(own, "subject"), "draw"), "draw", seed=7)
    wide = drawn.where(~F.col("test")).select("fold", *(F.get(c, k).alias(f"{c}{k}") for c, n in (("x_tensor", d), ("x_clusters", 2 * q), ("x_naive", q)) for k in range(n)), "y")
    every = fold_moments(wide, wide.columns[1:], "fold")
    last = d + 3 * q
    part = lambda a, n: {k: m.picked([*range(a, a + n), last]) for k, m in every.items()}
    two = {"g": np.arange(2 * q) // q, "j": np.arange(2 * q) % q}
    records, chosen = [], []
    for name, folds, fit in (("tensor", part(0, d), selection.fit_group(MODES["j"])), ("clusters", part(d, 2 * q), selection.fit_alternating(two)), ("naive", part(d + 2 * q, q), selection.fit_lasso())):
        total = summed(folds)
        if name == "tensor":
            grid = solvers.penalty_grid(solvers.largest_penalty(total, MODES["j"]))
        else:
            grid = selection.lasso_path(total) if name == "naive" else np.geomspace(1e-4, 1.0, 15) * total.covariance[-1, -1] ** 0.5
        errors, betas = selection.cross_validation(spark, folds, grid, fit)
        best = selection.least(errors)
        b = betas[best]
        if name == "clusters":
            b = solvers.coefficients(selection.restarts(spark, total, two, float(grid[best])), two)
        by = {"tensor": [f"{DENSE[j]}.{g}.{s}" for g, j, s in zip(*(MODES[m] for m in "gjs"))], "clusters": [f"{DENSE[j]}.{g}" for g, j in zip(two["g"], two["j"])], "naive": DENSE}[name]
        records.append(fits.record(name, total, b, by, float(grid[best]), float(errors[best])))
        beta = b if name == "naive" else np.bincount(two["j"], weights=b) if name == "clusters" else np.bincount(MODES["j"], weights=b) / np.bincount(MODES["j"])
        if name == "tensor":
            tau = np.sqrt(solvers.error(total, b) * total.n / max(total.n - 1, 1)) * np.sqrt(2 * np.log(q) / total.n)
            beta = np.where(solvers.block_norms(b, MODES["j"]) < tau, 0.0, beta)
        chosen.append((name, DENSE, [float(v) for v in beta]))
    return fits.table_of(spark, records), fits.selected(spark.createDataFrame(chosen, "fit string, features array<string>, coefficients array<double>")), drawn


def study_results(spark: SparkSession, sf: str) -> DataFrame:
    """The result table: each estimator's penalty, errors by cross-validation, on training and on test rows, and how many features it selects."""
    stored, picked, drawn = _study(spark, sf)
    rows = drawn.select("draw", "y", "test", F.inline(F.array(*(F.struct(F.lit(n).alias("fit"), F.col(f"x_{n}").alias("x")) for n in ("tensor", "clusters", "naive")))))
    errors = fits.errors(fits.predict(stored, rows, on=["fit"]), ["fit", "test"])
    side = lambda test, c: F.max(F.when(F.col("test") == test, F.col(c)))
    by = errors.groupBy("fit").agg(side(False, "n").alias("n_train"), side(True, "n").alias("n_test"), side(False, "mse").alias("train_mse"), side(True, "mse").alias("test_mse"))
    number = picked.groupBy("fit").agg(F.count("*").alias("n_selected"))
    return stored.select("fit", "lam", "cv_mse").join(by, "fit").join(number, "fit", "left").fillna(0, ["n_selected"])


def study_selected(spark: SparkSession, sf: str) -> DataFrame:
    """Each estimator's selected features with their coefficients, as they are and normalized."""
    return _study(spark, sf)[1]


def study_report(results: DataFrame, selected: DataFrame) -> DataFrame:
    """The write-up of a study as lines of text in their order (line, text): the table of results, then each estimator's selected features."""
    order = F.when(F.col("fit") == "tensor", 0).when(F.col("fit") == "clusters", 1).otherwise(2)
    head = results.sparkSession.createDataFrame([(0, 0, "", f"{'Estimator':<10} {'Lambda':>10} {'CV-MSE':>14} {'Train MSE':>14} {'Test MSE':>14} {'Selected':>9}")], "part int, k int, tie string, text string")
    table_ = results.select(F.lit(1).alias("part"), order.alias("k"), F.lit("").alias("tie"), F.format_string("%-10s %10.4f %14.4f %14.4f %14.4f %9d", "fit", "lam", "cv_mse", "train_mse", "test_mse", "n_selected").alias("text"))
    features = selected.select(F.lit(2).alias("part"), order.alias("k"), F.concat("fit", "feature").alias("tie"), F.format_string("%s: %+.4f  %s", "fit", "normalized", "feature").alias("text"))
    lines = head.union(table_).union(features)
    return selection.numbered(lines, "part", "k", "tie").select(F.col("place").alias("line"), "text")


def oracle_sql() -> dict[str, str]:
    o = oracles
    wide = "w AS (SELECT vec_id, list_concat(CAST(embedding AS DOUBLE[]), [embedding[1]::DOUBLE * 2 + embedding[2]::DOUBLE * 0.1, embedding[1]::DOUBLE - embedding[3]::DOUBLE * 0.05, -embedding[11]::DOUBLE + embedding[12]::DOUBLE * 0.2]) AS v FROM embeddings), cells AS (SELECT vec_id, unnest(range(1, 68)) AS i, unnest(v) AS x FROM w), nm AS (SELECT i, CASE WHEN i <= 64 THEN 'e' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') ELSE 'x' || (i - 64) END AS f FROM range(1, 68) t(i))"
    slides = "obj AS (SELECT o_custkey AS subject, o_orderpriority AS slide, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS label, o_totalprice AS total FROM orders), st AS (SELECT subject, slide, " + ", ".join(f"sum(CASE WHEN label = {g} THEN total ELSE 0 END) / count(total) AS v{g - 1}" for g in CLUSTERS) + " FROM obj GROUP BY 1, 2), pl AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY slide) - 1 AS s, count(*) OVER (PARTITION BY subject) AS n FROM st), pad AS (SELECT * FROM pl UNION ALL SELECT subject, slide, v0, v1, v2, 1, n FROM pl WHERE n = 1), cells AS (" + " UNION ALL ".join(f"SELECT subject, {g} AS g, s, v{g} AS value FROM pad" for g in range(3)) + ")"
    price = o.NAIVE + ", rows_ AS (SELECT subject, price, s_acctbal AS y, subject % 5 AS fold FROM av JOIN supplier ON s_suppkey = subject), fit AS (SELECT k, covar_pop(price, y) / var_pop(price) AS b, avg(price) AS mx, avg(y) AS my FROM rows_, range(5) t(k) WHERE fold <> k GROUP BY k), hat AS (SELECT subject, CAST(fold AS INT) AS fold, y, my + b * (price - mx) AS y_hat FROM rows_ JOIN fit ON k = fold)"
    count = lambda item, value: f"SELECT '{item}' AS item, CAST({value} AS DOUBLE) AS value FROM obj"
    return {
        "wide_correlations": f"WITH {wide} SELECT p.f AS f1, q.f AS f2, round(covar_pop(a.x, b.x) / (stddev_pop(a.x) * stddev_pop(b.x)), 5) AS r FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND a.i < b.i JOIN nm p ON p.i = a.i JOIN nm q ON q.i = b.i GROUP BY 1, 2",
        "candidate_matrix": f"WITH {o.RANKED}, c AS (SELECT feature FROM ranked WHERE m < 0.8) SELECT f1, f2, round(r, 6) AS r FROM pairs WHERE f1 IN (FROM c) AND f2 IN (FROM c)",
        "all_slide_tensors": f"WITH {slides}, size AS (SELECT max(s) + 1 AS n FROM pad), grid AS (SELECT DISTINCT subject, g, s FROM (SELECT DISTINCT subject FROM pad), range(3) a(g), range((SELECT n FROM size)) b(s)) SELECT grid.subject, CAST(grid.g * (SELECT n FROM size) + grid.s AS INT) AS k, round(coalesce(value, 0), 6) AS value FROM grid LEFT JOIN cells USING (subject, g, s)",
        "ragged_tensors": f"WITH {slides} SELECT subject, CAST(m AS INT) AS n_slides, CAST(g * m + s AS INT) AS k, round(value, 6) AS value FROM cells JOIN (SELECT subject, max(s) + 1 AS m FROM pad GROUP BY 1) USING (subject)",
        "two_mode_contraction": f"WITH {o.CELLS} SELECT subject, j, round(sum(value * CASE g WHEN 0 THEN 1.0 ELSE 2.0 END / 3 * CASE s WHEN 0 THEN 2.0 ELSE 1.0 END / 3), 5) AS value FROM cells GROUP BY 1, 2",
        "fold_predictions": f"WITH {price} SELECT subject, fold, round(y_hat, 3) AS y_hat FROM hat",
        "fold_errors": f"WITH {price} SELECT fold, count(*) AS n, round(avg((y - y_hat) * (y - y_hat)), 2) AS mse FROM hat GROUP BY 1",
        "exact_medians": "SELECT l_linestatus, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY 1",
        "clustering_summary": f"WITH {o.DENSE} " + " UNION ALL ".join([count("subjects", "count(DISTINCT subject)"), count("slides", "count(DISTINCT (subject, slide))"), count("objects", "count(*)"), *(count(f"cluster {g}", f"count(*) FILTER (WHERE label = {g})") for g in (1, 2)), *(count(f"share {g}", f"round((count(*) FILTER (WHERE label = {g})) / count(*), 6)") for g in (1, 2)), "SELECT 'subjects of slides ' || n, CAST(count(*) AS DOUBLE) FROM (SELECT count(DISTINCT slide) AS n FROM obj GROUP BY subject) GROUP BY n"]),
        "section_breaks": "WITH p AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, p_size, n, row_number() OVER w - 1 AS place, coalesce(lag(p_brand) OVER w <> p_brand, true) AS new_section FROM p WINDOW w AS (ORDER BY p_brand, p_size)",
        "rounded_shares": f"WITH {o.SPARSE}, st AS (SELECT subject, slide, count(*) AS n FROM obj GROUP BY 1, 2) SELECT subject, slide, CAST(round_even(n / 8.0, 0) AS INT) AS taken, round_even(n / 8.0, 2) AS eighth FROM st",
        "nonzero_features": f"WITH {o.GRAD} SELECT j FROM gr GROUP BY j HAVING max(abs(grad)) > 20",
        "tau_on_norms": f"WITH {o.GRAD}, {o.RESID}, tau AS (SELECT stddev_samp(r) * sqrt(2 * ln(40.0) / count(r)) AS tau FROM res) SELECT j, round(CASE WHEN norm < tau THEN 0.0 ELSE mean END, 4) AS beta FROM nm, tau",
        "normalized_coefficients": f"WITH {o.GRAD}, sz AS (SELECT sum(abs(mean)) AS size, arg_max(sign(mean), abs(mean)) AS side FROM nm WHERE abs(mean) > 1e-6) SELECT CAST(j AS VARCHAR) AS feature, round(mean / size * side, 5) AS normalized FROM nm, sz WHERE abs(mean) > 1e-6",
    }
