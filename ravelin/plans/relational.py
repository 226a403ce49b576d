"""Registered queries that SQL expresses too: each applies an operator to a view of the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions import arrays, keys
from ravelin.operators import features as screen
from ravelin.operators import selection, tensors
from ravelin.runtime import small, table
from ravelin.sources import views
from ravelin.sources.slides import missing_settings as missing

R = lambda c, n=6: F.round(c, n)
DENSE = list(views.DENSE)


def rounded(df: DataFrame, *columns: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: R(c, n) for c in columns})


def dense(spark: SparkSession, sf: str) -> DataFrame:
    return views.dense_objects(spark, sf).where("excluded = 0")


def naive_average(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(screen.naive_average(dense(spark, sf), DENSE), *DENSE)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return screen.correlation_pairs(screen.naive_average(dense(spark, sf), DENSE), DENSE)


def corr_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_pairs(spark, sf).select("f1", "f2", "r"), "r")


def max_abs_corr_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(screen.ranked(_pairs(spark, sf)).select("feature", "max_abs_corr", "rank"), "max_abs_corr")


def independent_topk(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf)
    return rounded(screen.sub_matrix(pairs, screen.most_independent(pairs, 3)).select("f1", "f2", "r"), "r")


def candidate_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(screen.candidates(_pairs(spark, sf), 0.8).select("feature", "max_abs_corr"), "max_abs_corr")


def corr_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Pruning of the dense features with derived ones, so that there is something to drop."""
    derived = dense(spark, sf).withColumns({"price2": F.col("price") * 2 + F.col("quantity"), "price3": F.col("price") - 50 * F.col("quantity")})
    names = [*DENSE, "price2", "price3"]
    stay, gone = screen.prune(screen.correlation_pairs(screen.naive_average(derived, names), names), names, 0.9)
    order = {f: k for k, f in enumerate(gone)}
    return spark.createDataFrame([(f, order.get(f, -1)) for f in names], "feature string, dropped_at int")


def cluster_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tensors.slide_statistics(dense(spark, sf), DENSE).select("subject", "slide", "n", "w1", "w2"), "w1", "w2")


def cluster_means(spark: SparkSession, sf: str) -> DataFrame:
    s = tensors.slide_statistics(dense(spark, sf), DENSE)
    return rounded(s.select("subject", "slide", "mean1_price", "mean2_price", "mean1_tax", "mean2_tax"), "mean1_price", "mean2_price", "mean1_tax", "mean2_tax")


def weighted_cluster_avg(spark: SparkSession, sf: str) -> DataFrame:
    s = tensors.slide_statistics(views.sparse_objects(spark, sf), ["total"])
    return rounded(s.select("subject", "slide", "weighted1_total", "weighted2_total"), "weighted1_total", "weighted2_total")


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return tensors.tensor_rows(tensors.assemble(views.dense_objects(spark, sf), DENSE), DENSE)


def tensor_long(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_cells(spark, sf), "value")


def one_slide_padding(spark: SparkSession, sf: str) -> DataFrame:
    slides = tensors.assemble(views.sparse_objects(spark, sf), ["total"])
    return slides.select("subject", F.col("s").cast("int").alias("s"), "slide", "n", F.col("copied").cast("int").alias("copied"))


def two_slide_subjects(spark: SparkSession, sf: str) -> DataFrame:
    return views.sparse_objects(spark, sf).groupBy("subject").agg(F.countDistinct("slide").alias("n_slides")).where("n_slides = 2")


def slides_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return views.sparse_objects(spark, sf).groupBy("subject").agg(F.countDistinct("slide").alias("n_slides")).groupBy("n_slides").agg(F.count("*").alias("n_subjects"))


def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    o = dense(spark, sf)
    return o.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n1"), R(F.avg((F.col("label") == 1).cast("double"))).alias("share1"))


def pooled_cluster_avg(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tensors.pooled_average(views.sparse_objects(spark, sf), ["total"]).select("subject", "g", "value"), "value")


def slide_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_cells(spark, sf).groupBy("subject", "g", "j").agg(F.avg("value").alias("value")), "value")


def grand_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_cells(spark, sf).groupBy("subject", "j").agg(F.avg("value").alias("value")), "value")


def outcome_match_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose key is spelled with a blank in one table and, for odd ids, with a dash in the other."""
    c = table(spark, sf, "customer")
    subjects = c.select(F.concat(F.lit("C "), F.col("c_custkey").cast("string")).alias("subject"))
    dash = F.when(F.col("c_custkey") % 2 == 1, "-").otherwise(" ")
    o = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    outcomes = o.select(F.concat(F.lit("C"), dash, F.col("c_custkey").cast("string"), F.lit(" - "), F.col("o_orderpriority")).alias("name"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("y"), F.col("o_orderkey").alias("place"))
    return tensors.matched(subjects, outcomes).select("subject", "y")


def subject_key_parse(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws("_", "p_brand", F.col("p_size").cast("string"), F.lit("PAS")).alias("a"), F.concat_ws(" ", "p_brand", F.lit("PAS")).alias("b"))
    return p.select("p_partkey", keys.subject_key(F.col("a")).alias("subject_a"), keys.slide_number(F.col("a")).alias("slide_a"), keys.subject_key(F.col("b")).alias("subject_b"))


def contiguous_folds(spark: SparkSession, sf: str) -> DataFrame:
    return selection.block_folds(table(spark, sf, "customer").select("c_custkey"), "c_custkey")


def standardize(spark: SparkSession, sf: str) -> DataFrame:
    """Column means and guarded population deviations of the naive averages, and each subject's scaled price."""
    a = screen.naive_average(dense(spark, sf), DENSE)
    m = a.agg(F.avg("price").alias("m"), arrays.guarded(F.stddev_pop("price")).alias("s"))
    return a.crossJoin(F.broadcast(m)).select("subject", R((F.col("price") - F.col("m")) / F.col("s")).alias("z"))  # one row


def group_scale(spark: SparkSession, sf: str) -> DataFrame:
    per = _cells(spark, sf).groupBy("subject", "j").agg(F.sum(F.col("value") * F.col("value")).alias("v"))
    return per.groupBy("j").agg(R(arrays.guarded(F.sqrt(F.avg("v"))), 5).alias("gnorm"))


def _gradients(spark: SparkSession, sf: str) -> DataFrame:
    """Covariance with the outcome of each tensor cell over its feature's scale."""
    x = tensors.packed(tensors.assemble(views.dense_objects(spark, sf), DENSE), DENSE).join(views.dense_outcomes(spark, sf), "subject")
    at = lambda g, j, s: F.get("x", (g * len(DENSE) + j) * 2 + s)
    cells = [(g, j, s) for j in range(len(DENSE)) for g in (0, 1) for s in (0, 1)]
    # One aggregate over packed tensors, as wide as a tensor; then one row.
    norm = lambda j: arrays.guarded(F.sqrt(F.avg(sum((at(g, j, s) * at(g, j, s) for g in (0, 1) for s in (0, 1)), F.lit(0.0)))))
    whole = x.agg(*(F.covar_pop(at(*c), "y").alias("cov_%d_%d_%d" % c) for c in cells), *(norm(j).alias(f"norm_{j}") for j in range(len(DENSE))))
    rows = [F.struct(F.lit(g).alias("g"), F.lit(j).alias("j"), F.lit(s).alias("s"), (F.col(f"cov_{g}_{j}_{s}") / F.col(f"norm_{j}")).alias("grad")) for g, j, s in cells]
    return whole.select(F.inline(F.array(*rows)))


def lambda_max_group(spark: SparkSession, sf: str) -> DataFrame:
    norms = _gradients(spark, sf).groupBy("j").agg(F.sqrt(F.sum(F.col("grad") * F.col("grad"))).alias("norm"))
    return norms.agg(R(F.max("norm"), 5).alias("lambda_max"))


def lambda_grid(spark: SparkSession, sf: str) -> DataFrame:
    top = _gradients(spark, sf).groupBy("j").agg(F.sqrt(F.sum(F.col("grad") * F.col("grad"))).alias("norm")).agg(F.max("norm").alias("top"))
    lo, hi = F.greatest(F.col("top") / 1000, F.lit(1e-8)), F.greatest(F.col("top"), F.lit(1e-4))
    return top.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(14)), lambda k: F.exp(F.log(lo) + (F.log(hi) - F.log(lo)) * k / 14)))).select(F.col("pos").alias("k"), R("col").alias("lam"))


def block_norms(spark: SparkSession, sf: str) -> DataFrame:
    return _gradients(spark, sf).groupBy("j").agg(R(F.sqrt(F.sum(F.col("grad") * F.col("grad"))), 5).alias("norm"), R(F.avg("grad"), 5).alias("mean"))


def soft_threshold_step(spark: SparkSession, sf: str) -> DataFrame:
    """One proximal step on the blocks of the first gradient, by half the largest norm."""
    blocks = _gradients(spark, sf).groupBy("j").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "s", "grad"))), lambda c: c.grad).alias("b"))
    norm = F.sqrt(arrays.total(F.transform("b", lambda v: v * v)))
    top = blocks.agg((F.max(norm) / 2).alias("by"))
    return blocks.crossJoin(F.broadcast(top)).select("j", F.posexplode(arrays.block_soft(F.col("b"), F.col("by")))).select("j", F.col("pos").alias("k"), R("col", 5).alias("value"))


def tensor_inner_product(spark: SparkSession, sf: str) -> DataFrame:
    """<B, X> with coefficients 1 / (1 + g + j + s)."""
    b = spark.createDataFrame([(g, j, s, 1.0 / (1 + g + j + s)) for g in (0, 1) for j in range(4) for s in (0, 1)], "g int, j int, s int, coef double")
    return rounded(tensors.inner_products(_cells(spark, sf), b), "y_hat", n=4)


def tensor_contract_mode(spark: SparkSession, sf: str) -> DataFrame:
    w = spark.createDataFrame([(0, 1 / 3), (1, 2 / 3)], "g int, w double")
    return rounded(tensors.contracted(_cells(spark, sf), w, "g"), "value", n=5)


def kronecker(spark: SparkSession, sf: str) -> DataFrame:
    s = tensors.slide_statistics(dense(spark, sf), ["tax"])
    k = arrays.kronecker(F.array("w1", "w2"), F.array("weighted1_tax", "weighted2_tax"))
    return s.select("subject", "slide", F.posexplode(k)).select("subject", "slide", F.col("pos").alias("k"), R("col").alias("value"))


def l1_normalize(spark: SparkSession, sf: str) -> DataFrame:
    a = screen.naive_average(dense(spark, sf), ["quantity", "discount", "tax"])
    v = F.array(-F.col("quantity"), F.col("discount"), F.col("tax"))
    return a.select("subject", F.posexplode(arrays.l1_normalized(v))).select("subject", F.col("pos").alias("k"), R("col").alias("value"))


def _slopes(spark: SparkSession, sf: str) -> DataFrame:
    """Per nation, the least-squares slope of the outcome on each supplier average."""
    a = screen.naive_average(dense(spark, sf), DENSE).join(table(spark, sf, "supplier"), F.col("subject") == F.col("s_suppkey"))
    cells = a.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("y"), F.inline(F.array(*(F.struct(F.lit(j).alias("j"), F.col(f).alias("x")) for j, f in enumerate(DENSE)))))
    v = F.var_pop("x")
    return cells.groupBy("nation", "j").agg(F.when(v > 1e-12, F.covar_pop("x", "y") / F.nullif(v, F.lit(0.0))).otherwise(0.0).alias("slope"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n"))


def simple_ols(spark: SparkSession, sf: str) -> DataFrame:
    return _slopes(spark, sf).select("nation", "j", "n", R("slope", 3).alias("slope"), R(F.col("my") - F.col("slope") * F.col("mx"), 2).alias("intercept"))


def hard_threshold_variants(spark: SparkSession, sf: str) -> DataFrame:
    """The block means and norms of the first gradient at four thresholds each; the last one cuts some of them."""
    blocks = _gradients(spark, sf).groupBy("j").agg(F.avg("grad").alias("beta"), F.sqrt(F.sum(F.col("grad") * F.col("grad"))).alias("norm"))
    cuts = spark.createDataFrame([(0.001,), (0.01,), (0.02,), (50.0,)], "thr double")
    every = blocks.crossJoin(F.broadcast(cuts))  # four rows
    raw = selection.thresholded(every, F.col("thr")).withColumn("kind", F.lit("raw"))
    return raw.union(selection.thresholded(every, F.col("thr"), size="norm").withColumn("kind", F.lit("norm"))).select("j", "thr", "kind", R("beta", 4).alias("beta"))


def _residuals(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    fit = li.groupBy("l_returnflag").agg((F.covar_pop("l_quantity", "l_extendedprice") / F.var_pop("l_quantity")).alias("b"), F.avg("l_quantity").alias("mx"), F.avg("l_extendedprice").alias("my"))
    return li.join(F.broadcast(fit), "l_returnflag").select("l_returnflag", "l_suppkey", (F.col("l_extendedprice") - F.col("my") - F.col("b") * (F.col("l_quantity") - F.col("mx"))).alias("r"))  # a row a flag


def adaptive_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.adaptive_threshold(_residuals(spark, sf), ["l_returnflag"], 40), "tau", n=5)


def selection_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per nation, the slopes as a fit whose truth is the slopes over all nations of magnitude above 10."""
    s = _slopes(spark, sf)
    truth = s.groupBy("j").agg(F.avg("slope").alias("t")).select("j", F.when(F.abs("t") > 10, F.col("t")).otherwise(0.0).alias("truth"))
    fits = s.join(F.broadcast(truth), "j").select("nation", F.when(F.abs("slope") > 10, F.col("slope")).otherwise(0.0).alias("beta"), "truth")
    out = selection.selection_metrics(fits, ["nation"])
    return out.select("nation", R(F.nanvl("tpr", F.lit(-1.0))).alias("tpr"), R(F.nanvl("fpr", F.lit(-1.0))).alias("fpr"), R("l1", 5).alias("l1"))


def _errors(spark: SparkSession, sf: str) -> DataFrame:
    """A penalty curve for each return flag: mean squared residual of a shrunk fit, by share of shrinking and fold of supplier."""
    grid = spark.createDataFrame([(k, 0.05 * (k + 1)) for k in range(10)], "k int, lam double")
    r = _residuals(spark, sf).withColumn("fold", (F.col("l_suppkey") % 5).cast("int"))
    per = r.groupBy("l_returnflag", "fold").agg(F.avg(F.col("r") * F.col("r")).alias("a"), F.avg("r").alias("m"))
    at = per.crossJoin(F.broadcast(grid))  # flags x folds x ten penalties
    mse = F.col("a") * (1 + (F.col("lam") - 0.2) * (F.col("lam") - 0.2)) + F.col("m") * F.col("lam")
    return at.groupBy("l_returnflag", "k", "lam").agg(F.avg(mse).alias("mse"))


def argmin_lambda(spark: SparkSession, sf: str) -> DataFrame:
    least = _errors(spark, sf).groupBy("l_returnflag").agg(F.min(F.struct("mse", "k", "lam")).alias("b"))
    return least.select("l_returnflag", "b.k", R("b.lam").alias("lam"), R(F.col("b.mse"), 2).alias("mse"), F.col("b.k").isin(0, 9).cast("int").alias("at_boundary"))


def lambda_spread_rule(spark: SparkSession, sf: str) -> DataFrame:
    e = _errors(spark, sf)
    lim = e.groupBy("l_returnflag").agg((F.min("mse") + F.stddev_pop("mse") / F.sqrt(F.lit(5.0))).alias("most"))
    return e.join(F.broadcast(lim), "l_returnflag").where("mse <= most").groupBy("l_returnflag").agg(R(F.max("lam")).alias("lam"))  # a row a flag


def metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value")).alias("value"))
    return rounded(selection.metric_summary(e, ["event_type"]), "mean", "median", n=5)


def missing_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Brand and size settings that no large order line has."""
    p = table(spark, sf, "part")
    grid = p.select("p_brand").distinct().crossJoin(small(p.select("p_size").distinct()))  # dimensions of the grid
    done = table(spark, sf, "lineitem").where("l_quantity >= 50").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return missing(grid, done, ["p_brand", "p_size"])


def centred_prediction(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions from tensors by coefficients 1 / (1 + place), about the means of tensors and outcomes."""
    packed = tensors.packed(tensors.assemble(views.dense_objects(spark, sf), DENSE), DENSE).join(views.dense_outcomes(spark, sf), "subject")
    return rounded(selection.centred_prediction(packed, [1.0 / (1 + k) for k in range(4 * len(DENSE))]).select("subject", "y_hat"), "y_hat", n=3)


def ratio_to_first(spark: SparkSession, sf: str) -> DataFrame:
    """Errors over the first estimator's, as plots show them."""
    e = _errors(spark, sf)
    w = Window.partitionBy("l_returnflag").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return e.select("l_returnflag", "k", R(F.col("mse") / F.first("mse").over(w)).alias("ratio"))


def outcome_statistics(spark: SparkSession, sf: str) -> DataFrame:
    o = views.dense_outcomes(spark, sf)
    return o.agg(R(F.avg("y"), 4).alias("mean"), R(F.stddev_pop("y"), 4).alias("sd"), F.min("y").alias("least"), F.max("y").alias("most"))
