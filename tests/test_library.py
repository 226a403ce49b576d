"""The core library against numpy, brute force and the registered SQL."""

import glob
import os
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ravelin.functions import arrays, keys
from ravelin.operators import features as screen
from ravelin.operators import mixture, selection, solvers, tensors
from ravelin.operators.moments import Moments, fold_moments, gram
from ravelin.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(frame):
    cols = sorted(frame.columns)
    norm = lambda v: None if v is None or v != v else (round(float(v), 6) + 0.0 if isinstance(v, (float, int, np.number)) else str(v))
    return sorted((tuple(norm(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(u == v or isinstance(u, float) and abs(u - v) <= 1e-4 * max(1, abs(v)) for u, v in zip(x, y))


def test_mixture_study(spark):
    """Sizes, shares and means of the labelled objects, put together again, are those of the objects."""
    from ravelin.sources import views

    got = catalog.queries()["mixture_fit"](spark, SF).toPandas()
    objects = views.dense_objects(spark, SF).where("excluded = 0").toPandas()
    assert got.n.sum() == len(objects) and np.allclose(got.w1 + got.w2, 1) and 0 < (got.n * got.w1).sum() < len(objects)
    for f in ("quantity", "price", "discount", "tax"):
        want = objects.groupby(["subject", "slide"])[f].mean()
        own = got.set_index(["subject", "slide"])
        assert np.allclose((own[f"weighted1_{f}"] + own[f"weighted2_{f}"])[want.index], want)


def test_threshold_search(spark):
    from ravelin.sources import views

    got = catalog.queries()["mixture_threshold_search"](spark, SF).toPandas()
    wide = views.wide_features(spark, SF).toPandas().drop(columns=["subject", "label"])
    r = np.triu(np.abs(np.corrcoef(wide.to_numpy().T)), 1) > got.threshold[0]
    left, gone = {(i, j) for i, j in zip(*np.nonzero(r))}, []
    while left:
        times = [sum(k in p for p in left) for k in range(wide.shape[1])]
        gone.append(times.index(max(times)))
        left = {p for p in left if gone[-1] not in p}
    assert {f for f, kept in zip(got.feature, got.kept) if not kept} == {wide.columns[k] for k in gone} and list(got.feature) == list(wide.columns) and got.log_likelihood.nunique() == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def moments(x, y):
    z = np.column_stack([x, y])
    shift = z.mean(0) + 0.1
    z = z - shift
    return Moments(len(z), z.sum(0), z.T @ z, shift)


def sample(seed=0, n=200, sign=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 24)) + 1
    modes = solvers.tensor_modes(2, 6, 2)
    b = np.where(np.isin(modes["j"], [1, 3]), 1.0 + modes["g"] + modes["s"], 0.0)
    return x, sign * (x @ b) + rng.standard_normal(n), modes, b


def test_lasso_optimality():
    x, y, _, _ = sample()
    m = moments(x, y)
    b = solvers.lasso(m, 0.2)
    slope = ((x - x.mean(0)) / x.std(0)).T @ (y - y.mean() - (x - x.mean(0)) @ b) / len(y)
    assert np.allclose(slope[b != 0], 0.1 * np.sign(b[b != 0]), atol=1e-6) and (np.abs(slope) <= 0.1 + 1e-6).all()


def test_group_lasso_optimality():
    x, y, modes, _ = sample()
    m, lam = moments(x, y), 0.3
    scale = solvers.block_scale(m, modes["j"])
    assert np.allclose(scale, np.sqrt([(x[:, modes["j"] == j] ** 2).sum(1).mean() for j in range(6)]))
    intercept, b = solvers.group_lasso(m, modes["j"], lam, rounds=20_000, tol=1e-10)
    slope = x.T @ (y - intercept - x @ b) / len(y) / scale[modes["j"]]
    norms = solvers.block_norms(slope, modes["j"])
    on = solvers.block_norms(b, modes["j"]) > 0
    assert np.allclose(norms[on], lam, atol=1e-5) and (norms <= lam + 1e-5).all() and on.any() and not on.all()
    top = solvers.largest_penalty(m, modes["j"])
    assert not solvers.group_lasso(m, modes["j"], top * 1.001)[1].any() and solvers.group_lasso(m, modes["j"], top * 0.9)[1].any()
    assert np.isclose(solvers.error(m, b), np.mean((y - y.mean() - (x - x.mean(0)) @ b) ** 2)) and np.isclose(solvers.error(m, b, False), np.mean((y - x @ b) ** 2))


@pytest.mark.parametrize("sign", [1, -1])
def test_alternating_keeps_the_sign(sign):
    rng = np.random.default_rng(3)
    x, modes = rng.standard_normal((300, 24)), solvers.tensor_modes(2, 6, 2)
    vec = {"g": np.array([1, 2]) / 3, "j": np.array([15.0, 0, -8, 0, 0, 0]), "s": np.array([2, 1]) / 3}
    y = sign * x @ solvers.coefficients(vec, modes) + 0.1 * rng.standard_normal(300)
    m = moments(x, y)
    start = {k: np.full(v.max() + 1, 1 / (v.max() + 1)) for k, v in modes.items()}
    v = solvers.alternating(m, modes, 0.01, start)
    assert np.corrcoef(x @ solvers.coefficients(v, modes), y)[0, 1] > 0.99 and set(np.flatnonzero(v["j"])) == {0, 2}
    two = {"p": modes["g"] * 2 + modes["s"], "j": modes["j"]}
    v2 = solvers.alternating(m, two, 0.01, {"p": np.full(4, 0.25), "j": np.full(6, 1 / 6)})
    assert np.corrcoef(x @ solvers.coefficients(v2, two), y)[0, 1] > 0.99
    # As the last scale is taken without its sign, two modes turn a negative association round.
    old = solvers.alternating(m, two, 0.01, {"p": np.full(4, 0.25), "j": np.full(6, 1 / 6)}, compat=True)
    unsigned = np.corrcoef(x @ solvers.coefficients(old, two), y)[0, 1]
    assert abs(unsigned) > 0.99 and unsigned * sign * np.sign(vec["j"].sum()) > 0


def test_moments_and_partitions(spark):
    x, y, modes, _ = sample(1, 90)
    rows = [(k, *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y))]
    names = [f"x{k}" for k in range(24)]
    df = spark.createDataFrame(rows, ["subject", *names, "y"])
    folded = selection.hash_folds(df, "subject")
    for parts in (1, 7):
        f = fold_moments(folded.repartition(parts), [*names, "y"], "fold")
        total = sum(list(f.values())[1:], list(f.values())[0])
        assert np.allclose(total.covariance, np.cov(np.column_stack([x, y]).T, ddof=0)) and total.n == 90
    errors = selection.cross_validated(f, np.array([0.1, 0.5]), selection.fit_group(modes["j"]))
    fold = {r.subject: r.fold for r in folded.select("subject", "fold").collect()}
    at, want = np.array([fold[k] for k in range(90)]), []
    for k in range(5):
        tr, te = at != k, at == k
        b = solvers.group_lasso(moments(x[tr], y[tr]), modes["j"], 0.5)[1]
        want.append(np.mean((y[te] - y[te].mean() - (x[te] - x[te].mean(0)) @ b) ** 2))
    assert np.isclose(errors[1], np.mean(want))
    spread, fits = selection.cross_validation(spark, f, np.array([0.1, 0.5]), selection.fit_group(modes["j"]))
    assert np.allclose(spread, errors) and np.allclose(fits[1], solvers.group_lasso(moments(x, y), modes["j"], 0.5)[1], atol=1e-4)
    assert gram(df.limit(0), names).n == 0


def test_correlations_and_pruning(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((80, 5))
    x = np.column_stack([x, x[:, 0] + 0.1 * x[:, 1], x[:, 0] - 0.1 * x[:, 2], np.ones(80)])
    names = [f"f{k}" for k in range(8)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], names)
    few, many = screen.correlation_pairs(df, names), screen.correlation_pairs(df, names, few=1)
    want = np.corrcoef(x[:, :7].T)
    for pairs in (few, many):
        got = {(r.i, r.j): r.r for r in pairs.collect()}
        assert all(np.isclose(got[i, j], want[i, j]) for i in range(7) for j in range(i + 1, 7)) and got[0, 7] is None
        stay, gone = screen.prune(pairs, names, 0.9)
        left = [names.index(f) for f in stay if f != "f7"]
        assert gone[0] == "f0" and all(abs(want[i, j]) <= 0.9 for i in left for j in left if i != j)
    assert [r.feature for r in screen.most_independent(few, 2).collect()] == [r.feature for r in screen.ranked(few).where("rank <= 2").orderBy("rank").collect()]


def test_tensor_of_odd_subjects(spark):
    """An empty cluster, one slide, three slides."""
    rows = [("a", "1", 0, 1, 2.0), ("a", "1", 0, 1, 4.0), ("a", "2", 0, 1, 6.0), ("a", "2", 0, 2, 8.0), ("a", "2", 1, 2, 99.0), ("b", "1", 0, 2, 5.0), ("c", "1", 0, 1, 1.0), ("c", "2", 0, 1, 2.0), ("c", "3", 0, 1, 3.0)]
    objects = spark.createDataFrame(rows, "subject string, slide string, excluded int, label int, f double")
    slides = tensors.assemble(objects, ["f"])
    x = {r.subject: list(r.x) for r in tensors.packed(slides, ["f"]).collect()}
    assert x == {"a": [3.0, 3.0, 0.0, 4.0], "b": [0.0, 0.0, 5.0, 5.0], "c": [1.0, 2.0, 0.0, 0.0]}
    cells = {(r.subject, r.g, r.j, r.s): r.value for r in tensors.tensor_rows(slides, ["f"]).collect()}
    assert all(cells[s, g, 0, k] == x[s][g * 2 + k] for s in x for g in (0, 1) for k in (0, 1))
    pooled = {(r.subject, r.g): r.value for r in tensors.pooled_average(objects, ["f"]).collect()}
    assert pooled["a", 0] == 3.0 and pooled["a", 1] == 2.0 and pooled["b", 0] == 0.0
    assert tensors.assemble(objects.limit(0), ["f"]).count() == 0


def test_keys(spark):
    cases = {"H19-00319_1_PAS": ("H19-00319", "1"), "H20-00927 1 PAS": ("H20-00927", "1"), "H22-16058 PAS": ("H22-16058", "H22-16058"), "PAS": ("", None)}
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    got = {r.name: (r.a, r.b) for r in df.select("name", keys.subject_key(F.col("name")).alias("a"), keys.slide_number(F.col("name")).alias("b")).collect()}
    assert got == cases
    one = spark.createDataFrame([("A 1 - x", 0.5)], "n string, s double").select(keys.outcome_key(F.col("n")), keys.repaired_key(F.lit("A 1")), keys.setting_code(F.col("s")), keys.short_label(F.lit("_Mean Red Nuclei_"), {"Mean ": "", "Nuclei": "N"}, "_"))
    assert tuple(one.first()) == ("A 1", "A-1", "05", "Red N")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3, allow_nan=False), min_size=1, max_size=6))
def test_normalized_vectors(spark, v):
    got = spark.range(1).select(arrays.l1_normalized(F.array(*map(F.lit, v))).alias("v"), arrays.kronecker(F.array(*map(F.lit, v)), F.array(F.lit(1.0), F.lit(2.0))).alias("k"), arrays.soft(F.lit(v[0]), F.lit(1.0)).alias("s")).first()
    want, _ = solvers.signed(np.array(v))
    assert np.allclose(got.v, want) and np.allclose(got.k, np.kron(v, [1, 2])) and np.isclose(got.s, np.sign(v[0]) * max(abs(v[0]) - 1, 0))


def test_folds_samples_splits(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    sizes = sorted(r["count"] for r in selection.block_folds(df, "k").groupBy("fold").count().collect())
    assert sizes == [20, 20, 20, 20, 23]
    assert [r.place for r in selection.numbered(df.repartition(5), "k").orderBy("k").collect()] == list(range(103))
    drawn = selection.bootstrap(df, "k", 2)
    assert drawn.count() == 206 and sorted(map(tuple, drawn.collect())) == sorted(map(tuple, selection.bootstrap(df.repartition(6), "k", 2).collect()))
    assert selection.split(df, "k").where("test").count() == 21
    assert {r.fold for r in selection.hash_folds(df, "k").collect()} == set(range(5))


def test_choices():
    grid, errors = np.array([1.0, 2.0, 4.0, 8.0]), np.array([3.0, 1.0, 1.0, 5.0])
    assert selection.least(errors) == 1 and not selection.at_boundary(grid, 1) and selection.at_boundary(grid, 3)
    assert selection.lambda_spread(grid, errors) == 4.0
    assert len(solvers.penalty_grid(0.0)) == 15 and solvers.penalty_grid(0.0)[-1] == 1e-4


def test_metrics(spark):
    rows = [("a", 1.0, 2.0), ("a", 0.0, 2.0), ("a", 1.0, 0.0), ("a", 0.0, 0.0), ("b", 1.0, 1.0), ("b", 1.0, 1.0), ("z", 0.0, 0.0)]
    got = {r.e: r for r in selection.selection_metrics(spark.createDataFrame(rows, "e string, beta double, truth double"), ["e"]).collect()}
    assert (got["a"].tpr, got["a"].fpr, got["a"].l1) == (0.5, 0.5, 1.0) and got["b"].fpr != got["b"].fpr and got["b"].l1 == 0 and got["z"].tpr != got["z"].tpr
    blocks = spark.createDataFrame([(0, 0.01, 0.5), (1, 0.3, 0.001)], "j int, beta double, norm double")
    assert [r.beta for r in selection.thresholded(blocks, F.lit(0.01)).orderBy("j").collect()] == [0.01, 0.3]
    assert [r.beta for r in selection.thresholded(blocks, F.lit(0.01), size="norm").orderBy("j").collect()] == [0.01, 0.0]


def test_mixture_recovers_clusters(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.multivariate_normal([0, 0], [[1, 0.5], [0.5, 1]], 600), rng.multivariate_normal([5, 5], [[1, -0.3], [-0.3, 0.5]], 400)])
    df = spark.createDataFrame([(float(a), float(b), int(k >= 600)) for k, (a, b) in enumerate(x)], "a double, b double, t int")
    model = mixture.fit(df, ["a", "b"])
    assert model["converged"] and np.allclose(model["weights"], [0.6, 0.4], atol=0.02) and np.allclose(model["means"], [[0, 0], [5, 5]], atol=0.2)
    assert mixture.label(df, model).where("label = t + 1").count() > 990
    mixture.save(spark, model, str(tmp_path / "model"))
    again = mixture.load(spark, str(tmp_path / "model"))
    assert all(np.allclose(again[k], model[k]) for k in ("weights", "means", "covariances")) and again["features"] == ["a", "b"] and again["converged"]


def test_simulation(spark):
    from ravelin.plans.studies import simulation_grid

    got = simulation_grid(spark, "/root/testdata/sf0.01", reps=1, sigmas=(0.5,)).toPandas().set_index("estimator")
    assert got.tpr["oracle"] == 1 and got.fpr["oracle"] == 0 and got.mse["oracle"] < 1 and got.tpr["tensor"] == 1


def test_slides_from_files(spark, tmp_path):
    from ravelin.sources import slides as s

    base = tmp_path / "slides"
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>In Medulla</t></is></c></row><row r="2"><c r="A2"><v>1.5</v></c><c r="B2"><v>0</v></c></row><row r="3"><c r="A3"><v>9</v></c><c r="B3"><v>1</v></c></row><row r="4"><c r="B4"><v>0</v></c></row></sheetData></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Area</t></si></sst>'
    for folder, kind in (("H1_1_PAS", "x"), ("H1_2_PAS", "x"), ("H2_1_OTHER", "x")):
        d = base / folder
        d.mkdir(parents=True)
        with zipfile.ZipFile(d / "objects.xlsx", "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", sheet)
            z.writestr("xl/sharedStrings.xml", shared)
        (d / "objects.csv").write_text("Area,In Medulla,extra\n1.5,0,7\n9,1,7\nNaN,0,7\n")
    for kind in ("xlsx", "csv"):
        got = s.load_slides(spark, str(base), kind, "`Area` double, `In Medulla` int" + (", extra int" if kind == "csv" else ""), drop=("extra", "absent"))
        assert sorted((r.subject, r.slide, r.Area) for r in got.where("Area is not null").collect()) == [("H1", "H1_1_PAS", 1.5), ("H1", "H1_2_PAS", 1.5)]
        assert got.count() == 4 and "extra" not in got.columns
    s.save_features(spark.createDataFrame([(1, "b c"), (0, "a")], "j int, name string"), str(tmp_path / "names"))
    assert [tuple(r) for r in s.load_features(spark, str(tmp_path / "names")).orderBy("j").collect()] == [(0, "a"), (1, "b c")]
    (tmp_path / "out.csv").write_text("Slide_number,v\nA 1 - x,\nA 1 - y,2.12345678\nB-2 - z,4e-3\n")
    outcomes = s.load_outcomes(spark, str(tmp_path / "out.csv"), "Slide_number", "v")
    subjects = spark.createDataFrame([("A 1",), ("B 2",), ("C",)], "subject string")
    assert sorted(map(tuple, tensors.matched(subjects, outcomes).select("subject", "y").collect())) == [("A 1", 2.12345678), ("B 2", 0.004)]
    pairs = spark.createDataFrame([("a", "b", 0.12345), ("b", "a", 0.12345)], "f1 string, f2 string, r double")
    s.save_correlations(pairs, ["a", "b"], str(tmp_path / "corr"))
    assert sorted(map(tuple, spark.read.option("header", "true").csv(str(tmp_path / "corr")).collect())) == [("a", "1.0", "0.1234"), ("b", "0.1234", "1.0")]


def test_results_of_settings(spark, tmp_path):
    from ravelin.sources import slides as s

    rows = [(n, k, "a", "mse", float(v)) for n in (10, 20) for k, v in enumerate((1, 2, 6, float("nan")))]
    s.save_results(spark.createDataFrame(rows, "n int, rep int, estimator string, metric string, value double"), str(tmp_path / "r"), ["n"])
    grid = spark.createDataFrame([(10,), (30,)], "n int")
    found, lacking = s.load_results(spark, str(tmp_path / "r"), grid, ["n"])
    assert [tuple(r) for r in s.settings_summary(found, ["n"]).collect()] == [(10, "a", "mse", 3, 3.0, 2.0)] and [r.n for r in lacking.collect()] == [30]
    names = spark.createDataFrame([(0, "a"), (1, "b")], "j int, name string")
    known, absent = s.feature_places(names, spark.createDataFrame([("b",), ("z",)], "name string"))
    assert [tuple(r) for r in known.collect()] == [(1, "b")] and [r.name for r in absent.collect()] == ["z"]
