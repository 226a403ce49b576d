"""Wide correlations, tensors of any shape, stored fits, medians, noise, mixtures' starts, workbooks, and the studies by value against plain numpy."""

import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.functions.noise import noisy, normal
from ravelin.operators import features as screen
from ravelin.operators import fits, medians, mixture, selection, solvers, tensors
from ravelin.operators.gram import block_products, wide_correlations
from ravelin.operators.moments import Moments, fold_set_moments
from ravelin.plans import catalog, cohorts, studies

SF = "/root/testdata/sf0.01"
Q = len(studies.DENSE)
MODES = solvers.tensor_modes(2, Q, 2)


def moments(x, y):
    z = np.column_stack([x, y])
    shift = z.mean(0) + 0.1
    z = z - shift
    return Moments(len(z), z.sum(0), z.T @ z, shift)


# Correlations of many columns


def test_blocks_of_two_thousand_columns(spark):
    rng = np.random.default_rng(5)
    d, n = 2000, 300
    x = rng.standard_normal((n, d)).round(3)
    x[:, 1999] = 2 * x[:, 3] + 0.01 * x[:, 4]
    x[:, 7] = 5.0
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,), ([1.0],)], "v array<double>").repartition(3)
    parts, _, rows = block_products(df, d)
    assert rows == n and {len(r.part) for r in parts.select("part").collect()} <= {8 * a * b for a in (256, 208) for b in (256, 208)}
    names = [f"f{k}" for k in range(d)]
    pairs = wide_correlations(df, names)
    strong = {(r.i, r.j): r.r for r in pairs.where("abs(r) > 0.5").collect()}
    assert set(strong) == {(3, 1999)} and np.isclose(strong[3, 1999], np.corrcoef(x[:, 3], x[:, 1999])[0, 1])
    some = {(r.i, r.j): r.r for r in pairs.where("i in (0, 255, 256) and j in (1, 257, 1999)").collect()}
    assert len(some) == 7 and all(np.isclose(r, np.corrcoef(x[:, i], x[:, j])[0, 1]) for (i, j), r in some.items())
    assert pairs.where("i = 7 or j = 7").where("r is not null").count() == 0
    stay, gone = screen.prune(pairs, names, 0.9)
    assert gone == ["f3"] and len(stay) == d - 1


def test_pairwise_complete(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 7))
    x[:, 6] += x[:, 0]
    x[rng.random(x.shape) < 0.2] = np.nan
    df = spark.createDataFrame([([None if v != v and k % 2 else float(v) for k, v in enumerate(r)],) for r in x], "v array<double>")
    got = {(r.i, r.j): r.r for r in wide_correlations(df, list("abcdefg"), block=3, pairwise=True).collect()}
    for (i, j), r in got.items():
        both = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
        assert np.isclose(r, np.corrcoef(x[both, i], x[both, j])[0, 1])
    whole = np.isfinite(x).all(1)
    complete = {(r.i, r.j): r.r for r in wide_correlations(df, list("abcdefg"), block=3).collect()}
    assert len(got) == len(complete) == 21 and all(np.isclose(r, np.corrcoef(x[whole, i], x[whole, j])[0, 1]) for (i, j), r in complete.items())
    assert wide_correlations(df.limit(0), ["a", "b"]).where("r is not null").count() == 0


def test_pruning_as_step_by_step(spark):
    rng = np.random.default_rng(7)
    for _ in range(5):
        bad = [(i, j) for i in range(12) for j in range(i + 1, 12) if rng.random() < 0.2]
        df = spark.createDataFrame([(i, j, 0.99) for i, j in bad] + [(0, 1, 0.1)], "i int, j int, r double")
        left, gone = set(bad), []
        while left:
            times = [sum(k in p for p in left) for k in range(12)]
            gone.append(times.index(max(times)))
            left = {p for p in left if gone[-1] not in p}
        assert screen.prune(df, list(range(12)), 0.95)[1] == gone


# Tensors


def test_tensors_of_any_shape(spark):
    rows = [("a", "1", 0, 1, 2.0), ("a", "2", 0, 2, 4.0), ("a", "3", 0, 3, 6.0), ("a", "3", 0, 1, 2.0), ("b", "1", 0, 2, 5.0), ("c", "1", 1, 1, 9.0)]
    objects = spark.createDataFrame(rows, "subject string, slide string, excluded int, label int, f double")
    slides = tensors.assemble(objects, ["f"], (1, 2, 3), most=None)
    assert tensors.slide_count(slides) == 3
    x = {r.subject: r.x for r in tensors.packed(slides, ["f"], (1, 2, 3), most=3).collect()}
    assert x == {"a": [2.0, 0.0, 1.0, 0.0, 4.0, 0.0, 0.0, 0.0, 3.0], "b": [0.0, 0.0, 0.0, 5.0, 5.0, 0.0, 0.0, 0.0, 0.0]}
    ragged = {r.subject: (r.n_slides, r.x) for r in tensors.packed(slides, ["f"], (1, 2, 3), most=None).collect()}
    assert ragged["a"] == (3, x["a"]) and ragged["b"] == (2, [0.0, 0.0, 5.0, 5.0, 0.0, 0.0])
    cells = {(r.subject, r.g, r.s): r.value for r in tensors.tensor_rows(slides, ["f"], (1, 2, 3)).collect()}
    assert all(v == ragged[s][1][g * ragged[s][0] + k] for (s, g, k), v in cells.items()) and len(cells) == 15
    assert {(r.subject, r.g): r.value for r in tensors.pooled_average(objects, ["f"], (1, 2, 3)).collect()}["a", 2] == 1.5


def test_contractions(spark):
    rng = np.random.default_rng(1)
    sizes = (3, 4, 2)
    x = rng.standard_normal((5, *sizes))
    df = spark.createDataFrame([(r.ravel().tolist(),) for r in x], "x array<double>")
    v = {m: rng.standard_normal(n) for m, n in zip("gjs", sizes)}
    for modes in ("g", "j", "s", "gs", "gj", "js", "gjs"):
        got = np.array([r.z for r in df.select(tensors.contraction(F.col("x"), sizes, {m: v[m].tolist() for m in modes}).alias("z")).collect()])
        kept = "".join(m for m in "gjs" if m not in modes)
        want = np.einsum(f"ngjs,{','.join(modes)}->n{kept}", x, *(v[m] for m in modes)).reshape(5, -1)
        assert np.allclose(got, want)
    with pytest.raises(ValueError):
        tensors.contraction(F.col("x"), sizes, {"t": [1.0]})
    with pytest.raises(ValueError):
        tensors.contraction(F.col("x"), sizes, {"g": [1.0]})
    with pytest.raises(ValueError):
        tensors.contracted(df, df, "t")


def test_outcomes_meet_both_keys_in_one_join(spark):
    subjects = spark.createDataFrame([("A 1", 1), ("A 1", 1), ("B-1", 2), ("C 3", 3), (None, 4)], "subject string, extra int")
    outcomes = spark.createDataFrame([("A 1 - x", None, 0), ("A 1 - y", 5.0, 1), ("A-1 - z", 7.0, 2), ("C-3 - x", 9.0, 3)], "name string, y double, place long")
    assert sorted(map(tuple, tensors.matched(subjects, outcomes).collect())) == [("A 1", 1, 5.0), ("A 1", 1, 5.0), ("C 3", 3, 9.0)]


# Fits


def test_fits_are_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    x, b = rng.standard_normal((50, 3)) + 2, np.array([1.0, -2.0, 0.0])
    y = x @ b + 4
    m = moments(x[:40], y[:40])
    stored = fits.table_of(spark, [fits.record("one", m, solvers.least_squares(m)[1], "abc", lam=0.5, cv_mse=float("nan")), fits.record("two", m, np.zeros(3), "abc")])
    path = str(tmp_path / "fits")
    fits.save(stored, path)
    fits.save(stored.where("fit = 'two'").withColumn("lam", F.lit(9.0)), path)  # replaces itself alone
    again = fits.load(spark, path)
    assert {r.fit: r.lam for r in again.collect()} == {"one": 0.5, "two": 9.0}
    rows = spark.createDataFrame([(k, x[k].tolist(), float(y[k])) for k in range(40, 50)] + [(90, None, 1.0), (91, [1.0], 1.0), (92, [1.0, float("nan"), 2.0], 1.0), (93, [1.0, None, 2.0], 1.0)], "k int, x array<double>, y double")
    got = {(r.fit, r.k): r.y_hat for r in fits.predict(again, rows).collect()}
    assert len(got) == 28 and all(np.isclose(got["one", k], y[k]) and np.isclose(got["two", k], y[:40].mean()) for k in range(40, 50)) and all(got["one", k] is None for k in (90, 91, 92, 93))
    wrong = {r.fit: (r.n, r.mse) for r in fits.errors(fits.predict(again, rows)).collect()}
    assert wrong["one"][0] == 10 and wrong["one"][1] < 1e-12 and np.isclose(wrong["two"][1], np.mean((y[40:] - y[:40].mean()) ** 2))
    with pytest.raises(ValueError):
        fits.predict(again, rows, most=1)
    assert {(r.feature, round(r.normalized, 6)) for r in fits.selected(again).collect()} == {("a", round(-1 / 3, 6)), ("b", round(2 / 3, 6))}


def test_fold_sets(spark):
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((70, 3)), rng.standard_normal(70)
    df = spark.createDataFrame([(k, *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y))] + [(99, None, 1.0, 1.0, 1.0)], "k int, a double, b double, c double, y double")
    ways = [F.pmod(F.xxhash64(F.lit(w), "k"), F.lit(4)) for w in range(3)]
    at = np.array([tuple(r) for r in df.where("k < 99").orderBy("k").select(*ways).collect()])
    for parts in (1, 5):
        sets = fold_set_moments(df.repartition(parts), ["a", "b", "c", "y"], ways)
        for w, folds in enumerate(sets):
            assert set(folds) == set(at[:, w])
            for k, m in folds.items():
                own = np.column_stack([x, y])[at[:, w] == k]
                assert m.n == len(own) and np.allclose(m.mean, own.mean(0)) and np.allclose(m.raw, own.T @ own / len(own))
    errors, betas = selection.cross_validation(spark, sets, np.array([0.01, 0.1, 0.3]), selection.fit_lasso())
    for j, lam in enumerate((0.01, 0.1, 0.3)):
        want = []
        for k in np.unique(at[:, j]):
            tr, te = at[:, j] != k, at[:, j] == k
            b = solvers.lasso(moments(x[tr], y[tr]), lam)
            want.append(np.mean((y[te] - y[te].mean() - (x[te] - x[te].mean(0)) @ b) ** 2))
        assert np.isclose(errors[j], np.mean(want)) and np.allclose(betas[j], solvers.lasso(moments(x, y), lam), atol=1e-6)


def test_numbers_that_are_none():
    x = np.ones((20, 8))
    x[3, 2] = np.nan
    m = moments(x, np.arange(20.0))
    modes = {"p": np.arange(8) // 4, "j": np.arange(8) % 4}
    assert np.isnan(solvers.least_squares(m)[0])
    v = solvers.alternating(m, modes, 0.1, {"p": np.full(2, 0.5), "j": np.full(4, 0.25)})
    assert all(np.isfinite(a).all() for a in v.values())


# Medians, noise, mixtures


@pytest.mark.parametrize("limit", [10, 300, 1_000_000])
def test_exact_medians(spark, limit):
    rng = np.random.default_rng(4)
    groups = {"normal": rng.standard_normal(4001), "even": rng.integers(0, 5, 1000).astype(float), "one": np.full(2000, 3.5), "wide": np.exp(rng.standard_normal(3000) * 30), "small": np.array([1.0, 2.0, 9.0, 11.0]), None: np.arange(50.0)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("small", None), ("small", float("nan")), ("empty", None)]
    got = {r.g: r.median for r in medians.exact_median(spark.createDataFrame(rows, "g string, value double").repartition(5), ["g"], limit=limit).collect()}
    assert set(got) == set(groups) and all(got[g] == np.median(x) for g, x in groups.items())


def test_noise(spark):
    df = spark.range(200_000)
    for parts in (1, 7):
        drawn = df.repartition(parts).select("id", normal(3, F.col("id")).alias("z"), normal(4, F.col("id")).alias("w"))
        z, w = (np.array(c) for c in zip(*((r.z, r.w) for r in drawn.orderBy("id").collect())))
        assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01 and abs(np.mean(z**3)) < 0.03 and abs(np.mean(z**4) - 3) < 0.1 and abs(np.corrcoef(z, w)[0, 1]) < 0.01 and abs(np.corrcoef(z[1:], z[:-1])[0, 1]) < 0.01
        cdf = 0.5 * (1 + np.vectorize(math.erf)(np.sort(z) / 2**0.5))
        assert np.abs(cdf - np.arange(len(z)) / len(z)).max() < 0.005
    x = spark.range(2000).select("id", F.array(F.lit(1.0), F.lit(2.0), F.lit(None).cast("double")).alias("x"))
    got = x.select(noisy(F.col("x"), 0.5, 1, F.col("id")).alias("x")).collect()
    a, b = np.array([r.x[0] for r in got]), np.array([r.x[1] for r in got])
    assert abs(a.std() - 0.5) < 0.03 and abs(b.mean() - 2) < 0.05 and abs(np.corrcoef(a, b)[0, 1]) < 0.08 and got[0].x[2] is None
    base = x.select("id", F.array(F.lit(0.0)).alias("x")).limit(50)
    one, two = (sorted(map(str, selection.noisy_bootstrap(base.repartition(p), "id", "x", 1.0, 2).collect())) for p in (1, 4))
    assert one == two and len(set(one)) == 100


def test_mixture_meets_small_clusters(spark):
    rng = np.random.default_rng(9)
    centers, sizes = np.array([[0, 0], [30, 0], [0, 30], [30, 30], [80, 80]]), [5000, 3000, 1500, 489, 11]
    x = np.vstack([rng.standard_normal((n, 2)) + c for c, n in zip(centers, sizes)])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double").repartition(4)
    model = mixture.fit(df, ["a", "b"], k=5, restarts=4)
    assert model["converged"] and sorted(np.round(model["weights"] * 10_000).astype(int).tolist()) == sorted(sizes)


def test_mixture_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (5.0, 6.0), (None, 1.0)], "a double, b double")
    for rows, k in ((df.limit(0), 0), (df.limit(2), 1), (df, 2), (df.where("a is null"), 0)):
        model = mixture.fit(rows, ["a", "b"], k=3, restarts=2)
        assert len(model["weights"]) == k and np.isfinite(model["means"]).all()
        assert {r.label for r in mixture.label(df, model).where("a is null").collect()} == {None} and mixture.label(df, model).where("label is null").count() == (4 if k == 0 else 1)


# Workbooks and stored results


def workbook(path, rows, references=True, shared=()):
    cells = lambda r, row: "".join(f'<c{f" r={chr(34)}{chr(65 + k)}{r}{chr(34)}" if references else ""}{" t=" + chr(34) + v[0] + chr(34) if isinstance(v, tuple) else ""}>' + (f"<is><t>{v[1]}</t></is>" if isinstance(v, tuple) and v[0] == "inlineStr" else f"<v>{v[1] if isinstance(v, tuple) else v}</v>") + "</c>" for k, v in enumerate(row))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(f"<row>{cells(r, row)}</row>" for r, row in enumerate(rows, 1)) + "</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")


@pytest.mark.parametrize("references", [True, False])
def test_workbooks(spark, tmp_path, references):
    from ravelin.sources import slides, workbooks

    base = tmp_path / f"books{references}"
    for folder in ("H1_1_PAS", "H1_2_PAS", "H3_1_HE"):
        (base / folder).mkdir(parents=True)
        workbook(base / folder / "objects.xlsx", [[("s", 0), ("inlineStr", "In Medulla"), ("s", 1)], [1.5, 0, ("s", 1)], [("e", "#N/A"), 0, 7], [3, 1, 8]], references, ["Area", "Note"])
    workbooks.register(spark)
    df = spark.read.format("workbooks").schema("Note string, Area double, absent int, path string").option("marker", "PAS").option("rows", 2).load(str(base))
    assert sorted((r.Area or 0, r.Note, r.absent) for r in df.collect()) == sorted([(1.5, "Note", None), (0, "7", None), (3.0, "8", None)] * 2) and df.rdd.getNumPartitions() == 2
    got = slides.load_slides(spark, str(base), "xlsx", "Area double, `In Medulla` int")
    assert sorted(((r.subject, r.slide, r.Area) for r in got.collect()), key=str) == sorted([("H1", f"H1_{k}_PAS", a) for k in (1, 2) for a in (None, 1.5)], key=str)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(f"{base}/*PAS*/")
    assert slides.read_workbooks(raw, "Area double, Note string").where("Area = 1.5 and Note = 'Note'").count() == 2
    assert workbooks.place_of("A1") == 0 and workbooks.place_of("AB12") == 27


def test_large_workbook_in_little_memory(tmp_path):
    import tracemalloc

    from ravelin.sources.workbooks import sheet_rows

    rows = [[("inlineStr", f"c{k}") for k in range(20)]] + [[k * 20 + j for j in range(20)] for k in range(20_000)]
    workbook(tmp_path / "big.xlsx", rows)
    tracemalloc.start()
    with open(tmp_path / "big.xlsx", "rb") as f:
        total = sum(int(r[0]) for r in sheet_rows(f, ["c7"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == sum(k * 20 + 7 for k in range(20_000)) and peak < 3_000_000


def test_results_that_grow(spark, tmp_path):
    from ravelin.sources import slides as s

    path, grid = str(tmp_path / "r"), spark.createDataFrame([(10,), (20,), (30,)], "n int")
    kind = "n int, rep int, estimator string, metric string, value double"
    ran = []

    def study(settings):
        ran.append(sorted(r.n for r in settings.collect()))
        return spark.createDataFrame([(n, 0, "a", "mse", float(n)) for n in ran[-1]], kind)

    s.save_results(spark.createDataFrame([(10, 0, "a", "mse", 1.0), (10, 1, "a", "mse", 2.0)], kind), path, ["n"])
    s.save_results(spark.createDataFrame([(20, 0, "a", "mse", 5.0)], kind), path, ["n"])
    assert sorted((r.n, r.value) for r in spark.read.parquet(path).collect()) == [(10, 1.0), (10, 2.0), (20, 5.0)]
    s.save_results(spark.createDataFrame([(10, 0, "a", "mse", 8.0)], kind), path, ["n"])
    assert s.run_missing(spark, path, grid, ["n"], study) == 1 and s.run_missing(spark, path, grid, ["n"], study) == 0 and ran == [[30]]
    assert sorted((r.n, r.value) for r in spark.read.parquet(path).collect()) == [(10, 8.0), (20, 5.0), (30, 30.0)]
    assert s.run_missing(spark, str(tmp_path / "none"), grid, ["n"], study) == 3


def test_other_tables(spark, tmp_path):
    from ravelin.sources import slides as s

    pairs = spark.createDataFrame([(0, 1, "a", "b", 0.9), (0, 2, "a", "c", -0.3), (1, 2, "b", "c", 0.1)], "i int, j int, f1 string, f2 string, r double")
    report = {r.feature: (r["rank"], r.candidate, r.among_first) for r in s.screening_report(pairs, most=1).collect()}
    assert report == {"c": (1, True, True), "a": (2, False, False), "b": (3, False, False)}
    x = spark.createDataFrame([("s", [1.0, 2.0])], "subject string, x array<double>")
    s.save_tensors(x, str(tmp_path / "x"))
    assert s.load_tensors(spark, str(tmp_path / "x")).collect() == x.collect()
    assert selection.arithmetic_grid(0.005, 0.055, 0.005).size == 10 and selection.arithmetic_grid(0.25, 2.75, 0.25).size == 10 and selection.arithmetic_grid(1, 1, 0.1).size == 0


# Studies by value


@pytest.fixture(scope="module")
def rows(spark):
    """The design's rows: x, y, and their folds."""
    got = selection.hash_folds(studies.design(spark, SF), "subject").orderBy("subject").collect()
    return np.array([r.x for r in got]), np.array([r.y for r in got]), np.array([r.fold for r in got])


def loop(x, y, fold, grid, fit, centred=True, intercept=False):
    out = []
    for lam in grid:
        errors = []
        for k in np.unique(fold):
            tr, te = fold != k, fold == k
            b = fit(moments(x[tr], y[tr]), lam)
            c, b = b if intercept else (0.0, b)
            errors.append(np.mean((y[te] - y[te].mean() - (x[te] - x[te].mean(0)) @ b) ** 2) if centred else np.mean((y[te] - c - x[te] @ b) ** 2))
        out.append(np.mean(errors))
    return np.array(out)


def test_group_lasso_studies(spark, rows):
    x, y, fold = rows
    grid = solvers.penalty_grid(solvers.largest_penalty(moments(x, y), MODES["j"]))
    got = catalog.queries()["group_lasso_cv"](spark, SF).orderBy("lam").collect()
    want = loop(x, y, fold, grid, selection.fit_group(MODES["j"]))
    assert np.allclose([r.lam for r in got], grid) and np.allclose([r.cv_mse for r in got], want, rtol=1e-4) and [r.chosen for r in got].index(True) == int(np.argmin(want))
    best = int(np.argmin(want))
    assert np.allclose(got[best].coefficients, solvers.group_lasso(moments(x, y), MODES["j"], grid[best])[1], rtol=1e-3, atol=1e-3)
    plain = catalog.queries()["group_lasso_uncentred"](spark, SF).orderBy("lam").collect()
    assert np.allclose([r.cv_mse for r in plain], loop(x, y, fold, grid, lambda m, lam: solvers.group_lasso(m, MODES["j"], lam), False, True), rtol=1e-4)


def test_lasso_study(spark, rows):
    x, y, fold = rows
    z = x.reshape(-1, 2, Q, 2).mean((1, 3))
    grid = selection.lasso_path(moments(z, y))
    got = catalog.queries()["lasso_cv"](spark, SF).orderBy(F.desc("lam")).collect()
    want = loop(z, y, fold, grid, selection.fit_lasso())
    assert np.allclose([r.lam for r in got], grid) and np.allclose([r.cv_mse for r in got], want, rtol=1e-6)


@pytest.mark.parametrize("name", ["rank1_lasso", "joint_lasso", "two_mode_lasso", "rank1_redrawn_folds"])
def test_alternating_studies(spark, rows, name):
    x, y, fold = rows
    modes = MODES
    if name == "joint_lasso":
        modes = {"p": MODES["g"] * 2 + MODES["s"], "j": MODES["j"]}
    if name == "two_mode_lasso":
        x = x.reshape(-1, 2, Q, 2).mean(3).reshape(-1, 2 * Q)
        modes = {"g": np.arange(2 * Q) // Q, "j": np.arange(2 * Q) % Q}
    grid = np.geomspace(1e-4, 1.0, 15) * y.std()
    fit = selection.fit_alternating(modes)
    if name == "rank1_redrawn_folds":
        at = np.array([tuple(r) for r in studies.design(spark, SF).orderBy("subject").select(*(F.pmod(F.xxhash64(F.lit(42 + k), "subject"), F.lit(5)) for k in range(15))).collect()])
        want = np.array([loop(x, y, at[:, k], [lam], fit)[0] for k, lam in enumerate(grid)])
    else:
        want = loop(x, y, fold, grid, fit)
    got = catalog.queries()[name](spark, SF).collect()
    best = int(np.argmin(want))
    assert np.isclose(got[0].cv_mse, want.min(), rtol=1e-3) and np.isclose(got[0].lam, grid[best], rtol=1e-6)
    v = selection.best_restart(moments(x, y), modes, grid[best])
    for mode, vec in v.items():
        assert np.allclose([r.coef for r in sorted(got, key=lambda r: r.k) if r["mode"] == mode], vec, rtol=0.02, atol=0.01 * np.abs(vec).max())


def test_oracles(spark, rows):
    x, y, fold = rows
    keep = [k for k in range(len(MODES["j"])) if studies.DENSE[MODES["j"][k]] in ("price", "tax")]
    got = {(r.feature, r.g, r.s): (r.coef, r.intercept, r.mse) for r in catalog.queries()["oracle_fit"](spark, SF).collect()}
    a = np.column_stack([x[:, keep], np.ones(len(x))])
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    want = {(studies.DENSE[MODES["j"][k]], MODES["g"][k], MODES["s"][k]): v for k, v in zip(keep, b)}
    assert all(np.isclose(got[k][0], v, rtol=1e-3, atol=1e-3) for k, v in want.items()) and np.isclose(next(iter(got.values()))[2], np.mean((y - a @ b) ** 2))
    z = np.einsum("ngjs,g,s->nj", x.reshape(-1, 2, Q, 2), cohorts.ALPHA, cohorts.GAMMA)
    grid = np.geomspace(1e-4, 1.0, 15) * y.std()
    errors = loop(z, y, fold, grid, selection.fit_lasso(), centred=False)
    found = catalog.queries()["rank1_oracle"](spark, SF).collect()
    best = int(np.argmin(errors))
    assert np.isclose(found[0].lam, grid[best]) and np.isclose(found[0].cv_mse, errors[best], rtol=1e-6) and np.allclose([r.coef for r in found], solvers.lasso(moments(z, y), grid[best]), rtol=1e-4, atol=1e-6)


def test_paired_designs(spark):
    drawn = cohorts.paired_design(spark, SF).collect()
    x, clean, y = (np.array([r[c] for r in drawn]) for c in ("x", "x_true", "y"))
    assert 0.9 < (x - clean).std() < 1.1 and 0.7 < (y - clean @ cohorts.truth()).std() < 1.3
    keep = np.flatnonzero(cohorts.truth())
    got = catalog.queries()["paired_oracle"](spark, SF).collect()
    a = np.column_stack([clean[:, keep], np.ones(len(y))])
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    coef = {(r.feature, r.g, r.s): r.coef for r in got}
    assert all(np.isclose(coef[studies.DENSE[MODES["j"][k]], MODES["g"][k], MODES["s"][k]], v, rtol=0.02, atol=0.02) for k, v in zip(keep, b))
    assert np.isclose(got[0].mse_true, np.mean((y - a @ b) ** 2), rtol=1e-3) and np.isclose(got[0].mse_noisy, np.mean((y - got[0].intercept - x[:, keep] @ np.array([coef[studies.DENSE[MODES["j"][k]], MODES["g"][k], MODES["s"][k]] for k in keep])) ** 2), rtol=1e-6)


def test_study_results(spark):
    stored, picked, drawn = cohorts._study(spark, SF)
    got = {r.fit: r for r in catalog.queries()["study_results"](spark, SF).collect()}
    sample = drawn.orderBy("draw").collect()
    test, fold, y = (np.array([r[c] for r in sample]) for c in ("test", "fold", "y"))
    assert test.sum() == max(1, round(len(test) * 0.2)) and set(got) == {"tensor", "clusters", "naive"}
    x = {n: np.array([r[f"x_{n}"] for r in sample]) for n in got}
    assert np.allclose(x["naive"], x["tensor"].reshape(-1, 2, Q, 2).mean((1, 3)))
    tr = ~test
    grid = selection.lasso_path(moments(x["naive"][tr], y[tr]))
    errors = loop(x["naive"][tr], y[tr], fold[tr], grid, selection.fit_lasso())
    b = solvers.lasso(moments(x["naive"][tr], y[tr]), grid[np.argmin(errors)])
    hat = y[tr].mean() + (x["naive"] - x["naive"][tr].mean(0)) @ b
    r = got["naive"]
    assert np.isclose(r.lam, grid[np.argmin(errors)]) and np.isclose(r.cv_mse, errors.min()) and (r.n_train, r.n_test) == (tr.sum(), test.sum())
    assert np.isclose(r.train_mse, np.mean((y - hat)[tr] ** 2)) and np.isclose(r.test_mse, np.mean((y - hat)[test] ** 2)) and r.n_selected == (np.abs(b) > 1e-6).sum()
    for s in stored.collect():
        hat = s.mean_y + (x[s.fit] - np.array(s.means)) @ np.array(s.coefficients)
        assert np.isclose(got[s.fit].test_mse, np.mean((y - hat)[test] ** 2)) and np.isclose(s.train_mse, np.mean((y - hat)[tr] ** 2))
    lines = [r.text for r in cohorts.study_report(spark.createDataFrame(list(got.values())), picked).orderBy("line").collect()]
    assert lines[0].startswith("Estimator") and [t.split()[0] for t in lines[1:4]] == ["tensor", "clusters", "naive"] and len(lines) == 4 + picked.count()


def test_bootstrap_study(spark):
    got = catalog.queries()["bootstrap_sample"](spark, SF).collect()
    whole = {r.subject: r.y for r in studies.design(spark, SF).collect()}
    assert sorted(r.draw for r in got) == list(range(len(whole))) and all(whole[r.subject] == r.y for r in got) and sum(r.test for r in got) == max(1, round(len(whole) * 0.2)) and 0.5 < len({r.subject for r in got}) / len(whole) < 0.75
