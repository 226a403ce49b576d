"""The same queries in DuckDB SQL."""

from __future__ import annotations

DENSE = "obj AS (SELECT l_suppkey AS subject, l_linestatus AS slide, CASE WHEN l_quantity <= 25 THEN 1 ELSE 2 END AS label, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem WHERE l_returnflag <> 'A')"
SPARSE = "obj AS (SELECT o_custkey AS subject, CAST(year(o_orderdate) % 2 AS VARCHAR) AS slide, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS label, o_totalprice AS total FROM orders)"
NAMES = ["quantity", "price", "discount", "tax"]
NAIVE = DENSE + ", av AS (SELECT subject, " + ", ".join(f"avg({f}) AS {f}" for f in NAMES) + " FROM obj GROUP BY subject)"
_PAIRS = [(i, a, j, b) for i, a in enumerate(NAMES) for j, b in enumerate(NAMES) if i < j]
PAIRS = NAIVE + ", pairs AS (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, '{a}' AS f1, '{b}' AS f2, (SELECT CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END FROM av) AS r" for i, a, j, b in _PAIRS) + ")"
RANKED = PAIRS + ", both_ AS (SELECT i, f1, r FROM pairs UNION ALL SELECT j, f2, r FROM pairs), strong AS (SELECT i AS j, f1 AS feature, max(abs(r)) AS m FROM both_ GROUP BY i, f1), ranked AS (SELECT *, row_number() OVER (ORDER BY m, j) AS rank FROM strong)"
SLIDES = DENSE + ", st AS (SELECT subject, slide, count(*) AS n, " + ", ".join(f"sum(CASE WHEN label = {g} THEN {f} ELSE 0 END) / count({f}) AS v{g - 1}_{j}" for g in (1, 2) for j, f in enumerate(NAMES)) + " FROM obj GROUP BY subject, slide)"
PLACED = ", pl AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY slide) - 1 AS s0, count(*) OVER (PARTITION BY subject) AS n_slides FROM st), pad AS (SELECT *, s0 AS s, 0 AS copied FROM pl WHERE s0 < 2 UNION ALL SELECT *, 1 AS s, 1 AS copied FROM pl WHERE n_slides = 1)"
CELLS = SLIDES + PLACED + ", cells AS (" + " UNION ALL ".join(f"SELECT subject, {g} AS g, {j} AS j, CAST(s AS INT) AS s, v{g}_{j} AS value FROM pad" for g in (0, 1) for j in range(4)) + ")"
SCALE = CELLS + ", per AS (SELECT subject, j, sum(value * value) AS v FROM cells GROUP BY subject, j), sc AS (SELECT j, CASE WHEN sqrt(avg(v)) > 1e-10 THEN sqrt(avg(v)) ELSE 1 END AS gnorm FROM per GROUP BY j)"
GRAD = SCALE + ", gr AS (SELECT g, c.j, s, covar_pop(value, s_acctbal) / any_value(gnorm) AS grad FROM cells c JOIN supplier ON s_suppkey = subject JOIN sc ON sc.j = c.j GROUP BY g, c.j, s), nm AS (SELECT j, sqrt(sum(grad * grad)) AS norm, avg(grad) AS mean FROM gr GROUP BY j)"
SLOPES = NAIVE + ", x AS (" + " UNION ALL ".join(f"SELECT s_nationkey AS nation, s_acctbal AS y, {j} AS j, {f} AS x FROM av JOIN supplier ON s_suppkey = subject" for j, f in enumerate(NAMES)) + "), sl AS (SELECT nation, j, CASE WHEN var_pop(x) > 1e-12 THEN covar_pop(x, y) / var_pop(x) ELSE 0 END AS slope, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM x GROUP BY nation, j)"
RESID = "f AS (SELECT l_returnflag, covar_pop(l_quantity, l_extendedprice) / var_pop(l_quantity) AS b, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem GROUP BY 1), res AS (SELECT l.l_returnflag, l_suppkey, l_extendedprice - my - b * (l_quantity - mx) AS r FROM lineitem l JOIN f ON f.l_returnflag = l.l_returnflag)"
ERRORS = RESID + ", p5 AS (SELECT l_returnflag, l_suppkey % 5 AS fold, avg(r * r) AS a, avg(r) AS m FROM res GROUP BY 1, 2), er AS (SELECT l_returnflag, k, 0.05 * (k + 1) AS lam, avg(a * (1 + (0.05 * (k + 1) - 0.2) * (0.05 * (k + 1) - 0.2)) + m * (0.05 * (k + 1))) AS mse FROM p5, (SELECT CAST(range AS INT) AS k FROM range(10)) GROUP BY 1, 2)"
DERIVED = ["quantity", "price", "discount", "tax", "price2", "price3"]
_DP = [(i, a, j, b) for i, a in enumerate(DERIVED) for j, b in enumerate(DERIVED) if i < j]


def _prune() -> str:
    """Greedy pruning by recursion over the dropped list: a step drops the first feature in the most bad pairs left."""
    base = DENSE + ", dv AS (SELECT *, price * 2 + quantity AS price2, price - 50 * quantity AS price3 FROM obj), av AS (SELECT subject, " + ", ".join(f"avg({f}) AS {f}" for f in DERIVED) + " FROM dv GROUP BY subject)"
    bad = ", bad AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, (SELECT abs(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b}))) FROM av) AS r" for i, a, j, b in _DP) + ") WHERE r > 0.9), sides AS (SELECT i AS k, i, j FROM bad UNION ALL SELECT j, i, j FROM bad)"
    step = ", steps AS (SELECT 0 AS n, CAST([] AS INTEGER[]) AS gone UNION ALL SELECT n + 1, list_append(gone, (SELECT k FROM sides WHERE NOT list_contains(gone, i) AND NOT list_contains(gone, j) GROUP BY k ORDER BY count(*) DESC, k LIMIT 1)) FROM steps WHERE EXISTS (SELECT 1 FROM bad WHERE NOT list_contains(gone, i) AND NOT list_contains(gone, j)))"
    names = ", nm AS (" + " UNION ALL ".join(f"SELECT {k} AS k, '{f}' AS feature" for k, f in enumerate(DERIVED)) + ")"
    return "WITH RECURSIVE " + base + bad + step + names + " SELECT feature, CAST(coalesce(list_position((SELECT gone FROM steps ORDER BY n DESC LIMIT 1), k), 0) - 1 AS INT) AS dropped_at FROM nm"


def oracle_sql() -> dict[str, str]:
    r = lambda c, n=6, a=None: f"round({c}, {n}) AS {a or c}"
    return {
        "naive_average": f"WITH {NAIVE} SELECT subject, " + ", ".join(r(f) for f in NAMES) + " FROM av",
        "corr_pairs": f"WITH {PAIRS} SELECT f1, f2, {r('r')} FROM pairs",
        "max_abs_corr_rank": f"WITH {RANKED} SELECT feature, round(m, 6) AS max_abs_corr, CAST(rank AS INT) AS rank FROM ranked",
        "independent_topk": f"WITH {RANKED}, t AS (SELECT feature FROM ranked WHERE rank <= 3) SELECT f1, f2, {r('r')} FROM pairs WHERE f1 IN (FROM t) AND f2 IN (FROM t)",
        "candidate_features": f"WITH {RANKED} SELECT feature, round(m, 6) AS max_abs_corr FROM ranked WHERE m < 0.8",
        "corr_prune": _prune(),
        "cluster_weights": f"WITH {DENSE} SELECT subject, slide, count(*) AS n, round(avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END), 6) AS w1, round(avg(CASE WHEN label = 2 THEN 1.0 ELSE 0.0 END), 6) AS w2 FROM obj GROUP BY 1, 2",
        "cluster_means": f"WITH {DENSE} SELECT subject, slide, " + ", ".join(f"round(avg(CASE WHEN label = {g} THEN {f} END), 6) AS mean{g}_{f}" for f in ("price", "tax") for g in (1, 2)) + " FROM obj GROUP BY 1, 2",
        "weighted_cluster_avg": f"WITH {SPARSE} SELECT subject, slide, " + ", ".join(f"round(sum(CASE WHEN label = {g} THEN total ELSE 0 END) / count(total), 6) AS weighted{g}_total" for g in (1, 2)) + " FROM obj GROUP BY 1, 2",
        "tensor_long": f"WITH {CELLS} SELECT subject, g, j, s, {r('value')} FROM cells",
        "one_slide_padding": f"WITH {SPARSE}, st AS (SELECT subject, slide, count(*) AS n FROM obj GROUP BY 1, 2){PLACED} SELECT subject, CAST(s AS INT) AS s, slide, n, copied FROM pad",
        "two_slide_subjects": f"WITH {SPARSE} SELECT subject, count(DISTINCT slide) AS n_slides FROM obj GROUP BY 1 HAVING count(DISTINCT slide) = 2",
        "slides_histogram": f"WITH {SPARSE}, c AS (SELECT subject, count(DISTINCT slide) AS n_slides FROM obj GROUP BY 1) SELECT n_slides, count(*) AS n_subjects FROM c GROUP BY 1",
        "cluster_sizes": f"WITH {DENSE} SELECT count(*) AS n, count(*) FILTER (WHERE label = 1) AS n1, round(avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END), 6) AS share1 FROM obj",
        "pooled_cluster_avg": f"WITH {SPARSE} " + " UNION ALL ".join(f"SELECT subject, {g} AS g, round(sum(CASE WHEN label = {g + 1} THEN total ELSE 0 END) / count(total), 6) AS value FROM obj GROUP BY subject" for g in (0, 1)),
        "slide_mean": f"WITH {CELLS} SELECT subject, g, j, round(avg(value), 6) AS value FROM cells GROUP BY 1, 2, 3",
        "grand_mean": f"WITH {CELLS} SELECT subject, j, round(avg(value), 6) AS value FROM cells GROUP BY 1, 2",
        "outcome_match_fallback": "WITH o AS (SELECT 'C' || CASE WHEN c_custkey % 2 = 1 THEN '-' ELSE ' ' END || c_custkey AS key, o_totalprice AS y, o_orderkey AS place FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'), f AS (SELECT key, arg_min(y, place) AS y FROM o GROUP BY key) SELECT 'C ' || c_custkey AS subject, coalesce(a.y, b.y) AS y FROM customer LEFT JOIN f a ON a.key = 'C ' || c_custkey LEFT JOIN f b ON b.key = 'C-' || c_custkey WHERE coalesce(a.y, b.y) IS NOT NULL",
        "subject_key_parse": "SELECT p_partkey, p_brand AS subject_a, CAST(p_size AS VARCHAR) AS slide_a, p_brand AS subject_b FROM part",
        "contiguous_folds": "WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place, (SELECT greatest(count(*) // 5, 1) FROM customer) AS size FROM customer) SELECT c_custkey, place, CAST(least(place // size, 4) AS INT) AS fold FROM n",
        "standardize": f"WITH {NAIVE}, m AS (SELECT avg(price) AS m, CASE WHEN stddev_pop(price) > 1e-10 THEN stddev_pop(price) ELSE 1 END AS s FROM av) SELECT subject, round((price - m) / s, 6) AS z FROM av, m",
        "group_scale": f"WITH {SCALE} SELECT j, round(gnorm, 5) AS gnorm FROM sc",
        "lambda_max_group": f"WITH {GRAD} SELECT round(max(norm), 5) AS lambda_max FROM nm",
        "lambda_grid": f"WITH {GRAD}, t AS (SELECT greatest(max(norm) / 1000, 1e-8) AS lo, greatest(max(norm), 1e-4) AS hi FROM nm) SELECT CAST(range AS INT) AS k, round(exp(ln(lo) + (ln(hi) - ln(lo)) * range / 14), 6) AS lam FROM t, range(15)",
        "block_norms": f"WITH {GRAD} SELECT j, round(norm, 5) AS norm, round(mean, 5) AS mean FROM nm",
        "soft_threshold_step": f"WITH {GRAD}, t AS (SELECT max(norm) / 2 AS top FROM nm) SELECT gr.j, CAST(row_number() OVER (PARTITION BY gr.j ORDER BY g, s) - 1 AS INT) AS k, round(CASE WHEN norm > top THEN grad * (1 - top / norm) ELSE 0 END, 5) AS value FROM gr JOIN nm ON nm.j = gr.j, t",
        "tensor_inner_product": f"WITH {CELLS} SELECT subject, round(sum(value / (1 + g + j + s)), 4) AS y_hat FROM cells GROUP BY 1",
        "centred_prediction": f"WITH {CELLS}, m AS (SELECT g, j, s, avg(value) AS mv FROM cells GROUP BY 1, 2, 3), c2 AS (SELECT subject, sum((value - mv) / (1 + (cells.g * 4 + cells.j) * 2 + cells.s)) AS d FROM cells JOIN m ON m.g = cells.g AND m.j = cells.j AND m.s = cells.s GROUP BY 1), my AS (SELECT avg(s_acctbal) AS y FROM supplier WHERE s_suppkey IN (SELECT subject FROM c2)) SELECT subject, round(y + d, 3) AS y_hat FROM c2, my WHERE subject IN (SELECT s_suppkey FROM supplier)",
        "tensor_contract_mode": f"WITH {CELLS} SELECT subject, j, s, round(sum(value * (g + 1) / 3.0), 5) AS value FROM cells GROUP BY 1, 2, 3",
        "kronecker": f"WITH {DENSE}, t AS (SELECT subject, slide, avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS w1, avg(CASE WHEN label = 2 THEN 1.0 ELSE 0.0 END) AS w2, sum(CASE WHEN label = 1 THEN tax ELSE 0 END) / count(tax) AS t1, sum(CASE WHEN label = 2 THEN tax ELSE 0 END) / count(tax) AS t2 FROM obj GROUP BY 1, 2) " + " UNION ALL ".join(f"SELECT subject, slide, {2 * a + b} AS k, round(w{a + 1} * t{b + 1}, 6) AS value FROM t" for a in (0, 1) for b in (0, 1)),
        "l1_normalize": f"WITH {NAIVE}, v AS (SELECT subject, abs(quantity) + abs(discount) + abs(tax) AS l, CASE WHEN abs(quantity) >= abs(discount) AND abs(quantity) >= abs(tax) THEN sign(-quantity) WHEN abs(discount) >= abs(tax) THEN sign(discount) ELSE sign(tax) END AS sg, quantity, discount, tax FROM av) " + " UNION ALL ".join(f"SELECT subject, {k} AS k, round({f} * sg / l, 6) AS value FROM v" for k, f in enumerate(("-quantity", "discount", "tax"))),
        "simple_ols": f"WITH {SLOPES} SELECT nation, j, n, round(slope, 3) AS slope, round(my - slope * mx, 2) AS intercept FROM sl",
        "hard_threshold_variants": f"WITH {GRAD}, c AS (SELECT unnest([0.001, 0.01, 0.02, 50.0]) AS thr) SELECT j, CAST(thr AS DOUBLE) AS thr, 'raw' AS kind, round(CASE WHEN abs(mean) < thr THEN 0.0 ELSE mean END, 4) AS beta FROM nm, c UNION ALL SELECT j, CAST(thr AS DOUBLE), 'norm', round(CASE WHEN norm < thr THEN 0.0 ELSE mean END, 4) FROM nm, c",
        "adaptive_threshold": f"WITH {RESID} SELECT l_returnflag, round(stddev_samp(r) * sqrt(2 * ln(40.0) / count(r)), 5) AS tau FROM res GROUP BY 1",
        "selection_metrics": f"WITH {SLOPES}, t AS (SELECT j, CASE WHEN abs(avg(slope)) > 10 THEN avg(slope) ELSE 0 END AS truth FROM sl GROUP BY j), ft AS (SELECT nation, CASE WHEN abs(slope) > 10 THEN slope ELSE 0 END AS beta, truth FROM sl JOIN t ON t.j = sl.j), sm AS (SELECT nation, sum(abs(beta)) AS sb, sum(abs(truth)) AS st FROM ft GROUP BY 1) SELECT ft.nation, round(coalesce(avg(CASE WHEN abs(truth) > 1e-6 THEN CASE WHEN abs(beta) > 1e-6 THEN 1.0 ELSE 0.0 END END), -1), 6) AS tpr, round(coalesce(avg(CASE WHEN abs(truth) <= 1e-6 THEN CASE WHEN abs(beta) > 1e-6 THEN 1.0 ELSE 0.0 END END), -1), 6) AS fpr, round(sum(abs(CASE WHEN sb > 0 THEN beta / sb ELSE 0 END - CASE WHEN st > 0 THEN truth / st ELSE 0 END)), 5) AS l1 FROM ft JOIN sm ON sm.nation = ft.nation GROUP BY ft.nation",
        "argmin_lambda": f"WITH {ERRORS}, o AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY mse, k) AS n FROM er) SELECT l_returnflag, k, round(CAST(lam AS DOUBLE), 6) AS lam, round(mse, 2) AS mse, CAST(k IN (0, 9) AS INT) AS at_boundary FROM o WHERE n = 1",
        "lambda_spread_rule": f"WITH {ERRORS}, m AS (SELECT l_returnflag, min(mse) + stddev_pop(mse) / sqrt(5.0) AS most FROM er GROUP BY 1) SELECT er.l_returnflag, round(CAST(max(lam) AS DOUBLE), 6) AS lam FROM er JOIN m ON m.l_returnflag = er.l_returnflag WHERE mse <= most GROUP BY 1",
        "metric_summary": "SELECT event_type, count(value) FILTER (WHERE event_id % 7 <> 0) AS n, round(avg(value) FILTER (WHERE event_id % 7 <> 0), 5) AS mean, round(median(value) FILTER (WHERE event_id % 7 <> 0), 5) AS median FROM events GROUP BY 1",
        "missing_settings": "SELECT b.p_brand, s.p_size FROM (SELECT DISTINCT p_brand FROM part) b, (SELECT DISTINCT p_size FROM part) s WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part p ON l_partkey = p_partkey WHERE l_quantity >= 50 AND p.p_brand = b.p_brand AND p.p_size = s.p_size)",
        "ratio_to_first": f"WITH {ERRORS} SELECT l_returnflag, k, round(mse / first_value(mse) OVER (PARTITION BY l_returnflag ORDER BY k), 6) AS ratio FROM er",
        "outcome_statistics": "SELECT round(avg(s_acctbal), 4) AS mean, round(stddev_pop(s_acctbal), 4) AS sd, min(s_acctbal) AS least, max(s_acctbal) AS most FROM supplier",
    }
