"""Sparse linear solvers on sufficient statistics. Nothing here depends on the number of subjects.

Moments hold d predictors and, last, the outcome. Predictors that form a tensor carry a number for each mode.
"""

from __future__ import annotations

import numpy as np

from ravelin.operators.moments import Moments


def _centred(m: Moments) -> tuple[np.ndarray, np.ndarray]:
    c = m.covariance
    return c[:-1, :-1], c[:-1, -1]


def error(m: Moments, b: np.ndarray, centred: bool = True, shift: float = 0.0) -> float:
    """Mean squared error of predictions x b (+ shift) on the rows of ``m``, all centred or as they are."""
    c = m.covariance if centred else m.raw
    out = c[-1, -1] - 2 * b @ c[:-1, -1] + b @ c[:-1, :-1] @ b
    if not centred and shift:
        out += shift * shift - 2 * shift * (m.mean[-1] - b @ m.mean[:-1])
    return float(out)


def lasso(m: Moments, lam: float, sweeps: int = 100_000, tol: float = 1e-10) -> np.ndarray:
    """Coordinate descent at penalty lam / 2 on centred predictors of unit population deviation; coefficients on the old scale."""
    a, c = _centred(m)
    s = np.sqrt(np.clip(np.diag(a), 0, None))
    s = np.where(s > 1e-10, s, 1.0)
    a, c, alpha = a / np.outer(s, s), c / s, max(lam / 2, 1e-10)
    d = np.diag(a)
    b, left = np.zeros(len(c)), c.copy()  # left: c - a b
    for _ in range(sweeps):
        most = 0.0
        for j in np.flatnonzero(d > 1e-12):
            v = left[j] + d[j] * b[j]
            new = np.sign(v) * max(abs(v) - alpha, 0.0) / d[j]
            if new != b[j]:
                left -= a[:, j] * (new - b[j])
                most = max(most, abs(new - b[j]))
                b[j] = new
        if most <= tol * max(1.0, np.abs(b).max()):
            break
    return b / s


def least_squares(m: Moments) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of least norm; NaN where the moments hold what is no number."""
    a, c = _centred(m)
    if not (np.isfinite(a).all() and np.isfinite(c).all()):
        return float("nan"), np.full(len(c), np.nan)
    b = np.linalg.lstsq(a, c, rcond=None)[0]
    return float(m.mean[-1] - b @ m.mean[:-1]), b


def block_scale(m: Moments, feature: np.ndarray) -> np.ndarray:
    """Root mean square of each feature's block, 1 where it is tiny."""
    g = np.sqrt(np.bincount(feature, weights=np.clip(np.diag(m.raw)[:-1], 0, None)))
    return np.where(g > 1e-10, g, 1.0)


def block_norms(b: np.ndarray, feature: np.ndarray) -> np.ndarray:
    return np.sqrt(np.bincount(feature, weights=b * b))


def largest_penalty(m: Moments, feature: np.ndarray) -> float:
    """The least penalty at which the group lasso is all zero."""
    _, c = _centred(m)
    return float(block_norms(c / block_scale(m, feature)[feature], feature).max())


def penalty_grid(top: float, n: int = 15) -> np.ndarray:
    return np.geomspace(max(top / 1000, 1e-8), max(top, 1e-4), n)


def group_lasso(m: Moments, feature: np.ndarray, lam: float, rounds: int = 2_000, tol: float = 1e-6) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient, restarted where momentum points uphill, with blocks by feature and a free intercept: (intercept, coefficients)."""
    scale = block_scale(m, feature)[feature]
    a, c = _centred(m)
    a, c = a / np.outer(scale, scale), c / scale
    step = 1.0 / max(np.linalg.eigvalsh(m.raw[:-1, :-1] / np.outer(scale, scale))[-1], 1e-300)
    x = z = np.zeros(len(c))
    t = 1.0
    for _ in range(rounds):
        v = z - step * (a @ z - c)
        norm = block_norms(v, feature)
        new = v * np.where(norm > step * lam, 1 - step * lam / np.where(norm > 0, norm, 1), 0.0)[feature]
        if not np.isfinite(new).all():
            break
        if (z - new) @ (new - x) > 0:  # the momentum points uphill: start it anew
            t = 1.0
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, done = new + (was - 1) / t * (new - x), np.abs(new - x).max() < tol
        x = new
        if done:
            break
    b = x / scale
    return float(m.mean[-1] - b @ m.mean[:-1]), b


def signed(v: np.ndarray) -> tuple[np.ndarray, float]:
    """v over its L1 norm with its largest entry (the first among equals) positive, and the factor that restores it."""
    size = np.abs(v).sum()
    if size == 0:
        return v, 0.0
    factor = float(np.sign(v[np.argmax(np.abs(v))]) * size)
    return v / factor, factor


def _onto(mode: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The map from predictors to one column for each value of ``mode``, by weights of the predictors; the outcome passes."""
    d = len(mode)
    w = np.zeros((mode.max() + 2, d + 1))
    w[mode, np.arange(d)] = weights
    w[-1, -1] = 1
    return w


def alternating(m: Moments, modes: dict[str, np.ndarray], lam: float, start: dict[str, np.ndarray], sparse: str = "j", rounds: int = 50, tol: float = 0.01, compat: bool = False) -> dict[str, np.ndarray]:
    """Rank-one coefficients: a vector for each mode, of which ``sparse`` is a lasso and the others least squares in turn.

    Iterates that are no numbers end the rounds; the vectors before them are the result. Vectors are L1-normalized; entries under 0.001 are set to zero. The scale, with its sign, goes to the first mode that is not sparse.
    With ``compat`` the scale is the last one measured for that mode, without its sign, and the last least-squares vector of three
    modes stays as it is fitted.
    """
    others = [k for k in modes if k != sparse]
    v = {k: np.asarray(x, float).copy() for k, x in start.items()}
    v[others[0]] = signed(v[others[0]])[0]
    scale = float(np.abs(v[others[0]]).sum())
    product = lambda but=None: np.prod([v[k][modes[k]] for k in modes if k != but], axis=0)
    for _ in range(rounds):
        old = {k: x.copy() for k, x in v.items()}
        whole = product()
        size = float(np.prod([np.abs(v[k]).sum() for k in others]))
        v[sparse] = signed(lasso(m.mapped(_onto(modes[sparse], product(sparse))), lam * size))[0]
        if not np.isfinite(v[sparse]).all():
            v = old
            break
        if not np.abs(v[sparse]).max() > 0:
            break
        for n, k in enumerate(others):
            fitted = least_squares(m.mapped(_onto(modes[k], product(k))))[1]
            if not np.isfinite(fitted).all():
                break
            if compat and n and n == len(others) - 1:
                v[k] = fitted
                continue
            v[k], factor = signed(fitted)
            if not compat:
                scale = factor
            elif n == 0:
                scale = abs(factor)
        else:
            fitted = v[sparse]
        if not np.isfinite(fitted).all():  # the last vectors that are numbers count
            v = old
            break
        if len(modes) == 2:
            moved = np.linalg.norm(product() - whole)
        else:
            moved = sum(np.linalg.norm(v[k] - old[k]) for k in modes)
        if moved < tol or not all(np.abs(x).max() > 0 for x in v.values()):
            break
    for x in v.values():
        x[np.abs(x) < 0.001] = 0.0
    if not np.abs(v[sparse]).max() > 0:
        scale = 0.0
    v[others[0]] = scale * v[others[0]]
    return v


def coefficients(v: dict[str, np.ndarray], modes: dict[str, np.ndarray]) -> np.ndarray:
    """The vectors' product for each predictor."""
    return np.prod([v[k][modes[k]] for k in modes], axis=0)


def tensor_modes(clusters: int, features: int, slides: int) -> dict[str, np.ndarray]:
    """Cluster, feature and slide of each packed predictor."""
    at = np.arange(clusters * features * slides)
    return {"g": at // (features * slides), "j": at // slides % features, "s": at % slides}
