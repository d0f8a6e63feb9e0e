"""NumPy kernels of multi-view geometry, each over one bounded group.

Points are rows: (n, 2) or (n, 3).  Residuals are squared distances.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def isotropic(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points moved to mean zero and mean distance sqrt(2), and the 3x3 matrix that does it."""
    c = x.mean(0)
    s = np.sqrt(2) / max(np.linalg.norm(x - c, axis=1).mean(), 1e-12)
    return (x - c) * s, np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])


def ones(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def null_vector(a: np.ndarray) -> np.ndarray:
    return np.linalg.svd(a)[2][-1]


def homography(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """The matrix that takes x to y, from 4 points or more."""
    (x, s), (y, t) = isotropic(x), isotropic(y)
    h, o = ones(x), np.zeros((len(x), 3))
    a = np.vstack([np.hstack([h, o, -y[:, :1] * h]), np.hstack([o, h, -y[:, 1:] * h])])
    m = np.linalg.inv(t) @ null_vector(a).reshape(3, 3) @ s
    return [m / np.linalg.norm(m)]


def homography_residuals(m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = ones(x) @ m.T
    w = np.where(np.abs(z[:, 2:]) < 1e-12, 1e-12, z[:, 2:])
    return ((z[:, :2] / w - y) ** 2).sum(1)


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (ones(y)[:, :, None] * ones(x)[:, None]).reshape(len(x), 9)


def fundamental8(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """F with y' F x = 0, from 8 points or more, of rank two."""
    (x, s), (y, t) = isotropic(x), isotropic(y)
    u, d, v = np.linalg.svd(null_vector(_products(x, y)).reshape(3, 3))
    m = t.T @ (u * [d[0], d[1], 0]) @ v @ s
    return [m / np.linalg.norm(m)]


def fundamental7(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Up to three F from 7 points: those of the pencil a F1 + (1 - a) F2 whose determinant is zero."""
    (x, s), (y, t) = isotropic(x), isotropic(y)
    f1, f2 = np.linalg.svd(_products(x, y))[2][-2:].reshape(2, 3, 3)
    at = np.array([-1.0, 0.0, 1.0, 2.0])
    cubic = np.polyfit(at, [np.linalg.det(a * f1 + (1 - a) * f2) for a in at], 3)
    found = [t.T @ (a.real * f1 + (1 - a.real) * f2) @ s for a in np.roots(cubic) if abs(a.imag) < 1e-9]
    return [m / np.linalg.norm(m) for m in found]


def epipolar_residuals(f: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distance of y from the line of x."""
    line = ones(x) @ f.T
    return (ones(y) * line).sum(1) ** 2 / np.maximum((line[:, :2] ** 2).sum(1), 1e-24)


def sampson_residuals(f: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = ones(x) @ f.T, ones(y) @ f
    return (ones(y) * a).sum(1) ** 2 / np.maximum((a[:, :2] ** 2).sum(1) + (b[:, :2] ** 2).sum(1), 1e-24)


def essential_of(f: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    return k2.T @ f @ k1


def motions(e: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The four (R, t) of an essential matrix, |t| = 1."""
    u, _, v = np.linalg.svd(e)
    u, v = u * np.sign(np.linalg.det(u)), v * np.sign(np.linalg.det(v))
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    return [(u @ r @ v, s * u[:, 2]) for r in (w, w.T) for s in (1, -1)]


def triangulate(x: np.ndarray, cameras: np.ndarray) -> np.ndarray:
    """The point seen at x (n, 2) by cameras (n, 3, 4)."""
    a = np.vstack([x[:, :1] * cameras[:, 2] - cameras[:, 0], x[:, 1:] * cameras[:, 2] - cameras[:, 1]])
    p = null_vector(a / np.linalg.norm(a, axis=1, keepdims=True))
    return p[:3] / p[3]


def relative_pose(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of the four motions, that with most points before both cameras, and their number; x and y are normalised rays."""
    best, first = None, np.eye(3, 4)
    for r, t in motions(e):
        second = np.column_stack([r, t])
        p = np.array([triangulate(np.stack(q), np.stack([first, second])) for q in zip(x, y)])
        n = int(((p[:, 2] > 0) & ((p @ r.T + t)[:, 2] > 0)).sum())
        if best is None or n > best[2]:
            best = r, t, n
    return best


def resect(p: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """The 3x4 camera that sees points p at x, from 6 or more."""
    h, o = ones(p), np.zeros((len(p), 4))
    m = null_vector(np.vstack([np.hstack([h, o, -x[:, :1] * h]), np.hstack([o, h, -x[:, 1:] * h])])).reshape(3, 4)
    return [m * np.sign(np.linalg.det(m[:, :3]) or 1) / np.linalg.norm(m[2, :3])]


def rotation_between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The rotation that best takes directions x to y."""
    return nearest_rotation(y.T @ x)


def nearest_rotation(m: np.ndarray) -> np.ndarray:
    u, _, v = np.linalg.svd(m)
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ v))]) @ v


def similarity(n: float, sx: np.ndarray, sy: np.ndarray, xx: float, yx: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(scale, R, t) with y = scale R x + t by least squares, from the sums of 1, x, y, x.x and y x'."""
    mx, my = sx / n, sy / n
    c, var = yx / n - np.outer(my, mx), xx / n - mx @ mx
    r = nearest_rotation(c)
    s = float(np.trace(r.T @ c) / var)
    return s, r, my - s * r @ mx


def rounds_needed(sample: int, failure: float, inliers: float) -> int:
    """Draws until one of `sample` is all inliers but for a chance of `failure`."""
    good = inliers**sample
    return 1 if good >= 1 else int(np.ceil(np.log(failure) / np.log1p(-good))) if good > 0 else np.iinfo(np.int64).max


def log_alarms(residuals: np.ndarray, sample: int, log_alpha: float, power: float, models: int) -> np.ndarray:
    """log10 of the expected number of models, of uniform points, that have as many residuals as small; residuals ascend.

    Entry k - 1 stands for the k smallest; those up to the sample's size are infinite.
    """
    n = len(residuals)
    fact = np.concatenate([[0], np.cumsum(np.log10(np.arange(1, n + 1)))])
    k = np.arange(1, n + 1)
    choose = fact[n] - fact[k] - fact[n - k] + fact[k] - fact[sample] - fact[np.maximum(k - sample, 0)]
    out = np.log10(models * max(1, n - sample)) + choose + (k - sample) * np.minimum(0, log_alpha + power * np.log10(np.maximum(residuals, 1e-20)))
    out[:sample] = np.inf
    return out


def a_contrario(n: int, sample: int, fit: Callable, residuals: Callable, log_alpha: float, power: float, seed: int, rounds: int = 1024, models: int = 1):
    """(model, inliers, squared threshold, log10 of alarms), the threshold chosen with the model; None if no model is meaningful.

    fit(indices) gives models, residuals(model) all n residuals.  After the first
    meaningful model a tenth of the rounds draws from its inliers.
    """
    if n <= sample:
        return None
    rng, pool, left, best = np.random.default_rng(seed), np.arange(n), rounds, None
    while left > 0:
        left -= 1
        for m in fit(rng.choice(pool, sample, replace=False)):
            r = residuals(m)
            order = np.argsort(r, kind="stable")
            alarms = log_alarms(r[order], sample, log_alpha, power, models)
            k = int(alarms.argmin())
            if alarms[k] < 0 and (best is None or alarms[k] < best[3]):
                if best is None:
                    left = min(left, max(1, rounds // 10))
                best = m, np.sort(order[: k + 1]), float(r[order[k]]), float(alarms[k])
                if len(best[1]) > sample:
                    pool = best[1]
    return best


def least_median(n: int, sample: int, fit: Callable, residuals: Callable, seed: int, rounds: int = 500):
    """(model, median of squared residuals) with the least median."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(rounds if n >= sample else 0):
        for m in fit(rng.choice(n, sample, replace=False)):
            v = float(np.median(residuals(m)))
            if best is None or v < best[1]:
                best = m, v
    return best


def average_rotations(n: int, edges: list[tuple[int, int]], relative: np.ndarray, rounds: int = 20) -> np.ndarray:
    """n rotations with R_j = R_ij R_i, the first the identity: the leading eigenvectors, then reweighted by each edge's angle."""
    w = np.ones(len(edges))
    for _ in range(rounds):
        m = np.zeros((3 * n, 3 * n))
        for (i, j), r, x in zip(edges, relative, w):
            a, b = slice(3 * i, 3 * i + 3), slice(3 * j, 3 * j + 3)
            m[b, a] += x * r
            m[a, b] += x * r.T
            m[a, a] += -x * np.eye(3)
            m[b, b] += -x * np.eye(3)
        v = np.linalg.eigh(m)[1][:, -3:].reshape(n, 3, 3)
        v = v * (np.sign(np.linalg.det(v[0])) or 1)
        out = np.array([nearest_rotation(x) for x in v])
        out = out @ out[0].T
        angle = np.array([np.arccos(np.clip((np.trace(r @ out[i] @ out[j].T) - 1) / 2, -1, 1)) for (i, j), r in zip(edges, relative)])
        w = 1 / np.maximum(angle, 1e-4)
        w /= w.max()
    return out
