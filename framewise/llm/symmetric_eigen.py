"""Leading eigenvectors of a small symmetric matrix: Householder tridiagonalisation, Sturm-count
bisection, inverse iteration with reorthogonalisation inside clusters.

The matrix is as wide as a vector has dimensions, whatever the number of rows it came from.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
CLUSTER = 1e-3  # eigenvalues closer than this, relative to the largest, share a subspace


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, e, q): diagonal, off-diagonal and orthogonal q with matrix = q T q'."""
    a, n = np.array(matrix, float), len(matrix)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = np.abs(x[1:]).max()
        if size == 0:
            continue
        scale = np.abs(x).max()
        v = x / scale
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        # a := h a h with h = 1 - 2 v v', by a symmetric update of rank two
        p = a[:, k + 1 :] @ v
        inner = v @ p[k + 1 :]
        a[:, k + 1 :] -= 2 * np.outer(p, v)
        a[k + 1 :, :] -= 2 * np.outer(v, p)
        a[k + 1 :, k + 1 :] += 4 * inner * np.outer(v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), (np.diag(a, -1) + np.diag(a, 1)) / 2, q


def count_below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm count: for each x, how many eigenvalues are smaller."""
    tiny = EPS * max(np.abs(d).max(), np.abs(e).max(initial=0.0), np.finfo(float).tiny / EPS)
    pivot, n = d[0] - x, np.zeros(len(x), int)
    for i in range(len(d)):
        if i:
            pivot = d[i] - x - e[i - 1] ** 2 / pivot
        pivot = np.where(np.abs(pivot) < tiny * EPS, -tiny * EPS, pivot)
        n += pivot < 0
    return n


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each by bisection to the last bits."""
    n = len(d)
    beside = np.concatenate([[0], np.abs(e)]) + np.concatenate([np.abs(e), [0]])
    low, high = (d - beside).min(), (d + beside).max()
    margin = 2 * EPS * max(abs(low), abs(high)) + np.finfo(float).tiny
    low, high = np.full(k, low - margin), np.full(k, high + margin)
    want = n - np.arange(k)  # the j-th largest has n - j eigenvalues at or below it
    for _ in range(200):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        over = count_below(d, e, middle) >= want
        high, low = np.where(over, middle, high), np.where(over, low, middle)
    return (low + high) / 2


def solve_shifted(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """x with (T - shift) x = b, by elimination with row exchanges."""
    n = len(d)
    tiny = EPS * max(np.abs(d).max(), np.abs(e).max(initial=0.0), np.finfo(float).tiny / EPS)
    x, u, v, w = b.astype(float), d - shift, np.append(e, 0.0), np.zeros(n)
    low = e.copy()
    for i in range(n - 1):
        if abs(low[i]) > abs(u[i]):
            u[i], low[i] = low[i], u[i]
            v[i], u[i + 1] = u[i + 1], v[i]
            w[i], v[i + 1] = v[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        u[i] = u[i] if abs(u[i]) > tiny else tiny
        f = low[i] / u[i]
        u[i + 1] -= f * v[i]
        v[i + 1] -= f * w[i]
        x[i + 1] -= f * x[i]
    u[-1] = u[-1] if abs(u[-1]) > tiny else tiny
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - (v[i] * x[i + 1] if i + 1 < n else 0) - (w[i] * x[i + 2] if i + 2 < n else 0)) / u[i]
        size = np.abs(x[i:]).max()
        if size > 1e200:
            x /= size
    return x


def vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of T as columns; those of one cluster are made orthogonal to each other."""
    random = np.random.default_rng(0)
    found = np.zeros((len(d), len(values)))
    near = CLUSTER * max(np.abs(values).max(initial=0.0), np.finfo(float).tiny)
    first = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > near:
            first = j
        x = random.standard_normal(len(d))
        # equal shifts would find one vector again and again
        shift = value - (j - first) * EPS * np.abs(values).max()
        for _ in range(6):
            for _ in range(2):
                x -= found[:, first:j] @ (found[:, first:j].T @ x)
            x /= np.linalg.norm(x)
            x = solve_shifted(d, e, shift, x)
            x /= np.abs(x).max()
        for _ in range(2):
            x -= found[:, first:j] @ (found[:, first:j].T @ x)
            x /= np.linalg.norm(x)
        found[:, j] = x
    return found


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    if not len(matrix):
        return np.zeros(0), np.zeros((0, 0))
    scale = np.abs(matrix).max()
    if scale == 0:
        return np.zeros(min(k, len(matrix))), np.eye(len(matrix))[:, :k]
    d, e, q = tridiagonal(np.asarray(matrix, float) / scale)
    values = leading_values(d, e, min(k, len(d)))
    return values * scale, q @ vectors(d, e, values)
