"""Leading eigenpairs of a symmetric matrix, in double precision.

Householder reflections bring the matrix to tridiagonal form; counting the
negative pivots of a shifted tridiagonal matrix (Sturm) tells how many
eigenvalues lie below the shift, so bisection finds each leading one; inverse
iteration gives its vector, made orthogonal to the earlier vectors of its
cluster; the reflections bring the vectors back. The matrix is d x d, whatever
the number of rows it was summed from.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
CLUSTER = 1e-3  # eigenvalues this near, of the matrix's size, make a cluster
STEPS = 200
SOLVES = 5


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Diagonal, off-diagonal and unit reflectors (first row, vector)."""
    a = np.array(a, float)
    reflectors = []
    for k in range(len(a) - 2):
        x = a[k + 1:, k]
        if not np.any(x[1:]):
            continue
        scale = np.abs(x).max()
        u = x / scale
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        u /= np.linalg.norm(u)
        column = x - 2 * u * (u @ x)
        block = a[k + 1:, k + 1:]
        p = 2 * (block @ u)
        w = p - (u @ p) * u
        block -= np.outer(u, w) + np.outer(w, u)
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = column[0]
        reflectors.append((k + 1, u))
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def count_below(diag: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Number of eigenvalues below each shift."""
    tiny = np.finfo(float).tiny / EPS
    squares = off * off
    count = np.zeros(len(shifts), np.int64)
    q = np.ones(len(shifts))
    for k in range(len(diag)):
        q = diag[k] - shifts - (squares[k - 1] / q if k else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)  # a zero counts as below
        count += q < 0
    return count


def leading_values(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling."""
    d = len(diag)
    around = np.zeros(d)
    around[:-1] += np.abs(off)
    around[1:] += np.abs(off)
    size = max(float(np.abs(diag).max() + around.max()), np.finfo(float).tiny)
    low = np.full(k, float((diag - around).min()) - EPS * size)
    high = np.full(k, float((diag + around).max()) + EPS * size)
    above = d - 1 - np.arange(k)  # so many eigenvalues lie below the wanted one
    for _ in range(STEPS):
        mid = (low + high) / 2
        if np.all((mid <= low) | (mid >= high)):
            break
        under = count_below(diag, off, mid) > above
        high = np.where(under, mid, high)
        low = np.where(under, low, mid)
    return (low + high) / 2


def solve_shifted(diag, off, shift: float, b: np.ndarray, size: float) -> np.ndarray:
    """Solve (T - shift) z = b by elimination with row exchange; a vanishing
    pivot becomes a rounding error, as inverse iteration wants it."""
    d, least = len(diag), EPS * size
    main, up, down = (diag - shift).tolist(), off.tolist() + [0.0], off.tolist()
    far = [0.0] * d
    z = b.tolist()
    for k in range(d - 1):
        if abs(main[k]) >= abs(down[k]):
            if abs(main[k]) < least:
                main[k] = least
            f = down[k] / main[k]
            main[k + 1] -= f * up[k]
            z[k + 1] -= f * z[k]
        else:  # the next row is the pivot
            f = main[k] / down[k]
            main[k], next_main = down[k], up[k] - f * main[k + 1]
            up[k], main[k + 1], old = main[k + 1], next_main, up[k + 1]
            far[k], up[k + 1] = old, -f * old
            z[k], z[k + 1] = z[k + 1], z[k] - f * z[k + 1]
    if abs(main[-1]) < least:
        main[-1] = least
    for k in range(d - 1, -1, -1):
        s = z[k]
        if k + 1 < d:
            s -= up[k] * z[k + 1]
        if k + 2 < d:
            s -= far[k] * z[k + 2]
        z[k] = s / main[k]
        if abs(z[k]) > 1e200:  # only the direction counts
            z = [x * 1e-200 for x in z]
    return np.array(z)


def vectors(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors as columns, for falling eigenvalues."""
    d = len(diag)
    size = max(float(np.abs(diag).max(initial=0) + 2 * np.abs(off).max(initial=0)),
               np.finfo(float).tiny)
    out = np.zeros((d, len(values)))
    first, shift = 0, 0.0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * size:
            first = j
        # equal eigenvalues get shifts a rounding error apart
        shift = min(value, shift - 2 * EPS * size) if j > first else value
        z = np.random.default_rng(j).uniform(0.5, 1.0, d)
        for _ in range(SOLVES):
            z = solve_shifted(diag, off, shift, z / np.linalg.norm(z), size)
            z /= np.abs(z).max()
            for _ in range(2):
                z -= out[:, first:j] @ (out[:, first:j].T @ z)
        out[:, j] = z / np.linalg.norm(z)
    return out


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors as columns."""
    a = np.array(a, float)
    k = min(k, len(a))
    size = float(np.abs(a).max(initial=0))
    if k == 0 or size == 0:
        return np.zeros(k), np.eye(len(a))[:, :k]
    diag, off, reflectors = tridiagonal(a / size)
    v = vectors(diag, off, leading_values(diag, off, k))
    for row, u in reversed(reflectors):
        v[row:] -= 2 * np.outer(u, u @ v[row:])
    v /= np.linalg.norm(v, axis=0)
    e = np.einsum("ij,ij->j", v, (a / size) @ v) * size
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]
