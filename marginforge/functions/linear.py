"""Linear solvers in numpy for one worker, and the losses of the distributed ones.

Weights are regularised with their bias: append the constant feature first.
"""

from __future__ import annotations

import numpy as np


def default_eps(solver: int) -> float:
    """Tolerance of a solver id where none is given."""
    return {0: 0.01, 2: 0.01, 5: 0.01, 6: 0.01, 11: 0.001}.get(solver, 0.1)


def loss_parts(kind: str, z: np.ndarray, y: np.ndarray, p: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, first, second derivative by z) of each row."""
    if kind == "logistic":
        m = y * z
        s = 1 / (1 + np.exp(-np.clip(-m, -500, 500)))  # sigmoid(-m)
        return np.logaddexp(0, -m), -y * s, s * (1 - s)
    if kind == "squared_hinge":
        d = np.maximum(1 - y * z, 0)
        return d * d, -2 * y * d, 2.0 * (d > 0)
    if kind == "squared_tube":
        r = z - y
        d = np.sign(r) * np.maximum(np.abs(r) - p, 0)
        return d * d, 2 * d, 2.0 * (np.abs(r) > p)
    raise ValueError(f"no such loss: {kind}")


def hinge_dual(X: np.ndarray, y: np.ndarray, C: np.ndarray, squared: bool, eps: float = 0.1, rounds: int = 1000, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(w, alpha) of the L2-regularised (squared) hinge loss by dual coordinate descent."""
    n = len(y)
    a, w = np.zeros(n), np.zeros(X.shape[1])
    extra = 0.5 / C if squared else np.zeros(n)
    top = np.full(n, np.inf) if squared else C
    q = (X * X).sum(1) + extra
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst_hi, worst_lo = -np.inf, np.inf
        for i in rng.permutation(n):
            g = y[i] * (X[i] @ w) - 1 + extra[i] * a[i]
            proj = min(g, 0) if a[i] == 0 else max(g, 0) if a[i] >= top[i] else g
            worst_hi, worst_lo = max(worst_hi, proj), min(worst_lo, proj)
            if abs(proj) > 1e-12 and q[i] > 0:
                new = min(max(a[i] - g / q[i], 0), top[i])
                w += (new - a[i]) * y[i] * X[i]
                a[i] = new
        if worst_hi - worst_lo <= eps:
            break
    return w, a


def tube_dual(X: np.ndarray, z: np.ndarray, C: float, p: float, squared: bool, eps: float = 0.1, rounds: int = 1000, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(w, beta) of support-vector regression with a (squared) tube loss by dual coordinate descent."""
    n = len(z)
    b, w = np.zeros(n), np.zeros(X.shape[1])
    lam, top = (0.5 / C, np.inf) if squared else (0.0, C)
    q = (X * X).sum(1) + lam
    rng = np.random.default_rng(seed)
    first = None
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(n):
            g = X[i] @ w - z[i] + lam * b[i]
            # Minimum of q/2 d^2 + g d + p |b + d| inside the box.
            new = b[i] - (g + p) / q[i]
            if new < 0:
                new = b[i] - (g - p) / q[i]
                if new > 0:
                    new = 0.0
            new = min(max(new, -top), top)
            if new != b[i]:
                moved += abs(new - b[i]) * q[i]
                w += (new - b[i]) * X[i]
                b[i] = new
        first = first or moved
        if moved <= eps * first:
            break
    return w, b


def crammer_singer(X: np.ndarray, k: np.ndarray, classes: int, C: np.ndarray, eps: float = 0.1, rounds: int = 1000, seed: int = 0) -> np.ndarray:
    """Weights (classes x features) of the joint multi-class machine, by exact steps on one row's block at a time."""
    n = len(k)
    W, a = np.zeros((classes, X.shape[1])), np.zeros((n, classes))
    q = (X * X).sum(1)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(n):
            if q[i] <= 0:
                continue
            margin = W @ X[i] + 1.0
            margin[k[i]] -= 1.0
            cap = np.zeros(classes)
            cap[k[i]] = C[i]
            can = a[i] < cap
            worst = max(worst, margin.max() - (margin[can].min() if can.any() else margin.max()))
            # min q/2 |new|^2 + b'new with sum 0 and new <= cap: new = min(cap, (t - b) / q) for the right t.
            b = margin - q[i] * a[i]
            points = np.sort(b + q[i] * cap)[::-1]
            t, total = 0.0, 0.0
            for m in range(1, classes + 1):
                total += points[m - 1]
                t = (total - q[i] * C[i]) / m
                if m == classes or t >= points[m]:
                    break
            new = np.minimum(cap, (t - b) / q[i])
            W += np.outer(new - a[i], X[i])
            a[i] = new
        if worst <= eps:
            break
    return W


def soft_newton(H: np.ndarray, g: np.ndarray, w: np.ndarray, l1: float, rounds: int = 500) -> np.ndarray:
    """Minimiser over v of g'(v - w) + 1/2 (v - w)'H(v - w) + l1 |v|_1 by coordinate descent."""
    v, r = w.copy(), np.zeros(len(w))  # r = H (v - w)
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(w)):
            h = max(H[j, j], 1e-12)
            b = h * v[j] - (g[j] + r[j])
            new = np.sign(b) * max(abs(b) - l1, 0) / h
            if new != v[j]:
                r += H[:, j] * (new - v[j])
                moved = max(moved, abs(new - v[j]))
                v[j] = new
        if moved < 1e-12 * (1 + np.abs(v).max()):
            break
    return v
