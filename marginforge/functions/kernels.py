"""Kernel formulas: as SQL expressions over sufficient sums, and as numpy tiles.

Values are exponents, halved and negated: minus half a squared distance for
rbf and chi2, half the sum of minima for intersection, the dot product for linear.
A kernel is built from sums over shared indexes only (see SPARSE), so the sparse
join is an equi-join on the index with a hash aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: name -> (term of a shared index from columns va, vb; value from its sum t and the rows' sums sa, qa, na, sb, qb, nb)
SPARSE: dict[str, tuple[Callable[[Column, Column], Column], Callable[[Column], Column]]] = {}
#: name -> numpy tile function (A rows x B rows)
DENSE: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {}
#: Names of tile functions whose values do not depend on the order of two rows.
SYMMETRIC: set[str] = set()


def sparse_kernel(name: str, term, value) -> None:
    """Register a kernel by its shared-index term and final expression."""
    SPARSE[name] = (term, value)


def dense_kernel(name: str, tile, symmetric: bool = False) -> None:
    """Register a numpy tile function; the slot for user kernels, which are not taken to be symmetric unless they say so."""
    DENSE[name] = tile
    (SYMMETRIC.add if symmetric else SYMMETRIC.discard)(name)


_c = F.col

_chi2 = lambda a, b: F.when(a + b == 0, F.lit(0.0)).otherwise(a * b / (a + b))
_chi2_d = lambda t: _c("sa") + _c("sb") - 4 * t
sparse_kernel("linear", lambda a, b: a * b, lambda t: t)
sparse_kernel("intersection", lambda a, b: F.least(a, b), lambda t: t / 2)
sparse_kernel("rbf", lambda a, b: a * b, lambda t: -(_c("qa") + _c("qb") - 2 * t) / 2 + 0.0)
# One empty row, or both: distance 2.
sparse_kernel("chi2", _chi2, lambda t: F.when((_c("na") == 0) | (_c("nb") == 0), F.lit(-1.0)).otherwise(-_chi2_d(t) / 2 + 0.0))
# Exactly one empty row: distance 2; both empty: 0.
sparse_kernel("chi2_zeros", _chi2, lambda t: F.when((_c("na") == 0) != (_c("nb") == 0), F.lit(-1.0)).otherwise(-_chi2_d(t) / 2 + 0.0))
sparse_kernel("chi2_plain", _chi2, lambda t: -_chi2_d(t) / 2 + 0.0)


def _rbf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)
    near = d < 1e-6 * ((a * a).sum(1)[:, None] + (b * b).sum(1))  # cancellation: take these directly
    if near.any():
        i, j = np.nonzero(near)
        d[i, j] = ((a[i] - b[j]) ** 2).sum(1)
    return -d / 2


def _chi2_tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    for k, row in enumerate(a):
        s = row + b
        with np.errstate(divide="ignore", invalid="ignore"):
            out[k] = -np.where(s == 0, 0.0, (row - b) ** 2 / s).sum(1) / 2
    return out


dense_kernel("linear", lambda a, b: a @ b.T, True)
dense_kernel("rbf", _rbf, True)
dense_kernel("intersection", lambda a, b: np.stack([np.minimum(r, b).sum(1) / 2 for r in a]) if len(a) else np.zeros((0, len(b))), True)
dense_kernel("chi2", _chi2_tile, True)


def rounded(k: np.ndarray, digits: int = 6) -> np.ndarray:
    """To ``digits`` places, halves away from zero, and no -0; values too large for that stay."""
    with np.errstate(over="ignore", invalid="ignore"):
        v = k * 10.0**digits
        whole = np.trunc(v)
        whole += np.copysign(np.abs(v - whole) >= 0.5, v)
    return np.where(np.isfinite(whole), whole / 10.0**digits, k) + 0.0


class Rbf:
    """exp(-gamma |x - y|^2)."""

    def __init__(self, gamma: float):
        self.gamma = gamma

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(2 * self.gamma * _rbf(a, b))

    def sides(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(L, R) with exponents L @ R.T; None where rows are so long that their cancellation would show."""
        q = self.gamma * (x * x).sum(1)
        if not len(x) or not q.max() < 1e4:
            return None
        one = np.ones(len(x))
        return np.column_stack([2 * self.gamma * x, -q, one]), np.column_stack([x, one, -q])

    def single(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(rows, s) in single precision: values are exp(2 gamma rows @ rows.T), times s of either side; None where rows are not single or too long for that."""
        q, rows = self.gamma * (x * x).sum(1), x.astype(np.float32)
        if not len(x) or not q.max() < 20 or not (rows == x).all():
            return None
        return rows, np.exp(-q)

    def quick(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The values to about 1e-11, by one product and one exp where rows are short enough."""
        left, right = self.sides(a), self.sides(b)
        if left is None or right is None:
            return self(a, b)
        k = left[0] @ right[1].T
        return np.exp(np.minimum(k, 0, out=k), out=k)


def standard(kind: str, gamma: float = 1.0, coef0: float = 0.0, degree: int = 3) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The solver library's own kernels: linear, poly, rbf, sigmoid."""
    return {
        "linear": lambda a, b: a @ b.T,
        "poly": lambda a, b: (gamma * (a @ b.T) + coef0) ** degree,
        "rbf": Rbf(gamma),
        "sigmoid": lambda a, b: np.tanh(gamma * (a @ b.T) + coef0),
    }[kind]


def standard_expr(kind: str, dot: Column, qa: Column, qb: Column, gamma: float = 1.0, coef0: float = 0.0, degree: int = 3) -> Column:
    """The same as expressions over a dot product and squared lengths."""
    return {
        "linear": dot,
        "poly": F.pow(gamma * dot + coef0, F.lit(degree)),
        "rbf": F.exp(-gamma * (qa + qb - 2 * dot)),
        "sigmoid": F.tanh(gamma * dot + coef0),
    }[kind]


def training_value(exponent: Column, gamma: Column | float, transform: str = "exp") -> Column:
    """What the trainer sees: exp(gamma * exponent) whatever the kernel, or the value itself."""
    return F.exp(gamma * exponent) if transform == "exp" else exponent


def sigmoid(f: Column, a: Column | float, b: Column | float) -> Column:
    """1 / (1 + exp(a f + b)) without overflow."""
    z = a * f + b
    return F.when(z >= 0, F.exp(-z) / (1 + F.exp(-z))).otherwise(1 / (1 + F.exp(z)))


def clamp_probability(p: Column, least: float = 1e-7) -> Column:
    return F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))
