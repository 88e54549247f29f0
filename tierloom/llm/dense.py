"""Small dense linear algebra by NumPy's own loops.

LAPACK and BLAS start threads of their own, which can lock up in a driver whose JVM was forked beside them;
nothing here calls either.
"""

from __future__ import annotations

import numpy as np


def inverse(matrix: np.ndarray) -> np.ndarray:
    """Inverse by Gauss-Jordan elimination with row pivots; a singular matrix raises ValueError."""
    n = len(matrix)
    work = np.concatenate([matrix.astype(float), np.eye(n)], axis=1)
    for k in range(n):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        if not work[pivot, k]:
            raise ValueError("the matrix is singular")
        if pivot != k:
            work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        factors = work[:, k].copy()
        factors[k] = 0
        touched = np.flatnonzero(factors)
        work[touched] -= factors[touched, None] * work[k]
    return work[:, n:]


def product(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Matrix times vector."""
    return (matrix * vector).sum(axis=1)


def solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution of a square system."""
    return product(inverse(matrix), right)
