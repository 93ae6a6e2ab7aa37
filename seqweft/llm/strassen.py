"""Exact products of whole-number matrices by Strassen's recursion."""

from __future__ import annotations

import numpy as np

#: Below this size of a side the recursion's additions cost more than the product they save.
LEAF = 32
_EXACT = float(1 << 53)


def leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The plain product; in doubles where every partial sum is a whole number that a double holds exactly."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    # As floats, so that the bound itself can't wrap around.
    largest = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if largest < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def even(m: np.ndarray) -> np.ndarray:
    """The matrix with a row or a column of zeros added where a side is odd."""
    rows, columns = m.shape[0] % 2, m.shape[1] % 2
    return np.pad(m, ((0, rows), (0, columns))) if rows or columns else m


def quarters(m: np.ndarray) -> tuple[np.ndarray, ...]:
    r, c = m.shape[0] // 2, m.shape[1] // 2
    return m[:r, :c], m[:r, c:], m[r:, :c], m[r:, c:]


def multiply(a: np.ndarray, b: np.ndarray, smallest: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices: seven products of halves instead of eight, sides of odd length padded with zeros.

    Additions are whole numbers modulo 2^64, so the result is what int64 arithmetic gives, exactly.
    """
    m, n = a.shape[0], b.shape[1]
    if min(m, a.shape[1], n) <= smallest:
        return leaf(a, b)
    a11, a12, a21, a22 = quarters(even(a))
    b11, b12, b21, b22 = quarters(even(b))
    p1 = multiply(a11 + a22, b11 + b22, smallest)
    p2 = multiply(a21 + a22, b11, smallest)
    p3 = multiply(a11, b12 - b22, smallest)
    p4 = multiply(a22, b21 - b11, smallest)
    p5 = multiply(a11 + a12, b22, smallest)
    p6 = multiply(a21 - a11, b11 + b12, smallest)
    p7 = multiply(a12 - a22, b21 + b22, smallest)
    r, c = p1.shape
    out = np.empty((2 * r, 2 * c), np.int64)
    out[:r, :c] = p1 + p4 - p5 + p7
    out[:r, c:] = p3 + p5
    out[r:, :c] = p2 + p4
    out[r:, c:] = p1 - p2 + p3 + p6
    return out[:m, :n]
