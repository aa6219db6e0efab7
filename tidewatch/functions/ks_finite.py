"""The Kolmogorov distribution for a finite number of values, P(D_n >= d).

Large two-sample tests take it with n = round(nm / (n + m)). Each part of the range
has the method that is accurate there:

* the far tail is twice the one-sided probability, a sum over the places where the
  empirical distribution first crosses (two crossings at once are negligible from n d^2 = 2.2 on);
* small n d^1.5, and n up to 140, take the power of a matrix whose order is about 2 n d;
* elsewhere the limiting distribution with its corrections in n^-1/2, n^-1 and n^-3/2.
"""

from __future__ import annotations

import math

import numpy as np

#: Limits of the methods: values that are summed one by one, far tail, matrix.
SUMMED, TAIL, TAIL_SMALL, SMALL, MATRIX_N, MATRIX = 1_000_000, 2.2, 4.0, 140, 100_000, 1.4


def one_sided(n: int, d: float) -> float:
    """P(D+ >= d)."""
    if n > SUMMED:  # the tail's expansion, whose relative error falls as 1 / n
        return math.exp(-((6.0 * n * d + 1.0) ** 2) / (18.0 * n))
    j = np.arange(0, math.floor(n * (1.0 - d)) + 1, dtype=np.float64)
    rest = 1.0 - d - j / n
    j, rest = j[rest > 0], rest[rest > 0]
    logs = np.cumsum(np.log(np.maximum(np.arange(n + 1, dtype=np.float64), 1.0)))  # log factorials
    at = j.astype(np.int64)
    terms = logs[n] - logs[at] - logs[n - at] + (j - 1) * np.log(d + j / n) + (n - j) * np.log(rest)
    top = terms.max()
    return float(d * math.exp(top) * np.exp(terms - top).sum())


def matrix_cdf(n: int, d: float) -> float:
    """P(D_n < d) by the n-th power of a (2k - 1)-square matrix, k = ceil(n d); powers of ten are kept apart."""
    k = math.ceil(n * d)
    m, h = 2 * k - 1, k - n * d
    rows, columns = np.indices((m, m))
    H = (rows - columns + 1 >= 0).astype(np.float64)
    powers = h ** np.arange(1, m + 1)
    H[:, 0] -= powers
    H[m - 1, :] -= powers[::-1]
    if 2 * h - 1 > 0:
        H[m - 1, 0] += (2 * h - 1) ** m
    fact = np.concatenate([[1.0], np.cumprod(np.arange(1, m + 1, dtype=np.float64))]) if m < 170 else None
    step = rows - columns + 1
    if fact is not None:
        H = np.where(step > 0, H / fact[np.clip(step, 0, m)], H)
    else:
        H = np.where(step > 0, H * np.exp(-np.array([math.lgamma(s + 1) for s in range(m + 1)]))[np.clip(step, 0, m)], H)

    def scaled(a: np.ndarray, e: int) -> tuple[np.ndarray, int]:
        s = math.frexp(float(np.abs(a).max()))[1]
        return np.ldexp(a, -s), e + s

    result, re, base, be, left = np.eye(m), 0, H, 0, n
    while left:
        if left & 1:
            result, re = scaled(result @ base, re + be)
        left >>= 1
        if left:
            base, be = scaled(base @ base, 2 * be)
    log = math.log(max(result[k - 1, k - 1], 5e-324)) + re * math.log(2.0)
    # times n! / n^n
    log += math.lgamma(n + 1) - n * math.log(n)
    return min(1.0, math.exp(log)) if log < 1 else 1.0


def expanded_cdf(n: int, d: float) -> float:
    """P(D_n < d) by the limiting distribution and three corrections."""
    z = math.sqrt(n) * d
    z2, pi2 = z * z, math.pi ** 2
    top = math.ceil(16 * z / math.pi) + 2
    k = np.arange(-top, top + 1, dtype=np.float64)
    half2, whole2 = (k + 0.5) ** 2, k ** 2
    eh, ew = np.exp(-pi2 * half2 / (2 * z2)), np.exp(-pi2 * whole2 / (2 * z2))
    root = math.sqrt(math.pi / 2)
    k0 = math.sqrt(2 * math.pi) / z * np.exp(-((2 * np.arange(1, top + 2) - 1) ** 2) * pi2 / (8 * z2)).sum()
    k1 = root / (6 * z ** 4) * ((pi2 * half2 - z2) * eh).sum()
    k2 = (root / (72 * z ** 7) * ((6 * z ** 6 + 2 * z ** 4 + pi2 * (2 * z ** 4 - 5 * z2) * half2 + pi2 ** 2 * (1 - 2 * z2) * half2 ** 2) * eh).sum()
          - root / (36 * z ** 3) * (pi2 * whole2 * ew).sum())
    k3 = (root / (6480 * z ** 10) * ((pi2 ** 3 * half2 ** 3 * (5 - 30 * z2) + pi2 ** 2 * half2 ** 2 * (-60 * z2 + 212 * z ** 4)
                                      + pi2 * half2 * (135 * z ** 4 - 96 * z ** 6) - (30 * z ** 6 + 90 * z ** 8)) * eh).sum()
          + root / (216 * z ** 6) * ((-pi2 ** 2 * whole2 ** 2 + 3 * pi2 * whole2 * z2) * ew).sum())
    return float(k0 + k1 / n ** 0.5 + k2 / n + k3 / n ** 1.5)


def finite_pvalue(d: float, n: int) -> float:
    """P(D_n >= d) for n values."""
    if n < 1 or d <= 0.5 / n:
        return 1.0
    if d >= 1:
        return 0.0
    nd2 = n * d * d
    if nd2 >= 370:
        return 0.0
    if nd2 >= (TAIL_SMALL if n <= SMALL else TAIL):
        return min(1.0, 2.0 * one_sided(n, d))
    below = matrix_cdf(n, d) if n <= SMALL or (n <= MATRIX_N and n * d ** 1.5 <= MATRIX) else expanded_cdf(n, d)
    return min(1.0, max(0.0, 1.0 - below))
