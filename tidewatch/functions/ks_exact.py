"""Exact two-sample Kolmogorov-Smirnov p-values by counting lattice paths.

Under the null hypothesis every order of the pooled values is equally likely, so
the p-value is the part of the monotone lattice paths from (0, 0) to (n, m) that
leave the band |i / n - j / m| < d. A path to (i, j) comes from (i - 1, j) with
probability i / (i + j), so the part that has left follows diagonal by diagonal,
without large numbers and without cancellation in small p-values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidewatch.functions.ks_finite import finite_pvalue

#: Fixed value: both samples at most this large are tested exactly, as is usual for "auto" methods.
EXACT_ROWS = 10_000


def exact_pvalue(d: float, n: int, m: int) -> float:
    """P(D >= d) for samples of n and m values."""
    # |i m - j n| as an integer, against the statistic on the same grid (D is a multiple of 1 / lcm)
    g = math.gcd(n, m)
    edge = round(d * (n // g) * m) * g
    if edge <= 0:
        return 1.0
    left = np.ones(n + 3)  # left[i + 1]: the part of the paths to (i, t - i) that have left the band
    left[1] = 0.0
    for t in range(1, n + m + 1):
        low = max(0, t - m, (t * n - edge) // (n + m) + 1)
        high = min(n, t, -((-t * n - edge) // (n + m)) - 1)
        if low > high:
            return 1.0
        i = np.arange(low, high + 1)
        left[low + 1:high + 2] = (left[low:high + 1] * i + left[low + 1:high + 2] * (t - i)) / t
        left[low] = 1.0
    return float(min(1.0, left[n + 1]))


def two_sample_pvalue(d: float, n: int, m: int) -> float:
    """P(D >= d): exact where both samples have at most EXACT_ROWS values, finite-n beyond."""
    if max(n, m) <= EXACT_ROWS:
        return exact_pvalue(d, n, m)
    return finite_pvalue(d, max(1, round(n * m / (n + m))))


def ks_pvalue_auto(d: Column, n_ref: Column, n_cur: Column) -> Column:
    """Exact for samples of at most EXACT_ROWS values, beyond by the finite distribution of round(nm / (n + m)) values.

    For results of tests (one row a feature, or a window and feature), not for input rows.
    """
    @pandas_udf("double")
    def exact(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ds, ns, ms in parts:
            yield pd.Series([two_sample_pvalue(x, int(n), int(m)) if x == x and n > 0 and m > 0 else None
                             for x, n, m in zip(ds, ns, ms, strict=True)], dtype="float64")

    rows = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return exact(d.cast("double"), rows(n_ref), rows(n_cur))
