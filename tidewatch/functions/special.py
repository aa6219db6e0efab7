"""Special functions as JVM-side Column expressions.

Spark SQL has no incomplete gamma, no erf and no Kolmogorov distribution.
These are written with higher-order array functions (``aggregate`` over a
``sequence``), which Spark interprets; they run on the one-row-per-feature
results of the drift tests, never per input row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed numerical constants (not data): iteration counts and the floor used by
# the modified Lentz algorithm.
KS_TERMS = 100
GAMMA_ITER = 300
LENTZ_FLOOR = 1e-300
LN_SQRT_PI = 0.5723649429247001


def ks_pvalue(d: Column, n_ref: Column, n_cur: Column) -> Column:
    """Two-sample KS p-value from the Kolmogorov limiting distribution.

    p = 2 * sum_{k>=1} (-1)^(k-1) exp(-2 k^2 en D^2), en = n m / (n + m),
    clamped to [0, 1]; 1.0 when sqrt(en) * D < 0.1 (the series has not
    converged there and the true value is 1 to double precision).
    """
    en = n_ref.cast("double") * n_cur.cast("double") / (n_ref + n_cur).cast("double")
    x = en * d * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)),
        F.lit(0.0).cast("double"),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(-2.0 * k.cast("double") * k.cast("double") * x),
    )
    p = F.least(F.greatest(2.0 * series, F.lit(0.0)), F.lit(1.0))
    return (F.when(d.isNull() | en.isNull(), F.lit(None).cast("double"))
            .when(F.sqrt(en) * d < 0.1, F.lit(1.0))
            .otherwise(p))


def _ln_gamma_half(a2: Column) -> Column:
    """ln Gamma(a) for a = a2 / 2, a2 a positive integer (df of chi-square)."""
    # integer a: sum_{j=1}^{a-1} ln j ; half-integer a: ln sqrt(pi) + sum_{j=0}^{a-3/2} ln(j + 1/2)
    a_int = (a2 / 2).cast("int")
    int_part = F.aggregate(F.sequence(F.lit(1), F.greatest(a_int - 1, F.lit(1))),
                           F.lit(0.0).cast("double"),
                           lambda acc, j: acc + F.log(j.cast("double")))
    half_part = F.aggregate(F.sequence(F.lit(0), F.greatest(a_int - 1, F.lit(0))),
                            F.lit(0.0).cast("double"),
                            lambda acc, j: acc + F.log(j.cast("double") + 0.5))
    return F.when(a2 % 2 == 0, int_part).otherwise(F.lit(LN_SQRT_PI) + F.when(a_int >= 1, half_part).otherwise(0.0))


def chi2_sf(stat: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution, Q(dof/2, stat/2).

    Series for the lower gamma when x < a + 1, modified Lentz continued
    fraction for the upper gamma otherwise (both to double precision with
    GAMMA_ITER steps). Exact for any positive integer dof.
    """
    a = dof.cast("double") / 2.0
    x = stat.cast("double") / 2.0
    lng = _ln_gamma_half(dof.cast("int"))
    front = F.exp(-x + a * F.log(x) - lng)

    # lower series: sum_{n>=0} x^n / (a (a+1) ... (a+n))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(GAMMA_ITER)),
        F.struct((1.0 / a).alias("t"), (1.0 / a).alias("s")),
        lambda acc, n: F.struct(
            (acc["t"] * x / (a + n.cast("double"))).alias("t"),
            (acc["s"] + acc["t"] * x / (a + n.cast("double"))).alias("s")),
        lambda acc: acc["s"],
    )
    p_lower = front * series

    # upper continued fraction (modified Lentz)
    b0 = x + 1.0 - a
    init = F.struct(b0.alias("b"), F.lit(1.0 / LENTZ_FLOOR).alias("c"),
                    (1.0 / F.when(F.abs(b0) < LENTZ_FLOOR, F.lit(LENTZ_FLOOR)).otherwise(b0)).alias("d"),
                    (1.0 / F.when(F.abs(b0) < LENTZ_FLOOR, F.lit(LENTZ_FLOOR)).otherwise(b0)).alias("h"))

    def step(acc, i):
        ic = i.cast("double")
        an = -ic * (ic - a)
        b = acc["b"] + 2.0
        d = an * acc["d"] + b
        d = F.when(F.abs(d) < LENTZ_FLOOR, F.lit(LENTZ_FLOOR)).otherwise(d)
        c = b + an / acc["c"]
        c = F.when(F.abs(c) < LENTZ_FLOOR, F.lit(LENTZ_FLOOR)).otherwise(c)
        d = 1.0 / d
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))

    cf = F.aggregate(F.sequence(F.lit(1), F.lit(GAMMA_ITER)), init, step, lambda acc: acc["h"])
    q_upper = front * cf

    q = F.when(x < a + 1.0, 1.0 - p_lower).otherwise(q_upper)
    q = F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0))
    return (F.when(stat.isNull() | dof.isNull() | (dof <= 0), F.lit(None).cast("double"))
            .when(stat <= 0, F.lit(1.0))
            .otherwise(q))
