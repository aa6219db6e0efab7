"""Label, flag and row-wise derivations as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.normalize import strip_ws

# Culture results that mean "no growth" and the conversion text
# that marks a failure.
NEGATIVE_RESULTS = ["no growth", "negative", "mtbc negative"]
NO_CONVERSION = "no conversion"


def culture_label(c: Column) -> Column:
    """0 for a negative result, 1 when the text contains 'positive', else null."""
    s = F.lower(strip_ws(c.cast("string")))
    return (F.when(c.isNull(), F.lit(None).cast("int"))
            .when(s.isin(NEGATIVE_RESULTS), F.lit(0))
            .when(s.contains("positive"), F.lit(1))
            .otherwise(F.lit(None).cast("int")))


def contains_flag(c: Column, token: str = "Positive") -> Column:
    """Case-sensitive substring flag; null stays null."""
    return F.when(c.isNotNull(), c.cast("string").contains(token).cast("int"))


def yes_flag(c: Column) -> Column:
    """1 when exactly 'YES', else 0 (null included)."""
    return F.coalesce((c == F.lit("YES")).cast("int"), F.lit(0))


def count_yes(cols: Sequence[Column]) -> Column:
    """Number of columns whose trimmed upper value is YES (nulls count 0)."""
    if not cols:
        return F.lit(0)
    terms = [F.coalesce((F.upper(strip_ws(c.cast("string"))) == "YES").cast("int"), F.lit(0)) for c in cols]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def any_flag(flags: Sequence[Column]) -> Column:
    """Sum of 0/1 flags clipped to [0, 1]."""
    if not flags:
        return F.lit(0)
    total = flags[0]
    for f in flags[1:]:
        total = total + f
    return F.least(F.greatest(total, F.lit(0)), F.lit(1)).cast("int")


def max_or_zero(a: Column, b: Column) -> Column:
    """Null-skipping max of two labels, 0 when both are null."""
    return F.coalesce(F.greatest(a, b), F.lit(0)).cast("int")


def both_missing(a: Column, b: Column) -> Column:
    """C11: 1 when neither label is present."""
    return (a.isNull() & b.isNull()).cast("int")


def is_missing(c: Column) -> Column:
    """C12."""
    return c.isNull().cast("int")


def discordant(culture: Column, conversion: Column) -> Column:
    """Both present and (culture positive) != (conversion says no conversion)."""
    cf = F.lower(strip_ws(culture.cast("string"))).contains("positive")
    vf = F.lower(strip_ws(conversion.cast("string"))) == NO_CONVERSION
    return F.when(culture.isNotNull() & conversion.isNotNull(), (cf != vf).cast("int")).otherwise(F.lit(0))


def bmi(weight: Column, height: Column, height_in_cm: bool = False) -> Column:
    """C14: weight / height^2 with height in metres; non-finite -> null."""
    w = weight.cast("string").try_cast("double")
    h = height.cast("string").try_cast("double")
    if height_in_cm:
        h = h / 100.0
    v = F.try_divide(w, h * h)
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)


def confidence(p: Column) -> Column:
    """Max class probability for a binary score."""
    return F.greatest(p, 1.0 - p)
