"""Imputation (I1, I2) and model-role typing of columns.

Fill values are fitted into a one-row DataFrame and attached with a
broadcast lookup, so fitting on one table (train) and applying to another
(test, a stream window) is the same call, and nothing passes through the
driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.columns import attach_row, col, is_numeric_type
from tidewatch.operators.profile import exact_quantiles, numeric_long, text_long

# Label and date columns the reference never imputes, and the
# fill used for a text column with no value at all.
TARGET_COLUMNS = ("TARGET_NON_CONVERSION_ANY", "TARGET_NON_CONVERSION_2M", "TARGET_NON_CONVERSION_5M",
                  "TARGET_SYMPTOM_PRESENT", "IS_IMPUTED", "TARGET_STRICT_M2", "M2_DISCORDANT")
DATE_COLUMNS = ("BASELINE", "DATE")
EMPTY_TEXT_FILL = "NO"


def _split(df: DataFrame, skip: Iterable[str]) -> tuple[list[str], list[str]]:
    skip = set(skip)
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in df.columns if c not in skip]
    num = [c for c in cols if is_numeric_type(types[c])]
    return num, [c for c in cols if c not in num]


def fit_fill_values(df: DataFrame, skip: Iterable[str] = TARGET_COLUMNS + DATE_COLUMNS,
                    buckets: int | None = None) -> DataFrame:
    """One row: median per numeric column (0 if all null), mode per other column
    (smallest value on ties, ``NO`` if all null). Column names are kept."""
    num, txt = _split(df, skip)
    spark = df.sparkSession
    parts = []
    if num:
        med = exact_quantiles(numeric_long(df, num), [0.5], buckets).select("feature", F.col("quantiles")[0].alias("m"))
        listed = spark.createDataFrame([(c,) for c in num], "feature string")
        med = listed.join(med, "feature", "left").select("feature", F.coalesce("m", F.lit(0.0)).alias("m"))
        parts.append(med.groupBy().pivot("feature", num).agg(F.first("m")))
    if txt:
        cnt = text_long(df, txt).groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n"))
        mode = cnt.groupBy("feature").agg(
            F.min_by("category", F.struct((-F.col("n")).alias("neg"), F.col("category"))).alias("m"))
        listed = spark.createDataFrame([(c,) for c in txt], "feature string")
        mode = listed.join(mode, "feature", "left").select("feature", F.coalesce("m", F.lit(EMPTY_TEXT_FILL)).alias("m"))
        parts.append(mode.groupBy().pivot("feature", txt).agg(F.first("m")))
    if not parts:
        return spark.range(1).select()
    out = parts[0]
    for p in parts[1:]:
        out = attach_row(out, p)
    return out


def apply_fill_values(df: DataFrame, values: DataFrame) -> DataFrame:
    """Fill nulls (and NaN in doubles) with the fitted values of matching columns."""
    fill_cols = [c for c in values.columns if c in df.columns]
    renamed = values.select(*[col(c).alias(f"__fill_{i}") for i, c in enumerate(fill_cols)])
    idx = {c: i for i, c in enumerate(fill_cols)}
    types = {f.name: f.dataType for f in df.schema.fields}
    joined = attach_row(df, renamed)
    out = []
    for c in df.columns:
        if c in idx:
            fv = F.col(f"__fill_{idx[c]}")
            if is_numeric_type(types[c]):
                # numeric columns come out as double, as a null-holding
                # integer column does in the reference
                x = col(c).cast("double")
                out.append(F.coalesce(F.nanvl(x, F.lit(None).cast("double")), fv.cast("double")).alias(c))
            else:
                out.append(F.coalesce(col(c), fv.cast(types[c])).alias(c))
        else:
            out.append(col(c))
    return joined.select(*out)


def impute(df: DataFrame, skip: Iterable[str] = TARGET_COLUMNS + DATE_COLUMNS, fitted_on: DataFrame | None = None,
           buckets: int | None = None) -> DataFrame:
    """I1 + I2. ``fitted_on`` fits the values on another table (e.g. train only)."""
    values = fit_fill_values(fitted_on if fitted_on is not None else df, skip, buckets)
    return apply_fill_values(df, values)


def feature_roles(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, role, position): numeric dtype -> numeric; <= 2 distinct -> binary;
    else categorical. One aggregate for the distinct counts."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in cols if c in types]
    spark = df.sparkSession
    txt = [c for c in cols if not is_numeric_type(types[c])]
    base = spark.createDataFrame([(c, i, is_numeric_type(types[c])) for i, c in enumerate(cols)],
                                 "feature string, position int, numeric boolean")
    if txt:
        nd = df.agg(*[F.count_distinct(col(c)).alias(c) for c in txt]).unpivot([], txt, "feature", "n_distinct")
        base = base.join(nd, "feature", "left")
    else:
        base = base.withColumn("n_distinct", F.lit(None).cast("long"))
    role = F.when(F.col("numeric"), "numeric").when(F.col("n_distinct") <= 2, "binary").otherwise("categorical")
    return base.select("feature", role.alias("role"), "position")
