"""Schema-tolerant projection helpers (plan-time column lists).

Column names in the data this library targets contain spaces, brackets and
question marks, so every reference goes through :func:`col`.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def col(name: str) -> Column:
    """Column reference that tolerates any character in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def numeric_columns(df: DataFrame, cols: Iterable[str] | None = None) -> list[str]:
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    names = list(cols) if cols is not None else df.columns
    return [c for c in names if c in types and is_numeric_type(types[c])]


def present(df: DataFrame, cols: Iterable[str]) -> list[str]:
    """The wanted columns that exist, in the wanted order."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def select_present(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Select only the wanted columns that exist."""
    return df.select(*[col(c) for c in present(df, cols)])


def reindex(df: DataFrame, cols: Iterable[str], types: Mapping[str, str] | None = None,
            default_type: str = "double") -> DataFrame:
    """Project to a fixed list; missing columns become typed nulls."""
    have = set(df.columns)
    types = types or {}
    return df.select(*[col(c) if c in have else F.lit(None).cast(types.get(c, default_type)).alias(c) for c in cols])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by map; names not present are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def strip_headers(df: DataFrame) -> DataFrame:
    """S3: trim surrounding spaces from every header."""
    return df.toDF(*[c.strip() for c in df.columns])


def skip_by_prefix(cols: Iterable[str], prefixes: tuple[str, ...], exclude: Iterable[str] = ()) -> list[str]:
    """Drop columns listed in ``exclude`` or starting with a prefix."""
    ex = set(exclude)
    return [c for c in cols if c not in ex and not c.startswith(prefixes)]


def coalesce_aliases(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Map API names to model column names; zeros are kept (not falsy-dropped).

    ``aliases`` maps api_name -> column name. When both exist the api value
    wins where it is not null.
    """
    out = df
    for api, name in aliases.items():
        if api not in out.columns:
            continue
        if name in out.columns:
            out = out.withColumn(name, F.coalesce(col(api), col(name))).drop(api)
        else:
            out = out.withColumnRenamed(api, name)
    return out


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row frame (fitted constants) to every row.

    A broadcast equi-join on a constant key: the right side holds exactly one
    row, so this is a lookup, not a product of two data sets.
    """
    return (df.withColumn("__one", F.lit(1))
            .join(F.broadcast(one_row.withColumn("__one", F.lit(1))), "__one", "inner")
            .drop("__one"))
