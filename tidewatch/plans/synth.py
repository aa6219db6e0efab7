"""Messy, sheet-like views derived from the given tables.

The cleaning operators target hand-typed clinical sheets. The test tables
are clean, so these views derive dirty text from them with a deterministic
md5-based token choice per row: the same choice in Spark and in DuckDB, and
the view grows with the table it reads. Each helper returns the Spark
Column and the SQL text of the same expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token pools used to dirty the derived views.
YES_NO_POOL = ["YES", "no", "Y", " n ", "TRUE", "false", "Positive", "NEGATIVE", "#", "", "N/A", "maybe", None]
SEX_POOL = ["M", "F", "Male", "female", " m ", "?", "UNKNOWN", None, "X"]
CULTURE_POOL = ["No growth", "Negative", "MTBC negative", "MTB Positive", "positive (scanty)", "contaminated", None]
CONVERSION_POOL = ["No conversion", "no conversion ", "Conversion", None]
BASELINE_POOL = ["Positive", "MTB Positive", "negative", "Negative", None, "positive"]
MONTH_POOL = ["MONTH ", "momth", "Montn ", "MOTNH", "week ", "Month"]


def _sql_lit(t):
    if t is None:
        return "NULL"
    return "'" + t.replace("'", "''") + "'"


def pick_col(key: Column, salt: str, pool: Sequence[str | None]) -> Column:
    """Token chosen by the first 32 bits of md5(key|salt)."""
    n = len(pool)
    h = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit("|" + salt))), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*[F.lit(t).cast("string") for t in pool]), (h % n + 1).cast("int"))


def pick_sql(key_sql: str, salt: str, pool: Sequence[str | None]) -> str:
    """The same choice in DuckDB SQL."""
    n = len(pool)
    return (f"([{', '.join(_sql_lit(t) + '::VARCHAR' for t in pool)}])"
            f"[1 + (('0x' || substr(md5(CAST({key_sql} AS VARCHAR) || '|{salt}'), 1, 8))::BIGINT % {n})]")


def uniform_col(key: Column, salt: str) -> Column:
    """Uniform in (0, 1) from 52 bits of md5(key|salt): the same value in Spark and DuckDB,
    whatever the partitioning."""
    return ((F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit("|" + salt))), 1, 13), 16, 10)
             .cast("double") + 0.5) / 4503599627370496.0)


def uniform_sql(key_sql: str, salt: str) -> str:
    return (f"((('0x' || substr(md5(CAST({key_sql} AS VARCHAR) || '|{salt}'), 1, 13))::BIGINT::DOUBLE + 0.5)"
            f" / 4503599627370496.0)")
