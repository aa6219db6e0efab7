"""Value normalisers and safe casts as Column expressions.

All are built-in expressions (codegen, no Python per row). Python's
``str.strip`` removes any whitespace, so trimming uses a ``\\s`` regex rather
than ``trim`` (which only strips spaces).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token lists of the reference's normalisers.
YES_TOKENS = ["YES", "Y", "TRUE", "POSITIVE"]
NO_TOKENS = ["NO", "N", "FALSE", "NEGATIVE"]
NULL_TOKENS = ["#", "", "?", "UNKNOWN", "N/A", "NA"]
MALE_TOKENS = ["M", "MALE"]
FEMALE_TOKENS = ["F", "FEMALE"]
MONTH_SPELLINGS = ["month", "momth", "montn", "motnh"]


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _key(c: Column) -> Column:
    return F.upper(strip_ws(c.cast("string")))


def yes_no(c: Column) -> Column:
    """YES / NO / null by token list; anything else keeps the original value."""
    k = _key(c)
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(k.isin(YES_TOKENS), F.lit("YES"))
            .when(k.isin(NO_TOKENS), F.lit("NO"))
            .when(k.isin(NULL_TOKENS), F.lit(None).cast("string"))
            .otherwise(c.cast("string")))


def sex(c: Column) -> Column:
    """M / F / null by token list; anything else keeps the original value."""
    k = _key(c)
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(k.isin(MALE_TOKENS), F.lit("M"))
            .when(k.isin(FEMALE_TOKENS), F.lit("F"))
            .when(k.isin(NULL_TOKENS), F.lit(None).cast("string"))
            .otherwise(c.cast("string")))


def followup_month(c: Column) -> Column:
    """Lower-case, drop spaces; a (misspelt) 'month' with digits -> MONTH_<digits>."""
    s = F.replace(F.lower(strip_ws(c.cast("string"))), F.lit(" "), F.lit(""))
    digits = F.regexp_replace(s, r"[^0-9]", "")
    hit = s.rlike("|".join(MONTH_SPELLINGS))
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(hit & (F.length(digits) > 0), F.concat(F.lit("MONTH_"), digits))
            .otherwise(c.cast("string")))


def safe_double(c: Column) -> Column:
    """C4: numeric cast with bad values to null (ANSI-safe)."""
    return c.cast("string").try_cast("double")


def version_number(c: Column) -> Column:
    """First run of digits as int (v9 -> 9); 0 when there is none."""
    d = F.regexp_extract(c.cast("string"), r"\d+", 0)
    return F.coalesce(F.when(d != "", d.try_cast("int")), F.lit(0))


def salvage_json(c: Column, schema: str | None = None) -> Column:
    """C17: parse JSON out of noisy text.

    Strip a code fence (and a 'json' tag); try the whole text, then the
    outermost {...}, then the first element of the outermost [...]; else
    null. Returns a JSON string of the recovered object (``schema`` given:
    the parsed struct).
    """
    raw = strip_ws(c)
    fenced = F.when(raw.startswith("```"), F.split(raw, "```").getItem(1)).otherwise(raw)
    fenced = F.when(fenced.startswith("json"), F.substring(fenced, 5, 1 << 30)).otherwise(fenced)
    body = strip_ws(fenced)
    whole = F.when(F.try_parse_json(body).isNotNull(), body)
    brace = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    brace_ok = F.when((brace != "") & F.try_parse_json(brace).isNotNull(), brace)
    bracket = F.regexp_extract(body, r"(?s)\[.*\]", 0)
    first = F.when((bracket != "") & F.try_parse_json(bracket).isNotNull(),
                   F.to_json(F.try_variant_get(F.try_parse_json(bracket), "$[0]", "variant")))
    found = F.coalesce(whole, brace_ok, first)
    if schema:
        return F.from_json(found, schema)
    return found


def has_fields(json_text: Column, numeric: list[str], categorical: list[str]) -> Column:
    """Numeric features need 'mean', categorical need 'distribution'; absent ones pass.

    False when the text is not a JSON object.
    """
    v = F.try_parse_json(json_text)
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    checks = [is_obj]
    for f in numeric:
        fv = F.try_variant_get(v, f"$['{f}']", "variant")
        checks.append(fv.isNull() | (F.schema_of_variant(fv).startswith("OBJECT")
                                     & F.try_variant_get(fv, "$.mean", "variant").isNotNull()))
    for f in categorical:
        fv = F.try_variant_get(v, f"$['{f}']", "variant")
        checks.append(fv.isNull() | (F.schema_of_variant(fv).startswith("OBJECT")
                                     & F.try_variant_get(fv, "$.distribution", "variant").isNotNull()))
    out = checks[0]
    for ch in checks[1:]:
        out = out & ch
    return F.coalesce(out, F.lit(False))


def clip_round_flag(c: Column, lo: float = 0, hi: float = 1) -> Column:
    """Round half to even, clip to [lo, hi], integer."""
    return F.least(F.greatest(F.rint(c), F.lit(float(lo))), F.lit(float(hi))).cast("int")


def export_number(c: Column) -> Column:
    """C21 (numeric part): null -> 0.0, numbers as double, text -> null."""
    return F.coalesce(c.cast("string").try_cast("double"), F.when(c.isNull(), F.lit(0.0)))


def export_text(c: Column) -> Column:
    """C21 (text part): the value as text when it is not a number, else null."""
    return F.when(c.isNotNull() & c.cast("string").try_cast("double").isNull(), c.cast("string"))
