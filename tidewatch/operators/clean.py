"""Cleaning and label-derivation composites (K1-K6) and the symptom join.

Each composite is one ``select`` of generated Column expressions over the
columns that exist (the inputs are schema-tolerant), not a withColumn loop.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import labels as L
from tidewatch.functions import normalize as N
from tidewatch.operators.columns import col

# Column lists of the reference's cleaning steps (names as they
# appear in the source sheets, misspellings included).
PATIENT_SYMPTOMS = ["COUGH", "FEVER", "WEIGHT LOSS", "NIGHT SWEATS", "DYSPENA", "CHEST PAIN", "HEMOPTYSIS"]
PATIENT_YES_NO = ["HAS_DIABETES", "HAS_CANCER", "SMOKES", "CONSUMES_ALCOHOL", "PAST_TB_DIAGNOSIS", "TB_CONTACT",
                  "HAS DIABETES (YES/NO)", "HAS CANCER (YES/NO)", "SMOKES CIGARETTES (YES/NO)",
                  "CONSUMES ALCOHOL (YES/NO)", "EVER BEEN DIAGNOSED WITH TB IN THE PAST? (YES/NO)",
                  "CONSUMED ANTIBIOTIC(S) IN THE PAST 6 MONTHS  (YES/NO)"]
HIV_COLUMNS = ["HIV STATUS", "HIV_STATUS"]
PATIENT_NUMERIC = ["AGE (YEARS)", "AGE", "WEIGHT (KG)", "WEIGHT", "WEIGHT IN KGS", "HEIGHT (M)", "HEIGHT (CM)",
                   "HEIGHT", "TEMPERATURE_CELCIUS", "TEMPERATURE CELICIUS", "TEMP IN CENTIGRADE", "TEMPERATURE", "BMI"]
FOLLOWUP_SYMPTOMS = ["COUGH", "FEVER", "WEIGHT LOSS", "NIGHT SWEATS", "DYSPNEA", "CHEST PAIN", "HEMOPTYSIS"]
FOLLOWUP_NUMERIC = ["AGE", "WEIGHT IN KGS", "TEMP IN CENTIGRADE"]
CONTACT_NUMERIC = ["AGE", "WEIGHT", "TEMPERATURE"]
DEMO_SYMPTOMS = ["COUGH", "FEVER", "WEIGHT LOSS", "NIGHT SWEATS", "CHEST PAIN", "HEMOPTYSIS"]
WEIGHT_COLUMNS = ["WEIGHT (KG)", "WEIGHT", "WEIGHT IN KGS"]
HEIGHT_COLUMNS = ["HEIGHT (M)", "HEIGHT (CM)", "HEIGHT"]
KEY = "Sample ID"


def apply_columns(df: DataFrame, fns: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Rewrite the listed columns that exist in place, in one projection."""
    return df.select(*[fns[c](col(c)).alias(c) if c in fns else col(c) for c in df.columns])


def clean_patients(df: DataFrame) -> DataFrame:
    """K1."""
    fns: dict[str, Callable[[Column], Column]] = {}
    fns.update({c: N.yes_no for c in PATIENT_SYMPTOMS + PATIENT_YES_NO + HIV_COLUMNS})
    fns["SEX"] = N.sex
    fns.update({c: N.safe_double for c in PATIENT_NUMERIC})
    return apply_columns(df, fns)


def clean_followup(df: DataFrame) -> DataFrame:
    """K2."""
    fns: dict[str, Callable[[Column], Column]] = {"FOLLOW UP MONTH": N.followup_month, "HIV STATUS": N.yes_no}
    fns.update({c: N.yes_no for c in FOLLOWUP_SYMPTOMS})
    fns.update({c: N.safe_double for c in FOLLOWUP_NUMERIC})
    return apply_columns(df, fns)


def clean_contacts(df: DataFrame) -> DataFrame:
    """K3."""
    fns: dict[str, Callable[[Column], Column]] = {"SEX": N.sex, "HIV STATUS": N.yes_no}
    fns.update({c: N.yes_no for c in FOLLOWUP_SYMPTOMS})
    fns.update({c: N.safe_double for c in CONTACT_NUMERIC})
    return apply_columns(df, fns)


def left_join_suffixed(left: DataFrame, right: DataFrame, key: str = KEY, null_safe: bool = False) -> DataFrame:
    """Left equi-join with suffixes.

    Duplicate right keys multiply rows. Null keys match nothing, as in SQL; with
    ``null_safe`` they match null keys (pandas ``merge``), which pairs all null-key
    rows of both sides, so it is for right sides with at most one null key. Overlapping non-key columns get the
    suffixes ``_x`` (left) and ``_y`` (right). The strategy is left to the
    planner (AQE converts to a broadcast join when the right side is measured
    small, and splits skewed keys otherwise).
    """
    overlap = [c for c in right.columns if c != key and c in left.columns]
    lsel = [col(c).alias(c + "_x") if c in overlap else col(c) for c in left.columns]
    rsel = [col(key).alias("__rkey")] + [col(c).alias(c + "_y") if c in overlap else col(c)
                                         for c in right.columns if c != key]
    l_ = left.select(*lsel)
    r_ = right.select(*rsel)
    cond = col(key).eqNullSafe(F.col("__rkey")) if null_safe else (col(key) == F.col("__rkey"))
    return l_.join(r_, cond, "left").drop("__rkey")


def _present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in names if c in df.columns]


def _baseline_col(df: DataFrame) -> str:
    return "BASELINE_RESULT" if "BASELINE_RESULT" in df.columns else "Unnamed: 4"


def _merge_demographics(patients: DataFrame, demographics: DataFrame) -> DataFrame:
    df = clean_patients(patients)
    demo_cols = _present(demographics, DEMO_SYMPTOMS)
    demo = apply_columns(demographics.select(col(KEY), *[col(c) for c in demo_cols]), {c: N.yes_no for c in demo_cols})
    return left_join_suffixed(df, demo, KEY)


def imputed_label_dataset(patients: DataFrame, demographics: DataFrame) -> DataFrame:
    """K4: clean, join symptoms, labels from months 2 and 5, imputed flag, baseline flag."""
    df = _merge_demographics(patients, demographics)
    m2 = L.culture_label(col("2 MONTHS"))
    m5 = L.culture_label(col("5 MONTHS"))
    base = _baseline_col(df)
    return (df.withColumn("TARGET_NON_CONVERSION_2M", m2)
              .withColumn("TARGET_NON_CONVERSION_5M", m5)
              .withColumn("TARGET_NON_CONVERSION_ANY",
                          L.max_or_zero(F.col("TARGET_NON_CONVERSION_2M"), F.col("TARGET_NON_CONVERSION_5M")))
              .withColumn("IS_IMPUTED", L.both_missing(F.col("TARGET_NON_CONVERSION_2M"), F.col("TARGET_NON_CONVERSION_5M")))
              .withColumn("BASELINE_POSITIVE", L.contains_flag(col(base))))


def strict_label_dataset(patients: DataFrame, demographics: DataFrame,
                         symptoms: Sequence[str] = DEMO_SYMPTOMS) -> DataFrame:
    """K5: strict month-2 label, symptom count, discordance, imputed and baseline flags."""
    df = _merge_demographics(patients, demographics)
    base = _baseline_col(df)
    return (df.withColumn("TARGET_STRICT_M2", L.culture_label(col("2 MONTHS")))
              .withColumn("baseline_symptom_count", L.count_yes([col(c) for c in _present(df, symptoms)]))
              .withColumn("M2_DISCORDANT", L.discordant(col("2 MONTHS"), col("2_MONTHS_RESULT")))
              .withColumn("IS_IMPUTED", L.is_missing(col("2 MONTHS")))
              .withColumn("BASELINE_POSITIVE", L.contains_flag(col(base))))


def contact_dataset(contacts: DataFrame) -> DataFrame:
    """K6: clean contacts, 0/1 symptom flags, any-symptom label."""
    df = clean_contacts(contacts)
    syms = _present(df, FOLLOWUP_SYMPTOMS)
    flags = {c + "_BINARY": L.yes_flag(col(c)) for c in syms}
    df = df.select("*", *[e.alias(n) for n, e in flags.items()])
    return df.withColumn("TARGET_SYMPTOM_PRESENT", L.any_flag([col(n) for n in flags]))


def with_bmi(df: DataFrame, out: str = "BMI_CALCULATED") -> DataFrame:
    """C14 applied to a frame: first existing weight and height columns win."""
    w = next((c for c in WEIGHT_COLUMNS if c in df.columns), None)
    h = next((c for c in HEIGHT_COLUMNS if c in df.columns), None)
    if not (w and h):
        return df
    return df.withColumn(out, L.bmi(col(w), col(h), height_in_cm=(h == "HEIGHT (CM)")))
