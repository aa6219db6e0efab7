"""Feature and target columns of each aim, and the strict matrix with fixed roles."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewatch.operators.clean import with_bmi
from tidewatch.operators.columns import col, present
from tidewatch.operators.features import Preprocessor, fit_preprocessor, transform

# Column names of the cleaned sheets, in matrix order.
AIM_FEATURES = {
    "aim1": [
        "SEX", "AGE (YEARS)", "TEMPERATURE_CELCIUS",
        "COUGH", "FEVER", "WEIGHT LOSS", "NIGHT SWEATS",
        "CHEST PAIN", "HEMOPTYSIS",
        "HIV_STATUS", "HAS_DIABETES", "SMOKES", "CONSUMES_ALCOHOL",
        "PAST_TB_DIAGNOSIS", "TB_CONTACT",
        "NUMBER_OF_OCCUPANTS", "BMI", "BASELINE_POSITIVE",
    ],
    "aim1_strict": ["SEX", "AGE (YEARS)", "BMI", "baseline_symptom_count"],
    "aim2": [
        "AGE", "SEX", "WEIGHT", "TEMPERATURE",
        "COUGH", "FEVER", "WEIGHT LOSS", "NIGHT SWEATS",
        "DYSPNEA", "CHEST PAIN", "HEMOPTYSIS",
        "HIV STATUS",
    ],
}
AIM_TARGET = {"aim1": "TARGET_NON_CONVERSION_ANY", "aim1_strict": "TARGET_STRICT_M2", "aim2": "TARGET_SYMPTOM_PRESENT"}
#: Columns carried beside features and target.
AIM_CARRIED = {"aim1": [], "aim1_strict": ["Sample ID", "M2_DISCORDANT"], "aim2": []}
STRICT_NUMERIC = ["AGE (YEARS)", "BMI", "baseline_symptom_count"]
STRICT_BINARY = ["SEX"]


def project(df: DataFrame, aim: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """(rows, features) of an aim: the features that exist, target and carried columns.

    Rows without a target go, except for the contacts' aim, whose target is never null.
    ``keep`` names further columns to carry.
    """
    features = present(df, AIM_FEATURES[aim])
    target = AIM_TARGET[aim]
    out = df.select(*[col(c) for c in [*keep, *features, target, *AIM_CARRIED[aim]]])
    return (out if aim == "aim2" else out.where(col(target).isNotNull())), features


def strict_matrix(strict: DataFrame, keep: tuple[str, ...] = ()) -> tuple[Preprocessor, DataFrame]:
    """The strict dataset's matrix with fixed roles, its target, ids and discordance.

    Expects K5's columns; a height and a weight column give BMI where the sheet has its own.
    """
    rows, features = project(with_bmi(strict), "aim1_strict", keep)
    pre = fit_preprocessor(rows, features, numeric=[c for c in STRICT_NUMERIC if c in features], categorical=[],
                           binary=[c for c in STRICT_BINARY if c in features])
    carried = [*keep, AIM_TARGET["aim1_strict"], *AIM_CARRIED["aim1_strict"]]
    return pre, transform(pre, rows, keep=carried)
