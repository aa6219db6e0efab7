"""Injection, scenario-curve and window-generation queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import clean as K
from tidewatch.operators import inject as G
from tidewatch.operators import profile as A
from tidewatch.operators.columns import col
from tidewatch.plans.catalog import register
from tidewatch.plans.clean_plans import demographics_view, patients_view
from tidewatch.sources.tables import read_table

R6 = 6


def _u(key: str, salt: str) -> str:
    return f"((('0x' || substr(md5({key} || '|{salt}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"


def _z(key: str, salt: str) -> str:
    return f"(sqrt(-2.0 * ln({_u(key, salt + '|1')})) * cos(2.0 * pi() * {_u(key, salt + '|2')}))"


CKEY = "coalesce(CAST(c_custkey AS VARCHAR), '\\N')"


@register("inject_gaussian_customer", f"""
SELECT c_custkey, c_name, round(c_nationkey::DOUBLE + 0.5 * {_z(CKEY, 'c_nationkey|42')}, 6) AS c_nationkey,
  round(c_acctbal + 0.5 * {_z(CKEY, 'c_acctbal|42')}, 6) AS c_acctbal, c_mktsegment FROM customer""", ("G1", "P9"))
def inject_gaussian_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    g = G.gaussian_drift(c, ["c_custkey"], noise_std=0.5, seed=42)
    return g.select("c_custkey", "c_name", F.round("c_nationkey", R6).alias("c_nationkey"),
                    F.round("c_acctbal", R6).alias("c_acctbal"), "c_mktsegment")


def _swap_sql(table: str, key: str, text_cols: list[str], pct: float, seed: int, src: str | None = None) -> str:
    k = f"coalesce(CAST({key} AS VARCHAR), '\\N')"
    longs = " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM s WHERE {c} IS NOT NULL"
                               for c in text_cols)
    sel = []
    joins = []
    for i, c in enumerate(text_cols):
        pick = (f"CASE WHEN nd{i}.nd IS NOT NULL AND {_u(k, f'{c}|{seed}|swap')} < {pct} "
                f"THEN floor({_u(k, f'{c}|{seed}|pick')} * nd{i}.nd)::BIGINT END")
        sel.append(f"{pick} AS r{i}")
        joins.append(f"LEFT JOIN (SELECT nd FROM nd WHERE feature = '{c}') nd{i} ON TRUE")
    outer = [f"coalesce(v{i}.value, b.{c}) AS {c}" for i, c in enumerate(text_cols)]
    outer_j = [f"LEFT JOIN (SELECT rank, value FROM rk WHERE feature = '{c}') v{i} ON v{i}.rank = b.r{i}"
               for i, c in enumerate(text_cols)]
    return f"""
WITH s AS ({src or 'SELECT * FROM ' + table}),
d AS ({longs}),
rk0 AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS rank,
               count(*) OVER (PARTITION BY feature) AS nd FROM d),
rk AS (SELECT * FROM rk0 WHERE nd >= 2),
nd AS (SELECT feature, any_value(nd) AS nd FROM rk GROUP BY feature),
b AS (SELECT s.*, {', '.join(sel)} FROM s {' '.join(joins)})
SELECT b.* EXCLUDE ({', '.join(text_cols)}, {', '.join(f'r{i}' for i in range(len(text_cols)))}), {', '.join(outer)}
FROM b {' '.join(outer_j)}"""


@register("inject_swap_part", _swap_sql("part", "p_partkey", ["p_name", "p_brand", "p_type"], 0.3, 42), ("G2",))
def inject_swap_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.category_swap(read_table(spark, sf_dir, "part"), ["p_partkey"], swap_pct=0.3, seed=42)


COMBINED_SRC = f"""SELECT c_custkey, c_name, c_nationkey::DOUBLE + 1.0 * {_z(CKEY, 'c_nationkey|42')} AS c_nationkey,
  c_acctbal + 1.0 * {_z(CKEY, 'c_acctbal|42')} AS c_acctbal, c_mktsegment FROM customer"""


@register("inject_combined_customer", f"""
WITH x AS ({_swap_sql('customer', 'c_custkey', ['c_name', 'c_mktsegment'], 0.4, 43, COMBINED_SRC)})
SELECT c_custkey, c_name, round(c_nationkey, 6) AS c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM x""", ("G3",))
def inject_combined_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    g = G.combined_drift(c, ["c_custkey"], noise_std=1.0, swap_pct=0.4, seed=42)
    return g.select("c_custkey", "c_name", F.round("c_nationkey", R6).alias("c_nationkey"),
                    F.round("c_acctbal", R6).alias("c_acctbal"), "c_mktsegment")


def patients_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned aim-1 patients with BMI, the table the scenario curves are applied to."""
    df = K.imputed_label_dataset(patients_view(spark, sf_dir), demographics_view(spark, sf_dir))
    return K.with_bmi(df, out="BMI")


PAT_NUM_SQL = """SELECT TRY_CAST("AGE (YEARS)" AS DOUBLE) AS age,
  CASE WHEN isfinite(TRY_CAST("WEIGHT (KG)" AS DOUBLE) / ((TRY_CAST("HEIGHT (CM)" AS DOUBLE) / 100.0) * (TRY_CAST("HEIGHT (CM)" AS DOUBLE) / 100.0)))
       THEN TRY_CAST("WEIGHT (KG)" AS DOUBLE) / ((TRY_CAST("HEIGHT (CM)" AS DOUBLE) / 100.0) * (TRY_CAST("HEIGHT (CM)" AS DOUBLE) / 100.0)) END AS bmi"""


def _scenario_values() -> str:
    rows = ", ".join(f"('{s}', '{f}', '{c}')" for s, m in G.SCENARIOS.items() for f, c in m.items())
    return f"(VALUES {rows}) t(scenario, feature, curve)"


def _curve_params_oracle(scenario: str, windows: int) -> str:
    from tidewatch.plans.clean_plans import patients_sql
    t = f"(w::DOUBLE / {float(windows)})"
    delta = (f"CASE curve WHEN 'linear_up' THEN 0.4 * {t} WHEN 'linear_down' THEN -0.3 * {t} "
             f"WHEN 'step_up_mid' THEN CASE WHEN {t} >= 0.5 THEN 0.25 ELSE 0.0 END "
             f"WHEN 'step_down_mid' THEN CASE WHEN {t} >= 0.5 THEN -0.25 ELSE 0.0 END "
             f"WHEN 'sine' THEN 0.15 * sin({t} * 4 * {math.pi!r}) ELSE 0.0 END")
    return f"""
WITH p AS ({PAT_NUM_SQL} FROM ({patients_sql()})),
prof AS (SELECT 'AGE (YEARS)' AS feature, avg(age) AS mean, stddev_samp(age) AS std FROM p WHERE age IS NOT NULL AND NOT isnan(age)
         UNION ALL SELECT 'BMI', avg(bmi), stddev_samp(bmi) FROM p WHERE bmi IS NOT NULL AND NOT isnan(bmi)),
c AS (SELECT * FROM {_scenario_values()} WHERE scenario = '{scenario}' AND curve <> 'none')
SELECT w AS window, feature, curve, round(mean + mean * ({delta}), 6) AS mean, round(std, 6) AS std
FROM prof JOIN c USING (feature), range(0, {windows}) r(w)"""


@register("scenario_curve_params", _curve_params_oracle("mixed", 72), ("G5", "G6", "J5", "A1"))
def scenario_curve_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    prof = A.numeric_profile(patients_features(spark, sf_dir), ["AGE (YEARS)", "BMI"])
    p = G.drift_parameters(prof, "mixed", 72)
    return p.select(F.col("window").cast("long").alias("window"), "feature", "curve",
                    F.round("mean", R6).alias("mean"), F.round("std", R6).alias("std"))


@register("bootstrap_customer", f"""
WITH r AS (SELECT c_acctbal AS value, row_number() OVER (ORDER BY c_custkey) - 1 AS rank, count(*) OVER () AS N
           FROM customer WHERE c_acctbal IS NOT NULL),
d AS (SELECT rank AS draw, floor({_u('CAST(rank AS VARCHAR)', 'boot|c_acctbal|42')} * N)::BIGINT AS pick FROM r)
SELECT d.draw, r.value FROM d JOIN r ON r.rank = d.pick""", ("G7",))
def bootstrap_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bootstrap sample of c_acctbal of the table's own size."""
    c = read_table(spark, sf_dir, "customer").where(col("c_acctbal").isNotNull())
    return G.bootstrap(c, "c_acctbal", "c_custkey", c.count(), 42)


@register("generate_scenario_windows", None, ("G8", "G9", "A2"))
def generate_scenario_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """72 windows x 10 records from the profile of the cleaned patients, drifted
    by the 'mixed' scenario, with the cough correlation applied. Rows-only check:
    the values are hash draws, covered by property tests."""
    pf = patients_features(spark, sf_dir)
    num = A.numeric_profile(pf, ["AGE (YEARS)", "BMI", "TARGET_NON_CONVERSION_ANY"])
    cat = A.categorical_profile(pf, ["SEX", "COUGH", "FEVER", "WEIGHT LOSS", "NIGHT SWEATS", "HIV STATUS"])
    params = G.drift_parameters(num, "mixed", 72)
    rows = G.generate_windows(num, cat, params, n_windows=72, n_records=10)
    return G.correlate_on(rows, "COUGH", {"FEVER": 1.1, "WEIGHT LOSS": 1.05, "NIGHT SWEATS": 1.05},
                          {"FEVER": 0.2, "WEIGHT LOSS": 0.2, "NIGHT SWEATS": 0.2})
