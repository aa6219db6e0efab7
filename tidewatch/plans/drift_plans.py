"""Drift queries over the given tables (D1-D8): reference and current are two
time ranges of the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import drift
from tidewatch.plans import oracle_sql as O
from tidewatch.plans.catalog import register
from tidewatch.sources.tables import read_table

R6 = 6  # digits kept on both sides of the oracle comparison


def _round_tests(tests: DataFrame) -> DataFrame:
    return tests.select("feature", "feature_type", "test", F.round("statistic", R6).alias("statistic"),
                        F.round("p_value", R6).alias("p_value"), "drift_detected", "info")


def _split(spark, sf_dir, table, ts_col, cutoff, num, cat):
    """num / cat map output names to functions building the Column (built lazily:
    Column objects need an active session)."""
    df = read_table(spark, sf_dir, table)
    cols = [e().alias(n) for n, e in num.items()] + [e().alias(n) for n, e in cat.items()]
    src = df.select(F.col(ts_col), *cols)
    cut = F.lit(cutoff).cast("timestamp_ntz")
    ref = src.where(F.col(ts_col) < cut).drop(ts_col)
    cur = src.where(F.col(ts_col) >= cut).drop(ts_col)
    return ref, cur


def _oracle(src: str, num: dict[str, str], cat: dict[str, str], fkey: str = "") -> str:
    """``fkey`` prefixes the feature label with a SQL expression (e.g. a window key)."""
    nl = " UNION ALL ".join(f"SELECT side, {fkey}'{n}' AS feature, ({e})::DOUBLE AS v FROM src" for n, e in num.items())
    cl = " UNION ALL ".join(f"SELECT side, {fkey}'{n}' AS feature, ({e})::VARCHAR AS category FROM src" for n, e in cat.items())
    parts = [f"src AS ({src})"]
    selects = []
    if num:
        parts += [f"nl AS ({nl})", O.num_counts("nl", "nc"), O.ladder("nc", "lad"), O.ks("lad", "ks"),
                  O.psi("nl", "lad", "ps"),
                  """nt AS (SELECT feature, CASE WHEN count(*) FILTER (WHERE n_ref > 0) = 1 THEN 'constant'
                     WHEN count(*) FILTER (WHERE n_ref > 0) <= 2 THEN 'binary' ELSE 'numeric' END AS feature_type
                     FROM nc GROUP BY feature)"""]
        selects += [
            "SELECT feature, feature_type, 'ks' AS test, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, "
            "p_value < 0.05 AS drift_detected, NULL::VARCHAR AS info FROM ks JOIN nt USING (feature) WHERE feature_type = 'numeric'",
            "SELECT feature, feature_type, 'psi', round(statistic, 6), NULL::DOUBLE, coalesce(statistic > 0.1, false), info "
            "FROM ps JOIN nt USING (feature) WHERE feature_type = 'numeric'"]
    if cat:
        parts += [f"cl AS ({cl})",
                  """cc AS (SELECT feature, category, count(*) FILTER (WHERE side = 0) AS n_ref,
                     count(*) FILTER (WHERE side = 1) AS n_cur FROM cl WHERE category IS NOT NULL GROUP BY ALL)""",
                  O.categorical("cc", "ct"),
                  """ctp AS (SELECT feature, CASE WHEN count(*) FILTER (WHERE n_ref > 0) = 1 THEN 'constant'
                     WHEN count(*) FILTER (WHERE n_ref > 0) <= 2 THEN 'binary' ELSE 'categorical' END AS feature_type
                     FROM cc GROUP BY feature)"""]
        selects += [
            "SELECT feature, feature_type, 'chi_square', round(chi_stat, 6), round(chi_p, 6), coalesce(chi_p < 0.05, false), chi_info "
            "FROM ct JOIN ctp USING (feature) WHERE feature_type IN ('binary', 'categorical')",
            "SELECT feature, feature_type, 'categorical_psi', round(cpsi, 6), NULL::DOUBLE, coalesce(cpsi > 0.1, false), cpsi_info "
            "FROM ct JOIN ctp USING (feature) WHERE feature_type IN ('binary', 'categorical')"]
    return "WITH " + ",\n".join(parts) + "\n" + "\nUNION ALL\n".join(selects)


# ---------------------------------------------------------------- events (flagship)

EVENTS_NUM = {"value": lambda: F.col("value"), "k": lambda: F.get_json_object("props", "$.k").cast("long")}
EVENTS_CAT = {"event_type": lambda: F.col("event_type")}
EVENTS_SRC = ("SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS side, value, "
              "CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events")


def events_report(spark: SparkSession, sf_dir: str) -> drift.DriftReport:
    ref, cur = _split(spark, sf_dir, "events", "ts", "2024-01-16", EVENTS_NUM, EVENTS_CAT)
    return drift.data_drift(ref, cur, ["value", "k", "event_type"])


@register("drift_events", _oracle(EVENTS_SRC, {"value": "value", "k": "k"}, {"event_type": "event_type"}),
          ("D1", "D2", "D3", "D4", "D6", "D7", "J2", "J3", "S6"))
def drift_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_tests(events_report(spark, sf_dir).tests)


@register("drift_events_summary", f"""
WITH t AS ({_oracle(EVENTS_SRC, {"value": "value", "k": "k"}, {"event_type": "event_type"})}),
f AS (SELECT feature, bool_or(drift_detected) AS d, count(*) AS n FROM t GROUP BY feature)
SELECT (count_if(d) / 3.0) > 0.3 AS data_drift_detected, round(count_if(d) / 3.0, 6) AS drift_ratio,
       3::BIGINT AS n_features, count_if(d)::BIGINT AS drift_count, sum(n)::BIGINT AS total_tests FROM f""",
          ("D7", "D8", "D12"))
def drift_events_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events_report(spark, sf_dir).summary
    return s.withColumn("drift_ratio", F.round("drift_ratio", R6))


# ---------------------------------------------------------------- lineitem and orders by date

LI_NUM = {c: (lambda c=c: F.col(c)) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}
LI_CAT = {"l_returnflag": lambda: F.col("l_returnflag")}
LI_SRC = ("SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 0 ELSE 1 END AS side, * FROM lineitem")


@register("drift_lineitem", _oracle(LI_SRC, {c: c for c in LI_NUM}, {"l_returnflag": "l_returnflag"}),
          ("D1", "D2", "D3", "D4", "D7"))
def drift_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = _split(spark, sf_dir, "lineitem", "l_shipdate", "1998-01-01", LI_NUM, LI_CAT)
    return _round_tests(drift.data_drift(ref, cur, list(LI_NUM) + list(LI_CAT)).tests)


ORD_NUM = {"o_totalprice": lambda: F.col("o_totalprice")}
ORD_CAT = {"o_orderpriority": lambda: F.col("o_orderpriority"), "o_orderstatus": lambda: F.col("o_orderstatus")}
ORD_SRC = "SELECT CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 0 ELSE 1 END AS side, * FROM orders"


@register("drift_orders", _oracle(ORD_SRC, {"o_totalprice": "o_totalprice"},
                                  {"o_orderpriority": "o_orderpriority", "o_orderstatus": "o_orderstatus"}),
          ("D1", "D2", "D3", "D4", "D7"))
def drift_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = _split(spark, sf_dir, "orders", "o_orderdate", "2000-01-01", ORD_NUM, ORD_CAT)
    return _round_tests(drift.data_drift(ref, cur, list(ORD_NUM) + list(ORD_CAT)).tests)


# ---------------------------------------------------------------- Jensen-Shannon

JS_ORACLE = """
WITH src AS (""" + EVENTS_SRC + """),
nl AS (SELECT side, 'value' AS feature, value::DOUBLE AS v FROM src UNION ALL SELECT side, 'k', k::DOUBLE FROM src),
st AS (SELECT feature, count(*) FILTER (WHERE side = 0) AS R, count(*) FILTER (WHERE side = 1) AS C, count(*) AS N,
              count(DISTINCT v) FILTER (WHERE side = 0) AS nd_ref, min(v) AS lo, max(v) AS hi
       FROM nl WHERE v IS NOT NULL GROUP BY feature),
rk AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS rnk FROM nl WHERE v IS NOT NULL),
qp AS (SELECT s.*, p, (s.N - 1)::DOUBLE * p AS h FROM st s, (VALUES (0.75), (0.25)) t(p)),
qv AS (SELECT q.feature, q.p, CASE WHEN q.h - floor(q.h) >= 0.5 THEN b.v - (b.v - a.v) * (1.0 - (q.h - floor(q.h)))
                                  ELSE a.v + (b.v - a.v) * (q.h - floor(q.h)) END AS qv
       FROM qp q JOIN rk a ON a.feature = q.feature AND a.rnk = floor(q.h)
                 JOIN rk b ON b.feature = q.feature AND b.rnk = least(floor(q.h) + 1, q.N - 1)),
g0 AS (SELECT s.*, max(CASE WHEN p = 0.75 THEN qv END) - max(CASE WHEN p = 0.25 THEN qv END) AS iqr
       FROM st s JOIN qv USING (feature) GROUP BY ALL),
g1 AS (SELECT *, (hi - lo) / (log2(N::DOUBLE) + 1.0) AS sturges, 2.0 * iqr * power(N::DOUBLE, -1.0 / 3.0) AS fd FROM g0),
g2 AS (SELECT *, CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END AS width,
              CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS first, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS last FROM g1),
geo AS (SELECT feature, R, C, nd_ref, first, last,
               (CASE WHEN width > 0 THEN ceil((last - first) / width) ELSE 1 END)::BIGINT AS nb FROM g2),
b0 AS (SELECT n.side, n.feature, n.v, g.*, least(((n.v - g.first) / (g.last - g.first) * g.nb)::DOUBLE, 1e300) AS f
       FROM nl n JOIN geo g USING (feature) WHERE n.v IS NOT NULL),
b1 AS (SELECT *, CASE WHEN trunc(f)::BIGINT >= nb THEN nb - 1 ELSE trunc(f)::BIGINT END AS i0 FROM b0),
b2 AS (SELECT *, CASE WHEN v < (CASE WHEN i0 >= nb THEN last ELSE i0::DOUBLE * ((last - first) / nb) + first END)
                      THEN i0 - 1 ELSE i0 END AS i1 FROM b1),
b3 AS (SELECT *, CASE WHEN v >= (CASE WHEN i1 + 1 >= nb THEN last ELSE (i1 + 1)::DOUBLE * ((last - first) / nb) + first END)
                       AND i1 <> nb - 1 THEN i1 + 1 ELSE i1 END AS bin FROM b2),
h AS (SELECT feature, bin, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b,
             any_value(R) AS R, any_value(C) AS C FROM b3 GROUP BY feature, bin),
js AS (SELECT feature, sqrt(greatest(sum(
          CASE WHEN a > 0 THEN (a / R) * ln((a / R) / ((a / R + b / C) / 2.0)) ELSE 0 END +
          CASE WHEN b > 0 THEN (b / C) * ln((b / C) / ((a / R + b / C) / 2.0)) ELSE 0 END), 0.0) / 2.0) AS js
       FROM h GROUP BY feature)
SELECT g.feature, round(CASE WHEN g.R = 0 OR g.C = 0 THEN NULL WHEN least(50, g.nd_ref) < 2 THEN 0.0 ELSE js.js END, 6) AS statistic,
       g.nb AS n_bins,
       coalesce(CASE WHEN g.R = 0 OR g.C = 0 THEN NULL WHEN least(50, g.nd_ref) < 2 THEN 0.0 ELSE js.js END > 0.1, false) AS drift_detected
FROM geo g LEFT JOIN js USING (feature)
"""


@register("js_events", JS_ORACLE, ("D5",))
def js_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = _split(spark, sf_dir, "events", "ts", "2024-01-16", EVENTS_NUM, {})
    out = drift.js_distance(ref, cur, ["value", "k"])
    return out.select("feature", F.round("statistic", R6).alias("statistic"), "n_bins", "drift_detected")
