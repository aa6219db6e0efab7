import re

import __spark_entry__ as entry
from tidewatch.plans.catalog import OPERATORS


def test_entry_runs_on_smoke_data(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["feature", "feature_type", "test", "statistic", "p_value", "drift_detected", "info"]
    assert {r.test for r in rows} <= {"ks", "psi", "chi_square", "categorical_psi"}


def test_query_names_and_oracles():
    qs, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(qs)
    own = [name for name in qs if not re.match(r"op\d+_|pipeline$", name)]
    assert len(own) > 80
    for name in own:
        assert OPERATORS[name], name


def test_oracle_sql_builds_without_spark():
    # oracle text must not need a running session
    assert all(isinstance(s, str) and s.strip() for s in entry.oracle_sql().values())
