import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidewatch.session import build_session, ensure_local_checkpoint_dir  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=4)
    ensure_local_checkpoint_dir(s)
    yield s
    s.stop()


def normal_frame(spark, n, mean=0.0, sd=1.0, seed=1, name="value"):
    """n rows of N(mean, sd) from hash uniforms (deterministic, partition independent)."""
    from pyspark.sql import functions as F
    from tidewatch.operators.inject import normal
    return spark.range(n).select((F.lit(mean) + F.lit(sd) * normal(F.col("id").cast("string"), f"t{seed}")).alias(name))
