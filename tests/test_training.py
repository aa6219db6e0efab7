"""Oversampling, fold rule, exact KS, file scoring, projections and explanation records."""

import itertools
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewatch.functions import ks_finite
from tidewatch.functions.ks_exact import exact_pvalue, two_sample_pvalue
from tidewatch.functions.ks_finite import finite_pvalue
from tidewatch.operators import explain_records as R
from tidewatch.operators import models as M
from tidewatch.operators import projections as P
from tidewatch.operators import scoring
from tidewatch.operators.drift import ks_two_sample
from tidewatch.functions.ks_exact import ks_pvalue_auto
from tidewatch.operators.smote import oversampled, synthetic_rows
from tidewatch.session import ensure_local_checkpoint_dir


def _folder(spark, name):
    import uuid
    return f"{ensure_local_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def _exceeding(n, m):
    """All orders of n + m values, counted by their largest |i m - j n|."""
    out = Counter()
    for places in itertools.combinations(range(n + m), n):
        i = j = top = 0
        for k in range(n + m):
            if k in places:
                i += 1
            else:
                j += 1
            top = max(top, abs(i * m - j * n))
        out[top] += 1
    return out


@pytest.mark.parametrize("n,m", [(3, 3), (4, 5), (6, 4), (7, 3), (1, 4), (2, 9), (6, 6)])
def test_exact_ks_counts_all_orders(n, m):
    counts = _exceeding(n, m)
    total = sum(counts.values())
    for top in counts:
        wanted = sum(c for t, c in counts.items() if t >= top) / total
        assert exact_pvalue(top / (n * m), n, m) == pytest.approx(wanted, abs=1e-12)


def test_exact_ks_at_published_critical_values():
    # 5 % two-sided: D = 0.7 for 10 against 10; one sample of 10: 0.409
    assert exact_pvalue(0.6, 10, 10) > 0.05 > exact_pvalue(0.7, 10, 10)
    assert exact_pvalue(0.40, 10, 10000) > 0.05 > exact_pvalue(0.42, 10, 10000)
    assert exact_pvalue(0.0, 5, 5) == 1.0 and exact_pvalue(1.0, 5, 5) == pytest.approx(2 / 252)


def test_finite_ks_at_published_values():
    # P(D_n < d) as tabulated for the matrix method
    for n, d, below in ((10, 0.274, 0.6284796154565042), (2000, 0.04, 0.99676943191713676985), (2000, 0.06, 0.99999893956930568),
                        (16000, 0.016, 0.99945234913828052)):
        assert finite_pvalue(d, n) == pytest.approx(1 - below, rel=1e-6, abs=1e-12)
    # 5 % and 1 % two-sided, as tabulated for one sample
    for n, five, one in ((5, 0.563, 0.669), (10, 0.409, 0.489), (20, 0.294, 0.352), (30, 0.242, 0.290)):
        assert finite_pvalue(five, n) == pytest.approx(0.05, abs=1e-3) and finite_pvalue(one, n) == pytest.approx(0.01, abs=5e-4)
    assert finite_pvalue(0.7, 1) == pytest.approx(0.6) and finite_pvalue(0.0, 9) == 1.0 and finite_pvalue(1.0, 9) == 0.0


@pytest.mark.parametrize("n", [200, 3000])
def test_finite_ks_methods_agree(n):
    for z in np.linspace(0.3, 1.45, 12):
        d = z / n ** 0.5
        assert ks_finite.expanded_cdf(n, d) == pytest.approx(ks_finite.matrix_cdf(n, d), abs=3 / n ** 2)
    for z in (1.49, 1.8, 2.5):
        assert 2 * ks_finite.one_sided(n, z / n ** 0.5) == pytest.approx(1 - ks_finite.matrix_cdf(n, z / n ** 0.5), rel=1e-4)
    values = [finite_pvalue(d, n) for d in np.linspace(0.001, 0.5, 400)]
    assert all(a >= b - 1e-9 for a, b in zip(values, values[1:]))


def test_large_samples_take_the_finite_distribution():
    assert two_sample_pvalue(0.02, 20000, 30000) == finite_pvalue(0.02, 12000)
    assert ks_finite.one_sided(1_000_001, 0.002) == pytest.approx(ks_finite.one_sided(1_000_000, 0.002), rel=1e-4)


def test_exact_ks_in_the_two_sample_test(spark):
    a = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    b = spark.createDataFrame([(float(i) + 4.5,) for i in range(10)], "v double")
    row = ks_two_sample(a, b, "v", p_value=ks_pvalue_auto).first()
    assert row["statistic"] == pytest.approx(0.5)
    assert row["p_value"] == pytest.approx(exact_pvalue(0.5, 10, 10))


def _unbalanced(spark, small=12, large=40):
    rows = [(i, 1 if i < small else 0, [float(i % 5), float(i * i % 7), float(i)]) for i in range(small + large)]
    return spark.createDataFrame(rows, "id long, y int, x array<double>")


def test_smote_balances_and_lies_between_neighbours(spark):
    train = _unbalanced(spark)
    points = {r["id"]: np.array(r["x"]) for r in train.where("y = 1").collect()}
    rows = synthetic_rows(train, "y", ["id"], "x").collect()
    assert sorted(r["synthetic_id"] for r in rows) == list(range(28))
    for r in rows:
        base, other, x = points[r["base"]["id"]], points[r["neighbour"]["id"]], np.array(r["x"])
        ranked = sorted((i for i in points if i != r["base"]["id"]), key=lambda i: ((points[i] - base) ** 2).sum())
        assert ((other - base) ** 2).sum() <= ((points[ranked[4]] - base) ** 2).sum()
        gap = np.linalg.norm(x - base) / np.linalg.norm(other - base)
        assert 0 < gap < 1 and x == pytest.approx(base + gap * (other - base))
    sizes = dict(oversampled(train, "y", ["id"], "x").groupBy("y").count().collect())
    assert sizes == {0: 40, 1: 40}


def test_smote_edges(spark):
    assert synthetic_rows(_unbalanced(spark, 1, 9), "y", ["id"], "x").count() == 0
    assert synthetic_rows(_unbalanced(spark, 2, 3), "y", ["id"], "x").count() == 0
    assert synthetic_rows(_unbalanced(spark, 8, 8), "y", ["id"], "x").count() == 0
    assert synthetic_rows(_unbalanced(spark, 0, 8), "y", ["id"], "x").count() == 0
    two = synthetic_rows(_unbalanced(spark, 2, 6), "y", ["id"], "x").collect()
    assert len(two) == 4 and all(r["base"]["id"] != r["neighbour"]["id"] for r in two)
    again = synthetic_rows(_unbalanced(spark).repartition(5), "y", ["id"], "x").orderBy("synthetic_id").collect()
    assert again == synthetic_rows(_unbalanced(spark), "y", ["id"], "x").orderBy("synthetic_id").collect()


def test_fold_plan_and_resampled_cross_validation(spark):
    few = _unbalanced(spark, 5, 10)
    assert sorted(r["fold"] for r in M.fold_plan(few, ["id"], "y").collect()) == list(range(15))
    rows = M.fold_plan(_unbalanced(spark), ["id"], "y", 3).withColumn("features", array_to_vector("x")).withColumnRenamed("y", "label")
    assert {r["fold"] for r in rows.collect()} == {0, 1, 2}
    seen = []

    def make(train):
        seen.append(dict(train.groupBy("label").count().collect()))
        return M.logistic("features", "label", "weight", train.agg(F.sum("weight")).first()[0])
    oof, _ = M.cross_validate(rows, make, "label", "fold", ["id"], resample=M.resampler("label", ["id"]))
    assert oof.count() == 52  # scored rows are the given ones
    assert all(s[0] == s[1] for s in seen) and len(seen) == 3


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_score_files_keeps_rows_with_bad_values(spark, fmt):
    rows = spark.createDataFrame([("a", "1.5", "2"), ("b", "x", "1"), ("c", None, "0")], "k string, f string, g string")
    source = _folder(spark, "in")
    if fmt == "csv":
        rows.select("g", "k", "f").write.option("header", True).csv(source)
    else:
        rows.select("k", F.col("f").try_cast("double").alias("f"), F.col("g").cast("double").alias("g")).write.json(source)
    out = scoring.score_files(spark, source, _folder(spark, "out"), {"f": 1.0, "g": -1.0}, 0.5, {"k": "string"}, fmt)
    found = {r["k"]: r["probability"] for r in out.collect()}
    assert found["a"] == pytest.approx(0.5) and found["b"] is None and found["c"] is None


def test_projection_takes_existing_features_and_known_targets(spark):
    df = spark.createDataFrame([("S1", "M", 30.0, 1, 1, 0), ("S2", "F", None, 2, None, 1)],
                               "`Sample ID` string, SEX string, `AGE (YEARS)` double, baseline_symptom_count int, TARGET_STRICT_M2 int, M2_DISCORDANT int")
    rows, features = P.project(df, "aim1_strict")
    assert features == ["SEX", "AGE (YEARS)", "baseline_symptom_count"]
    assert [r["Sample ID"] for r in rows.collect()] == ["S1"]


def test_records_of_one_version_are_replaced_alone(spark):
    importance = spark.createDataFrame([("b", 2.0, 0.5), ("a", 1.0, None)], "feature string, mean_abs double, std double")
    base, n = spark.createDataFrame([(0.25,)], "base_value double"), spark.createDataFrame([(7,)], "n_background_samples long")
    path = _folder(spark, "records")
    for version in ("v1", "v2", "v1"):
        R.save_records(R.global_record(importance, base, n, "x", "m", version), path)
    found = R.load_records(spark, path, R.GLOBAL_SCHEMA, "x", "m", "v1").collect()
    assert len(found) == 1 and found[0]["feature_names"] == ["a", "b"] and found[0]["mean_abs_shap"] == [1.0, 2.0]
    assert R.load_records(spark, path, R.GLOBAL_SCHEMA, "x", "m", "v2").count() == 1


def test_records_are_stored_compressed_in_files_of_bounded_length(spark, monkeypatch):
    names = [f"a_feature_with_a_long_name_{i}" for i in range(5)]
    entry = lambda i, n: F.struct(F.lit(n).alias("feature"), (F.col("id") / 7 + i).alias("phi"))
    rows = spark.range(1000).coalesce(1).select("id", F.array(*[entry(i, n) for i, n in enumerate(names)]).alias("attributions"))
    base = spark.createDataFrame([(0.25,)], "base_value double")
    records = R.instance_records(rows, base, ["id"], "x", "m", "v1")
    monkeypatch.setattr(R, "FILE_RECORDS", 300)
    path = R.save_records(records, _folder(spark, "records"))
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("path like '%json%'").select("path", "length").collect()
    plain = records.select(F.length(F.to_json(F.struct("*"))).alias("n")).agg(F.sum("n")).first()[0]
    assert len(stored) == 4 and sum(r.length for r in stored) < plain / 3
    schema = "id long, prediction int, probability double, base_value double, shap_values map<string, double>, feature_names array<string>"
    got = {r.id: r for r in R.load_records(spark, path, schema, "x", "m", "v1").collect()}
    for r in records.collect():
        assert all(got[r.id][c] == r[c] for c in ("prediction", "probability", "base_value", "shap_values", "feature_names"))
    assert len(got) == 1000

def test_writers_that_meet_get_versions_of_their_own(spark, tmp_path):
    folder = str(tmp_path / "aim" / "model")
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: M.claim_version(spark, folder), range(16)))
    assert sorted(got) == list(range(1, 17)) and M.claim_version(spark, folder) == 17


def test_concurrent_tasks_keep_their_order_and_raise(spark):
    assert M.concurrently(spark, [lambda i=i: spark.range(i).count() for i in range(9)], 4) == list(range(9))
    assert M.concurrently(spark, [], 4) == []

    def fails():
        raise ValueError("no fit")
    with pytest.raises(ValueError, match="no fit"):
        M.concurrently(spark, [lambda: 1, fails], 2)


def test_folds_side_by_side_score_like_folds_in_turn(spark):
    rows = M.fold_plan(_unbalanced(spark), ["id"], "y", 3).withColumn("features", array_to_vector("x")).withColumn("w", F.lit(1.0))
    make = lambda d: M.forest("features", "y", "w")
    found = [M.cross_validate(rows, make, "y", "fold", ["id"], parallelism=p)[0].orderBy("id").collect() for p in (1, 3)]
    assert found[0] == found[1] and len(found[0]) == 52


def test_fits_get_partitions_by_the_values_of_their_rows(spark, monkeypatch):
    rows = _unbalanced(spark).repartition(7).withColumn("features", array_to_vector("x")).withColumn("w", F.lit(1.0))
    rows = rows.withColumn("fold", (F.col("id") % 2).cast("int"))
    partitions = []

    def make(d):
        partitions.append(d.rdd.getNumPartitions())
        return M.logistic("features", "y", "w", 1.0)

    oof, _ = M.cross_validate(rows, make, "y", "fold", ["id"])
    assert partitions == [1, 1] and sorted(r.id for r in oof.collect()) == sorted(r.id for r in rows.collect())
    width = rows.first().features.size
    monkeypatch.setattr(M, "TASK_VALUES", 52 * width // 3 + 1)
    assert M.training_rows(rows).rdd.getNumPartitions() == 3
    assert M.training_rows(rows.select("id", "y"), "features").count() == 52


def test_out_of_fold_rows_are_scored_once(spark):
    rows = _unbalanced(spark).withColumn("features", array_to_vector("x")).withColumn("w", F.lit(1.0))
    rows = rows.withColumn("fold", (F.col("id") % 2).cast("int"))
    oof, per_fold = M.cross_validate(rows, lambda d: M.logistic("features", "y", "w", 1.0), "y", "fold", ["id"])
    for df in (oof, per_fold):
        assert "UDF" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.fold, r.n) for r in per_fold.collect()} == {(r.fold, r["count"]) for r in rows.groupBy("fold").count().collect()}


def test_all_models_are_fitted_and_described(spark, monkeypatch):
    monkeypatch.setattr(M, "TREES", 5)
    monkeypatch.setattr(M, "GBT_ROUNDS", 3)
    rows = M.fold_plan(_unbalanced(spark), ["id"], "y", 2).withColumn("features", array_to_vector("x"))
    found = {}
    for parallelism in (1, 3):
        models, meta = M.train_all(spark, rows, "y", ["id"], "aim", parallelism=parallelism)
        assert set(models) == {"logistic_regression", "random_forest", "gradient_boosted_trees"}
        found[parallelism] = {r.model: r for r in meta.collect()}
    assert found[1].keys() == found[3].keys() == set(models)
    for name, row in found[1].items():
        assert row.n_train == 52 and abs(row.cv_auc_mean - found[3][name].cv_auc_mean) < 1e-9 and abs(row.train_auc - found[3][name].train_auc) < 1e-9
