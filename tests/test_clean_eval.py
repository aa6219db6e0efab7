import pytest
from pyspark.sql import functions as F

from tidewatch.functions import labels as L
from tidewatch.functions import normalize as N
from tidewatch.operators import clean as K
from tidewatch.operators import evaluate as E
from tidewatch.operators import profile as A
from tidewatch.operators import registry as R
from tidewatch.sources import sinks as S


def col_values(df, c):
    return [r[c] for r in df.collect()]


def test_sex_map(spark):
    df = spark.createDataFrame([("M",), ("F",), ("Male",), ("Female",), (None,)], "SEX string")
    assert col_values(df.select(N.sex(F.col("SEX")).alias("s")), "s") == ["M", "F", "M", "F", None]


def test_yes_no_map(spark):
    df = spark.createDataFrame([("YES",), ("NO",), ("Yes",), ("no",), (None,), ("#",), (" y ",), ("maybe",)], "c string")
    assert col_values(df.select(N.yes_no(F.col("c")).alias("s")), "s") == ["YES", "NO", "YES", "NO", None, None, "YES", "maybe"]


def test_month_repair(spark):
    df = spark.createDataFrame([("MONTH 2",), ("MOMTH 2",), ("MONTH5",), (None,), ("week 3",), ("month",)], "c string")
    assert col_values(df.select(N.followup_month(F.col("c")).alias("s")), "s") == [
        "MONTH_2", "MONTH_2", "MONTH_5", None, "week 3", "month"]


def test_json_salvage(spark):
    rows = [('{"a": 1}',), ('```json\n{"a": 2}\n```',), ('Here you go: {"a": 3} bye',), ('[{"a": 4}, {"a": 5}]',),
            ('nothing',)]
    df = spark.createDataFrame(rows, "raw string").select(N.salvage_json(F.col("raw")).alias("j"))
    got = [r.j for r in df.collect()]
    assert [None if g is None else F.get_json_object for g in got][-1] is None
    vals = spark.createDataFrame([(g,) for g in got], "j string").select(F.get_json_object("j", "$.a").alias("a"))
    # the whole array parses, so the reference returns the list itself (no 'a')
    assert col_values(vals, "a") == ["1", "2", "3", None, None]


def test_labels_and_counts(spark):
    df = spark.createDataFrame(
        [("No growth", "No conversion", "YES", "no"), ("MTB Positive", "no conversion", "yes ", "YES"),
         ("contaminated", None, None, None), (None, "Conversion", "NO", "YES")],
        "culture string, conv string, a string, b string")
    out = df.select(L.culture_label(F.col("culture")).alias("lab"),
                    L.discordant(F.col("culture"), F.col("conv")).alias("disc"),
                    L.count_yes([F.col("a"), F.col("b")]).alias("n")).collect()
    assert [r.lab for r in out] == [0, 1, None, None]
    assert [r.disc for r in out] == [1, 0, 0, 0]
    assert [r.n for r in out] == [1, 2, 0, 1]


def test_left_join_suffixes_duplicates_and_null_keys(spark):
    left = spark.createDataFrame([("s1", "M"), ("s2", "F"), (None, "M")], "`Sample ID` string, COUGH string")
    right = spark.createDataFrame([("s1", "YES"), ("s1", "NO"), (None, "YES")], "`Sample ID` string, COUGH string")
    j = K.left_join_suffixed(left, right, null_safe=False)
    assert sorted(j.columns) == ["COUGH_x", "COUGH_y", "Sample ID"]
    assert j.count() == 4  # s1 doubles, s2 and the null key keep one row each
    assert K.left_join_suffixed(left, right, null_safe=True).count() == 4


def test_auc_and_ap_with_ties(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8), (1, 0.4)], "y int, s double")
    r = E.ranking_metrics(df, "y", "s").collect()[0]
    # pairs (pos, neg): 0.35>0.1, 0.35<0.4, 0.8>both, 0.4>0.1, 0.4=0.4 (half) -> 4.5 / 6
    assert r.auc == pytest.approx(4.5 / 6)
    # thresholds 0.8: p=1, r=1/3; 0.4: tp=2, fp=1 -> p=2/3, r=2/3; 0.35: tp=3, fp=1 -> p=3/4, r=1
    assert r.avg_precision == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 4)
    one_class = E.ranking_metrics(df.where("y = 1"), "y", "s").collect()[0]
    assert one_class.auc is None


def test_out_of_fold_metrics(spark):
    oof = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.6), (1, 0, 0.4), (0, 0, 0.2)],
                                "true_label int, predicted_label int, probability double")
    m = E.classification_metrics(oof, "true_label", "predicted_label", "probability").collect()[0]
    assert m.accuracy == 0.5 and m.auc == pytest.approx(0.75)
    assert (m.tn, m.fp, m.fn, m.tp) == (1, 1, 1, 1)


def test_family_champion_rule(spark):
    rows = [("logistic_regression", "v1", "aim_a", 0.70, "p1"), ("xgboost", "v2", "aim_a", 0.80, "p2"),
            ("xgboost", "v3", "aim_a", 0.75, "p3"), ("random_forest", "v4", "aim_a", 0.78, "p4"),
            ("logistic_regression", "v1", "aim_b", 0.60, "p5"), ("xgboost", "v2", "aim_b", None, "p6")]
    reg = spark.createDataFrame(rows, "model string, version string, aim string, cv_auc_mean double, model_path string") \
        .withColumn("train_auc", F.lit(None).cast("double"))
    fam = {r.aim: (r.model, r.version) for r in R.family_champion(reg).collect()}
    assert fam["aim_a"] == ("xgboost", "v3")  # best family, then its latest scored version
    ch = {r.aim: (r.model, r.version) for r in R.champion_per_aim(reg).collect()}
    assert ch["aim_a"] == ("xgboost", "v2") and ch["aim_b"] == ("logistic_regression", "v1")
    latest = R.latest_version(reg.union(reg.limit(1).withColumn("version", F.lit("v10")))).where("aim = 'aim_a'").collect()[0]
    assert latest.version == "v10"


def test_only_new_files_are_hashed(spark, tmp_path):
    path, state_at = str(tmp_path / "table with space"), str(tmp_path / "state")
    rows = spark.range(100).selectExpr("id", "cast(id as double) / 7 as x", "if(id % 9 = 0, null, cast(id as string)) as t")
    whole = lambda: A.fingerprint(spark.read.parquet(path)).collect()
    rows.where("id < 60").repartition(3).write.parquet(path)
    A.file_fingerprints(spark, path).write.parquet(state_at + "1")
    state = spark.read.parquet(state_at + "1")
    assert state.count() == 3 and A.files_fingerprint(state).collect() == whole()
    # rows of a known file are taken from the state: a changed state shows in the result
    rows.where("id >= 60").coalesce(1).write.mode("append").parquet(path)
    other = state.withColumn("n_rows", F.col("n_rows") + 1000)
    found = A.file_fingerprints(spark, path, other).collect()
    assert sorted(r["n_rows"] > 999 for r in found) == [False, True, True, True]
    A.file_fingerprints(spark, path, state).write.parquet(state_at + "2")
    state = spark.read.parquet(state_at + "2")
    assert A.files_fingerprint(state).collect() == whole()
    # a file that is gone leaves; nothing new, nothing hashed
    next((tmp_path / "table with space").glob("part-*.parquet")).unlink()
    assert A.file_fingerprints(spark, path, state).count() == 3
    assert A.files_fingerprint(A.file_fingerprints(spark, path, state)).collect() == whole()


def test_no_files_have_the_fingerprint_of_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "a int")
    (tmp_path / "none").mkdir()
    assert A.files_fingerprint(A.file_fingerprints(spark, str(tmp_path / "none"))).collect() == A.fingerprint(empty).collect()


def test_appended_files_meet_when_read(spark, tmp_path):
    path = tmp_path / "registry"
    S.append_rows(spark.createDataFrame([("m", "v1", 0.5)], "model string, version string, auc double"), str(path))
    before = {f: f.read_bytes() for f in path.glob("part-*.parquet")}
    S.append_rows(spark.createDataFrame([("v2", "m", "late")], "version string, model string, notes string"), str(path))
    found = S.read_appended(spark, str(path), ["model", "version"]).orderBy("version")
    assert found.columns == ["model", "version", "auc", "notes"]
    assert [tuple(r) for r in found.collect()] == [("m", "v1", 0.5, None), ("m", "v2", None, "late")]
    assert before and all(f.read_bytes() == b for f, b in before.items())
    with pytest.raises(ValueError, match="auc"):
        S.append_rows(spark.createDataFrame([("x",)], "auc string"), str(path))
    assert S.read_appended(spark, str(path)).count() == 2
