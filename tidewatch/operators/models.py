"""Model fitting, cross-validation, scoring and persistence with Spark ML.

Each fit is a distributed Spark ML job over a vector column; models and folds are
fitted some at a time by driver threads that only launch jobs, so that the short
stages of one fit fill the gaps of another. Training data is
cut from its lineage once (checkpoint in the shared folder, or persisted) so
repeated fits do not re-read and re-encode the sources, and a lost executor
costs a recompute of one partition, not of the whole chain.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from functools import partial
from multiprocessing.pool import ThreadPool
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.labels import confidence
from tidewatch.operators import evaluate as E
from tidewatch.operators.columns import col
from tidewatch.session import cut_lineage

# The reference's model settings.
LR_C = 0.1
TREES = 100
MAX_DEPTH = 3
GBT_ROUNDS = 100
GBT_STEP = 0.1
LOO_MAX_ROWS = 20
#: Folds of one model that are fitted at once.
PARALLEL_FITS = 5
#: Feature values in a partition of training rows, about.
TASK_VALUES = 1 << 21


def concurrently(spark: SparkSession, tasks: Sequence[Callable[[], Any]], parallelism: int) -> list:
    """Results of the tasks in their order, at most ``parallelism`` running at once; the first error is raised."""
    if not tasks:
        return []
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        return pool.map(lambda task: task(), [inheritable_thread_target(spark)(t) for t in tasks], chunksize=1)


def training_rows(df: DataFrame, features: str = "features") -> DataFrame:
    """The rows, cut from their lineage once, in no more partitions than TASK_VALUES asks for.

    A boosted fit runs some 300 short jobs, whose cost rises with their tasks, not with
    the rows, while partitions are small; a fit's partitions grow with the rows from there on.
    """
    data = cut_lineage(df)
    head = data.where(col(features).isNotNull()).select(col(features)).first() if features in data.columns else None
    width = head[0].size if head else len(data.columns)
    return data.coalesce(data.count() * width // TASK_VALUES + 1)


def balanced_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """A17 for training: n / (2 * n_class) per row (broadcast of one row per class)."""
    from tidewatch.operators.profile import balanced_weights
    return balanced_weights(df, label, out)


def positive_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """M3: positives weighted by neg / pos, negatives 1."""
    from tidewatch.operators.columns import attach_row
    ratio = df.agg((F.count_if(col(label) == 0) / F.greatest(F.count_if(col(label) == 1), F.lit(1))).alias("_spw"))
    return attach_row(df, ratio).withColumn(out, F.when(col(label) == 1, F.col("_spw")).otherwise(F.lit(1.0))).drop("_spw")


def logistic(features: str, label: str, weight: str | None, n_weight: float, C: float = LR_C) -> Estimator:
    """M1: L2 logistic regression. Spark minimises the weighted mean loss, so
    regParam = 1 / (C * sum(weights)) reproduces an L2 penalty of strength C on the
    summed loss; no internal standardisation (features are scaled by I4)."""
    lr = LogisticRegression(featuresCol=features, labelCol=label, regParam=1.0 / (C * max(n_weight, 1e-12)),
                            elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-6)
    return lr.setWeightCol(weight) if weight else lr


def forest(features: str, label: str, weight: str | None, seed: int = 42) -> Estimator:
    """M2: random forest, 100 trees of depth 3."""
    rf = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=TREES, maxDepth=MAX_DEPTH, seed=seed)
    return rf.setWeightCol(weight) if weight else rf


def boosted(features: str, label: str, weight: str | None, seed: int = 42) -> Estimator:
    """M3: gradient-boosted trees, 100 rounds of depth 3, step 0.1."""
    gbt = GBTClassifier(featuresCol=features, labelCol=label, maxIter=GBT_ROUNDS, maxDepth=MAX_DEPTH,
                        stepSize=GBT_STEP, seed=seed)
    return gbt.setWeightCol(weight) if weight else gbt


def score(model: Model, df: DataFrame, probability: str = "p1", prediction: str = "prediction") -> DataFrame:
    """M6: probability of class 1, 0/1 prediction and confidence."""
    out = model.transform(df)
    out = out.withColumn(probability, vector_to_array(F.col("probability"))[1])
    out = out.withColumn("confidence", confidence(F.col(probability)))
    return out.withColumn(prediction, F.col("prediction").cast("int"))


def fold_plan(df: DataFrame, keys: Sequence[str], label: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """M5: the folds to use: a row each up to 20 rows (leave one out), else k stratified
    ones, never more than there are rows."""
    from tidewatch.operators.features import fold_column, row_hash
    n = df.count()
    if n <= LOO_MAX_ROWS:
        return df.withColumn(out, (F.row_number().over(Window.orderBy(row_hash(keys, seed), *[col(c) for c in keys])) - 1).cast("int"))
    return fold_column(df, keys, label, min(k, n), seed, out)


def resampler(label: str, keys: Sequence[str], features: str = "features", seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    """I12 before a fit: synthetic minority rows, and both weight columns. ``pos_weight`` is that of the
    rows before oversampling, ``weight`` balances the rows after it, so it is 1."""
    from tidewatch.operators.smote import oversampled

    def resample(train: DataFrame) -> DataFrame:
        arrays = train.withColumn(features, vector_to_array(F.col(features)))
        spw = train.agg(F.count_if(col(label) == 0) / F.greatest(F.count_if(col(label) == 1), F.lit(1))).first()[0]
        rows = oversampled(arrays, label, keys, features, seed).withColumn(features, array_to_vector(F.col(features)))
        rows = rows.withColumn("pos_weight", F.when(col(label) == 1, F.lit(float(spw))).otherwise(F.lit(1.0)))
        return training_rows(balanced_weight(rows, label, "weight"), features)
    return resample


def cross_validate(df: DataFrame, make: Callable[[DataFrame], Estimator], label: str, fold: str,
                   keys: Sequence[str], features: str = "features",
                   resample: Callable[[DataFrame], DataFrame] | None = None,
                   parallelism: int = PARALLEL_FITS) -> tuple[DataFrame, DataFrame]:
    """M5: fit once per fold value on the other folds, score the held-out fold.

    Returns (out-of-fold rows: keys, fold, label, p1, prediction) and per-fold
    metrics (fold, n, auc, accuracy). AUC is null for single-class folds.
    ``resample`` changes a fold's training rows only, never those scored.
    ``parallelism`` folds are fitted at once; the number doesn't change the result.
    """
    return _cross_validated(training_rows(df, features), make, label, fold, keys, resample, parallelism)


def _cross_validated(data: DataFrame, make: Callable[[DataFrame], Estimator], label: str, fold: str, keys: Sequence[str],
                     resample: Callable[[DataFrame], DataFrame] | None, parallelism: int) -> tuple[DataFrame, DataFrame]:
    """``cross_validate`` on rows that are cut from their lineage."""
    folds = [r[0] for r in data.select(fold).distinct().orderBy(fold).collect()]  # k values

    def scored_fold(f) -> DataFrame:
        train = data.where(F.col(fold) != f)
        test = data.where(F.col(fold) == f)
        head = [*keys, F.col(fold).alias("fold"), col(label).alias("true_label")]
        if train.select(label).distinct().count() < 2:
            # nothing to fit: the rows stay, without a score
            return test.select(*head, F.lit(None).cast("double").alias("probability"), F.lit(None).cast("int").alias("predicted_label"))
        if resample:
            train = resample(train)
        m = make(train).fit(train)
        return score(m, test).select(*head, F.col("p1").alias("probability"), F.col("prediction").alias("predicted_label"))

    parts = concurrently(data.sparkSession, [partial(scored_fold, f) for f in folds], parallelism)
    if not parts:
        raise ValueError("no rows to cross-validate")
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    oof = cut_lineage(oof)  # scored once, for all metrics
    per_fold = E.ranking_metrics(oof, "true_label", "probability", groups=["fold"]).join(
        oof.groupBy("fold").agg(F.avg((F.col("true_label") == F.col("predicted_label")).cast("double")).alias("accuracy"),
                                F.count(F.lit(1)).alias("n")), "fold", "right")
    return oof, per_fold.select("fold", "n", "auc", "accuracy")


def cv_summary(oof: DataFrame, per_fold: DataFrame, model_name: str) -> DataFrame:
    """M4/M5: mean and population std of fold AUCs (null folds skipped), plus
    accuracy, precision, recall and F1 of the pooled out-of-fold predictions."""
    auc = per_fold.agg(F.avg("auc").alias("cv_auc_mean"), F.stddev_pop("auc").alias("cv_auc_std"))
    pooled = E.classification_metrics(oof, "true_label", "predicted_label").select("accuracy", "precision", "recall", "f1")
    from tidewatch.operators.columns import attach_row
    return attach_row(auc, pooled).withColumn("model", F.lit(model_name))


def leave_one_group_out(df: DataFrame, make: Callable[[DataFrame], Estimator], label: str, group: str,
                        keys: Sequence[str], discordant: str | None = None, features: str = "features") -> DataFrame:
    """M9: leave-one-group-out (leave-one-out when the group is the row key); the
    7-column record (sample_id, fold, true_label, predicted_label, probability,
    correct, discordant)."""
    oof, _ = cross_validate(df, make, label, group, keys + ([discordant] if discordant else []), features)
    sid = F.concat_ws("|", *[col(k).cast("string") for k in keys])
    return oof.select(sid.alias("sample_id"), F.col("fold").cast("string").alias("fold"), "true_label",
                      "predicted_label", "probability",
                      (F.col("true_label") == F.col("predicted_label")).alias("correct"),
                      (F.coalesce(col(discordant), F.lit(0)) == 1).alias("discordant") if discordant
                      else F.lit(False).alias("discordant"))


def train_all(spark: SparkSession, train: DataFrame, label: str, keys: Sequence[str], aim: str,
              fold: str = "fold", features: str = "features", use_smote: bool = False,
              parallelism: int = PARALLEL_FITS) -> tuple[dict[str, PipelineModel], DataFrame]:
    """M4: fit LR, RF and GBT on the whole training set, cross-validate each on the
    fold column, and return the fitted models with one metadata row per model
    (model, cv_auc_mean, cv_auc_std, train_auc, train_avg_precision, n_train).
    The models go side by side, each with ``parallelism`` folds at once beside the fit on all rows (1: one fit after another)."""
    data = training_rows(balanced_weight(positive_weight(train, label, "pos_weight"), label, "weight"), features)
    makers = {
        # the penalty scale of M1 is the weight total of the rows being fitted (one number)
        "logistic_regression": lambda d: logistic(features, label, "weight", d.agg(F.sum("weight")).collect()[0][0]),
        "random_forest": lambda d: forest(features, label, "weight"),
        "gradient_boosted_trees": lambda d: boosted(features, label, "pos_weight"),
    }
    resample = resampler(label, keys, features) if use_smote else None
    fit_rows = resample(data) if resample else data

    def on_all(make: Callable[[DataFrame], Estimator]) -> tuple[PipelineModel, DataFrame]:
        model = Pipeline(stages=[make(fit_rows)]).fit(fit_rows)
        return model, cut_lineage(score(model, data).select(col(label), "p1"))

    def one(name: str, make: Callable[[DataFrame], Estimator]) -> tuple[PipelineModel, DataFrame]:
        (model, scored), (oof, per_fold) = concurrently(spark, [
            partial(on_all, make), partial(_cross_validated, data, make, label, fold, keys, resample, parallelism)], 1 if parallelism == 1 else 2)
        tr = E.ranking_metrics(scored, label, "p1").select(F.col("auc").alias("train_auc"),
                                                           F.col("avg_precision").alias("train_avg_precision"))
        summ = cv_summary(oof, per_fold, name)
        from tidewatch.operators.columns import attach_row
        return model, (attach_row(attach_row(summ, tr), data.agg(F.count(F.lit(1)).alias("n_train")))
                       .withColumn("aim", F.lit(aim)))

    done = concurrently(spark, [partial(one, n, m) for n, m in makers.items()], 1 if parallelism == 1 else len(makers))
    fitted = {n: model for n, (model, _) in zip(makers, done)}
    rows = [row for _, row in done]
    meta = rows[0]
    for r in rows[1:]:
        meta = meta.unionByName(r)
    return fitted, meta


def importances(model: PipelineModel | Model, slot_names: Sequence[str]) -> DataFrame:
    """Tree feature importances zipped with slot names, largest first."""
    m = model.stages[-1] if isinstance(model, PipelineModel) else model
    vals = m.featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    rows = [(s, float(v)) for s, v in zip(slot_names, vals)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def next_version(registry: DataFrame, aim: str, model: str) -> int:
    """1 + the highest stored version number (a delete cannot cause a collision)."""
    from tidewatch.functions.normalize import version_number
    v = (registry.where((F.col("aim") == aim) & (F.col("model") == model))
         .agg(F.max(version_number(F.col("version")))).collect()[0][0])
    return int(v or 0) + 1


def claim_version(spark: SparkSession, folder: str) -> int:
    """The next version below ``folder``, claimed by a marker that only one writer can create.

    Versions rise by one from 1. Of writers that meet only one creates the marker of a number, and the
    others go on to the next; a failed save leaves its number unused, and deleted models'
    numbers do not come again. The file system's create without overwriting has to be atomic, as
    that of HDFS is; for ``file:`` folders the operating system's is used.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    markers = path(f"{folder.rstrip('/')}/_versions")
    files = markers.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(markers)
    taken = [s.getPath().getName() for s in files.listStatus(markers)]
    version = max([int(t[1:]) for t in taken if t[:1] == "v" and t[1:].isdigit()], default=0) + 1
    while True:
        marker = path(markers, f"v{version}")
        try:
            if files.getScheme() == "file":
                os.close(os.open(marker.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            else:
                files.create(marker, False).close()
            return version
        except (FileExistsError, Py4JJavaError):
            if not files.exists(marker):
                raise
            version += 1


def save_model(model: PipelineModel, base_dir: str, aim: str, name: str) -> tuple[str, int]:
    """Persist under <base>/<aim>/<name>/v<n> with the next version n; (path, n)."""
    folder = f"{base_dir.rstrip('/')}/{aim}/{name}"
    version = claim_version(SparkSession.getActiveSession(), folder)
    path = f"{folder}/v{version}"
    model.write().save(path)
    return path, version


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
