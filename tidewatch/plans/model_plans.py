"""Model queries (M1-M12, I13, E2) on ``embeddings`` and ``labels`` x ``documents``.

Fitted models are not bit-equal to other libraries' fits, so queries that return
fitted numbers have no SQL oracle; others return what must hold of them.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators import features as FT
from tidewatch.operators import models as M
from tidewatch.operators.columns import attach_row
from tidewatch.plans.catalog import SLOW, register
from tidewatch.session import checkpoint_dir, ensure_local_checkpoint_dir
from tidewatch.sources.tables import read_table



def embeddings_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    df = e.select("vec_id", array_to_vector(F.col("embedding")).alias("features"),
                  (F.col("label") >= 5).cast("int").alias("label"))
    return FT.fold_column(df, ["vec_id"], "label", 5, 42)


def _lr_maker(label="label"):
    return lambda d: M.logistic("features", label, "weight", d.agg(F.sum("weight")).collect()[0][0])


@register("model_cv_logistic_embeddings", None, ("M1", "M5", "E2", "A17"))
def model_cv_logistic_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.balanced_weight(embeddings_frame(spark, sf_dir), "label")
    oof, per_fold = M.cross_validate(df, _lr_maker(), "label", "fold", ["vec_id"])
    return per_fold.withColumn("model", F.lit("logistic_regression"))


@register("model_cv_checks_embeddings", """
SELECT count(*) AS n, count(DISTINCT vec_id) AS n_distinct, count(*) AS n_scored, count(*) AS n_equal, 5::BIGINT AS n_folds,
       true AS folds_even, count(*) AS n_in_folds FROM embeddings""", ("M1", "M5", "E2"))
def model_cv_checks_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of cross-validation: every row scored once, in five folds of even size, and
    alike whether folds are fitted side by side or one after another."""
    df = M.cut_lineage(M.balanced_weight(embeddings_frame(spark, sf_dir), "label"))
    side, per_fold = M.cross_validate(df, _lr_maker(), "label", "fold", ["vec_id"])
    apart, _ = M.cross_validate(df, _lr_maker(), "label", "fold", ["vec_id"], parallelism=1)
    apart = apart.select("vec_id", F.col("probability").alias("other"))
    rows = side.join(apart, "vec_id").agg(
        F.count("*").alias("n"), F.countDistinct("vec_id").alias("n_distinct"), F.count("probability").alias("n_scored"),
        F.count_if(F.abs(F.col("probability") - F.col("other")) < 1e-9).alias("n_equal"))
    # a fold has a fifth of each class, up to a row
    folds = per_fold.agg(F.count("*").alias("n_folds"), (F.max("n") - F.min("n") <= 2).alias("folds_even"), F.sum("n").alias("n_in_folds"))
    return attach_row(rows, folds)


@register("model_train_all_embeddings", None, ("M2", "M3", "M4", "M11", "I13"))
def model_train_all_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    models, meta = M.train_all(spark, embeddings_frame(spark, sf_dir), "label", ["vec_id"], "embeddings")
    base = checkpoint_dir(spark) or ensure_local_checkpoint_dir(spark)
    root = f"{base.rstrip('/')}/models-{uuid.uuid4().hex[:8]}"
    paths = [(name, *M.save_model(m, root, "embeddings", name)) for name, m in models.items()]
    p = spark.createDataFrame(paths, "model string, model_path string, version int")
    return meta.drop("version").join(p.withColumn("version", F.concat(F.lit("v"), "version")), "model")


SLOW.add("model_train_all_embeddings")


@register("model_loo_documents", None, ("M9", "E2", "E10"))
def model_loo_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-language-out logistic regression on document length."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lb = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lb, "doc_id").select("doc_id", "lang", F.col("quality").alias("label"), "toxic",
                                    array_to_vector(F.array(F.log1p(F.col("n_chars").cast("double")))).alias("features"))
    j = M.balanced_weight(j, "label")
    return M.leave_one_group_out(j, _lr_maker(), "label", "lang", ["doc_id"], discordant="toxic")


@register("model_importance_embeddings", None, ("M2", "M12"))
def model_importance_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.balanced_weight(embeddings_frame(spark, sf_dir), "label")
    m = M.forest("features", "label", "weight").fit(df)
    return M.importances(m, [f"dim_{i}" for i in range(len(m.featureImportances))])


@register("model_batch_score_embeddings", None, ("M6", "M8", "I13", "C15"))
def model_batch_score_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the hash split's train rows, persist, load back, score the test rows."""
    df = M.balanced_weight(FT.hash_rank_split(embeddings_frame(spark, sf_dir), ["vec_id"], "label", 0.2, 42), "label")
    train = df.where(~F.col("is_test"))
    from pyspark.ml import Pipeline
    model = Pipeline(stages=[_lr_maker()(train)]).fit(train)
    base = checkpoint_dir(spark) or ensure_local_checkpoint_dir(spark)
    path, _ = M.save_model(model, f"{base.rstrip('/')}/models-{uuid.uuid4().hex[:8]}", "embeddings", "logistic_regression")
    loaded = M.load_model(path)
    return M.score(loaded, df.where(F.col("is_test"))).select("vec_id", "label", "p1", "prediction", "confidence")


@register("model_versions_embeddings", """
SELECT v::INTEGER AS version, (SELECT count(*) FROM embeddings) AS n, (SELECT count(*) FROM embeddings) AS n_equal FROM range(1, 4) t(v)""",
          ("M11", "I13", "M1"))
def model_versions_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model saved three times: versions 1 to 3, and every row scored alike by each one loaded and the one in memory."""
    from pyspark.ml import Pipeline
    df = M.balanced_weight(embeddings_frame(spark, sf_dir), "label")
    model = Pipeline(stages=[_lr_maker()(df)]).fit(df)
    base = checkpoint_dir(spark) or ensure_local_checkpoint_dir(spark)
    root = f"{base.rstrip('/')}/models-{uuid.uuid4().hex[:8]}"
    mine = M.score(model, df).select("vec_id", F.col("p1").alias("own"))
    out = None
    for _ in range(3):
        path, version = M.save_model(model, root, "embeddings", "logistic_regression")
        both = M.score(M.load_model(path), df).select("vec_id", "p1").join(mine, "vec_id")
        row = both.agg(F.lit(version).alias("version"), F.count("*").alias("n"), F.count_if(F.col("p1") == F.col("own")).alias("n_equal"))
        out = row if out is None else out.unionByName(row)
    return out


@register("model_importance_checks_embeddings", """
SELECT 64::BIGINT AS n_features, true AS sums_to_one, true AS falling, true AS none_negative""", ("M2", "M12"))
def model_importance_checks_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a forest's importances: one a feature, shares of one, largest first."""
    df = M.balanced_weight(embeddings_frame(spark, sf_dir), "label")
    m = M.forest("features", "label", "weight").fit(df)
    rows = M.importances(m, [f"dim_{i}" for i in range(len(m.featureImportances))])
    # one row a feature
    ranked = rows.withColumn("at", F.monotonically_increasing_id())
    before = F.lag("importance").over(Window.orderBy("at"))
    return ranked.withColumn("before", before).agg(
        F.count("*").alias("n_features"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"),
        F.coalesce(F.bool_and(F.col("before").isNull() | (F.col("before") >= F.col("importance"))), F.lit(False)).alias("falling"),
        F.bool_and(F.col("importance") >= 0).alias("none_negative"))


@register("model_tree_attribution_embeddings", None, ("X2", "M2", "X3"))
def model_tree_attribution_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact path-dependent Shapley values of a 100-tree, depth-3 forest for every
    embedding row, aggregated to the global importance table (X3)."""
    from tidewatch.operators import attribution as X
    from tidewatch.operators.tree_attribution import tree_attribution
    df = M.balanced_weight(embeddings_frame(spark, sf_dir), "label")
    m = M.forest("features", "label", "weight").fit(df)
    phi, base = tree_attribution(df, m, ["vec_id"], [f"dim_{i}" for i in range(64)], kind="rf")
    return X.global_attribution(phi, base)


SLOW.add("model_tree_attribution_embeddings")


@register("model_forest_background_embeddings", "SELECT count(*) AS n, count(*) AS n_additive FROM embeddings", ("X2", "M2"))
def model_forest_background_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapley values of a forest against 100 background rows: for every row they add up to
    its probability less the background's mean."""
    from tidewatch.operators.tree_attribution import tree_attribution
    df = M.cut_lineage(M.balanced_weight(embeddings_frame(spark, sf_dir), "label"))
    m = M.forest("features", "label", "weight").fit(df)
    phi, base = tree_attribution(df, m, ["vec_id"], [f"dim_{i}" for i in range(64)], "rf", background=df, max_background=100)
    total = attach_row(phi.groupBy("vec_id").agg(F.sum("phi").alias("total")), base)
    scored = M.score(m, df).select("vec_id", "p1").join(total, "vec_id", "left")
    off = F.abs(F.col("total") + F.col("base_value") - F.col("p1"))
    return scored.agg(F.count("*").alias("n"), F.count_if(off < 1e-6).alias("n_additive"))
