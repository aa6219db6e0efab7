"""Feature matrix preparation (I4-I11, I14): imputation, scaling, one-hot
encoding, slot names, deterministic splits and folds.

A fitted preprocessor is data: a one-row frame of fill values, means and
population standard deviations, and a table of the one-hot slots, one row a
level, written once. ``sparse`` looks each value's slot up in that table by a
join, so a column may have any number of levels; ``transform`` makes a column of each
slot, for few.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.columns import attach_row, col
from tidewatch.operators.impute import feature_roles
from tidewatch.operators.ladder import value_ladder
from tidewatch.operators.profile import numeric_long, quantiles_of_counts, text_long
from tidewatch.session import written

BINARY_FILL = "NO"
#: Slots that ``transform`` makes columns of, at most.
MAX_COLUMNS = 5_000


@dataclass
class Preprocessor:
    numeric: list[str]
    categorical: list[str]
    binary: list[str]
    params: DataFrame                      # one row: __med_i, __mean_i, __std_i, __mode_j
    slots: DataFrame                       # (feature, level, slot, name) of categorical and binary columns
    width: dict[str, tuple[int, int]] = field(default_factory=dict)   # column -> first slot, number of slots

    @property
    def size(self) -> int:
        return len(self.numeric) + sum(n for _, n in self.width.values())

    def encoded(self) -> list[str]:
        """The columns with one-hot slots, in slot order."""
        return [c for c in [*self.categorical, *self.binary] if self.width.get(c, (0, 0))[1]]

    def levels(self) -> list[tuple[str, str, str]]:
        """(feature, level, name) in slot order, for matrices of few columns."""
        if self.size > MAX_COLUMNS:
            raise ValueError(f"{self.size} slots are too many for columns: use sparse() or vectors()")
        return [(r["feature"], r["level"], r["name"]) for r in self.slots.orderBy("slot").collect()]

    def slot_names(self) -> list[str]:
        """I8: numeric names, then one slot per categorical level, then binary slots."""
        return [*self.numeric, *[name for _, _, name in self.levels()]]

    def slot_table(self) -> DataFrame:
        """I8 as a table, for any number of slots: (slot, name, feature)."""
        spark = self.slots.sparkSession
        rows = spark.createDataFrame([(i, c, c) for i, c in enumerate(self.numeric)], "slot long, name string, feature string")
        return rows.unionByName(self.slots.select("slot", "name", "feature"))

    def slot_map(self, spark) -> DataFrame:
        """(slot, feature) pairs for folding attributions back."""
        return self.slot_table().select(F.col("name").alias("slot"), "feature")


def split_roles(df: DataFrame, feature_cols: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
    """I3 as three plan-time lists (one aggregate for the distinct counts)."""
    roles = {r["feature"]: r["role"] for r in feature_roles(df, feature_cols).collect()}  # one row per column
    cols = [c for c in feature_cols if c in roles]
    return ([c for c in cols if roles[c] == "numeric"], [c for c in cols if roles[c] == "categorical"],
            [c for c in cols if roles[c] == "binary"])


def fit_preprocessor(train: DataFrame, feature_cols: Sequence[str], numeric: Sequence[str] | None = None,
                     categorical: Sequence[str] | None = None, binary: Sequence[str] | None = None) -> Preprocessor:
    """I4-I6 fitted on ``train`` only: median + mean + population std for numeric
    columns (the mean and std of the median-filled column), most frequent level
    for categorical ones, 'NO' for binary ones. Counts of values and of levels are taken once and
    written, as the ladders and the modes read them several times; so are the parameters."""
    if numeric is None or categorical is None or binary is None:
        numeric, categorical, binary = split_roles(train, feature_cols)
    numeric, categorical, binary = list(numeric), list(categorical), list(binary)
    spark = train.sparkSession
    parts = []
    if numeric:
        values = numeric_long(train, numeric).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        med = quantiles_of_counts(written(values, "feature-values"), [0.5]).select("feature", F.col("quantiles")[0].alias("m"))
        med_row = med.groupBy().pivot("feature", numeric).agg(F.first("m"))
        med_row = med_row.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(f"__med_{i}") for i, c in enumerate(numeric)])
        med_row = written(med_row, "feature-medians")
        filled = attach_row(train.select(*[col(c).cast("double").alias(f"__x_{i}") for i, c in enumerate(numeric)]), med_row)
        filled = filled.select(*[F.coalesce(F.col(f"__x_{i}"), F.col(f"__med_{i}")).alias(f"__x_{i}") for i in range(len(numeric))])
        mom = filled.agg(*[F.avg(f"__x_{i}").alias(f"__mean_{i}") for i in range(len(numeric))],
                         *[F.stddev_pop(f"__x_{i}").alias(f"__std_{i}") for i in range(len(numeric))])
        parts += [med_row, mom]
    found = []
    if categorical:
        cnt = written(text_long(train, categorical).groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n")), "feature-counts")
        mode = cnt.groupBy("feature").agg(F.min_by("category", F.struct((-F.col("n")).alias("neg"), "category")).alias("m"))
        mode_row = mode.groupBy().pivot("feature", categorical).agg(F.first("m"))
        parts.append(mode_row.select(*[F.col(f"`{c}`").alias(f"__mode_{j}") for j, c in enumerate(categorical)]))
        found.append(cnt.select("feature", "category", F.lit(False).alias("binary")))
    if binary:
        filled = train.select(*[F.coalesce(col(c).cast("string"), F.lit(BINARY_FILL)).alias(c) for c in binary])
        found.append(written(text_long(filled, binary).distinct(), "feature-binary").select("feature", "category", F.lit(True).alias("binary")))
    slots, width = _slots(spark, found, [*categorical, *binary], len(numeric))
    params = parts[0] if parts else spark.range(1).select()
    for p in parts[1:]:
        params = attach_row(params, p)
    if parts:
        params = written(params, "feature-params")
    return Preprocessor(numeric, categorical, binary, params, slots, width)


def _slots(spark, found: list[DataFrame], order: list[str], first: int) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """(feature, level, slot, name) and each column's first slot and number of slots.

    Levels are numbered in their order by the ladder, so no column's levels meet in one task. A
    binary column of two levels has a slot for the larger alone.
    """
    if not found:
        return spark.createDataFrame([], "feature string, level string, slot long, name string"), {}
    levels = found[0]
    for f in found[1:]:
        levels = levels.unionByName(f)
    ladder = value_ladder(levels.withColumn("one", F.lit(1).cast("long")), ["feature", "binary"], "category", ["one"])
    pair = F.col("binary") & (F.col("tot_one") == 2)
    ranked = ladder.where(~pair | (F.col("cum_one") == 2)).select(
        "feature", F.col("category").alias("level"), F.when(pair, 0).otherwise(F.col("cum_one") - 1).alias("rank"))
    ranked = written(ranked, "feature-levels")
    counts = {r["feature"]: r["n"] for r in ranked.groupBy("feature").agg(F.count("*").alias("n")).collect()}  # one row a column
    width, at = {}, first
    for c in order:
        width[c] = (at, counts.get(c, 0))
        at += counts.get(c, 0)
    starts = spark.createDataFrame([(c, a) for c, (a, _) in width.items()], "feature string, start long")
    return ranked.join(F.broadcast(starts), "feature").select(
        "feature", "level", (F.col("start") + F.col("rank")).alias("slot"), F.concat("feature", F.lit("_"), "level").alias("name")), width


def transform(pre: Preprocessor, df: DataFrame, keep: Sequence[str] = (), assemble: bool = False,
              output: str = "features") -> DataFrame:
    """One projection producing the slot columns in matrix order (numeric,
    categorical, binary); unknown categories become all zeros; other columns are
    dropped except ``keep``. ``assemble`` adds a vector column for Spark ML. For at most MAX_COLUMNS slots."""
    j = attach_row(df, pre.params)
    out = [col(k) for k in keep]
    for i, c in enumerate(pre.numeric):
        x = F.coalesce(col(c).cast("double"), F.col(f"__med_{i}"))
        std = F.col(f"__std_{i}")
        out.append(F.when(std > 0, (x - F.col(f"__mean_{i}")) / std).otherwise(x - F.col(f"__mean_{i}")).alias(c))
    filled = _filled(pre)
    out += [(filled[c] == F.lit(lv)).cast("double").alias(name) for c, lv, name in pre.levels()]
    res = j.select(*out)
    if assemble:
        res = VectorAssembler(inputCols=pre.slot_names(), outputCol=output, handleInvalid="keep").transform(res)
    return res


def _filled(pre: Preprocessor) -> dict[str, F.Column]:
    """The text of each encoded column, nulls filled; over rows with the parameters attached."""
    out = {c: F.coalesce(col(c).cast("string"), F.col(f"__mode_{j}")) for j, c in enumerate(pre.categorical)}
    return out | {c: F.coalesce(col(c).cast("string"), F.lit(BINARY_FILL)) for c in pre.binary}


def _indexed(pre: Preprocessor, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows with ``keep``, __n_i (scaled numbers) and __s_j: each encoded column's slot, null for levels not seen in fitting.

    A join with the column's levels: broadcast where they are few, else on the level.
    """
    j = attach_row(df, pre.params)
    filled = _filled(pre)
    out = [col(k).alias(k) for k in keep]
    for i, c in enumerate(pre.numeric):
        x = F.coalesce(col(c).cast("double"), F.col(f"__med_{i}")) - F.col(f"__mean_{i}")
        out.append(F.when(F.col(f"__std_{i}") > 0, x / F.col(f"__std_{i}")).otherwise(x).alias(f"__n_{i}"))
    names = pre.encoded()
    rows = j.select(*out, *[filled[c].alias(f"__v_{k}") for k, c in enumerate(names)])
    for k, c in enumerate(names):
        own = pre.slots.where(F.col("feature") == F.lit(c)).select(F.col("level").alias(f"__l_{k}"), F.col("slot").alias(f"__s_{k}"))
        rows = rows.join(own, F.col(f"__v_{k}") == F.col(f"__l_{k}"), "left").drop(f"__v_{k}", f"__l_{k}")
    return rows


def sparse(pre: Preprocessor, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """I4-I7 for any number of levels: ``keep``, slots array<long>, values array<double> (rising slots, no zeros)."""
    rows = _indexed(pre, df, keep)
    cells = [F.struct(F.lit(i).cast("long").alias("slot"), F.col(f"__n_{i}").alias("value")) for i in range(len(pre.numeric))]
    cells += [F.struct(F.col(f"__s_{k}").alias("slot"), F.lit(1.0).alias("value")) for k in range(len(pre.encoded()))]
    if not cells:
        return rows.select(*keep, F.array().cast("array<bigint>").alias("slots"), F.array().cast("array<double>").alias("values"))
    row = F.filter(F.array(*cells), lambda x: x["slot"].isNotNull() & (x["value"] != 0.0))
    return rows.withColumn("__row", row).select(*keep, F.col("__row.slot").alias("slots"), F.col("__row.value").alias("values"))


def vectors(pre: Preprocessor, df: DataFrame, keep: Sequence[str] = (), output: str = "features") -> DataFrame:
    """The same as a sparse vector column for Spark ML."""
    rows = _indexed(pre, df, keep)
    inputs = [f"__n_{i}" for i in range(len(pre.numeric))]
    for k, c in enumerate(pre.encoded()):
        first, n = pre.width[c]
        # one index more than there are levels, and the last dropped: unseen levels are all zeros
        index = F.coalesce(F.col(f"__s_{k}") - first, F.lit(n)).cast("double")
        rows = rows.withColumn(f"__i_{k}", index.alias(f"__i_{k}", metadata={"ml_attr": {"type": "nominal", "num_vals": n + 1}}))
    names = list(range(len(pre.encoded())))
    if names:
        encoder = OneHotEncoder(inputCols=[f"__i_{k}" for k in names], outputCols=[f"__o_{k}" for k in names], dropLast=True)
        rows = encoder.fit(rows).transform(rows)
    return VectorAssembler(inputCols=[*inputs, *[f"__o_{k}" for k in names]], outputCol=output, handleInvalid="keep").transform(rows).select(*keep, output)


def row_hash(key: Sequence[str], seed: int) -> F.Column:
    """60-bit order key from md5(key|seed): reproducible across partitionings and engines."""
    text = F.concat_ws("|", *[F.coalesce(col(k).cast("string"), F.lit("\\N")) for k in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _hash_ladder(df: DataFrame, key: Sequence[str], label: str, seed: int) -> tuple[DataFrame, F.Column]:
    """Per-class ladder over the row hashes: (label, h, n, cum_n, tot_n), computed with
    range buckets so no class is sorted inside one task."""
    h = row_hash(key, seed)
    counts = df.groupBy(col(label).alias("_lbl"), h.alias("_h")).agg(F.count(F.lit(1)).alias("n"))
    return value_ladder(counts, ["_lbl"], "_h", ["n"]), h


def hash_rank_split(df: DataFrame, key: Sequence[str], label: str, test_size: float = 0.2, seed: int = 42,
                    out: str = "is_test") -> DataFrame:
    """Stratified split: within each class, rows in row_hash(key, seed) order; the
    first round(test_size * n_class) go to test (no test rows when test_size * n < 1).

    Exact and distributed: the per-class hash threshold is found on the ladder
    (a rank lookup), broadcast (one row per class) and compared row by row, so the
    data is not joined or sorted. Rows sharing a hash fall on the same side.
    """
    n_total = df.count()  # one number: the reference's empty-test rule needs it
    if test_size * n_total < 1:
        return df.withColumn(out, F.lit(False))
    lad, h = _hash_ladder(df, key, label, seed)
    lad = lad.persist()
    want = lad.groupBy("_lbl").agg(F.first("tot_n").alias("tot")).select(
        "_lbl", (F.round(F.col("tot") * test_size).cast("long") - 1).alias("_r"))
    thr = (lad.join(F.broadcast(want), "_lbl")
           .where((F.col("_r") >= F.col("cum_n") - F.col("n")) & (F.col("_r") < F.col("cum_n")))
           .select("_lbl", F.col("_h").alias("_thr")))
    joined = df.join(F.broadcast(thr), col(label).eqNullSafe(F.col("_lbl")), "left")
    return joined.withColumn(out, F.coalesce(h <= F.col("_thr"), F.lit(False))).drop("_lbl", "_thr")


def fold_column(df: DataFrame, key: Sequence[str], label: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """M5 folds: stratified round robin over the per-class hash order (fold = rank mod k).

    Ranks come from the distributed ladder and are joined back on (label, hash)."""
    lad, h = _hash_ladder(df, key, label, seed)
    ranks = lad.select("_lbl", F.col("_h").alias("_rh"), (F.col("cum_n") - F.col("n")).alias("_rank"))
    j = df.withColumn("_h", h).join(ranks, (col(label).eqNullSafe(F.col("_lbl"))) & (F.col("_h") == F.col("_rh")), "left")
    return j.withColumn(out, (F.col("_rank") % k).cast("int")).drop("_lbl", "_h", "_rh", "_rank")


def background_sample(df: DataFrame, key: Sequence[str], n: int = 500, seed: int = 42) -> DataFrame:
    """All rows when there are at most n, else the n rows first in hash order
    (reproducible; the limit is the sampling operator itself)."""
    return df.orderBy(row_hash(key, seed)).limit(n)
