"""Profiling aggregates.

Per-column statistics are computed for all columns in one pass over an
unpivoted long frame, so the number of jobs does not grow with the number of
columns. Exact quantiles use the value ladder (no per-group buffer of all
values); moments use ordinary partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.binning import equal_width_bin, open_range
from tidewatch.operators.columns import attach_row, col, is_numeric_type, numeric_columns
from tidewatch.operators.ladder import quantiles_linear, value_ladder


def numeric_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value double) with nulls and NaN dropped."""
    return (df.select(*[col(c).cast("double").alias(c) for c in cols])
            .unpivot([], list(cols), "feature", "value")
            .where(F.col("value").isNotNull() & ~F.isnan("value")))


def text_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, category string) with nulls dropped."""
    return (df.select(*[col(c).cast("string").alias(c) for c in cols])
            .unpivot([], list(cols), "feature", "category")
            .where(F.col("category").isNotNull()))


def exact_quantiles(long: DataFrame, probs: Sequence[float], buckets: int | None = None) -> DataFrame:
    """(feature, quantiles array) with linear interpolation, from a long frame."""
    return quantiles_of_counts(long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")), probs, buckets)


def quantiles_of_counts(counts: DataFrame, probs: Sequence[float], buckets: int | None = None) -> DataFrame:
    """The same from (feature, value, n)."""
    lad = value_ladder(counts, ["feature"], "value", ["n"], buckets=buckets)
    targets = lad.groupBy("feature").agg(F.first("tot_n").alias("n")).withColumn(
        "probs", F.array(*[F.lit(float(p)) for p in probs]))
    return quantiles_linear(lad, ["feature"], "value", "n", targets)


def numeric_profile(df: DataFrame, cols: Sequence[str] | None = None, buckets: int | None = None) -> DataFrame:
    """A1: (feature, n, mean, std, min, max, q25, q50, q75); std is the sample std."""
    cols = numeric_columns(df, cols)
    long = numeric_long(df, cols)
    moments = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(long, [0.25, 0.5, 0.75], buckets)
    return moments.join(q, "feature", "left").select(
        "feature", "n", "mean", "std", "min", "max", F.col("quantiles")[0].alias("q25"),
        F.col("quantiles")[1].alias("q50"), F.col("quantiles")[2].alias("q75"))


def categorical_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A2: normalised value counts among non-null values, long form (feature, category, n, share).

    Kept long: a per-feature map would put every category of a high-cardinality
    column into one row.
    """
    long = text_long(df, cols)
    counts = long.groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("_tot"))
    return (counts.join(F.broadcast(totals), "feature")
            .select("feature", "category", "n", (F.col("n") / F.col("_tot")).alias("share")))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """A3: (value, count) over non-null values."""
    return df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def overview(df: DataFrame) -> DataFrame:
    """A4: rows, columns and overall missing share in percent, rounded to 1."""
    n_cols = len(df.columns)
    nulls = [F.sum(col(c).isNull().cast("long")) for c in df.columns]
    total_null = nulls[0]
    for x in nulls[1:]:
        total_null = total_null + x
    return df.agg(F.count(F.lit(1)).alias("rows"), total_null.alias("_nulls")).select(
        "rows", F.lit(n_cols).cast("long").alias("columns"),
        F.round(F.try_divide(F.col("_nulls") * 100.0, F.col("rows") * n_cols), 1).alias("missing_pct"))


def missing_share(df: DataFrame, top_n: int = 20) -> DataFrame:
    """A5: missing share per column, largest first, top n, only > 0 (the limit is the report)."""
    shares = df.agg(*[F.avg(col(c).isNull().cast("double")).alias(c) for c in df.columns])
    long = shares.unpivot([], df.columns, "column", "missing_share")
    return long.orderBy(F.desc("missing_share"), "column").limit(top_n).where(F.col("missing_share") > 0)


def histogram(df: DataFrame, column: str, bins: int = 20, by: str | None = None) -> DataFrame:
    """Numpy-style fixed-width histogram, optionally one per group (each with its own range).

    Returns (group?, bin, lo, hi, count); empty bins are included.
    """
    keys = [by] if by else []
    base = df.select(*[col(k).alias(k) for k in keys], col(column).cast("double").alias("v")).where(
        F.col("v").isNotNull() & ~F.isnan("v"))
    if by:
        base = base.where(F.col(by).isNotNull())
    rng = base.groupBy(*keys).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    first, last = open_range(F.col("_lo"), F.col("_hi"))
    rng = rng.select(*keys, first.alias("first"), last.alias("last"), F.lit(bins).cast("long").alias("nb"))
    counted = (base.join(rng, keys, "inner") if keys else attach_row(base, rng)).withColumn(
        "bin", equal_width_bin(F.col("v"), F.col("first"), F.col("last"), F.col("nb")))
    counts = counted.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(*keys, "first", "last", "nb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("bin"))
    step = (F.col("last") - F.col("first")) / F.col("nb")
    out = grid.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("bin") * step + F.col("first")).alias("lo"),
        F.when(F.col("bin") == F.col("nb") - 1, F.col("last")).otherwise((F.col("bin") + 1) * step + F.col("first")).alias("hi"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    return out


def prevalence(df: DataFrame, cols: Sequence[str], token: str = "YES", over_all_rows: bool = False) -> DataFrame:
    """Share of ``token`` per column, in percent, with its count.

    A7 divides by the non-null count; A8 (``over_all_rows``) by all rows.
    """
    long = df.select(*[col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "feature", "value")
    agg = long.groupBy("feature").agg(
        F.count_if(F.col("value") == token).alias("count"), F.count("value").alias("non_null"),
        F.count(F.lit(1)).alias("rows"))
    denom = F.col("rows") if over_all_rows else F.col("non_null")
    return agg.select("feature", F.coalesce(F.try_divide(F.col("count") * 100.0, denom), F.lit(0.0)).alias("pct"),
                      "count")


def factor_counts(df: DataFrame, cols: Sequence[str], token: str = "YES") -> DataFrame:
    """Count of ``token`` per column."""
    long = df.select(*[col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "feature", "value")
    return long.groupBy("feature").agg(F.count_if(F.col("value") == token).alias("count"))


def stacked_counts(df: DataFrame, cols: Sequence[str], levels: Sequence[str] = ("YES", "NO")) -> DataFrame:
    """A10: per column, the count of each level (pivot with the levels given up front)."""
    long = df.select(*[col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "feature", "value")
    piv = long.groupBy("feature").pivot("value", list(levels)).agg(F.count(F.lit(1)))
    return piv.select("feature", *[F.coalesce(F.col(f"`{lv}`"), F.lit(0)).cast("long").alias(lv) for lv in levels])


def crosstab_pct(df: DataFrame, row: str, column: str) -> DataFrame:
    """Row-normalised cross tab in percent, long form (row, column, pct)."""
    base = df.where(col(row).isNotNull() & col(column).isNotNull())
    cnt = base.groupBy(col(row).alias("row_value"), col(column).alias("column_value")).agg(F.count(F.lit(1)).alias("n"))
    tot = cnt.groupBy("row_value").agg(F.sum("n").alias("_rt"))
    return cnt.join(tot, "row_value").select("row_value", "column_value", (F.col("n") * 100.0 / F.col("_rt")).alias("pct"))


def multi_flag_count(df: DataFrame, flags: Sequence[str], at_least: int = 2) -> DataFrame:
    """Rows with at least ``at_least`` flags set."""
    total = sum((F.coalesce(col(f).cast("long"), F.lit(0)) for f in flags[1:]), F.coalesce(col(flags[0]).cast("long"), F.lit(0)))
    return df.agg(F.count_if(total >= at_least).alias("rows"))


def describe(df: DataFrame, cols: Sequence[str] | None = None, buckets: int | None = None) -> DataFrame:
    """describe(include='all') in long form.

    Numeric columns: count, mean, std, min, 25%, 50%, 75%, max (exact
    quantiles). Text columns: count, unique, top (most frequent, smallest on
    ties), freq.
    """
    cols = list(cols) if cols is not None else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in cols if is_numeric_type(types[c])]
    txt = [c for c in cols if c not in num]
    spark = df.sparkSession
    out = spark.createDataFrame([], "feature string, count long, mean double, std double, min double, q25 double, "
                                    "q50 double, q75 double, max double, unique long, top string, freq long")
    if num:
        p = numeric_profile(df, num, buckets)
        out = out.unionByName(p.select("feature", F.col("n").alias("count"), "mean", "std", "min", "q25", "q50", "q75",
                                       "max"), allowMissingColumns=True)
    if txt:
        cnt = text_long(df, txt).groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n"))
        agg = cnt.groupBy("feature").agg(
            F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
            F.min_by(F.struct(F.col("category").alias("top"), F.col("n").alias("freq")),
                     F.struct((-F.col("n")).alias("neg"), F.col("category"))).alias("_top"))
        out = out.unionByName(agg.select("feature", "count", "unique", "_top.top", "_top.freq"), allowMissingColumns=True)
    return out


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False,
                    rsd: float = 0.01) -> DataFrame:
    """Non-null distinct count per column (HyperLogLog++ when ``approximate``)."""
    cols = list(cols) if cols is not None else df.columns
    fn = (lambda c: F.approx_count_distinct(col(c), rsd)) if approximate else (lambda c: F.count_distinct(col(c)))
    wide = df.agg(*[fn(c).alias(c) for c in cols])
    return wide.unpivot([], cols, "feature", "n_distinct")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Negatives, positives, neg/pos ratio (positive weight) and smallest class size."""
    return df.agg(F.count_if(col(label) == 0).alias("n_neg"), F.count_if(col(label) == 1).alias("n_pos")).select(
        "n_neg", "n_pos", F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos")).alias("scale_pos_weight"),
        F.least("n_neg", "n_pos").alias("min_class_size"))


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """N / (n_classes * n_class) per row, from a broadcast one-row-per-class table."""
    counts = df.groupBy(col(label).alias("_lbl")).agg(F.count(F.lit(1)).alias("_nc"))
    totals = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = attach_row(counts, totals).select("_lbl", (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(out))
    # one row per class: bounded by the label domain
    return df.join(F.broadcast(w), col(label).eqNullSafe(F.col("_lbl")), "left").drop("_lbl")


def row_text(df: DataFrame, cols: Sequence[str]) -> Column:
    """Row text for fingerprints: doubles as DECIMAL(38,6), nulls as \\N."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for c in cols:
        x = col(c)
        if type(types[c]).__name__ in ("DoubleType", "FloatType"):
            x = F.round(x, 6).cast("decimal(38,6)")
        parts.append(F.coalesce(x.cast("string"), F.lit("\\N")))
    return F.concat_ws("|", *parts)


def _hash_sums(hashed: Column) -> list[Column]:
    """What a fingerprint is made of; rows of these sums add up to those of all their rows."""
    return [F.count(F.lit(1)).alias("n_rows"), F.sum(hashed.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(hashed).alias("hash_xor")]


def _fingerprint_text() -> Column:
    return F.concat_ws("-", F.coalesce("hash_sum", F.lit(0).cast("decimal(38,0)")).cast("string"),
                       F.lower(F.lpad(F.hex(F.coalesce("hash_xor", F.lit(0))), 15, "0"))).alias("fingerprint")


def _row_hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def fingerprint(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Order-insensitive table fingerprint: row count, and sum and exclusive or of 60-bit md5 prefixes.

    The sum is a decimal, so it holds for any number of rows.

    Unlike a hash over the rows in order, it does not change when Spark reads
    the table in another order or partitioning.
    """
    cols = list(cols) if cols is not None else df.columns
    return df.select(_row_hash(row_text(df, cols)).alias("_h")).agg(*_hash_sums(F.col("_h"))).select("n_rows", _fingerprint_text())


FILE_KEY = ["file", "size", "modified"]


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, modified, location) of the Parquet files below a folder; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    meta = files.metadataColumn("_metadata")
    return files.select(meta["file_path"].alias("file"), meta["file_size"].alias("size"),
                        meta["file_modification_time"].alias("modified"), F.col("path").alias("location"))


def file_fingerprints(spark: SparkSession, path: str, state: DataFrame | None = None, cols: Sequence[str] | None = None) -> DataFrame:
    """A18 by file: (file, size, modified, n_rows, hash_sum, hash_xor), one row for each file with rows.

    Files that ``state`` (an earlier result, written to a folder of its own) has with the same size and
    time keep their row; only the others are read and hashed, so a check costs what has been added. Files that are
    gone leave. A file rewritten with the same size within the clock's tick is taken for the old one. The driver
    holds the names of new files alone, as any read of them does. ``cols`` should be
    named and stay the same where files may differ in their columns. No files, or only empty
    ones, give no rows.
    """
    files = source_files(spark, path)
    kept = state.join(files, FILE_KEY, "left_semi") if state is not None else None
    new = files.join(state, FILE_KEY, "left_anti") if state is not None else files
    places = [r.location for r in new.select("location").collect()]
    if not places:
        if kept is not None:
            return kept
        return spark.createDataFrame([], "file string, size long, modified timestamp, n_rows long, hash_sum decimal(38,0), hash_xor long")
    rows = spark.read.option("basePath", path).parquet(*places)
    meta = rows.metadataColumn("_metadata")
    hashed = (rows.select(meta["file_path"].alias("file"), meta["file_size"].alias("size"), meta["file_modification_time"].alias("modified"),
                          _row_hash(row_text(rows, list(cols) if cols is not None else rows.columns)).alias("_h"))
              .groupBy(*FILE_KEY).agg(*_hash_sums(F.col("_h"))))
    hashed = hashed.withColumn("hash_sum", F.col("hash_sum").cast("decimal(38,0)"))
    return hashed if kept is None else kept.unionByName(hashed)


def files_fingerprint(state: DataFrame) -> DataFrame:
    """The fingerprint of all files of a state: equal to ``fingerprint`` of their rows."""
    return state.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.sum("hash_sum").alias("hash_sum"),
                     F.bit_xor("hash_xor").alias("hash_xor")).select("n_rows", _fingerprint_text())


def changed_since(current: DataFrame, state: DataFrame) -> DataFrame:
    """Compare a fresh fingerprint with the stored one (one-row state table).

    A missing state counts as changed.
    """
    cur = current.select(F.col("n_rows").alias("current_rows"), F.col("fingerprint").alias("current_fingerprint"))
    old = state.select(F.col("n_rows").alias("stored_rows"), F.col("fingerprint").alias("stored_fingerprint"))
    joined = (cur.withColumn("__one", F.lit(1))
              .join(old.withColumn("__one", F.lit(1)), "__one", "left").drop("__one"))
    return joined.withColumn("changed", F.coalesce(F.col("current_fingerprint") != F.col("stored_fingerprint"), F.lit(True)))
