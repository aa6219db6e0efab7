"""Feature attribution for linear models and its aggregates.

For a linear margin w . x + b with interventional (background-mean)
attribution, phi_i = w_i (x_i - mean_i) and the base value is w . mean + b;
the attributions of a row sum to its margin minus the base value. A row's
attributions are one array column, bounded by the model width: folding slots
into features, ranking and summing the rest all happen inside the row, so
nothing is shuffled and rows need no unique key. Long tables are exploded from
the array.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.columns import attach_row, col


def slot_means(background: DataFrame, slots: Sequence[str]) -> DataFrame:
    """(slot, mean) over the background rows (nulls skipped)."""
    wide = background.agg(*[F.avg(col(s).cast("double")).alias(s) for s in slots])
    return wide.unpivot([], list(slots), "slot", "mean")


def linear_rows(df: DataFrame, keys: Sequence[str], weights: Mapping[str, float], intercept: float,
                background: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One row per input row, (keys..., attributions array<struct<slot, value, phi>>),
    and a one-row (base_value) frame. The slot means are one row, attached to every row."""
    slots = list(weights)
    means = slot_means(background if background is not None else df, slots)
    wide = means.agg(F.map_from_entries(F.collect_list(F.struct("slot", "mean"))).alias("__means"))
    items = [F.struct(F.lit(s).alias("slot"), col(s).cast("double").alias("value"),
                      (F.lit(float(w)) * (col(s).cast("double") - F.try_element_at("__means", F.lit(s)))).alias("phi"))
             for s, w in weights.items()]
    rows = attach_row(df, wide).select(*[col(k).alias(k) for k in keys], F.array(*items).alias("attributions"))
    total = sum((F.lit(float(w)) * F.try_element_at("__means", F.lit(s)) for s, w in weights.items()), F.lit(0.0))
    return rows, wide.select((total + F.lit(float(intercept))).alias("base_value"))


def exploded(rows: DataFrame, column: str = "attributions") -> DataFrame:
    """Long form of an attribution array: the other columns and the struct's fields."""
    keep = [c for c in rows.columns if c != column]
    return rows.select(*keep, F.inline_outer(column))


def linear_attribution(df: DataFrame, keys: Sequence[str], weights: Mapping[str, float], intercept: float,
                       background: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """X1 in long form: (keys..., slot, value, phi) and a one-row (base_value) frame."""
    rows, base = linear_rows(df, keys, weights, intercept, background)
    return exploded(rows), base


def global_attribution(phi: DataFrame, base: DataFrame | None = None, feature: str = "slot") -> DataFrame:
    """Per feature, mean |phi|, population std of phi and n (plus the base value)."""
    g = phi.groupBy(F.col(feature).alias("feature")).agg(
        F.avg(F.abs("phi")).alias("mean_abs"), F.stddev_pop("phi").alias("std"), F.count(F.lit(1)).alias("n"))
    return attach_row(g, base) if base is not None else g


def instance_attribution(rows: DataFrame, keys: Mapping[str, object]) -> DataFrame:
    """The attributions of the instances with these key values (pushed down to the scan)."""
    cond = F.lit(True)
    for k, v in keys.items():
        cond = cond & (col(k) == F.lit(v))
    return rows.where(cond)


def fold_slots(rows: DataFrame, slot_map: Mapping[str, str], column: str = "attributions") -> DataFrame:
    """Sum slot attributions into their source features with the encoder's own
    slot -> feature map, inside each row. Zero sums are kept; the array becomes
    array<struct<feature, phi>> in the order of the map."""
    def phi(feature: str) -> Column:
        own = [s for s, f in slot_map.items() if f == feature]
        return F.aggregate(F.filter(column, lambda x: x["slot"].isin(own)), F.lit(0.0), lambda acc, x: acc + x["phi"])
    features = list(dict.fromkeys(slot_map.values()))
    folded = F.array(*[F.struct(F.lit(f).alias("feature"), phi(f).alias("phi")) for f in features])
    return rows.withColumn(column, folded)


def ranked_importance(global_df: DataFrame, top_n: int = 20) -> DataFrame:
    """Features ranked by mean |phi| (ties by name), the first ``top_n``.

    The input holds one row per feature, so the global order is cheap.
    """
    w = Window.orderBy(F.desc("mean_abs"), F.asc("feature"))
    return global_df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def top_n_with_others(rows: DataFrame, feature: str = "feature", top_n: int = 12, column: str = "attributions") -> DataFrame:
    """Per row, the ``top_n`` largest |phi| by name and the rest summed as 'others'
    (array<struct<name, phi>>; ties go to the smaller name). Sorted inside the row."""
    by_size = F.array_sort(F.transform(column, lambda x: F.struct((-F.abs(x["phi"])).alias("size"), x[feature].alias("name"), x["phi"].alias("phi"))))
    entry = lambda x: F.struct(x["name"].alias("name"), x["phi"].alias("phi"))
    rest = F.slice(by_size, top_n + 1, F.greatest(F.size(by_size) - top_n, F.lit(0)))
    others = F.array(F.struct(F.lit("others").alias("name"), F.aggregate(rest, F.lit(0.0), lambda acc, x: acc + x["phi"]).alias("phi")))
    top = F.transform(F.slice(by_size, 1, top_n), entry)
    return rows.withColumn(column, F.when(F.size(column) > top_n, F.concat(top, others)).otherwise(top))


def as_maps(rows: DataFrame, feature: str = "feature", column: str = "attributions") -> DataFrame:
    """One map<feature, phi> per row (bounded by the number of features)."""
    return rows.withColumn(column, F.map_from_entries(F.transform(column, lambda x: F.struct(x[feature], x["phi"]))))


def dependence(phi: DataFrame, feature_value: str = "value", which: str | None = None, feature: str = "slot") -> DataFrame:
    """X11: (value, phi) pairs of one feature."""
    out = phi if which is None else phi.where(F.col(feature) == which)
    return out.select(F.col(feature).alias("feature"), F.col(feature_value).alias("value"), "phi")
