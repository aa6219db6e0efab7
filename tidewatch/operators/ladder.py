"""Value ladder: exact cumulative counts over ordered distinct values.

Several operators need running sums in value order (two-sample KS, exact
quantiles for PSI edges and medians, exact AUC / average precision, ROC and PR
curves). A window ``partitionBy(key).orderBy(value)`` would sort every
distinct value of one key inside one task, which does not survive a
continuous column at scale. The ladder instead, at every size:

1. starts from a table already aggregated to one row per (key, value)
   (partial aggregation happens map side, so hot values cost one row);
2. splits each key's value range into ranges by ``approx_percentile`` over the
   distinct values (the split only balances the work, the result stays exact).
   The number of ranges follows the session's shuffle partitions, so a range
   holds about as much of a key as a task holds of a shuffle; a value finds its
   range by binary search, one generated comparison per halving;
3. sums the weights per (key, range), a table of at most keys x ranges rows,
   and turns them into offsets with a window over that small table;
4. runs the running sum inside each (key, range) and adds the offset.

The bounds (one row per key) are joined on the key and a salt, so the rows of
one key never meet in one task; the joins carry no hint, AQE broadcasts what it
has measured as small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import shuffle_partitions

# Tasks that share the rows of one key while they look up their range.
SALTS = 16


def default_buckets(counts: DataFrame) -> int:
    """Ranges per key: the shuffle partitions, rounded up to a power of two."""
    return 1 << max(1, (shuffle_partitions(counts.sparkSession) - 1).bit_length())


def order_number(value: str, kind: str) -> Column:
    """A double that never falls as the value rises; values with equal numbers share a range.

    For strings the first six bytes, read as a number.
    """
    if kind == "string":
        head = F.rpad(F.hex(F.substring(F.col(value).cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    return F.col(value).cast("double")


def matched(rows: DataFrame, lookup: DataFrame, keys: list[str], last: str) -> DataFrame:
    """Inner join on the keys, where null is a key like any other, and on ``last``."""
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    other = lookup.withColumnsRenamed(names | {last: "_key_last"})
    on = F.col(last) == F.col("_key_last")
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return rows.join(other, on, "inner").drop("_key_last", *names.values())


def with_range(counts: DataFrame, keys: list[str], value: str, buckets: int) -> DataFrame:
    """Add ``_bucket``: how many of the key's bounds lie below the value."""
    kind = dict(counts.dtypes)[value]
    probs = [i / buckets for i in range(1, buckets)]
    numbered = counts.withColumn("_number", order_number(value, kind))
    bounds = (numbered.groupBy(*keys)
              .agg(F.percentile_approx("_number", probs, max(10000, 50 * buckets)).alias("_bounds"))
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    out = matched(numbered.withColumn("_salt", F.pmod(F.hash(value), F.lit(SALTS))), bounds, keys, "_salt").drop("_salt")
    out = out.withColumn("_bucket", F.lit(0))
    size = 1 << (buckets - 1).bit_length()
    while size > 1:
        size //= 2
        # beyond the last bound get() is null, and the search stays on the left
        step = F.when(F.get("_bounds", F.col("_bucket") + (size - 1)) < F.col("_number"), size).otherwise(0)
        out = out.withColumn("_bucket", F.col("_bucket") + step)
    return out.drop("_bounds", "_number")


def value_ladder(counts: DataFrame, keys: list[str], value: str, weights: list[str],
                 buckets: int | None = None, descending: bool = False) -> DataFrame:
    """Add ``cum_<w>`` (inclusive running sum in value order) and ``tot_<w>``.

    ``counts`` must hold one row per (keys..., value), without null values. With
    ``descending=True`` the running sums go from the largest value down.
    ``buckets`` sets the ranges per key; any number gives the same result.
    """
    buckets = buckets or default_buckets(counts)
    order_col = F.col(value).desc() if descending else F.col(value).asc()
    with_bucket = with_range(counts, keys, value, buckets)
    if descending:
        with_bucket = with_bucket.withColumn("_bucket", -F.col("_bucket"))

    per_bucket = with_bucket.groupBy(*keys, "_bucket").agg(*[F.sum(w).alias(f"_bs_{w}") for w in weights])
    w_prev = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = per_bucket.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_bs_{w}").over(w_prev), F.lit(0)).alias(f"_off_{w}") for w in weights],
        *[F.sum(f"_bs_{w}").over(w_all).alias(f"tot_{w}") for w in weights])

    w_run = Window.partitionBy(*keys, "_bucket").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    out = matched(with_bucket, offsets, keys, "_bucket")
    return out.select(*counts.columns,
                      *[(F.col(f"_off_{w}") + F.sum(w).over(w_run)).alias(f"cum_{w}") for w in weights],
                      *[F.col(f"tot_{w}") for w in weights])


def rank_lookup(ladder: DataFrame, keys: list[str], value: str, weight: str,
                targets: DataFrame, ranks_col: str = "ranks") -> DataFrame:
    """Values at given 0-based ranks of the weighted, value-ordered multiset.

    ``targets`` holds one row per key with an array of wanted ranks (bounded
    length, broadcast). A ladder row covers ranks
    [cum - weight, cum); every wanted rank inside that interval maps to its
    value. Returns (keys..., rank, value) rows.
    """
    lo = F.col(f"cum_{weight}") - F.col(weight)
    hi = F.col(f"cum_{weight}")
    hits = (ladder.where(F.col(weight) > 0)
            .join(F.broadcast(targets), on=keys, how="inner")
            .withColumn("_hit", F.filter(ranks_col, lambda r: (r >= lo) & (r < hi)))
            .where(F.size("_hit") > 0)
            .select(*keys, F.explode("_hit").alias("rank"), F.col(value).alias("value")))
    return hits


def quantiles_linear(ladder: DataFrame, keys: list[str], value: str, weight: str,
                     probs: DataFrame, probs_col: str = "probs", extra: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy's default method).

    ``probs`` holds one row per key with an array of probabilities and a
    total ``n`` column. Returns (keys..., quantiles array) in the order of the
    probabilities. Interpolation: a + (b - a) t, or b - (b - a)(1 - t) when
    t >= 0.5, as numpy does. ``probs`` may hold several rows per key (e.g.
    one per bin count), told apart by the ``extra`` columns that are kept.
    """
    extra = list(extra or [])
    prep = probs.withColumn(
        "_h", F.transform(probs_col, lambda p: p * (F.col("n") - 1).cast("double")))
    prep = prep.withColumn("ranks", F.array_distinct(F.flatten(F.transform(
        "_h", lambda h: F.array(F.floor(h).cast("long"),
                                F.least(F.floor(h).cast("long") + 1, F.col("n") - 1))))))
    targets = prep.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list("ranks"))).alias("ranks")) \
        if extra else prep.select(*keys, "ranks")
    found = rank_lookup(ladder, keys, value, weight, targets)
    rank_map = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_vals"))
    joined = prep.join(rank_map, on=keys, how="inner")

    def interp(h):
        lo_i = F.floor(h).cast("long")
        hi_i = F.least(lo_i + 1, F.col("n") - 1)
        a = F.try_element_at("_vals", lo_i)
        b = F.try_element_at("_vals", hi_i)
        t = h - lo_i.cast("double")
        return F.when(t >= 0.5, b - (b - a) * (1.0 - t)).otherwise(a + (b - a) * t)

    return joined.select(*keys, *extra, F.transform("_h", interp).alias("quantiles"))
