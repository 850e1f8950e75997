"""Descriptive statistics of a value per group, exact also for very large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.fixed_values import TRIM_EACH_SIDE
from triagelake.session import cut_lineage

QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
STAT_COLUMNS = ["n", "mean", "std", "min", *QUANTILES, "max", "non_zero_ratio"]
HOT_GROUP_ROWS = 1_000_000
HOT_BINS = 256  # at least; more, so that a bin keeps to about HOT_GROUP_ROWS values


def trimmed(df: DataFrame, keys: list[str], value: str, trim: Column, side: int) -> DataFrame:
    """Drops the ``side`` smallest and largest values of groups with more than 2*side values."""
    by_value = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    whole = Window.partitionBy(*keys)
    ranked = df.withColumn("_rank", F.row_number().over(by_value)).withColumn(
        "_n", F.count(value).over(whole)
    )
    inner = (F.col("_rank") > F.lit(side)) & (F.col("_rank") <= F.col("_n") - F.lit(side))
    keep = ~trim | (F.col("_n") <= F.lit(2 * side)) | inner
    return ranked.where(keep).drop("_rank", "_n")


def _small_groups(df, keys, value, trim, side) -> DataFrame:
    rows = df if trim is None else trimmed(df, keys, value, trim, side)
    v = F.col(value)
    cuts = F.percentile(v, list(QUANTILES.values()))
    described = rows.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), cuts.alias("_q"), F.max(v).alias("max"),
        F.avg((v != F.lit(0.0)).cast("int")).alias("non_zero_ratio"),
    )
    parts = [F.col("_q")[i].alias(name) for i, name in enumerate(QUANTILES)]
    return described.select(*keys, "n", "mean", "std", "min", *parts, "max", "non_zero_ratio")


def _hot_groups(df, keys, value, trim, side, bins) -> DataFrame:
    """The same statistics from value counts, binned by value so that a group is split."""
    v = F.col(value)
    flag = F.lit(False) if trim is None else trim
    weights = df.where(v.isNotNull()).withColumn("_trim", flag).groupBy(
        *keys, "_trim", value).agg(F.count(F.lit(1)).alias("_c"))
    measured = _hot_counts(weights, keys, value, side, bins)
    return measured.unionByName(_empty_groups(df.groupBy(*keys).agg(F.count(v).alias("n")), keys))


def _empty_groups(sizes: DataFrame, keys: list[str]) -> DataFrame:
    none = F.lit(None).cast("double")
    return sizes.where(F.col("n") == F.lit(0)).select(
        *keys, "n", *[none.alias(c) for c in STAT_COLUMNS if c != "n"])


def _hot_counts(weights, keys, value, side, bins) -> DataFrame:
    """Statistics of counts ``_c`` per value, groups split over bins of values.

    Approximate quantiles of the distinct values serve only as bin borders; ranks inside and
    across bins are exact.
    """
    v = F.col(value)
    weights = cut_lineage(weights)
    steps = [i / bins for i in range(1, bins)]
    borders = weights.groupBy(*keys).agg(
        F.percentile_approx(v, steps, 10 * bins).alias("_borders")
    )
    binned = cut_lineage(
        weights.join(borders, keys)
        .withColumn("_bin", F.size(F.filter("_borders", lambda border: border < v)))
        .withColumn("_middle", F.element_at("_borders", F.lit(bins // 2)))
        .drop("_borders")
    )
    by_bin = Window.partitionBy(*keys).orderBy("_bin")
    sizes = binned.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_size"))
    offsets = sizes.select(
        *keys, "_bin",
        (F.sum("_size").over(by_bin) - F.col("_size")).alias("_before"),
        F.sum("_size").over(Window.partitionBy(*keys)).alias("_n"),
    )
    in_bin = Window.partitionBy(*keys, "_bin").orderBy(value)
    ranked = binned.join(offsets, [*keys, "_bin"]).withColumn(
        "_end", F.sum("_c").over(in_bin) + F.col("_before")
    )
    cut = F.when(F.col("_trim") & (F.col("_n") > F.lit(2 * side)), F.lit(side)).otherwise(0)
    ranked = ranked.withColumn("_cut", cut.cast("long"))
    low = F.greatest(F.col("_end") - F.col("_c"), F.col("_cut")) - F.col("_cut")
    high = F.least(F.col("_end"), F.col("_n") - F.col("_cut")) - F.col("_cut")
    kept = (
        ranked.withColumn("_low", low).withColumn("_high", high)
        .withColumn("_m", F.col("_n") - F.lit(2) * F.col("_cut"))
        .withColumn("_w", F.col("_high") - F.col("_low")).where(F.col("_w") > F.lit(0))
    )
    picks = []
    for name, q in QUANTILES.items():
        place = (F.col("_m") - F.lit(1)) * F.lit(q)
        for end, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            inside = (F.col("_low") <= rank) & (rank < F.col("_high"))
            picks.append(F.max(F.when(inside, v)).alias(f"_{name}_{end}"))
    weight = F.col("_w")
    nonzero = F.when(v != F.lit(0.0), weight).otherwise(F.lit(0))
    centre = kept.groupBy(*keys).agg(
        F.sum(weight).alias("n"), (F.sum(v * weight) / F.sum(weight)).alias("mean"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        (F.sum(nonzero) / F.sum(weight)).alias("non_zero_ratio"),
        F.sum(weight * F.pow(v - F.col("_middle"), 2)).alias("_squares"),
        F.max("_middle").alias("_middle"), *picks,
    )
    # squares are taken around a middle value, close to the mean, to keep their precision
    squares = F.col("_squares") - F.col("n") * F.pow(F.col("mean") - F.col("_middle"), 2)
    quantiles = []
    for name, q in QUANTILES.items():
        place = (F.col("n") - F.lit(1)) * F.lit(q)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        quantiles.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    std = F.when(F.col("n") > F.lit(1), F.sqrt(
        F.greatest(squares, F.lit(0.0)) / (F.col("n") - F.lit(1))))
    measured = centre.select(
        *keys, "n", "mean", std.alias("std"), "min", *quantiles, "max", "non_zero_ratio"
    )
    return measured


def _small_counts(counts, keys, value, weight, trim, side) -> DataFrame:
    """Statistics of counted values, one task per group: weights are cut by their ranks."""
    v = F.col(value)
    present = F.when(v.isNotNull(), F.col(weight)).otherwise(F.lit(0)).cast("long")
    ordered = Window.partitionBy(*keys).orderBy(v.asc_nulls_last())
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = counts.select(*keys, value, present.alias("_c"), trim.alias("_trim")).select(
        "*", F.sum("_c").over(upto).alias("_end"), F.sum("_c").over(whole).alias("_n"),
        F.min(v).over(whole).alias("_base"))
    cut = F.when(F.col("_trim") & (F.col("_n") > F.lit(2 * side)), F.lit(side)).otherwise(
        F.lit(0)).cast("long")
    inside = F.least(F.col("_end"), F.col("_n") - cut) - F.greatest(
        F.col("_end") - F.col("_c"), cut)
    rows = rows.withColumn("_w", F.greatest(inside, F.lit(0)).cast("long"))
    w = F.col("_w")
    kept = F.when(w > F.lit(0), v)
    # squares are taken above the least value, so large values keep their precision
    above = v - F.col("_base")
    found = rows.groupBy(*keys).agg(
        F.sum(w).alias("n"), F.sum(w * v).alias("_total"), F.sum(w * above).alias("_sum"),
        F.sum(w * above * above).alias("_squares"), F.min(kept).alias("min"),
        F.max(kept).alias("max"),
        F.sum(F.when(v != F.lit(0.0), w).otherwise(F.lit(0))).alias("_nonzero"),
        F.percentile(kept, list(QUANTILES.values()), w).alias("_q"),
    )
    n = F.col("n")
    mean = F.when(n > F.lit(0), F.col("_total") / n).alias("mean")
    spread = F.greatest(F.col("_squares") - F.col("_sum") * F.col("_sum") / n, F.lit(0.0))
    std = F.when(n > F.lit(1), F.sqrt(spread / (n - F.lit(1))))
    parts = [F.col("_q")[i].alias(name) for i, name in enumerate(QUANTILES)]
    share = F.when(n > F.lit(0), F.col("_nonzero") / n).alias("non_zero_ratio")
    return found.select(*keys, "n", mean, std.alias("std"), "min", *parts, "max", share)


def describe_counts(
    counts: DataFrame,
    keys: list[str],
    value: str = "value",
    weight: str = "count",
    trim: Column | None = None,
    side: int = TRIM_EACH_SIDE,
    hot_rows: int | None = HOT_GROUP_ROWS,
) -> DataFrame:
    """What ``describe`` gives for a table that holds each row ``weight`` times.

    A value may be counted in several rows. NULL values count as rows without a value, so a
    group that has nothing else appears with ``n = 0``.
    """
    flag = F.lit(False) if trim is None else trim
    if hot_rows is None:
        return _small_counts(counts, keys, value, weight, flag, side)
    sizes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    largest = sizes.agg(F.max("_rows")).first()[0]
    if largest is None or largest <= hot_rows:
        return _small_counts(counts, keys, value, weight, flag, side)
    hot_keys = cut_lineage(sizes.where(F.col("_rows") > F.lit(hot_rows)).drop("_rows"))
    bins = max(HOT_BINS, -(-largest // HOT_GROUP_ROWS))
    small = counts.join(hot_keys, keys, "left_anti")
    hot = counts.join(hot_keys, keys, "left_semi")
    v = F.col(value)
    weights = hot.where(v.isNotNull()).withColumn("_trim", flag).groupBy(
        *keys, "_trim", value).agg(F.sum(weight).cast("long").alias("_c"))
    present = F.sum(F.when(v.isNotNull(), F.col(weight)).otherwise(F.lit(0))).cast("long")
    empty = _empty_groups(hot.groupBy(*keys).agg(present.alias("n")), keys)
    return _small_counts(small, keys, value, weight, flag, side).unionByName(
        _hot_counts(weights, keys, value, side, bins)).unionByName(empty)


def describe(
    df: DataFrame,
    keys: list[str],
    value: str = "value",
    trim: Column | None = None,
    side: int = TRIM_EACH_SIDE,
    hot_rows: int | None = HOT_GROUP_ROWS,
) -> DataFrame:
    """Count, mean, deviation, extremes, quantiles and share of non-zero values per group.

    ``trim`` marks the rows whose group loses its extreme values. Groups of more than
    ``hot_rows`` rows take a path that splits them over many tasks; keys must not be NULL.
    Whether there are any is found out first, by a count that is combined before its shuffle
    and reads no values. Set ``hot_rows=None`` where every group is known to be bounded.
    """
    if hot_rows is None:
        return _small_groups(df, keys, value, trim, side)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    largest = sizes.agg(F.max("_rows")).first()[0]
    if largest is None or largest <= hot_rows:
        return _small_groups(df, keys, value, trim, side)
    hot_keys = cut_lineage(sizes.where(F.col("_rows") > F.lit(hot_rows)).drop("_rows"))
    bins = max(HOT_BINS, -(-largest // HOT_GROUP_ROWS))
    small = df.join(hot_keys, keys, "left_anti")
    hot = df.join(hot_keys, keys, "left_semi")
    return _small_groups(small, keys, value, trim, side).unionByName(
        _hot_groups(hot, keys, value, trim, side, bins)
    )
